"""Subject areas of documents by label propagation.

The graph has documents and terms as nodes; two documents are similar over the terms they share. An edge counts only if its
term is verified as one that concentrates in a subject among the labelled documents, and weighs less the more documents the
term stands in. Labels spread from documents to terms and back by joins until they no longer change: hand-given labels that
the graph confirms stay clamped, others are released, and every node keeps a weight for each subject and may gain one it
did not begin with. The subjects that a document has weight for are then checked exactly: each sentence goes to the subject
of its terms, and a document has every subject that enough of its sentences treat.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from corvid.session import prepare, sent, stage

SHARE = 0.25
#: A subject must also hold this share of all sentences, terms or none, so that a mention in junk is no subject.
LEAST_OF_ALL = 0.05
#: Rounds end when the terms' weights, summed over the subjects, moved by TOLERANCE or less on average, or after so many.
ROUNDS, TOLERANCE = 12, 0.01
#: A term is verified if, with 95 % confidence, at least this share of its labelled documents has one subject, and it
#: stands in at least this share of the labelled documents (which also bounds their number) and in four of them.
PURITY, TERM_SHARE, TERM_DOCS = 0.3, 0.002, 4
Z = 1.64
#: A given label is trusted, and clamped, if the graph gives it at least this weight in the document.
TRUST = 0.2
#: A document is checked for the subjects that it has at least this weight for.
CANDIDATE = 0.05
#: A term that a longer one contains follows that one if it is at most this many times as frequent.
SAME = 1.15
#: What a term may take over from a document for a subject that it has no weight for itself.
OPEN = 0.02
#: The part of a term's weights that its documents give; the rest stays that of the labelled documents it was verified by.
TAKEN = 0.5
#: Bits of a term's number beside a sentence's; there are fewer than 500 times a document's distinct terms.
BITS = 22
GRAM = (2, 4)
#: Shorter pieces, in characters, are no sentences; the second is for those with Chinese characters.
MIN_LATIN, MIN_CHINESE = 40, 12

_WORD = re.compile(r"[一-鿿]+|(?<![\w\-/`])[^\W\d_一-鿿]+(?![\w\-/`])")
_END = re.compile(r"([.!?])\s+")
_CHINESE = re.compile(r"[一-鿿]")


def terms_of(text: str) -> set[str]:
    """Words and neighbouring word pairs (parts of identifiers are no words), and short runs of Chinese characters."""
    low = text.lower()
    out: set[str] = set()
    prev, end = None, -9
    for m in _WORD.finditer(low):
        w = m.group()
        if "一" <= w[0] <= "鿿":
            for n in range(GRAM[0], GRAM[1] + 1):
                out.update(w[i : i + n] for i in range(len(w) - n + 1))
            prev = None
            continue
        out.add(w)
        if prev and m.start() == end + 1 and low[end] == " ":
            out.add(prev + " " + w)
        prev, end = w, m.end()
    return out


def sentences_of(text: str) -> list[str]:
    """The sentences of a text in lower case: cut behind end marks and at line ends; short pieces are no sentences."""
    text = _END.sub("\\1\n", text.lower()).replace("\r", "\n")
    for mark in "。！？":
        text = text.replace(mark, mark + "\n")
    return [s for s in text.split("\n") if len(s) >= MIN_LATIN or len(s) >= MIN_CHINESE and _CHINESE.search(s)]


def clean_labels(labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject) of labels that name a subject of the list, apart from case and outer white space; each once."""
    name = lambda c: F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    known = subjects.select(name("subject").alias("key"), F.col("subject").alias("name"))
    return (
        labels.where("doc_id IS NOT NULL")
        .select("doc_id", name("subject").alias("key"))
        .join(F.broadcast(known), "key")
        .select("doc_id", F.col("name").alias("subject"))
        .distinct()
    )


def verified_terms(docs: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """(term, n, p0, p1, ...): verified terms with their count and the share of each subject among their labelled documents.
    As each stands in a share of TERM_SHARE of the labelled documents, there are at most 1 / TERM_SHARE times as many as a
    document has terms on average, however many documents there are."""
    index = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    lab = stage(labels.groupBy("doc_id").agg(F.collect_set(index[F.col("subject")]).alias("s")), "labelled")
    n = lab.count()
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(sent(lab), "doc_id")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[set[str], list[int]]]:
        for b in batches:
            for text, ss in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                yield terms_of(text), ss

    counts = texts.mapInArrow(lambda batches: counted(pairs(batches)), COUNTED)
    return verified(counts, len(names), F.lit(float(n)), PURITY)


COUNTED = "term string, s int, n bigint"


def counted(pairs: Iterator[tuple[set[str], list[int]]]) -> Iterator[pa.RecordBatch]:
    """Batches of COUNTED from (terms, subjects) of documents, summed as far as a task's memory allows."""
    held: Counter = Counter()

    def flush():
        keys = list(held)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([held[k] for k in keys], pa.int64())], ["term", "s", "n"]
        )

    for terms, ss in pairs:
        for s in ss:
            held.update((t, s) for t in terms)
        if len(held) > 400_000:
            yield flush()
            held.clear()
    if held:
        yield flush()


def verified(counts: DataFrame, count: int, docs, purity: float) -> DataFrame:
    """(term, n, p0, p1, ...) of the COUNTED terms that stand in enough of the ``docs`` and concentrate in a subject."""
    wide = counts.groupBy("term").agg(*[F.sum(F.when(F.col("s") == i, F.col("n")).otherwise(0)).alias(f"c{i}") for i in range(count)])
    cs = [F.col(f"c{i}") for i in range(count)]
    n = reduce(lambda a, b: a + b, cs)
    wide = wide.withColumn("n", n).where(F.col("n") >= F.greatest(F.lit(float(TERM_DOCS)), TERM_SHARE * docs))
    p, m = (F.greatest(*cs) if count > 1 else cs[0]) / F.col("n"), F.col("n")
    low = (p + Z * Z / (2 * m) - Z * F.sqrt(p * (1 - p) / m + Z * Z / (4 * m * m))) / (1 + Z * Z / m)
    return wide.where(low >= purity).select("term", "n", *[(c / F.col("n")).alias(f"p{i}") for i, c in enumerate(cs)])


class Finder:
    """Finds verified terms in sentences by one automaton, made once a process."""

    def __init__(self, shared):
        self.shared, self.made = shared, None

    def __getstate__(self):
        return {"shared": self.shared, "made": None}

    def automaton(self):
        if self.made is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for i, w in enumerate(self.shared.value[0]):
                # Chinese runs may stand anywhere, words only between other signs: their length says where they begin.
                a.add_word(w, (i, 0 if "一" <= w[0] <= "鿿" else len(w)))
            a.make_automaton()
            self.made = a
        return self.made

    def hits(self, sentences: list[str], out: list[int]) -> None:
        """Adds sentence << BITS | term for every hit."""
        if not self.shared.value[0]:
            return
        find, add = self.automaton().iter, out.append
        for k, s in enumerate(sentences):
            base, size = k << BITS, len(s)
            for e, (i, m) in find(s):
                if m:
                    f = e - m
                    if f >= 0 and (s[f].isalnum() or s[f] in "-/`") or e + 1 < size and (s[e + 1].isalnum() or s[e + 1] in "-/`"):
                        continue
                add(base | i)


def followed(rows: list[tuple[str, int]]) -> np.ndarray:
    """For terms with their counts, in order, the place of the term that each follows: a longer one that contains it (a pair with
    the word, a Chinese run with the shorter run) and is nearly as frequent, as both would say the same twice; else its own."""
    place = {t: i for i, (t, _) in enumerate(rows)}
    best = np.arange(len(rows))
    for i, (term, n) in enumerate(rows):
        if " " in term:
            parts = term.split(" ")
        elif "一" <= term[0] <= "鿿":
            parts = [term[a:b] for a in range(len(term)) for b in range(a + GRAM[0], len(term) + 1) if b - a < len(term)]
        else:
            continue
        for q in parts:
            k = place.get(q)
            if k is not None and rows[k][1] <= SAME * n and (best[k] == k or rows[best[k]][1] < n):
                best[k] = i
    while (best[best] != best).any():
        best = best[best]
    return best


def hashes_of(sentences: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(s.encode("utf-8", "replace")) for s in sentences], np.uint64).view(np.int64)


def sentence_hashes(texts: DataFrame) -> DataFrame:
    """(hash): the hashes of all sentences of a table of texts, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(hashes_of([s for t in b.column(0).to_pylist() for s in sentences_of(t)]))], ["hash"])

    prepare(texts.sparkSession)
    return texts.where("text IS NOT NULL").select("text").mapInArrow(run, "hash bigint").distinct()


HITS = "doc_id bigint, n int, hashes array<bigint>, at array<int>, term array<int>, only array<int>, tf array<int>"


def term_hits(docs: DataFrame, terms: list[str], follows: np.ndarray, hashes: bool = False) -> DataFrame:
    """(doc_id, n, hashes, at, term, only, tf): per document the number of sentences and (if asked for) their hashes, each hit's
    sentence and term number, and its edges: the distinct terms that follow no other, with their counts. Terms are found by
    one automaton over each sentence."""
    spark = docs.sparkSession
    finder = Finder(spark.sparkContext.broadcast((terms, follows == np.arange(len(terms)))))
    low = (1 << BITS) - 1

    def lists(offsets: np.ndarray, values: np.ndarray, kind=np.int32) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(kind)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = finder.shared.value[1]
        for b in batches:
            codes: list[int] = []
            n, ends, sentences = [], [0], []
            for text in b.column(1).to_pylist():
                ss = sentences_of(text or "")
                finder.hits(ss, codes)
                n.append(len(ss))
                ends.append(len(codes))
                sentences.extend(ss)
            ends, flat = np.array(ends), np.array(codes, np.int64)
            term = flat & low
            row = np.repeat(np.arange(b.num_rows), np.diff(ends))
            edge = own[term] if len(term) else np.zeros(0, bool)
            edges, tf = np.unique(row[edge] << BITS | term[edge], return_counts=True)
            at = np.searchsorted(edges, np.arange(b.num_rows + 1) << BITS)
            size = np.array(n, np.int64) if hashes else np.zeros(b.num_rows, np.int64)
            hs = hashes_of(sentences) if hashes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int32()), lists(np.concatenate([[0], np.cumsum(size)]), hs, np.int64), lists(ends, flat >> BITS), lists(ends, term), lists(at, edges & low), lists(at, tf)],
                ["doc_id", "n", "hashes", "at", "term", "only", "tf"],
            )

    prepare(spark)
    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(find, HITS).where("n > 0")


def without(hits: DataFrame, skip: DataFrame) -> DataFrame:
    """``hits`` without the sentences whose hash is in ``skip`` (hash): they have no terms and do not count, in ``live``."""
    held = hits.select("doc_id", F.posexplode("hashes").alias("k", "hash")).join(sent(skip), "hash")
    held = stage(held.groupBy("doc_id").agg(F.collect_set("k").alias("ks")), "skipped")
    full = hits.join(sent(held), "doc_id", "left")
    keep = F.filter(F.arrays_zip("at", "term"), lambda x: ~F.array_contains("ks", x["at"]))
    some = F.col("ks").isNotNull()
    full = full.withColumn("kept", F.when(some, keep))
    terms = F.transform("kept", lambda x: x["term"])
    return full.withColumns(
        {
            "live": F.when(some, F.col("n") - F.size("ks")).otherwise(F.col("n")),
            "at": F.when(some, F.transform("kept", lambda x: x["at"])).otherwise(F.col("at")),
            "term": F.when(some, terms).otherwise(F.col("term")),
            "only": F.when(some, F.array_intersect("only", terms)).otherwise(F.col("only")),
            "tf": F.when(some, F.transform(F.array_intersect("only", terms), lambda t: F.size(F.filter(terms, lambda x: x == t)))).otherwise(F.col("tf")),
        }
    ).drop("ks", "kept", "hashes").where("live > 0")


def propagate(hits: DataFrame, start: DataFrame, seeds: DataFrame, count: int, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """(documents, terms) after propagation: documents (doc_id, d0, d1, ..., given, trusted) and terms (term, p0, p1, ...), weights
    that sum to 1 over the subjects.

    ``hits`` (doc_id, only, tf) holds the edges of each document, ``start`` (term, p0, ...) the first weights, ``seeds`` (doc_id,
    given array<double>) the given labels. A round sends each document the weights of its terms, each times its count and
    its rarity; given labels that this confirms are clamped. Each edge then carries the document's weights back, the more
    the term agrees, and a little (OPEN) in any case, so that a term may gain a subject. With no rounds the documents have
    the weights of the terms as they start. All sums are made before the shuffle as far as the rows of a task allow.
    """
    k = range(count)
    p, d = [f"p{i}" for i in k], [f"d{i}" for i in k]
    total = lambda cs: reduce(lambda a, b: a + b, cs)
    shares = lambda cs, names: [(c / total(cs)).alias(n) for c, n in zip(cs, names)]
    # The terms' number has a bound (``verified_terms``), so their table is broadcast.
    each = lambda df, *cols: df.select(*cols, "tf", F.posexplode("only").alias("_i", "term")).select(*cols, "term", F.col("tf")[F.col("_i")].alias("tf"))
    edges = each(hits, "doc_id")
    df = edges.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rare = F.log(1 + F.col("docs") / F.col("df"))
    terms = stage(start.join(df, "term").join(F.broadcast(hits.agg(F.count(F.lit(1)).alias("docs")))).select("term", *p, *[F.col(c).alias(f"start_{c}") for c in p], rare.alias("rare")), "terms")

    def to_documents(terms: DataFrame) -> DataFrame:
        w = F.col("tf") * F.col("rare")
        got = edges.join(F.broadcast(terms.select("term", "rare", *p)), "term").groupBy("doc_id").agg(*[F.sum(w * F.col(c)).alias(c) for c in p])
        got = got.where(total([F.col(c) for c in p]) > 0).select("doc_id", *shares([F.col(c) for c in p], d)).join(seeds, "doc_id", "left")
        ok = [F.when((F.col("given")[i] > 0) & (F.col(d[i]) >= TRUST), 1.0).otherwise(0.0) for i in k]
        got = got.withColumn("trusted", F.array(*ok))
        n = F.aggregate("trusted", F.lit(0.0), lambda a, x: a + x)
        return got.select("doc_id", *[F.when(n > 0, F.col("trusted")[i] / n).otherwise(F.col(d[i])).alias(d[i]) for i in k], "trusted")

    for r in range(rounds):
        both = hits.select("doc_id", "only", "tf").join(to_documents(terms), "doc_id")
        both = each(both, *d)
        y = [(F.col(a) + OPEN) * F.col(b) for a, b in zip(p, d)]
        back = both.join(F.broadcast(terms.select("term", *p)), "term").select("term", "tf", *[x.alias(c) for x, c in zip(y, p)])
        back = back.select("term", *[(F.col("tf") * s).alias(c) for s, c in zip(shares([F.col(c) for c in p], p), p)])
        new = back.groupBy("term").agg(*[F.sum(c).alias(c) for c in p]).select("term", *shares([F.col(c) for c in p], p))
        # A term whose documents have no weights keeps its own.
        starts = [f"start_{c}" for c in p]
        old = terms.select("term", "rare", *starts, *[F.col(c).alias(f"o{c}") for c in p]).join(new, "term", "left")
        old = old.select("term", "rare", *starts, *[F.coalesce((1 - TAKEN) * F.col(f"start_{c}") + TAKEN * F.col(c), f"o{c}").alias(c) for c in p], *[f"o{c}" for c in p])
        moved = total([F.abs(F.col(c) - F.col(f"o{c}")) for c in p])
        terms = stage(old.select("term", "rare", *starts, *p, moved.alias("moved")), f"terms{r}")
        if (terms.agg(F.avg("moved")).first()[0] or 0.0) <= tolerance:
            break
    return stage(to_documents(terms), "documents"), terms


class Subjects:
    """The propagated graph of a corpus: ``weights`` of all documents, and the exact check of ``found``.

    ``docs`` (doc_id, text), ``labels`` (doc_id, subject), ``subjects`` (subject); ``skip_texts`` (text): sentences of these do not
    count. The list of subjects is small and collected, so are the verified terms, whose number has a bound (``verified_terms``).
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, subjects: DataFrame, skip_texts: DataFrame | None = None, rounds: int = ROUNDS):
        spark = docs.sparkSession
        prepare(spark)
        self.names = [r["subject"] for r in subjects.where("subject IS NOT NULL").select("subject").distinct().orderBy("subject").collect()]
        count = len(self.names)
        seeds = stage(clean_labels(labels, subjects), "labels")
        p = [f"p{i}" for i in range(count)]
        rows = verified_terms(docs, seeds, self.names).orderBy("term").collect()
        self.terms = [r["term"] for r in rows]
        self.follows = followed([(r["term"], r["n"]) for r in rows])
        hits = stage(term_hits(docs, self.terms, self.follows, skip_texts is not None), "hits")
        if skip_texts is not None:
            hits = without(hits, stage(sentence_hashes(skip_texts), "skip"))
        else:
            hits = hits.withColumn("live", F.col("n")).drop("hashes")
        self.hits = hits
        kind = StructType([StructField("term", IntegerType()), *[StructField(c, DoubleType()) for c in p]])
        self.starts = np.array([[r[c] for c in p] for r in rows], np.float64).reshape(len(rows), count)
        start = spark.createDataFrame([(i, *w) for i, w in enumerate(self.starts.tolist())], kind)
        given = seeds.groupBy("doc_id").agg(F.array(*[F.max(F.when(F.col("subject") == n, 1.0).otherwise(0.0)) for n in self.names]).alias("given"))
        self.documents, self.weights_of_terms = propagate(hits, start, given, count, rounds)

    def weights(self, least: float = CANDIDATE) -> DataFrame:
        """(doc_id, subject, weight, trusted): the propagated subjects of every document with a weight of ``least`` or more."""
        each = F.array(*[F.struct(F.lit(n).alias("subject"), F.col(f"d{i}").alias("weight"), (F.col("trusted")[i] > 0).alias("trusted")) for i, n in enumerate(self.names)])
        return self.documents.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.*").where(F.col("weight") >= least)

    def found(self, share: float = SHARE) -> DataFrame:
        """(doc_id, subject): trusted given labels, and those propagated ones that at least ``share`` of the sentences treat."""
        w = self.weights(0.0)
        treated = treats(self.hits, self.weights_of_terms, [len(t) for t in self.terms], self.starts, self.names, share)
        checked = treated.join(w.where(F.col("weight") >= CANDIDATE), ["doc_id", "subject"], "left_semi")
        return checked.unionByName(w.where("trusted").select("doc_id", "subject")).distinct()


def treats(hits: DataFrame, terms: DataFrame, lengths: list[int], starts: np.ndarray, names: list[str], share: float) -> DataFrame:
    """(doc_id, subject): by the subject of each term (``terms``, or ``starts`` for those without edges), what at least ``share`` of a document's treated sentences treat."""
    count = len(names)
    p = starts.copy()
    for r in terms.select("term", *[f"p{i}" for i in range(count)]).collect():
        p[r["term"]] = r[1:]
    best = np.where(p.max(axis=1, initial=0.0) >= 0.5, p.argmax(axis=1), -1) if len(p) else np.zeros(0, np.int64)
    weight = np.array(lengths, np.float64)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n, live = (b.column(i).to_numpy().astype(np.int64) for i in (1, 2))
            first = np.cumsum(n) - n
            lists = b.column(4)
            off = lists.offsets.to_numpy().astype(np.int64)
            flat = lambda c: c.values.to_numpy(zero_copy_only=False)[c.offsets[0].as_py() : c.offsets[-1].as_py()]
            at, term = flat(b.column(3)).astype(np.int64), flat(lists).astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), np.diff(off))
            s = best[term].astype(np.int64)
            ok = s >= 0
            row, sentence, s, w = row[ok], (first[row] + at)[ok], s[ok], weight[term[ok]]
            score = np.bincount(sentence * count + s, weights=w, minlength=int(n.sum()) * count).reshape(-1, count)
            whole = np.bincount(row * count + s, weights=w, minlength=b.num_rows * count).reshape(-1, count)
            treated = score.max(axis=1) > 0
            owner = np.repeat(np.arange(b.num_rows), n)
            # A tie within a sentence goes to the subject that is stronger in the document.
            tie = 1e-3 * whole / (1 + whole.max(axis=1, keepdims=True))
            top = (score + tie[owner]).argmax(axis=1)
            got = np.bincount(owner[treated] * count + top[treated], minlength=b.num_rows * count).reshape(-1, count)
            of = got.sum(axis=1, keepdims=True)
            r, k = np.nonzero((got > 0) & (got >= share * of) & (got >= LEAST_OF_ALL * live[:, None]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), pa.array([names[x] for x in k], pa.string())], ["doc_id", "subject"])

    return hits.select("doc_id", "n", "live", "at", "term").mapInArrow(judge, "doc_id bigint, subject string").distinct()


def subjects_of(docs: DataFrame, labels: DataFrame, subjects: DataFrame, skip_texts: DataFrame | None = None, share: float = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, subject): every subject that at least ``share`` of a document's sentences treat, and trusted given labels.

    Sentences without a verified term are taken to continue their neighbours and do not count. Null, empty and meaningless
    texts have no subject, nor has any document if nothing is labelled; repeated doc_ids give their subjects once.
    """
    if subjects.where("subject IS NOT NULL").isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id bigint, subject string")
    return Subjects(docs, labels, subjects, skip_texts, rounds).found(share)


def composition(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(subject, docs, share): documents of each subject and their share of all documents, four places."""
    n = docs.agg(F.count(F.lit(1)).alias("all"))
    return found.groupBy("subject").agg(F.count(F.lit(1)).alias("docs")).join(F.broadcast(n)).select("subject", "docs", F.round(F.col("docs") / F.col("all"), 4).alias("share"))
