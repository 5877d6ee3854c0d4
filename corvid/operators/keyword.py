"""Keyword retrieval: tokens, BM25, fuzzy terms and highlights, for a table of queries at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from corvid.functions.text import strip, tokens
from corvid.operators.vectors import QUERY_BLOCK, Best, ids_of
from corvid.session import prepare, sent, stage

K1, B = 1.2, 0.75
#: A character that with its like makes one token.
WORD = r"[\p{L}\p{N}&&[^\x{4E00}-\x{9FFF}]]"


@dataclass(frozen=True)
class Search:
    """Settings of a keyword search: fuzzy terms for queries of at most ``max_fuzzy_tokens`` words, with the same first ``prefix``
    characters and at most ``max_expansions`` matches a term; weight of the text against the path; highlights for k of at most
    ``highlight_max_k``, as ``fragments`` windows of ``chars`` characters."""

    fuzziness: bool = True
    max_fuzzy_tokens: int = 8
    prefix: int = 1
    max_expansions: int = 50
    text_boost: float = 2.0
    highlight: bool = True
    highlight_max_k: int = 20
    fragments: int = 3
    chars: int = 150


EXACT = Search(fuzziness=False, text_boost=1.0)


def query_terms(queries: DataFrame, query_id: str, query: str) -> DataFrame:
    """(query_id, term): the distinct terms of each query; blank and null queries have none."""
    return queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens(query))).alias("term"))


def postings(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, term, tf) for every document and term."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(tokens(text)).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str, query: str, k: int = 10, search: Search = EXACT, path: str | None = None) -> DataFrame:
    """(query_id, doc_id, rank, score): the ``k`` best documents of each query by BM25, ties by doc_id, scores at six places.

    With ``search.fuzziness`` similar terms of the documents count too, weighted by their likeness. With a ``path`` column a query
    that is the whole path scores its idf there, and the better of both fields counts (the text times its boost). Queries go to
    the tasks in blocks. For a block each text is read once and counted where it is read; only the numbers of the queries' terms
    are kept. Scores are summed and cut to the best ``k`` of each query within the tasks, so no document is shuffled by its terms.
    Null and empty texts count as documents without terms; null ids are dropped.
    """
    spark = docs.sparkSession
    prepare(spark)
    terms = query_terms(queries, query_id, query).withColumn("weight", F.lit(1.0))
    if search.fuzziness:
        terms = fuzzy_query_terms(queries, query_id, query, docs.select(F.explode(tokens(text)).alias("term")), search)
    listed = stage(terms.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("terms")), "terms")
    kind = StructType([StructField("query_id", queries.schema[query_id].dataType), StructField("doc_id", docs.schema[doc_id].dataType), StructField("score", DoubleType())])
    toks = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), tokens(text).alias("w"))
    scored = None
    waiting = listed.toLocalIterator()
    while block := list(islice(waiting, QUERY_BLOCK)):
        part = _scored(toks, block, kind, k, search.text_boost)
        scored = part if scored is None else scored.unionByName(part)
    if scored is None:
        scored = spark.createDataFrame([], kind)
    if path:
        n = docs.where(F.col(doc_id).isNotNull()).count()
        whole = queries.select(F.col(query_id).alias("query_id"), strip(query).alias("path")).where("path <> ''")
        at = stage(docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(path).alias("path")).join(sent(whole.select("path").distinct()), "path"), "paths")
        per = at.groupBy("path").agg(F.count(F.lit(1)).alias("df")).select("path", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("score"))
        named = whole.join(per, "path").join(at, "path").select("query_id", "doc_id", F.round("score", 6).alias("score"))
        scored = scored.unionByName(named).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "doc_id", "rank", "score")


def _scored(toks: DataFrame, block: list, kind: StructType, k: int, boost: float) -> DataFrame:
    """(query_id, doc_id, score) of a block of queries (query_id, terms): of every task the ``k`` best documents of each."""
    spark = toks.sparkSession
    place: dict[str, int] = {}
    at = np.array([place.setdefault(t["term"], len(place)) for r in block for t in r["terms"]], np.int64)
    owner = np.repeat(np.arange(len(block)), [len(r["terms"]) for r in block])
    weight = np.array([t["weight"] for r in block for t in r["terms"]], np.float64)
    shared = spark.sparkContext.broadcast(place)
    counts = StructType([kind["doc_id"], *(StructField(c, t) for c, t in (("len", IntegerType()), ("terms", ArrayType(IntegerType())), ("tf", ArrayType(IntegerType()))))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        for b in batches:
            off = b.column(1).offsets.to_numpy().astype(np.int64)
            coded = b.column(1).values.slice(off[0], off[-1] - off[0]).dictionary_encode()
            known = np.array([place.get(w, -1) for w in coded.dictionary.to_pylist()], np.int64)
            term = known[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.int64)
            row = np.repeat(np.arange(b.num_rows), np.diff(off))
            met = term >= 0
            cells, tf = np.unique(row[met] << 32 | term[met], return_counts=True)
            ends = pa.array(np.searchsorted(cells, np.arange(b.num_rows + 1) << 32).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (cells & 0xFFFFFFFF, tf)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(off).astype(np.int32)), *lists], counts.names)

    rows = stage(toks.mapInArrow(count, counts), "tf")
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avglen")).first()
    n, avglen = stats["n"], stats["avglen"] or 1.0
    df = np.zeros(len(place))
    for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[r["term"]] = r["count"]
    weight = weight * np.log(1 + (n - df[at] + 0.5) / (df[at] + 0.5)) * boost
    o = np.argsort(at, kind="stable")
    sides = spark.sparkContext.broadcast(([r["query_id"] for r in block], owner[o], weight[o], np.searchsorted(at[o], np.arange(len(place) + 1))))
    qtype, dtype = to_arrow_type(kind["query_id"].dataType), to_arrow_type(kind["doc_id"].dataType)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, owner, weight, first = sides.value
        held = Best(k)
        for b in batches:
            off = b.column(2).offsets.to_numpy().astype(np.int64)
            term, tf = (b.column(c).values.to_numpy()[off[0] : off[-1]] for c in (2, 3))
            if not len(term):
                continue
            row = np.repeat(np.arange(b.num_rows), np.diff(off))
            length = b.column(1).to_numpy()[row]
            s = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avglen))
            o = np.argsort(term, kind="stable")
            term, row, s = term[o], row[o], s[o]
            sums = np.zeros((len(qids), b.num_rows))
            cut = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1], [True]]))
            for x, y in zip(cut[:-1], cut[1:]):
                q = slice(first[term[x]], first[term[x] + 1])
                sums[np.ix_(owner[q], row[x:y])] += weight[q][:, None] * s[x:y][None, :]
            held.add(np.arange(len(qids)), ids_of(b.column(0)), np.floor(sums * 1e6 + 0.5) / 1e6, sums > 0)
        i, ids, score = held.rows()
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array([qids[x] for x in i], qtype), pa.array(ids.tolist(), dtype), pa.array(score)], kind.names)

    return rows.where(F.size("terms") > 0).mapInArrow(best, kind)


def allowed_edits(c):
    """0, 1 or 2 edits for terms of up to 2, 5 and more characters."""
    n = F.length(c)
    return F.when(n <= 2, 0).when(n <= 5, 1).otherwise(2)


def fuzzy_terms(terms: DataFrame, vocabulary: DataFrame, prefix: int = 1, max_expansions: int = 50) -> DataFrame:
    """(term, match, distance): the nearest vocabulary terms of each term, within its allowed edits and with the same first
    ``prefix`` characters; at most ``max_expansions``, nearest first, ties by match. An equi-join on prefix and length, which
    drops the rest of the vocabulary before it is shuffled; null and empty terms match nothing."""
    t = terms.select("term").where("term <> ''").distinct().withColumn("edits", allowed_edits(F.col("term")))
    t = t.withColumn("n", F.explode(F.sequence(F.greatest(F.length("term") - F.col("edits"), F.lit(1)), F.length("term") + F.col("edits"))))
    t = stage(t.withColumn("p", F.substring("term", 1, prefix)), "shapes")
    v = vocabulary.select(F.col("term").alias("match"), F.length("term").alias("n"), F.substring("term", 1, prefix).alias("p"))
    v = v.join(sent(t.select("p", "n").distinct()), ["p", "n"], "left_semi").distinct()
    d = v.join(sent(t), ["p", "n"]).withColumn("distance", F.levenshtein("term", "match")).where("distance <= edits")
    w = Window.partitionBy("term").orderBy("distance", "match")
    return d.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max_expansions).select("term", "match", "distance")


def fuzzy_query_terms(queries: DataFrame, query_id: str, query: str, vocabulary: DataFrame, search: Search = Search()) -> DataFrame:  # noqa: B008
    """(query_id, term, weight): query terms at weight 1, and for queries of few words their fuzzy matches, at one minus the
    distance over the shorter length; a match of several terms counts with its best weight."""
    exact = query_terms(queries, query_id, query)
    words = F.filter(F.split(strip(query), r"(?U)\s+"), lambda x: x != "")
    short = queries.where(F.size(words) <= search.max_fuzzy_tokens).select(F.col(query_id).alias("query_id"))
    asked = stage(exact.join(short.distinct(), "query_id"), "asked")
    near = fuzzy_terms(asked, vocabulary, search.prefix, search.max_expansions).where("distance > 0")
    weight = 1 - F.col("distance") / F.least(F.length("term"), F.length("match"))
    more = asked.join(near, "term").select("query_id", F.col("match").alias("term"), weight.alias("weight"))
    both = exact.withColumn("weight", F.lit(1.0)).unionByName(more)
    return both.groupBy("query_id", "term").agg(F.max("weight").alias("weight"))


def highlights(hits: DataFrame, text: str, query: str, k: int, search: Search = EXACT) -> DataFrame:
    """``hits`` with ``highlights``: up to ``fragments`` windows of ``chars`` characters around term occurrences, terms wrapped in
    <em>. Windows end between tokens, so no occurrence is split; a token longer than ``chars`` is a window of its own. For k over
    ``highlight_max_k`` the array is empty, as it is for null texts."""
    fragments, chars = search.fragments, search.chars
    if k > search.highlight_max_k or not search.highlight:
        return hits.withColumn("highlights", F.array().cast("array<string>"))
    t = F.coalesce(F.col(text), F.lit(""))
    windows = F.regexp_extract_all(t, F.lit(rf"(?s).{{1,{chars}}}(?!(?<={WORD}){WORD})|{WORD}+"), F.lit(0))
    qt = F.array_distinct(tokens(query))
    hit = F.filter(windows, lambda x: F.arrays_overlap(tokens(x), qt))

    # One pattern for all tokens: words between other characters, Chinese characters anywhere.
    han = F.filter(qt, lambda x: x.rlike(r"^[\x{4E00}-\x{9FFF}]$"))
    words = F.array_join(F.array_append(F.array_except(qt, han), F.lit("(?!)")), "|")
    pattern = F.concat(F.lit(rf"(?iu)((?<!{WORD})(?:"), words, F.lit(rf")(?!{WORD})"), F.when(F.size(han) > 0, F.concat(F.lit("|["), F.array_join(han, ""), F.lit("]"))).otherwise(""), F.lit(")"))

    def wrap(x):
        return F.regexp_replace(x, pattern, F.lit("<em>$1</em>"))

    return hits.withColumn("highlights", F.transform(F.slice(hit, 1, fragments), wrap))


def keywords(docs: DataFrame, doc_id: str, text: str, k: int = 3) -> DataFrame:
    """(doc_id, rank, term, score): the ``k`` terms of each document with the highest tf * ln(N / df), six places, ties by term:
    a deterministic stand-in for a model's keywords and title words. Documents without terms have no rows."""
    tf = postings(docs, doc_id, text)
    df_ = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    scored = tf.join(df_, "term").join(F.broadcast(n)).select("doc_id", "term", F.round(F.col("tf") * F.log(F.col("n") / F.col("df")), 6).alias("score"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("doc_id", "rank", "term", "score")
