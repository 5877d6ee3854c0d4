"""Near-duplicate records: banded MinHash candidates, verified by odd sketches and then exactly.

Equal normalised texts are one class. A text's MinHash samples (one permutation, the hash range cut into
bins) are banded; rows that share a band meet in a bucket, where the popcount of the XOR of their odd
sketches estimates their similarity. Pairs that may reach the threshold are compared as sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.buckets import grouped, keyed, near_pairs, spans
from corvid.llm.conversations import connected_components
from corvid.session import prepare, sent, stage

SHINGLE = 5
LEAST = 0.7
MIN_CHARS = 300
#: Samples of a text (bins), rows of a band and bands. At similarity s a pair meets with 1 - (1 - s^rows)^bands.
BINS, ROWS, BANDS = 128, 5, 22
SKETCH_BITS = 256
#: Copies of a text that one task pairs with all others of the class.
CLASS_BLOCK = 1000
#: Standard deviations of the sketch's popcount that a candidate may lie beyond the threshold.
SLACK = 4.0
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def samples(texts: list[str], shingle: int = SHINGLE, bins: int = BINS) -> np.ndarray:
    """rows x bins MinHash samples of the texts' character shingles; empty bins take the next full one's, marked."""
    joined = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(size)
    n = max(len(joined) - shingle + 1, 0)
    h = np.zeros(n, np.uint64)
    for k in range(shingle):
        h = h * _MUL + joined[k : k + n]
    h = mixed(h)
    edges = np.arange(bins, dtype=np.uint64) << np.uint64(64 - int(math.log2(bins)))
    out = np.full((len(texts), bins), _EMPTY)
    for row, (e, s) in enumerate(zip(ends, size)):
        own = np.sort(h[e - s : max(e - shingle + 1, e - s)])
        if not len(own):
            continue
        at = np.searchsorted(own, edges)
        upto = np.append(at[1:], len(own))
        full = np.flatnonzero(at < upto)
        out[row, full] = own[at[full]]
        if len(full) < bins:
            empty = np.flatnonzero(at >= upto)
            src = full[np.searchsorted(full, empty) % len(full)]
            out[row, empty] = mixed(out[row, src] + (((empty - src) % bins).astype(np.uint64) * _MUL))
    return out


def odd_sketch(sig: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """rows x bits/64 words: each (bin, sample) toggles one bit."""
    n, bins = sig.shape
    pos = (mixed(sig + (np.arange(bins, dtype=np.uint64) * _MUL)[None, :]) % np.uint64(bits)).astype(np.int64)
    count = np.bincount((pos + np.arange(n)[:, None] * bits).ravel(), minlength=n * bits)
    return np.packbits((count & 1).astype(np.uint8).reshape(n, bits), axis=1).view(np.uint64)


def sketch_limit(least: float = LEAST, bins: int = BINS, bits: int = SKETCH_BITS, slack: float = SLACK) -> float:
    """The popcount of the XOR that a pair of similarity ``least`` stays under, with ``slack`` standard deviations."""
    d = 2 * bins * (1 - least)
    mean = bits / 2 * (1 - math.exp(-2 * d / bits))
    # of the number of differing samples, carried to the popcount, and of the popcount itself
    spread = 2 * math.sqrt(bins * least * (1 - least)) * math.exp(-2 * d / bits)
    own = math.sqrt(bits / 4 * (1 - math.exp(-4 * d / bits)))
    return mean + slack * math.hypot(spread, own)


def bands(sig: np.ndarray, rows: int = ROWS, count: int = BANDS) -> np.ndarray:
    """rows x count band keys: the band's number above 56 bits of a hash of its samples."""
    out = np.empty((len(sig), count), np.int64)
    for b in range(count):
        h = np.full(len(sig), np.uint64(b + 1))
        for k in range(b * rows, (b + 1) * rows):
            h = mixed(h * _MUL + sig[:, k])
        out[:, b] = ((h >> np.uint64(8)) | (np.uint64(b) << np.uint64(56))).view(np.int64)
    return out


def normalised(c):
    """Lower case, every run of Unicode white space one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def texts_of(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, text, h1, h2) of the rows that count: id not null, normalised text of at least ``min_chars`` characters."""
    t = df.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text")).where(F.col("id").isNotNull() & (F.length("text") >= min_chars))
    return t.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})


def similarity(a: set, b: set) -> float:
    m = len(a & b)
    return m / (len(a) + len(b) - m) if a or b else 1.0


def shingles(text: str, n: int = SHINGLE) -> set[str]:
    return {text[i : i + n] for i in range(len(text) - n + 1)}


def signed_classes(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(rid, h1, h2, keys, s0, s1, s2, s3): the distinct texts with their band keys and odd sketches, written once."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = samples(b.column(2).to_pylist(), shingle)
            sk = odd_sketch(sig).view(np.int64)
            keys = bands(sig)
            off = pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.ListArray.from_arrays(off, pa.array(keys.ravel())), *[pa.array(np.ascontiguousarray(sk[:, k])) for k in range(sk.shape[1])]],
                ["h1", "h2", "keys", "s0", "s1", "s2", "s3"],
            )

    signed = texts.select("h1", "h2", "text").mapInArrow(sign, "h1 bigint, h2 bigint, keys array<bigint>, s0 bigint, s1 bigint, s2 bigint, s3 bigint")
    base = signed.groupBy("h1", "h2").agg(*[F.first(c).alias(c) for c in ("keys", "s0", "s1", "s2", "s3")])
    return stage(base.withColumn("rid", F.monotonically_increasing_id()), "signed")


def leader_pairs(starts: np.ndarray, test) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, several): positions within buckets, each bucket's first row with all that are close to it, the first of the others
    with all of those that are close to it, and so on: every row is in one pair at most as the second. ``several`` are the
    starts of the buckets with more than one such leader."""
    out_i, out_j, several = [], [], []
    for a, b in zip(starts[:-1], starts[1:]):
        rest, leaders = np.arange(a, b), 0
        while len(rest):
            leaders += 1
            hit = test(np.full(len(rest) - 1, rest[0]), rest[1:])
            out_i.append(np.full(int(hit.sum()), rest[0]))
            out_j.append(rest[1:][hit])
            rest = rest[1:][~hit]
        if leaders > 1:
            several.append(a)
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return join(out_i), join(out_j), np.array(several, np.int64)


def copies_of(base: DataFrame, *more: str) -> DataFrame:
    """A row for every band of a class."""
    return base.select("rid", "s0", "s1", "s2", "s3", *more, F.explode("keys").alias("key"))


def candidates_of(base: DataFrame, least: float, keys: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b: the pairs of classes that share a band and whose sketches may reach ``least``. With ``keys`` (key) only pairs
    that meet in those buckets and lie in different parts, by the column ``part`` of ``base``."""
    limit = sketch_limit(least)
    apart = keys is not None
    copies = copies_of(base, "part").join(sent(keys), "key", "left_semi") if apart else copies_of(base.withColumn("part", F.lit(0).cast("bigint")), "part")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, "key"):
            at = spans(t, "key")
            rid, p, q, blk, part = (t.column(c).to_numpy() for c in ("rid", "p", "q", "blk", "part"))
            words = [t.column(f"s{k}").to_numpy().view(np.uint64) for k in range(4)]

            def close(i, j, words=words, part=part):
                ok = sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int32) for w in words) <= limit
                return ok & (part[i] != part[j]) if apart else ok

            i, j = near_pairs(at, p, q, blk, close)
            if len(i):
                a, b = np.minimum(rid[i], rid[j]), np.maximum(rid[i], rid[j])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    n = None if apart else base.count() * BANDS
    found = keyed(copies, "key", "rid", copies=n).mapInArrow(verify, "a bigint, b bigint").where("a <> b")
    return stage(found.distinct(), "candidates")


def led(base: DataFrame, least: float) -> DataFrame:
    """(key, a, b): the ``leader_pairs`` of all buckets, as class numbers, a < b; and a row with a = b = -1 for every bucket that has
    several leaders."""
    limit = sketch_limit(least)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, "key"):
            at = spans(t, "key")
            at = at if np.diff(at).max(initial=0) > 1 else at[:1]
            key, rid = t.column("key").to_numpy(), t.column("rid").to_numpy()
            words = [t.column(f"s{k}").to_numpy().view(np.uint64) for k in range(4)]
            # Buckets of one row have nothing to compare.
            wide = np.flatnonzero(np.diff(at) > 1)
            i, j, several = [], [], []
            for x in wide:
                parts = leader_pairs(at[x : x + 2], lambda i, j, words=words: sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int32) for w in words) <= limit)
                i.append(parts[0])
                j.append(parts[1])
                several.append(parts[2])
            if i:
                i, j, several = np.concatenate(i), np.concatenate(j), np.concatenate(several)
                none = np.full(len(several), -1)
                a, b = np.minimum(rid[i], rid[j]), np.maximum(rid[i], rid[j])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((key[i], key[several]), (a, none), (b, none))], ["key", "a", "b"])

    return stage(keyed(copies_of(base), "key", "rid", copies=base.count() * BANDS).mapInArrow(verify, "key bigint, a bigint, b bigint"), "led")


def verified_pairs(texts: DataFrame, ids: DataFrame, candidates: DataFrame, least: float, shingle: int = SHINGLE) -> DataFrame:
    """(a, b, similarity) of the candidates whose shingle sets reach ``least``, exactly."""
    involved = candidates.select(F.explode(F.array("a", "b")).alias("rid")).distinct().join(ids, "rid")
    held = stage(
        texts.select("h1", "h2", "text").join(involved, ["h1", "h2"]).groupBy("rid").agg(F.first("text").alias("text")), "texts"
    )

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, set()
        for b in batches:
            A, B = b.column(0).to_pylist(), b.column(1).to_pylist()
            sim = np.empty(len(A))
            for r, (i, x, y) in enumerate(zip(A, b.column(2).to_pylist(), b.column(3).to_pylist())):
                if i != last:
                    last, own = i, shingles(x, shingle)
                sim[r] = similarity(own, shingles(y, shingle))
            ok = np.flatnonzero(sim >= least)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok)), b.column(1).take(pa.array(ok)), pa.array(sim[ok])], ["a", "b", "similarity"])

    both = (
        candidates.join(held.select(F.col("rid").alias("b"), F.col("text").alias("tb")), "b")
        .join(held.select(F.col("rid").alias("a"), F.col("text").alias("ta")), "a")
        .select("a", "b", "ta", "tb")
    )
    return both.mapInArrow(exact, "a bigint, b bigint, similarity double")


def class_pairs(texts: DataFrame, least: float = LEAST, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(classes, pairs): classes (rid, h1, h2) of distinct texts, and pairs (a, b, similarity) of class numbers, a < b,
    whose shingle sets reach ``least``. The similarity is exact; candidates are missed as the bands allow."""
    base = signed_classes(texts, shingle)
    ids = base.select("rid", "h1", "h2")
    return ids, verified_pairs(texts, ids, candidates_of(base, least), least, shingle)


def members(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(rid, id): the ids of every class; a repeated id with differing texts belongs to each."""
    return texts.select("h1", "h2", "id").distinct().join(ids, ["h1", "h2"]).select("rid", "id")


def duplicate_pairs(df: DataFrame, id_col: str = "id", text_col: str = "content", least: float = LEAST, shingle: int = SHINGLE, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of different ids whose texts reach the similarity, equal texts included.

    Texts are normalised first; null ids, null and short texts have no pairs; repeated ids count once. The result grows with
    the square of a group of copies; ``duplicate_groups`` does not.
    """
    prepare(df.sparkSession)
    texts = stage(texts_of(df, id_col, text_col, min_chars), "normalised")
    ids, pairs = class_pairs(texts, least, shingle)
    m = stage(members(texts, ids), "members")
    across = (
        pairs.select("a", "b")
        .join(m.withColumnsRenamed({"rid": "a", "id": "x"}), "a")
        .join(m.withColumnsRenamed({"rid": "b", "id": "y"}), "b")
        .select("x", "y")
    )
    # Copies of one text are paired block by block, so a class of many is no single key.
    copied = m.groupBy("rid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rid", F.ceil(F.col("n") / CLASS_BLOCK).cast("int").alias("blocks"))
    own = m.join(copied, "rid")
    left = own.select("rid", F.col("id").alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("blk"))
    right = own.select("rid", F.col("id").alias("y"), F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("blk"))
    inside = left.join(right, ["rid", "blk"]).where("x < y").select("x", "y")
    return across.unionByName(inside).where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def duplicate_groups(df: DataFrame, id_col: str = "id", text_col: str = "content", least: float = LEAST, shingle: int = SHINGLE, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, group): every id that counts and the smallest id of its group: texts connected by similarity, directly or over others.

    One row per id, and no pairs within a large group: first each text is compared with the leaders of its buckets only, then
    those pairs that lie across the groups found so far; all others would join what is joined already. The groups are
    those of all verified pairs. A repeated id with differing texts belongs to the group of the smallest id.
    """
    prepare(df.sparkSession)
    texts = stage(texts_of(df, id_col, text_col, min_chars), "normalised")
    base = signed_classes(texts, shingle)
    ids = base.select("rid", "h1", "h2")
    met = led(base, least)
    candidates = stage(met.where("a >= 0 AND a <> b").select("a", "b").distinct(), "candidates")
    first = stage(verified_pairs(texts, ids, candidates, least, shingle).select("a", "b"), "links")
    # A bucket with one leader that all its rows are verified with is one group: only the others hold more to be found.
    failed = candidates.join(first, ["a", "b"], "left_anti")
    left = stage(met.where("a < 0").select("key").unionByName(met.join(failed, ["a", "b"]).select("key")).distinct(), "left")
    part = connected_components(first).withColumnsRenamed({"node": "rid", "component": "part"})
    parts = stage(base.join(part, "rid", "left").withColumn("part", F.coalesce("part", "rid")), "parts")
    rest = verified_pairs(texts, ids, candidates_of(parts, least, left), least, shingle).select("a", "b")
    named = parts.select("rid", "part")
    over = rest.join(named.withColumnsRenamed({"rid": "a", "part": "x"}), "a").join(named.withColumnsRenamed({"rid": "b", "part": "y"}), "b")
    joined = connected_components(over.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()).withColumnsRenamed({"node": "part"})
    rows = members(texts, ids).join(named, "rid").join(joined, "part", "left").select("id", F.coalesce("component", "part").alias("component"))
    low = rows.groupBy("component").agg(F.min("id").alias("group"))
    return rows.join(low, "component").groupBy("id").agg(F.min("group").alias("group"))
