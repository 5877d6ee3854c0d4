"""Most similar vectors for every vector, by cross-polytope hashing.

Fast Hadamard pseudo-rotations send unit vectors to their nearest signed axes: an axis is a bucket. A few
tables with extra probes, chosen over all tables by how little similarity they give up, bring candidates
together; within a bucket all cosines are computed. Exact copies of a vector are one class, so a vector that
a third of all rows share is hashed once.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from corvid.llm.buckets import grouped, keyed, spans
from corvid.session import prepare, sent, stage

DIM = 96
K = 10
#: Tables and probed buckets of a vector, at no further bits; each further bit adds a table, and probes as ``plan`` finds them needed.
TABLES, PROBES = 3, 9
#: The cosine at which further bits must not lower the chance to meet.
MEET = 0.75
#: Key comparisons held at once when pairs of one bucket are checked for an earlier one.
COMPARED = 1 << 26
#: A further bit of a second rotation halves the buckets when one would hold more rows than this on average.
BUCKET = 3000
#: Queries that are compared with all vectors in one scan.
QUERY_BLOCK = 4096
SEED = 20240229
CHUNK = 512


def hadamard(a: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of the rows of ``a``, scaled to keep lengths; the width is a power of two."""
    n, w = a.shape
    h = 1
    while h < w:
        b = a.reshape(n, w // (2 * h), 2, h)
        a = np.stack([b[:, :, 0] + b[:, :, 1], b[:, :, 0] - b[:, :, 1]], axis=2).reshape(n, w)
        h *= 2
    return a / math.sqrt(w)


def rotations(dim: int, count: int, seed: int = SEED) -> np.ndarray:
    """``count`` pseudo-rotations (three rounds of random signs and a Hadamard transform) as one dim x (count * width) matrix:
    the transform of the unit vectors, so that applying all of them is one product."""
    width = 1 << max(1, (dim - 1).bit_length())
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        a = np.eye(dim, width)
        for _ in range(3):
            a = hadamard(a * rng.choice([-1.0, 1.0], width))
        out.append(a)
    return np.concatenate(out, axis=1).astype(np.float32)


def pack(x: np.ndarray) -> list[bytes]:
    """float32 rows as bytes, all first bytes of the row's values, then all second ones and so on: the same bits, which
    the shuffle's compression packs far better."""
    return [r.tobytes() for r in np.ascontiguousarray(x.astype("<f4")).view(np.uint8).reshape(len(x), -1, 4).transpose(0, 2, 1).copy()]


def unpack(col: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, 4, dim)
    return np.ascontiguousarray(raw.transpose(0, 2, 1)).view("<f4").reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def extra_rotations(bits: int, width: int) -> list[int]:
    """The bits that each further rotation of a table gives: as many as its signed axes can, until all are given."""
    most, out = width.bit_length(), []
    while bits > sum(out):
        out.append(min(most, bits - sum(out)))
    return out


def rotations_of(tables: int, bits: int, dim: int) -> int:
    return tables * max(2, 1 + len(extra_rotations(bits, 1 << max(1, (dim - 1).bit_length()))))


def cells_of(bits: int, dim: int) -> int:
    """Buckets of a table that a vector may probe."""
    return 3 * math.prod(min(2, 1 << b) for b in extra_rotations(bits, 1 << max(1, (dim - 1).bit_length())))


def bucket_keys(u: np.ndarray, matrix: np.ndarray, tables: int, probes: int, bits: int) -> np.ndarray:
    """rows x probes bucket numbers, the best bucket of every table first, then those that cost least over all tables."""
    n, dim = u.shape
    width = 1 << max(1, (dim - 1).bit_length())
    per = matrix.shape[1] // (tables * width)
    r = (u.astype(np.float32) @ matrix).reshape(n, per * tables, width)
    keys, loss = [], []
    for t in range(tables):
        both = np.concatenate([r[:, per * t], -r[:, per * t]], axis=1)
        top = np.argpartition(-both, 3, axis=1)[:, :3]
        val = np.take_along_axis(both, top, 1)
        o = np.argsort(-val, axis=1, kind="stable")
        top, val = np.take_along_axis(top, o, 1), np.take_along_axis(val, o, 1)
        cells = [(top[:, k].astype(np.int64), val[:, 0] - val[:, k]) for k in range(3)]
        for x, more in enumerate(extra_rotations(bits, width)):
            part = r[:, per * t + 1 + x, : 1 << (more - 1)]
            both = np.concatenate([part, -part], axis=1)
            m = min(2, both.shape[1])
            o = np.argsort(-both, axis=1, kind="stable")[:, :m]
            v = np.take_along_axis(both, o, 1)
            cells = [(c * (1 << more) + o[:, j], d + v[:, 0] - v[:, j]) for c, d in cells for j in range(m)]
        for k, (c, d) in enumerate(cells):
            keys.append(t * (2 * width << bits) + c)
            loss.append(np.full(n, -np.inf) if k == 0 else d)
    keys, loss = np.stack(keys, 1), np.stack(loss, 1)
    return np.take_along_axis(keys, np.argsort(loss, axis=1, kind="stable")[:, :probes], 1)


def classes(df: DataFrame, id_col: str, vec_col: str, dim: int = DIM, keep: int = K + 1) -> DataFrame:
    """(h1, h2, ids, vec): the distinct usable vectors, each with its ``keep`` smallest ids, which is all that a list of
    ``keep`` - 1 neighbours can name of it. Usable: exactly ``dim`` finite values, not all zero, id not null."""
    prepare(df.sparkSession)

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(3)
            flat = lists.values.to_numpy(zero_copy_only=False)
            off = lists.offsets.to_numpy()
            x = flat[off[0] : off[-1]].reshape(-1, dim)
            ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            at = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([*[b.column(i).take(at) for i in range(3)], pa.array(pack(x[ok]), pa.binary())], ["id", "h1", "h2", "vec"])

    raw = df.select(F.col(id_col).alias("id"), F.xxhash64(vec_col).alias("h1"), F.xxhash64(F.lit(1), vec_col).alias("h2"), F.col(vec_col).cast("array<float>").alias("v"))
    raw = raw.where(F.col("id").isNotNull() & (F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull()))
    # An id that comes with several vectors counts with the one of the smallest hash.
    h = F.struct("h1", "h2")
    odd = raw.groupBy("id").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).where("lo <> hi").select("id", "lo")
    if not odd.isEmpty():
        raw = raw.join(odd, "id", "left").where(F.col("lo").isNull() | (F.col("lo") == h)).drop("lo")
    packed = raw.mapInArrow(usable, f"id {dict(df.dtypes)[id_col]}, h1 bigint, h2 bigint, vec binary")
    w = Window.partitionBy("h1", "h2").orderBy("id")
    return (
        packed.withColumn("r", F.dense_rank().over(w))
        .where(F.col("r") <= keep)
        .groupBy("h1", "h2")
        .agg(F.array_sort(F.collect_set("id")).alias("ids"), F.first("vec").alias("vec"))
    )


@functools.cache
def probes_to_meet(tables: int, bits: int, dim: int, cosine: float = MEET, pairs: int = 3000) -> np.ndarray:
    """For random pairs of the given cosine, in ascending order, how many probes of each bring the two into one bucket; the
    pairs are the same for all arguments. Pairs that no number of probes brings together have the greatest number."""
    rng = np.random.default_rng(SEED)
    a, g = unit(rng.normal(size=(pairs, dim))), rng.normal(size=(pairs, dim))
    g = unit(g - np.einsum("ij,ij->i", g, a)[:, None] * a)
    matrix, every = rotations(dim, rotations_of(tables, bits, dim)), tables * cells_of(bits, dim)
    x, y = (bucket_keys(v, matrix, tables, every, bits) for v in (a, cosine * a + math.sqrt(1 - cosine**2) * g))
    rank = np.arange(1, x.shape[1] + 1, dtype=np.int16)
    later = np.maximum(rank[:, None], rank[None, :])
    need = [np.where(p[:, :, None] == q[:, None, :], later, np.iinfo(np.int16).max).min(axis=(1, 2)) for p, q in zip(np.array_split(x, 10), np.array_split(y, 10))]
    return np.sort(np.concatenate(need))


def plan(n: int, dim: int = DIM, bucket: int = BUCKET) -> tuple[int, int, int]:
    """(tables, probes, bits) for ``n`` vectors: bits of further rotations as needed to hold the mean bucket, a table for
    each, and so many probes that a pair of cosine ``MEET`` meets as often as with no further bits."""
    axes = 2 << max(1, (dim - 1).bit_length())
    tables, probes, bits = TABLES, PROBES, 0
    while n * probes / tables / (axes << bits) > bucket:
        bits += 1
        tables = TABLES + bits
        enough = np.searchsorted(probes_to_meet(TABLES, 0, dim), PROBES, side="right")
        while (probes := int(probes_to_meet(tables, bits, dim)[enough - 1])) > cells_of(bits, dim) * tables:
            tables += 1
        probes = max(probes, PROBES)
    return tables, probes, bits


def with_keys(base: DataFrame, rows: int, dim: int, bucket: int = BUCKET) -> DataFrame:
    """``base`` (with vec) and the keys of its probed buckets; ``rows`` is the number of vectors to plan for, at least theirs."""
    tables, probes, bits = plan(rows, dim, bucket)
    matrix = rotations(dim, rotations_of(tables, bits, dim))
    wide = tables * (4 << max(1, (dim - 1).bit_length()) << bits) >= 1 << 31
    out = StructType([*base.schema, StructField("keys", ArrayType(LongType() if wide else IntegerType()))])
    at = base.columns.index("vec")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = bucket_keys(unit(unpack(b.column(at), dim)), matrix, tables, probes, bits).astype(np.int64 if wide else np.int32)
                off = pa.array(np.arange(0, keys.size + 1, probes, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(off, pa.array(keys.ravel()))], out.names)

    return base.mapInArrow(hashed, out)


def neighbour_lists(base: DataFrame, dim: int, k: int, least: float) -> DataFrame:
    """(rid, near): for every row of ``base`` (rid, vec, keys) up to ``k`` neighbours as (minus cosine, rid), nearest first."""
    copies = base.select("rid", "vec", "keys", F.explode("keys").alias("key"))
    count = base.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, "key"):
            u = unit(unpack(t.column("vec"), dim))
            f = u.astype(np.float32)
            rid = t.column("rid").to_numpy()
            keys = np.concatenate([c.values.to_numpy()[c.offsets[0].as_py() : c.offsets[-1].as_py()] for c in t.column("keys").chunks]).reshape(len(rid), -1)
            key, p, q, blk = (t.column(c).to_numpy() for c in ("key", "p", "q", "blk"))
            at = spans(t, "key")
            I, J = [], []
            for s, e in zip(at[:-1], at[1:]):
                if e - s < 2:
                    continue
                for a in range(s, e, CHUNK):
                    sim = f[a : min(a + CHUNK, e)] @ f[s:e].T
                    i, j = np.nonzero(sim >= least - 1e-3)
                    i, j = i + a, j + s
                    ok = (i != j) & ((p[i] == q[i]) | (blk[i] != blk[j]))
                    i, j = i[ok], j[ok]
                    if len(i):
                        # A pair counts in the first bucket that both share, in the order of bucket numbers.
                        ok = np.empty(len(i), bool)
                        step = max(1, COMPARED // keys.shape[1] ** 2)
                        for c in range(0, len(i), step):
                            x, y = i[c : c + step], j[c : c + step]
                            both = (keys[x][:, :, None] == keys[y][:, None, :]).any(axis=2)
                            ok[c : c + step] = np.where(both, keys[x], np.iinfo(keys.dtype).max).min(axis=1) == key[x]
                        I.append(i[ok])
                        J.append(j[ok])
            if not I:
                continue
            i, j = np.concatenate(I), np.concatenate(J)
            cos = np.einsum("ij,ij->i", u[i], u[j])
            ok = cos >= least
            i, j, cos = i[ok], j[ok], cos[ok]
            bucket_no = np.searchsorted(at, i, side="right")
            o = np.lexsort((rid[j], -cos, i, bucket_no))
            i, j, cos = i[o], j[o], cos[o]
            if not len(i):
                continue
            new = np.concatenate([[True], i[1:] != i[:-1]])
            start = np.flatnonzero(new)
            place = np.arange(len(i)) - np.repeat(start, np.diff(np.concatenate([start, [len(i)]])))
            ok = place < k
            i, j, cos = i[ok], j[ok], cos[ok]
            start = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            pairs = pa.StructArray.from_arrays([pa.array(-cos), pa.array(rid[j])], ["d", "rid"])
            off = pa.array(np.concatenate([start, [len(i)]]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(rid[i[start]]), pa.ListArray.from_arrays(off, pairs)], ["rid", "near"])

    found = keyed(copies, "key", "rid", copies=count).mapInArrow(compare, "rid bigint, near array<struct<d:double,rid:bigint>>")
    return found.groupBy("rid").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))


def numbered(df: DataFrame, id_col: str, vec_col: str, dim: int, k: int, bucket: int = BUCKET) -> DataFrame:
    """The classes with a number ``rid``, odd where a class has several ids, and their keys: hashed and written once. The
    number of rows with a vector, which is that of the classes at most, decides the plan."""
    base = classes(df, id_col, vec_col, dim, k + 1)
    rid = F.monotonically_increasing_id() * 2 + F.when(F.size("ids") > 1, 1).otherwise(0)
    rows = df.where(F.size(vec_col) == dim).count()
    return stage(with_keys(base.withColumn("rid", rid), rows, dim, bucket), "classes")


def exact_lists(base: DataFrame, asked: DataFrame, dim: int, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(rid, near): the ``k`` nearest others of the ``asked`` (rid, vec) rows among all of ``base``, as in ``neighbour_lists``.

    Blocks of queries are sent to all tasks; each keeps its best ``k`` a query, so only those are shuffled. The driver holds one
    block at a time. One scan of the vectors a block: for a stated set of queries, not for all rows."""
    spark = base.sparkSession
    out = None

    def scan(rids: np.ndarray, q: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((rids, q))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rids, q = shared.value
            most = np.full(len(rids), np.inf)
            row, dist, name = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
            for b in batches:
                if not b.num_rows:
                    continue
                other = b.column(0).to_numpy()
                d = -(q @ unit(unpack(b.column(1), dim)).T)
                d[rids[:, None] == other[None, :]] = np.inf
                m = min(k, len(other))
                least = np.minimum(np.partition(d, m - 1, axis=1)[:, m - 1], most)
                i, j = np.nonzero((d <= least[:, None]) & np.isfinite(d))
                row, dist, name = np.concatenate([row, i]), np.concatenate([dist, d[i, j]]), np.concatenate([name, other[j]])
                # Equal cosines: the smaller number first, in every task.
                o = np.lexsort((name, dist, row))
                row, dist, name = row[o], dist[o], name[o]
                start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
                place = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
                most[row[place == k - 1]] = dist[place == k - 1]
                row, dist, name = (x[place < k] for x in (row, dist, name))
            yield pa.RecordBatch.from_arrays([pa.array(rids[row]), pa.array(dist), pa.array(name)], ["rid", "d", "other"])

        return base.select("rid", "vec").mapInArrow(best, "rid bigint, d double, other bigint")

    rids: list[int] = []
    vecs: list[bytes] = []

    def flush():
        nonlocal out
        part = scan(np.array(rids, np.int64), unit(unpack(pa.array(vecs, pa.binary()), dim)))
        out = part if out is None else out.unionByName(part)
        rids.clear()
        vecs.clear()

    for r in asked.select("rid", "vec").toLocalIterator():
        rids.append(r["rid"])
        vecs.append(bytes(r["vec"]))
        if len(rids) == block:
            flush()
    if rids:
        flush()
    if out is None:
        return spark.createDataFrame([], "rid bigint, near array<struct<d:double,rid:bigint>>")
    pair = F.struct("d", F.col("other").alias("rid"))
    return out.groupBy("rid").agg(F.slice(F.array_sort(F.collect_list(pair)), 1, k).alias("near"))


def expanded(df: DataFrame, base: DataFrame, near: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """(id, neighbour, rank, cosine) of class lists ``near``: classes give way to their ids, each list cut to ``k`` ids."""
    names = base.select(F.col("rid").alias("other"), F.col("ids").alias("other_ids"))
    # A class of one has no neighbour inside; a class with copies lists its own ids first.
    lists = (
        near.select("rid", F.explode("near").alias("x"))
        .select("rid", F.col("x.d").alias("d"), F.col("x.rid").alias("other"))
        .join(names, "other")
        .groupBy("rid")
        .agg(F.array_sort(F.flatten(F.collect_list(F.transform("other_ids", lambda i: F.struct(F.col("d"), i.alias("id")))))).alias("near"))
    )
    few = base.where(F.size("ids") <= k).select("rid", F.explode("ids").alias("id"))
    many = base.where(F.size("ids") > k).select("rid", "h1", "h2")
    rest = df.select(F.col(id_col).alias("id"), F.xxhash64(vec_col).alias("h1"), F.xxhash64(F.lit(1), vec_col).alias("h2")).where("id IS NOT NULL")
    members = few.unionByName(rest.join(many, ["h1", "h2"]).select("rid", "id").distinct())
    best = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    return (
        members.join(lists, "rid")
        .select("id", F.posexplode(best).alias("rank", "x"))
        .select("id", F.col("x.id").alias("neighbour"), (F.col("rank") + 1).alias("rank"), (-F.col("x.d")).alias("cosine"))
    )


def with_own(base: DataFrame, near: DataFrame, least: float) -> DataFrame:
    """Class lists with the class itself, at cosine 1, where it has several ids."""
    if least > 1:
        return near
    own = base.where("rid % 2 = 1").select("rid", F.array(F.struct(F.lit(-1.0).alias("d"), F.col("rid").alias("rid"))).alias("near"))
    return near.unionByName(own)


def similar(df: DataFrame, id_col: str = "id", vec_col: str = "embedding", dim: int = DIM, k: int = K, least: float = -1.0, bucket: int = BUCKET) -> DataFrame:
    """(id, neighbour, rank, cosine): for every usable vector up to ``k`` others of the highest cosine, at least ``least``.

    Approximate: a neighbour is missed if it shares no probed bucket, seldom from cosine ``MEET`` on, often far below it (recall in
    the README); ``nearest_of`` is exact for a stated set of queries. Vectors that are null, of another length, zero or hold NaN
    have no rows and are nobody's neighbour; repeated ids count once. Copies of a vector under other ids are neighbours of
    cosine 1, smaller ids first. An empty table gives no rows.
    """
    base = numbered(df, id_col, vec_col, dim, k, bucket)
    near = neighbour_lists(base, dim, k, least)
    return expanded(df, base, with_own(base, near, least), id_col, vec_col, k)


def nearest_of(df: DataFrame, queries: DataFrame, id_col: str = "id", vec_col: str = "embedding", dim: int = DIM, k: int = K, bucket: int = BUCKET, meet: float = MEET) -> DataFrame:
    """(id, neighbour, rank, cosine): ``similar`` for the ids of ``queries`` (id_col) only, and without its misses: where hashing does
    not fill a list with cosines of ``meet`` or more, the query is compared with all vectors, in blocks. Ids without a usable
    vector have no rows."""
    base = numbered(df, id_col, vec_col, dim, k, bucket)
    ids = queries.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct()
    hashes = df.select(F.col(id_col).alias("id"), F.xxhash64(vec_col).alias("h1"), F.xxhash64(F.lit(1), vec_col).alias("h2"))
    asked = hashes.join(sent(ids), "id", "left_semi").select("h1", "h2").distinct()
    asked = stage(base.join(sent(asked), ["h1", "h2"], "left_semi").select("rid", "vec"), "asked")
    near = stage(neighbour_lists(base, dim, k, meet).join(sent(asked.select("rid")), "rid", "left_semi"), "near")
    full = near.where(F.size("near") >= k)
    near = full.unionByName(exact_lists(base, asked.join(full, "rid", "left_anti"), dim, k))
    return expanded(df, base, with_own(base, near, -1.0), id_col, vec_col, k).join(sent(ids), "id", "left_semi")


def similar_pairs(df: DataFrame, id_col: str = "id", vec_col: str = "embedding", dim: int = DIM, k: int = K, least: float = 0.75, bucket: int = BUCKET) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the pairs of which at least one is among the other's ``similar`` ones.

    Lists without copies are paired by number and named at the end, which moves far less; lists that touch a class
    of several ids are expanded as in ``similar``.
    """
    base = numbered(df, id_col, vec_col, dim, k, bucket)
    near = stage(neighbour_lists(base, dim, k, least), "near")
    copied = (F.col("rid") % 2 == 1) | F.exists("near", lambda x: x["rid"] % 2 == 1)
    plain = (
        near.where(~copied)
        .select("rid", F.explode("near").alias("x"))
        .select(F.least("rid", "x.rid").alias("a"), F.greatest("rid", "x.rid").alias("b"))
        .distinct()
    )
    name = base.select("rid", F.get("ids", F.lit(0)).alias("id"))
    plain = (
        plain.join(name.withColumnsRenamed({"rid": "a", "id": "ia"}), "a")
        .join(name.withColumnsRenamed({"rid": "b", "id": "ib"}), "b")
        .select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
    )
    rest = expanded(df, base, with_own(base, near.where(copied), least), id_col, vec_col, k)
    rest = rest.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
    # A pair of two single ids may come from a plain list and from an expanded one.
    return plain.unionByName(rest).distinct()
