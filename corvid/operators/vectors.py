"""Embedding and vector search. Every search takes a table of queries; vectors are array<float> columns."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StringType, StructField, StructType

from corvid.functions.vectors import distance_score, l2_normalize, norm
from corvid.session import prepare, stage

#: Queries are sent to the tasks in blocks of this many; each block is one pass over the vectors.
QUERY_BLOCK = 4096
#: Centroids are fitted on about this many vectors at most, of each length those of the smallest id hash; every vector is then assigned.
IVF_SAMPLE = 100_000
# Cells to probe first, by the number of rows.
NPROBE = [(1_000, 10), (10_000, 32), (100_000, 64), (None, 128)]
MODEL_DIMS = {"small": 384, "base": 768, "large": 1024, "mini": 384}
CONTENT_LIMIT = 65_000


class HashingEncoder:
    """Deterministic stand-in for a learned encoder: signed hashed counts of a text's tokens, at length 1. With ``max_tokens``
    only so many first tokens count; a model that truncates has 512."""

    def __init__(self, dim: int = 64, max_tokens: int | None = None):
        self.dim, self.max_tokens = dim, max_tokens
        self.places: dict[str, int] = {}

    def place(self, w: str) -> int:
        """Twice the token's dimension, plus one for a positive sign."""
        h = int(hashlib.md5(w.encode("utf-8", "replace")).hexdigest()[:8], 16)
        return h % self.dim * 2 + (h >> 31)

    def encode(self, texts: list[str]) -> np.ndarray:
        if len(self.places) > 1 << 20:
            self.places.clear()
        known, rows, at = self.places, [], []
        for row, t in enumerate(texts):
            own = re.findall(r"[一-鿿]|\w+", (t or "").lower())[: self.max_tokens]
            for w in set(own) - known.keys():
                known[w] = self.place(w)
            at.extend(map(known.__getitem__, own))
            rows.append(len(own))
        place = np.array(at, np.int64)
        cell = np.repeat(np.arange(len(texts)), rows) * self.dim + place // 2
        out = np.bincount(cell, weights=place % 2 * 2 - 1, minlength=len(texts) * self.dim).reshape(-1, self.dim).astype(np.float32)
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.where(n > 0, out / np.maximum(n, 1e-12), out)


def embed(df: DataFrame, key: str, text: str, make_encoder: Callable = HashingEncoder, batch: int = 32, keep: bool = False) -> DataFrame:
    """(key, embedding, error): vectors of the texts in batches. A batch that fails gives null vectors and its error;
    null texts are encoded as ''. The encoder is made once per task. With ``keep`` all other columns go along in the same pass."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = make_encoder()
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            vecs: list = []
            errors: list = []
            for s in range(0, len(texts), batch):
                part = texts[s : s + batch]
                try:
                    vecs.extend(np.asarray(enc.encode(part), np.float32).tolist())
                    errors.extend([None] * len(part))
                except Exception as e:  # noqa: BLE001
                    vecs.extend([None] * len(part))
                    errors.extend([str(e)] * len(part))
            yield pa.RecordBatch.from_arrays([*(b.column(out.names.index(c) if keep else 0) for c in out.names[:-2]), pa.array(vecs, pa.list_(pa.float32())), pa.array(errors, pa.string())], out.names)

    src = df.select(key, text, *[c for c in df.columns if c not in (key, text, "embedding", "error")]) if keep else df.select(key, text)
    out = StructType([*(src.schema if keep else src.schema[:1]), StructField("embedding", ArrayType(FloatType())), StructField("error", StringType())])
    return src.mapInArrow(run, out)


def shaped_hits(hits: DataFrame, store: DataFrame, id_col: str) -> DataFrame:
    """Hits (query_id, id, rank, score) as the service hands them out: id, doc_id and file_path 'unknown' where the store lacks them,
    content '', no chunk_index, and a distance that is always null; hits without a stored row stay."""
    s = store.select(F.col(id_col).alias("id"), "doc_id", "file_path", "content").groupBy("id").agg(F.min(F.struct("doc_id", "file_path", "content")).alias("s"))
    unknown = lambda c: F.coalesce(c, F.lit("unknown"))
    return hits.join(s, "id", "left").select("query_id", "rank", unknown(F.col("id").cast("string")).alias("id"), unknown(F.col("s.doc_id")).alias("doc_id"), unknown(F.col("s.file_path")).alias("file_path"), F.coalesce("s.content", F.lit("")).alias("content"), "score", F.lit(None).cast("double").alias("distance"))


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of rows with an id and a finite vector that is not zero."""
    return df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)) & (norm("v") > 0)
    )


def query_blocks(queries: DataFrame, id_col: str, vec_col: str, block: int = QUERY_BLOCK) -> Iterator[tuple[list, np.ndarray]]:
    """Query ids and unit vectors, in blocks of one length of vector; the driver holds one block at a time."""
    held: dict[int, tuple[list, list]] = {}
    for r in usable(queries, id_col, vec_col).toLocalIterator():
        ids, vs = held.setdefault(len(r["v"]), ([], []))
        ids.append(r["id"])
        vs.append(r["v"])
        if len(ids) == block:
            yield ids, _unit(np.array(vs, np.float64))
            del held[len(r["v"])]
    for ids, vs in held.values():
        yield ids, _unit(np.array(vs, np.float64))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def ids_of(column: pa.Array) -> np.ndarray:
    """Ids as an array that sorts as Spark does: numbers, or strings by code points."""
    return np.array(column.to_pylist())


class Best:
    """The ``k`` best rows of each query, of all that were added: highest score first, equal ones by id."""

    def __init__(self, k: int):
        self.k, self.held = k, []

    def add(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray, ok: np.ndarray | None = None) -> None:
        """``scores`` is queries x ids; where ``ok`` is false a row does not count."""
        if ok is not None:
            scores = np.where(ok, scores, -np.inf)
        m = min(self.k, scores.shape[1])
        least = -np.partition(-scores, m - 1, axis=1)[:, m - 1]
        i, j = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        if len(i):
            self.held.append((queries[i], ids[j], scores[i, j]))
            self.held = [self.rows()]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(queries, ids, scores) in order."""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        q, ids, s = (np.concatenate([h[x] for h in self.held]) for x in range(3))
        o = np.lexsort((ids, -s, q))
        q, ids, s = q[o], ids[o], s[o]
        start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
        ok = place < self.k
        return q[ok], ids[ok], s[ok]


def topk(vectors: DataFrame, id_col: str, vec_col: str, queries: DataFrame, query_id: str, query_vec: str, k: int = 10, exclude_self: bool = False) -> DataFrame:
    """(query_id, id, rank, cosine): the ``k`` most similar vectors of every query, cosine at six places, ties by id.

    Exact, in blocks: each task keeps its best ``k`` per query by one matrix product a batch, so only k rows a task and
    query are shuffled. Null, zero and NaN vectors, and vectors of another length, are left out; no queries, no rows.
    """
    spark = vectors.sparkSession
    prepare(spark)
    base = usable(vectors, id_col, vec_col)
    kq = queries.schema[query_id].dataType
    out = None
    for ids, units in query_blocks(queries, query_id, query_vec):
        part = _best_of(base.where(F.size("v") == units.shape[1]), ids, units, kq, k, exclude_self)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], _hits(kq, vectors.schema[id_col].dataType)).withColumn("rank", F.lit(0)).select("query_id", "id", "rank", "cosine")
    return _ranked(out, k)


def _hits(query_kind, id_kind) -> StructType:
    return StructType([StructField("query_id", query_kind), StructField("id", id_kind), StructField("cosine", DoubleType())])


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "id", "rank", "cosine")


def _best_of(base: DataFrame, ids: list, units: np.ndarray, query_kind, k: int, exclude_self: bool = False, probed: np.ndarray | None = None) -> DataFrame:
    """(query_id, id, cosine): of each task's rows of ``base`` (id, v[, cell]) the ``k`` best for every query of the block. With ``probed``
    (queries x cells) a row is compared with the queries that probe its cell only, cell by cell."""
    shared = base.sparkSession.sparkContext.broadcast((ids, units, probed))
    out = _hits(query_kind, base.schema["id"].dataType)
    qtype, vtype = to_arrow_type(query_kind), to_arrow_type(base.schema["id"].dataType)
    dim = units.shape[1]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q, probed = shared.value
        names = np.array(qids)
        held = Best(k)
        for b in batches:
            if not b.num_rows:
                continue
            vid = ids_of(b.column(0))
            flat, off = b.column(1).values.to_numpy(zero_copy_only=False), b.column(1).offsets.to_numpy()
            u = _unit(flat[off[0] : off[-1]].reshape(-1, dim).astype(np.float64))
            if probed is None:
                groups = [(np.arange(len(qids)), np.arange(len(u)))]
            else:
                cell = b.column(2).to_numpy()
                groups = [(np.flatnonzero(probed[:, c]), np.flatnonzero(cell == c)) for c in np.unique(cell)]
            for qs, rows in groups:
                if len(qs):
                    cos = np.floor((q[qs] @ u[rows].T) * 1e6 + 0.5) / 1e6
                    held.add(qs, vid[rows], cos, names[qs][:, None] != vid[rows][None, :] if exclude_self else None)
        i, ids, cos = held.rows()
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array([qids[x] for x in i], qtype), pa.array(ids.tolist(), vtype), pa.array(cos)], out.names)

    return base.mapInArrow(best, out)


def with_scores(hits: DataFrame) -> DataFrame:
    """Hits with ``score``: 1/(1+d) of the value the index returns as distance, beside the cosine that ranks."""
    return hits.withColumn("score", F.round(distance_score("cosine"), 6))


def normalised(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.select(id_col, l2_normalize(vec_col).alias(vec_col))


def nprobe_for(rows: int) -> int:
    return next(p for limit, p in NPROBE if limit is None or rows < limit)


def ivf_train(vectors: DataFrame, id_col: str, vec_col: str, nlist: int = 1024, sample: int = IVF_SAMPLE, rounds: int = 10) -> dict[int, np.ndarray]:
    """Unit centroids by length of vector: at most ``nlist`` cells a length, by spherical k-means on a bounded sample of the
    vectors, to which each length adds its share."""
    good = usable(vectors, id_col, vec_col).withColumn("n", F.size("v"))
    counts = {r["n"]: r["count"] for r in good.groupBy("n").count().collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for n, c in counts.items() for x in (n, -(-sample * c // max(sample, sum(counts.values()))))])
    w = Window.partitionBy("n").orderBy(F.xxhash64("id"), "id")
    rows = good.withColumn("r", F.row_number().over(w)).where(F.col("r") <= share[F.col("n")]).orderBy("n", "r").select("n", "v").collect()
    out = {}
    for dim in sorted(counts):
        x = _unit(np.array([r["v"] for r in rows if r["n"] == dim], np.float64))
        c = x[np.linspace(0, len(x) - 1, min(nlist, max(1, len(x) // 8))).astype(int)]
        for _ in range(rounds):
            own = (x @ c.T).argmax(axis=1)
            s = np.zeros_like(c)
            np.add.at(s, own, x)
            n = np.linalg.norm(s, axis=1, keepdims=True)
            c = np.where(n > 1e-9, s / np.maximum(n, 1e-9), c)
        out[dim] = c
    return out


def _by_length(b: pa.RecordBatch, column: int, centroids: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(row numbers, unit vectors, centroids, number of the first cell) for each length of vector in the batch that has cells."""
    flat, off = b.column(column).values.to_numpy(zero_copy_only=False), b.column(column).offsets.to_numpy()
    size, base = np.diff(off), 0
    for dim, c in sorted(centroids.items()):
        at = np.flatnonzero(size == dim)
        if len(at):
            yield at, _unit(flat[off[at][:, None] + np.arange(dim)].astype(np.float64)), c, base
        base += len(c)


def ivf_assign(vectors: DataFrame, id_col: str, vec_col: str, centroids: dict[int, np.ndarray], cells: int = 1) -> DataFrame:
    """(id, v, cell): the nearest ``cells`` cells of every usable vector; written partitioned by cell, probes prune files."""
    spark = vectors.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(centroids)

    def run(batches):
        for b in batches:
            for at, u, c, base in _by_length(b, 1, shared.value):
                near = np.argsort(-(u @ c.T), axis=1, kind="stable")[:, :cells].astype(np.int32)
                rows = pa.array(np.repeat(at, near.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(near.ravel() + np.int32(base))], ["id", "v", "cell"])

    base = usable(vectors, id_col, vec_col).where(F.size("v").isin(*centroids))
    return base.mapInArrow(run, f"id {dict(vectors.dtypes)[id_col]}, v array<float>, cell int")


def cell_bounds(index: DataFrame, centroids: dict[int, np.ndarray]) -> dict[int, tuple[int, float]]:
    """By cell that has rows: their number, and the least cosine of one of them to the centroid."""
    shared = index.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for b in batches:
            for at, u, c, base in _by_length(b, 0, shared.value):
                cell = b.column(1).to_numpy()[at]
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.einsum("ij,ij->i", u, c[cell - base]))], ["cell", "cos"])

    near = index.select("v", "cell").mapInArrow(run, "cell int, cos double")
    return {r["cell"]: (r["n"], r["least"]) for r in near.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("cos").alias("least")).collect()}


def ivf_search(index: DataFrame, centroids: dict[int, np.ndarray], queries: DataFrame, query_id: str, query_vec: str, k: int = 10, nprobe: int | None = None) -> DataFrame:
    """(query_id, id, rank, cosine): the best ``k`` rows of the index for each query, from the cells it probes.

    Exact by default: the nearest cells are probed first, as many as ``nprobe_for`` says, then every cell whose bound does
    not exclude a hit as good as the k-th so far. With ``nprobe`` only the rows of so many nearest cells are compared, and
    hits outside them are missed. Queries go to the tasks in blocks; cells that none of a block probes are not read where
    the index is written by cell, and a row meets only the queries that probe its cell, in one matrix product a cell.
    """
    spark = index.sparkSession
    prepare(spark)
    kq = queries.schema[query_id].dataType
    bounds = {} if nprobe else cell_bounds(index, centroids)
    first = nprobe or nprobe_for(sum(n for n, _ in bounds.values()))
    starts = dict(zip(sorted(centroids), np.cumsum([0, *(len(centroids[d]) for d in sorted(centroids))])))
    cells = sum(len(c) for c in centroids.values())

    def hits(ids: list, units: np.ndarray, probed: np.ndarray) -> DataFrame:
        some = np.flatnonzero(probed.any(axis=0)).tolist()
        return _ranked(_best_of(index.where(F.col("cell").isin(some)).select("id", "v", "cell"), ids, units, kq, k, probed=probed), k)

    out = None
    for ids, units in query_blocks(queries, query_id, query_vec):
        c = centroids.get(units.shape[1])
        if c is None:
            continue
        base = starts[units.shape[1]]
        sim = units @ c.T
        probed = np.zeros((len(ids), cells), bool)
        np.put_along_axis(probed, np.argsort(-sim, axis=1, kind="stable")[:, :first] + base, True, axis=1)
        part = hits(ids, units, probed)
        if not nprobe:
            part = stage(part, "ivf_first")
            floor = {r["query_id"]: r["cosine"] for r in part.where(F.col("rank") == k).collect()}
            least = np.array([floor.get(i, -2.0) for i in ids])
            # A row lies within the cell's angle of the centroid, so no nearer to the query than the centroid's angle less that.
            # Cosines are compared at six places, and the index holds floats.
            angle = np.arccos(np.clip([bounds[base + x][1] if base + x in bounds else 1.0 for x in range(len(c))], -1, 1))
            best = np.cos(np.maximum(np.arccos(np.clip(sim, -1, 1)) - angle, 0))
            more = np.zeros_like(probed)
            more[:, base : base + len(c)] = (best >= least[:, None] - 1e-5) & np.isin(np.arange(base, base + len(c)), list(bounds))
            more &= ~probed
            if more.any():
                part = part.drop("rank").unionByName(hits(ids, units, more).drop("rank"))
            part = _ranked(part, k)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], _hits(kq, index.schema["id"].dataType)).withColumn("rank", F.lit(0)).select("query_id", "id", "rank", "cosine")
    # An id that several queries' blocks share is ranked once more.
    return _ranked(out.drop("rank").distinct(), k)


def chunks_by_path(chunks: DataFrame, path: str, limit: int = 1000) -> DataFrame:
    """Chunks of a file: those whose relative path (in metadata) or file_path equals it, or whose doc_id starts with 'path#';
    sorted by chunk_index (missing first, as 0), then id; the limit is taken after the sort."""
    rel = F.get_json_object("metadata", "$.relative_path")
    hit = F.coalesce(rel == path, F.lit(False)) | F.coalesce(F.col("file_path") == path, F.lit(False)) | F.coalesce(F.col("doc_id").startswith(path + "#"), F.lit(False))
    return chunks.where(hit).dropDuplicates(["id"]).orderBy(F.coalesce("chunk_index", F.lit(0)), "id").limit(limit)


def collection_stats(df: DataFrame, vec_col: str) -> DataFrame:
    """One row: row_count and greatest vector length (0 without vectors)."""
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.max(F.size(vec_col)), F.lit(0)).alias("dim"))
