"""The retrieval plan: vector and keyword branches, fusion, rerank and context, for a table of queries in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.functions.text import strip
from corvid.operators import context, fusion, keyword, vectors
from corvid.session import stage

# Fixed value: the form that a rewritten query must have.
REWRITE = "semantic_search_query string, keyword_list array<string>"


def parse_rewrites(df: DataFrame, column: str) -> DataFrame:
    """``df`` with semantic_query and keywords (joined by spaces) from the rewriter's JSON; malformed JSON fails when it runs."""
    r = F.from_json(column, REWRITE, {"mode": "FAILFAST"})
    return df.withColumn("semantic_query", r["semantic_search_query"]).withColumn("keywords", F.array_join(r["keyword_list"], " "))


def stand_in_rewrite(query):
    """Column: a deterministic rewrite of a query: itself, and its tokens as keywords, as JSON."""
    from corvid.functions.text import tokens

    return F.to_json(F.struct(query.alias("semantic_search_query"), F.array_distinct(tokens(query)).alias("keyword_list")))


def rewritten(queries: DataFrame, rewriter: Callable = stand_in_rewrite) -> DataFrame:
    """``queries`` (query_id, query) with semantic_query and keywords by the rewriter (a column of the query's JSON); where either
    comes back blank the query itself stands in."""
    q = parse_rewrites(queries.withColumn("_json", rewriter(F.col("query"))), "_json").drop("_json")
    or_query = lambda c: F.coalesce(F.nullif(strip(c), F.lit("")), F.col("query"))
    return q.withColumns({"semantic_query": or_query("semantic_query"), "keywords": or_query("keywords")})


def with_vectors(queries: DataFrame, make_encoder: Callable = vectors.HashingEncoder) -> DataFrame:
    """``queries`` with query_vec, the encoded semantic_query (the query itself without one)."""
    text = "semantic_query" if "semantic_query" in queries.columns else "query"
    return vectors.embed(queries.drop("query_vec"), "query_id", text, make_encoder, keep=True).drop("error").withColumnRenamed("embedding", "query_vec")


def vector_side(chunks: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str) -> DataFrame:
    """The vector search of each query, by query_vec."""
    h = vectors.topk(chunks, id_col, vec_col, queries, "query_id", "query_vec", k)
    return h.select("query_id", "id", F.col("id").alias("doc_id"), "rank", F.col("cosine").alias("score"))


def keyword_side(docs: DataFrame, queries: DataFrame, k: int, id_col: str, text: str, search: keyword.Search = keyword.EXACT, path: str | None = None) -> DataFrame:
    """The keyword search of each query, by its keywords if it was rewritten, else by itself."""
    words = "keywords" if "keywords" in queries.columns else "query"
    h = keyword.bm25(docs, id_col, text, queries, "query_id", words, k, search, path)
    return h.select("query_id", F.col("doc_id").alias("id"), "doc_id", "rank", "score")


def hybrid(docs: DataFrame, id_col: str, text: str, vecs: DataFrame | None, vec_id: str, vec_col: str, queries: DataFrame, k: int = 10, search: keyword.Search = keyword.EXACT) -> DataFrame:
    """Fused lists: both sides fetch 5*k, a missing vector table leaves the keyword side alone."""
    kw = keyword_side(docs, queries, fusion.FAN_OUT * k, id_col, text, search)
    if vecs is None:
        return fusion.rrf(kw.limit(0), kw)
    return fusion.rrf(vector_side(vecs, queries, fusion.FAN_OUT * k, vec_id, vec_col), kw)


def retrieve(docs: DataFrame, id_col: str, text: str, vecs: DataFrame | None, vec_id: str, vec_col: str, queries: DataFrame, k: int = 10, path: str | None = None, search: keyword.Search = keyword.EXACT, rewriter: Callable | None = None, make_encoder: Callable | None = None, cut: int | None = None) -> DataFrame:
    """(query_id, rank, key, rrf, rerank_score, score, content, file_path): hybrid lists cut to min(3k, 50), texts joined only then,
    reranked to ``k``. With a ``rewriter`` the vector side searches by the semantic query (``make_encoder`` encodes it; without
    one the given query_vec counts) and the keyword side by the keywords. ``cut`` is the older pipeline's limit before scoring (2k)."""
    if rewriter:
        queries = stage(rewritten(queries, rewriter), "queries")
    if make_encoder and vecs is not None:
        queries = stage(with_vectors(queries, make_encoder), "query_vectors")
    fused = hybrid(docs, id_col, text, vecs, vec_id, vec_col, queries, k, search).where(F.col("position") <= fusion.candidate_cap(k))
    d = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text).alias("content"), (F.col(path) if path else F.lit(None).cast("string")).alias("file_path"))
    q = queries.select("query_id", "query")
    cand = fused.select("query_id", "key", "rrf", "position").join(d, "key").join(q, "query_id")
    best = fusion.rerank(cand, "query", "content", "position", k, cut)
    return best.withColumn("score", fusion.final_score(F.col("rerank_score"), F.col("rrf"), F.lit(0.0))).select("query_id", "rank", "key", "rrf", "rerank_score", "score", "content", "file_path")


def counts(queries: DataFrame, vector: DataFrame, kw: DataFrame, fused: DataFrame, final: DataFrame) -> DataFrame:
    """(query_id, total_vector, total_keyword, total_rrf, final_results): the sizes of each query's lists, zero included."""
    out = queries.select("query_id").distinct()
    for name, side in (("total_vector", vector), ("total_keyword", kw), ("total_rrf", fused), ("final_results", final)):
        out = out.join(side.groupBy("query_id").agg(F.count(F.lit(1)).alias(name)), "query_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def contexts(retrieved: DataFrame, queries: DataFrame, **limits) -> DataFrame:
    return context.context(retrieved, queries, **limits)
