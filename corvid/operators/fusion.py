"""Fusion and reranking of ranked lists, for many queries at once.

A side is a table (query_id, id, doc_id, rank, score[, content]); the fusion key is doc_id, or id where doc_id is null or
'unknown'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions.text import strip, tokens

RRF_K = 60
FAN_OUT = 5
CANDIDATE_FACTOR, CANDIDATE_CAP = 3, 50


def candidate_cap(k: int) -> int:
    return min(CANDIDATE_FACTOR * k, CANDIDATE_CAP)


def check_weights(vector: float, keyword: float) -> None:
    """Raise ValueError unless the weights sum to 1 within 0.01."""
    if abs(vector + keyword - 1) > 0.01:
        raise ValueError("weights must sum to 1")


def key_of(df: DataFrame) -> DataFrame:
    return df.withColumn("key", F.coalesce(F.nullif(F.col("doc_id").cast("string"), F.lit("unknown")), F.col("id").cast("string"))).where("key IS NOT NULL")


def rrf(vector: DataFrame, keyword: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, key, rrf, vector_rank, vector_score, keyword_rank, keyword_score, n_sources, sources, position).

    Reciprocal rank fusion: every occurrence adds 1/(k+rank). Rank and score of a side are those of its first vector and its
    last keyword occurrence. Order: score, then vector rank (missing last), keyword rank, key. Either side may be empty.
    """
    both = (
        key_of(vector).select("query_id", "key", "rank", F.col("score").cast("double").alias("score"), F.lit("vector").alias("source"))
        .unionByName(key_of(keyword).select("query_id", "key", "rank", F.col("score").cast("double").alias("score"), F.lit("keyword").alias("source")))
    )
    v, w = F.col("source") == "vector", F.col("source") == "keyword"
    rank_if = lambda c: F.when(c, F.col("rank"))
    fused = both.groupBy("query_id", "key").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 8).alias("rrf"),
        F.min(rank_if(v)).alias("vector_rank"),
        F.min_by(F.when(v, F.col("score")), rank_if(v)).alias("vector_score"),
        F.max(rank_if(w)).alias("keyword_rank"),
        F.max_by(F.when(w, F.col("score")), rank_if(w)).alias("keyword_score"),
        F.count(F.lit(1)).alias("n_sources"),
        F.array_join(F.reverse(F.array_sort(F.collect_list("source"))), ",").alias("sources"),
    )
    o = Window.partitionBy("query_id").orderBy(F.desc("rrf"), F.col("vector_rank").asc_nulls_last(), F.col("keyword_rank").asc_nulls_last(), "key")
    return fused.withColumn("position", F.row_number().over(o))


def weighted(vector: DataFrame, keyword: DataFrame, w_vector: float = 0.6, w_keyword: float = 0.4) -> DataFrame:
    """(query_id, key, combined_score): w1*vector + w2*keyword, a missing side counts 0; of repeated keys the best rank counts."""
    check_weights(w_vector, w_keyword)

    def side(df, name):
        return key_of(df).groupBy("query_id", "key").agg(F.min_by(F.col("score").cast("double"), "rank").alias(name))

    both = side(vector, "a").join(side(keyword, "b"), ["query_id", "key"], "full")
    return both.select("query_id", "key", F.round(w_vector * F.coalesce("a", F.lit(0.0)) + w_keyword * F.coalesce("b", F.lit(0.0)), 6).alias("combined_score"))


def both_sources(fused: DataFrame) -> DataFrame:
    """(query_id, n): keys that stand in exactly two lists."""
    return fused.groupBy("query_id").agg(F.count_if(F.col("n_sources") == 2).alias("n"))


def coverage(query, content):
    """Stand-in for a cross-encoder's score: the share of the query's distinct tokens that the content holds, six places."""
    q = F.array_distinct(tokens(query))
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(q, tokens(content))), F.size(q)), F.lit(0.0)), 6)


def rerank(candidates: DataFrame, query: str, content: str, order: str, k: int = 10, cut: int | None = None, scorer=coverage) -> DataFrame:
    """The best ``k`` candidates of each query by the scorer, with rerank_score and rank; rows of empty content fall out first.
    ``cut`` keeps only that many of each query by ``order`` before scoring; ties keep that order."""
    c = candidates.where(F.length(strip(content)) > 0)
    w = Window.partitionBy("query_id")
    if cut is not None:
        c = c.withColumn("_n", F.row_number().over(w.orderBy(order))).where(F.col("_n") <= cut).drop("_n")
    scored = c.withColumn("rerank_score", scorer(query, content))
    return scored.withColumn("rank", F.row_number().over(w.orderBy(F.desc("rerank_score"), order))).where(F.col("rank") <= k)


def final_score(rerank_score, rrf_score, score):
    """The score a result shows: rerank, else fusion, else its own, else 0."""
    return F.coalesce(rerank_score, rrf_score, score, F.lit(0.0))
