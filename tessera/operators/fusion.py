"""Reciprocal rank fusion of two ranked lists, for one query or many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.keyword import check_page

RRF_K = 60


def check_fusion(rrf_k: int, *depths: int) -> None:
    if rrf_k < 1:
        raise ValueError("rrf_k must be positive")
    if any(not 1 <= d <= 100 for d in depths):
        raise ValueError("depths must be between 1 and 100")


def first_ranks(ranked: DataFrame, score: str) -> DataFrame:
    """Of repeated ids the first rank, with its score."""
    return ranked.groupBy("query_id", "id").agg(F.min("rank").alias("rank"), F.min_by(score, "rank").alias(score))


def rrf_score(keyword_rank: Column, semantic_rank: Column, rrf_k: int) -> Column:
    part = lambda r: F.coalesce(F.lit(1.0) / (F.lit(float(rrf_k)) + r), F.lit(0.0))
    return part(keyword_rank) + part(semantic_rank)


def reciprocal_rank_fusion(keyword: DataFrame, semantic: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """keyword and semantic: query_id, id, rank, and keyword_score or semantic_score. One row for each id on either side."""
    check_fusion(rrf_k)
    k = first_ranks(keyword, "keyword_score").withColumnRenamed("rank", "keyword_rank")
    s = first_ranks(semantic, "semantic_score").withColumnRenamed("rank", "semantic_rank")
    both = k.join(s, ["query_id", "id"], "full_outer")
    return both.withColumn("hybrid_score", rrf_score(F.col("keyword_rank"), F.col("semantic_rank"), rrf_k))


def fused_order() -> list[Column]:
    return [F.desc("hybrid_score"), F.least("keyword_rank", "semantic_rank"), F.col("id").cast("string")]


def fused_page(fused: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """The page of each query, after fusion, with the place in it."""
    check_page(limit, offset)
    place = Window.partitionBy("query_id").orderBy(*fused_order())
    return fused.withColumn("place", F.row_number().over(place)).where((F.col("place") > offset) & (F.col("place") <= offset + limit))
