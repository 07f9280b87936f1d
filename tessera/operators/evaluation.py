"""Relevance metrics of retrieval methods, from judged rows (query_id, method, rank, resource_id, relevance_label)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METHODS = ("keyword", "semantic", "hybrid")
#: The labels of a judgement.
LABELS = ("Relevant", "Partially Relevant", "Irrelevant")
TOP = 5
QUERIES, CATEGORIES, EACH = 24, 6, 4


def labelled(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("relevance_label").isin(*LABELS))


def method_metrics(rows: DataFrame) -> DataFrame:
    """One row for each method, zeros where it has none: ranks are counted among judged rows only."""
    order = Window.partitionBy("query_id", "method").orderBy("rank", "resource_id")
    top = labelled(rows).withColumn("place", F.row_number().over(order)).where(F.col("place") <= TOP)
    relevant, partly = F.col("relevance_label") == LABELS[0], F.col("relevance_label") == LABELS[1]
    by = top.groupBy("method").agg(
        F.count_distinct("query_id").alias("labelled_queries"),
        F.count_if((F.col("place") == 1) & relevant).alias("top_1_relevant"),
        F.count_if(relevant).alias("top_5_relevant"),
        F.count_if(relevant | partly).alias("top_5_relevant_or_partial"),
        F.count_if(F.col("relevance_label") == LABELS[2]).alias("top_5_irrelevant"),
    )
    counts = [c for c in by.columns if c != "method"]
    every = rows.sparkSession.createDataFrame([(m,) for m in METHODS], "method string")
    full = every.join(F.broadcast(by), "method", "left").fillna(0, counts)
    rate = F.when(F.col("labelled_queries") > 0, F.col("top_1_relevant") / F.col("labelled_queries")).otherwise(0.0)
    return full.withColumn("top_1_relevant_rate", F.round(rate, 6))


def overlaps(rows: DataFrame) -> DataFrame:
    """One row: how many results methods share, and how many relevant ones hybrid has from one side only. The label of a
    query's result is the last in the order of rows (seq)."""
    has = {m: F.bool_or(F.col("method") == m).alias(m) for m in METHODS}
    per = labelled(rows).groupBy("query_id", "resource_id").agg(*has.values(), F.max_by("relevance_label", "seq").alias("label"))
    k, s, h = (F.col(m) for m in METHODS)
    return per.agg(
        F.count_if(k & s).alias("keyword_semantic"),
        F.count_if(k & h).alias("keyword_hybrid"),
        F.count_if(s & h).alias("semantic_hybrid"),
        F.count_if(s & ~k & h & (F.col("label") == LABELS[0])).alias("semantic_only_relevant"),
        F.count_if(k & ~s & h & (F.col("label") == LABELS[0])).alias("keyword_only_relevant"),
    )


def carry_labels(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """rows with the labels and notes that earlier rows of the same query, method and resource have; the last stands."""
    keys = ["query_id", "method", "resource_id"]
    last = judged.groupBy(*keys).agg(F.max_by(F.struct("relevance_label", "notes"), "seq").alias("_j"))
    return rows.join(last, keys, "left").withColumns({"relevance_label": F.col("_j.relevance_label"), "notes": F.coalesce("_j.notes", F.lit(""))}).drop("_j")


def check_fixture(queries: DataFrame) -> None:
    """The set of queries: so many, told apart by id, equally many of each category."""
    row = queries.agg(F.count(F.lit(1)), F.count_distinct("query_id")).first()
    by = [r[1] for r in queries.groupBy("category").count().collect()]
    if tuple(row) != (QUERIES, QUERIES) or by != [EACH] * CATEGORIES:
        raise ValueError(f"expected {QUERIES} distinct queries, {EACH} in each of {CATEGORIES} categories")
