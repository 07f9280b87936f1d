"""Latency, throughput and completeness of acquisition methods, from samples (method, ordinal, status, latency_ms, fields)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of a detail record.
FIELDS = ("ref", "title", "url", "description", "subtitle", "tags", "author", "last_updated", "votes", "downloads", "usability_rating", "size_bytes", "license")
MIN_COMPLETENESS = 0.8


def present(column: Column, kind: str) -> Column:
    """Not null, nor empty text, nor an empty list; zero and false are present."""
    if kind == "string":
        return F.coalesce(column, F.lit("")) != ""
    if kind.startswith("array"):
        return F.coalesce(F.size(column), F.lit(0)) > 0
    return column.isNotNull()


def populated(df: DataFrame, fields: tuple[str, ...]) -> Column:
    kinds = dict(df.dtypes)
    return sum((present(F.col(f), kinds[f]).cast("int") for f in fields), F.lit(0))


def nearest_rank(value: str, q: float) -> Column:
    """The smallest value that at least a share q of all do not exceed; null of none."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")


def method_stats(samples: DataFrame, total_fields: int = len(FIELDS)) -> DataFrame:
    """samples: method, status, latency_ms, populated, wall_ms (of the whole method, repeated)."""
    ok = F.col("status") == "ok"
    done = F.count_if(ok)
    seconds = F.max("wall_ms") / 1000.0
    return samples.groupBy("method").agg(
        F.count(F.lit(1)).alias("requested"),
        done.alias("succeeded"),
        F.count_if(~ok).alias("failed"),
        nearest_rank("latency_ms", 0.5).cast("long").alias("latency_p50"),
        nearest_rank("latency_ms", 0.95).cast("long").alias("latency_p95"),
        F.round(F.when(seconds > 0, done / seconds).otherwise(0.0), 3).alias("throughput"),
        F.round(F.when(done > 0, F.sum(F.when(ok, F.col("populated"))) / (done * total_fields)).otherwise(0.0), 4).alias("completeness"),
    )


def recommended(stats: DataFrame, least: float = MIN_COMPLETENESS) -> DataFrame:
    """At most one row: of methods without failures and complete enough, the fastest, then the most complete."""
    return stats.where((F.col("failed") == 0) & (F.col("completeness") >= least)).orderBy(F.desc("throughput"), F.desc("completeness"), "method").limit(1)
