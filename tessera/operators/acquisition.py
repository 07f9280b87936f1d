"""The acquisition benchmark: details of a list of refs by several methods, their samples and statistics."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import stats, sync
from tessera.sources import catalog

#: The methods and whether they ask for several refs at a time.
METHODS = {"rest-sequential": False, "rest-concurrent": True}


def checked(refs: list[str], methods: list[str], workers: int) -> list[str]:
    """The refs, trimmed and distinct in order."""
    kept = list(dict.fromkeys(r.strip() for r in refs if r.strip()))
    if not kept:
        raise ValueError("give at least one ref")
    if workers < 1:
        raise ValueError("workers must be positive")
    unknown = sorted(set(methods) - set(METHODS))
    if unknown:
        raise ValueError(f"unknown methods: {', '.join(unknown)}")
    return kept


def checked_source(source: str) -> str:
    kind, _, value = source.partition(":")
    if kind not in ("tag", "query") or not value.strip():
        raise ValueError("a source is tag:<value> or query:<value>")
    return source


def discovered(rows: DataFrame, size: int) -> list[str]:
    """The first distinct refs of valid rows, in the order in which they come: a stated sample."""
    if size < 1:
        raise ValueError("a sample has at least one ref")
    firsts = rows.where(sync.valid_record()).groupBy("ref").agg(F.min("seq").alias("first"))
    return [r.ref for r in firsts.orderBy("first").limit(size).collect()]


def samples(spark: SparkSession, refs: list[str], methods: list[str], options: dict, workers: int = 4) -> DataFrame:
    """position, ref, method, status, latency_ms, populated and wall_ms of each ref by each method, in order of position."""
    kept = checked(refs, methods, workers)
    asked = spark.createDataFrame(list(enumerate(kept)), "position int, ref string")
    out = None
    for method in methods:
        spread = asked.repartitionByRange(workers if METHODS[method] else 1, "position")
        began = time.perf_counter()
        rows = catalog.details(spread, options).collect()  # one to a stated ref
        wall = 1000 * (time.perf_counter() - began)
        found = spark.createDataFrame(rows, "ref string, record string, error string, latency_ms long")
        kinds = [(f.split()[0], f.split()[1]) for f in sync.RECORD.split(", ") if f.split()[0] != "is_private"]
        detail = catalog.detail_records(found, [("ref", "string"), *kinds])
        told = detail.select(F.col("ref").alias("_ref"), "error", "detail.*")
        one = told.select(
            F.col("_ref").alias("ref"),
            F.lit(method).alias("method"),
            F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"),
            F.when(F.col("error").isNull(), stats.populated(told, stats.FIELDS)).otherwise(0).cast("long").alias("populated"),
            F.lit(wall).alias("wall_ms"),
        ).join(found.select("ref", "latency_ms"), "ref")
        out = one if out is None else out.unionByName(one)
    return out.join(asked, "ref").orderBy("method", "position")
