"""An evaluation of all queries by keyword, semantic and hybrid search, each side in one plan for all of them."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import evaluation, fusion, keyword, vectors
from tessera.plans import stored

#: What a query of the fixture tells.
FIXTURE = "query_id string, category string, raw_query string, lexical_queries array<string>, semantic_query string"


@dataclass(frozen=True)
class Evaluation:
    rows: DataFrame
    timings: dict[str, float]

    def report(self) -> dict:
        """A JSON-ready report: rows in order, metrics of each method, overlaps, and how long each stage took."""
        rows = [r.asDict(recursive=True) for r in self.rows.orderBy("query_id", "method", "rank").collect()]  # five to a query and method
        judged = self.rows.withColumn("seq", F.col("rank"))
        metrics = [r.asDict() for r in evaluation.method_metrics(judged).collect()]
        return {"status": "pending_human_review", "rows": rows, "metrics": metrics, "overlaps": evaluation.overlaps(judged).first().asDict(), "timings": self.timings}


def checked_semantic(query: str) -> str:
    """Single spaces, trimmed; it needs a letter or a digit."""
    kept = " ".join(query.split())
    if not any(c.isalnum() for c in kept):
        raise ValueError("a semantic query needs a letter or a digit")
    return kept


def timed(df: DataFrame, timings: dict[str, float], name: str) -> DataFrame:
    """df written to the shared folder, and how many milliseconds that took."""
    began, path = time.perf_counter(), stored.folder(df.sparkSession)
    df.write.parquet(path)
    timings[name] = round(1000 * (time.perf_counter() - began), 3)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyword_side(index: keyword.Index, queries: list[dict], k: int, resource_type: str | None, analyze: Callable | None = None) -> DataFrame:
    """query_id, id, keyword_score and rank: the best of each query's lexical queries."""
    spark = index.posts.sparkSession
    subs = [(n, q["query_id"], text) for n, (q, text) in enumerate((q, t) for q in queries for t in keyword.clean_queries(q["lexical_queries"]))]
    terms = keyword.query_terms(spark, [(n, text) for n, _, text in subs], analyze)
    owners = spark.createDataFrame([(n, owner) for n, owner, _ in subs], "sub long, owner string")
    hits = keyword.matches(index, terms, "cover", resource_type).join(F.broadcast(owners), F.col("query_id") == F.col("sub"))
    best = hits.groupBy(F.col("owner").alias("query_id"), "id").agg(F.max("score").alias("score"))
    return keyword.top_k(best, k).withColumnRenamed("score", "keyword_score")


def semantic_side(resources: DataFrame, embeddings: DataFrame, backend: vectors.EmbeddingBackend, queries: list[dict], k: int, resource_type: str | None) -> DataFrame:
    """query_id, id, semantic_score and rank: the nearest of all active resources."""
    vectors.ensure_model(embeddings, (backend.name, backend.revision, backend.dimension))
    found = backend.embed([checked_semantic(q["semantic_query"]) for q in queries])
    asked = resources.sparkSession.createDataFrame([(q["query_id"], v) for q, v in zip(queries, found, strict=True)], "query_id string, vector array<float>")
    live = keyword.active(resources, resource_type).select("id").join(embeddings.select(F.col("resource_id").alias("id"), "embedding"), "id")
    return vectors.semantic_top_k(live, asked, k).withColumnRenamed("score", "semantic_score")


def run_evaluation(
    queries: list[dict],
    resources: DataFrame,
    embeddings: DataFrame,
    backend: vectors.EmbeddingBackend,
    analyzers: tuple[Callable, Callable],
    resource_type: str | None = "dataset",
    rrf_k: int = fusion.RRF_K,
    keyword_top_k: int = 20,
    semantic_top_k: int = 20,
    previous: DataFrame | None = None,
) -> Evaluation:
    """The five best of every query by each method, with the labels and notes of previous rows (query_id, method,
    resource_id, relevance_label, notes). Times are of all queries together."""
    fusion.check_fusion(rrf_k, keyword_top_k, semantic_top_k)
    spark = resources.sparkSession
    fixture = spark.createDataFrame([tuple(q[f.split()[0]] for f in FIXTURE.split(", ")) for q in queries], FIXTURE)
    evaluation.check_fixture(fixture)
    timings: dict[str, float] = {}
    index = keyword.Index.of(keyword.active(resources, resource_type), analyzers[0])
    kw = timed(keyword_side(index, queries, keyword_top_k, resource_type, analyzers[1]), timings, "keyword_ms")
    sem = timed(semantic_side(resources, embeddings, backend, queries, semantic_top_k, resource_type), timings, "semantic_ms")
    fused = timed(fusion.fused_page(fusion.reciprocal_rank_fusion(kw, sem, rrf_k), evaluation.TOP), timings, "fusion_ms")
    timings["total_ms"] = round(sum(timings.values()), 3)
    of = lambda df, method, rank: df.where(F.col(rank) <= evaluation.TOP).select("query_id", F.lit(method).alias("method"), F.col(rank).cast("int").alias("rank"), "id")
    rows = of(kw, "keyword", "rank").unionByName(of(sem, "semantic", "rank")).unionByName(of(fused, "hybrid", "place"))
    named = rows.join(resources.select("id", "title"), "id").join(F.broadcast(fixture), "query_id").withColumn("resource_id", F.col("id").cast("string")).drop("id")
    if previous is None:
        labelled = named.withColumns({"relevance_label": F.lit(None).cast("string"), "notes": F.lit("")})
    else:
        judged = evaluation.labelled(previous)
        labelled = evaluation.carry_labels(named, judged if "seq" in judged.columns else judged.withColumn("seq", F.monotonically_increasing_id()))
    return Evaluation(labelled, timings)
