"""The catalog's tables: their keys and the constraints that every write keeps."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessera.operators import sync_run
from tessera.sources.bucketed import BucketTable

#: The schema, the key, conditions by name, and the columns that cannot be null of each table.
TABLES: dict[str, tuple[str, list[str], dict[str, str], tuple[str, ...]]] = {
    "resources": (
        sync_run.RESOURCE,
        ["source", "source_id"],
        {"resource_type_known": "resource_type IN ('dataset', 'notebook')", "status_known": "status IN ('active', 'unavailable', 'deleted')"},
        ("id", "source", "source_id", "resource_type", "title", "url", "tags", "indexed_at", "last_synced_at", "status"),
    ),
    "states": (sync_run.STATE, ["ref"], {}, ("ref", "detail_pending")),
    "checkpoints": (
        sync_run.CHECKPOINT,
        sync_run.CHECKPOINT_KEY,
        {"mode_known": "mode IN ('bootstrap', 'incremental')", "status_known": "status IN ('running', 'complete', 'partial', 'retryable_failure', 'invalid_source')"},
        ("run_id", "mode", "source", "sort", "last_successful_page", "status", "retryable", "started_at", "updated_at"),
    ),
    "embeddings": (
        "resource_id string, content_hash string, embedding array<float>, model_name string, model_revision string, embedding_dimension int, embedded_at timestamp",
        ["resource_id"],
        {"dimension_true": "size(embedding) = embedding_dimension", "embedding_finite": "forall(embedding, x -> NOT isnan(x) AND abs(x) < double('infinity'))"},
        ("resource_id", "content_hash", "embedding", "model_name", "model_revision", "embedding_dimension", "embedded_at"),
    ),
}


def catalog_table(spark: SparkSession, home: str, name: str, buckets: int = 64, **constraints: str) -> BucketTable:
    """The table below a folder; more constraints may be named, as the dimension of one model."""
    schema, keys, conditions, required = TABLES[name]
    return BucketTable(spark, f"{home.rstrip('/')}/{name}", schema, keys, conditions | constraints, required, buckets=buckets)
