"""Sharding by jump consistent hashing (Lamping and Veach): a key and the number of shards decide, without a ring
table, and one more shard takes rows only into itself."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ranked

#: Fixed value: the multiplier of the published generator.
MULTIPLIER = 2862933555777941757


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key."""
    state = keys.astype(np.uint64)
    shard, ahead = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(moving):
            shard[moving] = ahead[moving]
            state[moving] = state[moving] * np.uint64(MULTIPLIER) + np.uint64(1)
            stride = 2.0**31 / ((state[moving] >> np.uint64(33)).astype(np.float64) + 1.0)
            ahead[moving] = ((shard[moving] + 1) * stride).astype(np.int64)
            moving = moving[ahead[moving] < shards]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """key is hashed first, so that any type of key, null included, has its shard."""

    @F.pandas_udf("int")
    def jump(values: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(values.to_numpy(np.int64), shards).astype(np.int32))

    return jump(F.xxhash64(key))


def sharded(docs: DataFrame, shards: int = 8, rows: int | None = None) -> DataFrame:
    """Every row with its size, its text's CRC-32, its shard, its slot in that shard, and its shard if there were one more.

    Rows of an equal doc_id, repeated ones included, share a shard and have slots of their own. A null text counts as
    empty; rows with a null doc_id share a shard. A text of any length counts whole. Other columns are ignored. An empty
    table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    dealt = base.withColumn("shard", shard_of(F.col("doc_id"), shards)).withColumn("grown_shard", shard_of(F.col("doc_id"), shards + 1))
    placed = ranked(dealt, "shard", "slot", docs.count() if rows is None else rows, keys=shards)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8(spark, sf_dir: str) -> DataFrame:
    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)
