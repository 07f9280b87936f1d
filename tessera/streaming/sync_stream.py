"""The sync of catalog rows as a stream: each micro-batch is folded into the stored records of its own buckets, in a new
version of the table that is named by the batch, so that a batch that is run again changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import sync
from tessera.sources.bucketed import BucketTable


def records_table(spark: SparkSession, path: str, fields: list[tuple[str, str]], buckets: int = 64) -> BucketTable:
    """ref and record, a struct of the fields."""
    return BucketTable(spark, path, f"ref string, record struct<{','.join(f'{n}:{kind}' for n, kind in fields)}>", ["ref"], required=("ref", "record"), buckets=buckets)


def sync_stream(rows: DataFrame, target: BucketTable, checkpoint: str, fields: list[tuple[str, str]], once: bool = True, keep: int = 3):
    """A query that folds accepted rows of a stream into target (records_table); late rows are never dropped, the merge
    decides. rows have ref, seq and the fields. The last versions of target stay readable."""

    def fold(batch: DataFrame, number: int) -> None:
        done = target.manifest().tag
        if done is not None and number <= int(done):
            return  # before a restart

        def merged(old: DataFrame, new: DataFrame) -> DataFrame:
            stored = old.select("ref", F.lit(0).alias("_k"), F.lit(None).cast(batch.schema["seq"].dataType).alias("seq"), *[F.col(f"record.{n}").alias(n) for n, _ in fields])
            ordered = stored.unionByName(new).withColumn("_order", F.struct("_k", "seq"))
            return sync.fold(ordered, "ref", "_order", fields).select("ref", "record")

        fresh = batch.where(sync.valid_record()).select("ref", F.lit(1).alias("_k"), "seq", *[n for n, _ in fields]).persist()
        try:
            target.upsert(fresh, merged, tag=str(number))
        finally:
            fresh.unpersist()
        target.expire(keep)

    writer = rows.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
