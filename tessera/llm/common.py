"""What several operators share: tables in the shared folder, ranks without a hot task, input columns."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The word separators of the contracts: space and \x09 to \x0D.
SPACES = " \t\n\x0b\f\r"

#: Rows of a key are joined in so many parts.
SALTS = 8

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. One is made up only where none is set and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return context._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df written as a table to the shared folder and read back, which cuts the lineage.

    What is returned may be read at any later time, so the tables live as long as the session: they are removed when
    Python ends, or by release() once a caller has written what it made of them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in the order of written tables, for release()."""
    return len(_written)


def release(since: int, until: int | None = None) -> None:
    """Removes the tables written from one mark to another; what was made of them must have been written."""
    gone = _written[since:until]
    del _written[since:until]
    for spark, path in gone:
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session is gone, or another has removed the folder
        pass


@atexit.register
def _clean() -> None:
    release(0)


def fresh(name: str, *taken: str) -> str:
    """name, or as many underscores before it as tell it from all columns that are there."""
    while name in taken:
        name = "_" + name
    return name


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """many joined with one, which has a row for each key at most; rows of a key are dealt out over SALTS tasks by ``by``.
    Both sides are shuffled: what is known of the size of a compressed table says little of that in memory."""
    salted = many.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    spread = one.withColumn("_salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)]))).hint("merge")
    return salted.join(spread, [*keys, "_salt"], how).drop("_salt")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over value, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ranked(df: DataFrame, key: str, out: str, rows: int, per_task: int = 500_000, keys: int = 8) -> DataFrame:
    """df with out: the row's place within its key, gapless from 0, in no task that holds a whole key.

    Rows of a key, equal ones too, are dealt to as many salts as keep a task near per_task rows; the salts' counts
    (keys x salts rows, so a bounded table) give each salt its first place. The salts are written with the rows, so that
    every reader sees the same. key has at most ``keys`` values.
    """
    salts = max(16, min(math.ceil(rows / per_task) * 4, 1_000_000 // max(1, keys)))
    salted = materialize(df.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int")))
    counts = salted.groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col(key).alias("_key"), F.col("_salt").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    place = Window.partitionBy(key, "_salt").orderBy(*df.columns)
    numbered = salted.withColumn("_row", F.row_number().over(place))
    joined = numbered.join(F.broadcast(first), (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_at")))
    return joined.withColumn(out, (F.col("_first") + F.col("_row") - 1).cast("long")).drop("_salt", "_row", "_key", "_at", "_first")
