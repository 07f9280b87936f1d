"""Tables that are made once and kept in the shared folder while what they are made of stays as it is."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Hashable

from pyspark.sql import SparkSession

_held: dict[tuple, tuple[list, str]] = {}


def folder(spark: SparkSession) -> str:
    """A new name in the folder that all executors share; one is made up only where none is set and all run here."""
    home = spark.conf.get("spark.checkpoint.dir", None)
    if not home:
        context = spark.sparkContext
        held = context._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
            held = context._jsc.sc().getCheckpointDir()
        home = held.get()
    return f"{home}/stored-{uuid.uuid4().hex}"


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """The files below a path, with their sizes and times, as Hadoop tells them."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    found, out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True), []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def once(spark: SparkSession, name: Hashable, sources: list[str], make: Callable[[str], object], read: Callable[[str], object]) -> object:
    """What make() has written from the sources; made anew if their files have changed, and once a session."""
    key = (spark.sparkContext.applicationId, name)
    now = [listing(spark, s) for s in sources]
    if key in _held and _held[key][0] == now:
        return read(_held[key][1])
    path = folder(spark)
    out = make(path)
    _held[key] = (now, path)
    return out
