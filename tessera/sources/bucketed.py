"""Tables that are updated by key: hash-bucketed Parquet files and manifests that say which of them a version has.

An update reads and rewrites the buckets of its own keys only. Its files are written by a data source of this module, whose
tasks each tell what they wrote; only when all are done, a manifest with the next number is created, which succeeds for one
writer only. Until then, and if a task fails, readers have the version before. Old versions can be read until they expire.

Constraints are checked as rows are written, in the same pass: a bad row either fails the write, or goes to the version's
rejects with the names of the constraints that it breaks. A constraint that is null for a row holds, as in SQL.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tessera.sources.catalog import located

BUCKETS = 64
_BUCKET, _BROKEN = "_bucket", "_broken"


class Conflict(RuntimeError):
    """Another writer has made the next version."""


class Broken(ValueError):
    """Rows break constraints of the table."""


@dataclass
class Written(WriterCommitMessage):
    """(bucket, file, rows) of a task; rejected rows have bucket -1."""

    files: list[tuple[int, str, int]]


class BucketWriter(DataSourceArrowWriter):
    """Rows sorted by _bucket as a file for each bucket. The files count for nothing until a manifest names them."""

    def __init__(self, options: dict):
        self.path, self.pending, self.strict = options["path"], options["pending"], options.get("rejects") != "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, home = FileSystem.from_uri(located(self.path))
        files.create_dir(f"{home}/data", recursive=True)
        done: list[tuple[int, str, int]] = []
        open_: dict[int, list] = {}

        def put(bucket: int, part: pa.Table) -> None:
            if bucket not in open_:
                if bucket >= 0:  # sorted: the bucket before has ended
                    close([b for b in open_ if b >= 0])
                name = f"{bucket}-{uuid.uuid4().hex}.parquet"
                open_[bucket] = [pq.ParquetWriter(f"{home}/data/{name}", part.schema, filesystem=files, compression="zstd"), name, 0]
            open_[bucket][0].write_table(part)
            open_[bucket][2] += len(part)

        def close(buckets: list[int]) -> None:
            for b in buckets:
                writer, name, rows = open_.pop(b)
                writer.close()
                done.append((b, name, rows))

        try:
            for batch in iterator:
                t = pa.Table.from_batches([batch])
                bad = pc.greater(pc.list_value_length(t.column(_BROKEN)), 0).to_numpy()
                if bad.any():
                    if self.strict:
                        names = sorted({n for x in t.column(_BROKEN).to_pylist() for n in x or ()})
                        raise Broken(f"rows break {', '.join(names)}")
                    put(-1, t.filter(pa.array(bad)).drop_columns([_BUCKET]))
                    t = t.filter(pa.array(~bad))
                of = t.column(_BUCKET).to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)] if len(of) else [0]
                for low, high in zip(edges, edges[1:], strict=False):
                    put(int(of[low]), t.slice(low, high - low).drop_columns([_BUCKET, _BROKEN]))
            close(list(open_))
        except BaseException:
            for writer, *_ in open_.values():
                writer.close()
            for name in [n for _, n, _ in done] + [o[1] for o in open_.values()]:
                files.delete_file(f"{home}/data/{name}")
            raise
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        """What all tasks wrote, for the one who makes the manifest."""
        files, path = FileSystem.from_uri(located(self.pending))
        with files.open_output_stream(path) as f:
            f.write(json.dumps([w for m in messages if m for w in m.files]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        files, home = FileSystem.from_uri(located(self.path))
        for name in [w[1] for m in messages if m for w in m.files]:
            files.delete_file(f"{home}/data/{name}")


class BucketFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bucket_files"

    def writer(self, schema, overwrite: bool) -> BucketWriter:
        return BucketWriter(self.options)


@dataclass(frozen=True)
class Manifest:
    """files: (name, rows) of each bucket; rejects: those of rows that broke constraints; tag: what the writer called it."""

    version: int
    buckets: int
    files: dict[int, list[tuple[str, int]]]
    rejects: list[tuple[str, int]]
    tag: str | None = None

    @property
    def names(self) -> list[str]:
        return [n for found in (*self.files.values(), self.rejects) for n, _ in found]


class BucketTable:
    """A table in a folder, with a key and constraints: a name and a condition in SQL for each, columns that cannot be null,
    and the key, which is unique unless it is said not to be."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], constraints: dict[str, str] | None = None, required: tuple[str, ...] = (), unique: bool = True, buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets, self.unique = spark, path.rstrip("/"), keys, buckets, unique
        self.schema = spark.createDataFrame([], schema).schema
        self.constraints = (constraints or {}) | {f"{c}_not_null": f"{c} IS NOT NULL" for c in required}

    # -- manifests

    def _where(self, name: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        """The numbers of the versions that can be read, in order."""
        fs, where = self._where("manifests")
        names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> Manifest:
        """Of a version, or of the last; version -1 has nothing."""
        for v in [version] if version is not None else reversed(self.versions()):
            if v < 0:
                break
            text = "".join(r.value for r in self.spark.read.text(f"{self.path}/manifests/{v}.json", wholetext=True).collect())  # one row for each bucket
            try:
                m = json.loads(text)
            except ValueError:
                continue  # its writer did not end
            return Manifest(v, m["buckets"], {int(b): [tuple(f) for f in fs] for b, fs in m["files"].items()}, [tuple(f) for f in m["rejects"]], m["tag"])
        return Manifest(-1, self.buckets, {}, [])

    def _publish(self, base: Manifest, new: Manifest) -> None:
        """Creates the manifest; only one writer can."""
        fs, where = self._where(f"manifests/{new.version}.json")
        if max(self.versions(), default=-1) > base.version or fs.exists(where):
            raise Conflict(f"version {new.version} of {self.path} is there already")
        told = {"buckets": new.buckets, "files": new.files, "rejects": new.rejects, "tag": new.tag}
        try:
            out = fs.create(where, False)
        except Exception as e:
            raise Conflict(f"version {new.version} of {self.path} is there already") from e
        out.write(bytearray(json.dumps(told).encode()))
        out.close()

    # -- reading

    def _files(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{n}" for n in names])

    def read(self, version: int | None = None) -> DataFrame:
        return self._files([n for found in self.manifest(version).files.values() for n, _ in found])

    def rejects(self, version: int | None = None) -> DataFrame:
        """The rows that a version's writer left out, with _broken, the names of the constraints."""
        names = [n for n, _ in self.manifest(version).rejects]
        schema = self.spark.createDataFrame([], self.schema).withColumn(_BROKEN, F.array().cast("array<string>")).schema
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def touched(self, keys: DataFrame, base: Manifest) -> list[int]:
        """The buckets that hold the keys: at most as many numbers as there are buckets."""
        typed = keys.select(*[F.col(k).cast(self.schema[k].dataType).alias(k) for k in self.keys])
        return sorted(r[0] for r in typed.select(self._bucket(base.buckets)).distinct().collect())

    def lookup(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The rows of these keys, out of their buckets only."""
        base = self.manifest(version)
        rows = self._files([n for b in self.touched(keys, base) for n, _ in base.files.get(b, [])])
        return rows.join(keys.select(*self.keys).distinct(), self.keys, "left_semi")

    def get(self, *key) -> dict:
        """The one row of a key; LookupError if there is none."""
        one = self.spark.createDataFrame([key], ", ".join(f"{k} {self.schema[k].dataType.simpleString()}" for k in self.keys))
        found = self.lookup(one).limit(2).collect()
        if not found:
            raise LookupError(f"no row with {dict(zip(self.keys, key, strict=True))}")
        return found[0].asDict(recursive=True)

    # -- writing

    def checked(self, rows: DataFrame) -> DataFrame:
        """rows with _bucket and _broken, the names of the constraints that each breaks; of rows with an equal key, all
        but one break the key's."""
        broken = [F.when(~F.expr(f"coalesce(({condition}), true)"), F.lit(name)) for name, condition in self.constraints.items()]
        if self.unique:
            # rows of a bucket are in one task and sorted by key already: this needs no other shuffle
            own = F.struct(*self.keys)
            broken.append(F.when(F.lag(own).over(Window.partitionBy(_BUCKET).orderBy(*self.keys)).eqNullSafe(own), F.lit(f"{'_'.join(self.keys)}_unique")))
        return rows.withColumn(_BROKEN, F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>"))

    def _write(self, rows: DataFrame, base: Manifest, replaced: list[int], rejects: bool, tag: str | None) -> Manifest:
        self.spark.dataSource.register(BucketFiles)
        pending = f"{self.path}/pending/{uuid.uuid4().hex}.json"
        fs, folder = self._where("pending")
        fs.mkdirs(folder)
        typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        tasks = max(1, min(len(replaced), int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        dealt = typed.withColumn(_BUCKET, self._bucket(base.buckets)).repartition(tasks, _BUCKET)
        sorted_ = self.checked(dealt).sortWithinPartitions(_BUCKET, *self.keys)
        sorted_.write.format("bucket_files").mode("append").options(path=self.path, pending=pending, rejects=str(rejects).lower()).save()
        found = json.loads("".join(r.value for r in self.spark.read.text(pending, wholetext=True).collect()))
        _, where = self._where(f"pending/{pending.rsplit('/', 1)[1]}")
        fs.delete(where, False)
        files = {b: f for b, f in base.files.items() if b not in set(replaced)}
        for b, name, n in found:
            if b >= 0:
                files.setdefault(b, []).append((name, n))
        new = Manifest(base.version + 1, base.buckets, files, [(name, n) for b, name, n in found if b < 0], tag)
        try:
            self._publish(base, new)
        except Conflict:
            for _, name, _ in found:
                self._drop(name)
            raise
        return new

    def upsert(self, updates: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], rejects: bool = False, tag: str | None = None, base: Manifest | None = None) -> Manifest:
        """A new version in which merge(rows of the touched buckets, updates) stands in place of these buckets.

        base is the version that the caller has seen; if there is a later one by now, this is a Conflict. With rejects,
        bad rows are set aside and the rest is written, else they fail the write."""
        base = base or self.manifest()
        touched = self.touched(updates, base)
        old = self._files([n for b in touched for n, _ in base.files.get(b, [])])
        return self._write(merge(old, updates), base, touched, rejects, tag)

    def delete(self, keys: DataFrame, tag: str | None = None) -> Manifest:
        """A new version without the rows of these keys."""
        return self.upsert(keys, lambda old, gone: old.join(gone.select(*self.keys).distinct(), self.keys, "left_anti"), tag=tag)

    def replace(self, rows: DataFrame, rejects: bool = False, tag: str | None = None, buckets: int | None = None) -> Manifest:
        """A new version that has these rows only, dealt to another number of buckets if that is named. Readers have the
        version before until all is written."""
        base = self.manifest()
        whole = Manifest(base.version, buckets or base.buckets, {}, [])
        return self._write(rows, whole, list(range(whole.buckets)), rejects, tag)

    def _drop(self, name: str) -> None:
        fs, where = self._where(f"data/{name}")
        fs.delete(where, False)

    def expire(self, keep: int = 1) -> list[int]:
        """Removes all versions but the last ones, and the files that only they had."""
        every = self.versions()
        gone = every[: max(0, len(every) - max(1, keep))]
        needed = {n for v in every[len(gone) :] for n in self.manifest(v).names}
        for v in gone:
            old = self.manifest(v).names
            fs, where = self._where(f"manifests/{v}.json")
            fs.delete(where, False)  # first what names the files
            for n in set(old) - needed:
                self._drop(n)
        return gone
