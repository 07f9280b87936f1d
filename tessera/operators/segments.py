"""An inverted index in immutable segments, whose postings stand in blocks with bounds.

A segment holds postings of single words in blocks of up to BLOCK documents in order of id. A block's header tells its best
document: the highest score, and of those the smallest id. The k best documents of a word are in the k blocks whose headers
are best, as each of these has a document as good as its header; so a search reads headers, keeps blocks that can still hold
one of a query's k best, and reads the postings of those alone.

A change makes a new segment of what has changed, and marks: from that segment on, what older ones say of these ids is void.
A header whose document is void is still a bound, but it vouches for none. Segments of like size are merged when there are
many of them, and marks that no older segment needs are dropped.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.operators import keyword
from tessera.plans import stored

#: Documents of a block; segments of one size that are merged, and by how much sizes differ from tier to tier.
BLOCK, TIER, FACTOR = 64, 4, 8
#: Postings of a task that makes blocks, on average.
PER_PART = 500_000

_HEADER = "segment int, lexeme string, resource_type string, block bigint, n int, best_score double, best_id {id}"
_POSTS = "segment int, lexeme string, resource_type string, block bigint, postings array<struct<id: {id}, score: double>>"
_BLOCKS = f"{_HEADER}, postings array<struct<id: {{id}}, score: double>>"


@dataclass(frozen=True)
class Segment:
    number: int
    documents: int
    path: str


class SegmentIndex:
    """headers, postings and marks of the live segments below a folder. Only active resources are in it."""

    def __init__(self, spark: SparkSession, home: str, id_type: str = "bigint", segments: tuple[Segment, ...] = (), marks: tuple[str, ...] = ()):
        self.spark, self.home, self.id_type, self.segments, self.marks = spark, home.rstrip("/"), id_type, segments, marks

    # -- tables

    def _read(self, name: str, schema: str) -> DataFrame:
        paths = [f"{s.path}/{name}" for s in self.segments]
        schema = schema.format(id=self.id_type)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @property
    def headers(self) -> DataFrame:
        return self._read("headers", _HEADER)

    @property
    def postings(self) -> DataFrame:
        return self._read("blocks", _POSTS)

    @property
    def void(self) -> DataFrame:
        """(gone_id, since): what segments before ``since`` say of an id counts for nothing."""
        schema = f"gone_id {self.id_type}, since int"
        found = self.spark.read.schema(schema).parquet(*self.marks) if self.marks else self.spark.createDataFrame([], schema)
        return found.groupBy("gone_id").agg(F.max("since").alias("since"))

    def live(self) -> DataFrame:
        """segment, lexeme, resource_type, id and score of all postings that count."""
        flat = self.postings.select("segment", "lexeme", "resource_type", F.inline("postings"))
        return self._alive(flat, "id")

    def _alive(self, rows: DataFrame, column: str) -> DataFrame:
        if not self.marks:
            return rows
        gone = (F.col(column) == F.col("gone_id")) & (F.col("segment") < F.col("since"))
        return rows.join(self.void, gone, "left_anti")

    # -- writing

    def _written(self, number: int, rows: DataFrame, documents: int) -> Segment:
        """rows (lexeme, resource_type, id, score) as a segment. They are counted and dealt to ranges of about PER_PART; a
        task is sent a range in order and holds a batch of it and the last block that is not full."""
        path = f"{self.home}/segment={number}-{stored.folder(self.spark).rsplit('-', 1)[1]}"
        rows = rows.select("lexeme", "resource_type", "id", F.col("score").cast("double").alias("score"))
        rows.write.parquet(f"{path}/rows")  # ranges are made of a count, a sample and then of all: documents are analyzed once
        rows = self.spark.read.schema(rows.schema).parquet(f"{path}/rows")
        order = ["lexeme", "resource_type", "id"]
        dealt = rows.repartitionByRange(max(1, -(-rows.count() // PER_PART)), *order).sortWithinPartitions(*order)
        blocks = dealt.mapInArrow(_blocked(number, BLOCK), _BLOCKS.format(id=self.id_type))
        blocks.write.option("parquet.block.size", keyword.ROW_GROUP_BYTES).parquet(f"{path}/blocks")
        held = self.spark.read.schema(blocks.schema).parquet(f"{path}/blocks")
        held.drop("postings").write.parquet(f"{path}/headers")
        return Segment(number, documents, path)

    def _with(self, rows: DataFrame, documents: int, gone: DataFrame | None) -> SegmentIndex:
        number = max((s.number for s in self.segments), default=-1) + 1
        marks = self.marks
        if gone is not None:
            path = f"{self.home}/marks={number}-{stored.folder(self.spark).rsplit('-', 1)[1]}"
            gone.select(F.col("id").alias("gone_id"), F.lit(number).alias("since")).write.parquet(path)
            marks = (*marks, path)
        return SegmentIndex(self.spark, self.home, self.id_type, (*self.segments, self._written(number, rows, documents)), marks)

    @classmethod
    def of(cls, resources: DataFrame, home: str | None = None, analyze: Callable[[Column], Column] = tokens) -> SegmentIndex:
        """The index of active resources, in one segment."""
        spark = resources.sparkSession
        empty = cls(spark, home or stored.folder(spark), dict(resources.dtypes)["id"])
        return empty._with(scored(resources, analyze), keyword.active(resources).count(), None)

    def refreshed(self, changes: DataFrame, resources: DataFrame, analyze: Callable[[Column], Column] = tokens) -> SegmentIndex:
        """The index after changes (id, change), as a change feed tells them: only the resources that were inserted or
        updated are analyzed and written, and older segments stay as they are."""
        changes = changes.select("id", "change")
        new = resources.join(changes.where("change <> 'gone'").select("id"), "id", "left_semi")
        void = changes.where("change <> 'inserted'").select("id")
        return self._with(scored(new, analyze), keyword.active(new).count(), void).compacted()

    def compacted(self) -> SegmentIndex:
        """With segments of a tier merged once there are TIER of them. Merged are neighbours in time only, so that marks mean
        what they did."""
        tier = lambda s: int(math.log(max(1, s.documents), FACTOR))
        run: list[Segment] = []
        for s in reversed(self.segments):
            if run and tier(s) > tier(run[-1]):
                break
            run.insert(0, s)
        return self.merged(run) if len(run) >= TIER else self

    def merged(self, run: list[Segment] | tuple[Segment, ...] | None = None) -> SegmentIndex:
        """With a run of the last segments (all, if none is named) made one, without what is void."""
        run = list(run if run is not None else self.segments)
        rest = tuple(s for s in self.segments if s not in run)
        rows = self.live().where(F.col("segment").isin([s.number for s in run]))
        number = max(s.number for s in run)
        one = self._written(number, rows, sum(s.documents for s in run))
        # without older segments no mark is needed
        return SegmentIndex(self.spark, self.home, self.id_type, (*rest, one), self.marks if rest else ())

    def stored(self) -> SegmentIndex:
        """Names the live segments in the folder, for read()."""
        told = json.dumps({"id": self.id_type, "segments": [vars(s) for s in self.segments], "marks": list(self.marks)})
        self.spark.createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.home}/live")
        return self

    @classmethod
    def read(cls, spark: SparkSession, home: str) -> SegmentIndex:
        told = json.loads(spark.read.text(f"{home.rstrip('/')}/live").first()[0])
        return cls(spark, home, told["id"], tuple(Segment(**s) for s in told["segments"]), tuple(told["marks"]))

    # -- search

    def chosen(self, words: DataFrame, k: int, resource_type: str | None = None) -> DataFrame:
        """query_id, segment, lexeme, resource_type and block of the blocks that may hold one of the k best documents of
        queries (query_id, lexeme) whose score is that of their best word."""
        asked = words.select("query_id", "lexeme").distinct()
        headers = keyword._asked(self.headers, asked)
        headers = headers if resource_type is None else headers.where(F.col("resource_type") == resource_type)
        rounded = headers.withColumn("best_score", F.round("best_score", 6))
        if self.marks:
            void = self.void
            rounded = rounded.join(void, F.col("best_id") == F.col("gone_id"), "left").withColumn("vouches", ~F.coalesce(F.col("segment") < F.col("since"), F.lit(False))).drop("gone_id", "since")
        else:
            rounded = rounded.withColumn("vouches", F.lit(True))
        # the k-th best document that headers vouch for bounds a word's k best from below, and a query's by its best word
        order = Window.partitionBy("lexeme").orderBy(F.desc("best_score"), "best_id")
        kth = rounded.where("vouches").withColumn("_k", F.row_number().over(order)).where(F.col("_k") == k).select("lexeme", F.col("best_score").alias("least_score"), F.col("best_id").alias("last_id"))
        met = asked.join(kth, "lexeme")
        best = met.groupBy("query_id").agg(F.max("least_score").alias("least_score"))
        bound = best.join(met.groupBy("query_id", "least_score").agg(F.min("last_id").alias("last_id")), ["query_id", "least_score"])
        rows = asked.join(rounded, "lexeme").join(bound, "query_id", "left")
        better = F.col("least_score").isNull() | (F.col("best_score") > F.col("least_score")) | ((F.col("best_score") == F.col("least_score")) & (F.col("best_id") <= F.col("last_id")))
        return rows.where(better).select("query_id", "segment", "lexeme", "resource_type", "block")

    def best_of_any(self, words: DataFrame, k: int, resource_type: str | None = None) -> DataFrame:
        """query_id, id, score and rank of the k best resources for any of the words (query_id, lexeme) of each query."""
        blocks = self.chosen(words, k, resource_type)
        key = ["segment", "lexeme", "resource_type", "block"]
        read = keyword._asked(self.postings, words).join(blocks, key).select("query_id", "segment", F.inline("postings"))
        alive = self._alive(read, "id").select("query_id", "id", F.round("score", 6).alias("score"))
        return keyword.top_k(alive.groupBy("query_id", "id").agg(F.max("score").alias("score")), k)


def _blocked(number: int, size: int):
    """Rows (lexeme, resource_type, id, score) in this order as the blocks of a segment. A word may go on in the next batch,
    and in the next task; a block's number tells its task and its place among the word's blocks there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = TaskContext.get().partitionId() << 32
        rest, before = None, 0  # the last block of the batches so far, and its word's rows before it
        for b in batches:
            if not len(b):
                continue
            rows = b if rest is None else pa.concat_batches([rest, b])
            at = _places(rows, before)
            last = int(np.flatnonzero(at % size == 0)[-1])
            if last:
                yield _of_rows(number, above, rows.slice(0, last), at[:last], size)
            rest, before = rows.slice(last), int(at[last])
        if rest is not None:
            yield _of_rows(number, above, rest, _places(rest, before), size)

    return run


def _places(rows: pa.RecordBatch, before: int) -> np.ndarray:
    """The place of each row among those of its word, of which the first word's have so many before them."""
    new = np.ones(len(rows), bool)
    new[1:] = False
    for name in ("lexeme", "resource_type"):
        code = rows.column(name).dictionary_encode().indices.fill_null(-1).to_numpy()
        new[1:] |= code[1:] != code[:-1]
    i = np.arange(len(rows))
    first = np.maximum.accumulate(np.where(new, i, 0))
    return i - first + np.where(first == 0, before, 0)


def _of_rows(number: int, above: int, rows: pa.RecordBatch, at: np.ndarray, size: int) -> pa.RecordBatch:
    """Whole blocks as rows of _BLOCKS."""
    first = np.flatnonzero(at % size == 0)
    n = np.diff(np.append(first, len(rows)))
    score = rows.column("score").to_numpy(zero_copy_only=False)
    # ids ascend, so that of the highest scores the smallest id is the first
    highest = np.flatnonzero(score == np.repeat(np.maximum.reduceat(score, first), n))
    best = highest[np.searchsorted(highest, first)]
    of, best = pa.array(first), pa.array(best)
    own = pa.StructArray.from_arrays([rows.column("id"), rows.column("score")], ["id", "score"])
    postings = pa.ListArray.from_arrays(pa.array(np.append(first, len(rows)).astype(np.int32)), own)
    arrays = [pa.array(np.full(len(first), number, np.int32)), rows.column("lexeme").take(of), rows.column("resource_type").take(of), pa.array(above + at[first] // size), pa.array(n.astype(np.int32)), rows.column("score").take(best), rows.column("id").take(best), postings]
    return pa.RecordBatch.from_arrays(arrays, ["segment", "lexeme", "resource_type", "block", "n", "best_score", "best_id", "postings"])


def scored(resources: DataFrame, analyze: Callable[[Column], Column] = tokens) -> DataFrame:
    """lexeme, resource_type, id and score of the active resources."""
    return keyword.postings(keyword.active(resources), analyze).select("lexeme", "resource_type", "id", "score")


# -- change capture -------------------------------------------------------------------------------------------------

CONTENT = ("title", "subtitle", "tags", "description", "resource_type", "status")


def snapshot(resources: DataFrame, columns: tuple[str, ...] = CONTENT) -> DataFrame:
    """id and digest, which tells two contents apart; null and empty, and one list and another, are different."""
    told = F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"})
    return resources.select("id", F.sha2(told, 256).alias("digest"))


def change_feed(before: DataFrame, after: DataFrame) -> DataFrame:
    """id and change (inserted, updated, gone) from one snapshot() to another."""
    old, new = before.select("id", F.col("digest").alias("_old")), after.select("id", F.col("digest").alias("_new"))
    change = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "gone").when(F.col("_old") != F.col("_new"), "updated")
    return old.join(new, "id", "full_outer").select("id", change.alias("change")).where("change IS NOT NULL")
