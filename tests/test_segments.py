"""Segments with block bounds against the plain index; changes from snapshots."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import keyword, segments

SCHEMA = "id long, title string, subtitle string, tags array<string>, description string, status string, resource_type string"
WORDS = ["wind", "solar", "data", "power", "sea", "rare", "often", "grid"]


def made(spark, n, seed=1):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        text = lambda m: " ".join(r.choices(WORDS, weights=[9, 7, 5, 5, 3, 0.2, 30, 2], k=r.randint(0, m)))
        rows.append((k, text(4), text(3) or None, ["often", r.choice(WORDS)], text(12), "active" if r.random() < 0.9 else "deleted", r.choice(["dataset", "notebook"])))
    return spark.createDataFrame(rows, SCHEMA)


def asked(spark):
    rows = [(1, "wind"), (2, "often"), (3, "rare"), (3, "often"), (4, "none"), (5, "data"), (5, "sea"), (5, "grid")]
    return spark.createDataFrame(rows, "query_id long, lexeme string")


def told(df):
    return sorted((r.query_id, r.rank, r.id, r.score) for r in df.collect())


def plain(resources, words, k, kind=None):
    return told(keyword.best_of_any(keyword.Index.of(resources), words, k, kind))


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 8)


def test_blocks_are_passed_by(spark):
    docs, words = made(spark, 600), asked(spark)
    index = segments.SegmentIndex.of(docs)
    for k, kind in ((5, None), (3, "dataset"), (1000, None)):
        assert told(index.best_of_any(words, k, kind)) == plain(docs, words, k, kind)
    of_words = words.select("lexeme").distinct()
    every = index.headers.join(of_words, "lexeme").count()
    read = index.chosen(words, 5).select("segment", "lexeme", "resource_type", "block").distinct().count()
    assert read < every / 2
    assert index.headers.agg(F.max("n")).first()[0] == 8


def test_refreshes_and_merges(spark, tmp_path, monkeypatch):
    """Changes go to segments of their own, old segments stay as they are, and results are those of an index made anew."""
    monkeypatch.setattr(segments, "TIER", 3)
    now, words = made(spark, 300), asked(spark)
    index = segments.SegmentIndex.of(now, str(tmp_path))
    first = index.segments[0]
    for step in range(1, 5):
        later = now.where(F.col("id") % 11 != step).withColumn("title", F.when(F.col("id") % 13 == step, F.lit("rare often often")).otherwise(F.col("title")))
        more = made(spark, 40, step).withColumn("id", F.col("id") + 1000 * step)
        later = spark.createDataFrame(later.unionByName(more).collect(), SCHEMA)
        feed = segments.change_feed(segments.snapshot(now), segments.snapshot(later))
        index, now = index.refreshed(feed, later), later
        assert told(index.best_of_any(words, 7)) == plain(now, words, 7)
    assert first in index.segments and 2 <= len(index.segments) < 4
    again = segments.SegmentIndex.read(spark, index.stored().home)
    assert told(again.best_of_any(words, 4, "notebook")) == plain(now, words, 4, "notebook")
    one = again.merged()
    assert len(one.segments) == 1 and not one.marks and told(one.best_of_any(words, 7)) == plain(now, words, 7)
    live = {(r.lexeme, r.id, round(r.score, 6)) for r in one.live().collect()}
    assert live == {(r.lexeme, r.id, round(r.score, 6)) for r in keyword.Index.of(now).among().collect()}


def test_a_void_best_document_vouches_for_none(spark):
    """The best of each block is deleted: what was second comes up."""
    rows = [(k, "wind " * (3 if k % 8 == 0 else 1), None, None, None, "active", "dataset") for k in range(64)]
    docs = spark.createDataFrame(rows, SCHEMA)
    index = segments.SegmentIndex.of(docs)
    later = docs.where("id % 8 > 0")
    index = index.refreshed(segments.change_feed(segments.snapshot(docs), segments.snapshot(later)), later)
    words = spark.createDataFrame([(1, "wind")], "query_id long, lexeme string")
    assert [r[2] for r in told(index.best_of_any(words, 9))] == [1, 2, 3, 4, 5, 6, 7, 9, 10]


def test_change_feed(spark):
    base = made(spark, 6)
    changed = base.where("id <> 0").withColumn("tags", F.when(F.col("id") == 1, F.array(F.lit("x"))).otherwise(F.col("tags"))).withColumn("subtitle", F.when(F.col("id") == 2, "").when(F.col("id") == 3, F.col("subtitle")).otherwise(F.col("subtitle")))
    after = spark.createDataFrame(changed.collect() + [(9, "t", None, None, None, "active", "dataset")], SCHEMA)
    feed = {(r.id, r.change) for r in segments.change_feed(segments.snapshot(base), segments.snapshot(after)).collect()}
    assert feed == {(0, "gone"), (1, "updated"), (2, "updated"), (9, "inserted")}


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    index = segments.SegmentIndex.of(docs)
    assert index.best_of_any(asked(spark), 3).count() == 0
    full = made(spark, 30)
    index = index.refreshed(segments.change_feed(segments.snapshot(docs), segments.snapshot(full)), full)
    assert told(index.best_of_any(asked(spark), 3)) == plain(full, asked(spark), 3)


def test_documents_are_analyzed_once(spark):
    """Sorting a segment reads its rows twice, but not the documents."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        seen.add(1)
        return text

    rows = [(k, f"a w{k}", "", "b", ["c"], "dataset", "active") for k in range(40)]
    docs = spark.createDataFrame(rows, "id long, title string, subtitle string, description string, tags array<string>, resource_type string, status string")
    index = segments.SegmentIndex.of(docs, analyze=lambda text: F.split(told(text), " "))
    assert len(index.segments) == 1
    assert seen.value == 4 * 40


def test_tasks_that_make_blocks_are_as_many_as_postings_need(spark, monkeypatch):
    """A segment's ranges follow its postings and not a setting; words go on from batch to batch and from task to task."""
    monkeypatch.setattr(segments, "PER_PART", 250, raising=False)
    docs, words = made(spark, 600), asked(spark)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        index = segments.SegmentIndex.of(docs)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    (segment,) = index.segments
    total = index.live().count()
    tasks = {r[0] for r in spark.read.parquet(f"{segment.path}/blocks").select(F.input_file_name()).distinct().collect()}
    assert len(tasks) >= total / 500 > 4
    assert told(index.best_of_any(words, 5)) == plain(docs, words, 5)
    # of a word's blocks in a task only the last may have room
    blocks = spark.read.parquet(f"{segment.path}/blocks").withColumn("_file", F.input_file_name())
    for own in blocks.groupBy("_file", "lexeme", "resource_type").agg(F.sort_array(F.collect_list(F.struct("block", "n", "best_score", "best_id", "postings"))).alias("b")).collect():
        assert all(b.n == 8 for b in own.b[:-1])
        ids = [p.id for b in own.b for p in b.postings]
        assert ids == sorted(ids) and all(b.n == len(b.postings) for b in own.b)
        assert all((b.best_score, -b.best_id) == max((p.score, -p.id) for p in b.postings) for b in own.b)
    assert blocks.groupBy("lexeme", "resource_type", "block").count().where("count > 1").isEmpty()
