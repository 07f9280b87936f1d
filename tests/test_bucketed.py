"""Tables updated by key: commits, conflicts, constraints, old versions."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import sync
from tessera.sources import bucketed

SCHEMA = "k long, v string, at timestamp_ntz, tags array<string>"


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "k long, v string").withColumns({"at": F.lit("2024-01-02 03:04:05.678901").cast("timestamp_ntz"), "tags": F.array(F.lit("x"), F.lit(None).cast("string"))})


def over(old, new):
    return old.join(new.select("k"), "k", "left_anti").select(new.columns).unionByName(new)


def told(df):
    return sorted((r.k, r.v) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    return bucketed.BucketTable(spark, f"{tmp_path}/t", SCHEMA, ["k"], {"v_known": "v IN ('a', 'b', 'c')"}, ("v",), buckets=16)


def test_updates_rewrite_their_buckets_only(spark, table):
    assert table.read().count() == 0 and table.versions() == []
    first = table.replace(rows(spark, [(k, "a") for k in range(1000)]))
    assert sum(n for f in first.files.values() for _, n in f) == 1000 and len(first.files) == 16
    second = table.upsert(rows(spark, [(7, "b"), (5000, "c")]), over)
    changed = {b for b in second.files if second.files[b] != first.files.get(b)}
    assert len(changed) <= 2
    assert told(table.read()) == sorted([(k, "b" if k == 7 else "a") for k in range(1000)] + [(5000, "c")])
    r = table.read().where("k = 7").first()
    assert (str(r.at), r.tags) == ("2024-01-02 03:04:05.678901", ["x", None])
    third = table.delete(rows(spark, [(5000, ""), (8, "")]))
    assert third.version == 2 and table.read().count() == 999
    # a bucket that is left empty has no file
    assert table.delete(rows(spark, [(k, "") for k in range(1000)])).files == {}


def test_old_versions_and_expiry(spark, table, tmp_path):
    for v in "abc":
        table.replace(rows(spark, [(1, v), (2, v)]))
    assert [told(table.read(v))[0][1] for v in table.versions()] == ["a", "b", "c"]
    before = len([*(tmp_path / "t" / "data").glob("*.parquet")])
    assert table.expire(keep=2) == [0] and table.versions() == [1, 2]
    assert len([*(tmp_path / "t" / "data").glob("*.parquet")]) < before and told(table.read(1))[0][1] == "b"
    assert table.expire() == [1] and told(table.read()) == [(1, "c"), (2, "c")] and table.replace(rows(spark, [(3, "a")])).version == 3
    # other numbers of buckets
    assert table.replace(rows(spark, [(k, "a") for k in range(100)]), buckets=4).buckets == 4 and table.upsert(rows(spark, [(1, "b")]), over).buckets == 4
    assert told(table.read())[:2] == [(0, "a"), (1, "b")]


def test_a_failed_task_leaves_the_version_before(spark, table, tmp_path):
    table.replace(rows(spark, [(k, "a") for k in range(50)]))
    files = sorted((tmp_path / "t" / "data").iterdir())
    with pytest.raises(Exception, match="v_known"):
        table.upsert(rows(spark, [(k, "b" if k < 40 else "z") for k in range(50)]), over)
    assert table.versions() == [0] and told(table.read()) == [(k, "a") for k in range(50)]
    left = {f.name for f in (tmp_path / "t" / "data").iterdir() if f.suffix == ".parquet"} - {f.name for f in files}
    assert not left


def test_one_of_two_writers(spark, table):
    table.replace(rows(spark, [(1, "a")]))
    seen = table.manifest()
    table.upsert(rows(spark, [(1, "b")]), over)
    with pytest.raises(bucketed.Conflict):
        table.upsert(rows(spark, [(1, "c")]), over, base=seen)
    assert told(table.read()) == [(1, "b")]
    # while a rebuild is under way, readers have what was there

    def slow(old, new):
        assert told(table.read()) == [(1, "b")]
        return new

    table.upsert(rows(spark, [(1, "c")]), slow)
    assert told(table.read()) == [(1, "c")]


def test_unfinished_manifest(spark, table, tmp_path):
    table.replace(rows(spark, [(1, "a")]))
    (tmp_path / "t" / "manifests" / "1.json").write_text('{"buckets": 16, "fi')
    assert told(table.read()) == [(1, "a")]


def test_rejects(spark, table):
    bad = [(1, "a"), (1, "b"), (2, None), (3, "z"), (4, "c"), (None, "a"), (None, "b")]
    done = table.upsert(rows(spark, bad), lambda old, new: new, rejects=True)
    assert sum(n for f in done.files.values() for _, n in f) == 3
    found = [(r.k, sorted(r._broken)) for r in table.rejects().collect()]
    assert sorted(found, key=str) == [(1, ["k_unique"]), (2, ["v_not_null"]), (3, ["v_known"]), (None, ["k_unique"])]
    with pytest.raises(Exception, match="k_unique"):
        table.replace(rows(spark, [(1, "a"), (1, "a")]))


def test_lookup(spark, table):
    table.replace(rows(spark, [(k, "a") for k in range(300)]))
    wanted = spark.createDataFrame([(5,), (6,), (999,)], "k long")
    found = table.lookup(wanted)
    assert told(found) == [(5, "a"), (6, "a")] and len(found.inputFiles()) <= 3
    assert table.get(5)["v"] == "a"
    with pytest.raises(LookupError):
        table.get(1000)


def test_resources(spark, tmp_path):
    schema = "id string, source string, source_id string, resource_type string, status string, indexed_at string, last_synced_at string, title string"
    t = bucketed.BucketTable(spark, f"{tmp_path}/r", schema, ["source", "source_id"])
    for now, data in (("t1", [("a", "A"), ("b", "B")]), ("t2", [("b", "B2"), ("c", "C")])):
        new = spark.createDataFrame([("cat", *d) for d in data], "source string, source_id string, title string")
        t.upsert(new, lambda old, u: sync.upsert_resources(old, u, F.lit(now)))  # noqa: B023
    got = {r.source_id: (r.title, r.indexed_at, r.last_synced_at) for r in t.read().collect()}
    assert got == {"a": ("A", "t1", "t1"), "b": ("B2", "t1", "t2"), "c": ("C", "t2", "t2")}
