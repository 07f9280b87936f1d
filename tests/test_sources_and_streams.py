import email.utils
import json
import urllib.error
from datetime import UTC, datetime, timedelta

import pytest

from tessera import cli
from tessera.sources import catalog
from tessera.streaming.sync_stream import records_table, sync_stream


def test_pages(spark, tmp_path):
    full = [{"ref": f"o/r{k}", "title": "T", "tags": [{"ref": "nlp"}, {"name": "x"}, "plain", {}], "lastUpdated": "2024-01-02T03:04:05Z", "voteCount": 0, "votes": 9, "totalBytes": "7", "licenses": [{"name": "CC0"}]} for k in range(20)]
    short = [{"id": 5, "title": "U", "keywords": ["k"], "creatorName": " me ", "isPrivate": True, "usabilityRating": 0.5}]
    folder = tmp_path / catalog.folder_name("tag:nlp", "updated")
    folder.mkdir()
    for k, page in enumerate([full, short, full], 1):
        (folder / f"{k}.json").write_text(json.dumps(page))
    spark.dataSource.register(catalog.CatalogPages)
    pages = spark.read.format("catalog_pages").option("path", str(tmp_path)).option("source", "tag:nlp").load()
    rows = {(r.page, r.seq.position): r for r in catalog.records(pages).collect()}
    assert len(rows) == 21  # a short page ends the pass
    a, b = rows[1, 0], rows[2, 0]
    assert (a.ref, a.url, a.tags, str(a.last_updated), a.votes, a.size_bytes, a.license) == ("o/r0", "https://catalog.example/datasets/o/r0", ["nlp", "x", "plain"], "2024-01-02 03:04:05", 0, 7, "CC0")
    assert (b.ref, b.catalog_id, b.tags, b.author, b.is_private, b.usability_rating, b.last_updated) == ("5", 5, ["k"], "me", True, 0.5, None)


def client(answers, **config):
    waits, seen = [], iter(answers)

    def transport(url, timeout, token):
        x = next(seen)
        if isinstance(x, Exception):
            raise x
        return catalog.Response(x, 200, 1)

    return catalog.Client("http://c", catalog.Config(request_delay_seconds=0, **config), transport, sleep=waits.append, jitter=lambda: 0.0), waits


def http(code, after=None):
    return urllib.error.HTTPError("u", code, "m", {"Retry-After": after} if after else {}, None)


def test_retries():
    c, waits = client([http(429), http(503, "7"), TimeoutError(), [1]])
    assert c.page("query:data science", "updated", 1)[::2] == ([1], 3) and [w for w in waits if w] == [180.0, 7.0, 8.0]
    c, _ = client([http(500)] * 2, retry_max_attempts=2)
    with pytest.raises(catalog.TransientError) as e:
        c.page("tag:nlp", "updated", 1)
    assert (e.value.http_status, e.value.retry_count) == (500, 1)
    c, _ = client([http(404)])
    with pytest.raises(urllib.error.HTTPError):
        c.detail("a/b")
    c, _ = client([{}, []])
    with pytest.raises(ValueError):
        c.page("tag:nlp", "updated", 1)
    with pytest.raises(ValueError):
        c.detail("a/b")


def test_wanted_delay():
    soon = email.utils.format_datetime(datetime.now(UTC) + timedelta(seconds=60))
    assert 50 < catalog.wanted_delay(soon) <= 60 and catalog.wanted_delay("-3") == 0 and catalog.wanted_delay("x") is None is catalog.wanted_delay(None)


def test_config(monkeypatch):
    monkeypatch.setenv("CATALOG_SYNC_RETRY_MAX_ATTEMPTS", "0")
    with pytest.raises(ValueError):
        catalog.Config.from_env()


FIELDS = [("title", "string"), ("url", "string"), ("last_updated", "bigint")]
ROW = "ref string, seq int, title string, url string, last_updated long, is_private boolean"


def test_stream_folds_late_rows(spark, tmp_path):
    def put(name, rows):
        spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    target = records_table(spark, str(tmp_path / "out"), FIELDS)
    for rows in ([("a", 1, "old", "u", 5, False), ("b", 2, "B", "u", 1, False)], [("a", 3, "late", "u2", 4, False), ("c", 4, "", "u", 1, False)], [("a", 5, "new", "u", 6, False)]):
        put("x", rows)
        stream = spark.readStream.schema(ROW).parquet(str(tmp_path / "in"))
        sync_stream(stream, target, str(tmp_path / "state"), FIELDS).awaitTermination()
    got = {r.ref: tuple(r.record) for r in target.read().collect()}
    assert got == {"a": ("new", "u", 6), "b": ("B", "u", 1)}
    again = target.versions()
    assert len(again) == 3
    sync_stream(spark.readStream.schema(ROW).parquet(str(tmp_path / "in")), target, str(tmp_path / "state"), FIELDS).awaitTermination()
    assert target.versions() == again


def test_cli(spark, tmp_path, capsys):
    docs = spark.createDataFrame([(1, "solar", None, "x", ["a"], "dataset", "active"), (2, "wind", None, "solar", ["a"], "dataset", "active")], "id long, title string, subtitle string, description string, tags array<string>, resource_type string, status string")
    docs.write.parquet(str(tmp_path / "r"))
    spark.createDataFrame([], "resource_id long, content_hash string, embedding array<float>, model_name string, model_revision string, embedding_dimension int").write.parquet(str(tmp_path / "e0"))
    assert cli.main(["backfill", "--resources", f"{tmp_path}/r", "--embeddings", f"{tmp_path}/e0", "--output", f"{tmp_path}/e1"]) == 0
    assert spark.read.parquet(f"{tmp_path}/e1").count() == 2
    assert {k: v for k, v in json.loads(capsys.readouterr().out).items() if k != "average_ms"} == {"total": 2, "embedded": 2, "skipped": 0}
    cli.main(["search-hybrid", "--resources", f"{tmp_path}/r", "--embeddings", f"{tmp_path}/e1", "--lexical-query", "solar", "--semantic-query", "wind solar", "--limit", "2"])
    assert [json.loads(x)["id"] for x in capsys.readouterr().out.splitlines()][:2] in ([1, 2], [2, 1])
    with pytest.raises(SystemExit):
        cli.main(["search-keyword", "--resources", f"{tmp_path}/r", "--query", "--", "--limit", "5"])
