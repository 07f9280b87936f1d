"""Pages as a stream: how far each pass is asked, against the rules over the whole table."""

import json
import threading
import time
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tessera.operators import sync, sync_run
from tessera.plans import adapters
from tessera.sources import catalog
from tessera.streaming import pages_stream
from tests.test_sync_run import item, put

CHECKPOINT = "source string, sort string, status string, watermark timestamp_ntz"
MARK = datetime(2024, 3, 1)


def full(page, day=None, tag="nlp", n=20):
    day = day or MARK + timedelta(days=1)
    return [item(f"o/p{page}r{k}", tag=tag, updated=day.isoformat() + "Z") for k in range(n)]


class Server(HTTPServer):
    """Serves endless pages of every pass, and remembers when each was asked for."""

    def __init__(self, page_of):
        self.asked, self.page_of = [], page_of
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                q = parse_qs(urlparse(self.path).query)
                source = f"tag:{q['tagids'][0]}" if "tagids" in q else f"query:{q['search'][0]}"
                key = (source, q["sortBy"][0], int(q["page"][0]))
                outer.asked.append((*key, time.monotonic()))
                got = outer.page_of(*key)
                self.send_response(got if isinstance(got, int) else 200)
                self.end_headers()
                self.wfile.write(b"" if isinstance(got, int) else json.dumps(got).encode())

            def log_message(self, *_):
                pass

        super().__init__(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.serve_forever, daemon=True).start()

    @property
    def url(self):
        return f"http://127.0.0.1:{self.server_port}"


@pytest.fixture
def quick(monkeypatch):
    monkeypatch.setenv("CATALOG_SYNC_REQUEST_DELAY_SECONDS", "0.05")
    monkeypatch.setenv("CATALOG_SYNC_BACKOFF_BASE_SECONDS", "0.05")
    monkeypatch.setenv("CATALOG_SYNC_RETRY_MAX_ATTEMPTS", "2")


def none(spark):
    return spark.createDataFrame([], sync_run.STATE), spark.createDataFrame([], CHECKPOINT)


def test_bootstrap_asks_up_to_its_limit(spark, quick):
    server = Server(lambda source, sort, page: full(page))
    states, marks = none(spark)
    pages = pages_stream.paged(spark, {"url": server.url, "source": "tag:nlp"}, "bootstrap", states, marks, page_limit=4)
    assert sorted(a[:3] for a in server.asked) == [("tag:nlp", sort, p) for sort in ("updated", "votes") for p in (1, 2, 3, 4)]
    got = {(r.sort, r.last_page, r.stop_reason, r.status, r.watermark) for r in pages_stream.stops(pages).collect()}
    assert got == {(s, 4, "configured_page_limit", "partial", MARK + timedelta(days=1)) for s in ("updated", "votes")}
    assert pages.count() == 160
    # one pace for all: no two requests closer than the delay
    times = sorted(a[3] for a in server.asked)
    assert min(b - a for a, b in zip(times, times[1:], strict=False)) >= 0.045
    server.shutdown()


def test_incremental_ends_at_two_stale_pages(spark, quick):
    days = {1: MARK + timedelta(days=2), 3: MARK + timedelta(hours=1)}
    server = Server(lambda source, sort, page: full(page, days.get(page, MARK - timedelta(days=page))))
    known = [(f"o/p{p}r{k}", MARK - timedelta(days=p), 1, False, None) for p in range(1, 9) for k in range(20)]
    states = spark.createDataFrame(known, sync_run.STATE)
    marks = spark.createDataFrame([("tag:nlp", "updated", "complete", MARK), ("tag:nlp", "updated", "partial", MARK + timedelta(days=9))], CHECKPOINT)
    pages = pages_stream.paged(spark, {"url": server.url, "source": "tag:nlp"}, "incremental", states, marks)
    assert [a[2] for a in server.asked] == [1, 2, 3, 4, 5]
    (end,) = pages_stream.stops(pages).collect()
    assert (end.last_page, end.stop_reason, end.status, end.watermark) == (5, "two_stale_pages", "complete", MARK + timedelta(days=2))
    assert [r.page for r in pages.where("stale").select("page").distinct().orderBy("page").collect()] == [2, 4, 5]
    server.shutdown()


def test_passes_end_by_themselves_and_as_over_the_whole_table(spark, quick):
    """Each source ends in its own way; the state agrees with the windows over the asked pages."""
    sources = sync.select_sources(None)[:6]
    how = {s: k % 5 for k, s in enumerate(sources)}

    def page_of(source, sort, page):
        own = full(page, tag=source.split(":")[1])
        if page < 1 + how[source] % 3:
            return own
        return {0: own[:7], 1: [], 2: 503, 3: full(page, tag="other") if source.startswith("tag:") else own[:1], 4: own[:19]}[how[source]]

    server = Server(page_of)
    states, marks = none(spark)
    pages = sync_run.kept(pages_stream.paged(spark, {"url": server.url, "source": ",".join(sources)}, "incremental", states, marks))
    rows, asked = catalog.records(pages), catalog.asked_pages(pages)
    plan = sync_run.planned(rows, asked, states, marks, "incremental")
    key = lambda df: sorted(map(str, df.select("source", "sort", "last_page", "stop_reason", "status", "watermark", "retryable").collect()))
    assert key(pages_stream.stops(pages)) == key(plan.stops.withColumn("last_page", F.col("last_page").cast("int")))
    assert len({r.stop_reason for r in plan.stops.collect()}) == 4 and plan.stops.count() == len(sources)
    last = {s: max(a[2] for a in server.asked if a[0] == s) for s in sources}
    assert last == {s: 1 + how[s] % 3 for s in sources}
    server.shutdown()


def test_a_run_that_broke_off_goes_on(spark, tmp_path, monkeypatch):
    put(tmp_path, "tag:nlp", [full(1), full(2), full(3), full(4)[:3], full(5)])
    states, marks = none(spark)
    options, work = {"path": str(tmp_path), "source": "tag:nlp"}, f"{tmp_path}/work"
    real = catalog.judged_pages
    calls = []

    def broken(folder):
        calls.append(folder)
        if len(calls) == 3:  # while the third page is judged, in the driver
            raise OSError("lost")
        return real(folder)

    monkeypatch.setattr(catalog, "judged_pages", broken)
    with pytest.raises(Exception, match="lost"):
        pages_stream.paged(spark, options, "incremental", states, marks, work)
    monkeypatch.setattr(catalog, "judged_pages", real)
    assert real(f"{work}/judged") == {"tag:nlp|updated": (2, False)}
    pages = pages_stream.paged(spark, options, "incremental", states, marks, work)
    assert {(r.page, r["count"]) for r in pages.groupBy("page").count().collect()} == {(1, 20), (2, 20), (3, 20), (4, 3)}
    assert [(r.last_page, r.stop_reason) for r in pages_stream.stops(pages).collect()] == [(4, "short_page")]


def test_missing_pages(spark, tmp_path):
    """A page without a file ends its pass; one that is missing before others could not be had."""
    put(tmp_path, "tag:nlp", [full(1), full(2)])
    states, marks = none(spark)
    end = pages_stream.stops(pages_stream.paged(spark, {"path": str(tmp_path), "source": "tag:nlp"}, "incremental", states, marks)).first()
    assert (end.last_page, end.stop_reason) == (3, "empty_page")
    (tmp_path / catalog.folder_name("tag:nlp", "updated") / "1.json").unlink()
    end = pages_stream.stops(pages_stream.paged(spark, {"path": str(tmp_path), "source": "tag:nlp"}, "incremental", states, marks)).first()
    assert (end.last_page, end.stop_reason, end.retryable) == (0, "transient_error", True)


def test_pages_are_put_row_by_row(spark, tmp_path, monkeypatch):
    """What a task is sent at once is a batch of rows, not of whole pages; pages that go over several batches are whole."""
    real = type(spark.range(1)).mapInArrow

    def spied(df, write, schema):
        def run(batches):
            def seen():
                for b in batches:
                    with open(f"{tmp_path}/batches", "a") as f:
                        f.write(f"{b.nbytes}\n")
                    yield b

            return write(seen())

        return real(df, run, schema)

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", spied)
    record = F.to_json(F.struct(F.col("id").alias("ref"), F.lit("é" * 50).alias("title")))
    page = (F.col("id") % 37 + 1).cast("int")
    rows = spark.range(37 * 45).select(F.when(F.col("id") % 2 == 0, "tag:nlp").otherwise("query:data science").alias("source"), page.alias("page"), (-F.col("id")).alias("position"), record.alias("record"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        adapters.put_pages(rows, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert max(int(n) for n in (tmp_path / "batches").read_text().split()) < 10 * 200
    expected = {}
    for r in rows.orderBy("position").collect():
        expected.setdefault((catalog.folder_name(r.source, "updated"), f"{r.page}.json"), []).append(json.loads(r.record))
    assert {(f.parent.name, f.name): json.loads(f.read_text()) for f in tmp_path.glob("*/*.json")} == expected
