"""Whole runs of the sync over pages in a folder."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import sync, sync_run
from tessera.sources import catalog


def item(ref, title="T", tag="nlp", updated="2024-01-02T00:00:00Z", **more):
    return {"ref": ref, "title": title, "tags": [tag], "lastUpdated": updated, "currentVersionNumber": 1} | more


def put(folder, source, pages, sort="updated"):
    home = folder / catalog.folder_name(source, sort)
    home.mkdir()
    for k, page in enumerate(pages, 1):
        (home / f"{k}.json").write_text(json.dumps(page))


def pages_of(spark, tmp_path, source, *failures, mode="incremental"):
    """Pages of a folder; failures are (page, status) of pages that could not be had, after which a pass has none."""
    spark.dataSource.register(catalog.CatalogPages)
    found = spark.read.format("catalog_pages").option("path", str(tmp_path)).option("source", source).option("mode", mode).load()
    for page, status in failures:
        lost = spark.createDataFrame([(source, "updated", page, None, None, status, None, 4, "HTTPError: lost")], catalog.PAGE_SCHEMA)
        found = found.where(F.col("page") < page).unionByName(lost)
    return spark.createDataFrame(found.collect(), found.schema)


def once(spark, pages, store, details, mode="incremental", dry=False, run_id="r1", now="2024-05-01"):
    rows, asked = catalog.records(pages), catalog.asked_pages(pages)
    states = store.read("states")
    plan = sync_run.planned(rows, asked, states, store.read("checkpoints"), mode)
    fields = sync_run.fields_of(rows)
    got = catalog.detail_records(catalog.details(sync_run.requested_refs(plan, states), {"path": details}), fields)
    done = sync_run.run(plan, asked, states, got, sync_run.stored_records(store.read("resources"), fields), mode, run_id)
    told = [(r.event, r.source, r.page, r.ref, dict(r.told)) for r in done.events.collect()]
    totals = tuple(done.totals().first())
    if not dry:
        store.write(done, F.lit(now).cast("timestamp"))
    return told, totals


def test_run(spark, tmp_path):
    put(tmp_path, "tag:nlp", [[item(f"o/r{k}") for k in range(20)], [item("o/r0", "newer", updated="2024-01-09T00:00:00Z"), item("o/x", "")]])
    (tmp_path / "details").mkdir()
    for k in range(19):
        (tmp_path / "details" / f"o__r{k}.json").write_text(json.dumps(item(f"o/r{k}", "", description="whole")))
    store = sync_run.Store(spark, f"{tmp_path}/store")
    pages = pages_of(spark, tmp_path, "tag:nlp")
    told, totals = once(spark, pages, store, str(tmp_path), dry=True)
    assert totals == (20, 20, 20, 1) and store.read("resources").count() == 0 and store.read("checkpoints").count() == 0
    assert once(spark, pages, store, str(tmp_path)) == (told, totals)
    kinds = [e[0] for e in told]
    assert {k: kinds.count(k) for k in set(kinds)} == {"run_complete": 1, "page_processed": 2, "pass_stopped": 1, "detail_succeeded": 19, "detail_failed": 1, "candidate_ready": 20}
    assert {e[2]: (e[4]["new_count"], e[4]["duplicate_count"], e[4]["raw_count"]) for e in told if e[0] == "page_processed"} == {1: ("20", "0", "20"), 2: ("0", "1", "2")}
    rows = {r.source_id: r for r in store.read("resources").collect()}
    assert len(rows) == 20 and (rows["o/r0"].title, rows["o/r0"].description, rows["o/r19"].description) == ("newer", "whole", None)
    states = {r.ref: r for r in store.read("states").collect()}
    assert states["o/r19"].detail_pending and states["o/r19"].detail_error.startswith("FileNotFoundError") and not states["o/r0"].detail_pending
    (mark,) = store.read("checkpoints").collect()
    assert (mark.status, mark.stop_reason, mark.last_successful_page, mark.watermark) == ("complete", "short_page", 2, datetime(2024, 1, 9))
    assert store.dataset("o/r0")["title"] == "newer"
    for gone in ("o/none", ""):
        with pytest.raises(LookupError):
            store.dataset(gone)
    # the next run asks again for what is pending only, and changes no row
    told, totals = once(spark, pages, store, str(tmp_path), run_id="r2", now="2024-06-01")
    assert totals == (20, 20, 1, 1) and store.read("resources").count() == 20 and store.read("checkpoints").count() == 2
    assert {r.indexed_at for r in store.read("resources").collect()} == {datetime(2024, 5, 1)}
    # the same run again keeps when it began
    once(spark, pages, store, str(tmp_path), run_id="r2", now="2024-07-01")
    began = {r.run_id: (r.started_at, r.updated_at) for r in store.read("checkpoints").collect()}
    assert began["r2"] == (datetime(2024, 6, 1), datetime(2024, 7, 1))
    assert {r.run_id for r in sync_run.latest_checkpoints(store.read("checkpoints")).collect()} == {"r2"}


def test_events_come_in_order(spark, tmp_path):
    """Whatever the joins deal out: the passes page by page, then the candidates, then the run."""
    put(tmp_path, "tag:nlp", [[item(f"o/r{k:02}") for k in range(20)], [item(f"o/r{k:02}") for k in range(20, 40)], [item("o/r40")]])
    told, _ = once(spark, pages_of(spark, tmp_path, "tag:nlp"), sync_run.Store(spark, f"{tmp_path}/store"), str(tmp_path))
    refs = [f"o/r{k:02}" for k in range(41)]
    passes = [("page_processed", 1, None), ("page_processed", 2, None), ("page_processed", 3, None), ("pass_stopped", 3, None)]
    candidates = [(e, None, r) for r in refs for e in ("detail_failed", "candidate_ready")]
    assert [(e[0], e[2], e[3]) for e in told] == [*passes, *candidates, ("run_complete", None, None)]


def test_failed_and_empty_pages(spark, tmp_path):
    full = [item(f"o/r{k}") for k in range(20)]
    put(tmp_path, "tag:nlp", [full, []])
    store = sync_run.Store(spark, f"{tmp_path}/store")
    told, totals = once(spark, pages_of(spark, tmp_path, "tag:nlp"), store, str(tmp_path))
    (mark,) = store.read("checkpoints").collect()
    assert (mark.status, mark.stop_reason, mark.last_successful_page) == ("complete", "empty_page", 2) and totals[0] == 20
    told, _ = once(spark, pages_of(spark, tmp_path, "tag:nlp", (2, 503)), store, str(tmp_path), run_id="r2")
    mark = store.read("checkpoints").where("run_id = 'r2'").first()
    assert (mark.status, mark.stop_reason, mark.last_successful_page, mark.retryable, mark.watermark) == ("retryable_failure", "transient_error", 1, True, datetime(2024, 1, 2))
    assert [(e[2], e[4]["http_status"]) for e in told if e[0] == "page_failed"] == [(2, "503")] and not [e for e in told if e[0] == "pass_stopped"]
    # a first page that fails advances neither page nor watermark
    once(spark, pages_of(spark, tmp_path, "tag:nlp", (1, 500)), sync_run.Store(spark, f"{tmp_path}/other"), str(tmp_path))
    mark = sync_run.Store(spark, f"{tmp_path}/other").read("checkpoints").first()
    assert (mark.last_successful_page, mark.watermark, mark.status) == (0, None, "retryable_failure")


def test_invalid_tag_and_suppressed(spark, tmp_path):
    put(tmp_path, "tag:nlp", [[item(f"o/r{k}") for k in range(20)], [item("o/z", tag="other")] * 20])
    told, totals = once(spark, pages_of(spark, tmp_path, "tag:nlp"), sync_run.Store(spark, f"{tmp_path}/store"), str(tmp_path))
    assert totals[0] == 20 and [(e[0], e[2]) for e in told if e[0] == "tag_validation_failed"] == [("tag_validation_failed", 2)]
    put(tmp_path, sync.FILTERED_SOURCE, [[item("o/j", "Jobs of all kinds"), item("o/k")]])
    told, totals = once(spark, pages_of(spark, tmp_path, sync.FILTERED_SOURCE), sync_run.Store(spark, f"{tmp_path}/store2"), str(tmp_path))
    assert totals[0] == 1 and [(e[3], e[4]["matched_negative_term"]) for e in told if e[0] == "source_suppressed"] == [("o/j", "jobs")]


def test_long_numbers_keep_their_digits(spark):
    big = 2**53 + 1
    pages = spark.createDataFrame([("tag:nlp", "updated", 1, 0, json.dumps(item("a/b", totalBytes=big, votes="3.7")), 200, 1, 0, None)], catalog.PAGE_SCHEMA)
    r = catalog.records(pages).first()
    assert (r.size_bytes, r.votes) == (big, 3)


def test_refs(spark):
    states = spark.createDataFrame([("a",), ("b",)], "ref string")
    assert [r.ref for r in sync_run.version_states(states, ["b", "c"]).collect()] == ["b"] and sync_run.version_states(states, []).count() == 0
    assert sync_run.version_states(states, states.where("ref = 'a'")).count() == 1


def test_modes(spark):
    with pytest.raises(ValueError):
        sync.sorts_of("full")
