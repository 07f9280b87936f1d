"""A run's pages as a stream that stops asking: each micro-batch has the next page of every pass that goes on.

The rules that end a pass are kept as state by pass: its last page, whether that was stale, the newest date so far and how
the pass ended. Every page is judged as it comes; what was judged is written, with the batch's pages before it, and the
source plans the next pages by that. So no page is asked for that comes after a pass's end, and a run that breaks off goes
on from its checkpoint with the pages and states that it had.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tessera.operators import sync
from tessera.plans import stored
from tessera.sources import catalog

_STORES = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Passes are few, and each batch has a page of each.
TASKS = 4

_VERDICT = "last_page int, stop_reason string, status string, watermark bigint, retryable boolean, stale boolean"
_JUDGED = f"{catalog.PAGE_SCHEMA}, {_VERDICT}"


def _micros(c: str):
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")


def flagged(pages: DataFrame, states: DataFrame | None) -> DataFrame:
    """Rows of pages with what their page is judged by: valid, accepted, changed, tagged and dated. Without states (a run
    that knows no stale page) nothing is looked up."""
    rows = catalog.canonical(pages, "https://catalog.example/datasets/", *[c for c in pages.columns if c not in ("source", "sort", "page")])
    valid = F.col("record").isNotNull() & F.coalesce(sync.valid_record(), F.lit(False))
    suppressed = (F.col("source") == sync.FILTERED_SOURCE) & sync.negative_term(F.col("title"), F.col("subtitle")).isNotNull()
    tagged = F.when(F.col("source").startswith("tag:"), sync.has_tag(F.col("tags"), F.substring_index("source", ":", -1))).otherwise(True)
    rows = rows.withColumns({"valid": valid, "accepted": valid & ~F.coalesce(suppressed, F.lit(False)), "tagged": tagged})
    if states is None:
        return rows.withColumns({"changed": F.lit(True), "dated": _micros("last_updated")})
    joined = rows.alias("r").join(states.alias("s"), F.col("r.ref") == F.col("s.ref"), "left")
    return joined.select("r.*", sync.changed(mind_pending=False).alias("changed"), _micros("r.last_updated").alias("dated"))


class PassJudge(StatefulProcessor):
    """The rules of sync.stop_pages for one pass, a page at a time. Each row goes on with its page's verdict: last_page,
    stop_reason and the like are null unless the page ends its pass."""

    def __init__(self, mode: str, page_limit: int, page_size: int):
        self.mode, self.page_limit, self.page_size = mode, page_limit, page_size

    def init(self, handle) -> None:
        self.state = handle.getValueState("pass", "page int, stale boolean, newest bigint, prior bigint, ended boolean")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        prior = initialState["prior"].dropna()
        self.state.update((0, False, None, int(prior.max()) if len(prior) else None, False))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else (0, False, None, None, False)
        page, stale, newest, prior, ended = held
        for number, own in pd.concat(list(rows)).groupby("page"):
            if ended or number <= page:
                continue
            page, facts = int(number), self.facts(own, prior)
            newest = max((x for x in (newest, facts["newest"]) if x is not None), default=None)
            reason = self.reason(page, facts, stale)
            stale, ended = facts["stale"], reason is not None
            yield self.told(own, page, reason, newest, prior, stale)
        self.state.update((page, stale, newest, prior, ended))

    def facts(self, own: pd.DataFrame, prior: int | None) -> dict:
        valid, accepted = own[own["valid"]], own[own["accepted"]]
        dates = valid["dated"].dropna()
        none_newer = prior is not None and len(dates) == len(valid) and (dates <= prior).all()
        return {
            "failed": own["error"].notna().any(),
            "raw": int(own["record"].notna().sum()),
            "tagged": valid.empty or bool(valid["tagged"].any()),
            "newest": int(dates.max()) if len(dates) else None,
            "stale": bool(none_newer and len(valid) and not accepted["changed"].any()),
        }

    def reason(self, page: int, facts: dict, was_stale: bool) -> str | None:
        rules = (
            (facts["failed"], "transient_error"),
            (not facts["tagged"], "tag_exact_validation_failed"),
            (facts["raw"] == 0, "empty_page"),
            (facts["raw"] < self.page_size, "short_page"),
            (self.mode == "incremental" and facts["stale"] and was_stale, "two_stale_pages"),
            (self.mode == "bootstrap" and page >= self.page_limit, "configured_page_limit"),
        )
        return next((why for holds, why in rules if holds), None)

    def told(self, own: pd.DataFrame, page: int, reason: str | None, newest: int | None, prior: int | None, stale: bool) -> pd.DataFrame:
        status = {None: None, "transient_error": "retryable_failure", "tag_exact_validation_failed": "invalid_source", "configured_page_limit": "partial"}.get(reason, "complete")
        without = reason in ("transient_error", "tag_exact_validation_failed")
        observed = max((x for x in (newest, prior) if x is not None), default=None)
        out = own[[c.split()[0] for c in catalog.PAGE_SCHEMA.split(", ")]].copy()
        out["last_page"] = pd.array([None if reason is None else page - 1 if without else page] * len(out), "Int32")
        out["stop_reason"], out["status"] = reason, status
        out["watermark"] = pd.array([None if reason is None else prior if without else observed] * len(out), "Int64")
        out["retryable"], out["stale"] = reason == "transient_error", stale
        for c in ("position", "http_status", "retry_count"):
            out[c] = out[c].astype("Int32")
        out["latency_ms"] = out["latency_ms"].astype("Int64")
        return out


def paged(spark: SparkSession, options: dict, mode: str, states: DataFrame, checkpoints: DataFrame, work: str | None = None, page_limit: int = sync.PAGE_LIMIT) -> DataFrame:
    """The pages of one run, asked for until every pass has ended: PAGE_SCHEMA with last_page, stop_reason, status,
    watermark, retryable (on the rows of a page that ends its pass, else null) and stale.

    options say where pages are (path, or url and token) and which sources (all, if none). checkpoints are those of
    earlier runs, whose watermarks an incremental run goes by. work is the run's folder: with that of a run that broke off,
    the run goes on after the last page that was judged."""
    work = (work or stored.folder(spark)).rstrip("/")
    spark.dataSource.register(catalog.CatalogPages)
    pages = spark.readStream.format("catalog_pages").options(**options, mode=mode, judged=f"{work}/judged").load()
    passes = catalog.passes_of(options | {"mode": mode})
    marks = sync.latest_watermarks(checkpoints).select("source", "sort", _micros("watermark").alias("prior")) if mode == "incremental" else None
    begin = spark.createDataFrame(passes, "source string, sort string")
    begin = begin.withColumn("prior", F.lit(None).cast("bigint")) if marks is None else begin.join(marks, ["source", "sort"], "left")
    judge = PassJudge(mode, page_limit, sync.PAGE_SIZE)
    rows = flagged(pages, states if mode == "incremental" else None)
    judged = rows.groupBy("source", "sort").transformWithStateInPandas(judge, _JUDGED, "Append", "None", begin.groupBy("source", "sort"))

    def write(batch: DataFrame, number: int) -> None:
        """The pages first, and then what they were judged to be, which the source goes by."""
        path = f"{work}/pages/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        new = spark.read.schema(_JUDGED).parquet(path).groupBy("source", "sort").agg(F.max("page").alias("page"), F.bool_or(F.col("stop_reason").isNotNull()).alias("ended"))
        before = catalog.judged_pages(f"{work}/judged")
        old = spark.createDataFrame([(*k.split("|"), page, ended) for k, (page, ended) in before.items()], "source string, sort string, page int, ended boolean")
        both = old.unionByName(new).groupBy("source", "sort").agg(F.max("page").alias("page"), F.bool_or("ended").alias("ended"))  # a row for each pass
        both.coalesce(1).write.mode("overwrite").parquet(f"{work}/judged/batch={number}")

    settings = {_STORES: _ROCKS, "spark.sql.shuffle.partitions": str(TASKS), "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    held = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        asked = judged.writeStream.foreachBatch(write).option("checkpointLocation", f"{work}/state").start()
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    try:
        asked.processAllAvailable()
    finally:
        asked.stop()
    found = spark.read.schema(f"{_JUDGED}, batch long").parquet(f"{work}/pages")
    return found.drop("batch").withColumn("watermark", F.expr("timestampadd(MICROSECOND, watermark, TIMESTAMP_NTZ'1970-01-01 00:00:00')"))


def stops(pages: DataFrame) -> DataFrame:
    """How each pass ended, of paged(): in the columns of sync.stop_pages."""
    ends = ["last_page", "stop_reason", "status", "watermark", "retryable"]
    return pages.where("stop_reason IS NOT NULL").groupBy("source", "sort").agg(F.first(F.struct(*ends)).alias("e")).select("source", "sort", *[f"e.{c}" for c in ends])
