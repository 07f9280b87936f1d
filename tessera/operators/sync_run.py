"""A whole run of the catalog sync: from asked pages to resources, version states, checkpoints, events and totals.

Everything is a plan over tables until it is written: a dry run has the same outcomes and writes nothing. Data is written
before the checkpoints that vouch for it, and a run that is repeated changes nothing but its own number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import sync
from tessera.plans import stored

SOURCE = "catalog"
CHECKPOINT = "run_id string, mode string, source string, sort string, last_successful_page int, watermark timestamp_ntz, status string, stop_reason string, retryable boolean, started_at timestamp, updated_at timestamp"
STATE = "ref string, last_updated timestamp_ntz, current_version_number long, detail_pending boolean, detail_error string"
RESOURCE = f"id string, source string, source_id string, resource_type string, status string, indexed_at timestamp, last_synced_at timestamp, {sync.RECORD}"
CHECKPOINT_KEY = ["run_id", "mode", "source", "sort"]
#: Events of one page, or of one candidate, in the order in which they happen.
EVENTS = ("source_suppressed", "page_processed", "pass_stopped", "page_failed", "tag_validation_failed", "detail_succeeded", "detail_failed", "candidate_ready", "run_complete")


@dataclass(frozen=True)
class Run:
    """ready: the candidates with merged, requested, pending and detail_error; checkpoints: the last of each pass; events:
    (event, source, sort, page, ref, told), told being a map of what each event tells."""

    mode: str
    run_id: str
    plan: sync.Plan
    ready: DataFrame
    checkpoints: DataFrame
    events: DataFrame

    def totals(self) -> DataFrame:
        """One row: candidates, resources_upserted, detail_requested and detail_failed."""
        n = F.count(F.lit(1))
        return self.ready.agg(n.alias("candidates"), n.alias("resources_upserted"), F.count_if("requested").alias("detail_requested"), F.count_if("pending").alias("detail_failed"))


def fields_of(rows: DataFrame) -> list[tuple[str, str]]:
    kinds = dict(rows.dtypes)
    return [(name, kinds[name]) for name in (f.split()[0] for f in sync.RECORD.split(", ")) if name in kinds and name != "is_private"]


def planned(rows: DataFrame, pages: DataFrame, states: DataFrame, checkpoints: DataFrame, mode: str, page_limit: int = sync.PAGE_LIMIT) -> sync.Plan:
    return sync.plan(rows, states, checkpoints, mode, fields_of(rows), page_limit, pages, kept)


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: a run uses each of its tables several times."""
    path = stored.folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run(plan: sync.Plan, pages: DataFrame, states: DataFrame, details: DataFrame, existing: DataFrame, mode: str, run_id: str) -> Run:
    """details: ref, detail (a record) and error of requested refs; existing: ref and record of stored resources."""
    fields = [(f.name, f.dataType.simpleString()) for f in plan.candidates.schema["record"].dataType.fields]
    found = sync.with_details(plan.candidates.select("ref", "record"), details, states, fields, existing)
    ready = kept(found.join(plan.candidates.select("ref", "hit_sources"), "ref"))
    return Run(mode, run_id, plan, ready, checkpoints_of(plan, mode, run_id), events_of(plan, pages, ready))


def requested_refs(plan: sync.Plan, states: DataFrame) -> DataFrame:
    """ref of the candidates whose detail is to be asked for."""
    rows = plan.candidates.select("ref", "record.last_updated", "record.current_version_number").alias("r")
    joined = rows.join(states.alias("s"), F.col("r.ref") == F.col("s.ref"), "left")
    return joined.where(sync.changed()).select("r.ref")


def checkpoints_of(plan: sync.Plan, mode: str, run_id: str) -> DataFrame:
    """The last checkpoint of each pass. One that has not ended is running, at its last page and with the watermark that
    it began with."""
    last = plan.facts.groupBy("source", "sort").agg(F.max("page").alias("at"), F.first("prior").alias("prior"))
    joined = last.join(plan.stops, ["source", "sort"], "left")
    ended = F.col("status").isNotNull()
    return joined.select(
        F.lit(run_id).alias("run_id"),
        F.lit(mode).alias("mode"),
        "source",
        "sort",
        F.coalesce("last_page", "at").cast("int").alias("last_successful_page"),
        F.when(ended, F.col("watermark")).otherwise(F.col("prior")).alias("watermark"),
        F.coalesce("status", F.lit("running")).alias("status"),
        "stop_reason",
        F.coalesce("retryable", F.lit(False)).alias("retryable"),
    )


def page_counts(plan: sync.Plan) -> DataFrame:
    """Of each page that counts, how many of its accepted rows bring a ref for the first time in the run, and how many one
    that has come before."""
    accepted = plan.rows.where("valid AND NOT suppressed").select("source", "sort", "page", "ref", "seq")
    firsts = accepted.groupBy("ref").agg(F.min("seq").alias("first"))
    marked = accepted.join(firsts, "ref")
    return marked.groupBy("source", "sort", "page").agg(F.count_if(F.col("seq") == F.col("first")).alias("new_count"), F.count_if(F.col("seq") != F.col("first")).alias("duplicate_count"))


def events_of(plan: sync.Plan, pages: DataFrame, ready: DataFrame) -> DataFrame:
    """What happened, an event to a row, in an order that is the same each time: the passes page by page, then the
    candidates by ref, then the whole run."""
    none = F.lit(None).cast("string")

    def of(df: DataFrame, event: str, *told: str, ref: Column = none) -> DataFrame:
        own = set(df.columns)
        keys = [F.col(c).cast("string") if c in own else none for c in ("source", "sort")]
        page = F.col("page").cast("int") if "page" in own else F.lit(None).cast("int")
        return df.select(F.lit(event).alias("event"), keys[0].alias("source"), keys[1].alias("sort"), page.alias("page"), ref.alias("ref"), F.create_map(*[x for t in told for x in (F.lit(t), F.col(t).cast("string"))]).alias("told"))

    key = ["source", "sort", "page"]
    asked = pages.groupBy(*key).agg(F.max("http_status").alias("http_status"), F.max("latency_ms").alias("latency_ms"), F.max("retry_count").alias("retry_count"))
    facts = plan.facts.join(asked, key, "left").join(plan.stops.select("source", "sort", "last_page", "stop_reason", "status"), ["source", "sort"], "left")
    counted = facts.where("last_page IS NULL OR page <= last_page").join(page_counts(plan), key, "left").fillna(0, ["new_count", "duplicate_count"])
    last = facts.where("page = last_page + 1")
    suppressed = plan.rows.where("valid AND suppressed").withColumn("matched_negative_term", sync.negative_term(F.col("title"), F.col("subtitle")))
    shown = ready.withColumn("hit_sources", F.array_join("hit_sources", "|"))
    ref = F.col("ref")
    parts = [
        of(last.where("stop_reason = 'transient_error' AND failed"), "page_failed", "http_status", "retry_count"),
        of(last.where("stop_reason = 'tag_exact_validation_failed' AND NOT page_valid"), "tag_validation_failed", "http_status", "latency_ms", "raw_count", "retry_count"),
        of(suppressed, "source_suppressed", "matched_negative_term", ref=ref),
        of(counted, "page_processed", "http_status", "latency_ms", "raw_count", "accepted_count", "new_count", "duplicate_count", "filtered_count", "retry_count"),
        of(facts.where("page = last_page AND NOT stop_reason IN ('transient_error', 'tag_exact_validation_failed')"), "pass_stopped", "stop_reason", "status"),
        of(shown.where("requested AND NOT pending"), "detail_succeeded", "requested", ref=ref),
        of(shown.where("pending"), "detail_failed", "detail_error", ref=ref),
        of(shown, "candidate_ready", "hit_sources", "pending", ref=ref),
    ]
    totals = ready.agg(F.count(F.lit(1)).alias("candidates"), F.count_if("requested").alias("detail_requested"), F.count_if("pending").alias("detail_failed"))
    out = of(totals, "run_complete", "candidates", "detail_requested", "detail_failed")
    for p in parts:
        out = out.unionByName(p)
    stage = F.when(F.col("event") == "run_complete", 2).when(F.col("source").isNull(), 1).otherwise(0)
    step = F.array_position(F.array(*[F.lit(e) for e in EVENTS]), F.col("event"))
    return out.orderBy(stage, "source", "sort", "page", F.col("ref").asc_nulls_last(), step, F.to_json("told"))


# -- tables ---------------------------------------------------------------------------------------------------------


def updated_states(states: DataFrame, ready: DataFrame) -> DataFrame:
    """Version states as the list rows tell them, not the merged records."""
    new = ready.select("ref", F.col("record.last_updated").alias("last_updated"), F.col("record.current_version_number").alias("current_version_number"), F.col("pending").alias("detail_pending"), "detail_error")
    return states.join(new.select("ref"), "ref", "left_anti").select(*new.columns).unionByName(new)


def updated_checkpoints(checkpoints: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Those of new keys are added; of known ones all is written over but when they began."""
    c, n = checkpoints.alias("c"), new.withColumn("_hit", F.lit(True)).alias("n")
    joined = c.join(n, [F.col(f"c.{k}").eqNullSafe(F.col(f"n.{k}")) for k in CHECKPOINT_KEY], "full_outer")
    hit = F.col("n._hit").isNotNull()
    own = {k: F.coalesce(f"n.{k}", f"c.{k}") for k in CHECKPOINT_KEY} | {"started_at": F.coalesce("c.started_at", now), "updated_at": F.when(hit, now).otherwise(F.col("c.updated_at"))}
    return joined.select(*[own[k].alias(k) if k in own else F.when(hit, F.col(f"n.{k}")).otherwise(F.col(f"c.{k}")).alias(k) for k in checkpoints.columns])


def latest_checkpoints(checkpoints: DataFrame) -> DataFrame:
    """Of each mode, source and sort the checkpoint that was written last."""
    rest = [c for c in checkpoints.columns if c not in ("mode", "source", "sort")]
    last = checkpoints.groupBy("mode", "source", "sort").agg(F.max_by(F.struct(*rest), F.struct("updated_at", "run_id")).alias("l"))
    return last.select("mode", "source", "sort", *[F.col(f"l.{c}").alias(c) for c in rest])


def stored_records(resources: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """ref and record of the catalog's resources, whatever their type and status."""
    own = resources.where(F.col("source") == SOURCE)
    return own.select(F.col("source_id").alias("ref"), F.struct(*[F.col(name).cast(kind).alias(name) for name, kind in fields]).alias("record"))


def version_states(states: DataFrame, refs: list[str] | DataFrame) -> DataFrame:
    """Those of a list of refs."""
    if isinstance(refs, DataFrame):
        return states.join(refs.select("ref").distinct(), "ref", "left_semi")
    return states.where(F.col("ref").isin(refs)) if refs else states.where("false")


class Store:
    """The tables of a sync in a folder: resources, states, checkpoints. A run rewrites the buckets of its own keys only,
    and the last versions stay readable."""

    NAMES = ("resources", "states", "checkpoints")

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        from tessera.sources.catalog_tables import catalog_table

        self.tables = {name: catalog_table(spark, path, name) for name in self.NAMES}
        self.keep = keep

    def read(self, name: str) -> DataFrame:
        return self.tables[name].read()

    def dataset(self, source_id: str) -> dict:
        """The active data set of a source id; LookupError if there is none."""
        row = self.tables["resources"].get(SOURCE, source_id)
        if row["status"] != "active" or row["resource_type"] != "dataset":
            raise LookupError(f"{source_id} is no active dataset")
        return row

    def write(self, done: Run, now: Column) -> None:
        """Data first, and then what vouches for it. What breaks a constraint fails the write of its table."""
        data = [f.name for f in done.ready.schema["merged"].dataType.fields]
        found = done.ready.select(F.lit(SOURCE).alias("source"), F.col("ref").alias("source_id"), *[F.col(f"merged.{c}").alias(c) for c in data])
        self.tables["resources"].upsert(found, lambda old, new: sync.upsert_resources(old, new, now), tag=done.run_id)
        self.tables["states"].upsert(done.ready, updated_states, tag=done.run_id)
        self.tables["checkpoints"].upsert(done.checkpoints, lambda old, new: updated_checkpoints(old, new, now), tag=done.run_id)
        for table in self.tables.values():
            table.expire(self.keep)
