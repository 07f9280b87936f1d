"""Incremental sync of catalog records, as transformations of paged rows.

A list row carries where it was found: source (kind:value), sort, page, position, and seq, its place in the order of all
arrivals. Passes are (source, sort); what a loop over pages decides one by one is decided here by windows over pages.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import filter_text, filter_words, nfkc_list

#: Terms of titles that suppress a hit of one source, in the order in which they are told.
NEGATIVE_TERMS = (
    "interview questions",
    "interview question",
    "cheat sheets",
    "cheat sheet",
    "data science books",
    "data science book",
    "certification",
    "salaries",
    "salary",
    "careers",
    "career",
    "roadmaps",
    "roadmap",
    "handbooks",
    "handbook",
    "courses",
    "course",
    "resume",
    "jobs",
    "job",
)
FILTERED_SOURCE = "query:data science"
#: The tags and the queries that are followed.
TAGS = (
    "artificial intelligence",
    "classification",
    "regression",
    "clustering",
    "time series analysis",
    "nlp",
    "computer vision",
    "recommender systems",
    "outlier analysis",
)
QUERIES = ("data science", "machine learning", "forecasting", "anomaly detection")
SOURCES = tuple(f"tag:{t}" for t in TAGS) + tuple(f"query:{q}" for q in QUERIES)
PAGE_SIZE, PAGE_LIMIT = 20, 20
MODES = ("bootstrap", "incremental")

TEXTS = ("title", "url", "subtitle", "description", "author", "license")
NUMBERS = ("last_updated", "current_version_number", "votes", "downloads", "usability_rating", "size_bytes")
#: Columns of a record besides its ref, in order.
RECORD = "title string, url string, subtitle string, description string, tags array<string>, author string, last_updated timestamp_ntz, current_version_number long, votes long, downloads long, usability_rating double, size_bytes long, license string, is_private boolean"


def select_sources(key: str | None = None) -> tuple[str, ...]:
    if key is None:
        return SOURCES
    if key not in SOURCES:
        raise ValueError(f"unknown source {key!r}; known: {', '.join(SOURCES)}")
    return (key,)


def sorts_of(mode: str) -> tuple[str, ...]:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    return ("votes", "updated") if mode == "bootstrap" else ("updated",)


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def valid_record() -> Column:
    return filled(F.col("ref")) & filled(F.col("title")) & filled(F.col("url")) & ~F.coalesce(F.col("is_private"), F.lit(False))


def negative_term(title: Column, subtitle: Column) -> Column:
    """The first of the terms that the title and subtitle have as whole words; null if none."""
    padded = F.concat(F.lit(" "), filter_text(F.concat_ws(" ", title, subtitle)), F.lit(" "))
    return F.coalesce(*[F.when(F.contains(padded, F.lit(f" {t} ")), t) for t in NEGATIVE_TERMS])


def has_tag(tags: Column, expected: Column) -> Column:
    """expected is one of the followed tags, which are ASCII."""
    wanted = filter_words(expected)
    return F.exists(nfkc_list(F.coalesce(tags, F.array().cast("array<string>"))), lambda t: filter_words(F.coalesce(t, F.lit(""))) == wanted)


def tag_pages(rows: DataFrame) -> DataFrame:
    """(source, sort, page, page_valid): a tag's page must have its tag on some valid row, or have no valid rows at all."""
    value = F.substring_index("source", ":", -1)
    tagged = F.when(F.col("source").startswith("tag:") & valid_record(), has_tag(F.col("tags"), value))
    return rows.groupBy("source", "sort", "page").agg(F.coalesce(F.bool_or(tagged), F.lit(True)).alias("page_valid"))


# -- merging --------------------------------------------------------------------------------------------------------


def merge_fields(base: Column, override: Column, fields: list[tuple[str, str]]) -> Column:
    """The struct base with every field of override that is not empty; false and zero are not empty."""
    out = []
    for name, kind in fields:
        a, b = base[name], override[name]
        if kind == "string":
            c = F.coalesce(F.nullif(b, F.lit("")), a)
        elif kind.startswith("array"):
            c = F.when(F.size(F.coalesce(b, F.array().cast(kind))) > 0, b).otherwise(a)
        else:
            c = F.coalesce(b, a)
        out.append(c.alias(name))
    return F.struct(*out)


def prefer_fresher(left: Column, right: Column, fields: list[tuple[str, str]], dated: str = "last_updated") -> Column:
    """The later arrival (right) overrides, unless both are dated and it is strictly older."""
    older = F.coalesce(right[dated] < left[dated], F.lit(False))
    return F.when(older, merge_fields(right, left, fields)).otherwise(merge_fields(left, right, fields))


def fold(rows: DataFrame, key: str, order: str, fields: list[tuple[str, str]], dated: str = "last_updated") -> DataFrame:
    """key and record: the arrivals of each key merged one by one in order. The merge is not associative, so it is a
    fold of the ordered list; a key's arrivals are as many as its sources, sorts and pages."""
    record = F.struct(*[F.col(n) for n, _ in fields])
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), record.alias("_r")))).alias("_all"))
    first, rest = F.element_at("_all", 1)["_r"], F.slice("_all", 2, F.greatest(F.size("_all") - 1, F.lit(0)))
    folded = F.aggregate(rest, first, lambda held, x: prefer_fresher(held, x["_r"], fields, dated))
    return listed.select(key, folded.alias("record"))


def candidates(rows: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """ref, record and hit_sources (sorted) of accepted rows."""
    hits = rows.groupBy("ref").agg(F.array_sort(F.collect_set("source")).alias("hit_sources"))
    return fold(rows, "ref", "seq", fields).join(hits, "ref")


# -- versions and stop rules ----------------------------------------------------------------------------------------


def changed(state: str = "s", row: str = "r", mind_pending: bool = True) -> Column:
    """Of a left join of rows with version states: new, changed, or still pending."""
    differs = ~F.col(f"{row}.last_updated").eqNullSafe(F.col(f"{state}.last_updated")) | ~F.col(f"{row}.current_version_number").eqNullSafe(F.col(f"{state}.current_version_number"))
    out = F.col(f"{state}.ref").isNull() | differs
    return out | F.coalesce(F.col(f"{state}.detail_pending"), F.lit(False)) if mind_pending else out


def page_facts(rows: DataFrame, states: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Counts of each page of each pass, its newest date, and whether it is stale.

    rows also have suppressed (whether a negative term was found at the filtered source). A stale page brings nothing new
    or changed, and all its valid rows, suppressed ones too, are dated and none is newer than the pass's watermark."""
    joined = rows.alias("r").join(states.alias("s"), F.col("r.ref") == F.col("s.ref"), "left")
    ok, accepted = F.col("valid"), F.col("valid") & ~F.col("suppressed")
    marked = joined.select("r.*", changed(mind_pending=False).alias("_changed")).join(watermarks, ["source", "sort"], "left")
    facts = marked.groupBy("source", "sort", "page").agg(
        F.count("ref").alias("raw_count"),
        F.count_if(ok).alias("valid_count"),
        F.count_if(accepted).alias("accepted_count"),
        F.count_if(ok & F.col("suppressed")).alias("filtered_count"),
        F.count_if(accepted & F.col("_changed")).alias("changed_count"),
        F.max(F.when(ok, F.col("last_updated"))).alias("newest"),
        F.coalesce(F.bool_and(F.when(ok, F.col("last_updated").isNotNull() & (F.col("last_updated") <= F.col("watermark")))), F.lit(False)).alias("none_newer"),
        F.first("watermark").alias("prior"),
    )
    stale = F.col("prior").isNotNull() & (F.col("changed_count") == 0) & (F.col("valid_count") > 0) & F.coalesce(F.col("none_newer"), F.lit(False))
    return facts.withColumn("stale", stale)


def stop_pages(facts: DataFrame, mode: str, page_limit: int = PAGE_LIMIT, page_size: int = PAGE_SIZE) -> DataFrame:
    """The first page that ends each pass: the last page that counts, why, with which status, the watermark that it
    commits, and whether it is worth another try.

    In this order: a page that could not be had or has not its tag (failed, page_valid, where facts have them), which
    counts for nothing and leaves the watermark as it was; an empty page, a short page, two stale pages in a row
    (incremental), the page limit (bootstrap)."""
    sorts_of(mode)
    passes = Window.partitionBy("source", "sort").orderBy("page")
    upto = passes.rowsBetween(Window.unboundedPreceding, 0)
    failed = F.col("failed") if "failed" in facts.columns else F.lit(False)
    wrong = ~F.col("page_valid") if "page_valid" in facts.columns else F.lit(False)
    twice = F.col("stale") & F.coalesce(F.lag("stale").over(passes), F.lit(False)) if mode == "incremental" else F.lit(False)
    limited = F.col("page") >= page_limit if mode == "bootstrap" else F.lit(False)
    reason = F.when(failed, "transient_error").when(wrong, "tag_exact_validation_failed")
    reason = reason.when(F.col("raw_count") == 0, "empty_page").when(F.col("raw_count") < page_size, "short_page").when(F.col("_twice"), "two_stale_pages").when(limited, "configured_page_limit")
    seen = facts.withColumns({"_twice": twice, "observed": F.greatest(F.max("newest").over(upto), F.col("prior"))}).withColumn("stop_reason", reason)
    first = seen.where("stop_reason IS NOT NULL").groupBy("source", "sort").agg(F.min_by(F.struct("page", "stop_reason", "observed", "prior"), "page").alias("f"))
    why = F.col("f.stop_reason")
    status = F.when(why == "transient_error", "retryable_failure").when(why == "tag_exact_validation_failed", "invalid_source").when(why == "configured_page_limit", "partial").otherwise("complete")
    without = why.isin("transient_error", "tag_exact_validation_failed")
    return first.select(
        "source",
        "sort",
        F.when(without, F.col("f.page") - 1).otherwise(F.col("f.page")).alias("last_page"),
        why.alias("stop_reason"),
        status.alias("status"),
        F.when(without, F.col("f.prior")).otherwise(F.col("f.observed")).alias("watermark"),
        (why == "transient_error").alias("retryable"),
    )


def latest_watermarks(checkpoints: DataFrame) -> DataFrame:
    """Of completed passes only, whatever their mode."""
    return checkpoints.where("status = 'complete'").groupBy("source", "sort").agg(F.max("watermark").alias("watermark"))


# -- tables ---------------------------------------------------------------------------------------------------------


def upsert_last(target: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of target with all columns of the last update of each key; keys that are new are added. order ranks updates."""
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in target.columns if c not in keys]), order).alias("_new"))
    joined = target.withColumn("_old", F.struct(*[c for c in target.columns if c not in keys])).select(*keys, "_old").join(last, keys, "full_outer")
    row = F.coalesce("_new", "_old")
    return joined.select(*[F.col(c) if c in keys else row[c].alias(c) for c in target.columns])


def upsert_resources(target: DataFrame, updates: DataFrame, now: Column, resource_type: str = "dataset") -> DataFrame:
    """The resources with updates (source, source_id and the record's columns) written over those of the same natural
    key, which are active again and keep id, indexed_at and type; new ones get an id made from their key."""
    data = [c for c in updates.columns if c not in ("source", "source_id")]
    t, u = target.alias("t"), updates.withColumn("_hit", F.lit(True)).alias("u")
    joined = t.join(u, (F.col("t.source") == F.col("u.source")) & (F.col("t.source_id") == F.col("u.source_id")), "full_outer")
    hit = F.col("u._hit").isNotNull()
    key = {c: F.coalesce(f"t.{c}", f"u.{c}") for c in ("source", "source_id")}
    digest = F.sha2(F.concat_ws("|", key["source"], key["source_id"]), 256)
    new_id = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    own = {
        **key,
        "id": F.coalesce("t.id", new_id),
        "status": F.when(hit, "active").otherwise(F.col("t.status")),
        "resource_type": F.coalesce("t.resource_type", F.lit(resource_type)),
        "indexed_at": F.coalesce("t.indexed_at", now),
        "last_synced_at": F.when(hit, now).otherwise(F.col("t.last_synced_at")),
    } | {c: F.when(hit, F.col(f"u.{c}")).otherwise(F.col(f"t.{c}")) for c in data}
    return joined.select(*[own[c].alias(c) if c in own else F.col(f"t.{c}") for c in target.columns])


def with_details(found: DataFrame, details: DataFrame, states: DataFrame, fields: list[tuple[str, str]], existing: DataFrame | None = None) -> DataFrame:
    """found (ref, record) with merged, requested, pending and detail_error: what is stored is overridden by the list
    row, and that by the detail record (ref, detail, error) if the version changed and it could be had."""
    if existing is not None:
        found = found.join(existing.select("ref", F.col("record").alias("_old")), "ref", "left")
        merged = F.when(F.col("_old").isNotNull(), merge_fields(F.col("_old"), F.col("record"), fields)).otherwise(F.col("record"))
    else:
        merged = F.col("record")
    rows = found.withColumn("_merged", merged).select("*", F.col("record.last_updated").alias("last_updated"), F.col("record.current_version_number").alias("current_version_number"))
    asked = rows.alias("r").join(states.alias("s"), F.col("r.ref") == F.col("s.ref"), "left").select("r.*", changed().alias("requested"))
    joined = asked.join(details.select("ref", "detail", "error"), "ref", "left")
    failed = F.col("requested") & (F.col("error").isNotNull() | F.col("detail").isNull())
    final = F.when(F.col("requested") & ~failed, merge_fields(F.col("_merged"), F.col("detail"), fields)).otherwise(F.col("_merged"))
    error = F.when(failed, F.substring(F.coalesce("error", F.lit("LookupError: no detail record")), 1, 1000))
    return joined.select("ref", "record", final.alias("merged"), "requested", failed.alias("pending"), error.alias("detail_error"))


@dataclass(frozen=True)
class Plan:
    """rows: those of pages that count, with valid and suppressed; facts: of every page; stops: of passes that ended;
    candidates: what was accepted."""

    rows: DataFrame
    facts: DataFrame
    stops: DataFrame
    candidates: DataFrame


def plan(rows: DataFrame, states: DataFrame, checkpoints: DataFrame, mode: str, fields: list[tuple[str, str]], page_limit: int = PAGE_LIMIT, pages: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Plan:
    """One run over paged rows (source, sort, page, seq, ref, the record's columns). pages (source, sort, page, failed)
    tells of every page that was asked for, also of those without rows. keep may write what is used more than once.

    Pages after a pass's end count for nothing; what earlier pages brought is kept."""
    sorts = sorts_of(mode)
    rows = rows.where(F.col("sort").isin(*sorts))
    suppressed = (F.col("source") == FILTERED_SOURCE) & negative_term(F.col("title"), F.col("subtitle")).isNotNull()
    rows = keep(rows.withColumns({"valid": F.coalesce(valid_record(), F.lit(False)), "suppressed": suppressed}))
    marks = latest_watermarks(checkpoints) if mode == "incremental" else latest_watermarks(checkpoints).limit(0)
    page = ["source", "sort", "page"]
    facts = page_facts(rows, states, marks).join(tag_pages(rows), page)
    if pages is None:
        facts = facts.withColumn("failed", F.lit(False))
    else:
        asked = pages.where(F.col("sort").isin(*sorts)).groupBy(*page).agg(F.bool_or("failed").alias("failed"))
        joined = asked.join(facts.drop("prior"), page, "left").join(marks.withColumnRenamed("watermark", "prior"), ["source", "sort"], "left")
        counts = [c for c in facts.columns if c.endswith("_count")]
        facts = joined.fillna(0, counts).withColumns({"stale": F.coalesce("stale", F.lit(False)), "page_valid": F.coalesce("page_valid", F.lit(True))})
    facts = keep(facts)
    stops = keep(stop_pages(facts, mode, page_limit))
    kept = rows.join(stops.select("source", "sort", "last_page"), ["source", "sort"], "left").where("last_page IS NULL OR page <= last_page").drop("last_page")
    return Plan(kept, facts, stops, keep(candidates(kept.where("valid AND NOT suppressed"), fields)))


def plan_sync(rows: DataFrame, states: DataFrame, checkpoints: DataFrame, mode: str, fields: list[tuple[str, str]], page_limit: int = PAGE_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(candidates, ended passes) of one run."""
    planned = plan(rows, states, checkpoints, mode, fields, page_limit)
    return planned.candidates, planned.stops


def retry_delay(attempt: int, retry_after: float | None, base: float = 2.0, floor: float = 180.0, rate_limited: bool = False, jitter: float = 0.0) -> float:
    """Seconds to wait before the next attempt: what the server asks for, else doubling from base, and no less than
    floor where the rate is limited."""
    if retry_after is not None:
        return max(0.0, retry_after)
    doubled = base * 2 ** (attempt - 1)
    return reduce(max, [doubled, floor] if rate_limited else [doubled]) + jitter
