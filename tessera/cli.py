"""Command line: sync, search, evaluation, benchmarks, profiles and statistics over Parquet tables."""

from __future__ import annotations

import argparse
import json
import os
import sys
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.english import english, query_words
from tessera.operators import acquisition, evaluation, evaluation_run, fusion, inspection, keyword, profile, stats, sync, sync_run, vectors
from tessera.sources import catalog
from tessera.streaming import pages_stream


ANALYZERS = (english, query_words)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, **defaults) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.set_defaults(**defaults)
        return c

    for name, kind in (("search-keyword", None), ("search-semantic", "dataset"), ("search-hybrid", None)):
        c = add(name)
        c.add_argument("--resources", required=True)
        c.add_argument("--resource-type", default=kind)
        c.add_argument("--limit", type=int, default=20)
        c.add_argument("--offset", type=int, default=0)
        if name != "search-semantic":
            c.add_argument("--query" if name == "search-keyword" else "--lexical-query", dest="queries", action="append", required=True)
        if name != "search-keyword":
            c.add_argument("--embeddings", required=True)
            c.add_argument("--semantic-query", required=True)
            c.add_argument("--dimension", type=int, default=64)
        if name == "search-hybrid":
            c.add_argument("--rrf-k", type=int, default=fusion.RRF_K)
            c.add_argument("--keyword-top-k", type=int, default=20)
            c.add_argument("--semantic-top-k", type=int, default=20)
            c.add_argument("--include-timing", action="store_true")
    c = add("sync")
    c.add_argument("mode", choices=sync.MODES)
    c.add_argument("--source")
    c.add_argument("--state", required=True)
    c.add_argument("--dry-run", action="store_true")
    c.add_argument("--events", help="a folder for the run's events as JSON lines; standard output unless given")
    c = add("smoke")
    c.add_argument("--source", default=sync.SOURCES[0])
    c = add("hybrid-evaluate")
    for name in ("--queries", "--resources", "--embeddings", "--output"):
        c.add_argument(name, required=True)
    c.add_argument("--dimension", type=int, default=64)
    c.add_argument("--rrf-k", type=int, default=fusion.RRF_K)
    c = add("acquisition-benchmark")
    which = c.add_mutually_exclusive_group(required=True)
    which.add_argument("--ref", dest="refs", action="append")
    which.add_argument("--source")
    c.add_argument("--sample-size", type=int, default=40)
    c.add_argument("--method", dest="methods", action="append")
    c.add_argument("--workers", type=int, default=4)
    c.add_argument("--output")
    for name in ("sync", "smoke", "acquisition-benchmark"):
        where = sub.choices[name].add_mutually_exclusive_group(required=True)
        where.add_argument("--pages", help="a folder of pages")
        where.add_argument("--url", help="the service")
    c = add("backfill")
    for name in ("--resources", "--embeddings", "--output"):
        c.add_argument(name, required=True)
    c.add_argument("--dimension", type=int, default=64)
    c.add_argument("--batch-size", type=int, default=32)
    c.add_argument("--rebuild", action="store_true")
    add("evaluate").add_argument("--rows", required=True)
    add("benchmark").add_argument("--samples", required=True)
    c = add("profile")
    for name in ("--resources", "--files", "--output"):
        c.add_argument(name, required=True)
    c.add_argument("--platform", default="Catalog")
    c.add_argument("--inspection-json", help="a folder for the inspections as JSON")
    return p


def _show(df: DataFrame) -> None:
    for row in df.toJSON().toLocalIterator():
        print(json.dumps(json.loads(row)))


def write_json(value: object, path: str | None) -> None:
    """To a file, or to standard output: indented, with letters as they are and a line feed at the end."""
    text = json.dumps(value, indent=2, ensure_ascii=False, default=str) + "\n"
    if path is None:
        sys.stdout.write(text)
    else:
        Path(path).write_text(text, encoding="utf-8")


def read_json(path: str):
    return json.loads(Path(path).read_text(encoding="utf-8"))


def where_from(a: argparse.Namespace) -> dict:
    return {"path": a.pages} if a.pages else {"url": a.url, **({"token": t} if (t := os.environ.get("CATALOG_TOKEN")) else {})}


def pages_of(spark: SparkSession, a: argparse.Namespace, mode: str, **more) -> DataFrame:
    spark.dataSource.register(catalog.CatalogPages)
    options = where_from(a) | ({"source": a.source} if a.source else {}) | {"mode": mode} | more
    return spark.read.format("catalog_pages").options(**options).load()


def sync_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    """One run; its tables are snapshots below the state folder."""
    store = sync_run.Store(spark, a.state)
    states, checkpoints, limit = store.read("states"), store.read("checkpoints"), catalog.Config.from_env().bootstrap_page_limit
    # asked for once, up to each pass's end: what a page said then is what the whole run goes by
    pages = pages_stream.paged(spark, where_from(a) | ({"source": a.source} if a.source else {}), a.mode, states, checkpoints, page_limit=limit)
    rows, asked = catalog.records(pages), catalog.asked_pages(pages)
    plan = sync_run.planned(rows, asked, states, checkpoints, a.mode, limit)
    fields = sync_run.fields_of(rows)
    refs = sync_run.requested_refs(plan, states)
    # requests to a server keep one pace
    found = sync_run.kept(catalog.details(refs.repartition(1) if a.url else refs, where_from(a)))
    done = sync_run.run(plan, asked, states, catalog.detail_records(found, fields), sync_run.stored_records(store.read("resources"), fields), a.mode, str(uuid.uuid4()))
    if not a.dry_run:
        store.write(done, F.current_timestamp())
    if a.events:
        done.events.write.mode("append").json(a.events)
    else:
        _show(done.events)
    return done.totals().first().asDict() | {"run_id": done.run_id, "dry_run": a.dry_run}


def hybrid(resources: DataFrame, embeddings: DataFrame, queries: list[str], vector: list[float], model: tuple, a: argparse.Namespace, timings: dict | None = None) -> DataFrame:
    """One page of both searches, fused; with timings, each stage is run by itself and timed."""
    staged = (lambda df, _: df) if timings is None else (lambda df, name: evaluation_run.timed(df, timings, name))
    fusion.check_fusion(a.rrf_k, a.keyword_top_k, a.semantic_top_k)
    kw = keyword.keyword_search(resources, queries, a.resource_type, a.keyword_top_k, 0, "cover", ANALYZERS)
    sem = vectors.semantic_search(resources, embeddings, vector, model, a.resource_type, a.semantic_top_k)
    ranked = lambda df, score: keyword.top_k(df.withColumn("query_id", F.lit(0)).select("query_id", "id", score), 100, score)
    kw, sem = staged(ranked(kw, "keyword_score"), "keyword_ms"), staged(ranked(sem, "semantic_score"), "semantic_ms")
    page = fusion.fused_page(fusion.reciprocal_rank_fusion(kw, sem, a.rrf_k), a.limit, a.offset)
    return staged(page, "fusion_ms").orderBy("place").drop("query_id")


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    read = spark.read.parquet
    try:
        if a.command == "search-keyword":
            _show(keyword.keyword_search(read(a.resources), a.queries, a.resource_type, a.limit, a.offset, "cover", ANALYZERS))
        elif a.command in ("search-semantic", "search-hybrid"):
            backend = vectors.HashingBackend(a.dimension)
            model = (backend.name, backend.revision, backend.dimension)
            vector = backend.embed([a.semantic_query])[0]
            if a.command == "search-semantic":
                _show(vectors.semantic_search(read(a.resources), read(a.embeddings), vector, model, a.resource_type, a.limit, a.offset))
            else:
                timings: dict[str, float] | None = {} if a.include_timing else None
                _show(hybrid(read(a.resources), read(a.embeddings), a.queries, vector, model, a, timings))
                if timings is not None:
                    print(json.dumps({"timing": timings | {"total_ms": round(sum(timings.values()), 3)}}))
        elif a.command == "sync":
            if a.source:
                sync.select_sources(a.source)
            print(json.dumps(sync_command(spark, a)))
        elif a.command == "smoke":
            page = pages_of(spark, a, "incremental", pagelimit="1")
            print(json.dumps({"source": a.source} | catalog.records(page).agg(F.count(F.lit(1)).alias("count"), F.count_if(sync.valid_record()).alias("valid")).first().asDict()))
        elif a.command == "hybrid-evaluate":
            backend = vectors.HashingBackend(a.dimension)
            old = read_json(a.output)["rows"] if os.path.exists(a.output) else []
            keys = "query_id string, method string, resource_id string, relevance_label string, notes string"
            previous = spark.createDataFrame([tuple(r.get(k.split()[0]) for k in keys.split(", ")) for r in old], keys)
            done = evaluation_run.run_evaluation(read_json(a.queries), read(a.resources), read(a.embeddings), backend, ANALYZERS, rrf_k=a.rrf_k, previous=previous)
            write_json(done.report(), a.output)
        elif a.command == "acquisition-benchmark":
            refs = a.refs or acquisition.discovered(catalog.records(pages_of(spark, argparse.Namespace(**vars(a) | {"source": acquisition.checked_source(a.source)}), "incremental")), a.sample_size)
            rows = acquisition.samples(spark, refs, a.methods or list(acquisition.METHODS), where_from(a), a.workers).collect()
            found = stats.method_stats(spark.createDataFrame(rows))
            best = stats.recommended(found).first()
            write_json({"methods": [r.asDict() for r in found.collect()], "samples": [r.asDict() for r in rows], "recommended": best and best.method}, a.output)
        elif a.command == "backfill":
            done = vectors.run_backfill(read(a.resources), read(a.embeddings), vectors.HashingBackend(a.dimension), a.rebuild, a.batch_size)
            done.table.write.parquet(a.output)
            print(json.dumps(done.stats().first().asDict()))
        elif a.command == "evaluate":
            _show(evaluation.method_metrics(read(a.rows)))
            _show(evaluation.overlaps(read(a.rows)))
        elif a.command == "benchmark":
            found = stats.method_stats(read(a.samples))
            _show(found)
            _show(stats.recommended(found))
        else:
            found = inspection.inspected(read(a.files))
            made = profile.profiles(read(a.resources), found, a.platform)
            if a.inspection_json:
                profile.sidecar(found).write.mode("overwrite").json(a.inspection_json)
            if a.output.endswith(".md"):
                one = made.limit(2).collect()
                if len(one) != 1:
                    raise ValueError("a Markdown file holds one resource; give a folder for more or less")
                Path(a.output).write_text(one[0].markdown, encoding="utf-8")
            else:
                made.write.parquet(a.output)
    except ValueError as e:
        sys.exit(str(e))
    return 0


if __name__ == "__main__":
    sys.exit(main())
