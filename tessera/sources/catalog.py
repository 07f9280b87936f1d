"""Catalog pages as a Spark data source, for batches and for streams.

Offline, pages are JSON files in a folder of any file system that Arrow reads: <folder>/<kind>_<value>_<sort>/<page>.json,
each a list of records. Online, a transport does the same over HTTP. What a page could not give is told in its row, and
ends its pass only.

All pages of a read, of whatever pass, are asked for by one client in one task: the delay between requests, and a server's
wish to be left alone, then hold for the whole run and not for each task. A batch reads each pass up to a page that is not
full. A stream asks for a page of a pass only when the page before has been judged (streaming/pages_stream.py).
"""

from __future__ import annotations

import email.utils
import json
import os
import random
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tessera.operators.sync import PAGE_SIZE, SOURCES, retry_delay, select_sources, sorts_of

PAGE_SCHEMA = "source string, sort string, page int, position int, record string, http_status int, latency_ms long, retry_count int, error string"


class TransientError(Exception):
    """A request failed after all attempts."""

    def __init__(self, message: str, http_status: int | None = None, retry_count: int = 0):
        super().__init__(message)
        self.http_status, self.retry_count = http_status, retry_count


@dataclass(frozen=True)
class Config:
    """How often and how patiently pages are asked for."""

    bootstrap_page_limit: int = 20
    retry_max_attempts: int = 5
    timeout_seconds: float = 30.0
    backoff_base_seconds: float = 2.0
    rate_limit_backoff_seconds: float = 180.0
    request_delay_seconds: float = 0.8

    @classmethod
    def from_env(cls, prefix: str = "CATALOG_SYNC_") -> Config:
        made = cls(**{f: type(getattr(cls, f))(os.environ[prefix + f.upper()]) for f in cls.__dataclass_fields__ if prefix + f.upper() in os.environ})
        if made.bootstrap_page_limit < 1 or made.retry_max_attempts < 1:
            raise ValueError("page limit and attempts must be positive")
        if min(made.timeout_seconds, made.backoff_base_seconds, made.rate_limit_backoff_seconds, made.request_delay_seconds) < 0:
            raise ValueError("times cannot be negative")
        return made


@dataclass(frozen=True)
class Response:
    payload: object
    status: int
    latency_ms: int


def http_transport(url: str, timeout: float, token: str | None = None) -> Response:
    request = urllib.request.Request(url, headers={"Accept": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {}))
    began = time.monotonic()
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return Response(json.loads(answer.read()), answer.status, int((time.monotonic() - began) * 1000))


def wanted_delay(header: str | None) -> float | None:
    """Seconds that a Retry-After header asks for, as a number or a date; null if it is neither."""
    if not header:
        return None
    try:
        return max(0.0, float(header))
    except ValueError:
        pass
    try:
        when = email.utils.parsedate_to_datetime(header)
    except (TypeError, ValueError, OverflowError):
        return None
    when = when if when.tzinfo else when.replace(tzinfo=UTC)
    return max(0.0, (when - datetime.now(UTC)).total_seconds())


class Client:
    """Pages and details over a transport, with patience for what may pass."""

    def __init__(self, base_url: str, config: Config, transport: Callable = http_transport, token: str | None = None, sleep: Callable = time.sleep, jitter: Callable = random.random):
        self.base_url, self.config, self.transport, self.token, self.sleep, self.jitter = base_url.rstrip("/"), config, transport, token, sleep, jitter

    def page(self, source: str, sort: str, page: int) -> tuple[list, Response, int]:
        kind, value = source.split(":", 1)
        asked = urllib.parse.urlencode({"sortBy": sort, "page": page, ("tagids" if kind == "tag" else "search"): value})
        answer, retries = self.get(f"{self.base_url}/datasets/list?{asked}")
        if not isinstance(answer.payload, list):
            raise ValueError("a page must be a list")
        return answer.payload, answer, retries

    def detail(self, ref: str) -> tuple[dict, int]:
        answer, retries = self.get(f"{self.base_url}/datasets/view/{urllib.parse.quote(ref, safe='/')}")
        if not isinstance(answer.payload, dict):
            raise ValueError("a detail must be an object")
        return answer.payload, retries

    def get(self, url: str) -> tuple[Response, int]:
        c = self.config
        for attempt in range(1, c.retry_max_attempts + 1):
            self.sleep(c.request_delay_seconds)
            status, asked = None, None
            try:
                return self.transport(url, c.timeout_seconds, self.token), attempt - 1
            except urllib.error.HTTPError as e:
                status = e.code
                if status != 429 and status < 500:
                    raise
                asked, last = wanted_delay(e.headers.get("Retry-After") if e.headers else None), e
            except (TimeoutError, urllib.error.URLError, ConnectionError) as e:
                last = e
            if attempt < c.retry_max_attempts:
                self.sleep(retry_delay(attempt, asked, c.backoff_base_seconds, c.rate_limit_backoff_seconds, status == 429, self.jitter()))
        raise TransientError(str(last), status, c.retry_max_attempts - 1) from last


def folder_name(source: str, sort: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", source.lower()) + f"_{sort}"


class Pages:
    """Rows of pages, by a client or from a folder; one of them serves a task, so that its pace is that of all requests."""

    def __init__(self, options: dict):
        self.client = Client(options["url"], Config.from_env(), token=options.get("token")) if "url" in options else None
        if self.client is None:
            self.files, self.home = FileSystem.from_uri(located(options["path"]))

    def rows(self, source: str, sort: str, page: int) -> tuple[list[tuple], bool]:
        """The rows of a page in PAGE_SCHEMA, one at least, and whether another page may follow."""
        try:
            items, answer, retries = self.client.page(source, sort, page) if self.client else self._stored(source, sort, page)
        except TransientError as e:
            return [(source, sort, page, None, None, e.http_status, None, e.retry_count, str(e)[:1000])], False
        told = [(source, sort, page, k, json.dumps(item), answer.status, answer.latency_ms, retries, None) for k, item in enumerate(items)]
        return told or [(source, sort, page, None, None, answer.status, answer.latency_ms, retries, None)], len(items) >= PAGE_SIZE

    def _stored(self, source: str, sort: str, page: int) -> tuple[list, Response, int]:
        """A page beyond the last file of its pass is empty; one that is missing before it cannot be had."""
        folder = f"{self.home}/{folder_name(source, sort)}"
        try:
            with self.files.open_input_stream(f"{folder}/{page}.json") as f:
                return json.loads(f.read()), Response([], 200, 0), 0
        except FileNotFoundError:
            found = self.files.get_file_info(FileSelector(folder, allow_not_found=True))
            if any(f.base_name.endswith(".json") and int(f.base_name[:-5]) > page for f in found):
                raise TransientError(f"page {page} is missing in {folder}") from None
            return [], Response([], 200, 0), 0


def located(path: str) -> str:
    """A path as a URI; one without a scheme is on the local file system."""
    return path if re.match(r"[a-z][a-z0-9+.-]*:", path) else Path(path).absolute().as_uri()


@dataclass
class Asked(InputPartition):
    """(source, sort, first page, last page) of each pass; a batch has no last page."""

    passes: list[tuple[str, str, int, int | None]]


def passes_of(options: dict) -> list[tuple[str, str]]:
    """Each source that the option names (several with commas between; all, if none) with each sort of the mode."""
    named = options["source"].split(",") if options.get("source") else [None]
    return [(s, sort) for key in named for s in select_sources(key) for sort in sorts_of(options.get("mode", "incremental"))]


def read_pages(options: dict, asked: Asked) -> Iterator[tuple]:
    pages = Pages(options)
    for source, sort, first, last in asked.passes:
        page, more = first, True
        while more and (last is None or page <= last):
            rows, more = pages.rows(source, sort, page)
            yield from rows
            page += 1


class PagesReader(DataSourceReader):
    """Every page of each pass up to one that is not full, or up to the option pagelimit."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[Asked]:
        limit = self.options.get("pagelimit")
        return [Asked([(source, sort, 1, int(limit) if limit else None) for source, sort in passes_of(self.options)])]

    def read(self, partition: Asked) -> Iterator[tuple]:
        return read_pages(self.options, partition)


class PagesStreamReader(DataSourceStreamReader):
    """An offset is the number of pages that each pass has been asked for. The next one has one page more of each pass that
    goes on, by what the option judged, a folder, tells of the pages so far."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def initialOffset(self) -> dict:
        return {f"{source}|{sort}": 0 for source, sort in passes_of(self.options)}

    def latestOffset(self) -> dict:
        judged = judged_pages(self.options["judged"])
        ends = {}
        for key in self.initialOffset():
            page, ended = judged.get(key, (0, False))
            ends[key] = page if ended else page + 1
        return ends

    def partitions(self, start: dict, end: dict) -> list[Asked]:
        asked = [(*key.split("|"), start.get(key, 0) + 1, last) for key, last in end.items() if last > start.get(key, 0)]
        return [Asked(asked)]

    def read(self, partition: Asked) -> Iterator[tuple]:
        return read_pages(self.options, partition)

    def commit(self, end: dict) -> None:
        pass


def judged_pages(folder: str) -> dict[str, tuple[int, bool]]:
    """(last page, whether the pass has ended) by pass, of the last batch that has judged its pages."""
    files, home = FileSystem.from_uri(located(folder))
    done = [f.path for f in files.get_file_info(FileSelector(home, allow_not_found=True)) if f.base_name.startswith("batch=")]
    for path in sorted(done, key=lambda p: int(p.rsplit("=", 1)[1]), reverse=True):
        if files.get_file_info(f"{path}/_SUCCESS").type != FileType.NotFound:
            t = pq.read_table(path, filesystem=files, partitioning=None).to_pylist()
            return {f"{r['source']}|{r['sort']}": (r["page"], r["ended"]) for r in t}
    return {}


class CatalogPages(DataSource):
    """spark.dataSource.register(CatalogPages); spark.read.format("catalog_pages").option("path" or "url", ...).load()"""

    @classmethod
    def name(cls) -> str:
        return "catalog_pages"

    def schema(self) -> str:
        return PAGE_SCHEMA

    def reader(self, schema) -> PagesReader:
        return PagesReader(self.options)

    def streamReader(self, schema) -> PagesStreamReader:
        return PagesStreamReader(self.options)


# -- records --------------------------------------------------------------------------------------------------------


def _text(record: Column, *names: str) -> Column:
    """The first of the fields that is not empty."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(record, f"$.{n}")), F.lit("")) for n in names])


def _present(record: Column, *names: str) -> Column:
    return F.coalesce(*[F.get_json_object(record, f"$.{n}") for n in names])


def _number(value: Column, kind: str) -> Column:
    filled = F.nullif(value, F.lit(""))
    # whole numbers keep all their digits; a fraction is cut off
    whole = F.when(filled.rlike(r"^\s*[+-]?\d+\s*$"), filled.cast("decimal(38,0)").cast("long")).otherwise(filled.cast("double").cast("long"))
    return whole if kind == "long" else filled.cast("double")


def _labels(record: Column, name: str) -> Column:
    """A list of texts, or of objects with a ref or a name."""
    items = F.from_json(F.get_json_object(record, f"$.{name}"), "array<string>")
    one = lambda t: F.when(F.ltrim(t).startswith("{"), F.coalesce(F.nullif(F.get_json_object(t, "$.ref"), F.lit("")), F.get_json_object(t, "$.name"))).otherwise(t)
    named = F.filter(F.transform(items, one), lambda t: t.isNotNull() & (t != ""))
    return F.when(F.size(items) > 0, named)


def arrival() -> Column:
    """The place of a row in the order in which passes are run: by source, then sort, page and position."""
    source = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source"))
    sort = F.array_position(F.array(*[F.lit(s) for s in sorts_of("bootstrap")]), F.col("sort"))
    return F.struct(source.alias("source"), sort.alias("sort"), "page", "position")


def asked_pages(pages: DataFrame) -> DataFrame:
    """A row for each page that was asked for, with or without records: whether it failed, and what the answer was like."""
    return pages.groupBy("source", "sort", "page").agg(
        F.bool_or(F.col("error").isNotNull()).alias("failed"),
        F.count("record").alias("raw_count"),
        F.max("http_status").alias("http_status"),
        F.max("latency_ms").alias("latency_ms"),
        F.max("retry_count").alias("retry_count"),
        F.first("error", ignorenulls=True).alias("error"),
    )


def details(refs: DataFrame, options: dict) -> DataFrame:
    """ref, record (JSON), error and latency_ms of each ref's detail: over HTTP (url), or from a folder (path), where
    details/<ref with / as __>.json has it. Tasks ask in parallel; spread the refs over one for one pace of all requests."""

    def one(pages: Pages, ref: str) -> tuple[str | None, str | None]:
        try:
            if pages.client is not None:
                return json.dumps(pages.client.detail(ref)[0]), None
            with pages.files.open_input_stream(f"{pages.home}/details/{ref.replace('/', '__')}.json") as f:
                found = json.loads(f.read())
            if not isinstance(found, dict):
                raise ValueError("a detail must be an object")
            return json.dumps(found), None
        except Exception as e:  # noqa: BLE001  a detail that cannot be had is told of, and asked for again next time
            return None, f"{type(e).__name__}: {e}"[:1000]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pages = Pages(options)
        for b in batches:
            records, errors, times = [], [], []
            for ref in b.column("ref").to_pylist():
                began = time.monotonic()
                record, error = one(pages, ref)
                records.append(record)
                errors.append(error)
                times.append(int(1000 * (time.monotonic() - began)))
            columns = [b.column("ref"), pa.array(records, pa.string()), pa.array(errors, pa.string()), pa.array(times, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["ref", "record", "error", "latency_ms"])

    return refs.select("ref").mapInArrow(run, "ref string, record string, error string, latency_ms long")


def detail_records(found: DataFrame, fields: list[tuple[str, str]], base_url: str = "https://catalog.example/datasets/") -> DataFrame:
    """details() as ref, detail (a struct of the fields, null if there is none) and error."""
    pages = found.select(F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("sort"), F.lit(0).alias("page"), F.lit(0).alias("position"), "record", F.col("ref").alias("asked"), "error")
    parsed = records(pages, base_url, "asked").select(F.col("asked").alias("ref"), F.struct(*[F.col(name).cast(kind).alias(name) for name, kind in fields]).alias("detail"))
    return found.select("ref", "error").join(parsed, "ref", "left")


def records(pages: DataFrame, base_url: str = "https://catalog.example/datasets/", *more: str) -> DataFrame:
    """Rows of pages with a record as canonical rows, in the schema that sync works on, with more of their columns. What
    became of pages without one, asked_pages() tells."""
    return canonical(pages.where("record IS NOT NULL"), base_url, *more)


def canonical(pages: DataFrame, base_url: str = "https://catalog.example/datasets/", *more: str) -> DataFrame:
    """Like records(), with rows that have no record, which are empty and valid by no rule."""
    r = F.col("record")
    ref = F.coalesce(_text(r, "ref"), _text(r, "id"), F.lit(""))
    license_ = F.coalesce(_text(r, "licenseName"), F.try_element_at(_labels(r, "licenses"), F.lit(1)))
    id_ = F.get_json_object(r, "$.id")
    return pages.select(
        *more,
        "source",
        "sort",
        "page",
        arrival().alias("seq"),
        ref.alias("ref"),
        F.when(id_.rlike(r"^-?\d+$"), id_.cast("long")).alias("catalog_id"),
        F.coalesce(F.get_json_object(r, "$.title"), F.lit("")).alias("title"),
        F.coalesce(_text(r, "url"), F.when(ref != "", F.concat(F.lit(base_url), ref)), F.lit("")).alias("url"),
        _text(r, "subtitle").alias("subtitle"),
        _text(r, "description").alias("description"),
        F.coalesce(_labels(r, "tags"), _labels(r, "keywords"), F.array().cast("array<string>")).alias("tags"),
        _text(r, "ownerName", "ownerRef", "creatorName").alias("author"),
        F.to_timestamp_ntz(F.regexp_replace(_text(r, "lastUpdated", "updatedAt"), r"(Z|[+]00:00)$", "")).alias("last_updated"),
        _number(_present(r, "currentVersionNumber"), "long").alias("current_version_number"),
        _number(_present(r, "voteCount", "votes"), "long").alias("votes"),
        _number(_present(r, "downloadCount", "downloads"), "long").alias("downloads"),
        _number(_present(r, "usabilityRating"), "double").alias("usability_rating"),
        _number(_present(r, "totalBytes", "size"), "long").alias("size_bytes"),
        license_.alias("license"),
        F.coalesce(F.get_json_object(r, "$.isPrivate").cast("boolean"), F.lit(False)).alias("is_private"),
    )
