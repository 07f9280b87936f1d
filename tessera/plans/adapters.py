"""The driver's tables as the canonical ones: documents as resources, events as catalog rows and samples, and so on."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.operators.keyword import Index
from tessera.plans import stored
from tessera.sources import catalog

#: Event types as sources of catalog rows.
EVENT_SOURCES = {"click": "tag:classification", "view": "query:data science", "signup": "tag:nlp", "purchase": "query:forecasting", "error": "tag:regression"}
PAGE_SPAN = 150
MODEL = ("hashing", "1", 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    toxic = labels.where("toxic = 1").select(F.col("doc_id").alias("_toxic")).distinct()
    title = F.substring_index("text", "\n", 1)
    return docs.join(toxic, docs.doc_id == toxic._toxic, "left").select(
        F.col("doc_id").alias("id"),
        title.alias("title"),
        F.lit(None).cast("string").alias("subtitle"),
        F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)").alias("description"),
        F.array("lang", "source").alias("tags"),
        F.col("source").alias("author"),
        F.col("n_chars").alias("size_bytes"),
        F.when(F.col("lang") == "en", "dataset").otherwise("notebook").alias("resource_type"),
        F.when(F.col("_toxic").isNotNull(), "unavailable").otherwise("active").alias("status"),
    )


RESOURCES_SQL = r"""resources AS (
  SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, substr(text, length(split_part(text, chr(10), 1)) + 2) AS description, lang, source, n_chars AS size_bytes,
         CASE WHEN lang = 'en' THEN 'dataset' ELSE 'notebook' END AS resource_type,
         CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'unavailable' ELSE 'active' END AS status FROM documents)"""

POSTS_SQL = r"""posts AS (
  SELECT id, status, resource_type, unnest(f).lexeme AS lexeme, unnest(f).weight AS weight, unnest(range(len(f))) AS pos FROM (
    SELECT id, status, resource_type, list_concat(list_concat(
      list_transform(list_filter(string_split_regex(lower(title), '[^\p{L}\p{N}]+'), lambda x: x <> ''), lambda x: {'lexeme': x, 'weight': 1.0::DOUBLE}),
      list_transform(list_filter(string_split_regex(lower(lang || ' ' || source), '[^\p{L}\p{N}]+'), lambda x: x <> ''), lambda x: {'lexeme': x, 'weight': 0.4::DOUBLE})),
      list_transform(list_filter(string_split_regex(lower(description), '[^\p{L}\p{N}]+'), lambda x: x <> ''), lambda x: {'lexeme': x, 'weight': 0.2::DOUBLE})) AS f FROM resources))"""

QUERIES_SQL = r"""q AS (SELECT item_id AS query_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark)"""


def indexed(spark: SparkSession, sf_dir: str) -> Index:
    """The stored index of resources, made anew only if their tables have changed."""
    return stored.once(spark, ("index", sf_dir), [f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet"], lambda path: Index.of(resources(spark, sf_dir)).stored(path), lambda path: Index.read(spark, path))


def query_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id and query, all words of each benchmark item, which serve as a set of queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), tokens(F.col("text")).alias("query")).where("size(query) > 0")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List rows of pages: out of order in time within a ref, some without title or url, some private."""
    e = table(spark, sf_dir, "events")
    source = F.create_map(*[F.lit(x) for kv in EVENT_SOURCES.items() for x in kv])[F.col("event_type")]
    tag = F.substring_index(source, ":", -1)
    even = F.col("event_id") % 2 == 0
    return e.select(
        source.alias("source"),
        F.lit("updated").alias("sort"),
        (F.floor(F.col("event_id") / PAGE_SPAN) + 1).cast("int").alias("page"),
        F.struct("value", "event_id").alias("seq"),
        F.concat(F.lit("u"), F.col("user_id")).alias("ref"),
        F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat(F.col("event_type"), F.when(F.col("event_id") % 7 == 0, " Cheat—Sheets").otherwise(" set"))).alias("title"),
        F.concat(F.lit("https://catalog.example/"), F.col("user_id")).alias("url"),
        F.when(even, F.col("props")).alias("subtitle"),
        F.lit(None).cast("string").alias("description"),
        F.when(F.col("event_id") % 3 == 0, F.array(F.upper(tag), F.col("event_type"))).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.when(F.col("event_id") % 5 == 0, F.col("event_type")).alias("author"),
        F.when(F.col("event_id") % 13 > 0, F.col("ts")).alias("last_updated"),
        F.get_json_object("props", "$.k").cast("long").alias("current_version_number"),
        F.lit(None).cast("long").alias("votes"),
        F.lit(None).cast("long").alias("downloads"),
        F.lit(None).cast("double").alias("usability_rating"),
        F.lit(None).cast("long").alias("size_bytes"),
        F.lit(None).cast("string").alias("license"),
        (F.col("event_id") % 19 == 0).alias("is_private"),
    )


ROWS_SQL = r"""rows AS (
  SELECT CASE event_type WHEN 'click' THEN 'tag:classification' WHEN 'view' THEN 'query:data science' WHEN 'signup' THEN 'tag:nlp' WHEN 'purchase' THEN 'query:forecasting' ELSE 'tag:regression' END AS source,
         CAST(event_id // 150 + 1 AS INTEGER) AS page, value, event_id, 'u' || user_id AS ref,
         CASE WHEN event_id % 11 = 0 THEN '' ELSE event_type || CASE WHEN event_id % 7 = 0 THEN ' Cheat—Sheets' ELSE ' set' END END AS title,
         'https://catalog.example/' || user_id AS url, CASE WHEN event_id % 2 = 0 THEN props END AS subtitle, event_type,
         CASE WHEN event_id % 3 = 0 THEN [event_type] ELSE [] END AS tags, CASE WHEN event_id % 5 = 0 THEN event_type END AS author,
         CASE WHEN event_id % 13 > 0 THEN ts END AS last_updated, CAST(json_extract_string(props, '$.k') AS BIGINT) AS current_version_number, event_id % 19 = 0 AS is_private FROM events),
valid AS (SELECT * FROM rows WHERE title <> '' AND NOT is_private)"""


#: The page from which on earlier runs know a source's rows, by event type.
KNOWN_FROM = "length(event_type) - 1"
LISTED_SQL = f"""listed AS (SELECT CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_SOURCES.items())} END AS source, event_id, ts, event_id // {PAGE_SPAN} + 1 AS page, event_id % 11 > 0 AND event_id % 19 > 0 AS valid, {KNOWN_FROM} AS known_from FROM events)"""


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of list pages: a record each, its ref being its own."""
    e = table(spark, sf_dir, "events")
    source = F.create_map(*[F.lit(x) for kv in EVENT_SOURCES.items() for x in kv])[F.col("event_type")]
    record = F.to_json(
        F.struct(
            F.concat(F.lit("e/"), F.col("event_id")).alias("ref"),
            F.when(F.col("event_id") % 11 == 0, "").otherwise(F.col("event_type")).alias("title"),
            F.array(F.substring_index(source, ":", -1)).alias("tags"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("lastUpdated"),
            F.lit(1).alias("currentVersionNumber"),
            (F.col("event_id") % 19 == 0).alias("isPrivate"),
        )
    )
    return e.select(source.alias("source"), (F.floor(F.col("event_id") / PAGE_SPAN) + 1).cast("int").alias("page"), F.col("event_id").alias("position"), record.alias("record"), "ts", F.expr(KNOWN_FROM).alias("known_from"))


def put_pages(rows: DataFrame, folder: str) -> None:
    """Rows (source, page, position, record) as files of list pages, written by the tasks. A task is sent its rows in the
    order of their pages and holds a batch of rows and one page, however many pages it writes."""
    where = catalog.located(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, home = FileSystem.from_uri(where)
        told = chain.from_iterable(zip(*(b.column(c).to_pylist() for c in ("source", "page", "record")), strict=True) for b in batches)
        written = 0
        for (source, page), own in groupby(told, itemgetter(0, 1)):  # a page may go on in the next batch
            path = f"{home}/{catalog.folder_name(source, 'updated')}"
            files.create_dir(path, recursive=True)
            with files.open_output_stream(f"{path}/{page}.json") as f:  # a task that runs again writes the same
                f.write(f"[{','.join(record for *_, record in own)}]".encode())
            written += 1
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["pages"])

    dealt = rows.select("source", "page", "position", "record").repartition("source", "page").sortWithinPartitions("source", "page", "position", "record")
    dealt.mapInArrow(write, "pages long").write.format("noop").mode("overwrite").save()


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples of acquisition methods."""
    e = table(spark, sf_dir, "events")
    ok = F.col("event_id") % F.when(F.col("event_type") == "click", 10**9).otherwise(23) > 0
    latency = F.round(F.col("value") * 10).cast("long")
    return e.select(
        F.col("event_type").alias("method"),
        F.when(ok, "ok").otherwise("error").alias("status"),
        latency.alias("latency_ms"),
        F.when(ok, 13 - F.col("event_id") % 4).otherwise(0).cast("long").alias("populated"),
        F.lit(60_000.0).alias("wall_ms"),
    )


SAMPLES_SQL = r"""samples AS (
  SELECT event_type AS method, CASE WHEN event_id % CASE WHEN event_type = 'click' THEN 1000000000 ELSE 23 END > 0 THEN 'ok' ELSE 'error' END AS status,
         CAST(round(value * 10) AS BIGINT) AS latency_ms, event_id FROM events)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as judged results: the label is that of the labels table, some are unlabelled."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    label = F.when(F.col("quality").isNull(), None).when((F.col("quality") == 1) & (F.col("toxic") == 0), "Relevant").when(F.col("quality") == 1, "Partially Relevant").otherwise("Irrelevant")
    rows = d.join(lab, "doc_id", "left").withColumn("relevance_label", label)
    of = lambda m, keep, rank: rows.where(keep).select(
        (F.col("doc_id") % 24).alias("query_id"), F.lit(m).alias("method"), rank.cast("long").alias("rank"), F.col("doc_id").alias("resource_id"), "relevance_label", (F.col("doc_id") * 3 + {"keyword": 0, "semantic": 1, "hybrid": 2}[m]).alias("seq")
    )
    i = F.col("doc_id")
    return of("keyword", i % 2 == 0, i).unionByName(of("semantic", i % 3 == 0, -i)).unionByName(of("hybrid", i % 5 < 4, i % 101))


JUDGED_SQL = r"""lab AS (SELECT doc_id, CASE WHEN quality IS NULL THEN NULL WHEN quality = 1 AND toxic = 0 THEN 'Relevant' WHEN quality = 1 THEN 'Partially Relevant' ELSE 'Irrelevant' END AS relevance_label
         FROM documents LEFT JOIN labels USING (doc_id)),
judged AS (SELECT doc_id % 24 AS query_id, 'keyword' AS method, doc_id AS rank, doc_id AS resource_id, relevance_label FROM lab WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id % 24, 'semantic', -doc_id, doc_id, relevance_label FROM lab WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id % 24, 'hybrid', doc_id % 101, doc_id, relevance_label FROM lab WHERE doc_id % 5 < 4)"""


def file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files of a ref: the path comes from the url, the extension from the page's number."""
    p = table(spark, sf_dir, "pages")
    exts = [".csv", ".TSV", ".arff", ".xlsx", ".db", ".parquet", ".zip", "", ".txt", ".tar.gz"]
    ext = F.element_at(F.array(*[F.lit(x) for x in exts]), (F.col("page_id") % 10 + 1).cast("int"))
    path = F.concat(F.when(F.col("page_id") % 4 == 0, "data/").otherwise(""), F.lit("part"), F.col("page_id"), ext)
    return p.select(F.concat(F.lit("r"), F.floor(F.col("page_id") / 25)).alias("ref"), F.col("page_id").alias("position"), path.alias("path"), (F.length("html") * 37).cast("long").alias("size"), F.encode("html", "utf-8").alias("content"))


FILES_SQL = r"""files AS (SELECT 'r' || CAST(page_id // 25 AS VARCHAR) AS ref, page_id AS position, length(html) * 37 AS size,
  CASE WHEN page_id % 4 = 0 THEN 'data/' ELSE '' END || 'part' || page_id || ['.csv', '.TSV', '.arff', '.xlsx', '.db', '.parquet', '.zip', '', '.txt', '.tar.gz'][page_id % 10 + 1] AS path,
  ['csv', 'tsv', 'arff', 'xlsx', 'sqlite', 'parquet', 'archive', 'unknown', 'txt', 'archive'][page_id % 10 + 1] AS format FROM pages)"""
