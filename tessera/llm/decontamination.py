"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Items and documents are words; an item's windows are 13 words long, or the whole of a shorter item. A document holds a
window exactly if it holds all of the window's word shingles at fitting places, so one necessary shingle of each window
is enough to find every candidate: shingles are ordered by their rarity in the documents and only each window's rarest
one, its prefix, is joined. A candidate's place and length must fit the document, and its words are then compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, let, materialize

#: Fixed values of the contract.
WINDOW, HIT_FACTOR = 13, 20
#: What stands between words once A-Z are lower-cased: ASCII but for digits and a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words to a shingle; shorter items have shingles of their whole length.
SHINGLE = 3
#: A side of a join is broadcast if it was counted and has no more rows; else both sides are shuffled.
MAX_BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def shingles(words: Column, size: int) -> Column:
    """The key of every shingle, in order: place k holds the words k to k + size - 1."""
    none = F.array().cast("array<bigint>")
    return let(words, lambda w: F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size)))).otherwise(none))


def counted_shingles(text: Column, size: int) -> Column:
    return let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), shingles(w, size).alias("keys")))


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it was counted and is small, as it is beyond."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


def windows_of(items: DataFrame) -> DataFrame:
    """window (its words, space-joined), length, items (the ids of those that have it): each distinct window."""
    words = items.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(WINDOW))
    starts = F.sequence(F.lit(1), F.size("w") - length + 1)
    each = words.select("item_id", length.alias("length"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, length), " "))).alias("window"))
    return each.groupBy("window", "length").agg(F.collect_set("item_id").alias("items"))


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs, all columns as they came, with n_words, n_hit, n_items, items_sha256, contaminated and longest_hit, the words of
    the longest window that the document holds (which replace columns of docs by these names).

    A null or empty text has no words and is not hit; an item without words has no window, and one without an id hits
    words but is no item to name. Documents of an equal doc_id
    are judged each by its own text, repeated rows alike and each returned; a text of any length is read whole. An empty
    benchmark hits nothing.
    """
    added = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_hit"]
    own = [c for c in docs.columns if c not in added]
    # what the table has besides is held together, so that no name of it can clash with one of these
    keyed = docs.select(F.struct(*own).alias("row"), "doc_id", F.xxhash64("text", F.length("text")).alias("__text"))
    text = F.col("row.text")

    windows = materialize(windows_of(items))
    sizes = [r[0] for r in windows.select(F.least("length", F.lit(SHINGLE)).alias("s")).distinct().collect()]  # of 1, 2, 3
    if not sizes:
        sizes = [SHINGLE]
    parts = F.split("window", " ")
    # (window, shingle, its place in the window); of a shingle that a window repeats, every place would do, so the first
    necessary = None
    for s in sizes:
        at = windows.where(F.least("length", F.lit(SHINGLE)) == s)
        one = at.select("window", "length", "items", F.lit(s).alias("size"), F.posexplode(shingles(parts, s)).alias("place", "key"))
        necessary = one if necessary is None else necessary.unionByName(one)
    necessary = materialize(necessary)

    # every place of the documents where a shingle of the benchmark stands
    wanted = small(necessary.select("size", "key").distinct())
    found = None
    for s in sizes:
        cut = keyed.select("doc_id", "__text", counted_shingles(text, s).alias("__cut"))
        one = cut.select("doc_id", "__text", F.col("__cut.n").alias("n"), F.posexplode("__cut.keys").alias("pos", "key")).withColumn("size", F.lit(s))
        found = one if found is None else found.unionByName(one)
    found = materialize(found.join(wanted, ["size", "key"]))

    # the rarest shingle of each window is its prefix; shingles that no document has make it unmatched
    rarity = found.groupBy("size", "key").agg(F.count(F.lit(1)).alias("rarity"))
    ordered = Window.partitionBy("window").orderBy(F.coalesce("rarity", F.lit(0)), "key", "place")
    prefix = necessary.join(rarity, ["size", "key"], "left").withColumn("_k", F.row_number().over(ordered)).where((F.col("_k") == 1) & F.col("rarity").isNotNull())
    prefix = materialize(prefix.select("window", "length", "items", "size", "key", "place"))

    # positional and length bounds, then the candidates of each document together
    start = F.col("pos") - F.col("place")
    candidates = found.join(small(prefix), ["size", "key"]).where((start >= 0) & (start + F.col("length") <= F.col("n")))
    per_doc = candidates.groupBy("doc_id", "__text").agg(F.collect_set(F.struct(start.alias("start"), "length", "window", "items")).alias("__candidates"))

    # verification against the words themselves
    # struct order: by start, then length
    same_doc = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & F.col("d.__text").eqNullSafe(F.col("c.__text"))
    joined = keyed.alias("d").join(per_doc.alias("c"), same_doc, "left").select("d.*", "c.__candidates")
    exact = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.when(F.col("__candidates").isNotNull(), F.array_sort(F.filter("__candidates", lambda c: F.array_join(F.slice(w, c["start"] + 1, c["length"]), " ") == c["window"]))).alias("hits"),
        ),
    )
    checked = joined.withColumn("__exact", exact).withColumns({"n_words": F.col("__exact.n_words"), "__hits": F.col("__exact.hits")}).drop("__exact", "__candidates")
    state = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def cover(held: Column, hit: Column) -> Column:
        end = hit["start"] + hit["length"]
        return F.struct(F.greatest(held["end"], end).alias("end"), (held["n"] + F.greatest(F.lit(0), end - F.greatest(held["end"], hit["start"]))).alias("n"))

    covered = F.coalesce(F.aggregate("__hits", state, cover)["n"], F.lit(0)).cast("long")
    ids = F.array_distinct(F.flatten(F.transform("__hits", lambda h: h["items"])))
    ids = F.array_sort(F.transform(F.coalesce(ids, F.array().cast("array<bigint>")), lambda x: x.cast("string")))
    out = checked.withColumns({"n_hit": covered, "__ids": ids})
    return out.select(
        "row.*",
        "n_words",
        "n_hit",
        F.size("__ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("__ids", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (HIT_FACTOR * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("__hits", lambda h: h["length"])), F.lit(0)).cast("long").alias("longest_hit"),
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

OP9_SQL = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS length, array_to_string(list_slice(w, k, k + least(len(w), 13) - 1), ' ') AS win
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
lens AS (SELECT DISTINCT length FROM win),
places AS (SELECT doc_id, w, length, unnest(range(1, len(w) - length + 2)) AS k FROM d, lens WHERE len(w) >= length),
spans AS (SELECT doc_id, k, length, array_to_string(list_slice(w, k, k + length - 1), ' ') AS win FROM places),
hits AS (SELECT doc_id, k, spans.length, item_id FROM spans JOIN win USING (win) WHERE spans.length = win.length),
cover AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + length)) AS spot FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""
