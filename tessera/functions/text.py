"""Text functions as Column expressions; Python runs only where a text is not ASCII and must be normalised."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: White space as Unicode has it, with the four separators x1c to x1f.
SPACE = r"(?U)[\s\x1c-\x1f]+"
#: The dashes that count as spaces in filter texts.
DASHES = "-‐‑‒–—"
DESCRIPTION_LIMIT = 1200
WORD_BREAK = r"[^\p{L}\p{N}]+"


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def _nfkc_list(lists: pd.Series) -> pd.Series:
    return lists.map(lambda x: [None if t is None else unicodedata.normalize("NFKC", t) for t in x], na_action="ignore")


def nfkc_list(texts: Column) -> Column:
    """The same for each text of a list: no Python can run inside a lambda."""
    whole = F.array_join(texts, "")
    plain = F.length(whole) == F.octet_length(whole)
    return F.when(plain, texts).otherwise(_nfkc_list(F.when(~plain, texts)))


def nfkc(text: Column) -> Column:
    """Compatibility composition. ASCII stays in the JVM: it is its own normal form. Python has every row, whatever the
    condition, so that what it does not need is null there."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, text).otherwise(_nfkc(F.when(~plain, text)))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normalize(text: Column) -> Column:
    """NFKC, white space to single spaces, trimmed; null to the empty text."""
    return collapse(nfkc(F.coalesce(text, F.lit(""))))


def filter_text(text: Column) -> Column:
    """For term filters: lower-case words with single spaces, dashes and other marks being spaces."""
    return filter_words(nfkc(F.coalesce(text, F.lit(""))))


def filter_words(composed: Column) -> Column:
    return collapse(F.regexp_replace(F.regexp_replace(F.lower(composed), f"[{DASHES}]+", " "), r"(?U)[^\w\s]+", " "))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_replace(text, r"^" + SPACE, ""), SPACE + "$", ""), F.lit(""))


def has_word(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{N}]")


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK), "")


def semantic_document(title: Column, subtitle: Column, tags: Column, description: Column) -> Column:
    """What is embedded: a labelled line for each part that is not empty."""
    listed = F.array_join(F.filter(F.transform(nfkc_list(F.coalesce(tags, F.array().cast("array<string>"))), lambda t: collapse(F.coalesce(t, F.lit("")))), lambda t: t != ""), ", ")
    parts = {"title": normalize(title), "subtitle": normalize(subtitle), "tags": listed, "description": F.substring(normalize(description), 1, DESCRIPTION_LIMIT)}
    return F.concat_ws("\n", *[F.when(value != "", F.concat(F.lit(f"{name}: "), value)) for name, value in parts.items()])


def content_hash(document: Column) -> Column:
    return F.sha2(document, 256)


def display(text: Column, limit: int) -> Column:
    """For a table cell: cut, with marks escaped; the empty text is shown as such."""
    full = F.when(F.coalesce(text, F.lit("")) == "", "(empty)").otherwise(text)
    cut = F.when(F.length(full) > limit, F.concat(F.substring(full, 1, limit), F.lit("…"))).otherwise(full)
    for old, new in (("\\", "\\\\"), ("|", "\\|"), ("\r", "↵"), ("\n", "↵")):
        cut = F.replace(cut, F.lit(old), F.lit(new))
    return cut


def file_format(path: Column) -> Column:
    """From the extension of the last part of a path; a leading dot is no extension, nor is a trailing one."""
    base = F.regexp_extract(F.rtrim(F.coalesce(path, F.lit("")), F.lit("/")), r"([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(base, r"^.*[^.].*\.([^.]+)$|^[^.]+\.([^.]+)$", 0))
    suffix = F.when(suffix != "", F.lower(F.regexp_extract(base, r"\.([^.]+)$", 1))).otherwise("")
    # fixed values: extensions that share a format
    known = F.when(suffix.isin("sqlite", "db", "sqlite3"), "sqlite").when(suffix.isin("zip", "gz", "gzip", "tar", "7z"), "archive")
    return known.when(suffix == "", "unknown").otherwise(suffix)
