"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest
ancestor directory that has a licence file, by joins on paths.

A text is compared with a template by its windows of as many consecutive terms as the template has (a shorter text is one
window); line breaks, comment marks and punctuation are no terms, so notices may be wrapped and indented in any way. A
window at the threshold or above holds one of the template's rarest terms, its prefix, so that only windows around those
are scored, each from the one before it. What a cosine hardly sees decides apart from it: numbers of versions, the words
that tell licences of a family apart, and negations.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.llm.license_texts import HEADS, templates

TEMPLATES = templates()
#: A window is a template's if their cosine is this or more.
THRESHOLD = 0.8
#: A file of which licence windows hold this share of the terms is a licence file of its directory, as is one so named.
FILE_SHARE = 0.5
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([.-][^/]*)?$"
#: Up to so many directories are broadcast, once counted; beyond, both sides are shuffled.
MAX_BROADCAST_ROWS = 200_000
#: A file that begins with a template of how licence files begin, within so many terms, is one too.
HEAD_TERMS = 40
#: Words that tell licences of a family apart: a window has those of its template and no others.
DECIDING = frozenset("lesser library affero sa nc nd sharealike noncommercial noderivatives endorse lgpl agpl gpl".split())
#: Words that name a licence: a window has those of its template.
NAMING = frozenset("apache mit bsd mozilla eclipse isc zlib boost gnu creative commons zero unlicense artistic documentation".split())
#: Words that turn a short phrase into its opposite, in it or up to REACH terms before it.
NEGATIONS = frozenset("not never no nor neither cannot isn wasn aren without instead unlike".split())
SHORT, REACH = 24, 3
#: What counts only where no licence is named.
LAST = "proprietary"

_TERM = re.compile(r"[a-z]+|\d+")
_SPELLING = {"licence": "license", "licenced": "licensed", "licences": "licenses"}


def terms(text: str) -> list[str]:
    return [_SPELLING.get(t, t) for t in _TERM.findall(text.lower())]


class Template:
    """A template's terms as a sparse vector. prefix: its rarest terms; a window without any stays below the threshold."""

    __slots__ = ("name", "size", "weights", "norm", "prefix", "numbers", "deciding", "naming", "negations", "short", "head")

    def __init__(self, name: str, found: list[str], idf: dict[str, float], head: bool = False):
        self.head = head
        counts = Counter(found)
        self.name, self.size = name, len(found)
        self.weights = {t: _tf(n) * idf[t] for t, n in counts.items()}
        self.norm = math.sqrt(sum(w * w for w in self.weights.values()))
        self.prefix: set[str] = set()
        left = self.norm**2
        for t, w in sorted(self.weights.items(), key=lambda x: (-x[1], x[0])):
            if left < (THRESHOLD * self.norm) ** 2:
                break
            self.prefix.add(t)
            left -= w * w
        self.numbers = {t for t in counts if t.isdigit()}
        self.deciding = DECIDING.intersection(counts)
        self.naming = NAMING.intersection(counts)
        self.negations = sum(counts[t] for t in NEGATIONS)
        self.short = self.size <= SHORT

    def admits(self, found: list[str], low: int, high: int) -> bool:
        """What decides apart from the cosine."""
        window = set(found[low:high])
        if not self.numbers <= window or not self.naming <= window or DECIDING.intersection(window) != self.deciding:
            return False
        return not self.short or sum(t in NEGATIONS for t in found[max(0, low - REACH) : high]) <= self.negations


def _tf(n: int) -> float:
    return 1 + math.log(n) if n else 0.0


class Scanner:
    """Templates behind the lists of their prefix terms. frequencies: in how many of all texts each term of a template
    stands; a term of no template counts as found in one text."""

    def __init__(self, given: tuple[tuple[str, str], ...], frequencies: dict[str, int], texts: int):
        self.unseen = math.log((1 + texts) / 2) + 1
        idf = {t: math.log((1 + texts) / (1 + n)) + 1 for t, n in frequencies.items()}
        split = [(name, terms(text)) for name, text in given]
        self.idf = {t: idf.get(t, self.unseen) for _, found in split for t in found} | idf
        heads = {(name, text) for name, text in HEADS}
        self.templates = [Template(name, found, self.idf, pair in heads) for pair, (name, found) in zip(given, split, strict=True)]
        self.prefix: dict[str, list[int]] = {}
        for k, template in enumerate(self.templates):
            for t in template.prefix:
                self.prefix.setdefault(t, []).append(k)

    def windows(self, found: list[str], template: Template, starts: list[tuple[int, int]]) -> Iterator[tuple[float, int]]:
        """(cosine, start) of the windows that start in these ranges, low to high - 1; each from the one before it."""
        size = min(template.size, len(found))
        for low, high in starts:
            counts = Counter(found[low : low + size])
            dot = square = 0.0
            for t, n in counts.items():
                w = _tf(n) * self.idf.get(t, self.unseen)
                dot += w * template.weights.get(t, 0.0)
                square += w * w
            yield dot / (math.sqrt(square) * template.norm), low
            for at in range(low + 1, high):
                for t, step in ((found[at - 1], -1), (found[at + size - 1], 1)):
                    n, idf = counts[t], self.idf.get(t, self.unseen)
                    old, new = _tf(n) * idf, _tf(n + step) * idf
                    counts[t] = n + step
                    dot += (new - old) * template.weights.get(t, 0.0)
                    square += new * new - old * old
                yield dot / (math.sqrt(max(square, 1e-12)) * template.norm), at

    def scan(self, text: str) -> tuple[str | None, float, float]:
        """The licence of the best window, its cosine, and the share of terms in windows of licences. The cosine is 0
        where no window reaches the threshold. How a licence file begins comes before all that it says further on (of other
        licences, or how to apply it), and such a file is all licence."""
        low = text.lower()
        # most texts hold no prefix term; their terms are not kept
        if self.prefix.keys().isdisjoint(_TERM.findall(low)):
            return None, 0.0, 0.0
        found = [_SPELLING.get(t, t) for t in _TERM.findall(low)]
        places: dict[int, list[int]] = {}
        for at, t in enumerate(found):
            for k in self.prefix.get(t, ()):
                places.setdefault(k, []).append(at)
        best: tuple[bool, bool, float, int] | None = None
        held = bytearray(len(found))
        for k, spots in sorted(places.items()):
            template = self.templates[k]
            size = min(template.size, len(found))
            starts: list[tuple[int, int]] = []
            for at in spots:  # every window with the term, none twice
                a, b = max(0, at - size + 1), min(at, len(found) - size) + 1
                if starts and a <= starts[-1][1]:
                    starts[-1] = (starts[-1][0], b)
                else:
                    starts.append((a, b))
            for score, at in self.windows(found, template, starts):
                if score >= THRESHOLD and template.admits(found, at, at + size):
                    held[at : at + size] = b"\1" * size
                    rank = (template.head and at < HEAD_TERMS, template.name != LAST, round(score, 9), -k)
                    best = rank if best is None or rank > best else best
        if best is None:
            return None, 0.0, 0.0
        return self.templates[-best[3]].name, best[2], 1.0 if best[0] else sum(held) / len(found)


def frequencies(files: DataFrame, templates: tuple[tuple[str, str], ...]) -> tuple[dict[str, int], int]:
    """In how many of all texts each term of a template stands, and how many texts there are."""
    wanted = frozenset(t for _, text in templates for t in terms(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for t in b.column("text"):
                counts[""] += 1
                counts.update(wanted.intersection(terms(t.as_py())) if t.is_valid else ())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    found = {r[0]: r[1] for r in files.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n")).collect()}  # a row for each term
    return {t: found.get(t, 0) for t in wanted}, found.get("", 0)


def scanned(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """files (doc_id, text and, where files have one, path) as doc_id, path, license, score, origin (own, inherited or
    none) and inherited_from. Without a column path there is nothing to inherit along, and no stage for it.

    A file's own licence comes before that of its nearest ancestor directory with a licence file; of several such files
    in a directory, that with the best score and then the least path and doc_id. A null or empty text has no own licence,
    a null path no ancestors; a text of any length is read whole. score is the best cosine, 0 where none reaches THRESHOLD.
    Repeated rows are judged alike and each returned. Other columns are ignored. An empty table gives no rows.
    """
    has_path = "path" in files.columns
    if not has_path:
        files = files.withColumn("path", F.lit(None).cast("string"))
    counts, texts = frequencies(files, templates)
    sent = files.sparkSession.sparkContext.broadcast(Scanner(templates, counts, texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sent.value.scan(t.as_py() or "") for t in b.column("text")]
            names, scores, shares = zip(*found, strict=True) if found else ((), (), ())
            columns = [pa.array(names, pa.string()), pa.array([round(s, 6) for s in scores], pa.float64()), pa.array(shares, pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("path"), *columns], ["doc_id", "path", "own", "score", "share"])

    own = files.select("doc_id", "path", "text").mapInArrow(run, "doc_id long, path string, own string, score double, share double")
    if not has_path:
        origin = F.when(F.col("own").isNotNull(), "own").otherwise("none").alias("origin")
        return own.select("doc_id", "path", F.col("own").alias("license"), "score", origin, F.lit(None).cast("string").alias("inherited_from"))
    own = materialize(own)
    folder = F.coalesce(F.regexp_extract("path", r"(?s)^(.*)/[^/]*$", 1), F.lit(""))
    own = own.withColumn("folder", F.when(F.col("path").isNotNull(), folder))
    is_file = F.col("own").isNotNull() & ((F.col("share") >= FILE_SHARE) | F.col("path").rlike(FILE_NAME))
    licensed = own.where(is_file & F.col("folder").isNotNull()).groupBy(F.col("folder").alias("ancestor")).agg(F.min(F.struct(-F.col("score"), "path", "doc_id", F.col("own").alias("license"))).alias("first"))
    licensed = licensed.select("ancestor", F.col("first.license").alias("license"))
    # every directory once, with all its ancestors and itself; the longest that has a licence is the nearest
    parts = F.split("folder", "/")
    folders = own.where(F.col("folder").isNotNull()).select("folder").distinct()
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    nearest = folders.select("folder", F.posexplode(up).alias("depth", "ancestor")).join(licensed, "ancestor")
    nearest = materialize(nearest.groupBy("folder").agg(F.max(F.struct("depth", "ancestor", "license")).alias("n")).select(F.col("folder").alias("_folder"), F.col("n.ancestor").alias("ancestor"), F.col("n.license").alias("given")))
    side = F.broadcast(nearest) if nearest.count() <= MAX_BROADCAST_ROWS else nearest
    out = own.join(side, F.col("folder") == F.col("_folder"), "left")
    inherited = F.col("own").isNull() & F.col("given").isNotNull()
    return out.select(
        "doc_id",
        "path",
        F.coalesce("own", "given").alias("license"),
        "score",
        F.when(F.col("own").isNotNull(), "own").when(inherited, "inherited").otherwise("none").alias("origin"),
        F.when(inherited, F.col("ancestor")).alias("inherited_from"),
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents inherit along their paths where the table has them; else each has what its own text says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scanned(docs.select("doc_id", *[F.col(c).cast("string").alias(c) for c in docs.columns if c == "path"], "text"))
