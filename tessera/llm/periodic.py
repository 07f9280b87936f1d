"""Periodic runs of words by a suffix automaton whose end-position sets are merged from small to large.

The automaton of a text has a state for each set of end positions. Going up its suffix links, from long states to short,
the ordered sets of the children are put into the largest of them one position at a time, and each position meets its
new neighbours there. Two neighbours at a distance d end the state's words both, and no two ends lie between them; if d
does not exceed the state's length, the words between them are a square of period d, which reaches back as far as
the state is long. All squares of one start and period are one run, whose end is that of the last of them. A distance that
is a multiple of the smallest period spans the same words as that run, and falls to it.

A text is first cut where no run can pass: every group of a few words within a run is found again one period on, so that
groups without an equal bound the stretches (with default parameters, groups of five). Equal groups are told by
hashes, which can only leave a stretch longer than it need be.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import let, table

#: A run has so many periods and so many words at least (fixed values of the contract).
EXPONENT, LEAST = 4, 6
#: Positions of a part of an ordered set.
PART = 512

_RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(link, length, end) of the states of words: end is the position that made a state, -1 for those split off."""
    nexts: list[dict[int, int]] = [{}]
    link, length, end = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(words):
        new = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(i + 1)
        end.append(i)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] != length[p] + 1:
                split = len(nexts)
                nexts.append(nexts[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                end.append(-1)
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = split
                    p = link[p]
                link[q] = q = split
            link[new] = q
        last = new
    return link, length, end


class Ends:
    """An ordered set of end positions, in parts that stay small, so that a position is put in without moving all."""

    __slots__ = ("firsts", "parts", "size")

    def __init__(self, at: int) -> None:
        self.firsts, self.parts, self.size = [at], [[at]], 1

    def __iter__(self) -> Iterator[int]:
        for part in self.parts:
            yield from part

    def add(self, at: int) -> tuple[int, int]:
        """Puts a new position in; returns its neighbours, -1 where there is none."""
        k = bisect_right(self.firsts, at) - 1
        self.size += 1
        if k < 0:
            part = self.parts[0]
            part.insert(0, at)
            self.firsts[0] = at
            k, below, above = 0, -1, part[1]
        else:
            part = self.parts[k]
            place = bisect_right(part, at)
            part.insert(place, at)
            below = part[place - 1]
            above = part[place + 1] if place + 1 < len(part) else self.firsts[k + 1] if k + 1 < len(self.firsts) else -1
        if len(part) > PART:
            half = part[PART // 2 :]
            del part[PART // 2 :]
            self.parts.insert(k + 1, half)
            self.firsts.insert(k + 1, half[0])
        return below, above


def squares(words: list[int]) -> dict[tuple[int, int], int]:
    """(start, period) of the leftmost square of each periodic stretch, and the end of its last one."""
    link, length, end = automaton(words)
    ends: list[Ends | None] = [Ends(i) if i >= 0 else None for i in end]
    found: dict[tuple[int, int], int] = {}
    for state in np.argsort(-np.array(length), kind="stable").tolist():
        up = link[state]
        small = ends[state]
        ends[state] = None
        if up <= 0:  # the empty state is no square's
            continue
        large = ends[up]
        if large is None:
            ends[up] = small
            continue
        if large.size < small.size:
            small, large = large, small
        own, reach = -1, length[up]
        for at in small:
            below, above = large.add(at)
            # neighbours of one set have met further down
            if 0 <= at - below <= reach and below not in (-1, own):
                key = (below - reach + 1, at - below)
                found[key] = max(at, found.get(key, -1))
            if 0 < above - at <= reach:
                key = (at - reach + 1, above - at)
                found[key] = max(above, found.get(key, -1))
            own = at
        ends[up] = large
    return found


def _group(exponent: int, least: int) -> int:
    """Words of a group of which every run of at least these sizes holds an equal one at one period's distance."""
    return min(max(least, exponent * q) - 2 * q + 1 for q in range(1, least + 1))


def stretches(ids: np.ndarray, group: int) -> list[tuple[int, int]]:
    """(first, one after the last) of the stretches of ids in which each group of words begins twice."""
    if len(ids) < group + 1:
        return []
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    starts = np.arange(len(ids) - group + 1)
    keys = np.zeros(len(starts), np.uint64)
    for k in range(group):
        keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + len(starts)]
    stretch = np.zeros(len(starts), np.int64)
    while len(starts):
        order = np.lexsort([keys, stretch])
        same = (keys[order][1:] == keys[order][:-1]) & (stretch[order][1:] == stretch[order][:-1])
        twice = np.zeros(len(starts), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        before = len(starts)
        starts, keys, stretch = starts[twice], keys[twice], stretch[twice]
        stretch = np.cumsum(np.concatenate([[0], (np.diff(starts) != 1)])) if len(starts) else stretch
        if len(starts) > 0.9 * before:
            break
    if not len(starts):
        return []
    edge = np.flatnonzero(np.concatenate([[True], np.diff(starts) != 1]))
    last = np.append(edge[1:], len(starts)) - 1
    return list(zip(starts[edge].tolist(), (starts[last] + group).tolist(), strict=True))


def runs(words: list, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of each stretch of words of smallest period q and a length of at least exponent * q and
    least, that no neighbouring word extends, by start and period."""
    numbers: dict = {}
    ids = np.fromiter(map(numbers.setdefault, words, count()), np.int64, len(words))
    out: dict[tuple[int, int], int] = {}
    for low, high in stretches(ids, _group(exponent, least)):
        if high - low < least:
            continue
        for (start, period), last in squares(ids[low:high].tolist()).items():
            if last - start + 1 >= max(least, exponent * period):
                key = (low + start, last - start + 1)
                out[key] = min(period, out.get(key, period))
    return sorted((start, length, period) for (start, length), period in out.items())


def collapse(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its own first period."""
    if not found:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(depth).tolist(), strict=False) if not d]


def collapsed(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """doc_id, runs (start, length and period in words, by start and period) and text, in which each run is one period.

    A word is dropped if it lies in a run after that run's first period; the words that stay are joined by one space.
    A null or empty text has no runs and becomes an empty one; a text of any length is read whole. Repeated rows, and rows
    of equal or null ids, are judged each by itself. Other columns are ignored. An empty table gives no rows.
    """
    if exponent < 2 or least < 2:
        raise ValueError("exponent and least must be 2 or more")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, texts = [], []
            for t in b.column("text"):
                words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
                own = runs(words, exponent, least)
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                texts.append(b" ".join(collapse(words, own)).decode("utf-8", "surrogatepass"))
            kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, kind), pa.array(texts, pa.string())], ["doc_id", "runs", "text"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, f"doc_id bigint, runs {_RUNS}, text string")


def strongest(found: Column) -> Column:
    """The run of the greatest length / period; of several the first by start and period. Null where there is none."""
    better = lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a)
    return F.aggregate(F.slice(found, 2, F.greatest(F.size(found), F.lit(1))), F.get(found, F.lit(0)), better)


def planted(docs: DataFrame) -> DataFrame:
    """docs with the contract's periodic tails: of a document whose crc32 h of its decimal doc_id is divisible by 10, the
    words from g % n on (g = h div 10) repeat with period 1 + (n - a) div (3 + g % 8). A null doc_id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t\\n\\x0B\\f\\r]+", -1), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        made = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % (1 + F.floor((n - a) / (3 + g % 8)))).cast("int")))
        return F.when(n > 0, F.array_join(made, " ")).otherwise("")

    return docs.withColumn("text", F.when(h % 10 == 0, let(words, repeated)).otherwise(F.col("text")))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = collapsed(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    line = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    best = made.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(line, 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


#: Runs as islands of words that equal the word one period on; pairs of positions meet by their five words.
OP11_SQL = r"""
WITH crc AS (SELECT doc_id, text, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))) AS h FROM documents),
split AS (SELECT doc_id, h, h // 10 AS g, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM crc),
sized AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN g % len(w) END AS a FROM split),
periods AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM sized),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM periods),
grams AS (SELECT doc_id, i, hash(list_slice(w, i + 1, i + 5)) AS x FROM (SELECT doc_id, w, unnest(range(n - 4)) AS i FROM d WHERE n >= 6)),
meets AS (SELECT doc_id, a.i, b.i - a.i AS q FROM grams AS a JOIN grams AS b USING (doc_id, x) WHERE a.i < b.i),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM meets),
spans AS (SELECT doc_id, q, min(i) AS s, max(i) + 5 + q - min(i) AS l FROM islands GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, s, l, min(q) AS q FROM spans WHERE l >= greatest(6, 4 * q) GROUP BY doc_id, s, l),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS whole FROM (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM d) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id),
best AS (SELECT r.* FROM runs AS r ANTI JOIN runs AS o ON r.doc_id = o.doc_id AND (o.l * r.q > r.l * o.q OR (o.l * r.q = r.l * o.q AND (o.s, o.q) < (r.s, r.q))))
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(s AS BIGINT) AS start, CAST(l AS BIGINT) AS length, CAST(q AS BIGINT) AS period,
    CAST(1000 * l // q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(whole, '')) AS collapsed_sha256
FROM d LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
