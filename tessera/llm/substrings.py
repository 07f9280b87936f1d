"""Substring deduplication by prefix-partitioned suffix trees over words.

A suffix is a document from some word on; only suffixes of at least WINDOW words matter, and the trees are cut at that
depth: what is longer than a window is a chain of nodes that deep, one for each word. The tree is never built whole. The
suffixes are split by variable-length prefixes: a suffix's prefix runs from its first word to the end of its anchor, the
least-hashed of the shingles of ANCHORS[0] words in its first WINDOW words. Suffixes with different anchors share no node
WINDOW deep, so those of one anchor make a group of subtrees of their own; neighbouring suffixes mostly have one anchor
and are sent together as a run of words. A group of more than MAX_GROUP suffixes is too large for a task, and its
prefixes are lengthened: its suffixes are anchored anew by longer shingles, until every group fits or the prefix is all
WINDOW words long and is itself the node. Before that, runs of equal words are made one, so that copies count once; and
of the last prefixes, each part of a group sends one row, however many of its suffixes have it.

Each group is sorted into a suffix array with the lengths of common prefixes of its neighbours. The array's ranges whose
neighbours share WINDOW words are the deep internal nodes: the smallest document below one owns its passage, and the
chains of marked nodes are the maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, spread_join

#: Fixed value of the contract: words to a window.
WINDOW = 50
#: Words to an anchor: a prefix ends with one; the longer ones are for groups that are too large.
ANCHORS = (8, 16, 32)
#: Most suffixes of a group that are sorted in one task.
MAX_GROUP = 5_000
#: Suffixes to a run: a word said ten thousand times over is one anchor all along.
MAX_RUN = 2048
#: Positions of a long document that are searched for anchors at a time.
BLOCK = 1 << 18
#: Words that a task sorts at a time, in whole groups.
BATCH_WORDS = 400_000
#: Digests of runs that a task remembers to have sent.
MAX_SENT = 500_000
#: Rows that a task holds before it passes them on.
MAX_ROWS = 20_000

_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    """The powers of the base and of its inverse modulo 2**64, up to n."""
    global _powers, _inverse
    if len(_powers) <= n:
        size = 1 << (n + 1).bit_length()
        with np.errstate(over="ignore"):
            factors = np.full((2, size + 1), _BASE, np.uint64)  # whole numbers throughout: a float would lose the low bits
            factors[1] = pow(_BASE, -1, 1 << 64)
            factors[:, 0] = 1
            _powers, _inverse = np.cumprod(factors, axis=1, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _runs_of(whole: bytes, ends: np.ndarray, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words, joined by one space and ending where told, as runs of suffixes with one anchor: its key, the first
    suffix of the run and the one after its last."""
    n = len(ends)
    starts = np.concatenate([[0], ends[:-1] + 1])
    _grow(len(whole))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.frombuffer(whole, np.uint8).astype(np.uint64) * _powers[: len(whole)], dtype=np.uint64)])
        first, last = starts[: n - anchor + 1], ends[anchor - 1 :]
        hashes = _mix((sums[last] - sums[first]) * _inverse[first])
    reach = WINDOW - anchor + 1
    views = np.lib.stride_tricks.sliding_window_view(hashes, reach)
    least = np.concatenate([views[k : k + BLOCK].min(axis=1) for k in range(0, len(views), BLOCK)])
    # a run ends where the least hash changes; where it stays, the shingle is the same, if not its place
    changes = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    since = np.arange(len(least)) - np.repeat(changes, np.diff(np.append(changes, len(least))))
    low = np.flatnonzero(since % MAX_RUN == 0)
    return least[low].view(np.int64), low, np.append(low[1:], len(least))


def _ends(whole: bytes) -> np.ndarray:
    return np.append(np.flatnonzero(np.frombuffer(whole, np.uint8) == 32), len(whole))


def anchors(text: str | None, anchor: int = ANCHORS[0]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """The words joined by one space, where each ends, and _runs_of them; None for a text with no window."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if len(words) < WINDOW:
        return None
    whole = b" ".join(words)
    ends = _ends(whole)
    return whole, ends, *_runs_of(whole, ends, anchor)


_KEYS = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("own", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])
_RUNS = pa.schema([("key", pa.int64()), ("large", pa.bool_()), ("doc", pa.int64()), ("own", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("content", pa.binary()), ("words", pa.binary())])
_SPANS = pa.schema([("doc", pa.int64()), ("own", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])
_PARTS = pa.schema([("key", pa.int64()), ("whole", pa.binary()), ("least", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("content", pa.binary()), ("words", pa.binary())])
_OWNED = pa.schema([("whole", pa.binary()), ("low", pa.int32()), ("high", pa.int32())])
_WINDOWS = pa.schema([("key", pa.int64()), ("words", pa.binary()), ("least", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _batch(columns, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, schema.types, strict=True)], schema=schema)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run: its anchor's key, its document, and its suffixes, low to high - 1."""
    for b in batches:
        parts = []
        for doc, own, text in zip(b.column("doc_id").to_pylist(), b.column("own").to_pylist(), b.column("text"), strict=True):
            found = anchors(text.as_py()) if doc is not None else None
            if found:
                _, _, keys, low, high = found
                parts.append((keys, np.full(len(keys), doc), np.full(len(keys), own), low, high))
        if parts:
            yield _batch([np.concatenate(x) for x in zip(*parts, strict=True)], _KEYS)


def _digest(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted runs of each document, with the digest of the words that their windows cover, and the words themselves
    where a task meets them first: copies are not sent again."""
    sent: set[bytes] = set()
    for b in batches:
        out: list[list] = [[] for _ in _RUNS]
        size = 0
        for doc, own, text, wanted in zip(b.column("doc_id").to_pylist(), b.column("own").to_pylist(), b.column("text"), b.column("wanted").to_pylist(), strict=True):
            whole = b" ".join(text.as_py().encode("utf-8", "surrogatepass").split())
            ends = [-1, *_ends(whole).tolist()]
            for w in wanted:
                low, high = w["low"], w["high"]
                words = whole[ends[low] + 1 : ends[high + WINDOW - 1]]
                content = _digest(words)
                known = content in sent
                sent.add(content)
                for column, value in zip(out, (w["key"], w["large"], doc, own, low, high - low, content, None if known else words), strict=True):
                    column.append(value)
                size += 100 if known else len(words)
            if size > 8 << 20:
                yield _batch(out, _RUNS)
                out, size = [[] for _ in _RUNS], 0
            if len(sent) > MAX_SENT:
                sent.clear()
        if out[0]:
            yield _batch(out, _RUNS)


# -- suffix arrays --------------------------------------------------------------------------------------------------


def suffix_array(words: np.ndarray, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in the order of their first WINDOW words, and of each how many of these it shares with the one
    before it (0 for the first). words: numbers, equal for equal words; at least WINDOW follow from each suffix on.

    By prefix doubling: ranks by h words give those by 2 h, and the ranks tell common lengths too."""
    n, h = len(words), 1
    ranks = {1: np.unique(words, return_inverse=True)[1].astype(np.int64)}
    while 2 * h <= WINDOW:
        held = ranks[h]
        ahead = np.zeros(n, np.int64)
        ahead[: n - h] = held[h:]  # what runs past the end of the array is in no suffix
        ranks[2 * h] = np.unique(held * (held.max() + 1) + ahead, return_inverse=True)[1].astype(np.int64)
        h *= 2
    deep = ranks[h]
    order = suffixes[np.lexsort([deep[suffixes + WINDOW - h], deep[suffixes]])]
    shared = np.zeros(max(0, len(order) - 1), np.int64)
    a, b = order[:-1], order[1:]
    for h in sorted(ranks, reverse=True):
        inside = np.minimum(np.maximum(a, b) + shared, n - 1) + h <= n
        at_a, at_b = np.minimum(a + shared, n - 1), np.minimum(b + shared, n - 1)
        shared += np.where(inside & (ranks[h][at_a] == ranks[h][at_b]), h, 0)
    return order, np.concatenate([[0], np.minimum(shared, WINDOW)])[: len(order)]


def deep_nodes(lcp: np.ndarray, depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The tree's internal nodes of this depth, as ranges (low, high) of the suffix array."""
    low = np.flatnonzero(lcp < depth)
    high = np.append(low[1:], len(lcp))
    several = high - low > 1
    return low[several], high[several]


def owned_elsewhere(contents: list[bytes], least: np.ndarray) -> list[tuple[int, int, int]]:
    """(content, first suffix, one after the last): the maximal repeats of each content of which a smaller document than
    its own least one has every window too. contents are distinct and have a window each."""
    numbers: dict[bytes, int] = {}
    split = b" ".join(contents).split(b" ")
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for w in split), np.int64, len(split))
    sizes = np.fromiter((c.count(b" ") + 1 for c in contents), np.int64, len(contents))
    many = sizes - (WINDOW - 1)
    of = np.repeat(np.arange(len(contents)), many)
    begin = np.cumsum(sizes) - sizes
    offset = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    order, lcp = suffix_array(words, begin[of] + offset)
    low, high = deep_nodes(lcp)
    if not len(low):
        return []
    where = np.full(len(words), -1, np.int64)
    where[begin[of] + offset] = np.arange(len(of))
    below = where[order]  # suffixes, numbered in the order of the contents
    lengths = high - low
    inside = np.repeat(low, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    members = below[inside]
    owner = np.minimum.reduceat(least[of[members]], np.cumsum(lengths) - lengths)
    marked = np.sort(members[least[of[members]] > np.repeat(owner, lengths)])
    if not len(marked):
        return []
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(marked) != 1) | (np.diff(of[marked]) != 0)]))
    first, last = marked[edge], marked[np.append(edge[1:], len(marked)) - 1]
    return list(zip(of[first].tolist(), offset[first].tolist(), (offset[last] + 1).tolist(), strict=True))


def _in_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[tuple]]:
    """The rows, sorted by key, as lists of whole groups with about BATCH_WORDS words."""
    held, size, key = [], 0, None
    for b in batches:
        for k, *row in zip(*(b.column(c).to_pylist() for c in ["key", *names]), strict=True):
            if k != key:
                if size > 6 * BATCH_WORDS:
                    yield held
                    held, size = [], 0
                key = k
            held.append(tuple(row))
            size += len(row[-1] or b"")
    if held:
        yield held


def _grouped(schema: pa.Schema, owner: str, identity: list[str], out_schema: pa.Schema):
    """Rows of schema, sorted by key, as spans of the suffixes that a smaller document than the row's owner has; a
    row is told by its identity. Runs of equal words are sorted as one."""
    names = schema.names[1:]
    doc, start, n, content, who = *map(names.index, (owner, "start", "n", "content")), [names.index(x) for x in identity]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _in_groups(batches, names):
            least: dict[bytes, int] = {}
            words: dict[bytes, bytes] = {}
            for r in rows:
                c = r[content]
                least[c] = min(r[doc], least.get(c, r[doc]))
                if r[-1] is not None:
                    words[c] = r[-1]
            contents = list(least)
            repeats: dict[bytes, list[tuple[int, int]]] = {}
            for c, low, high in owned_elsewhere([words[c] for c in contents], np.fromiter(least.values(), np.int64, len(least))):
                repeats.setdefault(contents[c], []).append((low, high))
            out = []
            for r in rows:
                own = tuple(r[k] for k in who)
                # of a run that a smaller document has too, every suffix
                spans = [(0, r[n])] if r[doc] > least[r[content]] else repeats.get(r[content], ())
                out += [(*own, r[start] + low, r[start] + high) for low, high in spans]
            if out:
                yield _batch(list(zip(*out, strict=True)), out_schema)

    return run


# -- groups that are too large --------------------------------------------------------------------------------------


def _anchored(anchor: int):
    """Contents (whole, least, words) as rows of _PARTS by anchors of this length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for whole, least, words in zip(*(b.column(c).to_pylist() for c in ("whole", "least", "words")), strict=True):
                ends = _ends(words)
                keys, lows, highs = _runs_of(words, ends, anchor)
                for key, low, high in zip(keys.tolist(), lows.tolist(), highs.tolist(), strict=True):
                    part = words[int(ends[low - 1]) + 1 if low else 0 : ends[high + WINDOW - 2]]
                    out.append((key, whole, least, low, high - low, _digest(part), part))
                if len(out) > MAX_ROWS:
                    yield _batch(list(zip(*out, strict=True)), _PARTS)
                    out = []
            if out:
                yield _batch(list(zip(*out, strict=True)), _PARTS)

    return run


def _windows_of(words: bytes) -> list[bytes]:
    """The suffixes of a content with the longest prefix: all their WINDOW words."""
    ends = [-1, *_ends(words).tolist()]
    return [words[ends[k] + 1 : ends[k + WINDOW]] for k in range(len(ends) - WINDOW)]


def _part_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents (key, least, words), sorted by key, as the distinct windows of each key and their least documents."""
    for rows in _in_groups(batches, ["key", "least", "words"]):
        nodes: dict[tuple[int, bytes], int] = {}
        for key, least, words in rows:
            for w in _windows_of(words):
                nodes[key, w] = min(least, nodes.get((key, w), least))
        found = [(key, w, least) for (key, w), least in nodes.items()]
        for k in range(0, len(found), MAX_ROWS):
            yield _batch(list(zip(*found[k : k + MAX_ROWS], strict=True)), _WINDOWS)


def _part_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents (key, whole, least, words), sorted by key, with windows (whole is null) that smaller documents than all of
    their key have, as the spans of the contents' windows that a smaller document than their own least one has."""
    for rows in _in_groups(batches, ["key", "whole", "least", "words"]):
        owners: dict[tuple[int, bytes], int] = {}
        contents = []
        for key, whole, least, words in rows:
            windows = [words] if whole is None else _windows_of(words)
            for w in windows:
                owners[key, w] = min(least, owners.get((key, w), least))
            if whole is not None:
                contents.append((key, whole, least, windows))
        out = []
        for key, whole, least, windows in contents:
            marked = np.array([False, *(owners[key, w] < least for w in windows), False])
            edges = np.flatnonzero(marked[1:] != marked[:-1]).tolist()
            out += [(whole, low, high) for low, high in zip(edges[::2], edges[1::2], strict=True)]
        if out:
            yield _batch(list(zip(*out, strict=True)), _OWNED)


def _by_windows(contents: DataFrame, max_group: int) -> DataFrame:
    """Of contents (key, whole, least, n, words): (whole, low, high), the spans of their windows that a smaller document
    than their least one has. The contents of a key are dealt out over parts of about max_group windows; a part sends
    each of its windows once, and is told which of them a document has that is smaller than all of the part's."""
    sizes = contents.groupBy(F.col("key").alias("_key")).agg(F.ceil(F.sum("n") / max_group).alias("_parts"))
    part = F.xxhash64("key", F.pmod(F.xxhash64("whole"), F.col("_parts")))
    parts = materialize(contents.join(sizes, F.col("key") == F.col("_key")).select(part.alias("key"), "whole", "least", "words"))
    dealt = parts.select("key", "least", "words").repartition("key").sortWithinPartitions("key")
    windows = materialize(dealt.mapInArrow(_part_windows, _ddl(_WINDOWS)))
    # prefixes of WINDOW words are nodes themselves: their least documents are found before they are dealt out
    owners = windows.groupBy("words").agg(F.min("least").alias("owner"))
    found = spread_join(windows, owners, ["words"], ["key"]).where("owner < least")
    told = found.select("key", F.lit(None).cast("binary").alias("whole"), F.col("owner").alias("least"), "words")
    return parts.union(told).repartition("key").sortWithinPartitions("key").mapInArrow(_part_spans, _ddl(_OWNED))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of content, _least and owned, with spans that meet or overlap made one."""
    for b in batches:
        out = []
        for owned in b.column("owned").to_pylist():
            spans: list[dict] = []
            for s in sorted(owned or (), key=lambda s: s["low"]):
                if spans and s["low"] <= spans[-1]["high"]:
                    spans[-1]["high"] = max(spans[-1]["high"], s["high"])
                else:
                    spans.append(dict(s))
            out.append(spans)
        yield pa.RecordBatch.from_arrays([b.column("content"), b.column("_least"), pa.array(out, b.schema.field("owned").type)], names=["content", "_least", "owned"])


def lengthened(rows: DataFrame, identity: list[str], owner: str, max_group: int, level: int = 1) -> DataFrame:
    """Of runs (identity, owner, start, n, content, words) of groups that are too large for one task: (identity, low,
    high), the spans of their suffixes that a smaller document than their owner has. Runs of equal words are one content,
    and the prefixes of the distinct contents are lengthened."""
    one = [F.min(owner).alias("least"), F.min("key").alias("key"), F.min("n").alias("n"), F.first("words", ignorenulls=True).alias("words")]
    contents = materialize(rows.groupBy(F.col("content").alias("whole")).agg(*one))
    if level < len(ANCHORS):
        parts = materialize(contents.select("whole", "least", "words").mapInArrow(_anchored(ANCHORS[level]), _ddl(_PARTS)))
        sizes = parts.groupBy("key").agg(F.sum("n").alias("size"), F.min("whole").alias("_a"), F.max("whole").alias("_b"))
        # a prefix of one content only repeats nowhere else
        dealt = materialize(parts.join(sizes.where("_a < _b").select("key", "size"), "key"))
        usual, large = dealt.where(F.col("size") <= max_group).drop("size"), dealt.where(F.col("size") > max_group)
        owned = usual.repartition("key").sortWithinPartitions("key").mapInArrow(_grouped(_PARTS, "least", ["whole"], _OWNED), _ddl(_OWNED))
        if large.limit(1).count():
            owned = owned.union(lengthened(large, ["whole"], "least", max_group, level + 1))
    else:
        owned = _by_windows(contents, max_group)
    owned = owned.groupBy("whole").agg(F.collect_set(F.struct("low", "high")).alias("owned"))
    told = contents.select("whole", "least").join(owned, "whole", "left").select(F.col("whole").alias("content"), F.col("least").alias("_least"), "owned")
    told = told.mapInArrow(_merged, told.schema)
    every = F.array(F.struct(F.lit(0).alias("low"), F.col("n").alias("high")))
    spans = F.when(F.col(owner) > F.col("_least"), every).otherwise(F.col("owned"))
    each = rows.select(*identity, *{owner} - {*identity}, "start", "n", "content")
    out = spread_join(each, told, ["content"], [*identity, "start"]).select(*identity, "start", F.explode(spans).alias("s"))
    return out.select(*identity, *[(F.col("start") + F.col(f"s.{x}")).cast("int").alias(x) for x in ("low", "high")])


# -- documents ------------------------------------------------------------------------------------------------------


def _with_key(docs: DataFrame) -> DataFrame:
    """A row is known by its id and own, which tells texts of an equal doc_id apart, and null ids from others.

    Neither is ever null: joins then need no filter, and all that meet the texts share one exchange of them."""
    own = F.xxhash64("text", F.length("text"), F.col("doc_id").isNull())
    return docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), own.alias("own"))


def repeated_spans(docs: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """(doc, own, low, high): the suffixes low to high - 1 of a document repeat a passage of a smaller doc_id. Repeated
    rows have the spans of one, which may be told as often as the row is."""
    keyed = _with_key(docs)
    keys = materialize(keyed.mapInArrow(_keys, _ddl(_KEYS)))
    counted = keys.groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.sum(F.col("high") - F.col("low")).alias("size"))
    shared = counted.where("least < most").select("key", (F.col("size") > max_group).alias("large"))
    # only runs of shared anchors are sent with their words
    wanted = keys.join(shared, "key").groupBy("doc", F.col("own").alias("_own")).agg(F.collect_set(F.struct("key", "large", "low", "high")).alias("wanted"))
    holders = keyed.join(wanted, (F.col("id") == F.col("doc")) & (F.col("own") == F.col("_own"))).select("doc_id", "text", "own", "wanted")
    runs = materialize(holders.mapInArrow(_runs, _ddl(_RUNS)))
    usual, large = runs.where("NOT large"), runs.where("large")
    spans = usual.repartition("key").sortWithinPartitions("key").mapInArrow(_grouped(_RUNS, "doc", ["doc", "own"], _SPANS), _ddl(_SPANS))
    return spans.union(lengthened(large, ["doc", "own"], "doc", max_group)) if large.limit(1).count() else spans


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_words, n_removed, digests, kept = [], [], [], []
        for text, spans in zip(b.column("text"), b.column("spans").to_pylist(), strict=True):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            n = len(words)
            if spans:
                depth = np.zeros(n + 1, np.int32)
                np.add.at(depth, [s["low"] for s in spans], 1)
                np.add.at(depth, [s["high"] + WINDOW - 1 for s in spans], -1)
                stay = np.cumsum(depth[:n]) == 0
                words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
            whole = b" ".join(words)
            n_words.append(n)
            n_removed.append(n - len(words))
            digests.append(hashlib.sha256(whole).hexdigest())
            kept.append(whole.decode("utf-8", "surrogatepass"))
        arrays = {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "kept_text": pa.array(kept, pa.string())}
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *arrays.values()], ["doc_id", *arrays])


def deduplicated(docs: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text (the words that stay, joined by one space) of every row.

    A word is removed if a window of WINDOW words that covers it also begins in a document with a smaller doc_id.
    Windows are judged on the input. A null text has no words. Rows of an equal doc_id own no passage over one another
    and are each judged by their own text; a row with a null doc_id is compared with none and keeps every word. Other
    columns are ignored. An empty table gives no rows.
    """
    spans = repeated_spans(docs, max_group)
    marks = spans.groupBy("doc", "own").agg(F.collect_set(F.struct("low", "high")).alias("spans")).withColumnRenamed("own", "_own")
    joined = _with_key(docs).join(marks, (F.col("id") == F.col("doc")) & (F.col("own") == F.col("_own")), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, k, sha256(array_to_string(list_slice(w, k, k + 49), ' ')) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50)),
owners AS (SELECT win, min(doc_id) AS owner FROM windows GROUP BY win),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS i FROM windows JOIN owners USING (win) WHERE doc_id > owner),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS whole, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(whole, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
