"""SimHash near-duplicates by a binary-trie self-join.

The distinct fingerprints stand in binary tries, one for each layout of their bits. Of five blocks of bits, two
fingerprints with at most four differing bits agree on one at least; each layout puts another block in front, so they
meet below a node of some trie that spells it (of six blocks they agree on two, and so on: more fingerprints take more
and longer fronts). Below such a node, pairs of trie nodes are traversed together: the differing bits of their
paths add up, and a pair is dropped when they exceed the budget. A node that holds too many fingerprints for one task is
first split, level by level, into pairs of deeper nodes under the same rule, and each such pair is a unit of work.

Of each unit only a spanning forest is returned, and pairs of nodes whose fingerprints are already linked to one
another are not traversed, so a large group of near copies costs about its size and not its square.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, materialize, spread_join
from tessera.llm.components import components

#: Fixed values of the contract.
SHINGLE, SEED, BUDGET = 4, 42, 4
#: Fewest blocks of bits: one more than the budget, so that some block has no differing bit.
LEAST_BLOCKS = BUDGET + 1
#: A unit of work holds about so many fingerprints.
MAX_NODE = 50_000
#: Bits by which a node is split when it is too large.
SPLIT_BITS = 6
#: A pair of nodes with fewer pairs of fingerprints is compared directly.
LEAF_PAIRS = 64


def fingerprint(text: str | None) -> int:
    """Bit k is set if it is set in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return digest(b" ".join(words), SEED)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[SHINGLE - 1 :].tolist()
    first = [0, *(ends[: len(words) - SHINGLE] + 1).tolist()]
    hashes = np.array([digest(whole[a:b], SEED) for a, b in zip(first, last, strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a very long text in blocks
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_key: str | None = None) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of each row, and text_key, which tells texts apart, if named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column("text")], np.uint64).view(np.int64)
            keys = [n for n in b.schema.names if n not in ("doc_id", "text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps), *map(b.column, keys)], ["doc_id", "fp", *keys])

    keys = [F.xxhash64("text", F.length("text")).alias(text_key)] if text_key else []
    return docs.select("doc_id", "text", *keys).mapInArrow(run, "doc_id long, fp long" + (f", {text_key} long" if text_key else ""))


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes reaches over the links (a, b)."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        before = root.copy()
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while not np.array_equal(root, jumped := root[root]):
            root = jumped
        if np.array_equal(root, before):
            return root


def traverse(values: np.ndarray, starts: np.ndarray, units: list[tuple[int, int, int, int, int]], budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j), at least a spanning forest of all pairs of values with at most budget differing bits.

    values: distinct within each sorted range. units: pairs of ranges (low, high, low, high) of them, and the depth at
    which their traversal begins; a range paired with itself is its own trie.
    """
    n = len(values)
    # neighbours in the order of a trie are likely links; with them, most nodes of a dense group are of one colour
    close = np.flatnonzero(_bits(values[1:] ^ values[:-1]) <= budget) if n > 1 else np.zeros(0, np.int64)
    close = close[~np.isin(close + 1, starts)]
    links_a, links_b = [close], [close + 1]
    colour = _roots(n, close, close + 1) if n else np.zeros(0, np.int64)
    change = np.concatenate([[0], np.cumsum(colour[1:] != colour[:-1])]) if n else colour
    todo = np.array([u[:5] for u in units], np.int64).reshape(-1, 5)
    errors = np.zeros(len(todo), np.int64)
    if len(todo):
        lead = np.where(todo[:, 4] > 0, np.uint64(64) - todo[:, 4].astype(np.uint64), np.uint64(0))
        errors = np.where(todo[:, 4] > 0, _bits((values[todo[:, 0]] >> lead) ^ (values[todo[:, 2]] >> lead)), 0)
    frontier = [np.column_stack([todo, errors])[errors <= budget]]
    while frontier:
        f = frontier.pop()
        if len(f) > 200_000:  # bounded memory: the rest waits
            frontier.append(f[200_000:])
            f = f[:200_000]
        lo1, hi1, lo2, hi2, depth, err = f.T
        one = (change[hi1 - 1] == change[lo1]) & (change[hi2 - 1] == change[lo2]) & (colour[lo1] == colour[lo2])
        f = f[~one & (hi1 > lo1) & (hi2 > lo2)]
        if not len(f):
            continue
        lo1, hi1, lo2, hi2, depth, err = f.T
        small = ((hi1 - lo1) * (hi2 - lo2) <= LEAF_PAIRS) | (depth >= 64)
        if small.any():
            a0, a1, b0, b1 = lo1[small], hi1[small], lo2[small], hi2[small]
            sizes = (a1 - a0) * (b1 - b0)
            unit = np.repeat(np.arange(len(sizes)), sizes)
            k = np.arange(len(unit)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            i, j = a0[unit] + k // (b1 - b0)[unit], b0[unit] + k % (b1 - b0)[unit]
            near = (i != j) & (_bits(values[i] ^ values[j]) <= budget)
            links_a.append(i[near])
            links_b.append(j[near])
        f = f[~small]
        if not len(f):
            continue
        lo1, hi1, lo2, hi2, depth, err = f.T
        mid1, mid2 = _middle(values, lo1, hi1, depth), _middle(values, lo2, hi2, depth)
        same = (lo1 == lo2) & (hi1 == hi2)
        down = lambda a, b, c, d, e: np.column_stack([a, b, c, d, depth + 1, e])
        cross = down(mid1, hi1, lo2, mid2, err + 1)[~same]
        nexts = np.concatenate([down(lo1, mid1, lo2, mid2, err), down(mid1, hi1, mid2, hi2, err), down(lo1, mid1, mid2, hi2, err + 1), cross])
        frontier.append(nexts[(nexts[:, 5] <= budget) & (nexts[:, 1] > nexts[:, 0]) & (nexts[:, 3] > nexts[:, 2])])
    return np.concatenate(links_a), np.concatenate(links_b)


def _middle(values: np.ndarray, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Where the right child of the node [low, high) at this depth begins: binary search for its first set bit."""
    low, high, bit = low.copy(), high.copy(), np.uint64(63) - depth.astype(np.uint64)
    while (open_ := low < high).any():
        mid = (low + high) // 2
        right = (values[np.minimum(mid, len(values) - 1)] >> bit) & np.uint64(1) == 1
        high = np.where(open_ & right, mid, high)
        low = np.where(open_ & ~right, mid + 1, low)
    return low


def _forest(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links: its members with the first of them."""
    if not len(a):
        return values[:0], values[:0]
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    roots = _roots(len(nodes), inverse[: len(a)], inverse[len(a) :])
    off = roots != np.arange(len(nodes))
    return values[nodes[off]], values[nodes[roots[off]]]


@functools.cache
def layouts(blocks: int) -> tuple[tuple[int, tuple[tuple[int, int], ...]], ...]:
    """(bits in front, pieces) of each layout: pieces are (first bit, length), from the highest bit, in their new order.
    Every choice of blocks - BUDGET blocks is the front of one."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    cut = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    out = []
    for front in itertools.combinations(range(blocks), blocks - BUDGET):
        order = [*front, *(k for k in range(blocks) if k not in front)]
        out.append((sum(cut[k][1] for k in front), tuple(cut[k] for k in order)))
    return tuple(out)


def _laid_out(pieces: tuple[tuple[int, int], ...]) -> Column:
    """fp with its bits in the order of the pieces."""
    out, at = None, 0
    for first, length in pieces:
        bits = F.shiftleft(F.shiftrightunsigned(F.shiftleft("fp", first), 64 - length), 64 - at - length)
        out = bits if out is None else out.bitwiseOR(bits)
        at += length
    return out


def _restored(x: np.ndarray, layout: np.ndarray) -> np.ndarray:
    """The fingerprints themselves. layout: 10,000 x the number of blocks + the layout's number."""
    out = np.zeros_like(x)
    for k in np.unique(layout):
        own, at = layout == k, 0
        values, back = x[own], np.zeros(own.sum(), np.uint64)
        for first, length in layouts(int(k) // 10_000)[int(k) % 10_000][1]:
            piece = (values << np.uint64(at)) >> np.uint64(64 - length)
            back |= piece << np.uint64(64 - first - length)
            at += length
        out[own] = back
    return out


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (unit, side, at, depth, layout) sorted by unit: at is the fingerprint laid out as its unit is."""
    held: list[pa.RecordBatch] = []

    def work(t: pa.Table) -> pa.RecordBatch:
        unit = t.column("unit").to_numpy()
        side = t.column("side").to_numpy()
        at = t.column("at").to_numpy().view(np.uint64)
        depth = t.column("depth").to_numpy().astype(np.int64)
        layout = t.column("layout").to_numpy()
        order = np.lexsort([at, side, unit])  # as unsigned numbers
        unit, side, at, depth, layout = unit[order], side[order], at[order], depth[order], layout[order]
        edge = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]) | (side[1:] != side[:-1])]))
        ends = np.append(edge[1:], len(unit))
        units, k = [], 0
        while k < len(edge):
            if k + 1 < len(edge) and unit[edge[k + 1]] == unit[edge[k]]:
                units.append((edge[k], ends[k], edge[k + 1], ends[k + 1], depth[edge[k]]))
                k += 2
            else:
                if side[edge[k]] == 0:  # one range is paired with itself
                    units.append((edge[k], ends[k], edge[k], ends[k], depth[edge[k]]))
                k += 1
        a, b = traverse(at, edge, units)
        real = _restored(at, layout)
        x, y = real[a], real[b]
        values, inverse = np.unique(np.concatenate([x, y]), return_inverse=True)
        x, y = _forest(values, inverse[: len(x)], inverse[len(x) :])
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    rows = 0
    for batch in batches:
        # whole units are worked on together once there are enough rows
        held.append(batch)
        rows += len(batch)
        if rows >= 200_000:
            t = pa.Table.from_batches(held)
            unit = t.column("unit").to_numpy()
            cut = int(np.searchsorted(unit, unit[-1], "left"))
            if cut:
                yield work(t.slice(0, cut))
                held, rows = t.slice(cut).to_batches(), len(t) - cut
    if rows:
        yield work(pa.Table.from_batches(held))


def blocks_for(fingerprints: int, max_node: int) -> int:
    """As few blocks as leave about max_node of evenly spread fingerprints below each front."""
    blocks = LEAST_BLOCKS
    while blocks < 8 and fingerprints >> min(front for front, _ in layouts(blocks)) > max_node:
        blocks += 1
    return blocks


def links(distinct: DataFrame, max_node: int = MAX_NODE, blocks: int | None = None) -> DataFrame:
    """(a, b): a spanning forest, over all units, of the pairs of fp in distinct with at most BUDGET differing bits."""
    blocks = blocks or blocks_for(distinct.count(), max_node)
    laid = [F.struct(F.lit(k).alias("block"), F.lit(10_000 * blocks + k).alias("layout"), F.lit(front).alias("depth"), _laid_out(pieces).alias("at")) for k, (front, pieces) in enumerate(layouts(blocks))]
    turned = distinct.select(F.inline(F.array(*laid)))
    node = lambda depth: F.expr(f"shiftrightunsigned(at, 64 - {depth})")
    turned = turned.withColumn("node", node("depth"))
    sizes = materialize(turned.groupBy("block", "node").agg(F.first("depth").alias("depth"), F.count(F.lit(1)).alias("n")))
    # pairs of nodes: at first each with itself. Those too large are split until they fit or are at their last bit
    pairs = sizes.where("n > 1").select("block", "depth", F.col("node").alias("left"), F.col("node").alias("right"), F.col("n").alias("n_left"), F.col("n").alias("n_right"))
    ready, large = pairs.where(f"n_left + n_right <= {2 * max_node}"), pairs.where(f"n_left + n_right > {2 * max_node}")
    while large.limit(1).count():
        depth = F.least(F.col("depth") + SPLIT_BITS, F.lit(64))
        roots = large.select("block", F.col("left").alias("node"), "depth").union(large.select("block", F.col("right").alias("node"), "depth")).distinct()
        found = None
        for d in sorted(r[0] for r in large.select("depth").distinct().collect()):  # a depth for each block length
            deeper = min(d + SPLIT_BITS, 64)
            here = turned.select("block", "at").withColumn("node", node(d)).join(roots.where(F.col("depth") == d).drop("depth"), ["block", "node"], "left_semi")
            one = here.groupBy("block", "node", F.expr(f"shiftrightunsigned(at, {64 - deeper})").alias("child")).agg(F.count(F.lit(1)).alias("n")).withColumn("depth", F.lit(d))
            found = one if found is None else found.union(one)
        children = materialize(found)
        left = children.select("block", "depth", F.col("node").alias("left"), F.col("child").alias("l"), F.col("n").alias("nl"))
        right = children.select("block", "depth", F.col("node").alias("right"), F.col("child").alias("r"), F.col("n").alias("nr"))
        split = large.select("block", "depth", "left", "right").join(left, ["block", "depth", "left"]).join(right, ["block", "depth", "right"])
        differing = F.bit_count(F.col("l").bitwiseXOR(F.col("r")))
        split = split.where((differing <= BUDGET) & ((F.col("left") != F.col("right")) | (F.col("l") <= F.col("r"))))
        split = materialize(split.select("block", depth.alias("depth"), F.col("l").alias("left"), F.col("r").alias("right"), F.col("nl").alias("n_left"), F.col("nr").alias("n_right")))
        split = split.where("NOT (left = right AND n_left < 2)")
        fits = F.expr(f"n_left + n_right <= {2 * max_node} OR depth >= 64")
        ready, large = ready.union(split.where(fits)), split.where(~fits)
    units = ready.select("block", "depth", "left", "right", F.xxhash64("block", "depth", "left", "right").alias("unit"))
    sides = units.select("block", "depth", F.col("left").alias("node"), "unit", F.lit(0).alias("side")).union(
        units.where("left <> right").select("block", "depth", F.col("right").alias("node"), "unit", F.lit(1).alias("side"))
    )
    rows = None
    for depth in sorted(r[0] for r in sides.select("depth").distinct().collect()):  # few: the lengths of fronts, and of the splits below
        here = turned.select("block", "layout", "at", F.lit(depth).alias("depth")).withColumn("node", node(depth))
        one = here.join(sides.where(F.col("depth") == depth).drop("depth"), ["block", "node"]).select("unit", "side", "at", "depth", "layout")
        rows = one if rows is None else rows.union(one)
    if rows is None:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    return rows.repartition("unit").sortWithinPartitions("unit", "side").mapInArrow(_join, "a long, b long")


def _labelled(prints: DataFrame, max_node: int) -> DataFrame:
    """(fp, root, least, component_id) of each distinct fp of prints, least being its own smallest doc_id."""
    least = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    label = components(links(least.select("fp"), max_node))
    rooted = least.join(label, least.fp == label.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return spread_join(rooted, named, ["root"], ["fp"])


def grouped(docs: DataFrame, max_node: int = MAX_NODE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links, for every row.

    A null or empty text has fingerprint zero, linked like any other; a text of any length is read whole. Rows of an
    equal doc_id keep a row each; a null doc_id is never the smallest unless its component has no other. Other columns
    are ignored. An empty table gives no rows.
    """
    prints = materialize(fingerprints(docs))
    named = _labelled(prints, max_node).select("fp", "component_id")
    out = spread_join(prints, named, ["fp"], ["doc_id"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, max_node: int = MAX_NODE) -> DataFrame:
    """docs, all columns, with one row of each component: one of the smallest doc_id. Of several such rows, that of the
    smallest fingerprint and text stays; a component with null ids only keeps one row likewise. Components are told apart
    by their roots, as several may have one id. Rows equal in id and text are one document. An empty table stays empty."""
    prints = materialize(fingerprints(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "own"))
    # a component's row is looked for only among the rows of its smallest doc_id
    chosen = _labelled(prints, max_node).where(F.col("least").eqNullSafe(F.col("component_id"))).select("fp", "root", "component_id")
    first = spread_join(prints, chosen, ["fp"], ["doc_id", "own"]).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    one = materialize(first.groupBy("root").agg(F.min(F.struct("fp", "own", "component_id")).alias("f")).select("f.component_id", "f.own"))
    key, id_, own = (fresh(n, *docs.columns) for n in ("key", "id", "own"))
    one = one.select(F.col("component_id").alias(id_), F.col("own").alias(own))
    keyed = docs.withColumn(key, F.xxhash64("text", F.length("text")))
    kept = keyed.join(one, keyed.doc_id.eqNullSafe(one[id_]) & (keyed[key] == one[own]), "left_semi").drop(key)
    # rows that are equal in id and text are looked for only if there are any
    if kept.select("doc_id").count() > one.count():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(spark.read.parquet(f"{sf_dir}/documents.parquet"))
