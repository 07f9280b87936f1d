"""Near-duplicates by n-gram Jaccard similarity, by a prefix-tree join.

Every document is the set of its distinct n-grams. Two sets that are similar enough share all but a few n-grams of each, so
a set with more n-grams than that few which no other set holds has no partner. This is told first by a part of the
n-grams (those of the least hashes), and for the sets that remain, whose texts are read again, by all of theirs.

The n-grams of the sets that still remain are ordered by rarity, the same way for all. Partners then meet at an n-gram
among the first few of both. The sets of such an n-gram are a unit of work; n-grams with the same sets are one unit. A unit's
sets stand in a tree by their ordered n-grams, and each set goes down the tree once for all sets that share a path: the
overlap adds up along the path, and a subtree is left when what remains of the set and below the node cannot make the
overlap large enough. Subtrees that are linked to the set already are left too, so that a large group of near copies costs
about its size. In a first round each set is in two units only; the others follow where they hold sets of more than one
component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, spread_join, table
from tessera.llm.components import components
from tessera.llm.simhash import _roots

#: Words of an n-gram, and the least similarity in hundredths (fixed values of the contract).
GRAM, SIMILAR = 3, 90
#: n-grams of one part of a unit, and of the units that share a tree; sets that go down the tree before colours are looked at
#: again; pairs of a set and a node, or n-grams of the ends of paths, that are held at once.
PART, BATCH, PROBES, HELD = 1_000_000, 250_000, 256, 100_000
#: n-grams of hashes below this are looked at first: three sixteenths, enough to hold more lone ones than a set may lack.
LOW = 3 << 60
#: Rows of ids that are broadcast at most (16 bytes each), and n-grams whose counts are.
MAX_BROADCAST, MAX_HOT = 2_000_000, 100_000

_PRINT = pa.schema([("doc_id", pa.int64()), ("set_id", pa.int64()), ("n", pa.int32()), ("grams", pa.binary())])
_GRAMS = pa.schema([("set_id", pa.int64()), ("n", pa.int32()), ("gram", pa.int64())])
_ORDERED = pa.schema([("set_id", pa.int64()), ("n", pa.int32()), ("m", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def slack(n: int | np.ndarray, similar: int = SIMILAR) -> int | np.ndarray:
    """n-grams of a set of n that a similar set may lack at most."""
    return n - (similar * n + 99) // 100


def grams_of(text: str | None, gram: int = GRAM) -> np.ndarray:
    """The distinct n-grams' hashes, ascending; of fewer words, that of all of them."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    whole = b" ".join(words)
    if len(words) <= gram:
        return np.array([digest(whole)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[gram - 1 :].tolist()
    first = [0, *(ends[: len(words) - gram] + 1).tolist()]
    return np.unique(np.array([digest(whole[a:b]) for a, b in zip(first, last, strict=True)], np.uint64))


def _prints(gram: int, below: int | None = None):
    """Documents as the key, size and n-grams of their sets; only those below a hash, if one is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, grams = [], [], []
            for t in b.column("text"):
                x = grams_of(t.as_py(), gram)
                ids.append(int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True))
                sizes.append(len(x))
                grams.append((x if below is None else x[: int(np.searchsorted(x, np.uint64(below)))]).tobytes())
            made = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(grams, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *made], schema=_PRINT)

    return run


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (set_id, n, grams) as (set_id, n, gram)."""
    for b in batches:
        for at in range(0, len(b), 512):
            part = b.slice(at, 512)
            grams = [np.frombuffer(x, np.int64) for x in part.column("grams").to_pylist()]
            sizes = np.fromiter(map(len, grams), np.int64, len(grams))
            told = [np.repeat(part.column(c).to_numpy(), sizes) for c in ("set_id", "n")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*told, np.concatenate(grams))], schema=_GRAMS)


def exploded(sets: DataFrame) -> DataFrame:
    return sets.select("set_id", "n", "grams").mapInArrow(_exploded, _ddl(_GRAMS))


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (set_id, n, count, gram), sorted, as one row a set."""

    def told(t: pa.Table) -> pa.RecordBatch:
        ids, n, count, gram = (t.column(c).to_numpy() for c in ("set_id", "n", "count", "gram"))
        edge = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        ends = np.append(edge[1:], len(ids))
        cut = lambda a: [a[i:j].tobytes() for i, j in zip(edge.tolist(), ends.tolist(), strict=True)]
        arrays = [pa.array(ids[edge]), pa.array(n[edge]), pa.array((ends - edge).astype(np.int32)), pa.array(cut(gram), pa.binary()), pa.array(cut(count.astype(np.int32)), pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, schema=_ORDERED)

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        last = b.column("set_id")[-1]
        if held[0].column("set_id")[0] != last:
            t = pa.Table.from_batches(held)
            ids = t.column("set_id").to_numpy()
            whole = int(np.flatnonzero(ids != ids[-1])[-1]) + 1
            yield told(t.slice(0, whole))
            held = t.slice(whole).to_batches()
    if held:
        yield told(pa.Table.from_batches(held))


class Tree:
    """The tree of ordered sets of numbers, sorted by unit and then as sequences; each unit has a root."""

    def __init__(self, sets: list[np.ndarray], unit: np.ndarray, n: np.ndarray) -> None:
        self.m = m = np.array([len(s) for s in sets], np.int64)
        most = int(m.sum()) + len(sets)
        self.token, self.parent, self.depth = np.full(most, -1, np.int64), np.full(most, -1, np.int64), np.zeros(most, np.int64)
        self.low, self.high, self.end = np.zeros(most, np.int64), np.zeros(most, np.int64), np.full(most, -1, np.int64)
        self.root = np.zeros(len(sets), np.int64)
        path = np.zeros(int(m.max(initial=0)) + 1, np.int64)
        used, before = 0, np.zeros(0, np.int64)
        for k, s in enumerate(sets):
            if not k or unit[k] != unit[k - 1]:
                self.high[path[: len(before) + 1]] = k
                path[0], before, shared = used, s[:0], 0
                self.low[used] = k
                used += 1
            else:
                both = min(len(s), len(before))
                differ = np.flatnonzero(s[:both] != before[:both])
                shared = int(differ[0]) if len(differ) else both
                self.high[path[shared + 1 : len(before) + 1]] = k
            self.root[k] = path[0]
            made = np.arange(used, used + len(s) - shared)
            self.token[made], self.depth[made], self.low[made] = s[shared:], np.arange(shared + 1, len(s) + 1), k
            path[shared + 1 : len(s) + 1] = made
            self.parent[made] = path[shared : len(s)]
            self.end[path[len(s)]] = k
            used, before = used + len(made), s
        self.high[path[: len(before) + 1]] = len(sets)
        for x in ("token", "parent", "depth", "low", "high", "end"):
            setattr(self, x, getattr(self, x)[:used])
        spans = np.column_stack([self.low, self.high]).ravel()
        self.least = np.minimum.reduceat(np.append(n, 0), spans)[::2] if used else spans
        self.most = np.maximum.reduceat(np.append(m, 0), spans)[::2] if used else spans
        below = np.flatnonzero(self.parent >= 0)
        self.children = below[np.argsort(self.parent[below], kind="stable")]
        self.many = np.bincount(self.parent[below], minlength=used)
        self.first = np.cumsum(self.many) - self.many


def linked(sets: list[np.ndarray], unit: np.ndarray, n: np.ndarray, colour: np.ndarray, similar: int = SIMILAR) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (i, j) of similar sets of one unit, whose overlaps are counted: with those between sets of one colour, all
    similar sets are of one component. Sets are ordered numbers, sorted by unit and then as sequences; n are their sizes with
    the numbers that are left out because no other set has them."""
    tree = Tree(sets, unit, n)
    m, flat = tree.m, np.concatenate(sets)
    wide = int(flat.max(initial=0)) + 1
    start = np.cumsum(m) - m
    of = np.repeat(np.arange(len(sets)), m)
    keys = of * wide + flat
    enough = lambda overlap, x, y: (100 + similar) * overlap >= similar * (n[x] + n[y])

    def held(probe: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether the probe has the token, how many of its numbers come up to it)."""
        key = probe * wide + token
        at = np.searchsorted(keys, key)
        hit = keys[np.minimum(at, len(keys) - 1)] == key
        return hit, at + hit - start[probe]

    # the first set of a unit with all others
    centre = tree.low[tree.root]
    overlap = np.add.reduceat(held(centre[of], flat)[0].astype(np.int64), start)
    near = np.flatnonzero(enough(overlap, centre, np.arange(len(sets))) & (centre != np.arange(len(sets))))
    found = [(centre[near], near)]

    def recoloured() -> tuple[np.ndarray, np.ndarray]:
        _, own = np.unique(colour, return_inverse=True)
        lead = np.full(own.max() + 1, -1)
        lead[own[::-1]] = np.arange(len(own))[::-1]
        a, b = (np.concatenate(x) for x in zip(*found, (lead[own], np.arange(len(own))), strict=True))
        root = _roots(len(own), a, b)
        return root, np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])

    for low in range(0, len(sets), PROBES):
        root, change = recoloured()
        probe = np.arange(low, min(low + PROBES, len(sets)))
        waiting = [(tree.root[probe], probe, np.zeros(len(probe), np.int64))]
        while waiting:
            node, probe, overlap = waiting.pop()
            many = tree.many[node]
            if len(node) > 1 and many.sum() > HELD:  # bounded memory: the rest waits
                half = len(node) // 2
                waiting += [(node[half:], probe[half:], overlap[half:]), (node[:half], probe[:half], overlap[:half])]
                continue
            at = np.repeat(tree.first[node] - np.cumsum(many) + many, many) + np.arange(many.sum())
            node, probe, overlap = tree.children[at], np.repeat(probe, many), np.repeat(overlap, many)
            after = np.maximum(tree.low[node], probe + 1)  # sets after the probe only
            there = after < tree.high[node]
            one = (change[np.minimum(after, len(sets) - 1)] == change[tree.high[node] - 1]) & (root[np.minimum(after, len(sets) - 1)] == root[probe])
            stay = there & ~one
            node, probe, overlap = node[stay], probe[stay], overlap[stay]
            hit, passed = held(probe, tree.token[node])
            overlap = overlap + hit
            reach = overlap + np.minimum(m[probe] - passed, tree.most[node] - tree.depth[node])
            stay = (100 + similar) * reach >= similar * (n[probe] + tree.least[node])
            node, probe, overlap = node[stay], probe[stay], overlap[stay]
            end = tree.end[node]
            whole = np.flatnonzero((end > probe) & enough(overlap, probe, end))
            found.append((probe[whole], end[whole]))
            single = np.flatnonzero(tree.high[node] - tree.low[node] == 1)
            x, y = probe[single], tree.low[node[single]]
            left = m[y] - tree.depth[node[single]]
            if left.sum() <= HELD:  # the rest of paths that are one set's is counted at once
                inside = np.repeat(start[y] + tree.depth[node[single]] - np.cumsum(left) + left, left) + np.arange(left.sum())
                pair = np.repeat(np.arange(len(single)), left)
                total = overlap[single] + np.bincount(pair[held(x[pair], flat[inside])[0]], minlength=len(single))
                whole = enough(total, x, y)
                found.append((x[whole], y[whole]))
                rest = tree.high[node] - tree.low[node] > 1
                node, probe, overlap = node[rest], probe[rest], overlap[rest]
            if len(node):
                waiting.append((node, probe, overlap))
    return found


def _joined(similar: int):
    """Rows (unit, set_id, root, n, grams, counts) sorted by unit, as links between sets."""

    def work(rows: list[tuple]) -> pa.RecordBatch:
        grams = np.concatenate([np.frombuffer(r[4], np.int64) for r in rows])  # ordered as signed numbers
        counts = np.concatenate([np.frombuffer(r[5], np.int32) for r in rows])
        order = np.lexsort([grams, counts])
        new = np.concatenate([[True], (grams[order][1:] != grams[order][:-1]) | (counts[order][1:] != counts[order][:-1])])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new) - 1
        sets = np.split(rank, np.cumsum([len(r[4]) // 8 for r in rows])[:-1])
        units = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)[1]
        by = sorted(range(len(rows)), key=lambda k: (units[k], sets[k].astype(">u4").tobytes()))
        ids, roots, n = (np.array([rows[k][c] for k in by], np.int64) for c in (1, 2, 3))
        found = linked([sets[k] for k in by], units[by], n, roots, similar)
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("unit", "set_id", "root", "n", "grams", "counts")), strict=True):
                if size > BATCH and r[0] != rows[-1][0]:
                    yield work(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[4]) // 8
        if rows:
            yield work(rows)

    return run


def _links(members: DataFrame, ordered: DataFrame, similar: int, part: int) -> DataFrame:
    """Links within the units of members (unit, set_id, root, m). A unit with more n-grams than part is dealt out, and
    its parts meet in pairs."""
    sizes = members.groupBy(F.col("unit").alias("_unit")).agg(F.count(F.lit(1)).alias("k"), F.ceil(F.sum(F.col("m").cast("long")) / part).cast("int").alias("parts"))
    sized = members.join(sizes.where("k > 1"), F.col("unit") == F.col("_unit"))
    own = F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int")
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != F.col("own")))
    dealt = sized.withColumn("own", own).withColumn("other", F.explode(others))
    dealt = dealt.select(F.xxhash64("unit", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), "set_id", "root")
    rows = dealt.join(ordered.hint("merge"), "set_id").select("unit", "set_id", "root", "n", "grams", "counts")
    return rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(_joined(similar), "a bigint, b bigint")


def _survivors(prints: DataFrame, may_lack) -> DataFrame:
    """set_id, n, least (smallest doc_id) and rows (how many rows have both) of each set, and whether it is partnered: it
    may have a partner, by its low n-grams."""
    of_doc = prints.where("n > 0").groupBy("set_id", "doc_id").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    own = F.struct(F.col("doc_id").isNull(), "doc_id")
    sets = of_doc.groupBy("set_id").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.min_by("rows", own).alias("rows"))
    lone = exploded(prints).groupBy("gram").agg(F.min("set_id").alias("set_id"), F.max("set_id").alias("last")).where("set_id = last")
    many = lone.groupBy(F.col("set_id").alias("_set")).agg(F.count(F.lit(1)).alias("lone"))
    return sets.join(many, F.col("set_id") == F.col("_set"), "left").withColumn("partnered", F.coalesce("lone", F.lit(0)) <= may_lack(F.col("n"))).drop("_set", "lone")


def _again(keyed: DataFrame, sets: DataFrame, gram: int) -> DataFrame:
    """set_id, n and all n-grams of the sets that are partnered, from a document of each."""
    wanted = sets.where("partnered").select(F.col("set_id").alias("_set"), F.col("least").alias("_least"), "rows")
    sized = wanted.agg(F.count(F.lit(1)).alias("n"), F.max("rows").alias("most")).first()
    wanted = wanted.drop("rows")
    wanted = F.broadcast(wanted) if sized["n"] <= MAX_BROADCAST else wanted.hint("merge")
    found = keyed.mapInArrow(_prints(gram), _ddl(_PRINT))
    one = found.join(wanted, (F.col("set_id") == F.col("_set")) & F.col("doc_id").eqNullSafe(F.col("_least")), "left_semi").select("set_id", "n", "grams")
    return materialize(one.dropDuplicates(["set_id"]) if (sized["most"] or 0) > 1 else one, "none")  # repeated rows


def _shared(sets: DataFrame) -> DataFrame:
    """set_id, n, gram and count of the n-grams that more than one of the sets has. Very frequent ones, of which there are
    few, are not shuffled by themselves."""
    grams = exploded(sets)
    counts = materialize(grams.groupBy("gram").agg(F.count(F.lit(1)).cast("int").alias("count")).where("count > 1"))
    most = max(10_000, (counts.agg(F.sum("count")).first()[0] or 0) // MAX_HOT)
    hot = F.broadcast(counts.where(F.col("count") > most))
    usual = grams.join(hot, "gram", "left_anti").join(counts.where(F.col("count") <= most).hint("merge"), "gram")
    return usual.unionByName(grams.join(hot, "gram")).select("set_id", "n", "count", "gram")


def grouped(docs: DataFrame, gram: int = GRAM, similar: int = SIMILAR, part: int = PART) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable over links) of every row.

    Documents link if 100 * intersection >= similar * union of their sets of n-grams. n-grams and whole sets are told
    apart by 64-bit hashes. A null or empty text has an empty set and is linked with nothing, not even with another such;
    fewer words than an n-gram are one. A text of any length is read whole. Rows of an equal doc_id keep a row each; a null
    doc_id is never the smallest unless its component has no other. Other columns are ignored. An empty table gives no rows.
    """
    may_lack = lambda n: n - F.ceil(F.lit(similar) * n / F.lit(100.0)).cast("int")
    keyed = docs.select(F.col("doc_id").cast("long"), "text")
    prints = materialize(keyed.mapInArrow(_prints(gram, LOW), _ddl(_PRINT)), "none")
    sets = materialize(_survivors(prints, may_lack))
    # n-grams of one set are left out; a set with too few others has no partner
    shared = _shared(_again(keyed, sets, gram)).repartition("set_id").sortWithinPartitions("set_id", "count", "gram")
    ordered = materialize(shared.mapInArrow(_assembled, _ddl(_ORDERED)).where(F.col("n") - F.col("m") <= may_lack(F.col("n"))), "none")

    front = F.expr("m - n").cast("int") + may_lack(F.col("n")) + 1
    heads = ordered.select("set_id", F.col("m").alias("n"), F.substring("grams", F.lit(1), 8 * front).alias("grams"))
    postings = materialize(exploded(heads).withColumnsRenamed({"gram": "unit", "n": "m"}))
    mixed = [F.bit_xor(F.xxhash64("set_id", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    units = postings.groupBy("unit").agg(F.count(F.lit(1)).alias("k"), *mixed).where("k > 1").groupBy("k", "x1", "x2").agg(F.min("unit").alias("unit")).select("unit")
    members = materialize(postings.join(units.hint("merge"), "unit"))
    at = F.row_number().over(Window.partitionBy("set_id").orderBy("unit"))
    few = members.withColumn("at", at).where("at <= 2").drop("at").withColumn("root", F.col("set_id"))
    first = materialize(_links(few, ordered, similar, part).distinct())
    label = components(first)
    rooted = materialize(members.join(label.hint("merge"), F.col("set_id") == F.col("node"), "left").select("unit", "set_id", "m", F.coalesce("root", "set_id").alias("root")))
    open_ = rooted.groupBy(F.col("unit").alias("_open")).agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("_open")
    rest = rooted.join(open_.hint("merge"), F.col("unit") == F.col("_open")).drop("_open")
    links = first.union(_links(rest, ordered, similar, part).distinct())

    label = components(links)
    labelled = sets.join(label.hint("merge"), F.col("set_id") == F.col("node"), "left").select("set_id", "least", F.coalesce("root", "set_id").alias("root"))
    named = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of_set = spread_join(labelled.select("set_id", "root"), named, ["root"], ["set_id"]).select("set_id", "component_id")
    out = spread_join(prints.select("doc_id", "set_id", "n"), of_set, ["set_id"], ["doc_id"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP12_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
items AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda k: array_to_string(list_slice(w, k, k + 2), ' ')) END) AS s FROM d),
sized AS (SELECT doc_id, count(*) AS n FROM items GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM items AS a JOIN items AS b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM met JOIN sized AS p ON p.doc_id = x JOIN sized AS q ON q.doc_id = y WHERE 100 * shared >= 90 * (p.n + q.n - shared)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT reach.node, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.seen)
SELECT d.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(seen) AS component_id FROM d LEFT JOIN sized USING (doc_id) JOIN reach ON reach.node = d.doc_id GROUP BY d.doc_id
"""
