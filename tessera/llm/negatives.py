"""Hard negatives by a blocked matrix product in two dimensions.

Rows of vectors stand in blocks of one label, and a block's matrix is cut into chunks of dimensions. Anchors are packed
likewise and sent to the blocks that they meet. A task multiplies an anchors' chunk with a rows' chunk, which gives a
tile of partial scores; the tiles of a pair of blocks are shuffled to one place and added, and the whole scores are
reduced there to the few best of each anchor. Blocks of the anchor's own label give its positives, and then blocks of the
other labels give the negatives in the window of each positive, so that every pair is multiplied once.

Components are whole numbers. Products are taken in double precision only while all sums stay exact, else as int64; tiles
travel in the narrowest type that holds them, and are added as int64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table

#: Rows of a block, anchors of a block, and dimensions of a chunk.
ROWS, ANCHORS, DIMS = 4096, 128, 32
#: What is mined (fixed values of the contract): positives of an anchor, negatives of a positive, and the window of a
#: negative's score in hundredths of the positive's. Components are scaled by SCALE and floored.
POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 5, 80, 100, 256

_NONE = np.iinfo(np.int64).min
_PANEL = pa.schema([("block", pa.int64()), ("label", pa.int64()), ("chunk", pa.int32()), ("rows", pa.int32()), ("matrix", pa.binary()), ("ids", pa.binary()), ("uids", pa.binary()), ("floors", pa.binary())])
_TILE = pa.schema([("block", pa.int64()), ("other", pa.int64()), ("chunk", pa.int32()), ("tile", pa.binary())] + [(x, pa.binary()) for x in ("ids", "uids", "floors", "other_ids", "other_uids")])
_BEST = "uid long, place int, other_id long, other_uid long, score long"


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _packed(a: np.ndarray) -> bytes:
    """The numbers in the narrowest type that holds them, which the first byte names."""
    for width in (1, 2, 4, 8):
        kind = np.dtype(f"<i{width}")
        if width == 8 or not a.size or (a.min() >= np.iinfo(kind).min and a.max() <= np.iinfo(kind).max):
            return bytes([width]) + a.astype(kind).tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.dtype(f"<i{b[0]}"), offset=1)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of the rows of a and of b, exactly."""
    top = lambda x: max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    bound = top(a) * top(b) * a.shape[1]
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    raise OverflowError("scores do not fit 64 bits")


def clean(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """uid, vec_id, label and vector of the rows that take part, components scaled and floored; uid tells rows apart."""
    whole = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))  # NaN is above all
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(whole, F.lit(False)))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return rows.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long"), F.col("label").cast("long"), scaled.alias("vector"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, label, uid, vec_id, vector, floors) sorted by block and vec_id, as panels: one for each chunk of dimensions."""

    def panels(rows: list[dict]) -> pa.RecordBatch:
        wide = max(DIMS, max(len(r["vector"]) for r in rows))
        wide += -wide % DIMS
        m = np.zeros((len(rows), wide), np.int64)
        for k, r in enumerate(rows):
            m[k, : len(r["vector"])] = r["vector"]
        floors = np.array([(r["floors"] or []) + [_NONE] * (POSITIVES - len(r["floors"] or [])) for r in rows], np.int64)
        told = [np.array([r[x] for r in rows], np.int64).tobytes() for x in ("vec_id", "uid")] + [floors.tobytes()]
        out = [(rows[0]["block"], rows[0]["label"], c, len(rows), _packed(m[:, c * DIMS : (c + 1) * DIMS]), *(told if c == 0 else (None,) * 3)) for c in range(wide // DIMS)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _PANEL.types, strict=True)], schema=_PANEL)

    held: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if held and r["block"] != held[0]["block"]:
                yield panels(held)
                held = []
            held.append(r)
    if held:
        yield panels(held)


def _blocks(labels: DataFrame, count: str, size: int) -> DataFrame:
    """Of one row a label: label_, parts and first, the numbers of its blocks. The window holds a row for each label."""
    parts = F.ceil(F.col(count) / size).cast("long")
    before = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    return labels.select(F.col("label").alias("label_"), parts.alias("parts"), F.coalesce(F.sum(parts).over(before), F.lit(0)).alias("first"))


def _panels(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Panels of the rows, which are dealt to the blocks of their label."""
    dealt = rows.join(blocks, F.col("label") == F.col("label_")).withColumn("block", F.col("first") + F.pmod(F.xxhash64("uid"), F.col("parts")))
    sorted_ = dealt.select("block", "label", "uid", "vec_id", "vector", "floors").repartition("block").sortWithinPartitions("block", "vec_id", "uid")
    return sorted_.mapInArrow(_pack, _ddl(_PANEL))


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of panels as partial tiles: one row in, one out."""
    for b in batches:
        for k in range(len(b)):
            r = {n: c[0] for n, c in b.slice(k, 1).to_pydict().items()}
            own, other = (_unpacked(r[m]).reshape(r[n], DIMS) for m, n in (("matrix", "rows"), ("other_matrix", "other_rows")))
            told = [r[x] for x in _TILE.names if x not in ("tile",)]
            told.insert(3, _packed(product(own, other)))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(told, _TILE.types, strict=True)], schema=_TILE)


def best(scores: np.ndarray, allowed: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``many`` highest allowed scores of each row, of equal ones those of the first columns."""
    n = scores.shape[1]
    rank = np.where(allowed, scores * n + np.arange(n - 1, -1, -1), _NONE)
    if n > many:
        columns = np.argpartition(rank, n - many, axis=1)[:, n - many :]
    else:
        columns = np.broadcast_to(np.arange(n), rank.shape)
    row, place = np.nonzero(np.take_along_axis(rank, columns, 1) != _NONE)
    return row, columns[row, place]


def _reduce(positives: bool, many: int, low: int, high: int):
    """Partial tiles sorted by their pair of blocks and chunk, added, as the best of each anchor (and of each window)."""

    def told(r: dict, total: np.ndarray) -> pa.RecordBatch:
        longs = lambda x: np.frombuffer(r[x], np.int64)
        uids, ids, others = longs("uids"), longs("other_ids"), longs("other_uids")
        scores = total.reshape(len(uids), len(others))
        found = []
        if positives:
            found.append((0, *best(scores, uids[:, None] != others[None, :], many)))
        else:
            floors = longs("floors").reshape(len(uids), POSITIVES)
            for place in range(POSITIVES):
                of = floors[:, place, None]
                there = of != _NONE
                of = np.where(there, of, 0)
                found.append((place, *best(scores, there & (100 * scores >= low * of) & (100 * scores <= high * of), many)))
        columns = [np.concatenate(x) for x in zip(*((uids[row], np.full(len(row), p, np.int32), ids[col], others[col], scores[row, col]) for p, row, col in found), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["uid", "place", "other_id", "other_uid", "score"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, total = None, None
        for b in batches:
            for k in range(len(b)):
                r = {n: c[0] for n, c in b.slice(k, 1).to_pydict().items()}
                tile = _unpacked(r.pop("tile")).astype(np.int64)
                if head is not None and (head["block"], head["other"]) == (r["block"], r["other"]):
                    total += tile
                    continue
                if head is not None:
                    yield told(head, total)
                head, total = r, tile
        if head is not None:
            yield told(head, total)

    return work


def _scored(anchors: DataFrame, rows: DataFrame, others: Column, work) -> DataFrame:
    """The best of each anchor over the blocks of rows that others names (an array of their numbers)."""
    sent = anchors.withColumn("other", F.explode(others)).withColumnRenamed("label", "own_label")
    met = rows.select(F.col("block").alias("other"), "chunk", F.col("label").alias("other_label"), *[F.col(x).alias(f"other_{x}") for x in ("rows", "matrix", "ids", "uids")])
    # a panel of rows and all anchors that meet it are one task's; panels of rows are many
    tiles = sent.join(met.hint("merge"), ["other", "chunk"]).where("keep IS NULL OR keep <> other_label")
    tiles = tiles.select("block", "other", "chunk", "rows", "matrix", "ids", "uids", "floors", *[f"other_{x}" for x in ("rows", "matrix", "ids", "uids")]).mapInArrow(_multiply, _ddl(_TILE))
    return tiles.repartition("block", "other").sortWithinPartitions("block", "other", "chunk").mapInArrow(work, _BEST)


def mined(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, rows_of_block: int = ROWS) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score, the hard negatives of each
    anchor and positive.

    Anchors are the rows that is_anchor names. An anchor's positives are its first rows of its own label, by score and
    then by vec_id, itself left out; a positive's negatives are the anchor's first rows of other labels with low *
    positive_score <= 100 * negative_score <= high * positive_score. Rows with a null vec_id, label or vector, or a null or
    infinite component or NaN, take no part; shorter vectors count as if zeros followed. Rows of an equal vec_id are rows
    of their own. Scores beyond 64 bits are an error. Other columns are ignored. An empty table gives no rows.
    """
    if positives > POSITIVES:
        raise ValueError(f"at most {POSITIVES} positives")
    rows = materialize(clean(vectors, scale).withColumn("floors", F.lit(None).cast("array<bigint>")).withColumn("anchor", F.coalesce(is_anchor, F.lit(False))))
    counts = materialize(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("anchor").cast("long")).alias("n_anchors")))
    blocks, anchor_blocks = _blocks(counts, "n", rows_of_block), _blocks(counts, "n_anchors", ANCHORS)
    n_blocks = blocks.agg(F.sum("parts")).first()[0] or 0
    panels = materialize(_panels(rows, blocks))
    anchors = rows.where("anchor")

    own = _panels(anchors, anchor_blocks).withColumn("keep", F.lit(None).cast("long")).join(blocks, F.col("label") == F.col("label_"))
    met = _scored(own, panels, F.sequence("first", F.col("first") + F.col("parts") - 1), _reduce(True, positives, low, high))
    first = Window.partitionBy("uid").orderBy(F.desc("score"), "other_id", "other_uid")
    positive = materialize(met.withColumn("n", F.row_number().over(first)).where(F.col("n") <= positives).select("uid", (F.col("n") - 1).alias("place"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")))

    floors = positive.groupBy(F.col("uid").alias("uid_")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("floors"))
    asking = anchors.drop("floors").join(floors, F.col("uid") == F.col("uid_")).drop("uid_")
    windows = _panels(asking, anchor_blocks).withColumn("keep", F.col("label"))
    found = _scored(windows, panels, F.sequence(F.lit(0), F.lit(max(0, n_blocks - 1))), _reduce(False, negatives, low, high))
    order = Window.partitionBy("uid", "place").orderBy(F.desc("score"), "other_id", "other_uid")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    names = anchors.select("uid", F.col("vec_id").alias("anchor_id"))
    out = ranked.join(positive, ["uid", "place"]).join(names, "uid")
    return out.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mined(moved, F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(CAST(a.x AS DOUBLE[]), CAST(b.x AS DOUBLE[])) AS BIGINT) AS score
    FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
