"""Approximate nearest vectors by navigable graphs: one of each shard, stored as neighbour lists, searched by a beam.

A vector's neighbours are the nearest of its shard that are nearer to it than to one another, so that edges lead in all
directions, and those that have chosen it. A search begins at a shard's pivots, a sample of about the root of its size, and
goes from the best vector that it has not gone from to the neighbours, until the beam holds nothing better to go from.
The shards' best are merged. Every vector that has a direction is in a graph; shards are dealt by a hash of the id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans import stored

#: Vectors of a shard, chosen neighbours of a vector (twice as many with those that chose it), candidates for them, and
#: queries that are searched for at once or are one task's.
PER_SHARD, DEGREE, CANDIDATES, AT_ONCE, PER_TASK = 60_000, 12, 32, 256, 100_000
#: A place of a beam looks at about so many vectors; with the pivots, beams look at this share of a shard. A beam that does
#: not grow with its shard loses recall.
LOOKED_A_PLACE, SHARE = 13, 0.085


def beam_of(vectors: int) -> int:
    """The places of a beam in a shard of so many vectors."""
    return int((SHARE * vectors - math.sqrt(vectors)) / LOOKED_A_PLACE)


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def neighbours(x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES) -> list[np.ndarray]:
    """The neighbour list of each row of unit vectors."""
    n = len(x)
    many = min(candidates, n - 1)
    if many < 1:
        return [np.zeros(0, np.int32)] * n
    sources, targets, scores = [], [], []
    block = max(1, min(1024, 32_000_000 // n))
    for low in range(0, n, block):
        s = x[low : low + block] @ x.T
        s[np.arange(len(s)), np.arange(low, low + len(s))] = -np.inf
        near = np.argpartition(-s, many - 1, axis=1)[:, :many]
        own = np.take_along_axis(s, near, 1)
        order = np.argsort(-own, axis=1, kind="stable")
        near, own = np.take_along_axis(near, order, 1), np.take_along_axis(own, order, 1)
        among = np.einsum("bid,bjd->bij", x[near], x[near])
        kept = np.zeros(near.shape, bool)
        for t in range(many):  # nearest first: kept if no kept one is nearer to it than its own vector
            covered = (kept & (among[:, t, :] >= own[:, t, None])).any(axis=1)
            kept[:, t] = ~covered & (kept.sum(axis=1) < degree)
        row, col = np.nonzero(kept)
        sources.append(row + low)
        targets.append(near[row, col])
        scores.append(own[row, col])
    a, b, s = (np.concatenate(v) for v in (sources, targets, scores))
    a, b, s = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s])
    _, first = np.unique(a * n + b, return_index=True)
    a, b, s = a[first], b[first], s[first]
    order = np.lexsort([-s, a])
    a, b = a[order], b[order]
    begin = np.searchsorted(a, np.arange(n + 1))
    return [b[begin[k] : min(begin[k + 1], begin[k] + 2 * degree)].astype(np.int32) for k in range(n)]


def search(x: np.ndarray, edges: np.ndarray, pivots: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, scores, looked at) of each query: the beam at its end, best first, with -1 where it is not full. edges has
    a row for each vector, filled up with -1."""
    q, n = len(queries), len(x)
    rows = np.arange(q)
    seen = np.zeros((q, n), bool)
    place, score, gone = np.full((q, beam), -1), np.full((q, beam), -np.inf, np.float32), np.zeros((q, beam), bool)

    def merge(new: np.ndarray, of: np.ndarray) -> None:
        """Puts new places (a row for each query of ``of``, -1 where there is none) into the beams."""
        fresh = (new >= 0) & ~seen[of[:, None], new]
        r, c = np.nonzero(fresh)
        seen[of[r], new[r, c]] = True
        found = np.full(new.shape, -np.inf, np.float32)
        found[r, c] = np.einsum("id,id->i", x[new[r, c]], queries[of[r]])
        all_score = np.concatenate([score[of], found], axis=1)
        best = np.argsort(-all_score, axis=1, kind="stable")[:, :beam]
        score[of] = np.take_along_axis(all_score, best, 1)
        place[of] = np.where(np.isneginf(score[of]), -1, np.take_along_axis(np.concatenate([place[of], new], axis=1), best, 1))
        gone[of] = np.take_along_axis(np.concatenate([gone[of], np.zeros(new.shape, bool)], axis=1), best, 1)

    merge(np.broadcast_to(pivots, (q, len(pivots))), rows)
    while True:
        able = (place >= 0) & ~gone
        of = np.flatnonzero(able.any(axis=1))
        if not len(of):
            return place, score, seen.sum(axis=1)
        at = able[of].argmax(axis=1)  # beams are in order: the best that has not been gone from
        gone[of, at] = True
        merge(edges[place[of, at]], of)


@dataclass(frozen=True)
class GraphIndex:
    """rows: (shard, place, id, vector, edges, pivot), one for each vector."""

    rows: DataFrame
    shards: int

    @classmethod
    def of(cls, vectors: DataFrame, per_shard: int = PER_SHARD, degree: int = DEGREE, path: str | None = None) -> GraphIndex:
        """The graphs of vectors (id, embedding), written to the shared folder or a path. A vector that is null, or has a null
        or infinite component or no length, has no direction and is left out, as it has no score."""
        spark = vectors.sparkSession
        finite = F.forall("embedding", lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False))) & F.exists("embedding", lambda c: c != 0)
        directed = vectors.where(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False))).select("id", "embedding")
        shards = max(1, math.ceil(directed.count() / per_shard))
        dealt = directed.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).repartition(shards, "shard").sortWithinPartitions("shard", "id")
        schema = f"shard int, place int, id {dict(vectors.dtypes)['id']}, vector array<float>, edges array<int>, pivot boolean"
        path = path or stored.folder(spark)
        dealt.mapInArrow(_built(degree), schema).write.parquet(path)
        return cls(spark.read.schema(schema).parquet(path), shards)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> GraphIndex:
        rows = spark.read.parquet(path)
        return cls(rows, (rows.agg(F.max("shard")).first()[0] or 0) + 1)

    def top_k(self, queries: DataFrame, k: int, beam: int | None = None) -> DataFrame:
        """query_id, id, score, rank and looked (how many vectors were looked at) of the k nearest that the beams find of each
        of queries (query_id, vector). Queries without a direction, or of another dimension, find nothing."""
        beam = max(k, beam or beam_of(self.rows.count() // self.shards))
        finite = F.forall("vector", lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False))) & F.exists("vector", lambda c: c != 0)
        asked = queries.where(F.coalesce(finite, F.lit(False)))
        parts = max(1, math.ceil(asked.count() / PER_TASK))
        kinds = dict(self.rows.dtypes) | {"query_id": dict(queries.dtypes)["query_id"]}
        none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
        # a task has one shard's graph, and then the queries, which pass by in batches
        graph = self.rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("shard", "part", F.lit(0).alias("kind"), "place", "id", "vector", "edges", "pivot", none("query_id"))
        sent = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(self.shards - 1)))).withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
        sent = sent.select("shard", "part", F.lit(1).alias("kind"), none("place"), none("id"), F.col("vector").cast("array<float>").alias("vector"), none("edges"), none("pivot"), "query_id")
        both = graph.unionByName(sent).repartition(self.shards * parts, "shard", "part").sortWithinPartitions("shard", "part", "kind", "place")
        found = both.mapInArrow(_searched(beam, k), f"query_id {kinds['query_id']}, id {kinds['id']}, score double, looked long")
        total = found.groupBy("query_id").agg(F.sum("looked").alias("looked"))  # told on one row of each shard
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        ranked = found.where("id IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.drop("looked").join(total, "query_id")


def _built(degree: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            of = b.column("shard").to_numpy()
            for low, high in _spans(of):
                part = b.slice(low, high - low)
                if held and held[0].column("shard")[0] != part.column("shard")[0]:
                    yield from told(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if held:
            yield from told(pa.Table.from_batches(held))

    def told(t: pa.Table) -> Iterator[pa.RecordBatch]:
        vectors = t.column("embedding").to_pylist()
        wide = max(map(len, vectors))
        x = _unit([v + [0.0] * (wide - len(v)) for v in vectors])
        edges = neighbours(x, degree)
        pivots = np.zeros(len(x), bool)
        pivots[np.linspace(0, len(x) - 1, math.isqrt(len(x)) or 1).astype(int)] = True  # rows come by id, which says nothing of places
        for low in range(0, len(x), 5_000):
            high = min(low + 5_000, len(x))
            arrays = [
                t.column("shard").slice(low, high - low).combine_chunks(),
                pa.array(np.arange(low, high, dtype=np.int32)),
                t.column("id").slice(low, high - low).combine_chunks(),
                pa.array([v[: len(vectors[low + k])] for k, v in enumerate(x[low:high].tolist())], pa.list_(pa.float32())),
                pa.array(edges[low:high], pa.list_(pa.int32())),
                pa.array(pivots[low:high]),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["shard", "place", "id", "vector", "edges", "pivot"])

    return run


def _spans(keys: np.ndarray) -> list[tuple[int, int]]:
    """(first, one after the last) of runs of equal keys."""
    edge = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)] if len(keys) else [0]
    return list(zip(edge, edge[1:], strict=False))


def _searched(beam: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, of, held = None, None, []
        for b in batches:
            key = b.column("shard").to_numpy().astype(np.int64) << 32 | b.column("part").to_numpy()
            for low, high in _spans(key * 2 + b.column("kind").to_numpy()):
                part = b.slice(low, high - low)
                if part.column("kind")[0].as_py() == 0:
                    if of != key[low]:
                        of, held, graph = key[low], [], None
                    held.append(part)
                elif of == key[low]:
                    graph = graph or made(pa.Table.from_batches(held))
                    for at in range(0, len(part), AT_ONCE):
                        yield told(part.slice(at, AT_ONCE), *graph)

    def made(t: pa.Table) -> tuple:
        vectors, edges = t.column("vector").to_pylist(), t.column("edges").to_pylist()
        wide, most = max(map(len, vectors)), max(1, max(map(len, edges)))
        x = np.array([v + [0.0] * (wide - len(v)) for v in vectors], np.float32)
        return t.column("id").combine_chunks(), x, np.array([e + [-1] * (most - len(e)) for e in edges]), np.flatnonzero(t.column("pivot").to_numpy())

    def told(asked: pa.RecordBatch, ids: pa.Array, x: np.ndarray, edges: np.ndarray, pivots: np.ndarray) -> pa.RecordBatch:
        vectors = asked.column("vector").to_pylist()
        fit = [r for r, v in enumerate(vectors) if len(v) == x.shape[1]]
        place, _, looked = search(x, edges, pivots, _unit([vectors[r] for r in fit]) if fit else np.zeros((0, x.shape[1]), np.float32), beam)
        r, c = np.nonzero(place[:, :k] >= 0)
        q = _unit([vectors[i] for i in fit]).astype(np.float64) if fit else np.zeros((0, x.shape[1]))
        score = np.einsum("id,id->i", x[place[r, c]].astype(np.float64), q[r])
        names = asked.column("query_id").take(pa.array(np.array(fit, np.int64)[r], pa.int64()))
        first = np.where(c == 0, looked[r], 0)
        return pa.RecordBatch.from_arrays([names, ids.take(pa.array(place[r, c])), pa.array(score), pa.array(first.astype(np.int64))], ["query_id", "id", "score", "looked"])

    return run
