"""Graphs of vectors against exact search."""

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import graph_index as G
from tessera.operators import vectors

SCHEMA = "id long, embedding array<float>"


def made(spark, n, seed=1, dims=24):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(8, dims))
    x = centres[r.integers(0, 8, n)] + r.normal(size=(n, dims))
    return spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], SCHEMA), x


def test_neighbours_lead_everywhere():
    """Lists are short, hold no vector itself, and from the pivots every vector can be reached."""
    x = G._unit(np.random.default_rng(3).normal(size=(2000, 16)).tolist())
    edges = G.neighbours(x, 8)
    assert max(map(len, edges)) <= 16 and all(k not in e for k, e in enumerate(edges))
    seen, todo = {0}, [0]
    while todo:
        for y in edges[todo.pop()].tolist():
            if y not in seen:
                seen.add(y)
                todo.append(y)
    assert len(seen) > 1990
    assert [e.tolist() for e in G.neighbours(x[:1])] == [[]] and [e.tolist() for e in G.neighbours(x[:2])] == [[1], [0]]


@pytest.mark.parametrize("per_shard", [10_000, 900])
def test_recall(spark, per_shard, tmp_path):
    v, _ = made(spark, 4000)
    index = G.GraphIndex.of(v, per_shard, path=f"{tmp_path}/g")
    assert index.rows.count() == 4000 and index.shards == -(-4000 // per_shard)
    asked = v.where("id % 40 = 0").selectExpr("id AS query_id", "embedding AS vector")
    got = G.GraphIndex.read(spark, f"{tmp_path}/g").top_k(asked, 10).collect()
    exact = {(r.query_id, r.id): r.score for r in vectors.semantic_top_k(v, asked, 10).collect()}
    found = {(r.query_id, r.id): r.score for r in got}
    assert len(found) == 1000 and len(found.keys() & exact.keys()) >= 950
    assert all(abs(found[x] - exact[x]) < 1e-5 for x in found.keys() & exact.keys())
    looked = {r.query_id: r.looked for r in got}
    assert len(looked) == 100 and np.mean([*looked.values()]) < (0.12 if per_shard > 4000 else 0.35) * 4000


def test_recall_holds_as_vectors_grow(spark):
    """Vectors without clusters, more than a beam of a fixed length serves."""
    x = np.random.default_rng(5).normal(size=(24_000, 48)).astype(np.float32)
    v = spark.createDataFrame(pa.table({"id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    asked = v.where("id % 400 = 0").selectExpr("id AS query_id", "embedding AS vector")
    got = G.GraphIndex.of(v).top_k(asked, 10).collect()
    exact = {(r.query_id, r.id) for r in vectors.semantic_top_k(v, asked, 10).collect()}
    assert len({(r.query_id, r.id) for r in got} & exact) >= 0.95 * len(exact)


def test_many_queries_share_a_shard(spark, monkeypatch):
    monkeypatch.setattr(G, "PER_TASK", 30)
    v, _ = made(spark, 300)
    asked = v.selectExpr("id AS query_id", "embedding AS vector")
    index = G.GraphIndex.of(v, 200)
    got = {(r.query_id, r.id) for r in index.top_k(asked, 3).collect()}
    exact = {(r.query_id, r.id) for r in vectors.semantic_top_k(v, asked, 3).collect()}
    assert len(got & exact) >= 0.95 * 900


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (None, [1.0, 1.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0])]
    v = spark.createDataFrame(rows, SCHEMA)
    index = G.GraphIndex.of(v)
    assert sorted(r.id for r in index.rows.collect()) == [1, 2, 9, 9]
    asked = spark.createDataFrame([("a", [2.0, 0.0]), ("b", None), ("c", [0.0, 0.0]), ("d", [1.0])], "query_id string, vector array<double>")
    assert [(r.query_id, r.id, r.rank) for r in index.top_k(asked, 2).collect()] == [("a", 1, 1), ("a", 9, 2)]
    assert G.GraphIndex.of(v.limit(0)).top_k(asked, 2).count() == 0
    assert index.top_k(asked.limit(0), 2).count() == 0
