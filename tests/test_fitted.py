"""The fitted embedding against an exact decomposition, and what it is good for."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import fitted, vectors


def test_factors_are_those_of_the_matrix(spark, monkeypatch):
    """On the given documents: what is captured is near what an exact decomposition captures."""
    monkeypatch.setattr(fitted, "CELLS", 3_000)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("text").alias("document"))
    model = fitted.fit(docs, 24, words=3_000, rounds=5)
    rows = []
    for r in docs.collect():
        row = np.zeros(len(model.words))
        for w in fitted._words(r.document or ""):
            if w in model.words:
                row[model.words[w]] += 1
        rows.append(np.log1p(row))
    a = np.array(rows)
    n = len(a)
    idf = np.log((1 + n) / (1 + (a > 0).sum(0))) + 1
    a = a * idf
    a = a[(a > 0).any(1)]
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    s = np.linalg.svd(a, compute_uv=False)
    exact = (s[:24] ** 2).sum() / (s**2).sum()
    assert 0.995 * exact <= model.captured <= exact + 1e-9
    v = model.factors / idf[:, None]
    assert np.abs(v.T @ v - np.eye(24)).max() < 1e-4
    kept = np.linalg.norm(a @ v) ** 2 / np.linalg.norm(a) ** 2
    assert abs(kept - model.captured) < 1e-4


TOPICS = [
    ("car", "automobile", "engine wheel road driver fuel brake speed motor tyre garage"),
    ("doctor", "physician", "hospital patient nurse illness medicine surgery clinic care health ward"),
    ("movie", "film", "actor director scene camera screen cinema script studio audience role"),
]


def paraphrases(seed=1):
    """Documents that use one of two words for a thing, among the words that go with it."""
    r = random.Random(seed)
    out = []
    for a, b, context in TOPICS:
        for k in range(60):
            out.append((a if k % 2 else b, " ".join([a if k % 2 else b] * 2 + r.choices(context.split(), k=8) + r.choices("the of and in to with for".split(), k=6))))
    return out


def test_paraphrases_are_nearer_than_by_hashes(spark):
    docs = paraphrases()
    df = spark.createDataFrame([(d,) for _, d in docs], "document string")
    model, plain = fitted.fit(df, 4), vectors.HashingBackend(64)

    def precision(backend):
        held = np.array(backend.embed([d for _, d in docs]))
        right = 0
        for a, b, _ in TOPICS:
            for asked, wanted in ((a, b), (b, a)):
                best = np.argsort(-(held @ np.array(backend.embed([asked])[0])))[:60]
                right += sum(docs[k][0] == wanted for k in best)
        return right / (6 * 30)

    assert precision(model) > max(0.7, precision(plain) + 0.2)


def test_models_are_pinned(spark, tmp_path):
    df = spark.createDataFrame([(d,) for _, d in paraphrases()], "document string")
    model = fitted.fit(df, 6)
    assert fitted.fit(df.repartition(5), 6).words == model.words
    again = fitted.FittedBackend.read(spark, model.stored(spark, f"{tmp_path}/m") and f"{tmp_path}/m")
    assert (again.revision, again.dimension, again.captured) == (model.revision, 6, model.captured)
    assert again.embed(["automobile engine"]) == model.embed(["automobile engine"]) and model.embed(["", "unheard"]) == [[0.0] * 6] * 2
    other = fitted.fit(df, 6, words=20)
    assert other.revision != model.revision
    rows = spark.createDataFrame([(1, model.name, model.revision, 6)], "resource_id long, model_name string, model_revision string, embedding_dimension int")
    vectors.ensure_model(rows, (again.name, again.revision, again.dimension))
    with pytest.raises(ValueError, match="another model"):
        vectors.ensure_model(rows, (other.name, other.revision, other.dimension))
    with pytest.raises(ValueError):
        fitted.fit(spark.createDataFrame([("one",), (None,)], "document string"))


def test_shares_are_told_in_small_blocks():
    """What a task is sent of all shares at once is bounded, however many tasks there are: 10,000 rows of a batch."""
    q = np.random.default_rng(1).normal(size=(20_000, 48))
    cells = pa.array([[{"place": 3, "n": 2}, {"place": 19_999, "n": 1}]])
    told = list(fitted._product(np.ones(len(q)), q)(iter([pa.RecordBatch.from_arrays([cells], ["cells"])])))
    assert max(len(b.column("block")[0].as_py()) for b in told) <= fitted.BLOCK_BYTES
    twice = sorted([*told, *told], key=lambda b: b.column("at")[0].as_py())
    summed = list(fitted._summed(iter(twice)))
    assert len(summed) == len(told) and sum(b.column("squares")[0].as_py() for b in summed) == pytest.approx(2)
    w = np.log1p([2, 1]) / np.linalg.norm(np.log1p([2, 1]))
    z = np.concatenate([np.frombuffer(b.column("block")[0].as_py()) for b in summed]).reshape(q.shape)
    assert np.allclose(z[[3, 19_999]], 2 * np.outer(w, w @ q[[3, 19_999]])) and np.count_nonzero(z) == 96
