import math
import random

import numpy as np
import pytest

from tessera.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, uid string, block string, rank string"


def brute(rows):
    v = []
    for i, label, x in rows:
        if i is not None and label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            v.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(c))) for c in x]))
    out = []
    for k, (a, label, x) in enumerate(v):
        if a % 100:
            continue
        score = lambda y: sum(p * q for p, q in zip(x, y))
        same = sorted((-score(y), i) for n, (i, own, y) in enumerate(v) if own == label and n != k)
        rest = sorted((-score(y), i) for i, own, y in v if own != label)
        for s, p in same[:5]:
            fit = [(t, i) for t, i in rest if 80 * -s <= 100 * -t <= 100 * -s]
            out += [(a, p, r, i, -s, -t) for r, (t, i) in enumerate(fit[:5], 1)]
    return sorted(out)


def table(spark, tmp_path, rows):
    full = [(*r, "u", "b", "r") for r in rows]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def random_rows(seed, n, dims=70, labels=4):
    r = random.Random(seed)
    return [(i, r.randrange(labels) if r.random() < 0.6 else 1, [r.gauss(0.3, 0.4) for _ in range(dims)]) for i in range(n)]


@pytest.mark.parametrize("dims", [1, 32, 70])
def test_query_against_brute_force(spark, tmp_path, dims):
    rows = random_rows(dims, 700, dims)
    got = [tuple(r) for r in negatives.op13(spark, table(spark, tmp_path, rows)).collect()]
    assert got and sorted(got) == brute(rows)


def test_small_blocks_give_the_same(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = random_rows(5, 600)
    spark_rows = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    got = negatives.mined(spark_rows, F.col("vec_id") % 100 == 0, rows_of_block=9)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_odd_input(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    odd = [(None, 1, [1.0]), (100, None, [1.0]), (200, 1, None), (300, 1, [None, 1.0]), (400, 1, [nan]), (500, 2, [inf, 0.0]), (600, 1, []), (700, 1, [0.0, 0.0]), (800, 3, [-1.0, -1.0])]
    ties = [(k, k % 3, [1.0, 0.5]) for k in range(1, 40)] + [(900, 1, [1.0, 0.5]), (1000, 9, [1.0, 0.5])]
    rows = odd + ties + [(41, 1, [1.0, 0.5]), (41, 1, [1.0, 0.5]), (43, 2, [1.0, 0.4]), (43, 2, [1.0, 0.4])]
    got = sorted(tuple(r) for r in negatives.op13(spark, table(spark, tmp_path, rows)).collect())
    assert got == brute(rows)


def test_empty(spark, tmp_path):
    assert negatives.op13(spark, table(spark, tmp_path, [])).count() == 0


def test_product_is_exact():
    a, b = np.array([[1 << 29, 3]]), np.array([[1 << 29, -5], [1, 1]])
    assert negatives.product(a, b).tolist() == [[(1 << 58) - 15, (1 << 29) + 3]]
    with pytest.raises(OverflowError):
        negatives.product(a << 10, b)
    for top in (100, 40_000, 1 << 40):
        assert negatives._unpacked(negatives._packed(np.array([top, -top]))).tolist() == [top, -top]
