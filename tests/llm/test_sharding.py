import zlib
from collections import Counter, defaultdict

import numpy as np

from tessera.llm import sharding


def test_growing_moves_only_into_the_new_shard():
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 20_000)
    before = sharding.jump_hash(keys, 1)
    assert not before.any()
    for n in range(2, 40):
        after = sharding.jump_hash(keys, n)
        moved = after != before
        assert (after[moved] == n - 1).all() and abs(moved.mean() - 1 / n) < 0.02
        before = after
    assert max(Counter(before.tolist()).values()) < 1.25 * len(keys) / 39


def plain_jump(key, shards):
    """The published algorithm on whole numbers, for one key."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_against_the_published_algorithm():
    keys = [0, 1, 2**63, 2**64 - 1, *map(int, np.random.default_rng(2).integers(0, 2**63, 500))]
    for shards in (1, 2, 8, 9, 1000):
        assert sharding.jump_hash(np.array(keys, np.uint64), shards).tolist() == [plain_jump(k, shards) for k in keys]


def test_query(spark):
    """The whole query on the small table, by the plain algorithm."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id", "text", "xxhash64(doc_id) AS h").collect()
    expected = sorted((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()), plain_jump(r.h % 2**64, 8), plain_jump(r.h % 2**64, 9)) for r in docs)
    assert sorted((r.doc_id, r["size"], r.text_crc32, r.shard, r.grown_shard) for r in sharding.op8(spark, d).collect()) == expected


def test_sharded(odd_docs, no_docs):
    rows = sharding.sharded(odd_docs).collect()
    expected = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd_docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == expected
    slots, of = defaultdict(list), {}
    for r in rows:
        assert r.law == "key" and r.grown_shard in (r.shard, 8) and of.setdefault(r.doc_id, r.shard) == r.shard
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.sharded(no_docs).count() == 0


def test_slots_of_a_crowded_shard(spark):
    docs = spark.range(5000).selectExpr("7L AS doc_id", "CASE WHEN id < 4000 THEN 'same' ELSE string(id) END AS text")
    assert sorted(r.slot for r in sharding.sharded(docs, rows=100_000_000).collect()) == list(range(5000))
