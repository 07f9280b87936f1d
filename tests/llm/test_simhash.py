import random
import re

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash
from tessera.llm.components import components


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def groups_of(values):
    """The least index that each value reaches by pairs of at most four differing bits."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def clustered(seed, n=400):
    r = random.Random(seed)
    out = set()
    for _ in range(n // 40):
        x = r.getrandbits(64)
        for _ in range(40):  # walks, balls and strays
            y = x
            for _ in range(r.randint(0, 4)):
                y ^= 1 << r.randrange(64)
            out.add(y)
            if r.random() < 0.3:
                x = y
    return sorted(out | {r.getrandbits(64) for _ in range(n)})


@pytest.mark.parametrize("text", [None, "", "  ", "A b", "A B c D", "a b c d e", "Über STRASSE É x y", "x" * 100_000, "w " * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("seed", range(3))
def test_traverse_is_whole(seed):
    values = clustered(seed)
    a = np.array(values, np.uint64)
    i, j = simhash.traverse(a, np.array([0]), [(0, len(a), 0, len(a), 0)])
    assert all((values[x] ^ values[y]).bit_count() <= 4 for x, y in zip(i, j, strict=True))
    assert list(simhash._roots(len(a), i, j)) == groups_of(values)


def test_layouts():
    """Any four differing bits leave the front of some layout alone, and layouts can be undone."""
    r = random.Random(9)
    for blocks in (5, 6, 7, 8):
        fronts = [({bit for first, n in pieces for bit in range(first, first + n)}, [b for first, n in pieces for b in range(first, first + n)][:front]) for front, pieces in simhash.layouts(blocks)]
        assert all(sorted(whole) == list(range(64)) for whole, _ in fronts)
        for _ in range(200):
            bits = set(r.sample(range(64), 4))
            assert any(bits.isdisjoint(front) for _, front in fronts)
    assert simhash.blocks_for(10**6, 50_000) == 5 and simhash.blocks_for(10**10, 50_000) == 6


@pytest.mark.parametrize(("max_node", "blocks"), [(50_000, None), (12, None), (50_000, 6), (12, 7)])
def test_links_and_components(spark, max_node, blocks):
    """Small nodes force every group to be split among tasks."""
    values = clustered(7)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {r.node: r.root for r in components(simhash.links(fps, max_node, blocks)).collect()}
    root = groups_of(values)
    # roots are the least signed value of a component: compare the partitions
    ours = {}
    for v in signed:
        ours.setdefault(got.get(v, v), set()).add(v)
    theirs = {}
    for v, g in zip(signed, root, strict=True):
        theirs.setdefault(g, set()).add(v)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_grouped_against_brute_force(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    values = [brute_fingerprint(t) for _, t in rows]
    root = groups_of(values)
    least = {}
    for (doc, _), g in zip(rows, root, strict=True):
        least[g] = min((x for x in (doc, least.get(g)) if x is not None), default=None)
    expected = sorted(((d, f"{v:016x}", least[g]) for (d, _), v, g in zip(rows, values, root, strict=True)), key=str)
    assert sorted((tuple(r) for r in simhash.grouped(odd_docs).collect()), key=str) == expected


def test_representatives(odd_docs):
    kept = simhash.representatives(odd_docs)
    assert kept.columns == odd_docs.columns
    groups = {r.component_id for r in simhash.grouped(odd_docs).collect()}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(g for g in groups if g is not None)


def test_empty(no_docs):
    assert simhash.grouped(no_docs).count() == 0
    assert simhash.representatives(no_docs).count() == 0


def test_chain_of_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}


def test_unlike_texts_of_one_id_all_stay(spark):
    """Null and repeated ids name several components; each keeps a row, and exact copies one."""
    texts = [" ".join(f"{w}{i * i % 97}" for i in range(60)) for w in ("red", "green", "blue", "black")]
    rows = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (None, texts[0]), (9, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, simhash.representatives(docs).collect())) == sorted(map(str, spark.createDataFrame(rows[:4], docs.schema).collect()))
