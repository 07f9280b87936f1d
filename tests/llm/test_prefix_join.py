import random
import re

import numpy as np
import pytest

from tessera.llm import prefix_join
from tessera.llm.simhash import _roots


def brute_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute(rows, similar=90):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= similar * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def edited(r, words, share):
    return [r.choice("qwertyuiop") + w if r.random() < share else w for w in words]


def corpus(prose, seed, n=240):
    """Chains and balls of near copies at similarities about the least one, passages that many share, and strays."""
    r = random.Random(seed)
    passage = prose(40, 900)
    out = []
    for k in range(n // 12):
        base = prose(r.choice([4, 12, 40, 120, 300]), 1000 * seed + k).split()
        for _ in range(8):
            text = edited(r, base, r.choice([0, 0.005, 0.01, 0.017, 0.02, 0.05]))
            out.append(" ".join(text) if r.random() < 0.8 else " ".join(text + text[: r.randint(0, 4)]))
            if r.random() < 0.4:
                base = text
        out += [passage + " " + prose(30, r.random()), prose(60, r.random()) + "\n" + passage, passage.upper(), " ".join(base[:2])]
    return [(k + 1, t) for k, t in enumerate(out)]


@pytest.mark.parametrize(("seed", "similar", "part"), [(1, 90, 2_000_000), (2, 90, 300), (3, 60, 3_000), (4, 100, 1)])
def test_against_brute_force(spark, prose, seed, similar, part):
    """With small parts units are dealt out and their parts meet in pairs."""
    rows = corpus(prose, seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = prefix_join.grouped(docs, similar=similar, part=part).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, similar)


@pytest.mark.parametrize(("seed", "probes", "held"), [(1, 256, 200_000), (2, 3, 10), (3, 1, 1), (4, 100, 300)])
def test_tree_finds_all_links(monkeypatch, seed, probes, held):
    monkeypatch.setattr(prefix_join, "PROBES", probes)
    monkeypatch.setattr(prefix_join, "HELD", held)
    r = random.Random(seed)
    groups = [r.sample(range(200), 40) for _ in range(8)]
    sets = {(u, tuple(sorted({x if r.random() < 0.95 else r.randrange(200) for x in r.choice(groups)}))) for u in range(3) for _ in range(60)}
    rows = sorted(sets)
    unit, arrays = np.array([u for u, _ in rows]), [np.array(s) for _, s in rows]
    n = np.array([len(s) + r.randint(0, 2) for s in arrays])
    found = prefix_join.linked(arrays, unit, n, np.arange(len(rows)), 80)
    a, b = (np.concatenate(x) for x in zip(*found))
    true = [(i, j) for j in range(len(rows)) for i in range(j) if unit[i] == unit[j] and 180 * len(set(rows[i][1]) & set(rows[j][1])) >= 80 * (n[i] + n[j])]
    assert {*zip(a.tolist(), b.tolist())} <= {*true}
    x, y = np.array(true).T
    assert len({*_roots(len(rows), x, y)}) < len(rows) and (_roots(len(rows), a, b) == _roots(len(rows), x, y)).all()


def test_subtrees_are_left():
    """Sets that share their first numbers only are not followed to their ends."""
    sets = sorted([[0, 1, *range(100 * k, 100 * k + 90)] for k in range(1, 50)])
    tree = prefix_join.Tree([np.array(s) for s in sets], np.zeros(49, int), np.array([92] * 49))
    assert len(tree.token) == 1 + 2 + 49 * 90 and tree.many[0] == 1 and tree.many[2] == 49
    assert (tree.low[2], tree.high[2], tree.least[2], tree.most[2]) == (0, 49, 92, 92)


def test_odd_input(odd_docs):
    got = prefix_join.grouped(odd_docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])


def test_shuffled_when_too_many_to_broadcast(spark, prose, monkeypatch):
    monkeypatch.setattr(prefix_join, "MAX_BROADCAST", 0)
    rows = corpus(prose, 6, 60)
    got = prefix_join.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_slack():
    assert [prefix_join.slack(n) for n in (1, 9, 10, 11, 100)] == [0, 0, 1, 1, 10]


def test_empty(no_docs):
    assert prefix_join.grouped(no_docs).count() == 0
