import hashlib
import re

import numpy as np
import pytest

from tessera.llm import substrings


def brute(rows):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    owner = {}
    for d, w in words:
        if d is not None:
            for k in range(len(w) - 49):
                owner[tuple(w[k : k + 50])] = min(d, owner.get(tuple(w[k : k + 50]), d))
    out = []
    for d, w in words:
        gone = set()
        if d is not None:
            for k in range(len(w) - 49):
                if owner[tuple(w[k : k + 50])] < d:
                    gone |= set(range(k, k + 50))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("max_group", [5_000, 60, 1])
def test_against_brute_force(odd_docs, max_group):
    """With tiny groups prefixes are lengthened, up to whole windows."""
    got = substrings.deduplicated(odd_docs, max_group).drop("kept_text").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])


def test_kept_text(spark, prose):
    passage = prose(60, 11)
    docs = spark.createDataFrame([(1, f"a {passage} b"), (2, f"c\n{passage}\td")], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in substrings.deduplicated(docs).collect()}
    assert got == {1: (0, f"a {passage} b"), 2: (60, "c d")}


def test_repeats_within_a_document_stay(spark, prose):
    docs = spark.createDataFrame([(1, " ".join([prose(70, 12)] * 3)), (2, "x " * 300)], "doc_id long, text string")
    assert [r.n_removed for r in substrings.deduplicated(docs).collect()] == [0, 0]


def test_anchors_follow_content(prose):
    """Every window has one anchor, the same wherever the window stands, and few positions are anchors."""
    passage = prose(200, 13)
    a, b = substrings.anchors(prose(77, 14) + " " + passage), substrings.anchors(passage + " " + prose(33, 15))
    at = lambda f, p: f[2][np.searchsorted(f[4], p, "right")]
    assert all(at(a, 77 + k) == at(b, k) for k in range(151))
    assert len(substrings.anchors(prose(20_000, 16))[2]) < 2_000


def test_empty(no_docs):
    assert substrings.deduplicated(no_docs).count() == 0


def test_suffix_array():
    """Against sorting, on few words, so that prefixes are long."""
    r = np.random.default_rng(3)
    words = np.concatenate([r.integers(0, 2, 400), np.zeros(120, int), r.integers(0, 2, 5), np.zeros(100, int), np.tile(r.integers(0, 3, 7), 30)])
    suffixes = np.arange(len(words) - 49)
    order, lcp = substrings.suffix_array(words, suffixes)
    window = lambda k: tuple(words[k : k + 50])
    assert sorted(order.tolist()) == suffixes.tolist() and [window(k) for k in order] == sorted(map(window, suffixes))
    common = lambda a, b: next((i for i in range(50) if words[a + i] != words[b + i]), 50)
    assert lcp.tolist() == [0, *(common(a, b) for a, b in zip(order, order[1:]))]
    low, high = substrings.deep_nodes(lcp)
    groups = {}
    for k in suffixes.tolist():
        groups.setdefault(window(k), set()).add(k)
    assert sorted(map(sorted, (set(order[a:b].tolist()) for a, b in zip(low, high)))) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


@pytest.mark.parametrize("max_group", [5_000, 200])
def test_large_groups(spark, prose, max_group):
    """Many copies, near copies, and one passage in many documents; also texts of few words and a word said over and over."""
    whole, passage = prose(150, 20), prose(70, 21)
    rows = [(k, whole) for k in range(60)] + [(100 + k, whole.replace(whole.split()[k], "changed", 1)) for k in range(60)]
    rows += [(200 + k, prose(k % 7, 22 + k) + " " + passage + " " + prose(20, 300 + k)) for k in range(60)]
    rows += [(300 + k, "x " * (40 + 5 * k)) for k in range(30)] + [(400 + k, "a b " * 80 + "c" * (k % 3)) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substrings.deduplicated(docs, max_group).drop("kept_text").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


@pytest.mark.parametrize("max_group", [10**9, 1])
def test_equal_rows(spark, prose, max_group):
    """What is told of repeated rows grows with their number, not with its square."""
    rows = [(1, prose(60, 40))] + [(2, prose(60, 40) + " " + prose(9, 41))] * 1000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert substrings.repeated_spans(docs, max_group).count() <= 20 * len(rows)
    assert {tuple(r)[:3] for r in substrings.deduplicated(docs, max_group).drop("kept_text").collect()} == {(1, 60, 0), (2, 69, 60)}


def test_windows_of_large_groups_meet_by_part(spark, prose, monkeypatch):
    """A passage of many documents is joined once for each part of its group, not once for each document."""
    made, join = [], substrings.spread_join

    def counted(many, one, keys, by):
        out = join(many, one, keys, by)
        if keys == ["words"]:
            made.append(out.where("owner < least").count())
        return out

    monkeypatch.setattr(substrings, "spread_join", counted)
    rows = [(k, f"first{k} {prose(60, 50)} last{k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substrings.deduplicated(docs, 300).drop("kept_text").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert made and 0 < sum(made) < len(rows)
