import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import periodic


def brute_runs(w, exponent=4, least=6):
    out, a = {}, np.array([hash(x) for x in w])
    for q in range(1, len(w) // exponent + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], a[:-q] == a[q:], [0]])))
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if j + q - i >= max(least, exponent * q):
                out.setdefault((i, j + q - i), q)
    return sorted((s, n, q) for (s, n), q in out.items())


def brute(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and w and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = brute_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines, kept = "".join(f"{s},{n},{q}\n" for s, n, q in found), " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha(lines), sha(kept))


def periodic_text(r):
    w = []
    for _ in range(r.randint(1, 6)):
        unit = r.choices("abc", k=r.randint(1, 7))
        w += (unit * r.randint(1, 9))[: r.randint(1, 40)]
        w += r.choices("abcdefghi", k=r.randint(0, 12))
    return w


@pytest.mark.parametrize(("exponent", "least"), [(4, 6), (2, 2), (3, 4), (2, 9), (5, 6)])
def test_runs_against_brute_force(exponent, least):
    r = random.Random(exponent)
    for _ in range(400):
        w = periodic_text(r)
        assert periodic.runs(w, exponent, least) == brute_runs(w, exponent, least)
    for n in range(40):
        assert periodic.runs(["x"] * n, exponent, least) == brute_runs(["x"] * n, exponent, least)


def test_states_are_those_of_the_text():
    """Every distinct part of a text is counted once by the lengths that its states add to their links'."""
    w = [0, 1, 0, 1, 1, 0, 1, 0, 0, 1]
    link, length, _ = periodic.automaton(w)
    parts = {tuple(w[i:j]) for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    assert sum(length[s] - length[link[s]] for s in range(1, len(link))) == len(parts)


def test_ends_stay_ordered(monkeypatch):
    monkeypatch.setattr(periodic, "PART", 4)
    r = random.Random(2)
    all_ = r.sample(range(1000), 300)
    ends, held = periodic.Ends(all_[0]), [all_[0]]
    for x in all_[1:]:
        below = max((y for y in held if y < x), default=-1)
        above = min((y for y in held if y > x), default=-1)
        assert ends.add(x) == (below, above)
        held.append(x)
    assert list(ends) == sorted(held)


def test_long_runs_stay_fast(prose):
    words = prose(20_000, 3).split()
    assert periodic.runs(words * 5) == [(0, 100_000, 20_000)]
    assert periodic.runs(["x"] * 100_000) == [(0, 100_000, 1)]


def test_cut_between_stretches(prose):
    words = prose(500, 4).split()
    assert periodic.stretches(np.arange(500), 5) == []
    assert periodic.runs(words + ["a", "b"] * 4 + words) == [(500, 8, 2)]


def test_collapsed(spark):
    docs = spark.createDataFrame([(1, "so  a b a b a b a b\nend"), (2, "la la la la la"), (3, "la la la la la la x"), (4, "a b c a b c a b c a b")], "doc_id long, text string")
    got = {r.doc_id: ([tuple(x) for x in r.runs], r.text) for r in periodic.collapsed(docs).collect()}
    assert got == {1: ([(1, 8, 2)], "so a b end"), 2: ([], "la la la la la"), 3: ([(0, 6, 1)], "la x"), 4: ([], "a b c a b c a b c a b")}
    with pytest.raises(ValueError):
        periodic.collapsed(docs, exponent=1)


def test_odd_input(spark, odd_docs, tmp_path):
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in periodic.op11(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((brute(r.doc_id, r.text) for r in odd_docs.collect()), key=str)


def test_query_against_brute_force(spark, prose, tmp_path):
    r = random.Random(7)
    rows = [(k, " ".join(periodic_text(r))) for k in range(150)] + [(k, prose(r.randint(1, 200), k)) for k in range(150, 300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(x) for x in periodic.op11(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((brute(*x) for x in rows), key=lambda x: x[0])


def test_empty(no_docs):
    assert periodic.collapsed(no_docs).count() == 0
