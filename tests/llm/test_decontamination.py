import hashlib
import random
import re

import pytest

from tessera.llm import decontamination


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words_of(text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w = words_of(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k : k + n]))
                if own is not None:
                    hit |= set(range(k, k + n))
                    found |= own - {None}
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def run(docs, items):
    out = decontamination.decontaminated(docs, items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return sorted((tuple(r) for r in out.collect()), key=str)


ITEMS = [(1, "One, two; three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "a b"), (3, "alone"), (4, None), (5, "..."), (None, "no id here at all"), (6, "x y x y x y x y x y x y x y x"), (2, "under two texts"), (7, "a b")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def test_against_brute_force(spark, items):
    r = random.Random(1)
    pool = "a b alone x y one two three four five six seven eight nine ten eleven twelve thirteen fourteen under texts no id here at all z0 z1 z2".split()
    rows = [(k, " ".join(r.choices(pool, k=r.randint(0, 60)))) for k in range(150)]
    whole = words_of(ITEMS[0][1])
    rows += [(200 + k, " ".join(["pad"] * k + whole[k % 3 :] + ["end"] * 30)) for k in range(20)]
    rows += [(300, None), (301, ""), (302, "x y " * 4000), (None, "a b"), (303, "ALONE-alone"), (303, "alone"), (303, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert run(docs, items) == brute(rows, ITEMS)


def test_odd_documents(odd_docs, no_docs, items):
    out = decontamination.decontaminated(odd_docs, items)
    assert set(odd_docs.columns) <= set(out.columns) and out.count() == odd_docs.count()
    assert run(odd_docs, items) == brute([(r.doc_id, r.text) for r in odd_docs.collect()], ITEMS)
    assert decontamination.decontaminated(no_docs, items).count() == 0
    assert not any(r[2] for r in run(odd_docs, items.limit(0)))


def test_joins_without_broadcast(spark, items, odd_docs, monkeypatch):
    monkeypatch.setattr(decontamination, "MAX_BROADCAST_ROWS", 0)
    assert run(odd_docs, items) == brute([(r.doc_id, r.text) for r in odd_docs.collect()], ITEMS)
