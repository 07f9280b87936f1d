import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts(spark, odd_docs, prose):
    extra = ["a b c d e a b c d e f", "a a a a a a", "x\nx\n\n \nx", "#*$ %&|<>", "a b c d e", "w " * 3000, prose(50, 1) + "\n" + prose(50, 1)]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    texts = docs.collect()
    got = quality.judged(docs, keep_text=True).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_verdicts(spark, prose):
    """Clean documents stay, whatever share of the corpus is junk; of junk only some votes are seen at a time."""
    clean = [prose(80 + k % 50, k) + "." for k in range(300)]
    loud = [" ".join(w.upper() + "!!" for w in prose(60, 1000 + k).split()) for k in range(40)]
    marked = [" ".join(w + "&&&" for w in prose(60, 2000 + k).split()) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(clean + loud + marked)), "doc_id long, text string")
    kept = {r.doc_id for r in quality.judged(docs, keep_text=False).where("kept").collect()}
    assert kept == set(range(300))


def test_held_out_labels(spark):
    """The labels, which the estimate never sees."""
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").withColumnRenamed("quality", "label")
    out = quality.op4(spark, d).join(labels, "doc_id").where("NOT base_failed").collect()
    assert sum(r.kept == bool(r.label) for r in out) >= 0.98 * len(out)


def test_columns_and_empty(odd_docs, no_docs):
    assert set(odd_docs.columns) <= set(quality.judged(odd_docs).columns)
    assert quality.judged(no_docs).count() == 0


def brute_model(votes, rounds=3000):
    """Expectation-maximisation document by document, in arrays: the posterior of each."""
    v = np.array(votes)
    one = np.stack([(v == x).astype(float) for x in (-1, 0, 1)], axis=2)
    good, bad = (v > 0).sum(1), (v < 0).sum(1)
    q = (good + 0.5) / (good + bad + 1.0)
    for _ in range(rounds):
        rate = lambda p, prior: (np.einsum("d,djw->jw", p, one) + 2.0 * np.array(prior)) / (p.sum() + 2.0)
        g, b, share = rate(q, [0.1, 0.3, 0.6]), rate(1 - q, [0.4, 0.3, 0.3]), (q.sum() + 1) / (len(v) + 2)
        q = 1 / (1 + np.exp(-(np.log(share / (1 - share)) + np.einsum("djw,jw->d", one, np.log(g / b)))))
    return q


def test_verdicts_against_brute_force(spark):
    """Of the given documents: the same verdicts as of the plain estimate, and not those of "no bad vote"."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    names = [r.name for r in quality.RULES]
    voted = quality.features(docs).select("doc_id", *[quality.vote(r).alias(r.name) for r in quality.RULES])
    rows = quality.judged(docs, keep_text=False).join(voted, "doc_id").where("NOT base_failed").collect()
    votes = [[r[n] for n in names] for r in rows]
    expected = brute_model(votes)
    assert [r.kept for r in rows] == (expected >= 0.5).tolist()
    assert max(abs(r.quality - e) for r, e in zip(rows, expected)) < 1e-4
    assert len({r.quality for r in rows}) > 3


def test_given_documents_where_posterior_and_any_bad_vote_differ(spark):
    """Bad votes of some rules are overruled by the others; documents without one are still kept."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").withColumnRenamed("quality", "label")
    voted = quality.features(docs).select("doc_id", F.least(*[quality.vote(r) for r in quality.RULES]).alias("worst"))
    rows = quality.judged(docs, keep_text=False).join(voted, "doc_id").join(labels, "doc_id", "left").where("NOT base_failed").collect()
    overruled = [r for r in rows if r.kept and r.worst < 0]
    assert len(overruled) >= 10 and sum(r.label == 1 for r in overruled) >= 3
    labelled = [r for r in rows if r.label is not None]
    by_vote = sum((r.worst >= 0) == bool(r.label) for r in labelled)
    assert sum(r.kept == bool(r.label) for r in labelled) >= max(by_vote - 5, 0.99 * len(labelled))


def test_accurate_rules_outvote_a_poor_one():
    """Three rules agree on what is bad; a fourth votes bad at random. Its vote alone rejects nothing, and where the three
    are split, two accurate ones decide against one."""
    clean = [((1, 1, 1, 1), 800.0), ((1, 1, 1, -1), 90.0), ((1, 1, -1, 1), 8.0), ((1, -1, 1, 1), 8.0)]
    junk = [((-1, -1, -1, 1), 70.0), ((-1, -1, -1, -1), 8.0), ((-1, -1, 1, 1), 6.0), ((-1, 0, -1, 1), 6.0)]
    model = quality.fit(clean + junk, 4)
    good = {votes: 1 / (1 + np.exp(-(np.log(model.share / (1 - model.share)) + sum(w[v + 1] for w, v in zip(model.weights(), votes))))) for votes, _ in clean + junk}
    assert all(good[v] > 0.95 for v, _ in clean) and all(good[v] < 0.05 for v, _ in junk)
    assert 0.85 < model.share < 0.95
    weights = model.weights()
    assert abs(weights[3][0]) < 0.3 < 2 < -weights[0][0]
    assert weights[0][2] > 1  # a good vote is evidence too


def test_unsettled_estimates_are_told():
    patterns = [((1, 1), 90.0), ((-1, -1), 8.0), ((1, -1), 3.0)]
    with pytest.warns(UserWarning, match="still move"):
        quality.fit(patterns, 2, rounds=1)
    assert quality.fit([], 2).share == 0.5


@pytest.mark.parametrize("name", [r.name for r in quality.RULES])
def test_rules_have_room_to_abstain(name):
    rule = next(r for r in quality.RULES if r.name == name)
    assert rule.good < rule.bad
