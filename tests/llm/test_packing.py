import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing

TEXTS = ["", "a  b", " a", "a ", "\n\n x", "it's <|endoftext|> ok", "a　b c", "x  y", "tab\there", "a \n b", "a\nb", "don't we'll", "é́ \U0001f600 ok", "end.\nStart,", "1,000.5 a-b", "Hello, world!\nNew: line?", "x\x1cy z"]


@pytest.fixture(scope="module")
def tokenizer():
    return packing.default_tokenizer()


@pytest.mark.parametrize("text", TEXTS)
def test_ids(tokenizer, text):
    expected = Tokenizer.from_file(tokenizer).encode(text, add_special_tokens=False).ids
    for _ in range(2):  # the second time from memory
        assert np.frombuffer(packing._tool(tokenizer)(text), "<u4").tolist() == expected


def test_packed(odd_docs, tokenizer):
    docs = odd_docs.select("doc_id", "text").collect()
    rows = packing.packed(odd_docs, tokenizer).collect()
    own = Tokenizer.from_file(tokenizer)
    expected = []
    for d in docs:
        ids = [*own.encode(d.text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected.append((d.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(expected, key=str)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(bins) <= -(-sum(r.length for r in rows) // 2048) + 1


def brute(lengths, capacity, free):
    """Each piece where the sum of squares, counted anew, is smallest; ties to an open sequence, the smaller gap first."""
    gaps, where = [], []
    square = lambda x: sum(n * n for g, n in Counter(x).items() if g)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        options = []
        for g in sorted({g for g in gaps if g >= lengths[k]}):
            after = list(gaps)
            after[after.index(g)] -= lengths[k]
            options.append((square(after), 0, g))
        if free or not options:
            options.append((square([*gaps, capacity - lengths[k]]), 1, capacity))
        _, new, g = min(options)
        if new:
            gaps.append(capacity - lengths[k])
        else:
            gaps[gaps.index(g)] -= lengths[k]
        where.append((k, capacity - g))
    return Counter(gaps), dict(where)


@pytest.mark.parametrize("free", [True, False])
def test_every_decision(free):
    r = np.random.default_rng(5)
    for n in (0, 1, 7, 60, 150):
        lengths = r.integers(1, 41, n)
        sequence, offset, opened = packing.placed(lengths, 40, free)
        used = Counter()
        for s, length in zip(sequence, lengths, strict=True):
            used[s] += int(length)
        gaps, offsets = brute(lengths.tolist(), 40, free)
        assert Counter(40 - x for x in used.values()) == gaps and opened == len(used)
        assert offset.tolist() == [offsets[k] for k in range(n)]


def test_few_sequences():
    r = np.random.default_rng(3)
    lengths = np.minimum(2047, r.lognormal(6, 1, 30_000)).astype(int) + 1
    _, _, opened = packing.best_placed(lengths, 2048)
    assert opened <= 1.002 * lengths.sum() / 2048 + 1
    assert packing.best_placed(np.full(500, 2048), 2048)[2] == 500


def test_blocks(spark, tokenizer, prose):
    """Packed in several blocks; rows that are all alike are dealt evenly too."""
    docs = spark.createDataFrame([(k // 300, prose(40, k // 300)) for k in range(900)], "doc_id long, text string").repartition(3)
    rows = packing.packed(docs, tokenizer, block=200).collect()
    assert len(rows) == 900 and max(Counter(r.sequence_id >> 32 for r in rows).values()) <= 200
    ends = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048 and len(ends) <= sum(ends.values()) / 2048 + 10


def test_empty(no_docs, tokenizer):
    assert packing.packed(no_docs, tokenizer).count() == 0
