"""An embedding model fitted to the corpus: a truncated singular value decomposition of its TF-IDF matrix.

The matrix has a row for each document and a column for each word of a bounded vocabulary, and is never gathered. Subspace
iteration needs only its product with a thin matrix, twice: each task multiplies its own rows, forth and back, and gives its
share of the result in blocks of words, which are shuffled and added. What the driver holds is as large as the model.

A model is pinned: its revision is a digest of its words and factors, so that vectors of another fit are refused.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import tokens

#: Words of the vocabulary, dimensions, more directions than are kept, and rounds. Parameters of fit().
WORDS, DIMENSION, MORE, ROUNDS = 20_000, 64, 16, 4
#: A share is told in blocks of so many bytes: a batch of Arrow has up to 10,000 of them, however many tasks there are.
BLOCK_BYTES = 16_000
#: Entries of the matrix that a task multiplies at once.
CELLS = 200_000


def _words(text: str) -> list[str]:
    """As functions.text.tokens has them."""
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFC", text).lower())


@dataclass(frozen=True)
class FittedBackend:
    """Documents as unit vectors in the space of the factors (a row for each word, already times its weight)."""

    words: dict[str, int]
    factors: np.ndarray
    captured: float
    name: str = "fitted"

    @property
    def dimension(self) -> int:
        return self.factors.shape[1]

    @property
    def revision(self) -> str:
        told = hashlib.sha256("\n".join(self.words).encode())
        told.update(np.ascontiguousarray(self.factors, np.float32).tobytes())
        return told.hexdigest()[:16]

    def embed(self, documents: list[str]) -> list[list[float]]:
        """A document without a word of the vocabulary is a vector of zeros."""
        out = []
        for d in documents:
            places, counts = np.unique([self.words[w] for w in _words(d) if w in self.words] or [-1], return_counts=True)
            v = np.log1p(counts) @ self.factors[places] if places[0] >= 0 else np.zeros(self.dimension)
            out.append((v / (np.linalg.norm(v) or 1.0)).astype(np.float32).tolist())
        return out

    def stored(self, spark, path: str) -> FittedBackend:
        """A row for each word, in order."""
        rows = [(k, w, self.factors[k].tolist()) for w, k in self.words.items()]
        spark.createDataFrame(rows, "place int, word string, factors array<float>").withColumn("captured", F.lit(self.captured)).write.mode("overwrite").parquet(path)
        return self

    @classmethod
    def read(cls, spark, path: str) -> FittedBackend:
        rows = spark.read.parquet(path).orderBy("place").collect()  # the model
        factors = np.array([r.factors for r in rows], np.float32)
        return cls({r.word: r.place for r in rows}, factors, rows[0].captured)


def vocabulary(documents: DataFrame, words: int = WORDS) -> tuple[dict[str, int], np.ndarray, int]:
    """The words that most of the documents (document) have, two at least, with their inverse frequencies, and how many
    documents there are."""
    total = documents.count()
    each = documents.select(F.explode(F.array_distinct(tokens(F.col("document")))).alias("word"))
    often = each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(words).collect()
    return {r.word: k for k, r in enumerate(often)}, np.log((1.0 + total) / (1.0 + np.array([r.n for r in often], float))) + 1.0, total


def _cells(documents: DataFrame, words: dict[str, int]) -> DataFrame:
    """places and counts of each document's words that the vocabulary has."""
    known = F.broadcast(documents.sparkSession.createDataFrame(list(words.items()), "word string, place int"))  # WORDS rows at most
    numbered = documents.select(F.monotonically_increasing_id().alias("doc"), tokens(F.col("document")).alias("words"))
    own = numbered.select("doc", F.explode("words").alias("word"))
    counted = own.join(known, "word").groupBy("doc", "place").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("doc").agg(F.collect_list(F.struct("place", "n")).alias("cells"))


def _product(idf: np.ndarray, q: np.ndarray):
    """Each task's rows A of the matrix as its share of A'(Aq), in blocks of words, and of the squares of A."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares = np.zeros_like(q), 0.0
        for b in batches:
            ends = np.cumsum(b.column("cells").value_lengths().to_numpy())
            low = 0
            while low < len(b):  # whole documents, and bounded memory
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + CELLS, "right")))
                cells = b.column("cells").slice(low, high - low)
                owner = np.repeat(np.arange(high - low), cells.value_lengths().to_numpy())
                flat = cells.flatten()
                place = flat.field("place").to_numpy()
                w = np.log1p(flat.field("n").to_numpy()) * idf[place]
                w /= np.sqrt(np.bincount(owner, w * w))[owner]
                y = np.zeros((high - low, q.shape[1]))
                np.add.at(y, owner, q[place] * w[:, None])
                np.add.at(total, place, y[owner] * w[:, None])
                squares += float((w * w).sum())
                low = high
        step = max(1, BLOCK_BYTES // (8 * q.shape[1]))
        for at in range(0, len(q), step):
            yield _share(at, total[at : at + step], squares if at == 0 else 0.0)

    return run


def _share(at: int, block: np.ndarray, squares: float) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([block.tobytes()]), pa.array([squares])], ["at", "block", "squares"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shares, sorted by their place, added."""
    at, total, squares = None, None, 0.0
    for b in batches:
        for of, block, more in zip(b.column("at"), b.column("block"), b.column("squares"), strict=True):
            own = np.frombuffer(block.as_buffer())
            if of.as_py() == at:
                total, squares = total + own, squares + more.as_py()
                continue
            if at is not None:
                yield _share(at, total, squares)
            at, total, squares = of.as_py(), own.copy(), more.as_py()
    if at is not None:
        yield _share(at, total, squares)


def fit(documents: DataFrame, dimension: int = DIMENSION, words: int = WORDS, more: int = MORE, rounds: int = ROUNDS, seed: int = 7, keep=lambda df: df) -> FittedBackend:
    """The model of documents (document): the leading right singular vectors of their TF-IDF matrix, rows at unit length, by
    randomised subspace iteration. captured: the share of the matrix's squares that they hold. keep may write the rows,
    which every round reads. All documents count; the vocabulary is bounded."""
    vocab, idf, _ = vocabulary(documents, words)
    if not vocab:
        raise ValueError("no word is in two documents")
    cells = keep(_cells(documents, vocab))
    width = min(dimension + more, len(vocab))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(vocab), width)))[0]
    schema = "at long, block binary, squares double"
    for k in range(rounds + 1):
        shares = cells.select("cells").mapInArrow(_product(idf, q), schema)
        found = shares.repartition("at").sortWithinPartitions("at").mapInArrow(_summed, schema).collect()  # as large as the model
        z = np.zeros_like(q)
        for r in found:
            own = np.frombuffer(r.block).reshape(-1, width)
            z[r.at : r.at + len(own)] = own
        if k < rounds:
            q = np.linalg.qr(z)[0]
    values, turn = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
    order = np.argsort(-values)[:dimension]
    v = q @ turn[:, order]
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1, 1)  # one of the two signs
    total = sum(r.squares for r in found)
    return FittedBackend(vocab, (v * idf[:, None]).astype(np.float32), float(values[order].sum() / total))
