"""Best-fit packing by sums of squares.

A piece goes where the sum, over all residual gaps, of the squared counts of open sequences with that gap becomes
smallest (Csirik et al.). Only lengths matter to it: pieces are cut and counted first, and then placed one by one, in
blocks that each fit a task.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: Fixed values of the contract.
CAPACITY, END = 2048, 0
SPECIAL = "<|endoftext|>"
#: Words whose ids a worker keeps; beyond it, it starts again.
MEMORY = 1_500_000
#: Pieces that are packed together, in one task.
BLOCK = 200_000

_tools: dict = {}


#: White space that touches other white space or an end of the text, or is neither a space nor a line feed.
_ODD = re.compile(r"\s\s|^\s|\s$|[^\S \n]")
_TAIL = ".,;:!?"


def _tool(path: str):
    """A function that gives a text's ids as little-endian unsigned 32-bit bytes; each worker keeps one with its words."""
    if path not in _tools:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        held: dict[str, bytes] = {}
        direct = _fast(path)

        def word(part: str) -> bytes:
            """Of a part with the space or line feed before it: letters and what closes them are pieces of their own."""
            core = part.rstrip(_TAIL)
            if core != part and core.isalpha():
                known = held.get(core)
                if known is None:
                    known = held[core] = direct(" " + core)
                found = known + direct(part[len(core) :])
            else:
                found = direct(part if part[0] == "\n" else " " + part)
            held[part] = found
            return found

        def ids(text: str) -> bytes:
            if SPECIAL in text:  # only the tokenizer itself knows what to do with it
                return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            if _ODD.search(text):
                return direct(text)
            # a word after one space, or after one line feed, has its ids whatever stands around it
            first, *rest = text.replace("\n", " \n").split(" ")
            if len(held) > MEMORY:
                held.clear()
            got = list(map(held.get, rest))
            if None in got:
                got = [word(part) if known is None else known for part, known in zip(rest, got, strict=True)]
            return direct(first) + b"".join(got)

        _tools[path] = ids
    return _tools[path]


def _fast(path: str):
    """The same merges by a faster library. Its ranks are the ids: the file lists byte tokens, then the merges in order."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the rest follow from 256 on
    chars = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(chars[c] for c in token): n for token, n in vocabulary.items() if token != SPECIAL}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    encoding = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: array("I", encoding.encode_ordinary(text)).tobytes()


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece. Only a document longer than capacity is cut, from its
    end, so that its first piece may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _tool(tokenizer)
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                raw = ids(text or "") + END.to_bytes(4, "little")
                n = len(raw) // 4
                first = n % capacity or capacity
                for k, low in enumerate([0, *range(first, n, capacity)]):
                    high = first if not k else low + capacity
                    for column, value in zip(out, (doc, k, low, high - low, zlib.crc32(raw[4 * low : 4 * high])), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def placed(lengths: np.ndarray, capacity: int, free: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """The sequence and offset of each piece, and how many sequences there are. Longest pieces first, one by one, each where
    the sum over residual gaps of the squared counts of open sequences becomes smallest. free: a new sequence is always
    one of the places; else only where no open one has room."""
    counts = np.zeros(2 * capacity + 1, np.int64)  # open sequences by gap; none beyond capacity
    held: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened, none = 0, np.iinfo(np.int64).max
    order = np.argsort(-lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order])) + 1
    for own in np.split(order, edges) if len(order) else ():
        length = int(lengths[own[0]])
        # the change of the sum for each gap: of the gap itself, and of what is left of it unless that is nothing
        at = np.arange(length, capacity + 1)
        change = np.full(2 * capacity + 1, none)
        change[at] = np.where(counts[at] > 0, 2 * (counts[at - length] - counts[at]) + 2, none)
        change[length] = 1 - 2 * counts[length] if counts[length] else none
        fitting, left_of_new = change[length : capacity + 1], capacity - length
        for k in own.tolist():
            gap = length + int(fitting.argmin())
            best = change[gap]
            if best == none or (free and left_of_new and 2 * counts[left_of_new] + 1 < best):
                number, gap, touched = opened, capacity, []
                opened += 1
            else:
                number, touched = held[gap].pop(), [gap]
                counts[gap] -= 1
            left = gap - length
            if left:
                held[left].append(number)
                counts[left] += 1
                touched.append(left)
            sequence[k], offset[k] = number, capacity - gap
            for t in touched:
                if t > length:
                    change[t] = 2 * (counts[t - length] - counts[t]) + 2 if counts[t] else none
                elif t == length:
                    change[t] = 1 - 2 * counts[t] if counts[t] else none
                if counts[t + length]:
                    change[t + length] = 2 * (counts[t] - counts[t + length]) + 2
    return sequence, offset, opened


def best_placed(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """As sequences are to be few, the smaller of both packings."""
    return min((placed(lengths, capacity, free) for free in (True, False)), key=lambda x: x[2])


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row.

    Pieces are dealt evenly into blocks of about ``block``, each packed in a task of its own, so that every decision is
    made for one piece, whatever the size of the corpus; a block leaves a sequence or two unfilled.
    A null text counts as empty: one piece, the closing id alone. Repeated rows are packed each. Rows with a null doc_id
    are packed like others. A text of any length is cut whole. Other columns are ignored. An empty table gives no rows.
    """
    cut = materialize(pieces(docs, tokenizer, capacity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        whole = pa.Table.from_batches(held)
        sequence, offset, _ = best_placed(whole.column("length").to_numpy(), capacity)
        numbers = (whole.column("block").to_numpy().astype(np.int64) << 32) + sequence
        whole = whole.drop_columns("block").append_column("sequence_id", pa.array(numbers)).append_column("offset", pa.array(offset))
        yield from whole.to_batches(max_chunksize=10_000)

    dealt = cut.repartition(max(1, -(-cut.count() // block))).withColumn("block", F.spark_partition_id())
    return dealt.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
