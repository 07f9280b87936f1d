"""The k best of many queries in a task, from matrices of scores."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: Scores that are looked at at once.
CELLS = 4_000_000


def slices(b: pa.RecordBatch, wide: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that make matrices of up to CELLS cells, wide in a row."""
    step = max(1, CELLS // max(1, wide))
    return (b.slice(low, step) for low in range(0, len(b), step))


def best_of_task(found: Iterable[tuple[np.ndarray, pa.Array, np.ndarray | None]], names: list, k: int) -> Iterator[pa.RecordBatch]:
    """query_id, id and score of the k best rows of each column over all of a task's matrices (scores, ids, told), ties by
    id; a score that is no number is null and last. told: which scores count at all. Only the best so far are held."""
    held = None
    for scores, ids, told in found:
        new = _best(*_able(scores, ids, told, k), k)
        held = new if held is None else _best(np.concatenate([held[0], new[0]]), pa.concat_arrays([held[1], new[1]]), np.concatenate([held[2], new[2]]), k)
    if held is not None:
        column, ids, score = held
        yield pa.RecordBatch.from_arrays([pa.array(names).take(pa.array(column)), ids, pa.array(score, mask=np.isnan(score))], ["query_id", "id", "score"])


def _able(scores: np.ndarray, ids: pa.Array, told: np.ndarray | None, k: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Columns, ids and scores of those that can be among the best k."""
    known = np.where(np.isnan(scores), -np.inf, scores)
    if told is not None:
        known[~told] = np.nan
    if len(known) > k:
        # the k-th best of each column bounds those that can be among its best
        bound = -np.partition(np.where(np.isnan(known), np.inf, -known), k - 1, axis=0)[k - 1]
        row, column = np.nonzero(known >= bound)
    else:
        row, column = np.nonzero(~np.isnan(known))
    return column, ids.take(pa.array(row)), scores[row, column]


def _best(column: np.ndarray, ids: pa.Array, score: np.ndarray, k: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    place = pc.rank(ids, sort_keys="ascending", tiebreaker="first").to_numpy().astype(np.int64) if len(ids) else np.zeros(0, np.int64)
    order = np.lexsort([place, np.where(np.isnan(score), np.inf, -score), column])
    own = column[order]
    order = order[np.arange(len(own)) - np.searchsorted(own, own, "left") < k]
    return column[order], ids.take(pa.array(order)), score[order]
