"""Lists of the best ids and scores of many queries at once."""

from __future__ import annotations

import numpy as np

#: The id of an empty place, whose score is -inf.
LAST = np.iinfo(np.int64).max
#: Rows of a tile at first and at most, and queries that are multiplied with it.
FIRST, TILE, ROWS = 256, 4096, 1024


def merge_hits(best: np.ndarray, score: np.ndarray, row: np.ndarray, ids: np.ndarray, value: np.ndarray) -> None:
    """Put hits (row, id, value) into full lists of best ids and scores, in place; ties to the smaller id."""
    rows, k = np.unique(row), best.shape[1]
    of = np.concatenate([np.repeat(rows, k), row])
    ids, value = np.concatenate([best[rows].ravel(), ids]), np.concatenate([score[rows].ravel(), value])
    order = np.lexsort((ids, -value, of))
    chosen = order[np.searchsorted(of[order], rows)[:, None] + np.arange(k)]
    best[rows], score[rows] = ids[chosen], value[chosen]


def empty_lists(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full((n, k), LAST), np.full((n, k), -np.inf)


def best_cosines(best: np.ndarray, score: np.ndarray, q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray, least: np.ndarray | float = -np.inf, exclude_self: bool = True) -> None:
    """Raise the lists of best ids and scores of unit queries q by unit rows m, in place: cosines rounded to six digits and of at least `least`, ties to the smaller id.

    Products are made in 32-bit floats; those near a query's last score or above it are made again in 64 bits, so that nothing is lost.
    """
    k, slack = best.shape[1], 1e-6 + (q.shape[1] + 8) * 2.0**-23
    held, floor = m.astype(np.float32), np.broadcast_to(least, len(q))
    for c in range(0, len(q), ROWS):
        own, lists, values, low = q[c : c + ROWS], best[c : c + ROWS], score[c : c + ROWS], floor[c : c + ROWS]
        asked, a, step = own.astype(np.float32), 0, FIRST
        while a < len(ids):
            near = asked @ held[a : a + step].T
            bar = np.maximum(low, values[:, -1]) - slack
            if near.shape[1] > k + 1 and np.isinf(values[:, -1]).any():
                # One more than k, as one may be the query itself.
                bar = np.maximum(bar, np.partition(near, near.shape[1] - k - 1, axis=1)[:, -k - 1] - 2 * slack)
            i, j = np.nonzero(near >= bar[:, None])
            if exclude_self:
                other = q_ids[c + i] != ids[a + j]
                i, j = i[other], j[other]
            # Where much is near, a product of all costs less than one for each pair.
            exact = (own @ m[a : a + step].T)[i, j] if 16 * len(i) > near.size else np.einsum("ij,ij->i", own[i], m[a + j])
            value, found = np.round(exact, 6), ids[a + j]
            last = values[i, -1]
            keep = (value >= low[i]) & ((value > last) | ((value == last) & (found < lists[i, -1])))
            if keep.any():
                merge_hits(lists, values, i[keep], found[keep], value[keep])
            a, step = a + step, min(4 * step, TILE)


def first_copies(ids: np.ndarray, marks: np.ndarray, m: np.ndarray, n: int) -> np.ndarray:
    """Places of rows, in order of their ids, without those that n equal rows of smaller ids come before. marks: a hash of each row."""
    order = np.lexsort((ids, marks))
    new = np.ones(len(ids), bool)
    new[1:] = marks[order[1:]] != marks[order[:-1]]
    start = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
    gone = np.flatnonzero(np.arange(len(ids)) - start >= n)
    # A row goes only if it is equal to the n before it, whatever the hash says.
    for back in range(1, n + 1):
        gone = gone[(m[order[gone]] == m[order[gone - back]]).all(1)]
    keep = np.ones(len(ids), bool)
    keep[order[gone]] = False
    kept = np.flatnonzero(keep)
    return kept[np.argsort(ids[kept], kind="stable")]
