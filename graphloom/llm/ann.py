"""Approximate nearest neighbours with a hash-prefix forest.

Every tree turns vectors by a random matrix and gives each a string of
``LETTERS`` letters: the signed axes nearest to the turned vector, the nearest
first.  The tree is the sorted array of these strings.  A query descends in
every tree to its longest matching prefixes, and all trees ascend together,
one letter at a time, until the ranges that share the prefix hold enough
entries.  The rows found are ranked by the number of trees that found them;
again from the top downward, counts are taken in until there are about
``reach`` times the square root of the number of vectors, over all shards.
These candidates are ranked by the inner product itself, in double precision.
So the candidates' share of the vectors falls as the table grows.  For inner
products of vectors of unlike lengths, vectors get one more component that
makes them all as long as the longest, so that angles rank like inner products.

The index holds every vector: they are dealt into shards by a hash and each
shard is a forest of its own; queries visit all shards.  Equal vectors are one
entry with all their ids, so ties come out by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.vectors import Cell, best, cells, dealt, usable

LETTERS = 4
AXES = 128  #: of a turned vector at most, so that a letter fits in a byte
TREES = 192
REACH = 10.0  #: candidates of a query over the square root of the number of vectors


class PrefixForest:
    """Sorted arrays of hash strings over the rows of a matrix."""

    def __init__(self, x: np.ndarray, trees: int = TREES, seed: int = 3):
        rng = np.random.default_rng(seed)
        norms = np.sqrt((x * x).sum(axis=1))
        longest = norms.max(initial=0.0)
        width = x.shape[1] + 1
        self.turns = rng.standard_normal((trees, width, min(width, AXES))).astype(np.float32)
        lifted = np.hstack([x, np.sqrt(np.maximum(longest * longest - norms * norms, 0.0))[:, None]])
        self.order, self.keys = [], []
        for turn in self.turns:
            keys = self._strings(lifted, turn)
            order = np.argsort(keys, kind="stable")
            self.order.append(order.astype(np.int32))
            self.keys.append(keys[order])

    @staticmethod
    def _strings(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """The strings as integers, the first letter in the highest byte; a letter is 1 to 256 less one: axis and sign."""
        size = np.sqrt((x * x).sum(axis=1, keepdims=True))
        y = (x / np.where(size > 0, size, 1.0)).astype(np.float32) @ turn
        far, rows = np.abs(y), np.arange(len(x))
        out = np.zeros(len(x), np.uint64)
        for _ in range(LETTERS):
            axis = far.argmax(axis=1)
            letter = axis * 2 + (y[rows, axis] > 0)
            out = out << np.uint64(8) | letter.astype(np.uint64)
            far[rows, axis] = -1.0
        return out

    def candidates(self, queries: np.ndarray, wanted: int) -> Iterator[np.ndarray]:
        """For each query about ``wanted`` rows: those that most trees find by the prefixes in common."""
        lifted = np.hstack([queries, np.zeros((len(queries), 1))])
        strings = [self._strings(lifted, turn) for turn in self.turns]
        for at in range(0, len(queries), 64):
            yield from self._found([s[at : at + 64] for s in strings], wanted)

    def _found(self, strings: list[np.ndarray], wanted: int) -> Iterator[np.ndarray]:
        n, q = len(self.keys[0]), len(strings[0])
        low, high = np.zeros((len(strings), q), np.int64), np.zeros((len(strings), q), np.int64)
        open_ = np.arange(q)
        for level in range(LETTERS, 0, -1):  # ascend in all trees at once
            free = np.uint64((1 << 8 * (LETTERS - level)) - 1)
            for t, (keys, s) in enumerate(zip(self.keys, strings, strict=True)):
                low[t, open_] = np.searchsorted(keys, s[open_] & ~free, "left")
                high[t, open_] = np.searchsorted(keys, s[open_] | free, "right")
            open_ = open_[(high - low)[:, open_].sum(axis=0) < 4 * wanted]
            if not len(open_):
                break
        size = high - low
        votes = np.zeros((q, n), np.int32)
        for k in range(q):
            parts = [order[a:b] for order, a, b in zip(self.order, low[:, k].tolist(), high[:, k].tolist(), strict=True) if b > a]
            if parts:
                votes[k] = np.bincount(np.concatenate(parts), minlength=n)
        for k in range(q):
            if n <= wanted or not size[:, k].any():
                yield np.arange(n)
                continue
            least = np.partition(votes[k], n - wanted)[n - wanted]
            yield np.flatnonzero(votes[k] >= least)


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products summed from the first component to the last, whatever else is computed beside them."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d] * q[d]
    return total


def search_cell(cell: Cell, k: int, trees: int, share: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each query of the cell: id, tag, and its k best of the shard with their scores."""
    rows = np.ascontiguousarray(cell.vectors)
    _, first, inverse = np.unique(rows.view(f"V{rows.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
    members = np.argsort(inverse, kind="stable")  # by class, then by id
    starts = np.searchsorted(inverse[members], np.arange(len(first) + 1))
    x = rows[first]
    forest = PrefixForest(x, trees)
    asked = np.array([v for _, _, v in cell.queries])
    enough = max(int(np.ceil(share * len(x))), 2 * (k + 1))
    for (query, tag, q), found in zip(cell.queries, forest.candidates(asked, enough), strict=True):
        near = x[found] @ q
        if len(found) > k + 1:
            cut = np.partition(near, len(near) - k - 1)[len(near) - k - 1]
            found = found[near >= cut - 1e-9 * max(1.0, abs(cut))]
        score = _exact(x[found], q)
        ids = [cell.ids[members[starts[c] : min(starts[c + 1], starts[c] + k + 1)]] for c in found]
        scores = np.repeat(score, [len(i) for i in ids])
        ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        other = ids != query
        ids, scores = ids[other], scores[other]
        top = np.lexsort((ids, -scores))[:k]
        yield query, tag, ids[top], scores[top]


def _search(batches: Iterator[pa.RecordBatch], k: int, trees: int, share: float) -> Iterator[pa.RecordBatch]:
    for cell in cells(batches):
        if not len(cell.ids) or not cell.queries:
            continue
        got = list(search_cell(cell, k, trees, share))
        sizes = [len(i) for _, _, i, _ in got]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([g[0] for g in got], sizes), pa.int64()), pa.array(np.repeat([g[1] for g in got], sizes), pa.int64()), pa.array(np.concatenate([g[2] for g in got]), pa.int64()), pa.array(np.concatenate([g[3] for g in got]), pa.float64())], ["query_id", "tag", "vec_id", "score"])


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, trees: int = TREES, reach: float = REACH, shard_rows: int = 8192, block_rows: int = 4096) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each row whose id is divisible by ``every``.

    Nearness is the inner product in double precision; ties go to the smaller
    id.  Null and zero vectors, vectors with null or non-finite components and
    rows with a null id take no part; vectors are compared with those of their
    length.  Rows of the query's own id are no candidates; rows that repeat
    another count once; an id with several vectors is several queries.  Other
    columns are ignored; an empty table gives no rows.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & usable(vector_col, zero=False)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    n = rows.count()
    share = min(1.0, reach / max(n, 1) ** 0.5)
    found = dealt(rows, n, every, shard_rows, block_rows).mapInArrow(partial(_search, k=k, trees=trees, share=share), "query_id long, tag long, vec_id long, score double")
    return best(found, k)
