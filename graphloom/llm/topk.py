"""Exact top-k search with a bit-sliced index.

Components are quantised to integers.  A shard keeps each component as bit
slices: one bitmap over the shard's rows for each binary digit.  A query adds
up the slices, weighted by its own integer components, with bitmap arithmetic
(carry-save adders); the result is the bit-sliced scores of all rows.  The top
rows are selected from the most significant slice downward, and rows that tie
at the boundary are resolved by id.  Bitmaps are Python's integers.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.vectors import best, cells, dealt, usable

SCALE = 256.0
_TOP = (1 << 63) - 1
_WIDE = 2200  #: bits that hold any score of doubles


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) as integers; Python's where 64 bits might not do."""
    if x.size and np.abs(x).max() >= 2.0**16:
        whole = [int(v) * int(SCALE) if abs(v) >= 2.0**53 else int(np.floor(SCALE * v)) for v in x.ravel().tolist()]
        out = np.empty(x.size, object)
        out[:] = whole
        return out.reshape(x.shape)
    return np.floor(SCALE * x).astype(np.int64)


class BitSlicedIndex:
    """The slices of a matrix of integers; rows keep their order."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.n = rows, len(rows)
        self.all = (1 << self.n) - 1
        self.slices: list[list[int]] = []
        for d in range(rows.shape[1]):
            column = rows[:, d] - rows[:, d].min()
            width = int(column.max()).bit_length()
            self.slices.append([int.from_bytes(np.packbits(((column >> b) & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(width)])

    def scores(self, weights: np.ndarray) -> list[int]:
        """Slices of each row's weighted sum, up to a constant, least significant first."""
        columns: dict[int, list[int]] = defaultdict(list)
        for w, slices in zip(weights.tolist(), self.slices, strict=True):
            if not w:
                continue
            if w < 0:  # subtracting is adding the complement, up to a constant
                w, slices = -w, [self.all ^ s for s in slices]
            shift = 0
            while w:
                if w & 1:
                    for b, s in enumerate(slices):
                        columns[shift + b].append(s)
                w >>= 1
                shift += 1
        out, at = [], 0
        while columns:
            todo = columns.pop(at, [])
            carries: list[int] = []
            while len(todo) > 2:
                a, b, c = todo.pop(), todo.pop(), todo.pop()
                half = a ^ b
                carries.append((a & b) | (half & c))
                todo.append(half ^ c)
            if len(todo) == 2:
                a, b = todo
                carries.append(a & b)
                todo = [a ^ b]
            if carries:
                columns[at + 1].extend(carries)
            out.append(todo[0] if todo else 0)
            at += 1
        return out

    def top(self, weights: np.ndarray, k: int, among: int) -> list[int]:
        """The k best of the rows in the bitmap ``among``; of ties the first rows."""
        sure, maybe = 0, among
        for s in reversed(self.scores(weights)):
            high = sure | (maybe & s)
            n = high.bit_count()
            if n > k:
                maybe &= s
            else:
                sure = high
                maybe &= ~s
                if n == k:
                    maybe = 0
                    break
        chosen = []
        while sure:
            bit = sure & -sure
            chosen.append(bit.bit_length() - 1)
            sure ^= bit
        while maybe and len(chosen) < k:
            bit = maybe & -maybe
            chosen.append(bit.bit_length() - 1)
            maybe ^= bit
        return chosen


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for cell in cells(batches):
        if not len(cell.ids) or not cell.queries:
            continue
        index = BitSlicedIndex(quantised(cell.vectors))
        queries, tags, ids, scores, beyond = [], [], [], [], []
        for query, tag, v in cell.queries:
            weights = quantised(v[None, :])[0]
            low, high = np.searchsorted(cell.ids, [query, query + 1])
            own = ((1 << int(high)) - 1) ^ ((1 << int(low)) - 1)
            for row in index.top(weights, k, index.all & ~own):
                score = int((index.rows[row] * weights).sum()) if index.rows.shape[1] else 0
                queries.append(query)
                tags.append(tag)
                ids.append(int(cell.ids[row]))
                scores.append(max(-_TOP, min(_TOP, score)))
                beyond.append("" if -_TOP < score < _TOP else format(score + (1 << _WIDE), f"0{_WIDE // 4 + 1}x"))
        columns = [pa.array(c, pa.int64()) for c in (queries, tags, ids, scores)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(beyond, pa.string())], ["query_id", "tag", "vec_id", "score", "beyond"])


def top_scores(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, shard_rows: int = 8192, block_rows: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best of all other rows by the quantised inner product.

    Queries are the rows whose id is divisible by ``every``; ties go to the
    smaller id.  Null vectors, vectors with null or non-finite components and
    rows with a null id take no part; vectors are compared with those of their length.  Rows of the query's
    own id are no candidates; rows that repeat another count once; an id with
    several vectors is several queries.  Scores beyond 64 bits
    are ranked exactly and reported as the nearest long.  Other
    columns are ignored; an empty table gives no rows.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & usable(vector_col, zero=True)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    found = dealt(rows, rows.count(), every, shard_rows, block_rows).mapInArrow(partial(_search, k=k), "query_id long, tag long, vec_id long, score long, beyond string")
    return best(found, k, "beyond")


REFERENCE_SQL = """
with e as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_dot_product(q.v::double[], c.v::double[])::bigint as score
  from e q join e c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v)
), r as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""
