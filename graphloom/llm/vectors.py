"""Dealing vectors and queries into cells that one task can search.

Vectors are dealt into shards by a hash of their id and queries into blocks;
every shard meets every block once, so each query sees all vectors, and a cell
is bounded by the sizes of a shard and a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Cell:
    """A shard's vectors, sorted by id and without repeated rows, and a block's queries."""

    ids: np.ndarray
    vectors: np.ndarray
    queries: list[tuple[int, int, np.ndarray]]  #: id, tag, vector


def usable(column: str, zero: bool) -> Column:
    """Rows whose vector has finite components only; ``zero``: whether zero vectors count."""
    c = F.col(column)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & ~bad & (F.lit(True) if zero else F.exists(c, lambda x: x != 0))


def dealt(vectors: DataFrame, n: int, every: int, shard_rows: int, block_rows: int) -> DataFrame:
    """``dim, shard, block, query, id, tag, v`` of ``n`` vectors, sorted by cell, a cell's vectors before its queries.

    Rows are dealt by id and vector, so rows of one id spread and equal rows meet.
    """
    rows = vectors.select(F.col("id"), F.col("v"), F.size("v").alias("dim"))
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n // (every * block_rows)))
    shard = F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(blocks)).cast("int")
    own = rows.select("dim", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("query"), "id", F.lit(0).cast("long").alias("tag"), "v")
    asked = rows.where(F.col("id") % every == 0)
    asked = asked.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), block.alias("block"), F.lit(1).alias("query"), "id", F.xxhash64("v").alias("tag"), "v")
    return own.unionByName(asked).repartition("dim", "shard", "block").sortWithinPartitions("dim", "shard", "block", "query", "id", "tag")


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[Cell]:
    """The cells of a partition, one at a time."""
    at: tuple | None = None
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def made() -> Cell:
        query, ids, tags, v = (np.concatenate(x) for x in zip(*parts, strict=True))
        own = query == 0
        i, x = ids[own], np.ascontiguousarray(v[own])
        keyed = np.ascontiguousarray(np.hstack([i.astype("<i8")[:, None].view(np.uint8), x.view(np.uint8).reshape(len(i), x.shape[1] * 8)]))
        keep = np.sort(np.unique(keyed.view(f"V{keyed.shape[1]}").ravel(), return_index=True)[1])  # repeated rows count once
        asked: dict[tuple[int, int], np.ndarray] = {}
        for q in np.flatnonzero(~own):
            asked.setdefault((int(ids[q]), int(tags[q])), v[q])
        return Cell(i[keep], x[keep], [(a, b, q) for (a, b), q in asked.items()])

    for batch in batches:
        dim, shard, block, query, ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(6))
        if not len(dim):
            continue
        lists = batch.column(6)
        change = np.flatnonzero((dim[1:] != dim[:-1]) | (shard[1:] != shard[:-1]) | (block[1:] != block[:-1])) + 1
        for a, b in zip([0, *change], [*change, len(dim)], strict=True):
            key = (dim[a], shard[a], block[a])
            if at is not None and key != at:
                yield made()
                parts = []
            at = key
            v = lists.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b - a, int(dim[a]))
            parts.append((query[a:b], ids[a:b], tags[a:b], v))
    if parts:
        yield made()


def best(found: DataFrame, k: int, *finer: str) -> DataFrame:
    """The k best of each query: ``query_id, rank, vec_id, score``, ties by ``finer`` (descending) and to the smaller id."""
    order = Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), *[F.desc(c) for c in finer], "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
