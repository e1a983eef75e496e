"""Nearest-neighbour graphs and what is derived from them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.vectors import doubles
from graphloom.graph import Graph, numbered
from graphloom.scratch import Scratch


BLOCK_ROWS = 4096  #: points of a block, about; small tables have smaller blocks, so that there are tasks enough
LEAST_ROWS = 512
BLOCK_BYTES = 4 << 20  #: of a block's vectors at most
TASKS = 96  #: a block of points that ask is a task of its own up to here; of four times as many, four are
STRIP = 1 << 20  #: distances of a pair of blocks that are held at once


def _packed(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Blocks of up to ``rows`` points of one length: the bytes of their ids and vectors."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def block(dim: int, ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], ["dim", "ids", "v"])

    for batch in batches:
        dims = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
        for dim in np.unique(dims).tolist():
            own = pa.array(np.flatnonzero(dims == dim))
            ids = batch.column(0).take(own).to_numpy().astype("<i8")
            v = batch.column(1).take(own).flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(len(own), dim)
            held.setdefault(dim, []).append((ids, v))
            most = max(1, min(rows, BLOCK_BYTES // (8 * max(dim, 1))))
            if sum(len(i) for i, _ in held[dim]) >= most:
                ids, v = (np.concatenate(x) for x in zip(*held[dim], strict=True))
                whole = len(ids) - len(ids) % most
                for at in range(0, whole, most):
                    yield block(dim, ids[at : at + most], v[at : at + most])
                held[dim] = [(ids[whole:], v[whole:])]
    for dim, parts in held.items():
        ids, v = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(ids):
            yield block(dim, ids, v)


def _blocks(points: DataFrame, id_col: str, vector_col: str, block_rows: int) -> DataFrame:
    """``block, dim, ids, v``: the points that have a vector, packed and kept in shared storage."""
    rows = points.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), doubles(F.col(vector_col)).alias("v"))
    n = rows.count()
    size = min(block_rows, max(LEAST_ROWS, -(-n // 64)))
    ranged = rows.repartitionByRange(max(1, -(-n // size)), F.size("v"), F.xxhash64("id"))  # even, and few lengths in each
    packed = ranged.mapInArrow(partial(_packed, rows=2 * size), "dim int, ids binary, v binary")
    return Scratch(points.sparkSession, "knn").save(packed.withColumn("block", F.monotonically_increasing_id()), "blocks")


class _Nearest:
    """The k nearest points so far of each point of a block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.own = (x * x).sum(axis=1)
        self.far = np.full((len(ids), k), np.inf)
        self.dst = np.full((len(ids), k), np.iinfo(np.int64).max)

    def meet(self, dst: np.ndarray, b: np.ndarray) -> None:
        """Take in the points of another block: by a matrix product first, then exactly."""
        squares, k = (b * b).sum(axis=1), self.k
        strip = max(1, STRIP // len(dst))
        shared = np.isin(self.ids, dst)
        for at in range(0, len(self.ids), strip):
            x, own = self.x[at : at + strip], self.own[at : at + strip]
            far = x @ b.T
            far *= -2
            far += squares
            far += own[:, None]
            same = np.flatnonzero(shared[at : at + strip])
            if len(same):
                far[same] = np.where(self.ids[at + same][:, None] == dst, np.nan, far[same])  # no point is its own neighbour
            slack = 1e-9 * (own + squares.max()) + 1e-300  # what rounding may hide
            limit = self.far[at : at + strip, -1] ** 2 + slack
            near = far <= limit[:, None]
            if np.count_nonzero(near) > 8 * k * len(x) and len(dst) > k:
                near = far <= np.fmin(limit, np.partition(far, k - 1, axis=1)[:, k - 1] + slack)[:, None]
            r, c = np.divmod(np.flatnonzero(near), len(dst))
            if not len(r):
                continue
            some = max(1, STRIP // max(1, b.shape[1]))
            exact = np.concatenate([np.sqrt(((x[r[i : i + some]] - b[c[i : i + some]]) ** 2).sum(axis=1)) for i in range(0, len(r), some)])
            rows = np.unique(r)
            r = np.concatenate([r, np.repeat(rows, k)])
            exact = np.concatenate([exact, self.far[at + rows].ravel()])
            ids = np.concatenate([dst[c], self.dst[at + rows].ravel()])
            order = np.lexsort((ids, exact, r))
            best = order[np.searchsorted(r[order], rows)[:, None] + np.arange(k)]
            self.far[at + rows], self.dst[at + rows] = exact[best], ids[best]

    def table(self) -> pa.RecordBatch:
        found = self.far < np.inf
        src = np.repeat(self.ids, self.k).reshape(found.shape)
        return pa.RecordBatch.from_arrays([pa.array(src[found]), pa.array(self.dst[found]), pa.array(self.far[found])], ["src", "dst", "distance"])


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The neighbours of the blocks that ask in a task, which meet all known blocks one after the other."""
    asked: dict[int, _Nearest] = {}
    for batch in batches:
        block, dim = (batch.column(c).to_pylist() for c in ("block", "dim"))
        for row, (name, width) in enumerate(zip(block, dim, strict=True)):
            def points(ids: str, v: str) -> tuple[np.ndarray, np.ndarray]:
                i = np.frombuffer(batch.column(ids)[row].as_buffer(), "<i8")
                return i, np.frombuffer(batch.column(v)[row].as_buffer(), "<f8").reshape(len(i), width)

            if name not in asked:
                asked[name] = _Nearest(*(x.copy() for x in points("ids", "v")), k)
            asked[name].meet(*points("known_ids", "known_v"))
    for nearest in asked.values():
        yield nearest.table()


def knn_edges(points: DataFrame, k: int, id_col: str = "id", vector_col: str = "vector", block_rows: int = BLOCK_ROWS, among: DataFrame | None = None) -> DataFrame:
    """``src, dst, distance, rank``: the k nearest other points of each point (exact, Euclidean; ties by id; rank from 0).

    Points are packed into blocks of about ``block_rows`` rows in shared
    storage.  A task holds a few blocks that ask and reads all known blocks one
    after the other, keeping each point's k best; so every vector is shuffled
    twice whatever the size of the table, and only the k best of a point are
    passed on.  Points without an id or a vector have no neighbours; vectors
    are compared with those of their length.  With ``among``, neighbours are
    looked for there.
    """
    saved = _blocks(points, id_col, vector_col, block_rows)
    known = saved if among is None else _blocks(among, id_col, vector_col, block_rows)
    blocks = saved.count()
    asked = saved.repartitionByRange(max(1, min(blocks, TASKS), -(-blocks // 4)), "block")
    stream = known.select(F.col("dim").alias("known_dim"), F.col("ids").alias("known_ids"), F.col("v").alias("known_v")).coalesce(1)
    pairs = stream.hint("shuffle_replicate_nl").join(asked, F.col("known_dim") == F.col("dim"))  # the side that is streamed comes first
    near = pairs.select("block", "dim", "ids", "v", "known_ids", "known_v").mapInArrow(partial(_search, k=max(k, 1)), "src long, dst long, distance double")
    order = Window.partitionBy("src").orderBy("distance", "dst")
    return near.withColumn("rank", (F.row_number().over(order) - 1).cast("int")).where(F.col("rank") < k).select("src", "dst", "distance", "rank")


def knn_graph(points: DataFrame, k: int, id_col: str = "id", vector_col: str = "vector") -> Graph:
    """A directed graph from each point to its nearest ones, with their distances and ranks."""
    edges = knn_edges(points, k, id_col, vector_col).withColumnsRenamed({"distance": "umap_knn_distance", "rank": "umap_knn_rank"})
    return Graph.of_edges(points.withColumnRenamed(id_col, "id"), numbered(edges, ["src", "umap_knn_rank"]), directed=True)


def supplied_knn(points: DataFrame, neighbours: DataFrame) -> Graph:
    """The same graph from given neighbours ``src, indices, distances``; a point's own entries are left out."""
    rows = neighbours.select("src", F.posexplode(F.arrays_zip("indices", "distances")).alias("rank", "x")).where("x.indices <> src")
    edges = rows.select("src", F.col("x.indices").alias("dst"), F.col("x.distances").alias("umap_knn_distance"), F.col("rank").cast("int").alias("umap_knn_rank"))
    return Graph.of_edges(points, numbered(edges, ["src", "umap_knn_rank"]), directed=True)


def collapse(weights: DataFrame) -> DataFrame:
    """``src, dst, weight`` with src < dst: the larger weight of both directions, without loops and zeros."""
    rows = weights.where("src <> dst and weight <> 0")
    return rows.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("weight").alias("weight"))


def mass(weights: DataFrame) -> DataFrame:
    """``id, mass``: sums of the rows of a weight matrix."""
    return weights.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("mass"))


def transform_graph(train: DataFrame, queries: DataFrame, links: DataFrame) -> Graph:
    """Query points after the training points, with edges from queries to training points.

    ``links(src, dst, ...)`` has query numbers in ``src``; they are shifted by
    the number of training points.
    """
    offset = train.count()
    nodes = train.select("id", F.lit(False).alias("is_query")).unionByName(queries.select((F.col("id") + offset).alias("id"), F.lit(True).alias("is_query")))
    return Graph.of_edges(nodes, links.withColumn("src", F.col("src") + offset), directed=True)


def fit_graph(points: DataFrame, k: int, weights: DataFrame | None = None, id_col: str = "id", vector_col: str = "vector") -> tuple[Graph, Graph]:
    """The fitted network and the neighbour graph behind it.

    The network has an edge for each pair of ``weights(src, dst, weight)`` (by
    default 1 / (1 + distance) of the neighbours) and the nodes' ``mass``.
    """
    near = knn_graph(points, k, id_col, vector_col)
    if weights is None:
        weights = near.edges.select("src", "dst", (1 / (1 + F.col("umap_knn_distance"))).alias("weight"))
    sums = mass(weights)
    nodes = near.nodes.join(sums, "id", "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)))
    return Graph.of_edges(nodes, collapse(weights)), near


def transform_queries(train: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "vector") -> Graph:
    """Query points linked to their k nearest training points, with distances, ranks and the links' ``mass``."""
    offset = train.agg(F.coalesce(F.max(id_col) + 1, F.lit(0))).first()[0]
    known = train.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    asked = queries.select((F.col(id_col) + offset).alias("id"), F.col(vector_col).alias("vector"))
    edges = numbered(knn_edges(asked, k, among=known).withColumnsRenamed({"distance": "umap_knn_distance", "rank": "umap_knn_rank"}), ["src", "umap_knn_rank"])
    sums = mass(edges.select("src", (1 / (1 + F.col("umap_knn_distance"))).alias("weight")))
    nodes = known.select("id", F.lit(False).alias("is_query")).unionByName(asked.select("id", F.lit(True).alias("is_query")))
    nodes = nodes.join(sums, "id", "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)))
    return Graph.of_edges(nodes, edges, directed=True)
