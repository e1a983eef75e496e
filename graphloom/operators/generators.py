"""Graph generators.

Random draws are hashes of the seed and of what is drawn for, so a generator
gives the same graph whatever the partitioning.  Generators that draw pairs
with one probability per block skip from hit to hit instead of looking at all
pairs; geometric ones join cells of a grid.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import Graph, GraphError, numbered

POSITION = "_generator_position"


def uniform(seed: int, *what: Column) -> Column:
    """A number in [0, 1) for a combination of values."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *what), 11).cast("double") * (1.0 / (1 << 53))


def _graph(spark: SparkSession, n: int, pairs: DataFrame, directed: bool, nodes: DataFrame | None = None) -> Graph:
    nodes = spark.range(n) if nodes is None else nodes
    return Graph.of_edges(nodes, numbered(pairs, ["src", "dst"]), directed)


def simple_edges(pairs: DataFrame, directed: bool = False) -> DataFrame:
    """Pairs without loops and repeats; undirected pairs from the smaller to the larger end."""
    pairs = pairs.where("src <> dst")
    if not directed:
        pairs = pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return pairs.select("src", "dst").distinct()


def lattice_2d(spark: SparkSession, rows: int, columns: int, level: int = 1, periodic: bool = False, directed: bool = False) -> Graph:
    """A grid whose nodes are joined to the right and down at distances 1 to ``level``; directed ones both ways."""
    n = rows * columns
    r, c, k = F.floor(F.col("id") / columns), F.col("id") % columns, F.col("k")
    steps = spark.range(n).select("id", F.explode(F.sequence(F.lit(1), F.lit(level))).alias("k"))
    right, down = c + k, r + k
    if periodic:
        ends = F.array(r * columns + right % columns, (down % rows) * columns + c)
    else:
        ends = F.array(F.when(right < columns, r * columns + right), F.when(down < rows, down * columns + c))
    pairs = steps.select(F.col("id").alias("src"), F.explode(ends.cast("array<bigint>")).alias("dst")).where("dst is not null")
    pairs = simple_edges(pairs)
    if directed:
        pairs = pairs.union(pairs.select("dst", "src"))
    return _graph(spark, n, pairs, directed)


def _skips(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hits among ``n`` numbered trials of probability ``p``, a binomial number of them; rows are (seed, lo, n, p, ...)."""
    for frame in groups:
        for row in frame.itertuples(index=False):
            rng = np.random.default_rng([row.seed, row.block, row.lo])
            hits = np.arange(row.n) if row.p >= 1 else np.sort(rng.choice(row.n, size=rng.binomial(row.n, row.p), replace=False))
            yield pd.DataFrame({"block": row.block, "t": hits.astype(np.int64) + row.lo})


def stochastic_block_model(spark: SparkSession, block_sizes: Sequence[int], probabilities: Sequence[Sequence[float]], directed: bool = False, seed: int = 0) -> Graph:
    """Every pair of nodes (ordered pairs if directed) is joined with its blocks' probability."""
    sizes, first = list(block_sizes), np.concatenate([[0], np.cumsum(block_sizes)]).tolist()
    if len(probabilities) != len(sizes) or any(len(p) != len(sizes) for p in probabilities):
        raise GraphError("probabilities must be a square matrix over the blocks")
    cells, chunk = [], 1 << 20
    for a in range(len(sizes)):
        for b in range(len(sizes)) if directed else range(a, len(sizes)):
            trials, p = sizes[a] * sizes[b], float(probabilities[a][b])
            cells += [(seed, a * len(sizes) + b, lo, min(chunk, trials - lo), p) for lo in range(0, trials if p > 0 else 0, chunk)]
    if not cells:
        return _graph(spark, first[-1], spark.createDataFrame([], "src long, dst long"), directed)
    drawn = spark.createDataFrame(cells, "seed long, block long, lo long, n long, p double").repartition(min(len(cells), 64)).mapInPandas(_skips, "block long, t long")
    table = spark.createDataFrame([(i * len(sizes) + j, first[i], first[j], sizes[j]) for i in range(len(sizes)) for j in range(len(sizes))], "block long, fa long, fb long, width long")
    pairs = drawn.join(F.broadcast(table), "block").select((F.col("fa") + F.floor(F.col("t") / F.col("width"))).alias("src"), (F.col("fb") + F.col("t") % F.col("width")).alias("dst"))  # a row per pair of blocks
    pairs = pairs.where("src <> dst") if directed else pairs.where("src < dst")
    return _graph(spark, first[-1], pairs, directed)


def erdos_renyi(spark: SparkSession, n: int, p: float, directed: bool = False, seed: int = 0) -> Graph:
    return stochastic_block_model(spark, [n], [[p]], directed, seed)


def watts_strogatz(spark: SparkSession, n: int, level: int = 2, rewiring: float = 0.01, directed: bool = False, seed: int = 0) -> Graph:
    """A ring joined up to distance ``level`` of which exactly round(n * level * rewiring) edges are rewired.

    A rewired edge keeps its first end and gets a target farther than
    ``level`` along the ring; draws that repeat an edge are drawn again.
    """
    if n <= 2 * level + 1 and rewiring > 0:
        raise GraphError("the ring is too small to rewire")
    slots = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(level))).alias("k")).withColumn("dst", (F.col("src") + F.col("k")) % n)
    many = round(n * level * rewiring)
    if not many:
        return _graph(spark, n, slots.select("src", "dst"), directed)
    from graphloom.scratch import Scratch

    scratch = Scratch(spark, "ring")
    chosen = scratch.save(numbered(slots.withColumn("u", uniform(seed, F.col("src"), F.col("k"))), ["u", "src", "k"], "place"), "slots")
    kept = chosen.where(F.col("place") >= many).select("src", "dst")
    todo, done, attempt = chosen.where(F.col("place") < many).select("src", "k"), None, 0
    while True:
        attempt += 1
        jump = F.floor(uniform(seed + attempt, F.col("src"), F.col("k"), F.lit("jump")) * (n - 2 * level - 1)) + level + 1
        tried = scratch.save(todo.withColumn("dst", (F.col("src") + jump) % n).withColumn("a", F.least("src", "dst") if not directed else F.col("src")).withColumn("b", F.greatest("src", "dst") if not directed else F.col("dst")), "tried")
        first = tried.groupBy("a", "b").agg(F.min(F.struct("src", "k")).alias("f"))
        good = tried.join(first, ["a", "b"]).where((F.col("f.src") == F.col("src")) & (F.col("f.k") == F.col("k"))).select("src", "k", "dst", "a", "b")
        if done is not None:
            good = good.join(done.select("a", "b"), ["a", "b"], "left_anti").select("src", "k", "dst", "a", "b")
        good = scratch.save(good, "good")
        done = good if done is None else scratch.save(done.unionByName(good), "done")
        todo = scratch.save(todo.join(good.select("src", "k"), ["src", "k"], "left_anti"), "todo")
        if not todo.limit(1).count():
            break
    return _graph(spark, n, kept.union(done.select("src", "dst")), directed)


def small_world(spark: SparkSession, n: int, level: int = 2, rewiring: float = 0.01, directed: bool = False, seed: int = 0) -> Graph:
    return watts_strogatz(spark, n, level, rewiring, directed, seed)


def barabasi_albert(spark: SparkSession, n: int, m: int = 2, clique: int = 0, directed: bool = False, seed: int = 0) -> Graph:
    """Preferential attachment: after a clique, each node joins m distinct nodes by their degrees.

    Each step depends on all before it, so the graph grows in a single task.
    """
    clique = clique or m + 1
    if not 1 <= m <= clique <= n:
        raise GraphError("needs 1 <= m <= clique <= n")

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            rng = np.random.default_rng(seed)
            src = [i for i in range(clique) for _ in range(i)]
            dst = [j for i in range(clique) for j in range(i)]
            ends = np.empty(2 * (len(src) + (n - clique) * m), np.int64)
            ends[: 2 * len(src)] = src + dst
            used = 2 * len(src)
            for v in range(clique, n):
                targets: set[int] = set()
                while len(targets) < m:
                    targets.add(int(ends[rng.integers(used)]) if used else int(rng.integers(v)))
                for t in sorted(targets):
                    src.append(v)
                    dst.append(t)
                    ends[used : used + 2] = v, t
                    used += 2
            for at in range(0, len(src), 1 << 20):
                yield pd.DataFrame({"src": src[at : at + (1 << 20)], "dst": dst[at : at + (1 << 20)]})

    pairs = spark.range(1, numPartitions=1).mapInPandas(grow, "src long, dst long")
    return _graph(spark, n, pairs, directed)


def _points(spark: SparkSession, n: int, seed: int) -> DataFrame:
    return spark.range(n).select("id", uniform(seed, F.col("id"), F.lit("x")).alias("x"), uniform(seed, F.col("id"), F.lit("y")).alias("y"))


def random_geometric(spark: SparkSession, n: int, radius: float = 0.05, directed: bool = False, seed: int = 0) -> Graph:
    """Uniform points of the unit square, joined up to a distance; only cells of a grid that touch are compared."""
    points = _points(spark, n, seed)
    side = max(radius, 1e-6)
    celled = points.select("id", "x", "y", F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy"))
    around = celled.select("id", "x", "y", F.explode(F.expr("transform(sequence(0, 8), i -> struct(cx + i % 3 - 1 as cx, cy + cast(floor(i / 3) as bigint) - 1 as cy))")).alias("c")).select(F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"), "c.cx", "c.cy")
    near = celled.join(around, ["cx", "cy"]).where("id <> dst" if directed else "id < dst")
    near = near.where((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2 <= radius * radius)
    nodes = points.select("id", F.array(F.col("x").cast("float"), F.col("y").cast("float")).alias(POSITION))
    return _graph(spark, n, near.select(F.col("id").alias("src"), "dst"), directed, nodes)


def waxman(spark: SparkSession, n: int, alpha: float = 0.4, beta: float = 0.2, directed: bool = False, seed: int = 0) -> Graph:
    """Points joined with probability beta * exp(-distance / (alpha * sqrt 2)).

    The probability never exceeds beta, so candidate pairs are drawn with beta
    by skips and kept with the rest of it by their distance.
    """
    alpha = alpha if alpha > 0 else 0.4
    beta = min(max(beta, 0.0), 1.0)
    points = _points(spark, n, seed)
    drawn = erdos_renyi(spark, n, beta, directed, seed).edges.select("src", "dst")
    pairs = drawn.join(points.select(F.col("id").alias("src"), "x", "y"), "src").join(points.select(F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2")), "dst")
    distance = F.sqrt((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2)
    kept = pairs.where(uniform(seed, F.col("src"), F.col("dst"), F.lit("keep")) < F.exp(-distance / (alpha * math.sqrt(2))))
    nodes = points.select("id", F.array(F.col("x").cast("float"), F.col("y").cast("float")).alias(POSITION))
    return _graph(spark, n, kept.select("src", "dst"), directed, nodes)


def configuration_model(spark: SparkSession, degrees: Sequence[int], directed: bool = False, self_loops: bool = False, multi_edges: bool = False, seed: int = 0) -> Graph:
    """Half-edges in random order, paired one after the other; pairs that are not allowed are dropped."""
    if sum(degrees) % 2:
        raise GraphError("the degrees must add up to an even number")
    if not sum(degrees):
        return _graph(spark, len(degrees), spark.createDataFrame([], "src long, dst long"), directed)
    table = spark.createDataFrame(list(enumerate(map(int, degrees))), "id long, degree int").where("degree > 0")
    stubs = table.select("id", F.explode(F.sequence(F.lit(1), F.col("degree"))).alias("k")).withColumn("u", uniform(seed, F.col("id"), F.col("k")))
    placed = numbered(stubs, ["u", "id", "k"], "place").select("id", F.floor(F.col("place") / 2).alias("pair"), (F.col("place") % 2).alias("end"))
    pairs = placed.groupBy("pair").agg(F.max(F.when(F.col("end") == 0, F.col("id"))).alias("src"), F.max(F.when(F.col("end") == 1, F.col("id"))).alias("dst"))
    if not self_loops:
        pairs = pairs.where("src <> dst")
    if not multi_edges:
        key = ["src", "dst"] if directed else [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]
        pairs = pairs.groupBy(*key).agg(F.min(F.struct("pair", "src", "dst")).alias("f")).select("f.pair", "f.src", "f.dst")
    return _graph(spark, len(degrees), pairs.select("src", "dst"), directed)
