"""Neighbourhoods: one hop, exactly or up to a level, and hop distances.

Traversals advance a frontier: each level is one join of the frontier with the
adjacency and one anti-join with what has been visited, written to shared
scratch so that plans stay short.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.scratch import Scratch


def _sources(graph: Graph, ids: DataFrame | Iterable[int]) -> DataFrame:
    return graph.ids_frame(ids).join(graph.nodes.select("id"), "id", "left_semi")


def neighbors(graph: Graph, ids: DataFrame | Iterable[int], direction: str = "both", include_sources: bool = True) -> tuple[DataFrame, DataFrame]:
    """Distinct neighbours and the edges that lead to them, each as ``id``.

    Sources are listed only where they are reached; with ``include_sources``
    off they are left out, but their edges are not.
    """
    sources = _sources(graph, ids).withColumnRenamed("id", "node")
    reached = graph.adjacency(direction).join(sources, "node", "left_semi")
    nodes = reached.select(F.col("nbr").alias("id")).distinct()
    if not include_sources:
        nodes = nodes.join(sources.withColumnRenamed("node", "id"), "id", "left_anti")
    return nodes, reached.select(F.col("edge").alias("id")).distinct()


def hop_distances(graph: Graph, ids: DataFrame | Iterable[int], max_level: int, direction: str = "both", scratch: Scratch | None = None) -> DataFrame:
    """``id, level``: hops from the nearest source, up to ``max_level``; the sources have 0."""
    scratch = scratch or Scratch(graph.spark, "levels")
    adjacency = graph.adjacency(direction).select("node", "nbr").distinct()
    seen = scratch.save(_sources(graph, ids).withColumn("level", F.lit(0)), "level")
    frontier = seen
    for level in range(1, max_level + 1):
        step = frontier.select(F.col("id").alias("node")).join(adjacency, "node").select(F.col("nbr").alias("id")).distinct()
        frontier = scratch.save(step.join(seen, "id", "left_anti").withColumn("level", F.lit(level)), "level")
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen


def _forward_edges(graph: Graph, levels: DataFrame, direction: str, low: int, high: int) -> DataFrame:
    """Edges from a level to the next one: those of the breadth-first levels only."""
    near = levels.select(F.col("id").alias("node"), F.col("level").alias("l0"))
    far = levels.select(F.col("id").alias("nbr"), F.col("level").alias("l1"))
    rows = graph.adjacency(direction).join(near, "node").join(far, "nbr").where((F.col("l1") == F.col("l0") + 1) & F.col("l1").between(low, high))
    return rows.select(F.col("edge").alias("id")).distinct()


def neighbors_at_level(graph: Graph, ids: DataFrame | Iterable[int], level: int, direction: str = "both", include_sources: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes at exactly ``level`` hops and the edges that lead there from the level before."""
    levels = hop_distances(graph, ids, level, direction)
    nodes = levels.where(F.col("level") == level)
    if level == 0 and not include_sources:
        nodes = nodes.where(F.lit(False))
    return nodes.select("id"), _forward_edges(graph, levels, direction, level, level) if level else levels.where(F.lit(False)).select("id")


def neighbors_up_to_level(graph: Graph, ids: DataFrame | Iterable[int], level: int, direction: str = "both", include_sources: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes at 1 to ``level`` hops (0 with the sources) and all edges from a level to the next."""
    levels = hop_distances(graph, ids, level, direction)
    nodes = levels.where(F.col("level") >= (0 if include_sources else 1))
    return nodes.select("id"), _forward_edges(graph, levels, direction, 1, level)


def pair_levels(graph: Graph, ids: DataFrame | Iterable[int] | None, max_level: int, direction: str = "out", scratch: Scratch | None = None) -> Iterator[DataFrame]:
    """``source, node, level`` as known after each level, from the sources' own rows on."""
    scratch = scratch or Scratch(graph.spark, "pairs")
    adjacency = graph.adjacency(direction).select("node", "nbr").distinct()
    sources = graph.nodes.select("id") if ids is None else _sources(graph, ids)
    seen = scratch.save(sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0).alias("level")), "pairs")
    frontier = seen
    yield seen
    for level in range(1, max_level + 1):
        step = frontier.select("source", "node").join(adjacency, "node").select("source", F.col("nbr").alias("node")).distinct()
        frontier = scratch.save(step.join(seen, ["source", "node"], "left_anti").withColumn("level", F.lit(level)), "pairs")
        if not frontier.limit(1).count():
            return
        seen = seen.unionByName(frontier)
        yield seen


def pair_distances(graph: Graph, ids: DataFrame | Iterable[int] | None, max_level: int, direction: str = "out", scratch: Scratch | None = None) -> DataFrame:
    """``source, node, level``: hops from each source (every node by default) by itself."""
    return deque(pair_levels(graph, ids, max_level, direction, scratch), maxlen=1)[0]
