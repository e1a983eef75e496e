"""Selections: queries, set operations on selectors, ordering and induced subgraphs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.graph import Graph, GraphError, numbered
from graphloom.operators.components import component_labels
from graphloom.plans.compiler import Compiled


def select_nodes(graph: Graph, query: str) -> DataFrame:
    """``id`` of the nodes that satisfy the query."""
    return Compiled(graph, "node", query).ids()


def select_edges(graph: Graph, query: str) -> DataFrame:
    return Compiled(graph, "edge", query).ids()


def filter_active(graph: Graph, scope: str, selector: DataFrame) -> DataFrame:
    """The selector's ids that exist, each once; with a ``pos`` column, at its first place."""
    order = [F.min("pos").alias("pos")] if "pos" in selector.columns else []
    once = selector.groupBy("id").agg(*order) if order else selector.select("id").distinct()
    return once.join(graph.frame(scope).select("id"), "id", "left_semi")


def intersect(graph: Graph, scope: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """Existing ids of both selectors, each once, in the order of the left one."""
    return filter_active(graph, scope, left).join(right.select("id"), "id", "left_semi")


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("id").union(right.select("id")).distinct()


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("id").distinct().join(right.select("id"), "id", "left_anti")


def edges_among(graph: Graph, keep: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """The edges (of a selector, or all) with both ends among ``keep``."""
    rows = graph.edges if edges is None else graph.edges.join(edges.select("id"), "id", "left_semi")
    nodes = keep.select("id")
    return rows.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi").select(graph.edges.columns)


def endpoints(graph: Graph, edges: DataFrame, unique: bool = True) -> DataFrame:
    """``id`` of the ends of the selected edges."""
    rows = graph.edges.join(edges.select("id"), "id", "left_semi")
    both = rows.select(F.col("src").alias("id")).union(rows.select("dst"))
    return both.distinct() if unique else both


def order_by(graph: Graph, scope: str, rows: DataFrame, *keys: str | tuple[str, str] | tuple[str, str, int]) -> DataFrame:
    """Rows sorted by attributes: 'name', '-name', 'name:desc', (name, direction) or (name, direction, component).

    Values that are not finite come last in either direction; ties go by id.
    """
    schema = graph.frame(scope).schema
    columns: list[Column] = []
    for key in keys:
        name, direction, component = (*key, 0)[:3] if isinstance(key, tuple) else (*_named(key), 0)
        if name not in schema.names:
            raise GraphError(f"unknown attribute {name!r}")
        kind = schema[name].dataType
        c = F.col(name)
        if isinstance(kind, T.ArrayType):
            c = F.get(c, F.least(F.lit(component), F.size(c) - 1))
        elif isinstance(kind, T.StringType):
            raise GraphError(f"attribute {name!r} has no order")
        c = c.cast("double") if name != "id" else c
        odd = F.isnan(c) | (F.abs(c) == float("inf")) | c.isNull() if name != "id" else F.lit(False)
        columns += [odd.asc(), c.desc() if direction == "desc" else c.asc()]
    return rows.orderBy(*columns, F.col("id").asc())


def promote_to_end(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, place`` of rows ``(id, pos)`` with the given ids moved behind the others; both parts keep their order."""
    moved = rows.join(ids.select("id", F.lit(1).alias("__moved")).distinct(), "id", "left").withColumn("__moved", F.coalesce("__moved", F.lit(0)))
    return numbered(moved, ["__moved", "pos"], "place").select("id", "place")


def _named(key: str) -> tuple[str, str]:
    if key.startswith("-"):
        return key[1:], "desc"
    name, _, direction = key.partition(":")
    return name, direction or "asc"


def filter_subgraph(graph: Graph, node_query: str | None = None, edge_query: str | None = None, node_selection: DataFrame | None = None, edge_selection: DataFrame | None = None, min_component_size: int = 1) -> Graph:
    """The subgraph of the nodes and edges that pass both queries and selections.

    Edges need both ends.  With a minimum size, components (over the passing
    edges, whatever their direction) that have fewer nodes are dropped; a node
    without an edge is a component of one.
    """
    nodes = Compiled(graph, "node", node_query).rows() if node_query else graph.nodes
    if node_selection is not None:
        nodes = nodes.join(node_selection.select("id"), "id", "left_semi")
    edges = Compiled(graph, "edge", edge_query).rows() if edge_query else graph.edges
    if edge_selection is not None:
        edges = edges.join(edge_selection.select("id"), "id", "left_semi")
    kept = replace(graph, edges=edges)
    edges = edges_among(kept, nodes)
    if min_component_size > 1:
        labels = component_labels(edges, "src", "dst")
        large = labels.groupBy("comp").agg(F.count("*").alias("n")).where(F.col("n") >= min_component_size)
        nodes = nodes.join(labels.join(large, "comp", "left_semi").select(F.col("v").alias("id")), "id", "left_semi")
        edges = edges_among(replace(graph, edges=edges), nodes)
    return replace(graph, nodes=nodes, edges=edges)
