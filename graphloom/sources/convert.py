"""To and from pandas, networkx and igraph (if they are installed)."""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import SparkSession

from graphloom.graph import Graph


def to_pandas(graph: Graph) -> tuple[pd.DataFrame, pd.DataFrame]:
    return graph.nodes.orderBy("id").toPandas(), graph.edges.orderBy("id").toPandas()


def from_pandas(spark: SparkSession, nodes: pd.DataFrame, edges: pd.DataFrame, directed: bool = False) -> Graph:
    return Graph.of_edges(spark.createDataFrame(nodes), spark.createDataFrame(edges), directed)


def to_networkx(graph: Graph) -> Any:
    """A multigraph, so that parallel edges stay apart."""
    import networkx as nx

    nodes, edges = to_pandas(graph)
    out = nx.MultiDiGraph() if graph.directed else nx.MultiGraph()
    out.graph.update(graph.attributes)
    out.add_nodes_from((r.pop("id"), r) for r in nodes.to_dict("records"))
    out.add_edges_from((r.pop("src"), r.pop("dst"), r.pop("id"), r) for r in edges.to_dict("records"))
    return out


def from_networkx(spark: SparkSession, source: Any) -> Graph:
    number = {v: i for i, v in enumerate(source.nodes)}
    nodes = pd.DataFrame([{"id": number[v], **d} for v, d in source.nodes(data=True)])
    edges = pd.DataFrame([{"id": i, "src": number[a], "dst": number[b], **d} for i, (a, b, d) in enumerate(source.edges(data=True))], columns=None if source.number_of_edges() else ["id", "src", "dst"])
    return from_pandas(spark, nodes, edges, source.is_directed())


def to_igraph(graph: Graph) -> Any:
    import igraph

    nodes, edges = to_pandas(graph)
    number = {v: i for i, v in enumerate(nodes["id"])}
    out = igraph.Graph(n=len(nodes), edges=[(number[a], number[b]) for a, b in zip(edges["src"], edges["dst"], strict=True)], directed=graph.directed)
    for c in nodes.columns[1:]:
        out.vs[c] = nodes[c].tolist()
    for c in edges.columns[3:]:
        out.es[c] = edges[c].tolist()
    return out


def from_igraph(spark: SparkSession, source: Any) -> Graph:
    nodes = pd.DataFrame({"id": range(source.vcount()), **{k: source.vs[k] for k in source.vs.attributes()}})
    edges = pd.DataFrame({"id": range(source.ecount()), "src": [e.source for e in source.es], "dst": [e.target for e in source.es], **{k: source.es[k] for k in source.es.attributes()}})
    return from_pandas(spark, nodes, edges, source.is_directed())
