"""Graphs as folders of Parquet files: the native, distributed form."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from graphloom.graph import Graph


def write_parquet(graph: Graph, path: str) -> None:
    """``nodes``, ``edges`` and a one-row ``graph`` table below ``path``."""
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")
    categories = json.dumps([[s, n, dict(d)] for (s, n), d in graph.categories.items()])
    row = [(graph.directed, json.dumps(graph.attributes, default=str), categories)]
    graph.spark.createDataFrame(row, "directed boolean, attributes string, categories string").write.mode("overwrite").parquet(f"{path}/graph")


def read_parquet(spark: SparkSession, path: str) -> Graph:
    row = spark.read.parquet(f"{path}/graph").first()
    categories = {(s, n): d for s, n, d in json.loads(row["categories"])}
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), row["directed"], json.loads(row["attributes"]), categories)
