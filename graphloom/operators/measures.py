"""Measures of nodes that take a bounded number of joins: degree, strength, clustering, modularity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.graph import Graph, GraphError


def weighted_adjacency(graph: Graph, weight: str | None, direction: str) -> DataFrame:
    """The adjacency with ``w``: a numeric scalar edge attribute as a double, or 1."""
    if weight is None:
        return graph.adjacency(direction).withColumn("w", F.lit(1.0))
    if weight not in graph.edges.columns or not isinstance(graph.edges.schema[weight].dataType, T.NumericType):
        raise GraphError(f"{weight!r} is no numeric edge attribute")
    return graph.adjacency(direction, [weight]).select("node", "nbr", "edge", F.col(weight).cast("double").alias("w"))


def _for_all(graph: Graph, values: DataFrame, name: str, otherwise: object) -> DataFrame:
    """A value for every node."""
    return graph.nodes.select("id").join(values, "id", "left").select("id", F.coalesce(name, F.lit(otherwise)).alias(name))


def degree(graph: Graph, direction: str = "both") -> DataFrame:
    """``id, degree``: entries of the neighbour lists; parallel edges count, a loop of an undirected graph twice."""
    counts = graph.adjacency(direction).groupBy(F.col("node").alias("id")).agg(F.count("*").alias("degree"))
    return _for_all(graph, counts, "degree", 0)


def selector_degree(graph: Graph, selector: DataFrame, direction: str = "both") -> DataFrame:
    """The selected nodes' degrees; further columns of the selector stay."""
    return selector.join(degree(graph, direction), "id")


def incident_edges(graph: Graph, selector: DataFrame, direction: str = "both") -> DataFrame:
    """Ids of the edges that stand in the neighbour lists of the selected nodes, each once."""
    ends = selector.select(F.col("id").alias("node")).distinct()
    return graph.adjacency(direction).join(ends, "node", "left_semi").select(F.col("edge").alias("id")).distinct()


def strength(graph: Graph, weight: str | None = None, direction: str = "both", measure: str = "sum") -> DataFrame:
    """``id, strength``: sum, average, minimum or maximum of the incident weights; 0 without any, and for sums and extremes that are not finite."""
    fold = {"sum": F.sum, "average": F.avg, "avg": F.avg, "minimum": F.min, "min": F.min, "maximum": F.max, "max": F.max}.get(measure)
    if fold is None:
        raise GraphError(f"unknown measure {measure!r}")
    values = weighted_adjacency(graph, weight, direction).groupBy(F.col("node").alias("id")).agg(fold("w").alias("strength"))
    if fold is not F.avg:
        values = values.withColumn("strength", F.when(~F.isnan("strength") & (F.abs("strength") < float("inf")), F.col("strength")).otherwise(0.0))
    return _for_all(graph, values, "strength", 0.0)


def pair_weights(graph: Graph, weight: str | None) -> DataFrame:
    """``a, b, w`` with a < b for each pair that an edge joins: parallel edges add up, opposite directions average."""
    rows = graph.edges.where("src <> dst").select("src", "dst", (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w"))
    if not graph.directed:
        return rows.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("w").alias("w"))
    one_way = rows.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return one_way.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.avg("w").alias("w"))


def clustering(graph: Graph, weight: str | None = None, variant: str = "unweighted") -> DataFrame:
    """``id, clustering`` by the unweighted, 'onnela' or 'newman' (Barrat) variant.

    Every triangle is found once: pairs point from the end of smaller degree
    to the other, and the two pairs that leave a node are closed by a third,
    so that a hub's neighbours are not paired with each other.
    """
    if variant not in ("unweighted", "onnela", "newman"):
        raise GraphError(f"unknown variant {variant!r}")
    if weight is not None and not isinstance(graph.edges.schema[weight].dataType, T.NumericType):
        raise GraphError(f"{weight!r} is no numeric edge attribute")
    pairs = pair_weights(graph, weight)
    ends = pairs.select(F.col("a").alias("id"), "w").unionByName(pairs.select(F.col("b").alias("id"), "w"))
    per = ends.groupBy("id").agg(F.count("*").alias("k"), F.sum("w").alias("s"))
    ranked = pairs.join(per.select(F.col("id").alias("a"), F.col("k").alias("ka")), "a").join(per.select(F.col("id").alias("b"), F.col("k").alias("kb")), "b")
    first = (F.col("ka") < F.col("kb")) | ((F.col("ka") == F.col("kb")) & (F.col("a") < F.col("b")))
    out = ranked.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("y"), "w")
    left = out.select("x", F.col("y").alias("p"), F.col("w").alias("wp"))
    right = out.select("x", F.col("y").alias("q"), F.col("w").alias("wq"))
    wedges = left.join(right, "x").where("p < q")
    closed = wedges.join(pairs.select(F.col("a").alias("p"), F.col("b").alias("q"), F.col("w").alias("wc")), ["p", "q"])
    if variant == "onnela":
        top = graph.edges.agg(F.max(F.lit(1.0) if weight is None else F.abs(F.col(weight).cast("double"))).alias("top")).select(F.when(F.col("top") > 0, F.col("top")).otherwise(1.0).alias("top"))
        closed = closed.crossJoin(F.broadcast(top))  # one row
        share = F.cbrt(F.abs(F.col("wp") * F.col("wq") * F.col("wc"))) / F.col("top")
        parts = [(c, share) for c in ("x", "p", "q")]
    elif variant == "newman":
        parts = [("x", (F.col("wp") + F.col("wq")) / 2), ("p", (F.col("wp") + F.col("wc")) / 2), ("q", (F.col("wq") + F.col("wc")) / 2)]
    else:
        parts = [(c, F.lit(1.0)) for c in ("x", "p", "q")]
    corners = closed.select(F.explode(F.array(*[F.struct(F.col(c).alias("id"), v.alias("v")) for c, v in parts])).alias("c")).groupBy(F.col("c.id").alias("id")).agg(F.sum("c.v").alias("t"))
    whole: Column = F.col("s") * (F.col("k") - 1) if variant == "newman" else F.col("k") * (F.col("k") - 1)
    values = per.where("k > 1").join(corners, "id").select("id", F.coalesce(F.try_divide(2 * F.col("t"), whole.cast("double")), F.lit(0.0)).alias("clustering"))
    return _for_all(graph, values, "clustering", 0.0)


def modularity(graph: Graph, labels: DataFrame, weight: str | None = None, resolution: float = 1.0) -> DataFrame:
    """One row ``modularity`` of the partition ``labels(id, label)``."""
    rows = weighted_adjacency(graph, weight, "out")
    of = labels.select(F.col("id").alias("node"), F.col("label").alias("a"))
    to = labels.select(F.col("id").alias("nbr"), F.col("label").alias("b"))
    rows = rows.join(of, "node").join(to, "nbr")
    out = rows.groupBy(F.col("a").alias("c")).agg(F.sum("w").alias("out"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("inner"))
    into = rows.groupBy(F.col("b").alias("c")).agg(F.sum("w").alias("into"))
    total = F.broadcast(rows.agg(F.sum("w").alias("m")))  # one row
    sums = out.join(into, "c", "full").crossJoin(total)
    term = F.coalesce("inner", F.lit(0.0)) / F.col("m") - resolution * F.coalesce("out", F.lit(0.0)) * F.coalesce("into", F.lit(0.0)) / (F.col("m") * F.col("m"))
    return sums.agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("modularity"))
