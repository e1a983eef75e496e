"""Attribute operators: categories, sets of categories, copies between nodes and edges."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.natural import natural_order
from graphloom.functions.types import MULTICATEGORY
from graphloom.graph import Graph, GraphError, numbered, running_sum
from graphloom.scratch import Scratch

MISSING = "__NA__"


def category_labels(frame: DataFrame, name: str, missing: str = MISSING) -> DataFrame:
    """``label, n, first``: how often each label comes and its smallest id; missing ones are left out."""
    return frame.where(F.col(name).isNotNull() & ~F.col(name).isin("", missing)).groupBy(F.col(name).alias("label")).agg(F.count("*").alias("n"), F.min("id").alias("first"))


def category_codes(frame: DataFrame, name: str, order: str = "none", missing: str = MISSING) -> DataFrame:
    """``label, code`` by first appearance ('none'), 'frequency', 'alphabetical' or 'natural' order; labels are ranked in ranges."""
    labels = category_labels(frame, name, missing)
    keyed = labels.withColumns({"__down": -F.col("n"), "__natural": natural_order(F.col("label"))})
    by = {"none": ["first"], "frequency": ["__down", "label"], "alphabetical": ["label"], "natural": ["__natural", "label"]}
    if order not in by:
        raise GraphError(f"unknown order {order!r}")
    return numbered(keyed, by[order], "__code").select("label", F.col("__code").cast("int").alias("code"))


class Codes(Mapping):
    """A dictionary of categories that stays a frame until a label is asked for."""

    def __init__(self, frame: DataFrame):
        self.frame = frame
        self._known: dict[str, int] | None = None

    def _all(self) -> dict[str, int]:
        if self._known is None:
            self._known = {r["label"]: r["code"] for r in self.frame.collect()}
        return self._known

    def __getitem__(self, label: str) -> int:
        return self._all()[label]

    def __iter__(self) -> Iterator[str]:
        return iter(self._all())

    def __len__(self) -> int:
        return len(self._all())


def _codes_frame(graph: Graph, scope: str, name: str) -> DataFrame:
    labels = graph.categories.get((scope, name), {})
    if isinstance(labels, Codes):
        return labels.frame
    return graph.spark.createDataFrame([(x, int(c)) for x, c in labels.items()], "label string, code int")


def categorize(graph: Graph, scope: str, name: str, order: str = "none", missing: str = MISSING) -> Graph:
    """Replace a string column by category codes; null, '' and the missing label become -1."""
    frame = graph.frame(scope)
    if not isinstance(frame.schema[name].dataType, T.StringType):
        raise GraphError(f"{name!r} is no string attribute")
    codes = Scratch(graph.spark, "codes").save(category_codes(frame, name, order, missing), "codes")
    named = codes.select(F.col("label").alias(name), F.col("code").alias("__code"))
    coded = frame.join(named, name, "left").withColumn(name, F.coalesce("__code", F.lit(-1)))
    absent = frame.where(F.col(name).isNull() | F.col(name).isin("", missing)).limit(1).select(F.lit(missing).alias("label"), F.lit(-1).alias("code"))
    out = graph.with_frame(scope, coded.select(frame.columns))
    return replace(out, categories={**graph.categories, (scope, name): Codes(codes.unionByName(absent))})


def decategorize(graph: Graph, scope: str, name: str, missing: str = MISSING) -> Graph:
    """Labels in place of codes: negative codes give the missing label, unknown ones null."""
    frame = graph.frame(scope)
    known = _codes_frame(graph, scope, name).where("code >= 0").groupBy(F.col("code").alias("__code")).agg(F.min("label").alias("__label"))
    rows = frame.join(known, F.col(name) == F.col("__code"), "left")
    text = F.when(F.col(name) < 0, F.lit(missing)).otherwise(F.col("__label"))
    out = graph.with_frame(scope, rows.withColumn(name, text).select(frame.columns))
    return replace(out, categories={k: v for k, v in graph.categories.items() if k != (scope, name)})


def set_dictionary(graph: Graph, scope: str, name: str, labels: dict[str, int], remap: bool = False) -> Graph:
    """Replace a dictionary; with ``remap`` codes follow their labels, -1 where the new one has no such label."""
    out = graph
    if remap:
        moves = [(code, labels.get(label, -1)) for label, code in graph.dictionary(scope, name).items()]
        table = F.create_map(*[F.lit(x) for pair in moves for x in pair]) if moves else None
        new = lambda c: F.coalesce(F.try_element_at(table, c), F.lit(-1)) if table is not None else F.lit(-1)
        c = F.col(name)
        sets = isinstance(graph.frame(scope).schema[name].dataType, T.ArrayType)
        column = F.transform(c, lambda x: F.struct(new(x["id"]).alias("id"), x["weight"].alias("weight"))) if sets else new(c)
        out = graph.with_frame(scope, graph.frame(scope).withColumn(name, column))
    return replace(out, categories={**graph.categories, (scope, name): dict(labels)})


def set_multicategory(graph: Graph, scope: str, name: str, values: dict[int, list[str] | dict[str, float]], weighted: bool = False) -> Graph:
    """Set rows' categories by label; new labels get the next codes in the order they come."""
    labels = graph.dictionary(scope, name)
    rows = []
    for row, entry in values.items():
        if weighted != isinstance(entry, dict):
            raise GraphError("weights are needed exactly if the attribute is weighted")
        pairs = entry.items() if isinstance(entry, dict) else ((x, None) for x in entry)
        coded = []
        for label, weight in pairs:
            code = labels.setdefault(label, max(labels.values(), default=-1) + 1)
            coded.append((code, None if weight is None else float(weight)))
        rows.append((int(row), coded))
    frame = graph.frame(scope)
    if name not in frame.columns:
        graph = graph.define_attribute(scope, name, "multicategory")
    new = graph.spark.createDataFrame(rows, T.StructType([T.StructField("id", T.LongType()), T.StructField("value", MULTICATEGORY)]))
    return replace(graph.set_values(scope, name, new), categories={**graph.categories, (scope, name): labels})


def multicategory_buffers(graph: Graph, scope: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Compressed rows: ``id, offset, stop`` of each row, and ``at, id, category, weight`` of each entry.

    A row without entries begins and ends where the next one begins.
    """
    rows = graph.frame(scope).select("id", F.posexplode(name).alias("pos", "entry"))
    entries = rows.select("id", "pos", F.col("entry.id").alias("category"), F.col("entry.weight").alias("weight"))
    placed = numbered(entries, ["id", "pos"], "at")
    sizes = graph.frame(scope).select("id", F.coalesce(F.greatest(F.size(name), F.lit(0)), F.lit(0)).alias("n"))
    offsets = running_sum(sizes, ["id"], F.col("n"), "offset")
    return offsets.select("id", "offset", (F.col("offset") + F.col("n")).alias("stop")), placed.select("at", "id", "category", "weight")


def edge_ends(graph: Graph, *names: str) -> DataFrame:
    """Edges with the node attributes of both ends as ``src_<name>`` and ``dst_<name>``."""
    rows = graph.edges
    for end in ("src", "dst"):
        rows = rows.join(graph.nodes.select(F.col("id").alias(end), *[F.col(n).alias(f"{end}_{n}") for n in names]), end)
    return rows


def node_to_edge(graph: Graph, source: str, target: str, endpoint: str = "both", duplicate: bool = False) -> Graph:
    """Copy a node attribute to an edge attribute: of the 'src', the 'dst', or both ends one after the other.

    With ``duplicate``, a single end's value comes twice.
    """
    kind = graph.nodes.schema[source].dataType
    listed = lambda c: c if isinstance(kind, T.ArrayType) else F.array(c)
    rows = edge_ends(graph, source)
    a, b = F.col(f"src_{source}"), F.col(f"dst_{source}")
    if endpoint == "both":
        value: Column = F.concat(listed(a), listed(b))
    else:
        one = a if endpoint == "src" else b
        value = F.concat(listed(one), listed(one)) if duplicate else one
    keep = [c for c in graph.edges.columns if c != target]
    return graph.with_frame("edge", rows.withColumn("__value", value).select(*keep, F.col("__value").alias(target)))


def interpolate(graph: Graph, scope: str, name: str, goals: DataFrame, elapsed: float, layout_elapsed: float, smoothing: float = 1.0, min_ratio: float = 0.0) -> tuple[Graph, bool]:
    """Move a float vector attribute towards ``goals(id, value)``; whether it moved noticeably.

    The share of the way is 1 - exp(-smoothing * step / layout time), with the
    step limited to 20 and the time to 10..2500 milliseconds.
    """
    import math

    w = 1 - math.exp(-smoothing * min(elapsed, 20.0) / min(max(layout_elapsed, 10.0), 2500.0))
    frame = graph.frame(scope)
    rows = frame.join(goals.select("id", F.col("value").alias("__goal")), "id", "left")
    moved = F.zip_with(name, "__goal", lambda c, t: (c + w * (t - c)).cast("float"))
    far = rows.agg(F.max(F.array_max(F.zip_with(name, "__goal", lambda c, t: F.abs(w * (t - c))))), F.max(F.array_max(F.transform("__goal", F.abs)))).first()
    out = rows.withColumn(name, F.coalesce(moved, F.col(name))).select(frame.columns)
    active = bool(far[0]) and (far[1] or 0) > 0 and far[0] / far[1] >= min_ratio
    return graph.with_frame(scope, out), active
