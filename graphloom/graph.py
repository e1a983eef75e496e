"""The property graph: a pair of DataFrames and the rules of their columns.

``nodes`` has a row for each node: ``id`` and the node attributes.  ``edges``
has a row for each edge: ``id``, ``src``, ``dst`` and the edge attributes.
Graphs are immutable: every change gives a new graph whose frames are lazy.
Multi-edges and self-loops are allowed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.types import attribute_type, default_value

RESERVED = {"node": ("id",), "edge": ("id", "src", "dst")}


class GraphError(ValueError):
    """A request that the graph cannot meet."""


@dataclass(frozen=True)
class Graph:
    """Nodes, edges and network attributes with their category dictionaries and versions.

    ``categories`` maps (scope, attribute) to {label: code}; such a column
    holds integer codes, -1 for missing.
    """

    nodes: DataFrame
    edges: DataFrame
    directed: bool = False
    attributes: dict[str, object] = field(default_factory=dict)
    categories: dict[tuple[str, str], Mapping[str, int]] = field(default_factory=dict)
    versions: dict[str, int] = field(default_factory=dict)
    derived: dict[str, tuple[str, str, bool]] = field(default_factory=dict)

    # -- construction ------------------------------------------------------------------------

    @staticmethod
    def empty(spark: SparkSession, directed: bool = False) -> Graph:
        return Graph(spark.createDataFrame([], "id long"), spark.createDataFrame([], "id long, src long, dst long"), directed)

    @staticmethod
    def of_edges(nodes: DataFrame, edges: DataFrame, directed: bool = False) -> Graph:
        """A graph of ``nodes(id, ...)`` and ``edges(src, dst, ...)``; edges without an id are numbered."""
        if "id" not in edges.columns:
            edges = numbered(edges, ["src", "dst", *[c for c in edges.columns if c not in ("src", "dst")]])
        return Graph(nodes, edges.select("id", "src", "dst", *[c for c in edges.columns if c not in RESERVED["edge"]]), directed)

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def frame(self, scope: str) -> DataFrame:
        return {"node": self.nodes, "edge": self.edges}[scope]

    def with_frame(self, scope: str, frame: DataFrame) -> Graph:
        return replace(self, **{f"{scope}s": frame})._bumped(f"{scope}s")

    def _bumped(self, *names: str) -> Graph:
        """Versions count changes of the topology and of each attribute; they wrap below 2^53."""
        versions = dict(self.versions)
        for n in names:
            versions[n] = (versions.get(n, 0) + 1) % ((1 << 53) - 1)
        return replace(self, versions=versions)

    def bump_attribute(self, scope: str, name: str) -> Graph:
        return self._bumped(f"{scope}.{name}")

    # -- topology ----------------------------------------------------------------------------

    def add_nodes(self, count: int) -> Graph:
        """Append nodes with default attributes; their ids follow the largest id."""
        if count <= 0:
            raise GraphError("the number of nodes to add must be positive")
        first = self.nodes.agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0]
        fresh = self.spark.range(first, first + count).select("id", *[default_value(f).alias(f.name) for f in self.nodes.schema.fields[1:]])
        return replace(self, nodes=self.nodes.unionByName(fresh))._bumped("nodes")

    def remove_nodes(self, ids: DataFrame | Iterable[int]) -> Graph:
        """Drop nodes and their incident edges; unknown ids are ignored."""
        gone = self.ids_frame(ids)
        edges = self.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        return replace(self, nodes=self.nodes.join(gone, "id", "left_anti"), edges=edges.select(self.edges.columns))._bumped("nodes", "edges")

    def add_edges(self, pairs: DataFrame | Iterable[tuple[int, int]]) -> Graph:
        """Append edges (parallel ones and loops too) with default attributes; an unknown end rejects the whole batch."""
        if not isinstance(pairs, DataFrame):
            pairs = self.spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(pairs)], "pos long, src long, dst long")
        elif "pos" not in pairs.columns:
            pairs = numbered(pairs.select("src", "dst"), ["src", "dst"], "pos")
        ends = pairs.select(F.col("src").alias("id")).union(pairs.select("dst")).distinct()
        if ends.join(self.nodes.select("id"), "id", "left_anti").limit(1).count():
            raise GraphError("an edge refers to a node that does not exist")
        first = self.edges.agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0]
        fresh = pairs.select((F.col("pos") + first).alias("id"), "src", "dst", *[default_value(f).alias(f.name) for f in self.edges.schema.fields[3:]])
        return replace(self, edges=self.edges.unionByName(fresh))._bumped("edges")

    def add_edges_from_arrays(self, sources: Iterable[int], targets: Iterable[int]) -> Graph:
        sources, targets = list(sources), list(targets)
        if len(sources) != len(targets):
            raise GraphError("sources and targets differ in length")
        return self.add_edges(zip(sources, targets, strict=True))

    def remove_edges(self, ids: DataFrame | Iterable[int]) -> Graph:
        return replace(self, edges=self.edges.join(self.ids_frame(ids), "id", "left_anti"))._bumped("edges")

    def ids_frame(self, ids: DataFrame | Iterable[int]) -> DataFrame:
        """Distinct ids as a frame."""
        if isinstance(ids, DataFrame):
            return ids.select("id").distinct()
        return self.spark.createDataFrame([(int(i),) for i in dict.fromkeys(ids)], "id long")

    def compact(self, node_ids: str | None = None, edge_ids: str | None = None) -> Graph:
        """Number nodes and edges 0..n-1 in ascending order of their ids, optionally keeping the old ids as attributes."""
        nodes = numbered(self.nodes, ["id"], "__new")
        renamed = nodes.select(F.col("id").alias("__old"), "__new")
        edges = numbered(self.edges, ["id"], "__eid")
        for end in ("src", "dst"):
            edges = edges.join(renamed.select(F.col("__old").alias(end), F.col("__new").alias(f"__{end}")), end)
        old_node = [F.col("id").alias(node_ids)] if node_ids else []
        old_edge = [F.col("id").alias(edge_ids)] if edge_ids else []
        nodes = nodes.select(F.col("__new").alias("id"), *self.nodes.columns[1:], *old_node)
        edges = edges.select(F.col("__eid").alias("id"), F.col("__src").alias("src"), F.col("__dst").alias("dst"), *self.edges.columns[3:], *old_edge)
        return replace(self, nodes=nodes, edges=edges)._bumped("nodes", "edges")

    # -- scans -------------------------------------------------------------------------------

    def edge_pairs(self) -> DataFrame:
        return self.edges.select("id", "src", "dst")

    def active(self, scope: str, ids: Iterable[int]) -> DataFrame:
        """``pos, id, active``: whether each given id exists, in the given order."""
        asked = self.spark.createDataFrame([(p, int(i)) for p, i in enumerate(ids)], "pos long, id long")
        there = self.frame(scope).select("id", F.lit(True).alias("active"))
        return asked.join(there, "id", "left").select("pos", "id", F.coalesce("active", F.lit(False)).alias("active"))

    def valid_range(self, scope: str) -> DataFrame:
        """``first, stop``: the smallest id and one more than the largest, 0 and 0 without rows."""
        return self.frame(scope).agg(F.coalesce(F.min("id"), F.lit(0)).alias("first"), F.coalesce(F.max("id") + 1, F.lit(0)).alias("stop"))

    def adjacency(self, direction: str = "out", attributes: Iterable[str] = ()) -> DataFrame:
        """``node, nbr, edge`` with a row for each entry of the nodes' neighbour lists.

        An undirected edge stands in both ends' lists (a loop twice in its
        node's), whatever the direction; 'both' of a directed graph is out and
        in together.
        """
        keep = [F.col(a) for a in attributes]
        out = self.edges.select(F.col("src").alias("node"), F.col("dst").alias("nbr"), F.col("id").alias("edge"), *keep)
        back = self.edges.select(F.col("dst").alias("node"), F.col("src").alias("nbr"), F.col("id").alias("edge"), *keep)
        if not self.directed or direction == "both":
            return out.unionByName(back)
        if direction not in ("out", "in"):
            raise GraphError(f"unknown direction {direction!r}")
        return out if direction == "out" else back

    # -- attributes --------------------------------------------------------------------------

    def define_attribute(self, scope: str, name: str, kind: str, dimension: int = 1) -> Graph:
        """A new column of zeros (null for strings); an existing name is an error."""
        if scope == "network":
            if name in self.attributes:
                raise GraphError(f"attribute {name!r} exists")
            return replace(self, attributes={**self.attributes, name: None})._bumped(f"network.{name}")
        frame = self.frame(scope)
        if name in frame.columns:
            raise GraphError(f"attribute {name!r} exists")
        data_type = attribute_type(kind, dimension)
        categories = {**self.categories, (scope, name): {}} if kind.lower() in ("category", "multicategory") else self.categories
        column = default_value(T.StructField(name, data_type), dimension).alias(name)
        return replace(self.with_frame(scope, frame.select("*", column)), categories=categories)

    def remove_attribute(self, scope: str, name: str) -> Graph:
        categories = {k: v for k, v in self.categories.items() if k != (scope, name)}
        if scope == "network":
            return replace(self, attributes={k: v for k, v in self.attributes.items() if k != name}, categories=categories)
        if name in RESERVED[scope] or name not in self.frame(scope).columns:
            raise GraphError(f"no attribute {name!r}")
        return replace(self.with_frame(scope, self.frame(scope).drop(name)), categories=categories)

    def attribute_names(self, scope: str) -> list[str]:
        return list(self.attributes) if scope == "network" else [c for c in self.frame(scope).columns if c not in RESERVED[scope]]

    def attribute_info(self, scope: str, name: str) -> dict[str, object]:
        """Type, whether it is a vector, and its version."""
        kind = self.frame(scope).schema[name].dataType
        vector = isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.StructType)
        return {"name": name, "type": "category" if (scope, name) in self.categories else kind.simpleString(), "vector": vector, "version": self.versions.get(f"{scope}.{name}", 0)}

    def with_attribute(self, scope: str, name: str, value: object) -> Graph:
        """Set a whole attribute from a constant, a column expression or a (pandas) function of the row's columns."""
        if scope == "network":
            return replace(self, attributes={**self.attributes, name: value})._bumped(f"network.{name}")
        column = value if isinstance(value, Column) else F.lit(value)
        return self.with_frame(scope, self.frame(scope).withColumn(name, column)).bump_attribute(scope, name)

    def map_attribute(self, scope: str, name: str, function: Callable[[object, int], object], kind: str) -> Graph:
        """Set an attribute row by row from ``function(current value, id)``; one version for the whole change.

        Rows pass in Arrow batches.  Prefer ``with_attribute`` with a column
        expression, which needs no Python.  An attribute that is not there yet
        comes as None.
        """
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        frame = self.frame(scope)
        data_type = attribute_type(kind) if isinstance(kind, str) else kind
        current = F.col(f"`{name}`") if name in frame.columns else F.lit(None).cast("int")
        rows = frame.select("id", current.alias("current"))
        arrow = to_arrow_type(data_type)

        def written(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            for batch in batches:
                values = [function(c, i) for i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, arrow)], ["id", "value"])

        schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("value", data_type)])
        return self.set_values(scope, name, rows.mapInArrow(written, schema))

    def derive_edge_attribute(self, source: str, target: str, endpoint: str = "both", duplicate: bool = False) -> Graph:
        """An edge attribute that follows a node attribute: ``edge_view`` computes it from the nodes as they are then."""
        if source not in self.nodes.columns:
            raise GraphError(f"no attribute {source!r}")
        if endpoint not in ("src", "dst", "both"):
            raise GraphError(f"unknown endpoint {endpoint!r}")
        if target in self.edges.columns:
            raise GraphError(f"attribute {target!r} exists")
        return replace(self, derived={**self.derived, target: (source, endpoint, duplicate)})

    def edge_view(self) -> DataFrame:
        """The edges with all derived attributes."""
        from graphloom.operators.attributes import node_to_edge

        out = replace(self, derived={})
        for target, (source, endpoint, duplicate) in self.derived.items():
            out = node_to_edge(out, source, target, endpoint, duplicate)
        return out.edges

    def set_values(self, scope: str, name: str, values: DataFrame) -> Graph:
        """Overwrite an attribute where ``values(id, value)`` has a row."""
        frame = self.frame(scope)
        new = values.select("id", F.struct("value").alias("__new"))
        column = F.when(F.col("__new").isNotNull(), F.col("__new.value"))
        old = F.col(name) if name in frame.columns else None
        column = column.otherwise(old) if old is not None else column
        out = frame.join(new, "id", "left").withColumn(name, column).drop("__new")
        return self.with_frame(scope, out.select(*frame.columns, *([] if old is not None else [name]))).bump_attribute(scope, name)

    def get_value(self, scope: str, name: str, row: int) -> object:
        if scope == "network":
            return self.attributes.get(name)
        found = self.frame(scope).where(F.col("id") == row).select(name).take(1)
        if not found:
            raise GraphError(f"no {scope} {row}")
        return found[0][0]

    def project(self, scope: str, selector: DataFrame, *names: str) -> DataFrame:
        """The attributes of the selected rows; further columns of the selector (such as its order) stay."""
        return selector.join(self.frame(scope).select("id", *names), "id")

    def dictionary(self, scope: str, name: str) -> dict[str, int]:
        return dict(self.categories.get((scope, name), {}))


def running_sum(frame: DataFrame, order: list[str], amount: Column, name: str) -> DataFrame:
    """The sum of ``amount`` over all rows before each by ``order``, without sending them to one task.

    Rows are ranged by the order and summed in each range; a row's value is
    the sum of the ranges before its own and of the rows before it there.
    """
    from pyspark.sql import Window

    from graphloom.scratch import Scratch

    kept = frame.withColumn("__amount", amount.cast("long"))
    parts = Scratch(frame.sparkSession, "numbered").save(kept.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    before, offsets = 0, []
    for part, n in sorted(parts.groupBy("__part").agg(F.sum("__amount")).collect()):  # a row for each range
        offsets += [F.lit(part), F.lit(before)]
        before += n or 0
    offset = F.element_at(F.create_map(*offsets), F.col("__part")) if offsets else F.lit(0)
    within = F.sum("__amount").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return parts.withColumn(name, (F.coalesce(within, F.lit(0)) + offset).cast("long")).drop("__part", "__amount")


def numbered(frame: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Rows numbered from 0 by ``order`` without sending them to one task."""
    rows = running_sum(frame, order, F.lit(1), name)
    return rows.select(name, *frame.columns) if name == "id" else rows
