"""From syntax trees to columns and the side tables they need.

The language is two-valued: a predicate on a missing value is false, and NOT
makes it true; so every leaf is coalesced.  Comparisons with NaN follow IEEE.
Predicates about neighbours and edge ends become Boolean flags that are
computed on the nodes once; all neighbour flags of a query share one pass over
the adjacency.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.types import is_numeric
from graphloom.functions.vectors import REDUCTIONS, dot, doubles
from graphloom.graph import Graph
from graphloom.plans.language import Both, Not, Predicate, QueryError, parse

#: POSIX bracket classes as Java has them.
_POSIX = {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "space": r"\s", "punct": r"\p{Punct}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "graph": r"\p{Graph}", "print": r"\p{Print}", "xdigit": r"\p{XDigit}"}


def java_regex(pattern: str) -> str:
    """An extended POSIX expression in Java's dialect."""
    return re.sub(r"\[:(\w+):\]", lambda m: _POSIX.get(m[1], m[0]), pattern)


def _compare(c: Column, operator: str, value: float) -> Column:
    number, v = c.cast("double"), F.lit(float(value))
    nan = F.isnan(number)
    return {
        "==": lambda: (number == v) & ~nan,
        "!=": lambda: (number != v) | nan,
        "<": lambda: number < v,
        "<=": lambda: number <= v,
        ">": lambda: (number > v) & ~nan,
        ">=": lambda: (number >= v) & ~nan,
    }[operator]()


class _Binder:
    """Resolves a predicate's attribute in one scope and gives its column."""

    def __init__(self, graph: Graph, scope: str):
        self.graph, self.scope, self.schema = graph, scope, graph.frame(scope).schema

    def column(self, p: Predicate) -> Column:
        if p.name not in self.schema.names:
            raise QueryError(f"unknown attribute {p.name!r}")
        kind = self.schema[p.name].dataType
        labels = self.graph.categories.get((self.scope, p.name))
        vector = isinstance(kind, T.ArrayType)
        element = kind.elementType if vector else kind
        text = isinstance(element, T.StringType)
        if not text and not is_numeric(element):
            raise QueryError(f"attribute {p.name!r} cannot be queried")
        self._check(p, text, vector, labels is not None)
        test = lambda c: self._test(p, c, text, labels)
        c = F.col(p.name)
        if p.accessor == "index":
            return F.coalesce(test(F.get(c, F.lit(p.argument)) if vector else c), F.lit(False))
        if p.accessor in REDUCTIONS:
            return F.coalesce(test(REDUCTIONS[p.accessor](doubles(c))), F.lit(False))
        if p.accessor == "dot":
            return F.coalesce(test(dot(doubles(c), self._other(p))), F.lit(False))
        if p.accessor == "all":
            return F.coalesce(F.forall(c, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))
        if vector:
            return F.coalesce(F.exists(c, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))
        return F.coalesce(test(c), F.lit(False))

    def _check(self, p: Predicate, text: bool, vector: bool, category: bool) -> None:
        if p.accessor == "index" and not vector and p.argument:
            raise QueryError("index out of range")
        if p.accessor not in (None, "index") and not vector:
            raise QueryError(f".{p.accessor} needs a vector")
        reduced = p.accessor in REDUCTIONS or p.accessor == "dot"
        if reduced and text:
            raise QueryError(f".{p.accessor} needs numbers")
        strings = isinstance(p.value, str) or (p.operator == "IN" and isinstance(p.value[0], str))
        if reduced and strings:
            raise QueryError(f".{p.accessor} compares with numbers")
        if p.operator == "=~" and (not text or category):
            raise QueryError("=~ needs a string attribute")
        if strings and p.operator in ("<", "<=", ">", ">="):
            raise QueryError("strings have no order here")
        if p.operator == "IN" and strings != (text or category):
            raise QueryError("IN list cannot be empty")

    def _other(self, p: Predicate) -> Column:
        """The second vector of a dot product: literal, or an attribute of the same scope as the first."""
        if isinstance(p.argument, tuple):
            return F.array(*[F.lit(float(x)) for x in p.argument])
        if p.argument not in self.schema.names or not isinstance(self.schema[p.argument].dataType, T.ArrayType):
            raise QueryError(f"no vector {p.argument!r}")
        return doubles(F.col(p.argument))

    def _test(self, p: Predicate, c: Column, text: bool, labels: dict[str, int] | None) -> Column:
        value = p.value
        if p.operator == "IN":
            if labels is not None:
                unknown = [v for v in value if v not in labels]
                if unknown:
                    raise QueryError(f"unknown category {unknown[0]!r}")
                return c.isin([labels[v] for v in value])
            if text:
                return c.isin(list(value))
            return c.cast("double").isin([float(v) for v in value]) & ~F.isnan(c.cast("double"))
        if p.operator == "=~":
            return c.rlike(java_regex(value))
        if isinstance(value, str):
            if labels is not None:  # an unknown label is neither equal nor unequal
                code = labels.get(value)
                return F.lit(False) if code is None else (c == code if p.operator == "==" else c != code)
            if not text:
                return F.lit(False)
            return c == value if p.operator == "==" else c != value
        if text:
            return F.lit(False)
        return _compare(c, p.operator, value)


class Compiled:
    """A query over one scope: its rows are ``ids()``."""

    def __init__(self, graph: Graph, scope: str, text: str):
        self.graph, self.scope = graph, scope
        self.own, self.on_nodes = _Binder(graph, scope), _Binder(graph, "node")
        self.near: list[tuple[str, Column]] = []  # neighbour flags: any or both, and the neighbour's column
        self.ends: dict[str, list[Column]] = {"src": [], "dst": []}
        self.condition = self._term(parse(text))

    def _term(self, t: object) -> Column:
        if isinstance(t, Not):
            return ~self._term(t.term)
        if isinstance(t, Both):
            left, right = self._term(t.left), self._term(t.right)
            return (left & right) if t.operator == "AND" else (left | right)
        return self._leaf(t)

    def _leaf(self, p: Predicate) -> Column:
        if p.qualifier is None:
            return self.own.column(p)
        if p.qualifier.endswith(".neighbor"):
            if self.scope != "node":
                raise QueryError("neighbour predicates belong to node queries")
            self.near.append((p.qualifier.split(".")[0], self.on_nodes.column(p)))
            return F.coalesce(F.col(f"__near{len(self.near) - 1}"), F.lit(False))
        if self.scope != "edge":
            raise QueryError(f"${p.qualifier} belongs to edge queries")
        column = self.on_nodes.column(p)
        if p.qualifier in ("src", "dst"):
            return self._end(p.qualifier, column)
        a, b = self._end("src", column), self._end("dst", column)
        return (a | b) if p.qualifier == "any" else (a & b)

    def _end(self, end: str, column: Column) -> Column:
        self.ends[end].append(column)
        return F.col(f"__{end}{len(self.ends[end]) - 1}")

    def rows(self) -> DataFrame:
        """The scope's rows that satisfy the query."""
        frame = self.graph.frame(self.scope)
        wide = frame
        if self.near:
            flags = self.graph.nodes.select(F.col("id").alias("nbr"), *[c.alias(f"__f{i}") for i, (_, c) in enumerate(self.near)])
            fold = {"any": F.bool_or, "both": F.bool_and}
            around = self.graph.adjacency("both").select("node", "nbr").join(flags, "nbr").groupBy(F.col("node").alias("id"))
            around = around.agg(*[fold[how](f"__f{i}").alias(f"__near{i}") for i, (how, _) in enumerate(self.near)])
            wide = wide.join(around, "id", "left")
        for end, columns in self.ends.items():
            if columns:
                flags = self.graph.nodes.select(F.col("id").alias(end), *[c.alias(f"__{end}{i}") for i, c in enumerate(columns)])
                wide = wide.join(flags, end)
        return wide.where(self.condition).select(frame.columns)

    def ids(self) -> DataFrame:
        return self.rows().select("id")
