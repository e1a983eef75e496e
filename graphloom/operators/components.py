"""Connected components of an edge table by repeated contraction.

Every round hooks each vertex to its smallest neighbour, flattens the
resulting forest by pointer jumping and replaces the edges by those between
the roots.  A round at least halves the number of vertices that still have an
edge, so the number of rounds is logarithmic whatever the diameter.  All state
is distributed and written to shared scratch between rounds.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.scratch import Scratch


def _flatten(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """Pointer jumping over ``(v, p)`` until every ``p`` is a root."""
    while True:
        up = parents.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        step = parents.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("q"), "p")
        step = scratch.save(step, "jump")
        moved = step.where("q <> p").limit(1).count()
        parents = step.select("v", F.col("q").alias("p"))
        if not moved:
            return parents


def component_rounds(edges: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> Iterator[DataFrame]:
    """The rounds of ``component_labels``: the labels so far after each, the last ones final."""
    scratch = scratch or Scratch(edges.sparkSession, "components")
    live = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    live = scratch.save(live.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "edges")
    labels: DataFrame | None = None
    while live.limit(1).count():
        # smallest neighbour of either end; a vertex that is its own minimum stays a root
        both = live.unionByName(live.select(F.col("y").alias("x"), F.col("x").alias("y")))
        hooks = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("v"), F.least("x", "m").alias("p"))
        parents = _flatten(scratch.save(hooks, "hooks"), scratch)
        if labels is None:
            labels = parents.select("v", F.col("p").alias("comp"))
        else:
            moved = parents.select(F.col("v").alias("comp"), F.col("p").alias("root"))
            known = labels.join(moved, "comp", "left").select("v", F.coalesce("root", "comp").alias("comp"))
            labels = scratch.save(known, "labels")
        yield labels
        px = parents.select(F.col("v").alias("x"), F.col("p").alias("rx"))
        py = parents.select(F.col("v").alias("y"), F.col("p").alias("ry"))
        nxt = live.join(px, "x").join(py, "y").where("rx <> ry")
        nxt = nxt.select(F.greatest("rx", "ry").alias("x"), F.least("rx", "ry").alias("y")).distinct()
        live = scratch.save(nxt, "edges")
    if labels is None:
        yield live.select(F.col("x").alias("v"), F.col("y").alias("comp"))


def component_labels(edges: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """``(v, comp)`` for each vertex of ``edges``: the smallest vertex it is connected with.

    Vertices without an edge to another vertex are not listed: their component
    is themselves.  Null ends are ignored.  Edge direction does not matter.
    """
    return deque(component_rounds(edges, a, b, scratch), maxlen=1)[0]
