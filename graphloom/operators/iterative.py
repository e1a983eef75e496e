"""Measures that repeat a step until it changes nothing: components, cores, centralities, dimension.

Each measure's state is a frame that every round writes to shared scratch; a
``Session`` drives the rounds one at a time and reports progress.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace
from functools import partial, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph, GraphError, running_sum
from graphloom.operators.components import component_rounds
from graphloom.operators.local import LOCAL_LINKS, path_dependencies, settled_cores, strong_labels
from graphloom.operators.measures import _for_all, weighted_adjacency
from graphloom.operators.select import edges_among
from graphloom.operators.traverse import pair_distances, pair_levels
from graphloom.scratch import Scratch


class Session:
    """A measure that advances step by step.

    The rounds are a generator of (phase, progress, state); the last state is
    the result.  The graph is immutable, so a session never goes stale.
    """

    def __init__(self, rounds: Iterator[tuple[str, float, DataFrame]]):
        self._rounds, self.phase, self.progress = rounds, "start", 0.0
        self.state: DataFrame | None = None
        self.complete = self.cancelled = False

    def cancel(self) -> None:
        """Stop for good: no further round runs and there is no result."""
        if not self.complete:
            self.cancelled, self.phase = True, "cancelled"
            self._rounds.close()  # type: ignore[attr-defined]

    def step(self, budget: int = 1) -> bool:
        """Run up to ``budget`` rounds; True once complete."""
        if self.cancelled:
            raise GraphError("the session was cancelled")
        for _ in range(budget):
            try:
                self.phase, p, self.state = next(self._rounds)
                self.progress = max(self.progress, p)
            except StopIteration:
                self.complete, self.progress, self.phase = True, 1.0, "done"
                break
        return self.complete

    def run(self, on_progress: Callable[[str, float], None] | None = None) -> DataFrame:
        while not self.step():
            if on_progress:
                on_progress(self.phase, self.progress)
            if self.cancelled:
                break
        return self.result()

    def result(self) -> DataFrame:
        if not self.complete or self.state is None:
            raise GraphError("the session is not complete")
        return self.state


# -- components --------------------------------------------------------------------------------


def _ranked(least: DataFrame) -> DataFrame:
    """``id, component``: components numbered 1.. in the order of their smallest node."""
    from graphloom.graph import numbered

    roots = numbered(least.where("id = least").select("least"), ["least"], "__n").select("least", (F.col("__n") + 1).alias("component"))
    return least.join(roots, "least").select("id", "component")


def _weak_rounds(graph: Graph) -> Iterator[tuple[str, float, DataFrame]]:
    rounds, n = component_rounds(graph.edges, "src", "dst"), 0
    for labels in rounds:
        n += 1
        last = labels.withColumnRenamed("v", "id")
        yield "contract", 1 - 1 / (n + 1), last
    yield "rank", 0.99, _ranked(graph.nodes.select("id").join(last, "id", "left").select("id", F.coalesce("comp", "id").alias("least")))


def weak_components(graph: Graph) -> DataFrame:
    """``id, component``: edges in either direction connect."""
    return Session(_weak_rounds(graph)).run()


def _spread(edges: DataFrame, start: DataFrame, scratch: Scratch, inside: str | None = None) -> DataFrame:
    """Smallest label that reaches each node along edges; ``inside``: a column of labels that must agree at both ends."""
    labels = start
    while True:
        came = edges.join(labels.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("in"))
        step = scratch.save(labels.join(came, "id", "left").select("id", F.least("label", F.coalesce("in", "label")).alias("label"), (F.col("in") < F.col("label")).alias("moved")), "spread")
        labels = step.select("id", "label")
        if not step.where("moved").limit(1).count():
            return labels


def _strong_rounds(graph: Graph, local_links: int = LOCAL_LINKS) -> Iterator[tuple[str, float, DataFrame]]:
    """Trimming, forward colouring and backward search until one task holds what is left, which Tarjan's search ends."""
    scratch = Scratch(graph.spark, "strong")
    nodes = scratch.save(graph.nodes.select("id"), "nodes")
    edges = scratch.save(graph.edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    done: list[DataFrame] = []
    first = max(edges.count(), 1)
    left = first
    while left > local_links:
        live = edges.select(F.col("src").alias("id")).intersect(edges.select("dst"))
        alone = scratch.save(nodes.join(live, "id", "left_anti").select("id", F.col("id").alias("least")), "alone")
        if alone.limit(1).count():
            done.append(alone)
            nodes = scratch.save(nodes.join(alone, "id", "left_anti"), "nodes")
        else:
            colours = _spread(edges, nodes.withColumn("label", F.col("id")), scratch)
            # within a colour, what also reaches its root backward is the root's component
            same = edges.join(colours.select(F.col("id").alias("src"), F.col("label").alias("c")), "src").join(colours.select(F.col("id").alias("dst"), F.col("label").alias("d")), "dst").where("c = d")
            frontier = reached = scratch.save(colours.where("id = label").select("id", F.col("label").alias("least")), "roots")
            back = scratch.save(same.select(F.col("dst").alias("id"), F.col("src").alias("to"), F.col("c").alias("least")), "back")
            while frontier.limit(1).count():
                step = frontier.join(back, ["id", "least"]).select(F.col("to").alias("id"), "least").distinct()
                frontier = scratch.save(step.join(reached, "id", "left_anti"), "reach")
                reached = reached.unionByName(frontier)
            reached = scratch.save(reached, "component")
            done.append(reached)
            nodes = scratch.save(nodes.join(reached, "id", "left_anti"), "nodes")
        kept = edges.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi")
        edges = scratch.save(kept, "edges")
        left = edges.count()
        yield "trim", 1 - left / first, nodes
    rest = scratch.save(edges.groupBy(F.lit(0).alias("one")).applyInArrow(strong_labels, "id long, least long"), "rest")
    alone = nodes.join(rest, "id", "left_anti").select("id", F.col("id").alias("least"))
    found = reduce(DataFrame.unionByName, [*done, rest, alone])
    least = found.groupBy("least").agg(F.min("id").alias("first"))
    yield "rank", 0.99, _ranked(found.join(least, "least").select("id", F.col("first").alias("least")))


def strong_components(graph: Graph, local_links: int = LOCAL_LINKS) -> DataFrame:
    """``id, component``: nodes that reach each other along edges.

    Nodes without way in or out are trimmed and components split off by
    colouring until at most ``local_links`` edges are left, which one task
    takes; the result does not depend on where that is.
    """
    return Session(_strong_rounds(graph, local_links) if graph.directed else _weak_rounds(graph)).run()


def component_session(graph: Graph, mode: str = "weak") -> Session:
    """``connected_components`` round by round."""
    if mode not in ("weak", "strong"):
        raise GraphError(f"unknown mode {mode!r}")
    return Session(_strong_rounds(graph) if mode == "strong" and graph.directed else _weak_rounds(graph))


def connected_components(graph: Graph, mode: str = "weak") -> DataFrame:
    return {"weak": weak_components, "strong": strong_components}[mode](graph)


def component_sizes(components: DataFrame) -> DataFrame:
    """``component, size, rank``: 1 is the largest, ties to the smaller component."""
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    from graphloom.graph import numbered

    keyed = sizes.withColumn("__down", -F.col("size"))
    return numbered(keyed, ["__down", "component"], "__n").select("component", "size", (F.col("__n") + 1).alias("rank"))


def extract_components(graph: Graph, mode: str = "weak", min_size: int = 1) -> DataFrame:
    """``rank, component, id``: the nodes of the components of at least ``min_size``, the largest first."""
    components = connected_components(graph, mode)
    sizes = component_sizes(components).where(F.col("size") >= min_size)
    return components.join(sizes, "component").select("rank", "component", "size", "id")


def component_graph(graph: Graph, members: DataFrame) -> Graph:
    """The induced subgraph of one component's nodes."""
    nodes = graph.nodes.join(members.select("id"), "id", "left_semi")
    return replace(graph, nodes=nodes, edges=edges_among(graph, nodes))


def largest_component(graph: Graph, mode: str = "weak") -> Graph:
    return component_graph(graph, extract_components(graph, mode).where("rank = 1"))


def label_major_components(graph: Graph, mode: str = "weak", max_components: int | None = None, min_size: int = 1, other_label: int = 0) -> DataFrame:
    """``id, label``: the rank of the node's component if it is among the largest, else ``other_label``."""
    major = extract_components(graph, mode, min_size)
    if max_components is not None:
        major = major.where(F.col("rank") <= max_components)
    return _for_all(graph, major.select("id", F.col("rank").alias("label")), "label", other_label)


# -- cores -------------------------------------------------------------------------------------


def _coreness_rounds(graph: Graph, direction: str, local_links: int = LOCAL_LINKS) -> Iterator[tuple[str, float, DataFrame]]:
    """Fixed point of the h-index over neighbours, from the degree down; neighbours count by multiplicity.

    Nodes are dealt into ranges of about ``local_links`` links, and every round
    settles each range as far as its own values go, so only what crosses
    ranges needs further rounds.
    """
    scratch = Scratch(graph.spark, "cores")
    links = scratch.save(graph.adjacency(direction).groupBy("node", "nbr").agg(F.count("*").alias("m")), "links")
    ranges = max(1, -(-links.count() // local_links))
    ranged = links.groupBy("node").agg(F.sum("m").alias("c"), F.count("*").alias("n"))
    before = running_sum(ranged, ["node"], F.col("n"), "before")
    state = scratch.save(before.select(F.col("node").alias("id"), F.floor(F.col("before") / local_links).cast("int").alias("range"), F.col("c").alias("coreness")), "state")
    dealt = scratch.save(links.join(state.select(F.col("id").alias("node"), "range"), "node"), "dealt")
    everyone = lambda values: _for_all(graph, values.select("id", "coreness"), "coreness", 0)
    n = 0
    while True:
        n += 1
        near = dealt.join(state.select(F.col("id").alias("nbr"), F.col("coreness").alias("c")), "nbr", "left").select("range", "node", "nbr", "m", F.coalesce("c", F.lit(0)).alias("c"))
        own = state.select("range", F.col("id").alias("node"), F.lit(None).cast("long").alias("nbr"), F.lit(0).cast("long").alias("m"), F.col("coreness").alias("c"))
        found = near.unionByName(own).groupBy("range").applyInArrow(settled_cores, "id long, coreness long, moved boolean")
        step = scratch.save(found.join(state.select("id", "range"), "id"), "state")
        state = step.select("id", "range", "coreness")
        if ranges == 1 or not step.where("moved").limit(1).count():
            yield "peel", 0.99, everyone(state)
            return
        yield "peel", 1 - 1 / (n + 1), everyone(state)


def coreness(graph: Graph, direction: str = "both", local_links: int = LOCAL_LINKS) -> DataFrame:
    """``id, coreness``: the largest k so that the node is in a subgraph whose degrees are all at least k."""
    return Session(_coreness_rounds(graph, direction, local_links)).run()


def coreness_session(graph: Graph, direction: str = "both") -> Session:
    """``coreness`` round by round."""
    return Session(_coreness_rounds(graph, direction))


# -- centralities ------------------------------------------------------------------------------


def _eigenvector_rounds(graph: Graph, weight: str | None, direction: str, max_iterations: int, tolerance: float, initial: DataFrame | None) -> Iterator[tuple[str, float, DataFrame]]:
    scratch = Scratch(graph.spark, "eigenvector")
    links = scratch.save(weighted_adjacency(graph, weight, direction).groupBy("node", "nbr").agg(F.sum("w").alias("w")), "links")
    n = graph.nodes.count()
    start = initial.select("id", F.col("value").cast("double").alias("x")) if initial is not None else graph.nodes.select("id", F.lit(1 / max(n, 1) ** 0.5).alias("x"))
    if initial is not None:
        start = start.crossJoin(F.broadcast(start.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("l")))).select("id", (F.col("x") / F.col("l")).alias("x"))
    state = scratch.save(start.withColumns({"iterations": F.lit(0), "delta": F.lit(0.0), "eigenvalue": F.lit(0.0), "converged": F.lit(False)}), "x")
    for i in range(1, max_iterations + 1):
        around = links.join(state.select(F.col("id").alias("nbr"), F.col("x").alias("xn")), "nbr").groupBy(F.col("node").alias("id")).agg(F.sum(F.col("w") * F.col("xn")).alias("a"))
        y = state.select("id", "x").join(around, "id", "left").select("id", "x", F.coalesce("a", F.lit(0.0)).alias("a"), (F.coalesce("a", F.lit(0.0)) + F.col("x")).alias("y"))
        norm = F.broadcast(y.agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("l"), F.sum(F.col("x") * F.col("a")).alias("value")))
        z = scratch.save(y.crossJoin(norm).select("id", F.when(F.col("l") > 0, F.col("y") / F.col("l")).otherwise(0.0).alias("x"), F.col("x").alias("was"), "value"), "x")
        delta, value = z.agg(F.max(F.abs(F.col("x") - F.col("was"))), F.max("value")).first()
        done = delta is None or delta <= tolerance
        state = z.select("id", "x", F.lit(i).alias("iterations"), F.lit(float(delta or 0.0)).alias("delta"), F.lit(float(value or 0.0)).alias("eigenvalue"), F.lit(done).alias("converged"))
        yield "iterate", i / max_iterations, state
        if done:
            return


def eigenvector_centrality(graph: Graph, weight: str | None = None, direction: str = "both", max_iterations: int = 100, tolerance: float = 1e-6, initial: DataFrame | None = None) -> DataFrame:
    """``id, x, iterations, delta, eigenvalue, converged`` by power iteration on the adjacency plus the identity.

    The vector has length 1; the eigenvalue is of the adjacency, without the
    shift, at the vector before the last step.
    """
    return Session(_eigenvector_rounds(graph, weight, direction, max_iterations, tolerance, initial)).run()


TIE = 1e-12  #: path lengths that differ by no more are equal; also the least weight


def _relaxed_dependencies(links: DataFrame, start: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, b`` by relaxing the distances of all (source, node) pairs."""
    best = scratch.save(start.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(0.0).alias("d"), F.lit(True).alias("fresh")), "distances")
    shortest = links.groupBy("node", "nbr").agg(F.min("w").alias("w"))
    while best.where("fresh").limit(1).count():
        offer = best.where("fresh").join(shortest, F.col("v") == F.col("node")).select("s", F.col("nbr").alias("v"), (F.col("d") + F.col("w")).alias("d"))
        offer = offer.groupBy("s", "v").agg(F.min("d").alias("o"))
        both = best.select("s", "v", "d").join(offer, ["s", "v"], "full")
        better = F.col("o").isNotNull() & (F.col("d").isNull() | (F.col("o") < F.col("d") - TIE))
        best = scratch.save(both.select("s", "v", F.when(better, F.col("o")).otherwise(F.col("d")).alias("d"), better.alias("fresh")), "distances")
    here, there = best.select("s", F.col("v").alias("node"), F.col("d").alias("d0")), best.select("s", F.col("v").alias("nbr"), F.col("d").alias("d1"))
    dag = here.join(links, "node").join(there, ["s", "nbr"]).where(F.abs(F.col("d0") + F.col("w") - F.col("d1")) <= TIE)
    dag = scratch.save(dag.groupBy("s", "node", "nbr").agg(F.sum("m").alias("m")), "dag")

    def summed(first: DataFrame, of: str, to: str) -> DataFrame:
        """Sums over all walks along the acyclic edges, one hop a round."""
        parts, wave = [first], first
        while True:
            step = wave.withColumnRenamed("v", of).join(dag, ["s", of]).groupBy("s", F.col(to).alias("v")).agg(F.sum(F.col("x") * F.col("m")).alias("x"))
            wave = scratch.save(step, "wave")
            if not wave.limit(1).count():
                break
            parts.append(wave)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return scratch.save(out.groupBy("s", "v").agg(F.sum("x").alias("x")), "sums")

    paths = summed(best.where("s = v").select("s", "v", F.lit(1.0).alias("x")), "node", "nbr")
    back = summed(paths.select("s", "v", (1 / F.col("x")).alias("x")), "nbr", "node")
    depend = paths.withColumnRenamed("x", "sigma").join(back, ["s", "v"]).where("s <> v").groupBy(F.col("v").alias("id")).agg(F.sum(F.col("sigma") * F.col("x") - 1).alias("b"))
    return depend


def betweenness_centrality(graph: Graph, weight: str | None = None, sources: Iterable[int] | DataFrame | None = None, normalize: bool = True, prior: DataFrame | None = None, local_links: int = LOCAL_LINKS) -> DataFrame:
    """``id, betweenness`` from shortest paths along out-edges, from all nodes or the given sources.

    Up to ``local_links`` links, counted before, are sent to every task and the
    sources are dealt out, each worked off by one search; sums of nodes are all
    that is shuffled.  Beyond, distances of all (source, node) pairs are relaxed until they are final;
    the edges of shortest paths form an acyclic graph for each source, along
    which numbers of paths are summed forward, hop by hop, and dependencies
    backward.  ``prior(id, value)`` is added after scaling.
    """
    scratch = Scratch(graph.spark, "betweenness")
    adjacency = weighted_adjacency(graph, weight, "out").where("node <> nbr")
    safe = F.when((F.col("w") > 0) & (F.col("w") < float("inf")) & ~F.isnan("w"), F.col("w")).otherwise(TIE)
    links = scratch.save(adjacency.groupBy("node", "nbr", safe.alias("w")).agg(F.count("*").cast("double").alias("m")), "links")
    start = graph.nodes.select("id") if sources is None else graph.ids_frame(sources).join(graph.nodes.select("id"), "id", "left_semi")
    if links.count() <= local_links:
        arrays = links.orderBy("node", "nbr", "w").toArrow()
        held = [arrays.column(c).to_numpy() for c in ("node", "nbr", "w", "m")]
        tasks = max(1, min(start.count(), 4 * graph.spark.sparkContext.defaultParallelism))
        search = partial(path_dependencies, node=held[0], nbr=held[1], w=held[2], m=held[3], tie=TIE)
        depend = start.select("id").repartition(tasks).mapInArrow(search, "id long, b double").groupBy("id").agg(F.sum("b").alias("b"))
    else:
        depend = _relaxed_dependencies(links, start, scratch)
    n = graph.nodes.count()
    scale = 1.0 if graph.directed else 0.5
    if normalize and n > 2:
        scale *= (1.0 if graph.directed else 2.0) / ((n - 1) * (n - 2))
    out = _for_all(graph, depend.select("id", (F.col("b") * scale).alias("betweenness")), "betweenness", 0.0)
    if prior is None:
        return out
    return out.join(prior, "id", "left").select("id", (F.col("betweenness") + F.coalesce("value", F.lit(0.0))).alias("betweenness"))


# -- dimension ---------------------------------------------------------------------------------

#: Finite-difference coefficients of the first derivative by order: forward (offsets 0..n; backward mirrors them) and central (offsets 1..n/2, antisymmetric).
FORWARD = {1: (-1.0, 1.0), 2: (-3 / 2, 2.0, -1 / 2), 3: (-11 / 6, 3.0, -3 / 2, 1 / 3), 4: (-25 / 12, 4.0, -3.0, 4 / 3, -1 / 4), 5: (-137 / 60, 5.0, -5.0, 10 / 3, -5 / 4, 1 / 5), 6: (-49 / 20, 6.0, -15 / 2, 20 / 3, -15 / 4, 6 / 5, -1 / 6)}
CENTRAL = {1: (1 / 2,), 2: (2 / 3, -1 / 12), 3: (3 / 4, -3 / 20, 1 / 60), 4: (4 / 5, -1 / 5, 4 / 105, -1 / 280)}


def ball_volumes(graph: Graph, max_level: int, sources: Iterable[int] | DataFrame | None = None) -> DataFrame:
    """``source, r, volume``: nodes within r out-hops of the source, itself included, for r = 0..max_level."""
    return _volumes(pair_distances(graph, sources, max_level), max_level)


def _volumes(distances: DataFrame, max_level: int) -> DataFrame:
    found = distances.groupBy("source", F.col("level").alias("r")).agg(F.count("*").alias("n"))
    grid = found.select("source").distinct().select("source", F.explode(F.sequence(F.lit(0), F.lit(max_level))).alias("r"))
    upto = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("source").orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    return grid.join(found, ["source", "r"], "left").select("source", "r", upto.alias("volume"))


def _dimension(volumes: DataFrame, key: list[str], max_level: int, method: str, order: int) -> DataFrame:
    """``dimension`` at each radius from ``volume`` by a finite difference of the volume, or a slope of logarithms."""
    w = Window.partitionBy(*key).orderBy("r")
    at = lambda k: F.lead("volume", k).over(w) if k > 0 else F.lag("volume", -k).over(w) if k < 0 else F.col("volume")
    if method == "leastsquares":
        near = w.rowsBetween(-order, order)
        x, y = F.when(F.col("r") > 0, F.ln(F.col("r").cast("double"))), F.ln(F.col("volume").cast("double"))
        slope = F.regr_slope(F.when(F.col("r") > 0, y), x).over(near)
        value = F.when(F.col("r") > order, F.coalesce(slope, F.lit(0.0))).otherwise(0.0)
    else:
        if method == "central":
            terms = [(s * k, s * c) for k, c in enumerate(CENTRAL[order], 1) for s in (1, -1)]
        else:
            side = 1 if method == "forward" else -1
            terms = [(side * k, side * c) for k, c in enumerate(FORWARD[order])]
        # a term at a radius of 0 or less, or beyond what was measured, is left out
        parts = [F.when((F.col("r") + k) > 0, F.coalesce(at(k).cast("double"), F.lit(0.0)) * c).otherwise(0.0) for k, c in terms]
        slope = parts[0]
        for p in parts[1:]:
            slope = slope + p
        value = F.when(F.col("r") > 0, slope * F.col("r") / F.col("volume")).otherwise(0.0)
    return volumes.withColumn("dimension", value).where(F.col("r") <= max_level)


def _checked(method: str, order: int) -> tuple[str, int]:
    name = {"fw": "forward", "bk": "backward", "ce": "central", "ls": "leastsquares"}.get(method, method)
    most = {"forward": 6, "backward": 6, "central": 4, "leastsquares": 1 << 30}
    if name not in most or not 1 <= order <= most[name]:
        raise GraphError(f"no {method} of order {order}")
    return name, 0 if name == "backward" else order


def node_dimension(graph: Graph, sources: Iterable[int] | DataFrame | None = None, max_level: int = 8, method: str = "leastsquares", order: int = 2) -> DataFrame:
    """``source, r, volume, dimension``: how the volume of balls around each source grows."""
    name, padding = _checked(method, order)
    return _dimension(ball_volumes(graph, max_level + padding, sources), ["source"], max_level, name, order)


def global_dimension(graph: Graph, sources: Iterable[int] | DataFrame | None = None, max_level: int = 8, method: str = "leastsquares", order: int = 2) -> DataFrame:
    """``r, volume, dimension, node_dimension, deviation``: of the mean volume, and mean and deviation of the nodes' dimensions."""
    name, padding = _checked(method, order)
    volumes = Scratch(graph.spark, "dimension").save(ball_volumes(graph, max_level + padding, sources), "volumes")
    local = _dimension(volumes, ["source"], max_level, name, order).groupBy("r").agg(F.avg("dimension").alias("node_dimension"), F.stddev_pop("dimension").alias("deviation"), F.max("dimension").alias("max_dimension"))
    mean = volumes.groupBy("r").agg(F.avg("volume").alias("volume")).withColumn("one", F.lit(1))
    return _dimension(mean, ["one"], max_level, name, order).drop("one").join(local, "r")


def _dimension_rounds(graph: Graph, sources: Iterable[int] | DataFrame | None, max_level: int, method: str, order: int) -> Iterator[tuple[str, float, DataFrame]]:
    name, padding = _checked(method, order)
    scratch, top = Scratch(graph.spark, "dimension"), max_level + padding
    seen = None
    for level, seen in enumerate(pair_levels(graph, sources, top, scratch=scratch)):
        yield "levels", (level + 1) / (top + 2), seen
    yield "fit", 0.99, _dimension(_volumes(seen, top), ["source"], max_level, name, order)


def dimension_session(graph: Graph, sources: Iterable[int] | DataFrame | None = None, max_level: int = 8, method: str = "leastsquares", order: int = 2) -> Session:
    """``node_dimension`` level by level."""
    return Session(_dimension_rounds(graph, sources, max_level, method, order))


def dimension_profiles(dimensions: DataFrame, encoding: str = "vector", digits: int = 6) -> DataFrame:
    """``id, max_dimension, profile``: each source's dimensions by radius, as a 'vector' or a JSON 'string' rounded to ``digits``."""
    if encoding not in ("vector", "string"):
        raise GraphError(f"unknown encoding {encoding!r}")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("r", "dimension"))), lambda x: x["dimension"])
    rows = dimensions.groupBy(F.col("source").alias("id")).agg(F.max("dimension").alias("max_dimension"), ordered.alias("profile"))
    if encoding == "vector":
        return rows
    return rows.withColumn("profile", F.to_json(F.transform("profile", lambda x: F.round(x, digits))))
