"""Community detection by modularity in the manner of Leiden.

Local moving, refinement and aggregation repeat until nothing improves.  A
graph of up to ``LOCAL_LINKS`` linked pairs is worked off in one task.  A
larger one is first made smaller by distributed rounds: nodes move to the
neighbouring community of the largest gain, half of them (by a hash) at a
time; communities are split into their connected parts; the parts become the
nodes of the next, smaller graph.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph, numbered
from graphloom.operators.components import component_labels
from graphloom.operators.iterative import Session
from graphloom.operators.measures import modularity, weighted_adjacency
from graphloom.scratch import Scratch

LOCAL_LINKS = 2_000_000


class _Partition:
    """Communities of a small graph: links both ways as (neighbour, out weight, in weight) lists."""

    def __init__(self, near: list[list[tuple[int, float, float]]], loops: list[float], out: list[float], into: list[float], total: float, resolution: float):
        self.near, self.loops, self.out, self.into, self.total, self.resolution = near, loops, out, into, total, resolution
        n = len(near)
        self.label = list(range(n))
        self.sum_out, self.sum_in = list(out), list(into)
        self.size = [1] * n
        self.free: list[int] = []

    def assign(self, labels: list[int]) -> None:
        n = len(self.near)
        self.label = list(labels)
        self.sum_out, self.sum_in, self.size = [0.0] * n, [0.0] * n, [0] * n
        for v, c in enumerate(labels):
            self.sum_out[c] += self.out[v]
            self.sum_in[c] += self.into[v]
            self.size[c] += 1
        self.free = [c for c in range(n) if not self.size[c]]

    def gains(self, v: int, within: list[int] | None = None) -> dict[int, float]:
        """Gain of putting v, taken out of its community, into each community near it."""
        links: dict[int, float] = {self.label[v]: 0.0}
        for u, w_out, w_in in self.near[v]:
            if within is None or within[u] == within[v]:
                links[self.label[u]] = links.get(self.label[u], 0.0) + w_out + w_in
        own, scale = self.label[v], self.resolution / self.total
        out = {}
        for c, w in links.items():
            less_out, less_in = (self.out[v], self.into[v]) if c == own else (0.0, 0.0)
            out[c] = w - scale * (self.out[v] * (self.sum_in[c] - less_in) + self.into[v] * (self.sum_out[c] - less_out))
        return out

    def move(self, v: int, c: int) -> None:
        old = self.label[v]
        for which, sign in ((old, -1), (c, 1)):
            self.sum_out[which] += sign * self.out[v]
            self.sum_in[which] += sign * self.into[v]
            self.size[which] += sign
        if not self.size[old]:
            self.free.append(old)
        self.label[v] = c

    def improve(self, rng: np.random.Generator, passes: int) -> bool:
        """Moves nodes while it pays; nodes beside a moved one are looked at again."""
        n = len(self.near)
        queue, waiting = deque(rng.permutation(n).tolist()), [True] * n
        changed, budget = False, passes * max(n, 1)
        while queue and budget:
            budget -= 1
            v = queue.popleft()
            waiting[v] = False
            gains = self.gains(v)
            if self.size[self.label[v]] > 1 and self.free:
                while self.free and self.size[self.free[-1]]:
                    self.free.pop()
                if self.free:
                    gains.setdefault(self.free[-1], 0.0)
            best = max(gains.values())
            if best > gains[self.label[v]] + 1e-12:
                ties = [c for c, g in gains.items() if g >= best - 1e-12]
                c = ties[0] if len(ties) == 1 else ties[int(rng.integers(len(ties)))]
                self.move(v, c)
                changed = True
                for u, _, _ in self.near[v]:
                    if self.label[u] != c and not waiting[u]:
                        waiting[u] = True
                        queue.append(u)
        return changed

    def refined(self, rng: np.random.Generator) -> list[int]:
        """A partition within the communities: nodes still alone join a neighbouring part of theirs if that pays."""
        coarse = self.label
        fine = _Partition(self.near, self.loops, self.out, self.into, self.total, self.resolution)
        for v in rng.permutation(len(self.near)).tolist():
            if fine.size[fine.label[v]] == 1:
                gains = fine.gains(v, coarse)
                best = max(gains, key=lambda c: (gains[c], -c))
                if gains[best] > 1e-12 and best != fine.label[v]:
                    fine.move(v, best)
        return fine.label


def _aggregate(p: _Partition, parts: list[int]) -> tuple[_Partition, list[int]]:
    """The parts as nodes, and each node's part."""
    number = {c: i for i, c in enumerate(dict.fromkeys(parts))}
    of = [number[c] for c in parts]
    n = len(number)
    loops, out, into = [0.0] * n, [0.0] * n, [0.0] * n
    links: list[dict[int, list[float]]] = [{} for _ in range(n)]
    for v, c in enumerate(of):
        loops[c] += p.loops[v]
        out[c] += p.out[v]
        into[c] += p.into[v]
        for u, w_out, w_in in p.near[v]:
            if of[u] == c:
                loops[c] += w_out
            else:
                w = links[c].setdefault(of[u], [0.0, 0.0])
                w[0] += w_out
                w[1] += w_in
    near = [[(u, w[0], w[1]) for u, w in d.items()] for d in links]
    return _Partition(near, loops, out, into, p.total, p.resolution), of


def leiden_labels(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, resolution: float, seed: int, max_levels: int, max_passes: int) -> list[int]:
    """Communities of nodes 0..n-1 from the adjacency's entries (both ways if undirected), numbered by first appearance."""
    both: list[dict[int, list[float]]] = [{} for _ in range(n)]
    loops, out, into = [0.0] * n, [0.0] * n, [0.0] * n
    for a, b, x in zip(src.tolist(), dst.tolist(), w.tolist(), strict=True):
        out[a] += x
        into[b] += x
        if a == b:
            loops[a] += x
        else:
            both[a].setdefault(b, [0.0, 0.0])[0] += x
            both[b].setdefault(a, [0.0, 0.0])[1] += x
    total = float(w.sum())
    if total <= 0:
        return list(range(n))
    rng = np.random.default_rng(seed)
    p = _Partition([[(u, x[0], x[1]) for u, x in d.items()] for d in both], loops, out, into, total, resolution)
    at = list(range(n))  # each node's node at the current level
    labels = list(range(n))
    for _ in range(max_levels):
        changed = p.improve(rng, max_passes)
        labels = [p.label[x] for x in at]
        if not changed and len(set(p.label)) == len(p.near):
            break
        parts = p.refined(rng)
        coarse = p.label
        smaller, of = _aggregate(p, parts)
        if len(smaller.near) == len(p.near):
            break
        first: dict[int, int] = {}
        start = [0] * len(smaller.near)
        for v, c in enumerate(of):
            start[c] = first.setdefault(coarse[v], c)
        smaller.assign(start)
        at = [of[x] for x in at]
        p = smaller
    number: dict[int, int] = {}
    return [number.setdefault(c, len(number)) for c in labels]


def _one_task(links: DataFrame, nodes: DataFrame, resolution: float, seed: int, max_levels: int, max_passes: int) -> DataFrame:
    rows = links.select("node", "nbr", "w").unionByName(nodes.select(F.col("id").alias("node"), F.lit(None).cast("long").alias("nbr"), F.lit(None).cast("double").alias("w")))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(batches)
        if not got:
            return
        table = pd.concat(got)
        ids = np.sort(table.loc[table.nbr.isna(), "node"].to_numpy(np.int64))
        real = table[table.nbr.notna()].sort_values(["node", "nbr"])
        labels = leiden_labels(len(ids), np.searchsorted(ids, real.node.to_numpy(np.int64)), np.searchsorted(ids, real.nbr.to_numpy(np.int64)), real.w.to_numpy(float), resolution, seed, max_levels, max_passes)
        yield pd.DataFrame({"id": ids, "label": labels})

    return rows.coalesce(1).mapInPandas(solve, "id long, label long")


def _shrunk(links: DataFrame, scratch: Scratch, resolution: float, seed: int, rounds: int = 6) -> tuple[DataFrame, DataFrame]:
    """``(v, part)`` and the links between parts after distributed local moving."""
    total = links.agg(F.sum("w")).first()[0]
    ends = links.groupBy(F.col("node").alias("v")).agg(F.sum("w").alias("out")).join(links.groupBy(F.col("nbr").alias("v")).agg(F.sum("w").alias("into")), "v", "full").na.fill(0.0)
    state = scratch.save(ends.withColumn("label", F.col("v")), "moving")
    either = links.unionByName(links.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "w")).where("node <> nbr")
    for r in range(rounds):
        sums = state.groupBy("label").agg(F.sum("out").alias("so"), F.sum("into").alias("si"))
        beside = either.join(state.select(F.col("v").alias("nbr"), "label"), "nbr").groupBy(F.col("node").alias("v"), "label").agg(F.sum("w").alias("w"))
        offers = beside.join(state.select("v", "out", "into", F.col("label").alias("own")), "v").join(sums, "label")
        mine = F.col("label") == F.col("own")
        so, si = F.col("so") - F.when(mine, F.col("out")).otherwise(0.0), F.col("si") - F.when(mine, F.col("into")).otherwise(0.0)
        gain = F.col("w") - resolution / total * (F.col("out") * si + F.col("into") * so)
        best = offers.withColumn("gain", gain).groupBy("v").agg(F.max(F.struct("gain", -F.col("label"))).alias("b"), F.max(F.when(mine, F.col("gain"))).alias("stay"))
        turn = F.pmod(F.xxhash64("v", F.lit(seed + r)), F.lit(2)) == 0
        moves = best.where(turn & (F.col("b.gain") > F.coalesce("stay", F.lit(0.0)) + 1e-12)).select("v", (-F.col("b.col2")).alias("to"))
        state = scratch.save(state.join(moves, "v", "left").select("v", "out", "into", F.coalesce("to", "label").alias("label")), "moving")
    of = state.select("v", "label")
    inner = links.join(of.select(F.col("v").alias("node"), F.col("label").alias("a")), "node").join(of.select(F.col("v").alias("nbr"), F.col("label").alias("b")), "nbr").where("a = b")
    parts = component_labels(inner, "node", "nbr", scratch)
    parts = scratch.save(of.join(parts, "v", "left").select("v", F.coalesce("comp", "v").alias("part")), "parts")
    smaller = links.join(parts.select(F.col("v").alias("node"), F.col("part").alias("a")), "node").join(parts.select(F.col("v").alias("nbr"), F.col("part").alias("b")), "nbr")
    return parts, scratch.save(smaller.groupBy(F.col("a").alias("node"), F.col("b").alias("nbr")).agg(F.sum("w").alias("w")), "smaller")


def _leiden_rounds(graph: Graph, weight: str | None, resolution: float, seed: int, max_levels: int, max_passes: int, local_links: int) -> Iterator[tuple[str, float, DataFrame]]:
    scratch = Scratch(graph.spark, "leiden")
    links = scratch.save(weighted_adjacency(graph, weight, "out").groupBy("node", "nbr").agg(F.sum("w").alias("w")), "links")
    nodes, maps = graph.nodes.select("id"), []
    first = size = max(links.count(), 1)
    stalled = False
    while size > local_links and not stalled:
        parts, links = _shrunk(links, scratch, resolution, seed + len(maps))
        maps.append(parts)
        nodes = nodes.join(parts, nodes["id"] == parts["v"], "left").select(F.coalesce("part", "id").alias("id")).distinct()
        before, size = size, links.count()
        stalled = size > 0.95 * before  # nothing moves any more: the parts are the communities
        yield "contract", 0.9 * (1 - size / first), nodes
    if size > local_links:
        labels = nodes.select("id", F.col("id").alias("label"))
    else:
        labels = _one_task(links, nodes, resolution, seed, max_levels, max_passes)
    labels = scratch.save(labels, "labels")
    yield "local", 0.95, labels
    found = graph.nodes.select("id", F.col("id").alias("at"))
    for parts in maps:
        found = found.join(parts.withColumnRenamed("v", "at"), "at", "left").select("id", F.coalesce("part", "at").alias("at"))
    found = found.join(labels.withColumnRenamed("id", "at"), "at").select("id", "label")
    smallest = found.groupBy("label").agg(F.min("id").alias("first"))
    ranked = numbered(smallest, ["first"], "community")
    yield "number", 0.99, found.join(ranked.select("label", "community"), "label").select("id", "community")


def leiden_session(graph: Graph, weight: str | None = None, resolution: float = 1.0, seed: int = 0, max_levels: int = 32, max_passes: int = 8, local_links: int = LOCAL_LINKS) -> Session:
    """``leiden`` phase by phase."""
    return Session(_leiden_rounds(graph, weight, resolution, seed, max_levels, max_passes, local_links))


def leiden(graph: Graph, weight: str | None = None, resolution: float = 1.0, seed: int = 0, max_levels: int = 32, max_passes: int = 8, local_links: int = LOCAL_LINKS) -> DataFrame:
    """``id, community``: numbered from 0 in the order of their smallest node.

    Up to ``local_links`` linked pairs Leiden runs in one task; larger graphs
    are first contracted in distributed rounds.  If these stall above that
    size, their parts are the communities.
    """
    return leiden_session(graph, weight, resolution, seed, max_levels, max_passes, local_links).run()


def leiden_modularity(graph: Graph, weight: str | None = None, resolution: float = 1.0, **settings) -> tuple[DataFrame, float]:
    """The communities and their modularity."""
    labels = Scratch(graph.spark, "leiden").save(leiden(graph, weight, resolution, **settings), "communities")
    return labels, float(modularity(graph, labels.withColumnRenamed("community", "label"), weight, resolution).first()[0])
