"""Exact graph algorithms on the part of a graph that one task holds.

The distributed operators hand these a bounded number of links: a range of
nodes at a time, or a remainder whose size was counted before.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOCAL_LINKS = 1_000_000  #: links that one task takes at most where a caller counts them


def settled_cores(rows: pa.Table) -> pa.Table:
    """Lower the values of a range of nodes to the h-index of their neighbours' until none changes.

    Rows are ``node, nbr, m, c``: the neighbour's value by multiplicity, or the
    node's own with a null neighbour.  Values of other ranges stay as given;
    as these only fall, the result is an upper bound of the cores again.
    """
    own: dict[int, int] = {}
    links: dict[int, list[tuple[int, int]]] = defaultdict(list)
    value: dict[int, int] = {}
    for node, nbr, m, c in zip(*(rows.column(x).to_pylist() for x in ("node", "nbr", "m", "c")), strict=True):
        if nbr is None:
            own[node] = value[node] = c
        else:
            links[node].append((nbr, m))
            value.setdefault(nbr, c)
    todo, waiting = deque(own), set(own)
    backward: dict[int, list[int]] = defaultdict(list)
    for node, near in links.items():
        for nbr, _ in near:
            if nbr in own:
                backward[nbr].append(node)
    while todo:
        node = todo.popleft()
        waiting.discard(node)
        top = value[node]
        counts = [0] * (top + 1)
        for nbr, m in links.get(node, ()):
            counts[min(value[nbr], top)] += m
        above, h = 0, 0
        for k in range(top, 0, -1):
            above += counts[k]
            if above >= k:
                h = k
                break
        if h < top:
            value[node] = h
            for other in backward.get(node, ()):
                if value[other] > h and other not in waiting:
                    waiting.add(other)
                    todo.append(other)
    ids = list(own)
    return pa.table({"id": pa.array(ids, pa.int64()), "coreness": pa.array([value[i] for i in ids], pa.int64()), "moved": pa.array([value[i] != own[i] for i in ids], pa.bool_())})


def strong_labels(rows: pa.Table) -> pa.Table:
    """``id, least``: the smallest node of each strong component, by Tarjan's search without recursion, from ``src, dst``."""
    out: dict[int, list[int]] = defaultdict(list)
    for a, b in zip(rows.column("src").to_pylist(), rows.column("dst").to_pylist(), strict=True):
        out[a].append(b)
        out.setdefault(b, [])
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    held: set[int] = set()
    stack: list[int] = []
    ids, least = [], []
    for root in out:
        if root in index:
            continue
        index[root] = low[root] = len(index)
        stack.append(root)
        held.add(root)
        path = [(root, iter(out[root]))]
        while path:
            node, rest = path[-1]
            for other in rest:
                if other not in index:
                    index[other] = low[other] = len(index)
                    stack.append(other)
                    held.add(other)
                    path.append((other, iter(out[other])))
                    break
                if other in held:
                    low[node] = min(low[node], index[other])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while not members or members[-1] != node:
                        members.append(stack.pop())
                    held.difference_update(members)
                    ids += members
                    least += [min(members)] * len(members)
    return pa.table({"id": pa.array(ids, pa.int64()), "least": pa.array(least, pa.int64())})


def path_dependencies(batches: Iterator[pa.RecordBatch], node: np.ndarray, nbr: np.ndarray, w: np.ndarray, m: np.ndarray, tie: float) -> Iterator[pa.RecordBatch]:
    """``id, b``: what the shortest paths from the batches' sources add to each node between their ends.

    Links are sorted by node; lengths that differ by ``tie`` or less are equal.
    """
    ids = np.unique(np.concatenate([node, nbr]))
    place = {int(v): i for i, v in enumerate(ids)}
    starts = np.searchsorted(node, ids).tolist() + [len(node)]
    to, length, times = np.searchsorted(ids, nbr).tolist(), w.tolist(), m.tolist()
    sums = np.zeros(len(ids))
    even = len(length) > 0 and min(length) == max(length)
    for batch in batches:
        for source in batch.column(0).to_pylist():
            if source not in place:
                continue
            s = place[source]
            far = {s: 0.0}
            order: list[int] = []
            if even:  # breadth first
                step, queue = length[0], deque([s])
                while queue:
                    v = queue.popleft()
                    order.append(v)
                    for e in range(starts[v], starts[v + 1]):
                        if to[e] not in far:
                            far[to[e]] = far[v] + step
                            queue.append(to[e])
            else:
                heap, done = [(0.0, s)], set()
                while heap:
                    d, v = heapq.heappop(heap)
                    if v in done:
                        continue
                    done.add(v)
                    order.append(v)
                    for e in range(starts[v], starts[v + 1]):
                        x, new = to[e], d + length[e]
                        if x not in done and (x not in far or new < far[x] - tie):
                            far[x] = new
                            heapq.heappush(heap, (new, x))
            paths: dict[int, float] = defaultdict(float)
            paths[s] = 1.0
            before: dict[int, list[tuple[int, float]]] = defaultdict(list)
            for v in order:
                for e in range(starts[v], starts[v + 1]):
                    x = to[e]
                    if x != s and abs(far[v] + length[e] - far[x]) <= tie:
                        paths[x] += paths[v] * times[e]
                        before[x].append((v, times[e]))
            depend: dict[int, float] = defaultdict(float)
            for x in reversed(order):
                for v, t in before.get(x, ()):
                    depend[v] += paths[v] * t / paths[x] * (1 + depend[x])
            for v, d in depend.items():
                if v != s:
                    sums[v] += d
    some = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(sums[some])], ["id", "b"])
