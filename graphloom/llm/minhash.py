"""Near-duplicate detection as a chosen-path set similarity join.

A document is the set of its distinct k-word shingles.  Documents whose sets
have a Jaccard similarity of at least ``threshold`` percent are linked, and
the connected components of the links are the groups of near-duplicates.

1. One pass over the texts gives each document the size of its set, a 128-bit
   fingerprint of it and ``positions`` minwise tokens.  Documents of the same
   fingerprint are one class, and only a class's representative goes on, so
   exact copies cost one row each whatever their number.
2. Chosen paths: in each of ``trees`` independent trees, a node (at first the
   root) selects about ``branch`` of the positions by a hash of its own path,
   and a document descends to one child for each selected position, named by
   its minwise token there.  A pair of similarity J meets in J * branch
   children of a node on average, so with branch * threshold > 1 the pair
   survives with a probability that does not fade with the depth, while unlike
   documents part at once.  Roots are redrawn until they choose a position.
   The 10 of seed 1 choose 27 in all, so at depth 2 a pair at 0.85 is missed
   with probability 7e-13 and one at 0.80 with 3e-11; in nodes of any depth
   the bounds are 1.1e-7 and 4.6e-6.
3. Stars: the members of each node are compared with its first member only;
   this already joins large groups of copies without listing their pairs.
4. Nodes that still hold several components are worked off: small ones
   exhaustively, large ones descend further, and large ones that do not shrink
   (many almost equal documents) compare the rows outside the node's largest
   component with all its rows, in blocks.  Pairs are compared by minwise
   tokens first and then by samples of the sets (whole sets up to ``BAG``
   shingles), so that few are listed that are not links; pairs within one
   component never are.
5. Candidates are confirmed on the full shingle sets (64-bit hashes).

No step caps a group or drops a candidate, and no group of unbounded size
meets in one task: stars are dealt out in cells of ``CELL`` members.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import join_per_key, mix64, quoted, run_starts, sorted_runs, spare, split_by_keys, words_of
from graphloom.operators.components import component_labels
from graphloom.scratch import Scratch

LEAF = 64  #: nodes up to this size are compared exhaustively
BLOCK = 128  #: rows of a dense region that a cell takes from either side
CELL = 256  #: members of a star that one cell confirms
SHRINK = 0.6  #: a node is dense if a child would hold more than this share of it
MARGIN = 0.15  #: candidates' sketches may be this much less similar than the threshold (4.7 deviations at 128 positions)
BAG = 512  #: shingles of a set that its sample holds at most; more than half as many unless the set is smaller
BAG_MARGIN = 0.085  #: the same for samples of sets that have more shingles (3.8 to 5.4 deviations)
#: Three-word shingle mixing constants, odd.
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; the whole sequence as one when shorter, none without words."""
    words = words_of(text) if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    if n < k:
        return np.array([xxhash.xxh64_intdigest(b"\x00".join(words), seed=n)], np.uint64)
    acc = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        acc = mix64(acc ^ (h[j : n - k + 1 + j] * (_C[j % 5] + np.uint64(2 * (j // 5)))))
    return np.unique(acc)


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh128_intdigest(s.tobytes())
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def _multipliers(positions: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.arange(1, positions + 1, dtype=np.uint64)
    return mix64(base * _C[0]) | np.uint64(1), mix64(base * _C[1])


def _minwise(s: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Minimum of each of the hash functions over the set, as its top 16 bits of a remix."""
    low = np.full(len(mul), np.iinfo(np.uint64).max, np.uint64)
    step = max(1, 200_000 // len(mul))
    for i in range(0, len(s), step):
        h = (s[i : i + step, None] * mul[None, :]) + add[None, :]
        np.minimum(low, h.min(axis=0), out=low)
    return (mix64(low) >> np.uint64(48)).astype(np.uint16)


def _bag(s: np.ndarray) -> bytes:
    """A sample of a sorted set: its halvings, how many of it are left after one more, and 16 bits of each member."""
    halvings = 0
    while len(s) > BAG:
        halvings += 1
        s = s[: np.searchsorted(s, np.uint64(1 << (64 - halvings)))]
    fewer = np.searchsorted(s, np.uint64(1 << (63 - halvings)))
    return np.concatenate([np.array([halvings, fewer]), s & np.uint64(0xFFFF)]).astype(np.uint16).tobytes()


def _sketches(batches: Iterator[pa.RecordBatch], k: int, positions: int) -> Iterator[pa.RecordBatch]:
    mul, add = _multipliers(positions)
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            n, hi, lo, sig, bag = [], [], [], [], []
            for text in part.column(1):
                s = shingle_set(text.as_py(), k)
                a, b = _fingerprint(s)
                n.append(len(s))
                hi.append(a)
                lo.append(b)
                sig.append(_minwise(s, mul, add).tobytes() if len(s) else None)
                bag.append(_bag(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sig, pa.binary()), pa.array(bag, pa.binary())], ["doc_id", "text_hash", "n", "hi", "lo", "sig", "bag"])


def _matrix(column: pa.ChunkedArray | pa.Array, dtype: type) -> np.ndarray:
    """Equal-length binaries as the rows of a matrix."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(a):
        return np.zeros((0, 0), dtype)
    off = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1]
    return np.frombuffer(a.buffers()[2], np.uint8)[off[0] : off[-1]].reshape(len(a), -1).view(dtype)


def _descend(v: np.ndarray, sig: np.ndarray, node: np.ndarray, branch: float) -> tuple[np.ndarray, np.ndarray]:
    """Children of each row's node: (row numbers, child nodes)."""
    positions = sig.shape[1]
    limit = np.uint64(int(branch / positions * 2.0**64))
    salt = mix64(np.arange(positions, dtype=np.uint64) * _C[2] + np.uint64(7))
    rows, children = [], []
    for at in range(0, len(node), 2000):
        part = node[at : at + 2000]
        draw = mix64(part[:, None] ^ salt[None, :])
        r, j = np.nonzero(draw < limit)
        rows.append(r + at)
        token = sig[r + at, j].astype(np.uint64)
        children.append(mix64(draw[r, j] ^ (token * _C[3] + np.uint64(1))))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(children)


def _roots(trees: int, positions: int, branch: float, seed: int) -> list[int]:
    """A root for each tree, drawn again until it chooses at least one position."""
    out = []
    for tree in range(trees):
        root = mix64(np.array([seed * 1000 + tree + 1], np.uint64))
        while not len(_descend(root[:0], np.zeros((1, positions), np.uint16), root, branch)[0]):
            root = mix64(root + _C[4])
        out.append(int(root[0]))
    return out


def _first_nodes(batches: Iterator[pa.RecordBatch], trees: int, depth: int, branch: float, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            if not part.num_rows:
                continue
            sig = _matrix(part.column(1), np.uint16)
            v = part.column(0).to_numpy(zero_copy_only=False)
            out_v, out_node = [], []
            for root in _roots(trees, sig.shape[1], branch, seed):
                rows, node = np.arange(len(v)), np.full(len(v), root, np.uint64)
                for _ in range(depth):
                    r, node = _descend(v, sig[rows], node, branch)
                    rows = rows[r]
                out_v.append(v[rows])
                out_node.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_node).view(np.int64)), pa.array(np.concatenate(out_v))], ["node", "v"])


def _next_nodes(batches: Iterator[pa.RecordBatch], branch: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4000):
            part = batch.slice(at, 4000)
            node = part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            v = part.column(1).to_numpy(zero_copy_only=False)
            rows, child = _descend(v, _matrix(part.column(3), np.uint16), node, branch)
            size = part.column(2).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(v[rows]), pa.array(size[rows])], ["node", "v", "parent"])


def _similar(sk: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: int) -> np.ndarray:
    """Which pairs may reach the threshold by size and by sketch."""
    ok = 100 * np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j])
    at = np.flatnonzero(ok)
    least = (threshold / 100 - MARGIN) * sk.shape[1]
    for a in range(0, len(at), 100_000):
        some = at[a : a + 100_000]
        ok[some] = (sk[i[some]] == sk[j[some]]).sum(axis=1) >= least
    return ok


def _placed(sets: list[np.ndarray], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All members of the sets by their place among the values: (places, sets)."""
    at = np.searchsorted(values, np.concatenate(sets))
    order = np.argsort(at, kind="stable")
    return at[order], np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order]


def _ones(placed: tuple[np.ndarray, np.ndarray], rows: int, low: int, width: int) -> np.ndarray:
    """Which sets have which of the values from ``low`` on."""
    a, b = np.searchsorted(placed[0], [low, low + width])
    out = np.zeros((rows, width), np.float32)
    out[placed[1][a:b], placed[0][a:b] - low] = 1
    return out


def _shares(bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity of each pair by its samples, and which pairs' samples are their whole sets."""
    halvings = np.array([b[0] for b in bags])
    held = [np.unique(b[2:]) for b in bags]
    fewer = [np.unique(b[2 : 2 + b[1]]) for b in bags]
    values = np.unique(np.concatenate(held))
    mixed = len(set(halvings.tolist())) > 1
    both, cut = np.zeros((len(bags), len(bags)), np.float32), np.zeros((len(bags), len(bags)), np.float32)
    wholes, parts = _placed(held, values), _placed(fewer, values) if mixed else None
    for low in range(0, len(values), 16_384):  # a matrix of all values at once might be large
        full = _ones(wholes, len(bags), low, 16_384)
        both += full @ full.T
        if parts is not None:
            cut += _ones(parts, len(bags), low, 16_384) @ full.T
    size = np.array([len(h) for h in held], float)
    left, right = np.broadcast_to(size[:, None], both.shape).copy(), np.broadcast_to(size[None, :], both.shape).copy()
    if mixed:
        least = np.array([len(h) for h in fewer], float)
        above = halvings[:, None] < halvings[None, :]
        both = np.where(above, cut, np.where(above.T, cut.T, both))
        left, right = np.where(above, least[:, None], left), np.where(above.T, least[None, :], right)
    return both / np.maximum(left + right - both, 1), (halvings[:, None] == 0) & (halvings[None, :] == 0)


def _worthwhile(i: np.ndarray, j: np.ndarray, comp: np.ndarray, bags: list[np.ndarray], threshold: int, hide: bool) -> list[tuple[int, int, bool]]:
    """Of a leaf's plausible pairs: a forest of those that are links all but surely, and every doubtful one between its trees.

    Without ``hide`` all plausible pairs.  The flag marks pairs that hide others.
    """
    rows, back = np.unique(np.concatenate([i, j]), return_inverse=True)
    x, y = back[: len(i)], back[len(i) :]
    share, whole = _shares([bags[r] for r in rows])
    s, w = share[x, y], whole[x, y]
    least = threshold / 100 - np.where(w, 0.01, BAG_MARGIN)
    sure = s >= threshold / 100 + np.where(w, 0.02, BAG_MARGIN)
    tree: dict[int, int] = {}

    def root(c: int) -> int:
        while c in tree:
            c = tree[c]
        return c

    out = []
    for p in np.flatnonzero(s >= least)[np.argsort(-(s[s >= least] + sure[s >= least]), kind="stable")]:
        a, b = root(int(comp[i[p]])), root(int(comp[j[p]]))
        if a != b:
            out.append((i[p], j[p], hide and sure[p]))
            if hide and sure[p]:
                tree[max(a, b)] = min(a, b)
    return out


def _plausible_rows(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Rows of small nodes that are in a plausible pair of different components; rows come sorted by (node, block).

    ``at`` is the row's place in its leaf, ``width`` the leaf's size and
    ``bits`` has one for the place of each row it is paired with further on.
    """
    for t in sorted_runs(batches, ["node", "block"]):
        node, block, v, comp, n = (t.column(c).to_numpy() for c in ("node", "block", "v", "comp", "n"))
        minor = t.column("minor").to_numpy()
        sk = _matrix(t.column("sk"), np.uint8)
        starts = run_starts([node, block])
        sizes = np.diff(np.append(starts, len(node)))
        for size in np.unique(sizes):
            if size < 2:
                continue
            ii, jj = np.triu_indices(size, 1)
            groups = starts[sizes == size]
            step = max(1, 2_000_000 // len(ii))
            for g in range(0, len(groups), step):
                begin = groups[g : g + step]
                i = (begin[:, None] + ii).ravel()
                j = (begin[:, None] + jj).ravel()
                apart = (comp[i] != comp[j]) & (minor[i] | minor[j])
                i, j = i[apart], j[apart]
                ok = _similar(sk, n, i, j, threshold)
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                rows, back = np.unique(np.concatenate([i, j]), return_inverse=True)
                at = rows - begin[np.searchsorted(begin, rows, "right") - 1]
                paired = np.zeros((len(rows), size), bool)
                paired[back[: len(i)], at[back[len(i) :]]] = True
                bits = [x.tobytes() for x in np.packbits(paired, axis=1)]
                columns = [pa.array(x) for x in (node[rows], block[rows], v[rows], comp[rows], at, np.full(len(rows), size))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(bits, pa.binary())], ["node", "block", "v", "comp", "at", "width", "bits"])


def _leaf_pairs(batches: Iterator[pa.RecordBatch], threshold: int, hide: bool) -> Iterator[pa.RecordBatch]:
    """Pairs to confirm of the rows that ``_plausible_rows`` gave; they come sorted by (node, block, at)."""
    for t in sorted_runs(batches, ["node", "block"]):
        node, block, v, comp, at, width = (t.column(c).to_numpy() for c in ("node", "block", "v", "comp", "at", "width"))
        bags = [np.frombuffer(x.as_buffer(), np.uint16) for x in t.column("bag")]
        bits = [np.frombuffer(x.as_buffer(), np.uint8) for x in t.column("bits")]
        starts = run_starts([node, block])
        out: list[tuple[int, int, bool]] = []
        for a, b in zip(starts, np.append(starts[1:], len(node)), strict=True):
            i, place = np.nonzero(np.unpackbits(np.stack(bits[a:b]), axis=1, count=int(width[a])))
            j = np.searchsorted(at[a:b], place)
            out += _worthwhile(a + i, a + j, comp, bags, threshold, hide)
        if out:
            i, j = np.array([p[:2] for p in out], np.int64).T
            columns = [node[i], block[i], np.maximum(v[i], v[j]), np.minimum(v[i], v[j]), np.array([p[2] for p in out], bool)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "block", "a", "b", "sure"])


def _cell_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Shingle sets for the cells they are wanted in; equal texts in a row are shingled once."""
    last, s, fp = None, np.zeros(0, np.uint64), (0, 0)
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            keep, sets = [], []
            for r, (text, hi, lo) in enumerate(zip(part.column(0), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                text = text.as_py()
                if text != last:
                    last, s = text, shingle_set(text, k)
                    fp = _fingerprint(s)
                if fp == (hi, lo):
                    keep.append(r)
                    sets.append(s.tobytes())
            got = part.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([got.column(3), got.column(4), got.column(5), got.column(6), pa.array(sets, pa.binary())], ["hub", "cell", "v", "leaf", "s"])


def _confirm(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Compare each row of a cell with the cell's hub, which comes first."""
    at, hub = None, np.zeros(0, np.uint64)
    for batch in batches:
        a, b = [], []
        for key, cell, v, leaf, s in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
            own = np.frombuffer(s.as_py(), np.uint64)
            if not leaf:
                at, hub = (key, cell), own
            elif at == (key, cell):
                both = len(np.intersect1d(hub, own, assume_unique=True))
                if 100 * both >= threshold * (len(hub) + len(own) - both):
                    a.append(v)
                    b.append(key)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


class _Join:
    """One run: what its steps share."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, k: int, threshold: int, positions: int, trees: int, branch: float, depth: int, seed: int, join_ids: bool):
        text = F.col(text_col)
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
        self.k, self.threshold, self.positions, self.trees, self.branch, self.depth, self.seed, self.join_ids = k, threshold, positions, trees, branch, depth, seed, join_ids
        self.scratch = Scratch(docs.sparkSession, "minhash")

    def sketch(self) -> None:
        rows = self.docs.select("*", F.xxhash64("text").alias("text_hash")).mapInArrow(partial(_sketches, k=self.k, positions=self.positions), "doc_id long, text_hash long, n long, hi long, lo long, sig binary, bag binary")
        whole = self.scratch.save(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
        self.rows = self.scratch.save(whole.select("doc_id", "text_hash", "n", "hi", "lo", "row"), "slim")
        named = self.rows.where("doc_id is not null and n > 0")
        first = named.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "row")).alias("f"), F.count("*").alias("c"))
        self.classes = self.scratch.save(first.select("hi", "lo", F.col("f.doc_id").alias("first_id"), F.col("f.row").alias("v"), "c"), "classes")
        # the few rows that stand for no class are told by a filter, so that sketches are not shuffled
        again = join_per_key(named.withColumn("class", F.xxhash64("hi", "lo")), self.classes.where("c > 1").select(F.xxhash64("hi", "lo").alias("class"), F.col("hi").alias("h"), F.col("lo").alias("l"), "v", "c"), "class", "c", self.rows.count(), self.scratch)
        copies = self.scratch.save(again.where("hi = h and lo = l and row <> v").select("row"), "copies")
        one, maybe = split_by_keys(whole.where("doc_id is not null and n > 0"), F.col("row"), copies, self.scratch)
        reps = one.unionByName(maybe.join(copies, "row", "left_anti"))
        self.reps = self.scratch.save(reps.select(F.col("row").alias("v"), "doc_id", "n", "hi", "lo", "sig", "bag"), "reps")
        self.scratch.keep_only(self.rows, self.classes, self.reps)

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Of saved pairs ``(a, b)`` those whose full sets reach the threshold; each b is the hub of its cells."""
        hubs = pairs.groupBy("b").agg(F.count("*").alias("c")).withColumn("cells", F.ceil(F.col("c") / CELL).cast("int"))
        hubs = self.scratch.save(hubs, "hubs")
        leaves = join_per_key(pairs.select("a", "b"), hubs, "b", "c", pairs.count(), self.scratch)
        leaves = leaves.select(F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), F.col("cells")).cast("int").alias("cell"), F.col("a").alias("v"), F.lit(1).alias("leaf"))
        heads = hubs.select(F.col("b").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.col("b").alias("v"), F.lit(0).alias("leaf"))
        wanted = self.scratch.save(leaves.unionByName(heads).join(self.reps.select("v", "doc_id", "hi", "lo"), "v"), "wanted")
        # only texts that some pair asks for are shuffled
        _, texts = split_by_keys(self.docs, F.col("doc_id"), self.scratch.save(wanted.select("doc_id").distinct(), "asked"), self.scratch)
        rows = texts.join(wanted, "doc_id").select("text", "hi", "lo", "hub", "cell", "v", "leaf")
        rows = rows.mapInArrow(partial(_cell_rows, k=self.k), "hub long, cell int, v long, leaf int, s binary")
        rows = rows.repartition("hub", "cell").sortWithinPartitions("hub", "cell", "leaf")
        return self.scratch.save(rows.mapInArrow(partial(_confirm, threshold=self.threshold), "a long, b long"), "links")

    def stars(self) -> DataFrame:
        """Candidates between each node's members and its first member, if they share several nodes."""
        nodes = self.reps.select("v", "sig").mapInArrow(partial(_first_nodes, trees=self.trees, depth=self.depth, branch=self.branch, seed=self.seed), "node long, v long")
        keys = self.scratch.save(nodes, "nodes")
        sizes = keys.groupBy("node").agg(F.count("*").alias("size"), F.min("v").alias("first")).where("size > 1")
        sizes = self.scratch.save(sizes, "sizes")
        _, shared = split_by_keys(keys, F.col("node"), sizes.select("node"), self.scratch)
        self.live = self.scratch.save(join_per_key(shared, sizes, "node", "size", keys.count(), self.scratch), "live")
        self.scratch.drop(keys, sizes)
        pairs = self.live.where("v <> first").groupBy(F.col("v").alias("a"), F.col("first").alias("b")).agg(F.count("*").alias("shared"))
        return self.scratch.save(self._plausible(pairs.where("shared > 1").select("a", "b")), "pairs")

    def _plausible(self, pairs: DataFrame) -> DataFrame:
        """Drop star candidates whose sketches are too unlike to be confirmed."""
        pairs = self.scratch.save(pairs, "candidates")
        left, right = (self._of_reps(pairs, side, "n", "sig") for side in ("a", "b"))
        rows = pairs.join(left.select(F.col("v").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a")
        near = f"100 * least(na, n) >= {self.threshold} * greatest(na, n)"
        rows = rows.join(right.withColumnRenamed("v", "b"), "b").where(near).select("a", "b", "sa", "sig")
        return rows.mapInArrow(partial(_star_pairs, threshold=self.threshold), "a long, b long")

    def stragglers(self, labels: DataFrame) -> DataFrame:
        """Links between different components in nodes that hold several."""
        known = self.reps.select("v", "n").join(labels, "v", "left").select("v", "n", F.coalesce("comp", "v").alias("comp"))
        known = self.scratch.save(known, "known")
        rows = self.live.select("node", "v", F.lit(None).cast("long").alias("parent"))
        found, dense = [], []
        while True:
            rows = self.scratch.save(rows.join(known, "v"), "labelled")
            per = rows.groupBy("node", "comp").agg(F.count("*").alias("c"), F.max("parent").alias("parent"))
            of = per.groupBy("node").agg(F.sum("c").alias("size"), F.max("parent").alias("parent"), F.count("*").alias("comps"))
            of = of.where("comps > 1").select("node", "size", (F.col("size") > SHRINK * F.col("parent")).alias("stuck"))
            of = self.scratch.save(of, "mixed")
            rows = self.scratch.save(join_per_key(rows.drop("parent"), of, "node", "size", rows.count(), self.scratch), "rows")
            large = self._with_density(rows.where(F.col("size") > LEAF), of.where(F.col("size") > LEAF))
            leaf = rows.where(F.col("size") <= LEAF).select("node", F.lit(0).alias("block"), "v", "comp", "n", F.lit(True).alias("minor"))
            found.append(leaf)
            dense.append(large.where("dense").select("node", "v", "comp", "n"))
            more = large.where("not dense").select("node", "v", F.col("size").alias("parent"))
            if not more.limit(1).count():
                break
            more = more.join(self._of_reps(more, "v", "sig"), "v").select("node", "v", "parent", "sig")
            rows = self.scratch.save(more.mapInArrow(partial(_next_nodes, branch=self.branch), "node long, v long, parent long"), "deeper")
        leaves = reduce(DataFrame.unionByName, [*found, self._regions(reduce(DataFrame.unionByName, dense))])
        leaves = self.scratch.save(leaves, "leaves")
        listed = self.scratch.save(self._leaf_pairs(leaves, True), "listed")
        links = self.confirmed(self.scratch.save(listed.groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b"), "pairs"))
        # a pair that hid others and is no link after all: its leaf's pairs are all looked at
        failed = listed.where("sure").join(links, ["a", "b"], "left_anti").select("node", "block").distinct()
        failed = self.scratch.save(failed, "failed")
        if failed.limit(1).count():
            every = self._leaf_pairs(leaves.join(failed, ["node", "block"], "left_semi"), False).select("a", "b").distinct()
            links = links.unionByName(self.confirmed(self.scratch.save(every.join(listed, ["a", "b"], "left_anti"), "pairs")))
        return links

    def _leaf_pairs(self, leaves: DataFrame, hide: bool) -> DataFrame:
        """Candidates within leaves: by sketches first, so that samples of sets go only to rows with a plausible pair."""
        sk = self.reps.select("v", "sig").mapInArrow(_low_bytes, "v long, sk binary")
        rows = leaves.join(sk, "v").repartition("node", "block").sortWithinPartitions("node", "block")
        rows = rows.mapInArrow(partial(_plausible_rows, threshold=self.threshold), "node long, block int, v long, comp long, at long, width long, bits binary")
        rows = self.scratch.save(rows, "plausible")
        rows = rows.join(self._of_reps(rows, "v", "bag"), "v").repartition("node", "block").sortWithinPartitions("node", "block", "at")
        return rows.mapInArrow(partial(_leaf_pairs, threshold=self.threshold, hide=hide), "node long, block int, a long, b long, sure boolean")

    def _of_reps(self, saved: DataFrame, key: str, *columns: str) -> DataFrame:
        """``v`` and columns of the representatives, without most that no row of a saved table asks for: sketches and samples that nobody needs are not shuffled."""
        asked = self.scratch.save(saved.select(F.col(key).alias("v")).distinct(), "asked")
        return split_by_keys(self.reps.select("v", *columns), F.col("v"), asked, self.scratch)[1]

    def _with_density(self, large: DataFrame, nodes: DataFrame) -> DataFrame:
        """Large nodes' rows with ``dense``: whether a further descent would hardly part them.

        The mean similarity of about 2 * LEAF members tells how much a child
        holds of its parent; nodes that did not shrink are dense anyway.  This
        only chooses between two ways that both treat all of a node's rows.
        """
        chance = F.pmod(F.xxhash64("node", "v"), F.lit(1 << 20)) * F.col("size") < float(2 * LEAF << 20)
        some = self.scratch.save(large.where(chance).select("node", "v"), "some")
        some = some.join(self._of_reps(some, "v", "sig"), "v").select("node", "sig")
        shares = some.repartition("node").sortWithinPartitions("node").mapInArrow(_mean_similarity, "node long, share double")
        dense = F.coalesce("stuck", F.lit(False)) | (F.coalesce("share", F.lit(0.0)) > SHRINK)
        flags = self.scratch.save(nodes.join(shares, "node", "left").select("node", F.col("size").alias("count"), dense.alias("dense")), "flags")
        return self.scratch.save(join_per_key(large.drop("stuck"), flags, "node", "count", large.count(), self.scratch).drop("count"), "large")

    def _regions(self, dense: DataFrame) -> DataFrame:
        """Cells in which the rows outside a region's largest component meet all its rows.

        A region is what dense nodes that share rows hold together: one
        covering of it replaces those of its nodes.
        """
        dense = self.scratch.save(dense, "dense")
        firsts = self.scratch.save(dense.groupBy("node").agg(F.min("v").alias("first"), F.count("*").alias("size")), "firsts")
        edges = join_per_key(dense.select("node", "v"), firsts, "node", "size", dense.count(), self.scratch)
        of = component_labels(edges.select(F.col("v").alias("a"), F.col("first").alias("b")), scratch=self.scratch).withColumnRenamed("comp", "node")
        rows = self.scratch.save(dense.select("v", "comp", "n").distinct().join(of, "v"), "regions")
        per = rows.groupBy("node", "comp").agg(F.count("*").alias("c"))
        sums = per.groupBy("node").agg(F.sum("c").alias("size"), F.max(F.struct("c", "comp")).alias("top"))
        across, down = F.ceil(F.col("size") / BLOCK).cast("int"), F.ceil((F.col("size") - F.col("top.c")) / BLOCK).cast("int")
        sums = self.scratch.save(sums.select("node", "size", across.alias("across"), down.alias("down"), F.col("top.comp").alias("main")), "sums")
        rows = self.scratch.save(join_per_key(rows, sums, "node", "size", rows.count(), self.scratch).where("down > 0"), "asked")
        cell = lambda i, j: (F.col(i) * F.col("across") + F.col(j)).alias("block")
        own = lambda n: F.pmod(F.xxhash64("v"), F.col(n)).cast("int")
        asked = rows.where("comp <> main").withColumn("i", own("down")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("across") - 1)))
        every = rows.withColumn("j", own("across")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("down") - 1)))
        return asked.select("node", cell("i", "j"), "v", "comp", "n", F.lit(True).alias("minor")).unionByName(every.select("node", cell("i", "j"), "v", "comp", "n", F.lit(False).alias("minor")))

    def run(self) -> DataFrame:
        self.sketch()
        links = self.confirmed(self.stars())
        links = links.unionByName(self.stragglers(component_labels(links, scratch=self.scratch)))
        if self.join_ids:  # an id that several rows carry with different texts joins their classes
            named = self.rows.where("doc_id is not null and n > 0")
            shared = named.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1")
            again = join_per_key(named.select("doc_id", "hi", "lo"), self.scratch.save(shared, "shared"), "doc_id", "c", self.rows.count(), self.scratch)
            again = again.select("doc_id", "hi", "lo").distinct().join(self.classes, ["hi", "lo"]).select("doc_id", "v")
            links = links.unionByName(again.join(again.groupBy("doc_id").agg(F.min("v").alias("b")), "doc_id").select(F.col("v").alias("a"), "b").where("a <> b"))
        labels = component_labels(links, scratch=self.scratch)
        of = self.classes.join(labels, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
        least = of.groupBy("comp").agg(F.min(F.struct("first_id", "hi", "lo")).alias("top"))
        of = of.join(least, "comp").select(F.xxhash64("hi", "lo").alias("class"), F.col("hi").alias("h"), F.col("lo").alias("l"), "c", "top")
        worded = self.rows.where("doc_id is not null and n > 0").withColumn("class", F.xxhash64("hi", "lo"))
        out = join_per_key(worded, self.scratch.save(of, "of"), "class", "c", self.rows.count(), self.scratch).where("hi = h and lo = l")
        own = F.lit(True) if self.join_ids else (F.col("hi") == F.col("top.hi")) & (F.col("lo") == F.col("top.lo"))
        named = [F.col("n").alias("n_shingles"), "text_hash"]
        out = out.select("doc_id", *named, F.col("top.first_id").alias("component_id"), ((F.col("doc_id") == F.col("top.first_id")) & own).alias("kept"), F.xxhash64("top.hi", "top.lo").alias("group"))
        alone = self.rows.where("doc_id is null or n = 0").select("doc_id", *named, F.when(F.col("n") == 0, F.col("doc_id")).alias("component_id"), F.lit(True).alias("kept"), F.lit(None).cast("long").alias("group"))
        done = self.scratch.save(out.unionByName(alone), "groups")
        self.scratch.keep_only(done)
        return done.select("doc_id", "n_shingles", "component_id", "kept", "text_hash", "group")


def _mean_similarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean share of equal minwise tokens over a node's pairs."""
    for t in sorted_runs(batches, ["node"]):
        node, sig = t.column("node").to_numpy(), _matrix(t.column("sig"), np.uint16)
        starts = run_starts([node])
        shares = []
        for a, b in zip(starts, np.append(starts[1:], len(node)), strict=True):
            equal = sum(float((sig[a:b] == row).mean(axis=1).sum()) for row in sig[a:b])
            shares.append((equal - (b - a)) / max((b - a) * (b - a - 1), 1))
        yield pa.RecordBatch.from_arrays([pa.array(node[starts]), pa.array(shares, pa.float64())], ["node", "share"])


def _low_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lowest byte of each minwise token: enough to compare sketches."""
    for batch in batches:
        if batch.num_rows:
            sk = np.ascontiguousarray(_matrix(batch.column(1), np.uint16).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in sk], pa.binary())], ["v", "sk"])


def _star_pairs(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            sa, sb = _matrix(batch.column(2), np.uint16), _matrix(batch.column(3), np.uint16)
            ok = pa.array((sa == sb).mean(axis=1) >= threshold / 100 - MARGIN)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: int = 80, positions: int = 128, trees: int = 10, branch: float = 5 / 3, depth: int = 2, seed: int = 1, join_ids: bool = True) -> DataFrame:
    """Groups of near-duplicates: ``doc_id, n_shingles, component_id, kept, text_hash, group``, one row per input row.

    ``k`` words make a shingle and ``threshold`` is the least Jaccard
    similarity of a link in percent (documents are lower-cased over A-Z and
    split at ASCII white space).  ``component_id`` is the smallest id that a
    document reaches over links, itself included; ``kept`` marks the documents
    whose id that is.  ``text_hash`` is xxhash64 of the row's text and
    ``group`` of the least fingerprint under the component's id.

    Null, empty and blank texts have no shingles and link with nothing; they
    are kept.  Rows with a null id link with nothing, have a null component and
    are kept.  Repeated ids are one document with all their texts, unless
    ``join_ids`` is false: then every text stands for itself, and of rows with
    the component's id only those of its least fingerprint are kept.  Each row
    is returned.  Other columns are ignored.  An empty table gives an empty
    result.  Texts of any length are shingled whole.
    """
    return _Join(docs, id_col, text_col, k, threshold, positions, trees, branch, depth, seed, join_ids).run()


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row of each group of near-duplicates, with all columns; texts that stay are not shuffled.

    Rows are judged by their texts: rows that share an id but not a text stay
    apart.  Of rows of the same id and the same words one stays, that of the
    least hash of its text and then of its row.  Rows without words or without
    an id all stay.
    """
    scratch = Scratch(docs.sparkSession, "undoubled")
    groups = near_duplicates(docs, id_col, text_col, join_ids=False, **settings).where("doc_id is not null and n_shingles > 0")
    per = groups.groupBy("doc_id", "text_hash").agg(F.max("component_id").alias("component_id"), F.max("kept").alias("kept"), F.max("group").alias("group"), F.count("*").alias("c"))
    per = scratch.save(per, "texts")
    least = per.where("kept").groupBy("doc_id", "group").agg(F.min("text_hash").alias("first"), F.count("*").alias("texts"))
    odd = per.join(least.where("texts > 1").select("doc_id", "group", "first"), ["doc_id", "group"], "left")
    stays = F.col("kept") & (F.col("first").isNull() | (F.col("first") == F.col("text_hash")))
    odd = scratch.save(odd.where(~stays | (F.col("c") > 1)).select("doc_id", "text_hash", stays.alias("stays")), "odd")
    hashed, of, text, stays, row, order = spare(docs.columns, "hashed", "of", "text", "stays", "row", "order")
    key = lambda i, h: F.xxhash64(i, h)
    clear, maybe = split_by_keys(docs.withColumn(hashed, F.xxhash64(text_col)), key(F.col(id_col).cast("long"), F.col(hashed)), odd.select(key(F.col("doc_id"), F.col("text_hash")).alias("key")), scratch)
    told = odd.toDF(of, text, stays)
    same = (F.col(of) == F.col(id_col)) & (F.col(text) == F.col(hashed))
    hashable = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    some = maybe.join(told, same).where(stays).select(F.col(of), F.col(text), F.struct(*quoted(docs.columns)).alias(row), F.xxhash64(*quoted(hashable)).alias(order))
    once = some.groupBy(of, text).agg(F.min_by(row, order).alias(row)).select(f"{row}.*")
    others = maybe.join(told, same, "left_anti")
    return clear.select(quoted(docs.columns)).unionByName(others.select(quoted(docs.columns))).unionByName(once)
