"""SentencePiece encoding with sampled segmentations, and lossless decoding.

A text's segmentations are the paths of its lattice of pieces; a path's weight
is the product of its pieces' probabilities to the power ``alpha``.  Forward
filtering gives the weight of all paths to each position, and sampling goes
backward from the end, so each segmentation comes up by its probability.  The
random numbers are functions of the row's key, the place in the text and the
seed: a row is segmented alike in every run and on every cluster.

No piece reaches over a boundary between two characters that stand side by
side in no piece, so the lattice falls apart there; the parts repeat
throughout a corpus, their filtered lattices are kept, and all
parts of a batch are sampled side by side.  Blanks are the pieces' U+2581; a
literal U+2581 and any character without a piece go to byte pieces, so that
decoding gives back every text as it was.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import give_back, mix64, uniforms

_TOKEN = re.compile(r" *[^ ]+| +")
PORTION = 30_000  #: characters of parts whose lattices are filtered at once; a longer part alone


@dataclass
class PieceModel:
    """Pieces by id (blanks as blanks), their log probabilities, and the byte pieces' ids."""

    pieces: list[str | None]  #: None: a special or a byte piece
    weights: list[float]
    byte_ids: list[int]
    by_text: dict[str, int] = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.by_text = {p: i for i, p in enumerate(self.pieces) if p}
        self.longest = max(map(len, self.by_text), default=1)
        self.pairs = {p[i : i + 2] for p in self.by_text for i in range(len(p) - 1)}
        self.byte_weight = min((self.weights[i] for i in self.by_text.values()), default=0.0)

    @staticmethod
    def load(path: str) -> PieceModel:
        """Read a model file.  Scores that are merge ranks (as in BPE models) become log probabilities by Zipf's law.

        User-defined pieces have no score of their own and count as the least likely ones.
        """
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        pieces = [None if m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i) else m.id_to_piece(i).replace("▁", " ") for i in range(n)]
        scores = [m.get_score(i) for i in range(n)]
        told = [s for s, p in zip(scores, pieces, strict=True) if p and s > -1e8]
        if all(s == int(s) and s <= 0 for s in told) and len(set(told)) == len(told):
            total = math.log(sum(1 / (2.7 - s) for s in told))
            scores = [-math.log(2.7 - s) - total if s > -1e8 else s for s in scores]
        least = min((s for s, p in zip(scores, pieces, strict=True) if p and s > -1e8), default=0.0)
        scores = [max(s, least) for s in scores]
        byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(m.is_byte(i) for i in byte_ids):
            raise ValueError("the model has no byte pieces: decoding would lose characters")
        return PieceModel(pieces, scores, byte_ids)

    def raw(self) -> list[bytes]:
        """What each id decodes to."""
        out = [p.encode() if p else b"" for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            out[i] = bytes([b])
        return out

    def decode(self, ids: list[int]) -> str:
        table = self.raw()
        return b"".join(table[i] for i in ids).decode("utf-8", "surrogatepass")

    def edges(self, part: str) -> list[list[tuple[int, tuple[int, ...], float]]]:
        """For each end in the part the edges (start, ids, log probability) that lead to it."""
        out: list[list[tuple[int, tuple[int, ...], float]]] = [[] for _ in range(len(part) + 1)]
        for start in range(len(part)):
            for end in range(start + 1, min(len(part), start + self.longest) + 1):
                i = self.by_text.get(part[start:end])
                if i is not None:
                    out[end].append((start, (i,), self.weights[i]))
            if part[start] not in self.by_text:
                ids = tuple(self.byte_ids[b] for b in part[start].encode("utf-8", "surrogatepass"))
                out[start + 1].append((start, ids, self.byte_weight * len(ids)))
        return out


class _Index(dict):
    """Numbers keys as they come; ``new`` are those since it was last emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


class _Grown:
    """An array that grows at its end, by halves, so that it is seldom copied."""

    def __init__(self, dtype: type, *first: float):
        self.room, self.size = np.array(first, dtype), len(first)

    def add(self, more: np.ndarray) -> None:
        size = self.size + len(more)
        if size > len(self.room):
            room = np.empty(max(size, 1000 + len(self.room) * 3 // 2), self.room.dtype)
            room[: self.size] = self.room[: self.size]
            self.room = room
        self.room[self.size : size] = more
        self.size = size

    def __len__(self) -> int:
        return self.size

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        return self.room[: self.size]


def _portions(parts: list[str], size: int) -> Iterator[list[str]]:
    """Parts in their order, of about ``size`` characters in all, a single part at least."""
    at, total = 0, np.cumsum([len(p) for p in parts])
    while at < len(parts):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right")))
        yield parts[at:stop]
        at = stop


def _chars(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _sums_within(x: np.ndarray, heads: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Cumulative sums of each group from its own first member, so that they do not depend on other groups."""
    out = x.copy()
    for step in range(1, int(count.max(initial=0))):
        at = heads[count > step] + step
        out[at] += out[at - 1]
    return out


class Lattices:
    """Filtered lattices of many parts at once, in arrays.

    A node is an end within a part; its outcomes are the edges that may come
    last on a path to it, likeliest first, with cumulative probabilities.
    """

    def __init__(self, model: PieceModel, alpha: float):
        self.model, self.alpha = model, alpha
        self.sequences = [(i,) for i in range(len(model.pieces))]  # ids by edge label
        self.byte_labels: dict[int, int] = {}
        pairs = np.array([ord(p[0]) << 21 | ord(p[1]) for p in model.pairs], np.uint64)
        self.pairs = np.sort(pairs)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, model.longest + 1):
            some = [(p, i) for p, i in model.by_text.items() if len(p) == n]
            if some:
                h = np.zeros(len(some), np.uint64)
                grid = np.array([[ord(c) for c in p] for p, _ in some], np.uint64)
                for j in range(n):
                    h = h * _BASE + mix64(grid[:, j])
                order = np.argsort(h)
                self.by_length[n] = h[order], np.array([i for _, i in some])[order]
        self.weights = np.array(model.weights)
        self.flat: tuple[np.ndarray, np.ndarray] | None = None

    def spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each edge label, and the ids of all labels in a row."""
        if self.flat is None or len(self.flat[0]) != len(self.sequences):
            self.flat = np.array([len(x) for x in self.sequences]), np.array([i for x in self.sequences for i in x])
        return self.flat

    def cuts(self, text: str, ends: np.ndarray) -> np.ndarray:
        """Ends of the parts: those given and wherever no piece can reach across."""
        c = _chars(text)
        cut = np.ones(len(c), bool)
        if len(c) > 1 and len(self.pairs):
            pair = c[:-1] << np.uint64(21) | c[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            cut[:-1] = self.pairs[at] != pair
        cut[ends - 1] = True
        return np.flatnonzero(cut) + 1

    def _bytes(self, char: int) -> int:
        label = self.byte_labels.get(char)
        if label is None:
            label = self.byte_labels[char] = len(self.sequences)
            self.sequences.append(tuple(self.model.byte_ids[b] for b in chr(char).encode("utf-8", "surrogatepass")))
        return label

    def build(self, parts: list[str], base: int) -> tuple[np.ndarray, ...]:
        """Nodes base + 1 .. base + characters: (first, count) of nodes, (cumulative, label, next) of outcomes, end node of each part."""
        c = _chars("".join(parts))
        sizes = np.array([len(p) for p in parts])
        stop = np.cumsum(sizes)
        limit = np.repeat(stop, sizes)  # where each character's part ends
        origin = np.repeat(stop - sizes, sizes)
        mixed = mix64(c)
        starts, ends, labels = [], [], []
        h, at = np.zeros(len(c), np.uint64), np.arange(len(c))
        covered = np.zeros(len(c), bool)
        for n in range(1, self.model.longest + 1):
            alive = at + n <= limit[at]
            at, h = at[alive], h[alive]
            if not len(at):
                break
            h = h * _BASE + mixed[at + n - 1]
            if n in self.by_length:
                hashes, ids = self.by_length[n]
                place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = hashes[place] == h
                starts.append(at[hit])
                ends.append(at[hit] + n)
                labels.append(ids[place[hit]])
                if n == 1:
                    covered[at[hit]] = True
        weights = [self.weights[x] for x in labels]
        bare = np.flatnonzero(~covered)
        if len(bare):
            values, back = np.unique(c[bare], return_inverse=True)
            own = np.array([self._bytes(int(v)) for v in values])
            wide = np.array([len(self.sequences[x]) for x in own])
            starts.append(bare)
            ends.append(bare + 1)
            labels.append(own[back])
            weights.append(self.model.byte_weight * wide[back])
        start, end, label, weight = (np.concatenate(x) for x in (starts, ends, labels, weights))
        depth = end - origin[start]
        order = np.lexsort((end, depth))
        start, end, label, weight, depth = (x[order] for x in (start, end, label, weight, depth))
        opens = start == origin[start]
        total, chance = np.zeros(len(c) + 1), np.zeros(len(start))
        levels = np.flatnonzero(np.diff(depth, prepend=-1))
        for a, b in zip(levels, np.append(levels[1:], len(depth)), strict=True):
            x = np.where(opens[a:b], 0.0, total[start[a:b]]) + self.alpha * weight[a:b]
            e = end[a:b]
            heads = np.flatnonzero(np.diff(e, prepend=-1))
            owner = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, b - a)))
            top = np.maximum.reduceat(x, heads)
            total[e[heads]] = top + np.log(np.add.reduceat(np.exp(x - top[owner]), heads))
            chance[a:b] = np.exp(x - total[e])
        order = np.lexsort((-chance, end))
        start, end, label, chance, opens = (x[order] for x in (start, end, label, chance, opens))
        heads = np.flatnonzero(np.diff(end, prepend=-1))
        count = np.diff(np.append(heads, len(end)))
        cum = _sums_within(chance, heads, count)
        cum[heads + count - 1] = 2.0  # the last outcome takes what rounding leaves
        return heads, count, cum, label, np.where(opens, 0, base + start), base + stop


class Sampler:
    """The lattices met so far, and sampling from them."""

    def __init__(self, model: PieceModel, alpha: float, seed: int, keep: int = 130_000):
        self.lattices, self.model, self.seed, self.keep = Lattices(model, alpha), model, seed, keep
        self.clear()

    def clear(self) -> None:
        self.tokens, self.parts = _Index(), _Index()
        self.token_at, self.token_parts, self.part_node = _Grown(np.int32, 0), _Grown(np.int32), _Grown(np.int32)
        self.first, self.cum, self.label, self.next = _Grown(np.int32, 0), _Grown(np.float64), _Grown(np.int32), _Grown(np.int32)

    def _learn(self) -> None:
        """Take in the new tokens: cut them into parts and filter the parts' lattices."""
        new, self.tokens.new = self.tokens.new, []
        text = "".join(new)
        token_ends = np.cumsum([len(t) for t in new])
        ends = self.lattices.cuts(text, token_ends)
        begins = np.concatenate([[0], ends[:-1]])
        ids = np.array([self.parts[text[a:b]] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], np.int64)
        self.token_at.add(len(self.token_parts) + np.searchsorted(ends, token_ends) + 1)
        self.token_parts.add(ids)
        fresh, self.parts.new = self.parts.new, []
        for some in _portions(fresh, PORTION):
            first, _, cum, label, after, nodes = self.lattices.build(some, len(self.first) - 1)
            self.first.add(first + len(self.cum))
            self.cum.add(cum)
            self.label.add(label)
            self.next.add(after)
            self.part_node.add(nodes)

    def sample(self, keys: list[int | None], texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.tokens) > self.keep:
            self.clear()
        coded: list[int] = []
        lengths = []
        for text in texts:
            found = _TOKEN.findall(text) if text else []
            coded.extend(map(self.tokens.__getitem__, found))
            lengths.append(len(found))
        if self.tokens.new:
            self._learn()
        token_at, token_parts, part_node, first, cum, label, after = map(np.asarray, (self.token_at, self.token_parts, self.part_node, self.first, self.cum, self.label, self.next))
        tokens = np.array(coded, np.int64)
        sizes = token_at[tokens + 1] - token_at[tokens]
        total = int(sizes.sum())
        begin = np.cumsum(sizes) - sizes
        node = part_node[token_parts[np.repeat(token_at[tokens] - begin, sizes) + np.arange(total)]]
        doc = np.repeat(np.repeat(np.arange(len(texts)), lengths), sizes)
        per_doc = np.bincount(doc, minlength=len(texts))
        place = np.arange(total) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
        own = mix64(np.array([0 if k is None else k & 0xFFFFFFFFFFFFFFFF for k in keys], np.uint64) + np.uint64(self.seed) * np.uint64(0x9E3779B97F4A7C15))
        state = mix64(own[doc] + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        where, step, steps = np.arange(total), 0, np.zeros(total, np.int64)
        rows, picks = [], []
        while len(where):
            u = uniforms(state[where] + np.uint64(step))
            pick = first[node]
            over = np.flatnonzero(u >= cum[pick])
            while len(over):
                pick[over] += 1
                over = over[u[over] >= cum[pick[over]]]
            rows.append(where)
            picks.append(label[pick])
            node = after[pick]
            steps[where] += 1
            live = node > 0
            where, node, step = where[live], node[live], step + 1
        ends = np.cumsum(steps)
        out = np.zeros(int(ends[-1]) if total else 0, np.int64)
        for s, (r, p) in enumerate(zip(rows, picks, strict=True)):
            out[ends[r] - 1 - s] = p
        per = np.bincount(doc, steps, len(texts)).astype(np.int64)
        if len(out) and out.max() >= len(self.model.pieces):
            wide, flat_ids = self.lattices.spelled()
            many = wide[out]
            flat = np.repeat(out, many)
            inner = np.arange(len(flat)) - np.repeat(np.cumsum(many) - many, many)
            starts = np.cumsum(wide) - wide
            flat = flat_ids[starts[flat] + inner]
            owner = np.repeat(np.repeat(np.arange(len(texts)), per), many)
            out, per = flat, np.bincount(owner, minlength=len(texts))
        return np.split(out.astype(np.int32), np.cumsum(per)[:-1]) if len(texts) else []


def _slices(batch: pa.RecordBatch, column: int = 1, size: int = 300_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold up to ``size`` bytes (or items) in a column, a single row at least: arrays stay small."""
    lengths = (pc.binary_length if pa.types.is_string(batch.schema.types[column]) or pa.types.is_large_string(batch.schema.types[column]) else pc.list_value_length)(batch.column(column))
    total = np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _encode(batches: Iterator[pa.RecordBatch], model: PieceModel, alpha: float, seed: int) -> Iterator[pa.RecordBatch]:
    sampler = Sampler(model, alpha, seed)
    for batch in batches:
        for part in _slices(batch):
            ids = sampler.sample(part.column(0).to_pylist(), part.column(1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*part.columns[2:], lists, pa.array(np.diff(offsets), pa.int64())], [*part.schema.names[2:], "ids", "n_pieces"])
    del sampler
    give_back()


def _decode(batches: Iterator[pa.RecordBatch], model: PieceModel) -> Iterator[pa.RecordBatch]:
    raw = model.raw()
    for batch in batches:
        for part in _slices(batch, 0):
            texts = [None if i is None else b"".join([raw[x] for x in i]).decode("utf-8", "surrogatepass") for i in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string())], [*part.schema.names[1:], "decoded"])


def _round_trip(batches: Iterator[pa.RecordBatch], model: PieceModel, alpha: float, seed: int) -> Iterator[pa.RecordBatch]:
    sampler, raw = Sampler(model, alpha, seed), model.raw()
    for batch in batches:
        for part in _slices(batch):
            texts = part.column(1).to_pylist()
            n, sums, whole = [], [], []
            for text, ids in zip(texts, sampler.sample(part.column(0).to_pylist(), texts), strict=True):
                n.append(len(ids))
                sums.append(hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest())
                whole.append(b"".join([raw[x] for x in ids.tolist()]) == (text or "").encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(sums, pa.string()), pa.array(whole, pa.bool_())], ["doc_id", "n_pieces", "ids_sha256", "lossless"])
    del sampler
    give_back()


def encode_pieces(docs: DataFrame, model: PieceModel, key_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, alpha: float = 0.5, seed: int = 1) -> DataFrame:
    """The columns of ``keep`` (by default all but the text) with ``ids`` (a sampled segmentation) and ``n_pieces``.

    Null and empty texts get no pieces.  Rows of the same key and text, and
    reruns, are segmented alike; a null key counts as 0.  Columns of the
    table that are called ``ids`` or ``n_pieces`` are replaced.
    """
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    rows = docs.select(F.col(f"`{key_col}`").cast("long").alias("__key"), F.col(f"`{text_col}`").alias("__text"), *[F.col(f"`{c}`") for c in keep if c not in ("ids", "n_pieces")])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:]), "ids array<int>, n_pieces long"])
    return rows.mapInArrow(partial(_encode, model=model, alpha=alpha, seed=seed), schema)


def decode_pieces(rows: DataFrame, model: PieceModel, ids_col: str = "ids") -> DataFrame:
    """The table with ``decoded`` in place of the ids: the texts they were made from ('' for null texts)."""
    rest = rows.select(F.col(f"`{ids_col}`").alias("__ids"), *[F.col(f"`{c}`") for c in rows.columns if c not in (ids_col, "decoded")])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields[1:]), "decoded string"])
    return rest.mapInArrow(partial(_decode, model=model), schema)


def sampled_round_trip(docs: DataFrame, model: PieceModel, alpha: float = 0.5, seed: int = 1) -> DataFrame:
    """``doc_id, n_pieces, ids_sha256, lossless`` for every document.

    The hash is of the sampled ids as little-endian 32-bit integers;
    ``lossless`` tells whether decoding them gave the text.  Odd rows are as in
    ``encode_pieces``; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_round_trip, model=model, alpha=alpha, seed=seed), "doc_id long, n_pieces long, ids_sha256 string, lossless boolean")
