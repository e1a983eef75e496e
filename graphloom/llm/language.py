"""Language identification with a linear-chain conditional random field.

Every word of a text gets a label; features are the word's affixes, its
character n-grams and its membership in per-language lexicons, and the
transitions between labels are learned.  Forward-backward gives each word's
posterior, so code-switched text is labelled word by word; a document's
language is the one with the largest posterior mass over its words.

The field is trained on the driver by stochastic gradient on the conditional
likelihood, on sequences spliced from pieces of about ``max_rows`` sampled
documents (and of rare languages up to about ``LEAST`` each), so that it sees switches.  A word's language in training is that of
its document.  Prediction reads whole texts; sequences of like length run
through the recursions side by side.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import hash_sample_by, held_out, mix64

#: Word characters that are numbers and no letters, such as superscripts and fractions.
_NUMBERS = "".join(c for c in map(chr, range(0x20000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
_WORD = re.compile(rf"[^\W\d_{_NUMBERS}]+")
_RUN = re.compile(r"[^\W\d_]+")  #: a word, or one with such numbers in it
UNDETERMINED = "und"
LEAST = 30  #: rows of a language that the training sample holds at least, unless there are fewer


def words_in(text: str) -> list[str]:
    """What ``_WORD`` finds; its long class is only tried on runs that hold more than letters."""
    runs = _RUN.findall(text)
    if not runs or "".join(runs).isalpha():
        return runs
    return [w for run in runs for w in ([run] if run.isalpha() else _WORD.findall(run))]


def forward_backward(emit: np.ndarray, trans: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of padded sequences.

    ``emit`` is (steps, sequences, labels) in logs; sequences are sorted by
    descending length.  Returns unary posteriors, expected transitions and the
    log partition of each sequence.
    """
    steps, _, labels = emit.shape
    top = emit.max(axis=2, keepdims=True)
    e, t = np.exp(emit - top), np.exp(trans)
    live = [int((lengths > s).sum()) for s in range(steps)]
    alpha, scale = np.zeros_like(e), np.ones(e.shape[:2])
    alpha[0] = np.exp(start) * e[0]
    for s in range(steps):
        n = live[s]
        if s:
            alpha[s, :n] = (alpha[s - 1, :n] @ t) * e[s, :n]
        scale[s, :n] = alpha[s, :n].sum(axis=1)
        alpha[s, :n] /= scale[s, :n, None]
    beta = np.ones((e.shape[1], labels))
    post, moves = np.zeros_like(e), np.zeros((labels, labels))
    for s in range(steps - 1, -1, -1):
        n = live[s]
        if s + 1 < steps and live[s + 1]:
            m = live[s + 1]
            ahead = e[s + 1, :m] * beta[:m] / scale[s + 1, :m, None]
            moves += t * (alpha[s, :m].T @ ahead)
            beta[:m] = ahead @ t.T
        post[s, :n] = alpha[s, :n] * beta[:n]
    mask = np.arange(steps)[:, None] < lengths[None, :]
    return post, moves, (np.log(scale) + top[:, :, 0]).sum(axis=0, where=mask)


class WordField:
    """A linear-chain field over words."""

    def __init__(self, languages: list[str], buckets: int = 1 << 16, lexicon: int = 3000, seed: int = 11):
        self.languages, self.buckets, self.lexicon_size, self.seed = sorted(languages), buckets, lexicon, seed
        k = len(self.languages)
        self.weights = np.zeros((buckets, k), np.float32)
        self.trans, self.start = np.zeros((k, k)), np.zeros(k)
        self.lexicon: dict[str, list[int]] = {}

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashed features of distinct words, as (buckets in the order of the words, number for each word).

        They are the affixes (up to three characters in front and four
        behind), the character 2- and 3-grams with the word's ends, the word
        itself, its lexicons and a constant.
        """
        low = [w.lower() for w in words]
        c = np.frombuffer("".join(f"<{w}>" for w in low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.array([len(w) for w in low])
        starts = np.concatenate([[0], np.cumsum(sizes + 2)[:-1]])
        of = np.repeat(np.arange(len(low)), sizes + 2)
        ids, codes = [], []

        def add(tag: int, rows: np.ndarray, *chars: np.ndarray) -> None:
            h = np.full(len(rows), tag, np.uint64)
            for x in chars:
                h = mix64(h) ^ x
            ids.append(rows)
            codes.append(mix64(h))

        two = np.flatnonzero(of[:-1] == of[1:])
        add(1, of[two], c[two], c[two + 1])
        three = np.flatnonzero(of[:-2] == of[2:])
        add(2, of[three], c[three], c[three + 1], c[three + 2])
        for n in (1, 2, 3, 4):
            rows = np.flatnonzero(sizes >= n)
            if n < 4:
                add(10 + n, rows, *(c[starts[rows] + 1 + i] for i in range(n)))
            add(20 + n, rows, *(c[starts[rows] + sizes[rows] - i] for i in range(n)))
        add(3, np.arange(len(low)), np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in low], np.uint64))
        add(4, np.arange(len(low)))
        told = [(i, k) for i, w in enumerate(low) for k in self.lexicon.get(w, ())]
        if told:
            rows, kinds = np.array(told).T
            add(5, rows, kinds.astype(np.uint64))
        row, code = np.concatenate(ids), np.concatenate(codes)
        order = np.argsort(row, kind="stable")
        return (code[order] % np.uint64(self.buckets)).astype(np.int64), np.bincount(row, minlength=len(low))

    def _splice(self, docs: list[tuple[list[str], int]], rng: np.random.Generator, sequences: int, length: int) -> list[list[tuple[str, int]]]:
        """Sequences of pieces of documents; each piece's language is drawn evenly."""
        by: dict[int, list[list[str]]] = defaultdict(list)
        for words, k in docs:
            by[k].append(words)
        kinds, out = sorted(by), []
        for _ in range(sequences):
            seq: list[tuple[str, int]] = []
            while len(seq) < length:
                k = kinds[rng.integers(len(kinds))]
                words = by[k][rng.integers(len(by[k]))]
                at, n = int(rng.integers(len(words))), int(rng.integers(5, 31))
                seq += [(w, k) for w in words[at : at + n]]
            out.append(seq[:length])
        return out

    def fit(self, texts: list[str], langs: list[str], sequences: int = 2400, length: int = 50, epochs: int = 4, rate: float = 0.3, batch: int = 40) -> WordField:
        rng = np.random.default_rng(self.seed)
        index = {x: i for i, x in enumerate(self.languages)}
        docs = [(w, index[lang]) for t, lang in zip(texts, langs, strict=True) if (w := words_in(t))]
        if not docs:
            return self
        counts: dict[int, Counter[str]] = defaultdict(Counter)
        for words, k in docs:
            counts[k].update(x.lower() for x in words)
        for k, c in sorted(counts.items()):
            for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: self.lexicon_size]:
                self.lexicon.setdefault(w, []).append(k)
        spliced = self._splice(docs, rng, sequences, length)
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for s in spliced for w, _ in s))}
        flat, sizes = self.features(list(vocabulary))
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        x = np.array([[vocabulary[w] for w, _ in s] for s in spliced])
        y = np.array([[k for _, k in s] for s in spliced])
        labels = len(self.languages)
        g = np.full_like(self.weights, 1e-6)
        gt, gs = np.full_like(self.trans, 1e-6), np.full_like(self.start, 1e-6)
        for epoch in range(epochs):
            step = rate * (1 - epoch / epochs)
            order = rng.permutation(len(x))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                words, inverse = np.unique(x[some], return_inverse=True)
                inverse = inverse.reshape(len(some), -1)
                spans = np.concatenate([np.arange(first[w], first[w] + sizes[w]) for w in words])
                cuts = np.concatenate([[0], np.cumsum(sizes[words])[:-1]])
                emit = np.add.reduceat(self.weights[flat[spans]], cuts, axis=0)[inverse].transpose(1, 0, 2).astype(np.float64)
                post, moves, _ = forward_backward(emit, self.trans, self.start, np.full(len(some), x.shape[1]))
                gold = np.eye(labels)[y[some]].transpose(1, 0, 2)
                d = (post - gold).transpose(1, 0, 2).reshape(-1, labels) / len(some)
                dw = np.stack([np.bincount(inverse.ravel(), d[:, k], len(words)) for k in range(labels)], axis=1)
                touched, back = np.unique(flat[spans], return_inverse=True)
                per = np.repeat(dw, sizes[words], axis=0)
                grad = np.stack([np.bincount(back, per[:, k], len(touched)) for k in range(labels)], axis=1).astype(np.float32)
                grad += 1e-5 * self.weights[touched]
                g[touched] += grad * grad
                self.weights[touched] -= step * grad / np.sqrt(g[touched])
                told = np.zeros_like(self.trans)
                np.add.at(told, (y[some][:, :-1].ravel(), y[some][:, 1:].ravel()), 1.0)
                dt = (moves - told) / len(some)
                gt += dt * dt
                self.trans -= step * dt / np.sqrt(gt)
                ds = (post[0] - gold[0]).mean(axis=0)
                gs += ds * ds
                self.start -= step * ds / np.sqrt(gs)
        return self

    def emissions(self, words: list[str]) -> np.ndarray:
        """A row of label scores for each of some distinct words."""
        flat, sizes = self.features(words)
        return np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes, axis=0)

    def tag(self, texts: list[str]) -> list[list[tuple[str, str, float]]]:
        """Each text's words with their likeliest language and its posterior."""
        out, lists = [], [words_in(t or "") for t in texts]
        for words, post in zip(lists, self.posteriors(lists, Emissions(self)), strict=True):
            best = post.argmax(axis=1)
            out.append([(w, self.languages[k], float(p[k])) for w, k, p in zip(words, best, post, strict=True)])
        return out

    def posteriors(self, texts: list[list[str]], known: Emissions, room: int = 200_000) -> list[np.ndarray]:
        """Posterior matrices of word lists; ``known`` keeps the emissions of words met before."""
        coded = known.codes(texts)
        k = len(self.languages)
        out: list[np.ndarray] = [np.zeros((0, k))] * len(texts)
        order = sorted((i for i in range(len(texts)) if texts[i] and k), key=lambda i: -len(texts[i]))
        trans, start = self.trans.astype(np.float32), self.start.astype(np.float32)
        at = 0
        while at < len(order):
            longest = len(texts[order[at]])
            some = order[at : at + max(1, room // longest)]
            at += len(some)
            lengths = np.array([len(texts[i]) for i in some])
            emit = np.zeros((longest, len(some), k), np.float32)
            for c, i in enumerate(some):
                emit[: lengths[c], c] = known.table[coded[i]]
            post, _, _ = forward_backward(emit, trans, start, lengths)
            for c, i in enumerate(some):
                out[i] = post[: lengths[c], c]
        return out


class Emissions(dict):
    """Words met so far, by number, and the table of their emissions."""

    def __init__(self, model: WordField):
        super().__init__()
        self.model, self.new = model, []
        self.table = np.zeros((0, len(model.languages)), np.float32)

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n

    def codes(self, texts: list[list[str]]) -> list[np.ndarray]:
        out = [np.fromiter(map(self.__getitem__, words), np.int64, len(words)) for words in texts]
        if self.new and self.model.languages:
            self.table = np.concatenate([self.table, self.model.emissions(self.new)])
            self.new = []
        return out


def _predict(batches: Iterator[pa.RecordBatch], model: WordField, keep: int = 300_000) -> Iterator[pa.RecordBatch]:
    known = Emissions(model)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = [words_in(t) if (t := x.as_py()) else [] for x in part.column(1)]
            if len(known) > keep:
                known = Emissions(model)
            langs, scores = [], []
            for words, post in zip(texts, model.posteriors(texts, known), strict=True):
                mass = post.sum(axis=0, dtype=np.float64)
                best = int(mass.argmax()) if len(post) else -1
                langs.append(model.languages[best] if best >= 0 else UNDETERMINED)
                scores.append(min(1.0, float(mass[best] / len(words))) if best >= 0 else 0.0)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])


def fit_language(docs: DataFrame, max_rows: int = 2000, max_chars: int = 100_000, **settings) -> WordField:
    """A field fitted on a bounded sample of rows with a language; rows whose crc32 of the id modulo 3 is 1 are held out.

    The sample has about ``max_rows`` rows, each language at its share, and
    languages whose share is below ``LEAST`` rows are raised to about that
    many: at most ``max_rows`` + ``LEAST`` a language, about.  Every language
    of the rows to learn from is learned.
    """
    told = docs.where("doc_id is not null and lang is not null").where(~held_out(F.col("doc_id"), 3, 1)).where(F.length("text").between(1, max_chars))
    chosen = hash_sample_by(told.select("doc_id", "text", "lang"), max_rows, LEAST, "lang", "doc_id", "text")
    rows = chosen.toPandas().sort_values(["doc_id", "text", "lang"])
    return WordField(sorted(set(rows.lang)), **settings).fit(rows.text.tolist(), rows.lang.tolist())


def identify_language(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every document.

    ``lang_pred`` is ``und`` with score 0 for null texts and texts without a
    letter (and everywhere if no row has a language to learn from).  Rows are
    judged one by one: repeated rows and null ids pass; empty tables give
    empty results; other columns are ignored.
    """
    model = fit_language(docs, **settings)
    rows = docs.select("doc_id", "text").mapInArrow(partial(_predict, model=model), "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")
