"""Toxicity scores from a subword-bag classifier.

A word is the bag of its character n-grams (with word boundaries) and itself,
hashed into ``buckets`` rows of an embedding matrix; a document is the average
over all its features, and a linear softmax on that average gives the label.
Embeddings and softmax are trained jointly with Adagrad in numpy, so that an
unseen misspelling is judged by the n-grams it shares with seen words.

The model is fitted on the driver on about ``max_rows`` labelled documents of
at most ``max_chars`` characters each (a sample by hash of the id); its
size is fixed by ``buckets`` and ``dim``.  Scoring covers every whole text:
averaging and softmax are linear up to the logits, so each word contributes a
constant that executors keep while they meet it again.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import give_back, hash_sample, held_out

_TOKEN = re.compile(r"\w+")


@dataclass
class SubwordSoftmax:
    """Averaged subword embeddings under a linear softmax over two classes."""

    buckets: int = 1 << 19
    dim: int = 8
    shortest: int = 4
    longest: int = 7
    epochs: int = 12
    rate: float = 1.0
    batch: int = 64
    decay: float = 1e-6
    seed: int = 7

    def features(self, word: str) -> list[int]:
        marked = f"<{word}>"
        grams = [marked[i : i + n] for n in range(self.shortest, self.longest + 1) for i in range(len(marked) - n + 1)]
        return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % self.buckets for g in (marked + "w", *grams)]

    def _bags(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Features of all words in a row, the number for each word, and each document's words with their weights.

        A word's weight is its share of the document's features for each of
        its own, so that the weighted sum over all features is their mean.
        """
        number: dict[str, int] = {}
        flat, sizes, words, weights = [], [], [], []
        for text in texts:
            count = Counter(_TOKEN.findall(text.lower()))
            for w in count:
                if w not in number:
                    number[w] = len(number)
                    flat.append(np.array(self.features(w), np.int32))
                    sizes.append(len(flat[-1]))
            ids = np.fromiter((number[w] for w in count), np.int32, len(count))
            times = np.fromiter(count.values(), np.float32, len(count))
            total = float((times * np.array([sizes[i] for i in ids], np.float32)).sum()) if len(ids) else 1.0
            words.append(ids)
            weights.append(times / np.float32(total))
        return np.concatenate(flat) if flat else np.zeros(0, np.int32), np.array(sizes, np.int64), words, weights

    def fit(self, texts: list[str], labels: list[int]) -> SubwordSoftmax:
        rng = np.random.default_rng(self.seed)
        self.E = (rng.random((self.buckets, self.dim), np.float32) - 0.5) / self.dim
        self.W = np.zeros((self.dim, 2), np.float32)
        share = (sum(labels) + 1) / (len(labels) + 2)
        self.bias = np.log(np.array([1 - share, share], np.float32))
        gE, gW, gb = np.full_like(self.E, 1e-8), np.full_like(self.W, 1e-8), np.full(2, 1e-8, np.float32)
        flat, sizes, words, weights = self._bags(texts)
        first = np.cumsum(sizes) - sizes
        gold = np.eye(2, dtype=np.float32)[np.array(labels, int)] if labels else np.zeros((0, 2), np.float32)
        for epoch in range(self.epochs if len(set(labels)) == 2 else 0):
            rate = self.rate * (1 - epoch / self.epochs)
            order = rng.permutation(len(texts))
            for at in range(0, len(order), self.batch):
                some = order[at : at + self.batch]
                some = np.array([d for d in some if len(words[d])], np.int64)
                if not len(some):
                    continue
                length = np.array([len(words[d]) for d in some])
                used, inverse = np.unique(np.concatenate([words[d] for d in some]), return_inverse=True)
                w = np.concatenate([weights[d] for d in some])[:, None]
                doc = np.repeat(np.arange(len(some)), length)
                starts = np.cumsum(sizes[used]) - sizes[used]
                features = flat[np.repeat(first[used] - starts, sizes[used]) + np.arange(sizes[used].sum())]
                per_word = np.add.reduceat(self.E[features], starts, axis=0)
                mean = np.add.reduceat(per_word[inverse] * w, np.cumsum(length) - length, axis=0)
                z = mean @ self.W + self.bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                d = (p - gold[some]) / len(some)
                back = (d @ self.W.T)[doc] * w
                by_word = np.stack([np.bincount(inverse, back[:, c], len(used)) for c in range(self.dim)], axis=1)
                touched, at_feature = np.unique(features, return_inverse=True)
                spread = np.repeat(by_word, sizes[used], axis=0)
                grad = np.stack([np.bincount(at_feature, spread[:, c], len(touched)) for c in range(self.dim)], axis=1).astype(np.float32)
                grad += self.decay * self.E[touched]
                gE[touched] += grad * grad
                self.E[touched] -= rate * grad / np.sqrt(gE[touched])
                dW = mean.T @ d
                gW += dW * dW
                self.W -= rate * dW / np.sqrt(gW)
                db = d.sum(axis=0)
                gb += db * db
                self.bias -= 0.1 * rate * db / np.sqrt(gb)
        return self

    def collapsed(self) -> tuple[np.ndarray, float]:
        """What each feature adds to the logit of class 1 over class 0, and the bias."""
        w = self.W[:, 1] - self.W[:, 0]
        return (self.E @ w).astype(np.float32), float(self.bias[1] - self.bias[0])


def _score(batches: Iterator[pa.RecordBatch], features, table: np.ndarray, bias: float, name: str = "score", at: int = 0, passed: int | None = None, keep: int = 300_000) -> Iterator[pa.RecordBatch]:
    """Scores of the texts in column ``at``, after the first ``passed`` columns (all by default)."""
    known: dict[str, tuple[float, int]] = {}
    for batch in (whole.slice(a, 1000) for whole in batches for a in range(0, whole.num_rows, 1000)):
        scores = np.empty(batch.num_rows)
        for r, text in enumerate(batch.column(at)):
            text = text.as_py()
            total, n = 0.0, 0
            for word, times in Counter(_TOKEN.findall(text.lower())).items() if text else ():
                got = known.get(word)
                if got is None:
                    if len(known) >= keep:
                        known.clear()
                    f = features(word)
                    got = known[word] = (float(table[f].sum(dtype=np.float64)), len(f))
                total += times * got[0]
                n += times * got[1]
            scores[r] = 1 / (1 + np.exp(-np.clip(bias + (total / n if n else 0.0), -50, 50)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:passed], pa.array(scores)], [*batch.schema.names[:passed], name])
    known.clear()
    give_back()


def training_sample(docs: DataFrame, labels: DataFrame, max_rows: int, max_chars: int) -> tuple[list[str], list[int]]:
    """About ``max_rows`` labelled texts, by hash of the id; rows held out (crc32 of the id modulo 4 is 2) never.

    Of several texts of an id one is taken, so ``max_rows`` times ``max_chars`` bounds what the driver gets.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"), 4, 2)).select("doc_id", "toxic")
    chosen = hash_sample(known, max_rows, "doc_id")
    texts = docs.select("doc_id", "text").where(F.length("text").between(1, max_chars)).join(chosen, "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = texts.toPandas().sort_values(["doc_id", "toxic", "text"])
    return rows.text.tolist(), rows.toxic.astype(int).tolist()


def score_documents(docs: DataFrame, model: SubwordSoftmax, text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns of ``keep`` (all by default) and ``name``: the probability of label 1.

    Null and empty texts get the score of an empty bag.  Rows are scored one
    by one, so repeated rows, null ids and further columns pass unchanged.
    """
    table, bias = model.collapsed()  # executors need no embeddings: a copy of the settings tells the features
    keep = docs.columns if keep is None else keep
    passed = [c for c in keep if c != name]
    at = passed.index(text_col) if text_col in passed else len(passed)  # a text that stays is sent once
    rows = docs.select(*[F.col(f"`{c}`") for c in passed], *([F.col(text_col).alias("__text")] if at == len(passed) else []))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(passed)]]
    work = partial(_score, features=replace(model).features, table=table, bias=bias, name=name, at=at, passed=len(passed))
    return rows.mapInArrow(work, ", ".join([*schema, f"`{name}` double"]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, max_chars: int = 20_000, **settings) -> SubwordSoftmax:
    """A model fitted on a bounded sample of the labelled documents."""
    texts, marks = training_sample(docs, labels, max_rows, max_chars)
    return SubwordSoftmax(**settings).fit(texts, marks)


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = 0.3, **settings) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document, as ``labels.toxic`` marks them.

    Empty tables give empty results; without labels of both kinds every score
    is the labels' smoothed share.  See ``score_documents`` for odd rows.
    """
    scored = score_documents(docs, fit_toxicity(docs, labels, **settings), keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
