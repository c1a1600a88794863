"""Quality classifier: supervised subword embeddings.

A text is the bag of its words, word pairs and character n-grams, each hashed to a learned vector; the mean vector goes to
a softmax layer. numpy's stochastic gradient descent trains both on a bounded sample of labelled rows. As the output layer
is linear, scoring needs one number per bucket (its vector times the layer), so the table that tasks get is of fixed size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Numbers, cut, held_out, mapped, picked

BITS = 18
BUCKETS = 1 << BITS
#: Character n-grams of each word between < and >.
GRAMS = (3, 4)
#: Distinct words after which a task starts its table anew; bounds memory, never the result.
TABLE_ENTRIES = 300_000
#: Labelled rows that the model is fitted on, at most.
MAX_ROWS = 4000
#: The bucket of a word that repeats the one before it.
SAME = crc32(b"= =") % BUCKETS


def word_ids(word: str) -> list[int]:
    marked = f"<{word}>".encode("utf-8", "replace")
    return [crc32(marked) % BUCKETS] + [crc32(marked[i : i + n]) % BUCKETS for n in GRAMS for i in range(len(marked) - n + 1)]


class Words:
    """Number by distinct word; flat ids by number."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = weights
        self.clear()

    def clear(self) -> None:
        self.numbers, self.done = Numbers(), 0
        self.first, self.sum, self.size = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)

    def of(self, text: str) -> np.ndarray:
        words = text.split()
        return np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))

    def grow(self) -> None:
        """Fills in what is known of new words: hash, sum of weights, number of ids."""
        if len(self.numbers) > self.done:
            ids = [word_ids(w) for w in list(self.numbers)[self.done :]]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.int64, int(size.sum()))
            starts = np.cumsum(size) - size
            self.first, self.size = np.append(self.first, flat[starts]), np.append(self.size, size)
            self.sum = np.append(self.sum, np.add.reduceat(self.weights[flat], starts))
            self.done = len(self.numbers)


def pair_ids(first: np.ndarray) -> np.ndarray:
    """Buckets of the word pairs, from the buckets of the words."""
    a, b = first[:-1].astype(np.uint64), first[1:].astype(np.uint64)
    mixed = (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - BITS)
    return np.where(a == b, SAME, mixed.astype(np.int64))


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their counts."""
    ids = [word_ids(w) for w in (text or "").split()]
    flat = np.array([i for x in ids for i in x], np.int64)
    return np.unique(np.append(flat, pair_ids(np.array([x[0] for x in ids], np.int64))) if len(ids) else flat, return_counts=True)


@dataclass(frozen=True)
class Model:
    """One weight per bucket and the bias: what is left of vectors and layer for scoring."""

    weights: np.ndarray
    bias: float


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int = 8, epochs: int = 6, rate: float = 0.5, decay: float = 1e-4, seed: int = 7) -> Model:
    """Stochastic gradient descent on softmax cross-entropy. Without rows: a model that scores everything 1/2."""
    rng = np.random.default_rng(seed)
    vectors, layer, bias = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32), np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    n, step = len(bags) * epochs, 0
    for _ in range(epochs if len(bags) else 0):
        for k in rng.permutation(len(bags)):
            ids, counts = bags[k]
            lr, step = rate * (1 - step / n), step + 1
            share = (counts / max(1, counts.sum())).astype(np.float32)
            hidden = share @ vectors[ids] if len(ids) else np.zeros(dim, np.float32)
            z = layer @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = p @ layer
            layer -= lr * (np.outer(p, hidden) + decay * layer)
            bias -= lr * 0.1 * p
            if len(ids):
                vectors[ids] -= (lr * np.sqrt(len(ids)) * share[:, None]) * back[None, :]
    return Model((vectors @ (layer[1] - layer[0])).astype(np.float64), float(bias[1] - bias[0]))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Fits on at most max_rows labelled rows that are not held out, chosen by a hash of their ids. Rows without a text, label
    or id, and labels other than 0 and 1, are left out."""
    chosen = picked(labels, doc_id="doc_id", label=label).where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = picked(docs, doc_id="doc_id", text="text").where(F.col("text").isNotNull()).join(F.broadcast(cut(chosen)), "doc_id").select("doc_id", "label", "text")

    def run(batch) -> dict:
        bags = [bag(t) for t in batch["text"].to_pylist()]
        return {"doc_id": batch["doc_id"], "label": batch["label"], "ids": [b[0] for b in bags], "counts": [b[1] for b in bags]}

    got = mapped(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, label int, ids array<int>, counts array<int>").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).toArrow()
    flat = lambda c: [np.asarray(x) for chunk in got[c].chunks if len(chunk) for x in np.split(chunk.flatten().to_numpy(zero_copy_only=False), np.cumsum(chunk.value_lengths().to_numpy())[:-1])]
    return fit(list(zip(flat("ids"), flat("counts"))), np.array(got["label"].to_pylist(), np.int64))


def scores(texts: list[str | None], words: Words, bias: float) -> list[float]:
    if len(words.numbers) > TABLE_ENTRIES:
        words.clear()
    at = [words.of(t or "") for t in texts]
    words.grow()
    out = []
    for k in at:
        total, n = words.sum[k].sum(), words.size[k].sum()
        if len(k) > 1:
            pairs = pair_ids(words.first[k])
            total, n = total + words.weights[pairs].sum(), n + len(pairs)
        out.append(1 / (1 + math.exp(-max(-500.0, min(500.0, total / max(1, n) + bias)))))
    return out


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every whole text, of any length. Null and empty texts get the score of the bias alone; repeated rows and null ids
    stay; an empty table gives an empty one; other columns are left out, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the input
    return mapped(
        picked(docs, doc_id=id_col, text=text_col),
        lambda rows, words: {"doc_id": rows["doc_id"], "score": pa.array(scores(rows["text"].to_pylist(), words, shared.value.bias))},
        f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double",
        lambda: Words(shared.value.weights),
    )


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    return score(docs, learn(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
