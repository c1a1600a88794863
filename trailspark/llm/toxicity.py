"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

A character language model (trigrams over folded letters) is counted over the words of the whole corpus. A token that looks
disguised (digits or symbols among letters, a character that repeats, letters spaced out) opens a lattice: each character may
stand for the letters that it is used for, may be a separator, or may repeat the one before. Viterbi decoding takes the cheapest
path under the language model and the channel. Restored words and their stems are the features of a logistic model, learned
from a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Numbers, cut, held_out, mapped, picked

#: Letters that a character is used for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il",
    "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "%": "x", "&": "",
}
SEPARATORS = frozenset(".-_*'~^`\"/\\,:;#=|+&%")
STATES = 28  # word edge, a to z, any other letter
EDGE, OTHER = 0, 27
#: Channel costs (negative log probabilities).
SUBSTITUTE, DROP, REPEAT, KEEP_ODD = 0.7, 0.4, 0.2, 6.0
TABLE_ENTRIES = 100_000
#: Characters after which decoding gives out what all its paths share; spaced-out letters that are joined at a time.
FLUSH, SPACED = 256, 24
#: Labelled rows that the model is fitted on, at most; features kept, at most.
MAX_ROWS, MAX_FEATURES = 8000, 1000
STEMS = (4, 5)
PUNCTUATION = ".,;:!?\"'()[]{}<>*#%&^~`_-/\\=…„“”«»¿"
SYMBOL_RUN = re.compile(r"^([^\w])\1+|([^\w])\2+$")
DOUBLE, DOUBLE_RUN = re.compile(r"(.)\1", re.S), re.compile(r"(.)\1+", re.S)


class Fold(dict):
    """Letters without their accents, for str.translate."""

    def __missing__(self, c: int) -> str:
        plain = self[c] = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))
        return plain


FOLD = Fold()


def folded(word: str) -> str:
    """Lower case without accents."""
    word = word.lower()
    return word if word.isascii() else word.translate(FOLD)


def state(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else OTHER


def lm_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """cell, n: how often each character trigram stands in the plain words of all texts. A task sends at most STATES**3 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, cells = Counter(), np.zeros(STATES**3, np.int64)

        def drain() -> None:
            plain = [(core, n) for w, n in words.items() if (core := w.strip(PUNCTUATION)).isalpha()]
            words.clear()
            letters = np.frombuffer(folded("".join(f" {core}" for core, _ in plain)).encode("ascii", "replace") + b"  ", np.uint8).astype(np.int64)
            states = np.where((letters >= 97) & (letters <= 122), letters - 96, np.where(letters == 32, EDGE, OTHER))
            before, two = np.roll(states, 1), np.roll(states, 2)
            two[before == EDGE] = EDGE
            weight = np.append([n for _, n in plain], [0, 0])[np.maximum(np.cumsum(states == EDGE) - 1 - (states == EDGE), 0)]
            inner = np.arange(len(states)) > 0
            cells[:] += np.bincount(((two * STATES + before) * STATES + states)[inner], weight[inner], STATES**3).astype(np.int64)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(0).slice(at, 256).to_pylist():
                    words.update((text or "").split())
                if len(words) > TABLE_ENTRIES:
                    drain()
        drain()
        seen = np.flatnonzero(cells)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(seen, pa.int32()), "n": pa.array(cells[seen], pa.int64())})

    return docs.select(F.col(f"`{text_col}`")).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def lm(counts: DataFrame) -> np.ndarray:
    """Negative log probabilities [two before, one before, next], interpolated with bigrams and unigrams."""
    cells = np.zeros(STATES**3)
    for cell, n in counts.collect():  # STATES**3 rows at most
        cells[cell] = n
    tri = cells.reshape(STATES, STATES, STATES)
    bi, uni = tri.sum(0), tri.sum((0, 1)) + 1
    p1 = uni / uni.sum()
    p2 = (bi + 10 * p1) / (bi.sum(-1, keepdims=True) + 10)
    return -np.log((tri + 10 * p2[None]) / (tri.sum(-1, keepdims=True) + 10))


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Per character its readings and their costs; an empty reading is a separator or a repeat."""
    out, low = [], folded(token)
    for k, c in enumerate(low):
        if "a" <= c <= "z" or c.isalpha():
            ways = [(c, 0.0)]
        else:
            ways = [(x, SUBSTITUTE) for x in LEET.get(c, "")]
            if c in SEPARATORS or not ways:
                ways.append(("", DROP))
            if not ways[0][0]:
                ways.append((c, KEEP_ODD))
        if k and c == low[k - 1]:
            ways.append(("", REPEAT))
        out.append(ways)
    return out


def restore(token: str, cost: np.ndarray) -> str:
    """The cheapest path through the token's lattice. Of equal ways, the one into the smaller state, then the first reading, counts."""
    spent: dict[tuple[int, int], float] = {(EDGE, EDGE): 0.0}
    back: list[dict] = []  # per character: state -> (state before, reading)
    said: list[str] = []

    def path(steps: list[dict], at: tuple[int, int]) -> list[str]:
        found = []
        for step in reversed(steps):
            at, c = step[at]
            found.append(c)
        return found[::-1]

    for ways in lattice(token):
        after: dict[tuple[int, int], float] = {}
        step: dict[tuple[int, int], tuple] = {}
        for a, b in sorted(spent) if len(spent) > 1 else spent:
            for c, channel in ways:
                s = state(c) if c else 0
                key = (b, s) if c else (a, b)
                x = spent[a, b] + channel + (float(cost[a, b, s]) if c else 0.0)
                if key not in after or x < after[key]:
                    after[key], step[key] = x, ((a, b), c)
        spent = after
        back.append(step)
        if len(back) % FLUSH == 0:
            own = set(spent)
            for k in range(len(back) - 1, -1, -1):  # how far back all paths meet
                own = {back[k][at][0] for at in own}
                if len(own) == 1:
                    said += path(back[:k], own.pop())
                    back = back[k:]
                    break
    best = min(spent, key=lambda k: (spent[k] + float(cost[k][EDGE]), k))
    return "".join(said + path(back, best))


def collapsed(word: str) -> str:
    """The word with each run of a character as one."""
    return DOUBLE_RUN.sub(r"\1", word)


def readings(word: str, cost: np.ndarray, starts: set[str] | None = None) -> list[str]:
    """A word as it is scored: without edge punctuation and folded, and decoded where it looks disguised; both where it may be plain. starts: what
    words of interest begin with, collapsed; letters that repeat are only decoded where they can lead to one."""
    core = word.strip(PUNCTUATION)
    if not core.isalpha():
        core = SYMBOL_RUN.sub("", core).strip(PUNCTUATION)
    if core.isalpha():
        plain = folded(core)
        if not DOUBLE.search(plain):
            return [plain]
        if starts is not None:
            bare = collapsed(plain)
            if starts.isdisjoint((bare[:1], bare[:2], bare[:3], bare[:4])):
                return [plain]
        return [plain] + ([x] if (x := restore(core, cost)) != plain else [])
    return [restore(core, cost)] if any(map(str.isalpha, core)) else [core]


def edge_readings(word: str, cost: np.ndarray) -> list[str]:
    """What a word may say if a sign at its edge stands for a letter."""
    if word.isalpha():
        return []
    core = word.strip(PUNCTUATION)
    at = word.find(core) if core and any(map(str.isalpha, core)) else -1
    if at < 0:
        return []
    before, after = word[at - 1 : at] if at else "", word[at + len(core) : at + len(core) + 1]
    heads = [*LEET.get(before, ""), ""] if before else [""]
    tails = ["", *LEET.get(after, "")] if after else [""]
    return [restore(h + core + t, cost) for h in heads for t in tails if h or t]


def features(restored: str) -> list[str]:
    return [restored, *(f"{restored[:n]}*" for n in STEMS if len(restored) > n)] if restored else []


class Words:
    """Number by distinct word; its features by number."""

    def __init__(self, cost: np.ndarray, known: dict[str, int] | None = None):
        self.cost, self.known = cost, known
        self.starts = {x[: STEMS[0]] for x in known or ()}
        self.bare = None if known is None else {collapsed(x) for x in self.starts}
        self.clear()

    def clear(self) -> None:
        self.numbers, self.found, self.short = Numbers(), [], []

    def grow(self) -> None:
        for word in list(self.numbers)[len(self.found) :]:
            got = {x for said in readings(word, self.cost, self.bare) for x in self.look(said)}
            if self.known is not None:  # a reading of an edge sign only counts as a known word
                got.update(x for said in edge_readings(word, self.cost) for x in self.look(said))
            self.found.append(tuple(sorted(got)))
            self.short.append(len(self.spaced(word)) <= 2)

    @staticmethod
    def spaced(word: str) -> str:
        """What is left of a word for spaced-out letters."""
        return word if word in LEET else word.strip(PUNCTUATION)

    def look(self, restored: str) -> tuple:
        if self.known is None:
            return tuple(features(restored))
        if restored[: STEMS[0]] not in self.starts:  # most words have no known feature
            return ()
        return tuple(self.known[x] for x in features(restored) if x in self.known)

    def joined(self, words: list[str]) -> set:
        """Features of spaced-out letters, one or two at a time. Where runs of short words are common speech, only known words count: those
        that begin at any of them."""
        parts = [self.spaced(w) for w in words]
        single = all(len(x) <= 1 for x in parts)
        if self.known is None:
            return set(features(self.decoded("".join(parts)))) if single else set()
        spelled = single or all(len(set(x)) <= 1 for x in parts)
        got: set = set()
        for k in range(len(parts) - 1):
            said = "".join(parts[k : k + SPACED])
            if len(said) < STEMS[0]:
                break
            if spelled and not (said.isalpha() and not DOUBLE.search(said)):
                got.update(self.look(self.decoded(said)))
            if said.isalpha() and (plain := folded(said))[: STEMS[0]] in self.starts:
                ends = np.cumsum([len(x) for x in parts[k : k + SPACED]])  # other words may follow
                got.update(x for end in ends if end >= STEMS[0] for x in self.look(plain[:end]))
        return got

    def decoded(self, said: str) -> str:
        return restore(said, self.cost) if any(map(str.isalpha, said)) else said

    def of(self, texts: list[str | None]) -> list[set]:
        """The features of each text."""
        if len(self.numbers) > TABLE_ENTRIES:
            self.clear()
        split = [(t or "").split() for t in texts]
        at = [np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)) for words in split]
        self.grow()
        some = np.fromiter(map(bool, self.found), bool, len(self.found))
        short = np.array(self.short, bool)
        out = []
        for words, k in zip(split, at):
            got = {x for i in np.unique(k[some[k]]) for x in self.found[i]}
            run = short[k]
            if len(k) > 2 and (run[:-2] & run[1:-1] & run[2:]).any():  # letters spaced out
                edges = np.flatnonzero(np.diff(np.concatenate([[0], run, [0]])))
                for a, b in zip(edges[::2], edges[1::2]):
                    if b - a > 2:
                        got.update(self.joined(words[a:b]))
            out.append(got)
        return out


@dataclass(frozen=True)
class Model:
    cost: np.ndarray
    known: dict[str, int]
    weights: np.ndarray
    bias: float

    def score(self, got: set) -> float:
        return 1 / (1 + math.exp(-float(np.clip(self.bias + sum(self.weights[i] for i in got), -500, 500))))


def fit_logistic(rows: list[list[int]], labels: np.ndarray, n: int, rounds: int = 300, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient descent on a dense 0/1 matrix of at most MAX_ROWS x MAX_FEATURES."""
    x = np.zeros((len(rows), n + 1), np.float32)
    for k, ids in enumerate(rows):
        x[k, ids] = 1
    x[:, n] = 1
    w, v = np.zeros(n + 1, np.float32), np.zeros(n + 1, np.float32)
    labels = labels.astype(np.float32)
    step = 4.0 / max(1.0, float((x.sum(1) * 1.0).max(initial=1.0)) * max(1, len(rows)))
    keep, step = np.append(np.full(n, ridge), 0.01).astype(np.float32), np.float32(step)
    for k in range(rounds):
        ahead = w + np.float32(k / (k + 3)) * (w - v)
        grad = x.T @ (1 / (1 + np.exp(-np.clip(x @ ahead, -50, 50))) - labels) + keep * ahead
        w, v = ahead - step * grad, w
    return w[:n].astype(float), float(w[n])


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> Model:
    """The language model over all docs; the classifier on at most max_rows labelled rows that are not held out, chosen by a
    hash of their ids. Rows without a text, label or id, and labels other than 0 and 1, are left out; without any row left, no text scores as toxic."""
    cost = lm(lm_counts(docs))
    chosen = picked(labels, doc_id="doc_id", label=label).where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = cut(
        mapped(
            picked(docs, doc_id="doc_id", text="text").where(F.col("text").isNotNull()).join(F.broadcast(cut(chosen)), "doc_id").select("doc_id", "label", "text"),
            lambda rows, words: {"doc_id": rows["doc_id"], "label": rows["label"], "found": [sorted(x) for x in words.of(rows["text"].to_pylist())]},
            f"doc_id {kind}, label int, found array<string>",
            lambda: Words(cost),
        )
    )
    total, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    seen = sample.select("label", F.explode("found").alias("feature")).groupBy("feature").agg(F.sum("label").alias("t"), F.count("*").alias("n"))
    odds = F.log((F.col("t") + 0.5) / (toxic - F.col("t") + 0.5)) - F.log((F.col("n") - F.col("t") + 0.5) / (total - toxic - F.col("n") + F.col("t") + 0.5))
    spread = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("n") - F.col("t") + 0.5) + 1 / (toxic - F.col("t") + 0.5) + 1 / (total - toxic - F.col("n") + F.col("t") + 0.5))
    top = seen.where(F.col("t") >= 3).withColumn("z", odds / spread).where(F.col("z") > 2.5).orderBy(F.desc("z"), "feature").limit(max_features).select("feature").collect()
    known = {r["feature"]: k for k, r in enumerate(top)}
    own = sample.select("doc_id", "label", F.array_intersect("found", F.array(*map(F.lit, known)) if known else F.array().cast("array<string>")).alias("found"))
    rows = own.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows).collect()
    if not rows:  # nothing is known to be toxic
        return Model(cost, {}, np.zeros(0), -5.0)
    weights, bias = fit_logistic([[known[x] for x in r["found"]] for r in rows], np.array([r["label"] for r in rows], float), len(known))
    return Model(cost, known, weights, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every whole text, of any length. Null and empty texts get the score of the bias alone; repeated rows and null ids
    stay; an empty table gives an empty one; other columns are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most STATES**3 costs and MAX_FEATURES features
    return mapped(
        picked(docs, doc_id=id_col, text=text_col),
        lambda rows, words: {"doc_id": rows["doc_id"], "score": [shared.value.score(x) for x in words.of(rows["text"].to_pylist())]},
        f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double",
        lambda: Words(shared.value.cost, shared.value.known),
    )


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    return score(docs, learn(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, in all their columns, whose text scores below the threshold. Null and empty texts score as the bias alone does; rows
    that share an id, or have none, are judged each by its own text; columns of any name stay as they are; an empty table gives an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value.cost, shared.value.known)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                keep = [shared.value.score(x) < threshold for x in words.of(part.column(at).to_pylist())]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
