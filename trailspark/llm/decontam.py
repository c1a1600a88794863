"""Benchmark decontamination: seeds of word pairs, then Smith-Waterman alignment.

A passage that scores enough must hold a number of an item's word pairs, next to each other or with one word between. Words
are counted over the whole corpus, and the pairs with the commonest words, as many as that number allows, are no seeds; so no
passage above the threshold is lost. A bit map of fixed size picks the passages of the corpus that may hold a seed; seeds join
these passages to items, and each pair with enough seeds is aligned word by word, so that edited and paraphrased copies still score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BitMap, cut, fresh, mapped, picked

#: log2 of the bits in the maps that tasks get, whatever the input.
BITS = 24
#: Alignment: what a common, a changed and a missing word count; the share of an item's full score that makes a leak.
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
EDGE = ".,;:!?\"'()[]{}<>*#%&^~`_-/\\|=$@…„“”«»¿¡"
ASCII_EDGE = "".join(c for c in EDGE if c.isascii())
#: A number for each byte at each of 64 places.
RANDOM = np.random.default_rng(11).integers(0, 1 << 64, 64 * 256, np.uint64)


def bytes_of(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins, with the end, counted from any number; the bytes of them all."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    return ends, np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]


def hashes(words: pa.StringArray) -> np.ndarray:
    """A hash by word, 0 of an empty one: sums of fixed random numbers, one for each byte and place; places go on after 64 with odd factors."""
    ends, data = bytes_of(words)
    sizes = np.diff(ends)
    starts = ends[:-1] - ends[0]
    place = np.arange(len(data), dtype=np.int32) - np.repeat(starts, sizes)
    h = RANDOM[((place & 63) << 8) | data]
    if len(data) and place.max() > 63:
        h *= (place >> 6).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    out, some = np.zeros(len(words), np.uint64), sizes > 0
    if some.any():
        out[some] = np.maximum(np.add.reduceat(h, starts[some]), np.uint64(1))
    return out.astype(np.int64)


class Words:
    """Words of texts as hashes."""

    @staticmethod
    def of(texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """Of each text the hashes of its words, which stand between white space, without case and edge punctuation; those of which nothing
        is left don't count. Arrow splits, trims and lowers them, all of a slice at once."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        parts = pc.utf8_split_whitespace(texts.cast(pa.string()))
        if not len(parts):
            return []
        raw = parts.flatten()
        h = hashes(pc.ascii_lower(pc.ascii_trim(raw, ASCII_EDGE)))
        ends, data = bytes_of(raw)
        other = np.unique(np.searchsorted(ends, np.flatnonzero(data > 127) + ends[0], side="right")) - 1
        if len(other):
            some = raw.take(pa.array(other))
            low = pc.utf8_lower(pc.utf8_trim(some, EDGE))
            odd = pc.match_substring_regex(some, "[\u0130\u03a3]")  # whose small letters hang on what is beside them
            if pc.any(odd).as_py():
                low = pc.replace_with_mask(low, odd, pa.array([w.strip(EDGE).lower() for w in some.filter(odd).to_pylist()], pa.string()))
            h[other] = hashes(low)
        kept = np.concatenate([[0], np.cumsum(h != 0)])
        return np.split(h[h != 0], kept[np.cumsum(parts.value_lengths().fill_null(0).to_numpy())][:-1])


def chained(parts: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for w in parts:
        h = (h ^ w.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.astype(np.int64)


def pairs_of(words: np.ndarray) -> np.ndarray:
    """Hashes of words that stand next to each other."""
    return chained([words[:-1], words[1:]])


def found_in(words: np.ndarray, single: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pairs that stand next to each other or with one word between, of single words if asked; their places."""
    parts = [pairs_of(words), chained([words[:-2], words[2:]])] + ([chained([words])] if single else [])
    return np.concatenate(parts), np.concatenate([np.arange(len(x)) for x in parts])


def pairs_needed(n: int, threshold: float) -> int:
    """Pairs of an item of n words that stand in any passage of the threshold's score. Below 1, only single words are sure.

    Let s words of the item be spanned, m of them matched, p pairs of matched neighbours have at most one word between. A score is at
    most 3m - s, and as 2m - s - 1 - p pairs of neighbours or more have two words between, at most s - m + 2 + 2p; s is at most n."""
    return math.ceil((4 * threshold - 1) * n / 3 - 1 - 1e-9)


def flags_of(found: BitMap) -> np.ndarray:
    """A flag for each number that the first BITS bits of a hash make."""
    return np.unpackbits(found.words.view(np.uint8), bitorder="little").view(bool)


def bit(hashes: np.ndarray) -> np.ndarray:
    return (hashes.astype(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64)


def align(a: np.ndarray, b: np.ndarray) -> int:
    """Smith-Waterman score of two word sequences, a row at a time."""
    best, row, cost = 0, np.zeros(len(b) + 1, np.int64), GAP * np.arange(len(b) + 1)
    for w in a:
        new = np.zeros_like(row)
        new[1:] = np.maximum(np.maximum(row[:-1] + np.where(b == w, MATCH, MISMATCH), row[1:] + GAP), 0)
        row = np.maximum.accumulate(new - cost) + cost  # gaps within the row
        best = max(best, int(row.max()))
    return best


def seeds_of(items: DataFrame, counts: DataFrame, threshold: float) -> DataFrame:
    """seed, key, times (in the item), least (times that a passage must reach), fewest (distinct seeds that this takes)."""
    words = items.select("key", F.posexplode("words").alias("pos", "word")).join(counts, "word", "left").select("key", "pos", F.log(F.coalesce("n", F.lit(0)) + 1.0).alias("cost"))
    per_item = words.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cost"))), lambda x: x["cost"]).alias("cost"))

    def pick(batch: pa.RecordBatch) -> dict:
        out = {"key": batch["key"], "seeds": [], "times": [], "least": [], "fewest": []}
        for words, cost in zip(batch["words"].to_pylist(), batch["cost"].to_pylist()):
            w, cost, needed = np.array(words, np.int64), np.array(cost), pairs_needed(len(words), threshold)
            least = max(1, -(-needed // 2))
            if needed < 1:
                chosen = chained([w])
            else:  # without any needed - least of the pairs, least are still met
                g = pairs_of(w)
                chosen = g[np.argsort(cost[:-1] + cost[1:], kind="stable")[: max(1, len(g) - needed + least)]]
            seeds, times = np.unique(chosen, return_counts=True)
            for k, v in (("seeds", seeds), ("times", times), ("least", least), ("fewest", int(np.searchsorted(np.cumsum(np.sort(times)[::-1]), least)) + 1)):
                out[k].append(v)
        return out

    rows = mapped(items.join(per_item, "key"), pick, "key long, seeds array<long>, times array<long>, least long, fewest long")
    return rows.select("key", "least", "fewest", F.explode(F.arrays_zip("seeds", "times")).alias("x")).select(F.col("x.seeds").alias("seed"), "key", F.col("x.times").alias("times"), "least", "fewest")


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    """row (hash of id and text), doc_id, item_id, score, n_seeds of each document and item at or above the threshold."""
    own = picked(docs, doc_id="doc_id", text="text").where(F.col("text").isNotNull()).withColumn("row", F.xxhash64("doc_id", "text"))
    doc_kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    items = picked(benchmark, item_id="item_id", text="text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    items = mapped(items, lambda rows: {"item_id": rows["item_id"], "words": Words.of(rows["text"])}, f"item_id {item_kind}, words array<long>").where(F.size("words") > 0)
    items = cut(items.distinct().withColumn("key", F.xxhash64("item_id", "words")))
    size = items.agg(F.coalesce(F.max(F.size("words")), F.lit(0)).alias("most"), F.coalesce(F.min(F.size("words")), F.lit(0)).alias("least")).first()
    # an alignment spans fewer words of a text than this
    longest, single = math.ceil((3 - 2 * threshold) * size["most"]), pairs_needed(size["least"] if threshold > 0.25 else size["most"], threshold) < 1
    sc = docs.sparkSession.sparkContext
    asked = sc.broadcast(BitMap.of(items.select(F.explode("words").alias("w")), "w", BITS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, found = flags_of(asked.value), Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                h = np.concatenate([np.zeros(0, np.int64), *Words.of(batch.column(0).slice(at, 256))])
                found.update(dict(zip(*(x.tolist() for x in np.unique(h[wanted[bit(h)]], return_counts=True)))))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.int64()), "n": pa.array(list(found.values()), pa.int64())})

    counts = own.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    seeds = cut(seeds_of(items, counts, threshold))
    fewest = seeds.agg(F.coalesce(F.min("fewest"), F.lit(1))).first()[0]
    sought = sc.broadcast(BitMap.of(seeds, "seed", BITS))

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = flags_of(sought.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), {"row": [], "doc_id": [], "start": [], "seeds": [], "words": []}
                for row, doc, w in zip(part["row"].to_pylist(), part["doc_id"].to_pylist(), Words.of(part["text"])):
                    g, place = found_in(w, single)
                    hits = np.flatnonzero(wanted[bit(g)])
                    hits = hits[np.argsort(place[hits], kind="stable")]
                    for run in np.split(hits, np.flatnonzero(np.diff(place[hits]) > longest) + 1) if len(hits) >= fewest else ():
                        met = np.unique(g[run])
                        if len(met) < fewest:
                            continue
                        a, b = max(0, place[run[0]] - longest), place[run[-1]] + longest + 3
                        for k, v in zip(out, (row, doc, a, met, w[a:b])):
                            out[k].append(v)
                if out["row"]:
                    yield pa.RecordBatch.from_pydict(out, schema=passage_schema(part.schema.field("doc_id").type))

    found = cut(own.select("row", "doc_id", "text").mapInArrow(passages, f"row long, doc_id {doc_kind}, start int, seeds array<long>, words array<long>").withColumn("passage", F.xxhash64("row", "start", "words")))
    pairs = found.select("passage", F.explode("seeds").alias("seed")).join(seeds, "seed").groupBy("passage", "key").agg(F.countDistinct("seed").alias("n_seeds"), F.sum("times").alias("times"), F.first("least").alias("least")).where("times >= least")
    both = pairs.join(found.select("passage", "row", "doc_id", "words").dropDuplicates(["passage"]), "passage").join(items.withColumnRenamed("words", "item"), "key").select("row", "doc_id", "item_id", "n_seeds", "words", "item")

    def score(batch: pa.RecordBatch) -> dict:
        texts, wanted = batch["words"].to_pylist(), batch["item"].to_pylist()
        out = []
        for i, t in zip(wanted, texts):
            i, t = np.array(i, np.int64), np.array(t, np.int64)
            enough = np.isin(pairs_of(i), found_in(t, False)[0]).sum() >= pairs_needed(len(i), threshold)
            out.append(align(i, t) / (MATCH * len(i)) if enough else 0.0)
        return {k: batch[k] for k in ("row", "doc_id", "item_id", "n_seeds")} | {"score": out}

    scored = mapped(both.repartition("row", "item_id"), score, f"row long, doc_id {doc_kind}, item_id {item_kind}, n_seeds long, score double")
    return scored.where(F.col("score") >= threshold).groupBy("row", "doc_id", "item_id").agg(F.max("score").alias("score"), F.max("n_seeds").alias("n_seeds"))


def passage_schema(doc: pa.DataType) -> pa.Schema:
    return pa.schema([("row", pa.int64()), ("doc_id", doc), ("start", pa.int32()), ("seeds", pa.list_(pa.int64())), ("words", pa.list_(pa.int64()))])


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score (1: the whole item), n_seeds for each pair at or above the threshold. Texts of any length are searched
    whole. Null and empty texts and items, and rows without an id, have no pairs; repeated rows count once, of several texts of one id
    the best score counts; texts that share an item's id each count; empty tables give an empty one; other columns are left out. A
    single word of an item of two is half of it."""
    found = leaks(docs, benchmark, threshold).where(F.col("doc_id").isNotNull())
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("n_seeds").alias("n_seeds"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, in all their columns, that hold no copy of a benchmark item, whether or not they have an id; a row that only
    shares its id with such a text stays."""
    row = fresh(docs, "row")
    gone = leaks(docs, benchmark, threshold).select(F.col("row").alias(row)).distinct()
    return docs.withColumn(row, F.xxhash64("doc_id", "text")).join(gone, row, "left_anti").select(*docs.columns)
