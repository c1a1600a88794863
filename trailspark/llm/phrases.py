"""Phrase collocation mining by marginalising the longest windows.

Each word of a piece begins one window: itself and the words that lead it, up to LONGEST, padded where the piece ends. Windows are
counted once, whole; ROLLUP sums them over successively shorter prefixes. As each occurrence of a phrase is the prefix of exactly one
window, that gives the counts of phrases of all lengths without an explosion for each.

Windows are cut short before they are counted where nothing frequent can follow: no phrase of a rare word, pair or triple is frequent.
Which are rare is known from counts of hashed words and pairs, then of triples, over all texts, kept as bit maps of bounded size; they
may call a rare one frequent, which costs a row, never the other way round. Words are told apart by 64-bit hashes within a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import BitMap, cut, picked

LONGEST, LEAST, WITHIN_PERCENT, TOP = 4, 30, 80, 2000
#: Bytes of text, about, that a task splits and counts at a time, and hashes that it gathers; they bound memory, never the result.
PART, HASHES = 1 << 20, 1 << 20

FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
ENDED, NEXT = re.compile(rb"[ \n]"), re.compile(rb"(?:[ \n]*[^ \n]+){0,%d}" % (LONGEST - 1))
#: Of the words' polynomial hashes: an odd base, its inverse modulo 2**64, and the value of each byte.
BASE = 0x9E3779B97F4A7C15
VALUE = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def pairs_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * np.uint64(0xA0761D6478BD642F) + b)


@dataclass
class Words:
    """Words in order: bytes and places in them, number of the language, hash of language and word, and whether the next word stands in
    the same piece. Only the first `counted` begin windows; the others lead them."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    lang: np.ndarray
    hash: np.ndarray
    leads: np.ndarray
    counted: int


class Powers:
    """Powers of BASE and of its inverse, as many as were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (BASE, pow(BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


def split(texts: list[bytes], langs: list[str], powers: Powers) -> Iterator[Words]:
    """The words of whole texts, PART bytes at a time; a part ends with a word and sees the next LONGEST - 1."""
    data = b"\n".join(texts).translate(FOLD)
    first = np.cumsum([0, *(len(x) + 1 for x in texts)])[:-1]
    salt = np.array([xxh64_intdigest(x.encode()) for x in langs], np.uint64)
    at = 0
    while at < len(data):
        stop = ENDED.search(data, at + PART)
        to = stop.start() if stop else len(data)
        part = data[at : NEXT.match(data, to).end()]
        x = np.frombuffer(part, np.uint8)
        ends = x == 10
        edges = np.diff((~ends & (x != 32)).view(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        up, down = powers.to(len(x))
        sums = np.cumsum(VALUE[x] * up)
        of = np.searchsorted(first, start + at, "right") - 1
        hashes = mixed((sums[end - 1] - np.where(start > 0, sums[start - 1], np.uint64(0))) * down[start] + salt[of])
        piece = np.cumsum(ends, dtype=np.int32)[start]
        yield Words(part, start, end, of, hashes, np.append(piece[1:] == piece[:-1], False)[: len(start)], int(np.searchsorted(start, to - at)))
        at = to


def parts(batches: Iterator[pa.RecordBatch], powers: Powers) -> Iterator[tuple[Words, list[str]]]:
    """The words of rows (lang, text) with the languages that their numbers stand for, rows of PART bytes at a time."""
    texts, langs, held = [], [], 0

    def drain() -> Iterator[tuple[Words, list[str]]]:
        for w in split(texts, langs, powers):
            yield w, langs

    for b in batches:
        for text, lang in zip(b["text"].cast(pa.binary()), b["lang"], strict=True):
            texts.append(text.as_py())
            langs.append(lang.as_py())
            held += len(texts[-1])
            if held >= PART:
                yield from drain()
                texts, langs, held = [], [], 0
    if texts:
        yield from drain()


def going(w: Words, kept: dict[int, BitMap]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size of grams: size, places where grams begin of which all that kept (maps by size) can tell is frequent, their hashes."""
    at, hashes = np.arange(len(w.hash)), w.hash
    for size in range(1, LONGEST + 1):
        if size > 1:
            on = np.zeros(len(w.hash) + 1, bool)
            on[at] = True
            from_here = np.zeros(len(w.hash), np.uint64)
            from_here[at] = hashes
            at = at[on[at + 1] & w.leads[at]]  # the shorter grams here and at the next word go on
            hashes = pairs_of(from_here[at], w.hash[at + size - 1])
        if size in kept:
            fine = kept[size].has(hashes)
            at, hashes = at[fine], hashes[fine]
        yield size, at, hashes


def frequent(rows: DataFrame, least: int, sizes: tuple[int, ...], kept: dict[int, BitMap]) -> BitMap:
    """Of the hashed grams of some sizes that rows (lang, text) hold at least so often; kept: the maps of shorter ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted() -> pa.RecordBatch:
            gram, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_pydict({"gram": gram.view(np.int64), "n": times})

        for w, _ in parts(batches, Powers()):
            for size, at, hashes in going(w, kept):
                if size in sizes:
                    held.append(hashes[: np.searchsorted(at, w.counted)])
                    n += len(held[-1])
            if n >= HASHES:
                yield counted()
                held, n = [], 0
        if held:
            yield counted()

    found = cut(rows.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("gram"))
    return BitMap.of(found, "gram", BitMap.bits_for(found.count()))


def frequent_grams(rows: DataFrame, least: int) -> dict[int, BitMap]:
    """Maps of words, pairs and triples; triples are counted of frequent pairs alone."""
    short = frequent(rows, least, (1, 2), {})
    kept = {1: short, 2: short}
    return kept | {3: frequent(rows, least, (3,), kept)}


NAMES = [f"w{k + 1}" for k in range(LONGEST)]


def windows(rows: DataFrame, kept: dict[int, BitMap]) -> DataFrame:
    """lang, w1 to w4, n: counted windows of rows (lang, text), '' where a piece ends or nothing frequent follows. Rare words count in
    windows of '' alone. A window may stand in several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, langs in parts(batches, Powers()):
            known, first, ids = np.unique(w.hash, return_index=True, return_inverse=True)
            pad, reach = len(known), np.zeros(len(ids), np.int64)
            for _, at, _ in going(w, kept):
                reach[at] += 1
            # lead columns: the k-th next word, where the window reaches that far
            columns = [np.where(reach > k, np.append(ids[k:], np.full(k, pad))[: len(ids)], pad) for k in range(LONGEST)]
            columns = [c[: w.counted] for c in columns]
            # rare words of different languages are different windows
            language = np.unique(np.array(langs, object), return_inverse=True)[1][w.lang[: w.counted]]
            key = np.zeros(w.counted, np.int64)
            for c in (language, *columns):
                key = np.unique(key * (pad + 1 + len(langs)) + c, return_inverse=True)[1]
            _, at, times = np.unique(key, return_index=True, return_counts=True)
            used, inverse = np.unique(np.concatenate([c[at] for c in columns]), return_inverse=True)
            words = pa.array([w.data[w.start[first[i]] : w.end[first[i]]].decode(errors="replace") if i < pad else "" for i in used.tolist()], pa.string())
            spread = inverse.reshape(LONGEST, -1)
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([langs[i] for i in w.lang[at].tolist()], pa.string())} | {name: words.take(pa.array(spread[k])) for k, name in enumerate(NAMES)} | {"n": times},
            )

    return rows.mapInArrow(run, "lang string, " + ", ".join(f"{x} string" for x in NAMES) + ", n long")


def grams(docs: DataFrame, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Written once: lang, words (array), phrase (words joined by a space) and n of each phrase of up to LONGEST words that stands at
    least so often in one language's pieces; and for each language a row without words: the number of all its words. A null
    language is 'und', a null text empty; rows repeated count as often as they stand. A language without a word has no row."""
    rows = picked(docs, lang=lang_col, text=text_col).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counted = windows(rows, frequent_grams(rows, least)).groupBy("lang", *NAMES).agg(F.sum("n").alias("n"))  # the longest windows alone are shuffled in number
    rolled = counted.rollup("lang", *NAMES).agg(F.sum("n").alias("n"), F.grouping_id().alias("away"))
    size = F.lit(LONGEST) - F.log2(F.col("away") + 1).cast("int")  # away has a bit for each column summed over, the last columns' first
    words = F.slice(F.array(*NAMES), F.lit(1), size)
    found = rolled.where(f"away < {1 << LONGEST}").select("lang", words.alias("words"), "n").where((F.size("words") == 0) | (F.col("n") >= least) & (F.element_at("words", -1) != ""))
    return cut(found.select("lang", "words", F.concat_ws(" ", "words").alias("phrase"), "n"))


def exact(x: str) -> Column:
    return F.col(x).cast("decimal(19,0)")


def scored(found: DataFrame) -> DataFrame:
    """lang, words, phrase, a, l, r, score of each phrase of two words or more in found (as grams gives it): its lowest-scoring cut, the
    first of equals."""
    one = found.where(F.size("words") > 0).select("lang", "phrase", "n")
    phrases = found.where(F.size("words") > 1).withColumnRenamed("n", "a")
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    side = lambda begin, n: F.concat_ws(" ", F.slice("words", begin, n))
    cuts = cuts.select("*", side(F.lit(1), F.col("k")).alias("before"), side(F.col("k") + 1, F.size("words") - F.col("k")).alias("after"))
    counts = cuts.join(one.select("lang", F.col("phrase").alias("before"), F.col("n").alias("l")), ["lang", "before"])
    counts = counts.join(one.select("lang", F.col("phrase").alias("after"), F.col("n").alias("r")), ["lang", "after"])
    score = F.expr("cast(a as decimal(19,0)) * cast(2000000 as decimal(7,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    least = counts.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return least.select("lang", "words", "phrase", "a", "cut.l", "cut.r", "cut.score")


def whole(found: DataFrame, percent: int = WITHIN_PERCENT) -> DataFrame:
    """The rows of found (as scored gives it) but those that stand inside a longer one which is at least so often what they are."""
    size = F.size("words")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.concat_ws(" ", F.slice("words", i, n)))))
    most = found.where(size > 2).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    both = found.join(most, ["lang", "phrase"], "left")
    return both.where(F.col("most").isNull() | (exact("most") * 100 < exact("a") * percent)).select(*found.columns)


def report(docs: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first phrases: lang, rank, phrase, a, l, r, n, score. An empty table gives an empty one; other columns of docs
    don't matter. Ranks are found within salted parts of a language first, so none is sorted whole in one task."""
    found = grams(docs)
    rows = whole(cut(scored(found)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    near = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= top)
    first = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = found.where(F.size("words") == 0).select("lang", "n")
    return first.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def report_sql() -> str:
    """The same in SQL."""
    return rf"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
wins AS (
  SELECT lang, w[i] AS w1, coalesce(w[i + 1], '') AS w2, coalesce(w[i + 2], '') AS w3, coalesce(w[i + 3], '') AS w4 FROM places),
rolled AS (
  SELECT lang, w1, w2, w3, w4, count(*) AS n, grouping_id(w1, w2, w3, w4) AS away FROM wins GROUP BY lang, ROLLUP (w1, w2, w3, w4)),
grams AS (
  SELECT lang, n, CASE away WHEN 0 THEN [w1, w2, w3, w4] WHEN 1 THEN [w1, w2, w3] WHEN 3 THEN [w1, w2] ELSE [w1] END AS words
  FROM rolled WHERE away < 15 AND n >= {LEAST}),
f AS (SELECT lang, n, words, array_to_string(words, ' ') AS phrase FROM grams WHERE words[-1] <> ''),
totals AS (SELECT lang, n FROM rolled WHERE away = 15),
cuts AS (
  SELECT lang, phrase, words, n AS a, k, array_to_string(words[:k], ' ') AS head, array_to_string(words[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, len(words))) AS k FROM f WHERE len(words) > 1)),
counted AS (
  SELECT c.lang, c.phrase, c.words, c.a, c.k, h.n AS l, t.n AS r, (2000000::HUGEINT * c.a) // (h.n::HUGEINT + t.n) AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail),
cands AS (
  SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, a, unnest([array_to_string(words[i:i + m - 1], ' ') FOR i IN range(1, len(words) - m + 2)]) AS phrase
    FROM (SELECT *, unnest(range(2, len(words))) AS m FROM cands WHERE len(words) > 2)) GROUP BY lang, phrase),
kept AS (
  SELECT c.* FROM cands c LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase
  WHERE i.most IS NULL OR 100::HUGEINT * i.most < {WITHIN_PERCENT}::HUGEINT * c.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, totals.n AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""
