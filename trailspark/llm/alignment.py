"""Cross-tokenizer alignment: which ids of a byte-level vocabulary (A) and of a piece vocabulary (B) stand for the same bytes of a text.

Byte offsets where tokens of both end cut a text into groups; within them each A token is linked with each B token that it overlaps.
An array from A id to the B id of the same bytes is made once. Links of such a pair, all exact one-to-one groups among them, are
counted in a vector as long as the vocabulary, one a task; the other links alone enter a shuffle of pairs.

Neither side has a token that begins before a run of spaces and goes on in it, unless the run follows other white space, so texts are
cut there and each distinct chunk is aligned once for a task's table. Vocabularies that break this are met with whole texts.

The counts are asked for slice by slice: a slice is a bounded run of a task's documents, which asks for each of its pairs once and gets
the corpus-wide counts back, so neither the pairs of the corpus nor a document's neighbours are ever held by one task.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import pieces
from .common import SLICE_ROWS, Numbers, cut, picked

#: Weight of a slice: distinct ids and pairs of its documents, and DOC for each; bounds what a task of the last step holds.
SLICE, DOC = 1_000_000, 20
#: Chunks after which a task starts its table anew; bounds memory, never the result.
TABLE_ENTRIES = 300_000

CROWDED = re.compile(r"\s ")
CHUNK = re.compile(r" +[^ ]*(?:(?<=\s) +[^ ]*)*")


def chunks(text: str) -> list[str]:
    """A text cut before each run of spaces that follows no white space, and each chunk without its first space; the first chunk has
    the space that both vocabularies put before a text."""
    whole = " " + text
    return [x[1:] for x in CHUNK.findall(whole)] if CROWDED.search(whole) else text.split(" ")


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Rows:
    """Arrays of many rows in one: values, and the size of each row."""

    values: np.ndarray
    sizes: np.ndarray

    def take(self, at: np.ndarray) -> Rows:
        size, past = self.sizes[at], np.cumsum(self.sizes[at])
        first = (np.cumsum(self.sizes) - self.sizes)[at]
        return Rows(self.values[np.repeat(first - past + size, size) + np.arange(past[-1] if len(past) else 0)], size)

    def joined(self, more: Rows) -> Rows:
        return Rows(np.concatenate([self.values, more.values]), np.concatenate([self.sizes, more.sizes]))

    def counted(self, of: np.ndarray, n: int) -> tuple[pa.ListArray, pa.ListArray, np.ndarray]:
        """The distinct values of n documents and how often they stand there; of: each row's document. And the number of distinct ones."""
        top = int(self.values.max(initial=0)) + 1
        found, times = np.unique(np.repeat(of, self.sizes) * top + self.values, return_counts=True)
        distinct = np.bincount(found // top, minlength=n)
        offsets = pa.array(np.concatenate([[0], np.cumsum(distinct)]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(found % top)), pa.ListArray.from_arrays(offsets, pa.array(times)), distinct


@dataclass
class Aligned:
    """Of some chunks: whether both sides' bytes are those of the chunk, numbers of A and B tokens, groups and links, the groups as text,
    A ids of links with their B id of the same bytes, and the other links as a * |B| + b."""

    fine: np.ndarray
    numbers: np.ndarray
    text: list[str]
    same: Rows
    odd: Rows

    def joined(self, more: Aligned) -> Aligned:
        return Aligned(np.concatenate([self.fine, more.fine]), np.concatenate([self.numbers, more.numbers]), self.text + more.text, self.same.joined(more.same), self.odd.joined(more.odd))


class Aligner:
    """Both vocabularies and the distinct chunks of a task."""

    def __init__(self, byte_bpe: str, piece_model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_bpe), pieces.load(piece_model)
        self.a.encode_special_tokens = True
        alphabet, entries = byte_alphabet(), self.a.get_vocab()
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in entry if c in alphabet)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(pieces.MARK, " ").encode() for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        self.names = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.size_a, self.size_b = (np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        # bytes that are a piece and a byte piece both are the piece's
        found = {x: i for last in (True, False) for i, x in enumerate(self.bytes_b) if self.b.is_byte(i) is last and not self.b.is_control(i) and not self.b.is_unknown(i)}
        self.same = np.array([found.get(x, -1) if x else -1 for x in self.bytes_a], np.int64)
        self.whole = bool(pieces.crossing_pieces(self.b)) or any(self.ids([x]) != tuple([[i for y in side for i in y]] for side in self.ids(chunks(x))) for x in pieces.PROBES)
        self.clear()

    def clear(self) -> None:
        self.known, self.table = Numbers(), self.align([])

    def ids(self, keys: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of each key, a space before it."""
        a = [x.ids for x in self.a.encode_batch_fast([" " + k for k in keys], add_special_tokens=False)] if keys else []
        b = self.b.encode(keys, num_threads=1) if keys else []
        return a, [x or [self.b.piece_to_id(pieces.MARK)] for x in b]

    def align(self, keys: list[str]) -> Aligned:
        ids_a, ids_b = self.ids(keys)
        whole = [(" " + k).encode() for k in keys]
        fine = np.ones(len(keys), bool)
        for ids, of in ((ids_a, self.bytes_a), (ids_b, self.bytes_b)):
            own = [b"".join(map(of.__getitem__, x)) for x in ids]
            if own != whole:
                fine &= [x == y for x, y in zip(own, whole, strict=True)]
        for i in np.flatnonzero(~fine):
            ids_a[i], ids_b[i] = [], []
        past_a, past_b = (np.cumsum(list(map(len, side)), dtype=np.int64) for side in (ids_a, ids_b))
        a, b = (np.fromiter(chain.from_iterable(side), np.int64, past[-1] if len(past) else 0) for side, past in ((ids_a, past_a), (ids_b, past_b)))
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends, cuts = np.union1d(ends_a, ends_b), np.intersect1d(ends_a, ends_b, assume_unique=True)
        at = np.append(0, ends_a)[past_a]  # where each key ends
        numbers = np.stack([np.diff(x, prepend=0) for x in (past_a, past_b, np.searchsorted(cuts, at, "right"), np.searchsorted(ends, at, "right"))], axis=1).reshape(-1, 4)

        left, right = a[np.searchsorted(ends_a, ends)], b[np.searchsorted(ends_b, ends)]
        same, key = self.same[left] == right, np.repeat(np.arange(len(keys)), numbers[:, 3])
        text_a, text_b = map(self.names.__getitem__, a.tolist()), map(self.names.__getitem__, b.tolist())
        n_a, n_b = (np.diff(np.searchsorted(e, cuts, "right"), prepend=0).tolist() for e in (ends_a, ends_b))
        groups = [f"{next(text_a)}|{next(text_b)}" if i == j == 1 else f"{','.join(islice(text_a, i))}|{','.join(islice(text_b, j))}" for i, j in zip(n_a, n_b, strict=True)]
        to = np.cumsum(numbers[:, 2]).tolist()
        sizes = lambda which: np.bincount(key[which], minlength=len(keys))
        return Aligned(fine, numbers, [";".join(groups[i:j]) for i, j in zip([0, *to], to, strict=False)], Rows(left[same], sizes(same)), Rows((left * len(self.bytes_b) + right)[~same], sizes(~same)))

    def of_texts(self, texts: list[str | None]) -> tuple[Aligned, np.ndarray]:
        """Whether each text has tokens and its groups as text; numbers and links of chunks, and the text of each chunk. A text with a
        chunk whose bytes differ is tried whole."""
        if len(self.known) > TABLE_ENTRIES:
            self.clear()
        number = self.known.__getitem__
        at = [list(map(number, chunks(x))) if x and not self.whole else [] for x in texts]
        self.table = self.table.joined(self.align(list(self.known)[len(self.table.text) :]))
        of = np.repeat(np.arange(len(texts)), list(map(len, at)))
        flat = np.fromiter(chain.from_iterable(at), np.int64, len(of))
        has = np.array([bool(x) for x in texts], bool)
        unfit = has & (np.bincount(of[~self.table.fine[flat]], minlength=len(texts)) > 0) | has & self.whole
        alone = np.flatnonzero(unfit)
        flat, of = flat[~unfit[of]], of[~unfit[of]]
        text = self.table.text.__getitem__
        groups = ["" if x else ";".join(map(text, w)) for x, w in zip(unfit, at, strict=True)]
        rest = self.align([texts[i] for i in alone])
        for i, x in zip(alone.tolist(), rest.text, strict=True):
            groups[i] = x
        has[alone[~rest.fine]] = False
        numbers = np.concatenate([self.table.numbers[flat], rest.numbers])
        return Aligned(has, numbers, groups, self.table.same.take(flat).joined(rest.same), self.table.odd.take(flat).joined(rest.odd)), np.concatenate([of, alone])


def aligned(docs: DataFrame, byte_bpe: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written once; by kind:
    'doc': doc_id, n_a, n_b, n_groups, n_links, groups (digest of the groups as text), same and odd (distinct A ids of links with the
        B id of the same bytes; distinct other links as a * |B| + b), each with times, and the slice of the document;
    'id': an A id and how many links (n) of a task it has with its B id; 'pair': another pair of a slice and how many links have it.
    Texts that are null, empty or not given back by both sides have no tokens. An empty table gives none."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"kind string, slice long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, same array<long>, same_times array<long>, odd array<long>, odd_times array<long>, id long, n long"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def batch(rows: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Aligner(byte_bpe, piece_model)
        vector, now, weight, pairs = np.zeros(len(both.bytes_a), np.int64), TaskContext.get().partitionId() << 32, 0, []

        def ended() -> pa.RecordBatch:
            found, at = np.unique(np.concatenate([p for p, _ in pairs]), return_inverse=True)
            times = np.zeros(len(found), np.int64)
            np.add.at(times, at, np.concatenate([n for _, n in pairs]))
            return batch(len(found), kind=["pair"] * len(found), slice=np.full(len(found), now), id=found, n=times)

        for b in batches:
            for start in range(0, b.num_rows, SLICE_ROWS):
                rows = b.slice(start, SLICE_ROWS)
                n = rows.num_rows
                got, of = both.of_texts(rows["text"].to_pylist())
                numbers = np.stack([np.bincount(of, got.numbers[:, k], n) for k in range(4)], axis=1).astype(np.int64)  # far below 2**53
                same, same_times, sizes = got.same.counted(of, n)
                odd, odd_times, more = got.odd.counted(of, n)
                vector += np.bincount(got.same.values, minlength=len(vector))
                yield batch(
                    n, kind=["doc"] * n, slice=np.full(n, now), doc_id=rows["doc_id"], n_a=numbers[:, 0], n_b=numbers[:, 1], n_groups=numbers[:, 2], n_links=numbers[:, 3], same=same, same_times=same_times, odd=odd, odd_times=odd_times,
                    groups=[sha256(x.encode()).hexdigest() if y else "" for x, y in zip(got.text, got.fine, strict=True)],
                )
                pairs.append((odd.values.to_numpy(), odd_times.values.to_numpy()))
                weight += int(sizes.sum() + more.sum()) + DOC * n
                if weight >= SLICE:
                    yield ended()
                    pairs.clear()
                    now, weight = now + 1, 0
        if pairs:
            yield ended()
        used = np.flatnonzero(vector)
        yield batch(len(used), kind=["id"] * len(used), id=used, n=vector[used])

    return cut(picked(docs, doc_id=id_col, text=text_col).mapInArrow(run, schema))


def pair_counts(found: DataFrame, byte_bpe: str, piece_model: str) -> DataFrame:
    """a, b, n: how many links of the corpus hold each pair of ids; found as aligned gives it."""
    both = Aligner(byte_bpe, piece_model)
    equal = found.sparkSession.createDataFrame([(a, b) for a, b in enumerate(both.same.tolist()) if b >= 0], "a long, b long")  # as long as the vocabulary
    same = found.where("kind = 'id'").groupBy(F.col("id").alias("a")).agg(F.sum("n").alias("n")).join(F.broadcast(equal), "a").select("a", "b", "n")
    n_b = len(both.bytes_b)
    odd = found.where("kind = 'pair'").groupBy("id").agg(F.sum("n").alias("n")).select(F.expr(f"id div {n_b}").alias("a"), (F.col("id") % n_b).alias("b"), "n")
    return same.unionByName(odd)


def scored(found: DataFrame, byte_bpe: str, piece_model: str) -> DataFrame:
    """Per document doc_id, n_a, n_b, n_groups, n_links, groups, n_best (its links whose pair is the commonest of its B id) and count_sum
    (the pairs' counts over its links); found as aligned gives it."""
    both = Aligner(byte_bpe, piece_model)
    n_b, same_b = len(both.bytes_b), both.same
    counts = cut(pair_counts(found, byte_bpe, piece_model))
    of_a, best = np.zeros(len(same_b), np.int64), np.zeros(n_b, np.int64)
    equal = found.where("kind = 'id'").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # as long as the vocabularies, both
    of_a[equal["id"].to_numpy()] = equal["n"].to_numpy()
    most = counts.groupBy("b").agg(F.max("n").alias("n")).toArrow()
    best[most["b"].to_numpy()] = most["n"].to_numpy()
    asked = found.where("kind = 'pair'").select(F.col("slice").alias("of"), F.col("id").alias("pair"))
    answers = asked.join(counts.select((F.col("a") * n_b + F.col("b")).alias("pair"), "n"), "pair")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]
    rows = found.where("kind = 'doc'").select("slice", *columns, "same", "same_times", "odd", "odd_times")
    kinds = {f.name: f.dataType.simpleString() for f in found.schema}

    def sums(lists: pa.ListArray, values: np.ndarray) -> np.ndarray:
        past = np.concatenate([[0], np.cumsum(values)])
        to = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return past[to[1:]] - past[to[:-1]]

    def score(docs: pa.Table, known: pa.Table) -> pa.Table:
        one = lambda t, name: t[name].combine_chunks() if t.num_rows else pa.array([], t.schema.field(name).type)
        pair, n = one(known, "pair").to_numpy(), one(known, "n").to_numpy()
        order = np.argsort(pair)
        pair, n = pair[order], n[order]
        out, n_best, count_sum = {c: one(docs, c) for c in columns}, 0, 0
        for name in ("same", "odd"):
            ids, times = one(docs, name), one(docs, f"{name}_times").flatten().to_numpy()
            x = ids.flatten().to_numpy()
            count, b = (of_a[x], same_b[x]) if name == "same" else (n[np.searchsorted(pair, x)] if len(x) else x, x % n_b)
            n_best = n_best + sums(ids, times * (count == best[b]))
            count_sum = count_sum + sums(ids, times * count)
        return pa.table(out | {"n_best": n_best, "count_sum": count_sum})

    return rows.groupBy("slice").cogroup(answers.groupBy("of")).applyInArrow(score, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", n_best long, count_sum long")


def report(docs: DataFrame, byte_bpe: str, piece_model: str) -> DataFrame:
    """One row of figures for each row of docs; rows repeated or with a null id stay as they are, other columns don't matter."""
    return scored(aligned(docs, byte_bpe, piece_model), byte_bpe, piece_model).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
