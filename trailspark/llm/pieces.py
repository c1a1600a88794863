"""SentencePiece encoding and decoding by a distinct-chunk table.

No piece of the vocabulary has a marker after another character, so a merge never crosses the place where a run of
markers begins. A text is therefore cut there, each distinct marked word is segmented once for a task's table, and
the ids are gathered back by position. `crossing_pieces` proves the condition for a vocabulary, and a few probes look at its
normaliser; with a vocabulary that breaks either, whole texts are segmented instead.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Numbers, mapped, picked

MARK = "▁"
#: Entries after which a task starts its table anew; bounds memory, never the result.
TABLE_ENTRIES = 300_000


def load(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def crossing_pieces(sp) -> list[int]:
    """Ids of pieces in which a marker follows another character."""
    return [i for i in range(sp.get_piece_size()) if re.search(f"[^{MARK}]{MARK}", sp.id_to_piece(i))]


#: Texts on which words apart must give what the whole gives; they show a normaliser or white-space settings that tie words together.
PROBES = ("a b", " a", "a  b", "a   b ", "\ta\nb", "\u3000x y\u00a0z", "\ufb01 \u2460", "e\u0301 \u00e9", "A b\u200bc", "\u2581a \u2581", "1 000,5 %")


def cut_marked(text: str) -> list[str]:
    """The marked words of a text, each without its first marker."""
    if not text:
        return []
    if "  " not in text and MARK not in text and text[0] != " ":
        return text.split(" ")
    return [x[1:] for x in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]


class ChunkTable:
    """Distinct marked words of a task: number by word, ids by number."""

    def __init__(self, model: str):
        self.sp = load(model)
        self.whole = bool(crossing_pieces(self.sp))
        self.clear()
        self.whole = self.whole or self.encode(list(PROBES)).to_pylist() != [self.sp.encode(x, add_eos=True) for x in PROBES]
        self.clear()

    def clear(self) -> None:
        self.numbers, self.done = Numbers(), 1
        self.numbers[None] = 0  # the end of a text
        self.ids, self.size = np.array([self.sp.eos_id()], np.int32), np.array([1], np.int64)

    def segment_new(self) -> None:
        new = list(self.numbers)[self.done :] if len(self.numbers) > self.done else []
        if new:
            found = self.sp.encode(new, num_threads=1)
            if not self.whole:
                found = [x or [self.sp.piece_to_id(MARK)] for x in found]
            self.size = np.append(self.size, np.fromiter(map(len, found), np.int64, len(found)))
            self.ids = np.append(self.ids, np.array([i for x in found for i in x], np.int32))
            self.done += len(new)

    def encode(self, texts: list[str | None]) -> pa.Array:
        if len(self.numbers) > TABLE_ENTRIES:
            self.clear()
        number, at, ends = self.numbers.__getitem__, [], []
        for text in texts:
            at.extend(map(number, ([text] if text else []) if self.whole else cut_marked(text or "")))
            at.append(0)
            ends.append(len(at))
        self.segment_new()
        at = np.array(at, np.int64)
        size, first = self.size[at], (np.cumsum(self.size) - self.size)[at]
        past = np.cumsum(size)
        ids = self.ids[np.repeat(first - past + size, size) + np.arange(past[-1] if len(past) else 0)]
        offsets = np.concatenate([[0], past[np.array(ends, np.int64) - 1]]) if ends else np.zeros(1, np.int64)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: the ids of each whole text, of any length, and an end id. A null text counts as empty: the end id alone. Repeated
    rows and null ids stay as they are; an empty table gives an empty one; other columns are left out, whatever their names."""
    return mapped(
        picked(docs, doc_id=id_col, text=text_col),
        lambda rows, known: {"doc_id": rows["doc_id"], "ids": known.encode(rows["text"].to_pylist())},
        f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>",
        lambda: ChunkTable(model),
    )


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded (doc_id, ids) and the decoded text, of any length. Null or empty ids give an empty text; repeated rows and null doc_ids stay; an
    empty table gives an empty one; other columns of encoded, one named text among them, are left out."""
    return mapped(
        encoded.select("doc_id", "ids"),
        lambda rows, sp: {"doc_id": rows["doc_id"], "ids": rows["ids"], "text": pa.array(sp.decode([x or [] for x in rows["ids"].to_pylist()], num_threads=1), pa.string())},
        f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string",
        lambda: load(model),
    )


def digests(docs: DataFrame, model: str) -> DataFrame:
    """Per document its number of ids and the digests of its ids and of the decoded text."""
    return decode(encode(docs, model), model).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
