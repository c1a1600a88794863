"""SimHash near-duplicates by pigeonhole blocks.

A document's fingerprint has a bit for each bit of its shingles' hashes: 1 where over half of them have it. A fingerprint is split
into BLOCKS blocks; two that differ in at most DISTANCE bits agree in BLOCKS - DISTANCE whole blocks, so under one choice of that
many blocks they have the same key. Distinct fingerprints are joined on these keys and their Hamming distance is verified.

A key of more than SMALL fingerprints isn't spelled out in pairs: there each fingerprint names itself and all that differ from it in
one bit outside the key. Two of the key differ in at most two bits if and only if they name one in common, and no name has more than
one owner a bit, so the group falls into small ones however large it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..operators.components import components
from .common import cut, mapped, picked

#: Words in a shingle, and bits in which linked fingerprints differ at most.
WORDS, DISTANCE = 3, 2
#: Blocks of a fingerprint: choices of 3 of 5 give ten keys of 38 or 39 bits, which few unlike fingerprints share even among 10**10.
BLOCKS = 5
#: Fingerprints of one key that are compared in pairs.
SMALL = 64
#: Bytes of a text, about, that are cut into words and hashed at a time; it bounds memory, never the result.
PART = 1 << 20

BLANK = re.compile(rb"[\x20\x09-\x0d]")


def parts(text: bytes, words: int) -> Iterator[list[bytes]]:
    """The lower-cased words of a text in lists, each after the last words - 1 of the one before, so that no shingle is lost."""
    at, held = 0, []
    while at < len(text):
        blank = BLANK.search(text, at + PART)
        end = blank.start() if blank else len(text)
        held = held[max(0, len(held) - words + 1) :] + text[at:end].lower().split()
        yield held
        at = end


def hashes(text: bytes, words: int) -> Iterator[list[int]]:
    """XXH64 of each shingle, seed 42; of the whole sequence, where it is shorter than a shingle."""
    some, last = False, []
    for last in parts(text, words):
        if found := [xxh64_intdigest(b" ".join(x), 42) for x in zip(*(last[k:] for k in range(words)), strict=False)]:
            some = True
            yield found
    if last and not some:
        yield [xxh64_intdigest(b" ".join(last), 42)]


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Zero where there is no word."""
    total, n = np.zeros(64, np.int64), 0
    for found in hashes(text, words):
        total += np.unpackbits(np.array(found, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(found)
    return int.from_bytes(np.packbits(2 * total > n).tobytes())


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, print (64 bits as a long) of each row. Null and empty texts and those of blanks alone have print 0."""
    return mapped(
        picked(docs, doc_id=id_col, text=text_col),
        lambda rows: {"doc_id": rows["doc_id"], "print": np.array([fingerprint(x or b"", words) for x in rows["text"].cast("binary").to_pylist()], np.uint64).view(np.int64)},
        f"doc_id {docs.schema[id_col].dataType.simpleString()}, print long",
    )


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def key_masks() -> list[int]:
    """The bits of each choice of BLOCKS - DISTANCE blocks."""
    ends = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:], strict=False)]
    return [sum(x) for x in combinations(blocks, BLOCKS - DISTANCE)]


def keys(f: Column) -> Column:
    """The keys of a fingerprint: number of the choice, bits of its blocks."""
    return F.array(*(F.struct(F.lit(c).alias("choice"), f.bitwiseAND(F.lit(signed(m))).alias("key")) for c, m in enumerate(key_masks())))


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(known: DataFrame) -> DataFrame:
    """a, b: links between distinct fingerprints (known, print) that connect all which differ in at most DISTANCE bits, through others
    or at once. Groups of one key up to SMALL are compared in pairs; larger ones by the names of their members."""
    keyed = known.select("print", F.explode(keys(F.col("print"))).alias("k")).select("print", "k.*")
    groups = cut(keyed.groupBy("choice", "key").agg(F.count("*").alias("n"), F.min("print").alias("a"), F.max("print").alias("b")).where("n > 1"))
    members = cut(keyed.join(groups.where("n > 2").select("choice", "key", "n"), ["choice", "key"]))
    few = members.where(F.col("n") <= SMALL).select("choice", "key", "print")
    pairs = few.withColumnRenamed("print", "a").join(few.withColumnRenamed("print", "b"), ["choice", "key"]).where("a < b").select("a", "b")

    f, mask = F.col("print"), F.element_at(F.array(*(F.lit(signed(m)) for m in key_masks())), F.col("choice") + 1)
    flips = (F.when(mask.bitwiseAND(F.lit(signed(1 << i))) == 0, f.bitwiseXOR(F.lit(signed(1 << i)))) for i in range(64))
    named = members.where(F.col("n") > SMALL).select("choice", f, F.explode(F.array(f, *flips)).alias("name")).where("name is not null")
    owners = named.groupBy("choice", "name").agg(F.collect_set("print").alias("all")).where(F.size("all") > 1)  # one a bit outside the key at most
    stars = owners.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a < b")
    found = groups.where("n = 2").select("a", "b").unionByName(pairs).unionByName(stars)
    return found.where(differing(F.col("a"), F.col("b")) <= DISTANCE)


def classes(prints: DataFrame) -> DataFrame:
    """print, component_id of each distinct fingerprint of prints (doc_id, print): the smallest doc_id reachable by links. Null ids are
    never the smallest; a component that has no other gets null."""
    known = cut(prints.groupBy("print").agg(F.min("doc_id").alias("first")))
    found = cut(components(links(known.select("print"))).select(F.col("v").alias("print"), "label"))
    least = found.join(known, "print").groupBy("label").agg(F.min("first").alias("least"))
    linked = found.join(least, "label").select("print", "least")
    return known.join(linked, "print", "left").select("print", F.coalesce("least", "first").alias("component_id"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row; rows that repeat an id stay, each with its own text's print. An
    empty table gives an empty one; other columns of docs don't matter."""
    prints = cut(fingerprints(docs))
    return prints.join(classes(prints), "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")

