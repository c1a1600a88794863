"""SimHash near-duplicates against brute force."""

from __future__ import annotations

import re

import pytest
import xxhash
from pyspark.sql import functions as F

from trailspark.llm import simhash

SCHEMA = "doc_id long, text string"


def print_of(text: str | None, words: int = 3) -> int:
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_ids(prints: dict[int, int]) -> dict[int, int]:
    """Of ids with their prints, by a walk from the smallest id on."""
    left, out = dict(prints), {}
    for first in sorted(prints):
        todo = [first] if first in left else []
        while todo:
            at = todo.pop()
            if at in left:
                p = left.pop(at)
                out[at] = first
                todo += [k for k, q in left.items() if (p ^ q).bit_count() <= 2]
    return out


TEXTS = [None, "", " \t\n\x0b", "one", "One", "two words", "Ä b c d", "a b c", "A  b\nC", "x y z " * 50, "x y z " * 50 + "q", "İstanbul ÉTÉ ONE two", "a b c d e f g h i j", "a b c d e f g h i k"]


def test_fingerprints_equal_brute_force():
    for text in TEXTS:
        for words in (1, 3, 5):
            assert simhash.fingerprint((text or "").encode(), words) == print_of(text, words)


def test_parts_lose_no_shingle(monkeypatch):
    text = " ".join(f"w{i * i % 97}" for i in range(500)) + "  "
    whole = simhash.fingerprint(text.encode())
    for part in (1, 7, 50, 400):
        monkeypatch.setattr(simhash, "PART", part)
        assert simhash.fingerprint(text.encode()) == whole == print_of(text)
        assert simhash.fingerprint(b"only  two") == print_of("only two")


def test_hash_is_that_of_spark(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    assert got % 2**64 == print_of("a b c")


@pytest.mark.parametrize("small", [64, 1, 3])
def test_links_equal_brute_force(spark, monkeypatch, small):
    """Prints around some centres, up to four bits off, and a whole ball of one bit; small group sizes take the way of large keys."""
    monkeypatch.setattr(simhash, "SMALL", small)
    centres = [0, 0x0123456789ABCDEF, (1 << 64) - 1, 0xF00F00FF12345678]
    found = {c for c in centres}
    for c in centres:
        for i in range(40):
            p = c
            for k in range(1 + i % 4):
                p ^= 1 << (i * 29 + k * 17 + i // 4) % 64
            found.add(p)
    found |= {centres[1] ^ 1 << i for i in range(64)}
    prints = dict(enumerate(sorted(found)))
    rows = spark.createDataFrame([(i, simhash.signed(p)) for i, p in prints.items()], "doc_id long, print long")
    assert {tuple(r) for r in rows.join(simhash.classes(rows), "print").select("doc_id", "component_id").collect()} == set(component_ids(prints).items())


def test_report_equals_brute_force(spark):
    base = " ".join(f"word{i}" for i in range(400))
    texts = [*TEXTS, base, base + " more", base.replace("word7 ", "other "), base.upper(), *(base + f" t{i}" for i in range(30)), *TEXTS]
    rows = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    prints = {i: print_of(x) for i, x in enumerate(texts)}
    expected = component_ids(prints)
    assert {tuple(r) for r in simhash.report(rows).collect()} == {(i, f"{p:016x}", expected[i]) for i, p in prints.items()}


def test_odd_rows(spark):
    """Empty tables, null and repeated ids, clashing columns."""
    assert simhash.report(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d", 1, 2), (5, "a b c d", 1, 2), (5, "other", 3, 4), (None, "lonely", 5, 6), (9, None, 7, 8)], "doc_id long, text string, `print` long, component_id long")
    got = sorted(((r["doc_id"], r["component_id"], r["fingerprint"]) for r in simhash.report(rows).collect()), key=str)
    assert got == sorted([(None, 5, f"{print_of('a b c d'):016x}"), (5, 5, f"{print_of('a b c d'):016x}"), (5, 5, f"{print_of('other'):016x}"), (None, None, f"{print_of('lonely'):016x}"), (9, 9, "0" * 16)], key=str)


def test_keys_cover_all_near_prints():
    """Any two bits leave one choice of blocks untouched."""
    masks = simhash.key_masks()
    assert all(any(not m & (1 << i | 1 << j) for m in masks) for i in range(64) for j in range(64))
