"""Cross-tokenizer alignment against brute force over whole texts."""

from __future__ import annotations

from collections import Counter
from hashlib import sha256

import pytest

from trailspark.llm import alignment
from trailspark.llm.entry import byte_bpe, piece_model

SCHEMA = "doc_id long, text string"
TEXTS = [
    None, "", "a", " ", "  ", "Hello world", "Hello world", "unaffordability of hyperparameterisation", " led by  two   spaces ", "line\nline two\n\n three\n  four\t five \n", "naïve café über straße",
    "日本語のテキスト 🙂 emoji", "<|endoftext|> plain <s> </s> <0x41>", "it's 12,345.67% of $9", "a▁b", "x y 　z", "​ ​q", "aaaa aaaaaaaa aaaaaaaaaaaaaaaa", "\x00 \x1c y\x85 z", "don't  won't\n 'll",
] + ["the quick brown fox jumps over the lazy dog " * 30]


def brute(both: alignment.Aligner, texts: list[str | None]) -> list[tuple]:
    """Every pair of tokens of a text by their byte ranges."""
    links, seen = [], []
    for text in texts:
        a = both.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = both.b.encode(text) if text else []
        if not text or not b"".join(both.bytes_a[i] for i in a) == b"".join(both.bytes_b[i] for i in b) == (" " + text).encode():
            links.append([])
            seen.append((0, 0, 0, 0, ""))
            continue
        spans = []
        for ids, of in ((a, both.bytes_a), (b, both.bytes_b)):
            at = 0
            spans.append([(at, at := at + len(of[i]), i) for i in ids])
        links.append([(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]])
        ends = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups = ["|".join(",".join(str(i) for s, e, i in side if begin <= s and e <= end) for side in spans) for begin, end in zip([0, *ends], ends, strict=False)]
        seen.append((len(a), len(b), len(ends), len(links[-1]), sha256(";".join(groups).encode()).hexdigest()))
    counts = Counter(x for found in links for x in found)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(*x[:4], sum(counts[p] == best[p[1]] for p in found), sum(counts[p] for p in found), x[4]) for x, found in zip(seen, links, strict=True)], counts


@pytest.fixture(scope="module")
def both():
    return alignment.Aligner(byte_bpe(), piece_model())


@pytest.mark.parametrize("limit", [1_000_000, 30])
def test_report_equals_brute_force(spark, both, monkeypatch, limit):
    """With one slice a task and with one for each few documents."""
    monkeypatch.setattr(alignment, "SLICE", limit)
    monkeypatch.setattr(alignment, "SLICE_ROWS", 256 if limit > 30 else 3)
    rows = spark.createDataFrame(list(enumerate(TEXTS)), SCHEMA).repartition(3)
    found = alignment.aligned(rows, byte_bpe(), piece_model())
    got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) for r in alignment.scored(found, byte_bpe(), piece_model()).collect()}
    expected, counts = brute(both, TEXTS)
    assert got == dict(enumerate(expected))
    assert {(r["a"], r["b"]): r["n"] for r in alignment.pair_counts(found, byte_bpe(), piece_model()).collect()} == counts


def test_chunks_give_what_whole_texts_give(both):
    assert not both.whole
    for text in TEXTS[1:]:
        a, b = both.ids(alignment.chunks(text))
        assert (sum(a, []), sum(b, [])) == (both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text) or sum(b, []))


def test_whole_texts_where_chunks_do_not_hold(both, monkeypatch):
    monkeypatch.setattr(both, "whole", True)
    got, of = both.of_texts(TEXTS)
    expected, _ = brute(both, TEXTS)
    assert [bool(x[0]) for x in expected] == got.fine.tolist()
    assert {i: tuple(got.numbers[k]) for k, i in enumerate(of.tolist()) if got.fine[i]} == {i: x[:4] for i, x in enumerate(expected) if x[0]}


def test_table_starts_anew(both, monkeypatch):
    monkeypatch.setattr(alignment, "TABLE_ENTRIES", 2)
    for text in TEXTS * 2:
        got, _ = both.of_texts([text])
        assert got.numbers.sum(axis=0).tolist() == list(brute(both, [text])[0][0][:4])


def test_odd_rows(spark):
    """An empty table; repeated and null ids; clashing columns."""
    assert alignment.report(spark.createDataFrame([], SCHEMA), byte_bpe(), piece_model()).count() == 0
    rows = spark.createDataFrame([(1, "a b", 1, 2), (1, "a b", 1, 2), (None, "c", 3, 4), (2, None, 5, 6)], "doc_id long, text string, slice long, n_a long")
    got = alignment.report(rows, byte_bpe(), piece_model()).collect()
    assert sorted((r["doc_id"] or 0, r["n_a"], r["n_links"], r["count_sum"], r["groups_sha256"] == "") for r in got) == [(0, 1, 1, 1, False), (1, 2, 2, 4, False), (1, 2, 2, 4, False), (2, 0, 0, 0, True)]
