"""Phrases against brute force and against their SQL."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from trailspark.llm import phrases

SCHEMA = "doc_id long, text string, lang string"


def brute(rows: list[tuple], top: int = 2000) -> dict[str, list[tuple]]:
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        f = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for i in range(len(words)):
                for k in range(1, 5):
                    if i + k <= len(words):
                        f[tuple(words[i : i + k])] += 1
    out = {}
    for lang, f in counts.items():
        cands = {}
        for p, a in f.items():
            if len(p) > 1 and a >= 30:
                score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                cands[p] = (a, f[p[:k]], f[p[k:]], score)
        inside = Counter()
        for q, (a, *_) in cands.items():
            for m in range(2, len(q)):
                for i in range(len(q) - m + 1):
                    inside[q[i : i + m]] = max(inside[q[i : i + m]], a)
        kept = [(p, *x) for p, x in cands.items() if not (p in inside and 100 * inside[p] >= 80 * x[0])]
        kept.sort(key=lambda x: (-x[4], -x[1], " ".join(x[0]).encode()))
        out[lang] = [(i + 1, " ".join(p), a, l, r, totals[lang], s) for i, (p, a, l, r, s) in enumerate(kept[:top])]
    return {k: v for k, v in out.items() if v}


def made(n: int) -> list[tuple]:
    """Texts of few words with fixed phrases, ties, blanks, signs and letters of two bytes."""
    pick = random.Random(3)
    fixed = ["New York city hall", "ad hoc", "où est été", "a a a a", "one two three", "Ça va"]
    rows = [(None, None, "en"), (1, "", "en"), (2, None, None), (3, " \t\n", "xx")]
    for i in range(n):
        words = [pick.choice(fixed) if pick.random() < 0.3 else pick.choice("the of and to in é word List".split()) + pick.choice(["", "", ",", "!", "\n", "\x0b", "\t", "  "]) for _ in range(pick.randrange(1, 40))]
        rows.append((i, " ".join(words), pick.choice(["en", "en", "fr", None])))
    return rows + rows[:9]


def found(rows) -> dict[str, list[tuple]]:
    out = {}
    for r in rows.collect():
        out.setdefault(r["lang"], []).append(tuple(r[c] for c in ("rank", "phrase", "a", "l", "r", "n", "score")))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("part", [1 << 22, 200])
def test_report_equals_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(phrases, "PART", part)
    rows = made(600)
    expected = brute(rows)
    assert sum(map(len, expected.values())) > 30
    assert found(phrases.report(spark.createDataFrame(rows, SCHEMA).repartition(3))) == expected


def test_first_of_each_language(spark):
    rows = made(600)
    assert found(phrases.report(spark.createDataFrame(rows, SCHEMA), top=7)) == brute(rows, 7)


def test_parts_see_the_words_that_lead(monkeypatch):
    """Windows across the end of a part are those of the whole."""
    texts, langs = [b"a b c d e. f g", b"", b"h  i j k\tl m n o p"], ["x", "y", "x"]

    def windows(part: int) -> list[tuple]:
        monkeypatch.setattr(phrases, "PART", part)
        out = []
        for w in phrases.split(texts, langs, phrases.Powers()):
            for i in range(w.counted):
                n = 1
                while n < 4 and w.leads[i + n - 1]:
                    n += 1
                out.append((langs[w.lang[i]], *(w.data[w.start[j] : w.end[j]] for j in range(i, i + n)), *w.hash[i : i + n].tolist()))
        return out

    whole = windows(1000)
    assert [x[1:5] for x in whole if x[1] in (b"d", b"l")] == [(b"d", b"e", whole[3][3], whole[3][4]), (b"l", b"m", b"n", b"o")]
    assert all(windows(part) == whole for part in (1, 3, 5, 11))


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    rows = spark.createDataFrame([("en", ["a"], "a", big), ("en", ["b"], "b", big - 1), ("en", ["a", "b"], "a b", big - 3)], "lang string, words array<string>, phrase string, n long")
    assert phrases.scored(rows).first()["score"] == 2000000 * (big - 3) // (2 * big - 1)
    rows = spark.createDataFrame([("en", ["a", "b"], "a b", big), ("en", ["a", "b", "c"], "a b c", big // 10 * 8), ("en", ["b", "c"], "b c", big)], "lang string, words array<string>, phrase string, a long")
    assert {r["phrase"] for r in phrases.whole(rows).collect()} == {"a b c"}


def test_odd_rows(spark):
    """An empty table, and clashing columns."""
    assert phrases.report(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame([(i, "alpha beta gamma", None, "x", 1) for i in range(30)], "doc_id long, text string, lang string, w1 string, n long")
    assert found(phrases.report(rows)) == {"und": [(1, "alpha beta gamma", 30, 30, 30, 90, 1000000)]}
