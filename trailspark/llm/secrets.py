"""Secret scan: fixed patterns, and password guess-cost dynamic programming on values in a credential context.

The cost of a value is the least sum, over all ways to cut it into dictionary words, dates, repeats, keyboard walks and
brute-force spans, of the spans' guesses (log10). A value dearer than `least_cost` adds a span of kind `cost`. Words are ranked:
the common passwords below, then the words of a vocabulary file, commonest first.
"""

from __future__ import annotations

import base64
import math
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, picked

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Where the method looks for values that the fixed patterns may not know: quoted ones to their closing quote.
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|pw|secret|token|credential|auth|(?:api|access|private)[_-]?key)["']?[ \t]*[:=]+[ \t]*(?:"((?:\\.|[^"\\\r\n]){6,})"|'((?:\\.|[^'\\\r\n]){6,})'|["']?([^\s"'<>;,]{6,}))""", re.I | re.A)
CONTEXT_WORDS = (b"pass", b"pwd", b"pw", b"secret", b"token", b"credential", b"auth", b"key")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")
KINDS = ("assign", "access", "hex", "cost")

#: Common passwords and words, most common first; the rank is the number of guesses.
WORDS = (
    "password 123456 qwerty admin letmein welcome monkey dragon master login abc123 iloveyou princess sunshine football "
    "baseball shadow superman batman trustno1 hello freedom whatever secret test guest root user pass changeme default "
    "example sample token key api access private public love summer winter spring autumn monday friday january march "
    "april june july august october december house water music money family friend happy computer internet server "
    "database system network security company office london paris berlin madrid orange banana apple flower "
    "correct horse battery staple the and for you that with this from have"
).split()
#: Letters of the longest word that is looked for.
LONGEST = 20


@lru_cache(maxsize=4)
def ranked(vocabulary: str | None) -> dict[str, int]:
    """Rank by word: WORDS, then the words of three letters or more of a vocabulary (lines of a base64 token and its rank), in its order."""
    words = list(WORDS)
    if vocabulary:
        with open(vocabulary, "rb") as lines:
            for line in lines:
                word = base64.b64decode(line.split()[0]).strip().lower()
                if 3 <= len(word) <= LONGEST and word.isalpha():
                    words.append(word.decode("ascii"))
    return {w: i + 1 for i, w in enumerate(dict.fromkeys(words))}


#: Rows of the common keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
STEP = {a + b for row in ROWS for x in (row, row[::-1]) for a, b in zip(x, x[1:])} | {a + b for x in zip(*ROWS[1:]) for a, b in zip(x, x[1:])} | {a + b for x in zip(*ROWS[1:]) for a, b in zip(x[::-1], x[::-1][1:])}
DATE = re.compile(r"(?=((?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\2(?:0[1-9]|[12]\d|3[01])))|(?=((?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\4(?:19|20)\d\d))|(?=((?:19|20)\d\d))")
LEAST_COST = 10.0


def char_cost(c: str) -> float:
    """log10 of the class of a character: the guesses for one brute-force character."""
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100)


def spans_of(value: str, rank_of: dict[str, int]) -> list[tuple[int, int, float, str]]:
    """All known spans of a value: start, end, cost, kind."""
    low, n, found = value.lower(), len(value), []
    low = value if len(low) != n else low
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            if rank := rank_of.get(low[i:j]):
                plain = value[i:j] == low[i:j]
                found.append((i, j, math.log10(rank) + (0 if plain else math.log10(2 * (j - i))), "word"))
    for m in DATE.finditer(value):
        for g in (1, 3, 5):
            if m[g]:
                found.append((m.start(), m.start() + len(m[g]), math.log10(36500 if g < 5 else 150), "date"))
    for kind, joined, cost in (("repeat", lambda a, b: a == b, char_cost), ("walk", lambda a, b: a + b in STEP or a + b in "abcdefghijklmnopqrstuvwxyz", lambda _: math.log10(47))):
        i = 0
        while i < n:
            j = i + 1
            while j < n and joined(low[j - 1], low[j]):
                j += 1
            if j - i >= 3:
                found.append((i, j, cost(value[i]) + math.log10(j - i), kind))
            i = j
    return found


@lru_cache(maxsize=4096)
def guess_cost(value: str, vocabulary: str | None = None) -> float:
    """log10 of the guesses that the cheapest segmentation takes; 0 for an empty value."""
    ending: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost, _ in spans_of(value, ranked(vocabulary)):
        ending.setdefault(j, []).append((i, cost))
    best = [0.0]
    for j in range(1, len(value) + 1):
        best.append(min([best[j - 1] + char_cost(value[j - 1])] + [best[i] + cost + math.log10(2) for i, cost in ending.get(j, ())]))
    return best[-1]


HEX_TO_X = bytes(ord("x") if chr(b) in "0123456789abcdef" else ord(".") for b in range(256))


def scan(text: str | None, least_cost: float = LEAST_COST, vocabulary: str | None = None) -> list[tuple[str, int, int]]:
    """All spans of a text, by start, then kind as in KINDS: kind, start, end in code points."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    low, found = raw.lower(), []
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in raw.translate(HEX_TO_X):
        found += [("hex", *m.span()) for m in HEX.finditer(text)]
    if any(w in low for w in CONTEXT_WORDS):
        found += [("cost", *m.span(m.lastindex)) for m in CONTEXT.finditer(text) if guess_cost(m[m.lastindex], vocabulary) >= least_cost]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def find_secrets(docs: DataFrame, least_cost: float = LEAST_COST, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, found array<struct<kind, start, end>> of every whole text, of any length. A null or empty text has none; repeated rows,
    null ids and empty tables pass through; other columns are left out. vocabulary: a file that every executor has."""
    return mapped(
        picked(docs, doc_id=id_col, text=text_col),
        lambda rows: {"doc_id": rows["doc_id"], "found": [[dict(zip(("kind", "start", "end"), x)) for x in scan(t, least_cost, vocabulary)] for t in rows["text"].to_pylist()]},
        f"doc_id {docs.schema[id_col].dataType.simpleString()}, found array<struct<kind string, start long, end long>>",
    )


def report(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The digest columns of find_secrets."""
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    text = lambda found: F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    return find_secrets(docs, vocabulary=vocabulary).select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(text(F.filter("found", lambda x: x["kind"] != "cost")), 256).alias("base_sha256"), text(F.col("found")).alias("spans"),
    )
