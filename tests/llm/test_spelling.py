"""Spelling variants against brute force over all pairs of words."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bandweave.llm import spelling
from bandweave.llm.common import table


def near(a: str, b: str) -> bool:
    if len(a) < len(b):
        a, b = b, a
    if a == b or len(a) - len(b) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def slow_variants(counts: dict[str, int], ratio: int = 10) -> set:
    """By deletions, which leave equal strings of near words."""
    holders: dict[str, set] = {}
    for w in counts:
        for i in range(len(w)):
            holders.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    mates = {w: set() for w in counts}
    for short, group in holders.items():
        group = group | ({short} & counts.keys())
        for a in group:
            mates[a] |= {b for b in group if b not in mates[a] and near(a, b)}
    form = {}
    for w, n in counts.items():
        best = min(mates[w], key=lambda m: (-counts[m], m), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(mates[w]), counts[form[w]] if form[w] else None))
    return out


def slow_counts(rows, least=7, drop=31) -> Counter:
    counts: Counter = Counter()
    lower = {c: c + 32 for c in range(65, 91)}
    for i, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            w, run = run.translate(lower), ""
            if w:
                h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
                if h % drop == 0:
                    w = w[: h % len(w)] + w[h % len(w) + 1 :]
                if len(w) >= least:
                    counts[w] += 1
    return counts


def result(df) -> set:
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_whole_table_matches_brute_force(spark, data):
    docs = table(spark, data, "documents")
    counts = slow_counts((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert result(spelling.spelling_variants(docs)) == slow_variants({w: n for w, n in counts.items() if n >= 2})


HARD = [
    (1, None),
    (2, ""),
    (3, "ÀÉÎÕÜßÿ Àéîõüßÿ àéîõüßÿ ABCDEFG×HIJK÷lm short naïveté"),
    (3, "ÀÉÎÕÜßÿ Àéîõüßÿ àéîõüßÿ ABCDEFG×HIJK÷lm short naïveté"),
    (None, "nobody knows the elephants elephants elephant"),
    (4, "z" * 3000 + " " + "z" * 3000 + "y"),
    (5, "z" * 3000 + " " + "z" * 3000 + "y"),
    (6, "北京 elephant🙂elephants\u0000elephants_elephant7elephants"),
]


def test_hard_rows(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SLICE_CHARS", 1000)
    df = spark.createDataFrame([(i, t, 1, "w") for i, t in HARD], "doc_id long, text string, n int, word string")
    wanted = slow_variants({w: n for w, n in slow_counts(HARD).items() if n >= 2})
    assert result(spelling.spelling_variants(df)) == wanted
    assert spelling.spelling_variants(df.where("false")).count() == 0


@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_crowded_blocks_are_tiled(spark, monkeypatch, letters):
    """Short words over few letters, all of which meet; tiles of a few words and matrices of a few rows."""
    monkeypatch.setattr(spelling, "TILE", 5)
    monkeypatch.setattr(spelling, "CELLS", 200)
    rng = random.Random(6)
    counts = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))): 2 * 10 ** rng.randint(0, 4) for _ in range(600)}
    df = spark.createDataFrame([(w, n, 1) for w, n in counts.items()], "word string, n long, length int")
    assert result(spelling.variants(df)) == slow_variants(counts)


def test_chains_are_followed_to_the_end(spark):
    words = ["abcdefghij"[: 10 - k] for k in range(8)]
    df = spark.createDataFrame([(w, 2 * 10**k) for k, w in enumerate(words)], "word string, n long")
    got = spelling.variants(df)
    assert result(got) == slow_variants({w: 2 * 10**k for k, w in enumerate(words)})
    assert got.where(F.col("root") == words[-1]).count() == len(words)
