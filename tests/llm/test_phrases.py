"""Phrases of whole texts against a plain parser that looks for each phrase in the sample."""

from __future__ import annotations

import numpy as np
import pytest

from bandweave.llm import langid


def plain(sample: bytes, text: bytes) -> int:
    """Phrases by the longest match from where the last one ended; a letter that isn't in the sample is one of its own."""
    at = count = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample and text[at : at + n] in sample:
            n += 1
        at, count = at + n, count + 1
    return count


def words(rng, letters, n):
    return " ".join("".join(rng.choice(list(letters), rng.integers(1, 9))) for _ in range(n))


@pytest.fixture
def known():
    rng = np.random.default_rng(1)
    return langid.Parser({"x": langid.letters(words(rng, "abcdé", 400)).tobytes(), "y": langid.letters(words(rng, "bcxyz", 300)).tobytes()}), rng


def check(known, texts, samples):
    got = langid.count_phrases(known, texts)
    for row, lang in enumerate(known.langs):
        assert got[row].tolist() == [plain(samples[lang], langid.letters(t).tobytes()) for t in texts]


@pytest.mark.parametrize("lane, batch, cut", [(384, 1 << 19, None), (7, 300, None), (5, 64, 100), (1, 50, 40)])
def test_counts_are_those_of_one_parse(monkeypatch, lane, batch, cut):
    rng = np.random.default_rng(2)
    samples = {"x": langid.letters(words(rng, "abcdé", 400)).tobytes(), "y": langid.letters(words(rng, "bcxyz", 300)).tobytes()}
    known = langid.Parser(samples)
    monkeypatch.setattr(langid, "LANE", lane)
    monkeypatch.setattr(langid, "BATCH_BYTES", batch)
    if cut:
        whole = langid.cut_long
        monkeypatch.setattr(langid, "cut_long", lambda d, o: whole(d, o, cut))
    texts = [words(rng, letters, int(n)) for letters, n in zip(["abcdé", "bcxyz", "aq", "dz é"] * 10, rng.integers(0, 300, 40), strict=True)]
    texts += ["", " ", "  a  ", " leading", "trailing ", "a" * 2000, "ab" * 900, "q" * 1000, "½ 12", "abc  " * 300, "é" * 700]
    check(known, texts, samples)


def test_a_text_does_not_depend_on_its_neighbours(known):
    parser, rng = known
    texts = [" abc bcd ", " bcx", "abc ", " ", "\n\nabc\n", words(rng, "abcxyz", 900)]
    alone = np.concatenate([langid.count_phrases(parser, [t]) for t in texts], axis=1)
    assert langid.count_phrases(parser, texts).tolist() == alone.tolist()


def test_lanes_that_never_meet_are_parsed_alone(known, monkeypatch):
    parser, _ = known
    monkeypatch.setattr(langid, "LANE", 3)
    called = []
    plain_alone = langid.Parser.alone
    monkeypatch.setattr(langid.Parser, "alone", lambda self, c: (called.append(len(c)), plain_alone(self, c))[1])
    text = "abcd" * 50
    assert langid.count_phrases(parser, [text]).T.tolist() == [plain_alone(parser, langid.letters(text))]
