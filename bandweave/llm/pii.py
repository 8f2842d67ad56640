"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, plus signs, digits, schemes,
identifier cues) in one pass. At each anchor a deterministic local parser
expands to both sides and validates what it has found. Parsers of the base kinds
give exactly the leftmost non-overlapping matches of the kind's expression; their
repetitions are possessive, so a text of any length takes linear time.

Further kinds: url (scheme://...), account (an IBAN that passes mod 97, or an
account number behind its cue) and secret (a credential behind its cue).
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_text

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "secret")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL_END = re.compile(r"[^\s<>\"'`{}|\\^\[\]]++")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_VALUE = re.compile(r"[\s\"':=#]{1,4}+(?:(?:no|number|nr|is)[.:]?\s)?[\"']?([A-Za-z0-9_\-/+.]++)")
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

#: Cues in the spellings looked for, by the kind of what follows them.
CUES = {
    "account": ("account", "acct", "routing", "iban", "passport", "ssn"),
    "secret": ("token", "api_key", "apikey", "secret", "password", "passwd", "access_key"),
}


@functools.lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in [("@", "@"), ("+", "+"), ("://", "url"), *((d, "digit") for d in "0123456789")]:
        found.add_word(word, (kind, len(word)))
    for kind, words in CUES.items():
        for w in words:
            for spelled in {w, w.upper(), w.capitalize()}:
                found.add_word(spelled, (kind, len(spelled)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


class _Parsers:
    """The matches of each kind in one text; ends keeps where the kind's last match ended, dropped or not."""

    def __init__(self, text: str):
        self.text, self.spans = text, {k: [] for k in KINDS}
        self.ends = dict.fromkeys(KINDS, 0)
        self.last_at, self.last_digit = -1, -2

    def email(self, at: int) -> None:
        low = max(self.ends["email"], self.last_at + 1)
        self.last_at = at
        start = low + len(self.text[low:at].rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(self.text, at + 1)):
            self.ends["email"] = m.end()
            self.spans["email"].append((start, m.end()))

    def number(self, at: int) -> None:
        if at == self.last_digit + 1:  # only the first digit of a run can start a match
            self.last_digit = at
            return
        self.last_digit = at
        if at >= self.ends["ip"] and (m := _IP.match(self.text, at)):
            self.ends["ip"] = m.end()
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in m.groups())):
                self.spans["ip"].append(m.span())
        if at >= self.ends["card"] and (m := _CARD.match(self.text, at)):
            self.ends["card"] = m.end()
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                self.spans["card"].append(m.span())

    def phone(self, at: int) -> None:
        if at >= self.ends["phone"] and (m := _PHONE.match(self.text, at)):
            self.ends["phone"] = m.end()
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                self.spans["phone"].append(m.span())

    def url(self, at: int) -> None:
        low = max(self.ends["url"], at - 16)
        start = low + len(self.text[low:at].rstrip(_LETTERS))
        if at - start >= 2 and (m := _URL_END.match(self.text, at + 3)):
            end = at + 3 + len(m[0].rstrip(".,;:!?)"))
            if end > at + 3:
                self.ends["url"] = end
                self.spans["url"].append((start, end))

    def account(self, at: int) -> None:
        if at < self.ends["account"] or not (m := _VALUE.match(self.text, at)):
            return
        iban = _IBAN.match(self.text, m.start(1))
        if iban and mod97(iban[0].replace(" ", "")):
            self._add("account", iban.span())
        else:
            value = m[1].rstrip(".-/+")
            if 6 <= sum(c in "0123456789" for c in value) and len(value) <= 34:
                self._add("account", (m.start(1), m.start(1) + len(value)))

    def secret(self, at: int) -> None:
        if at < self.ends["secret"] or not (m := _VALUE.match(self.text, at)):
            return
        value = m[1].rstrip(".")
        if len(value) >= 8 and any(c.isdigit() for c in value):
            self._add("secret", (m.start(1), m.start(1) + len(value)))

    def _add(self, kind: str, span: tuple[int, int]) -> None:
        self.ends[kind] = span[1]
        self.spans[kind].append(span)


def find_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans (start, end exclusive, in code points) by kind, ascending and non-overlapping within a kind."""
    p = _Parsers(text)
    for last, (kind, size) in _automaton().iter(text):
        if kind == "digit":
            p.number(last)
        elif kind == "@":
            p.email(last)
        elif kind == "+":
            p.phone(last)
        elif kind == "url":
            p.url(last + 1 - size)
        elif kind == "account":
            p.account(last + 1)
        else:
            p.secret(last + 1)
    return p.spans


def listed(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k in kinds for a, z in spans[k])


def redact(text: str, spans: dict[str, list[tuple[int, int]]] | None = None) -> str:
    """The text with each span replaced by its kind in square brackets; overlapping spans become one, named by the first."""
    found = spans if spans is not None else find_spans(text)
    merged: list[list] = []
    for a, z, k in sorted((a, z, k) for k, s in found.items() for a, z in s):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(z, merged[-1][1])
        else:
            merged.append([a, z, k])
    out, at = [], 0
    for a, z, k in merged:
        out += text[at:a], f"[{k.upper()}]"
        at = z
    return "".join([*out, text[at:]])


def pii_spans(docs: DataFrame) -> DataFrame:
    """A row for each document: counts of the base kinds, the base spans' digest, and all spans.

    Null and empty texts have no spans (the digest of nothing); texts of any
    length, with runs of digits or letters of any length, are searched whole in
    linear time; of spans of one kind that overlap the leftmost stands; repeated
    rows and null ids stay; further columns don't matter; an empty table gives
    an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find_spans(t) for t in b.column("text").to_pylist()]
            counts = [pa.array([len(s[k]) for s in found], pa.int64()) for k in BASE]
            digest = [hashlib.sha256(listed(s, BASE).encode()).hexdigest() for s in found]
            spans = [listed(s, KINDS) for s in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *counts, pa.array(digest), pa.array(spans)],
                names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
            )

    docs = with_text(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), "doc_id")
    return docs.mapInArrow(
        run, f"doc_id bigint, {', '.join(f'n_{k} bigint' for k in BASE)}, base_sha256 string, spans string"
    )


def redact_column(text):
    """Column expression: the text with personal data replaced; null stays null and empty text empty."""

    @F.pandas_udf("string")
    def redacted(texts):
        return texts.map(redact, na_action="ignore")

    return redacted(text)
