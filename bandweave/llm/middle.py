"""Fill-in-middle transformation: texts cut at token boundaries and put in another order behind marks.

Tokens are runs of ASCII letters and every other code point. A wavelet matrix
over the classes of a slice's code points counts boundaries: what begins a token
is a code point of class OTHER or FIRST. A text's number of tokens is a difference
of two counts, and a cut is found by bisection on them, for all texts at once.

A null text is an empty one; a null id is hashed as an empty string and stays
null; repeated rows give equal rows; a text of any length is cut whole; further
columns are left behind; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, text_buffers, with_text
from .wavelet import BitVector, WaveletMatrix, first_reaching

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode())
OTHER, FIRST, INNER = 0, 1, 2
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _letters() -> np.ndarray:
    out = np.zeros(256, bool)
    out[65:91] = out[97:123] = True
    return out


LETTERS = _letters()


class Boundaries:
    """Token boundaries of the code points of consecutive UTF-8 texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        leads = (data & 0xC0) != 0x80
        self._leads = BitVector(leads)
        self.texts = self._leads.rank(offsets)
        letter = LETTERS[data[leads]]
        inner = np.zeros(len(letter), bool)
        inner[1:] = letter[1:] & letter[:-1]
        inner[self.texts[:-1][np.diff(self.texts) > 0]] = False  # no token crosses texts
        self._classes = WaveletMatrix(np.where(inner, INNER, np.where(letter, FIRST, OTHER)).astype(np.uint8), 2)

    def count(self, ends: np.ndarray) -> np.ndarray:
        """Tokens that begin before each code point."""
        return self._classes.rank(OTHER, ends) + self._classes.rank(FIRST, ends)

    def cut(self, tokens: np.ndarray) -> np.ndarray:
        """The code point at which so many tokens of each text have ended."""
        low, high = self.texts[:-1], self.texts[1:]
        return first_reaching(self.count, low, high, self.count(low) + tokens + 1)

    def byte(self, places: np.ndarray) -> np.ndarray:
        return self._leads.select(places)


def _arranged(text: bytes, a: int, z: int, form: str) -> bytes:
    p, s, m = MARKS
    if form == "plain":
        return text
    if form == "spm":
        return b"".join((s, text[z:], p, text[:a], m, text[a:z]))
    return b"".join((p, text[:a], s, text[z:], m, text[a:z]))


def _transformed(batches: Iterator[pa.RecordBatch], plain_from: int, spm_below: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, h = batch.column("doc_id"), [batch.column(f"h{k}").to_numpy() for k in range(1, 5)]
        whole, offsets = text_buffers(batch.column("text"))
        for row, end in pieces(offsets):
            data = whole[offsets[row] : offsets[end]]
            local = offsets[row : end + 1] - offsets[row]
            found = Boundaries(data, local)
            n = found.count(found.texts[1:]) - found.count(found.texts[:-1])
            one, two = (h[k][row:end] % (n + 1) for k in (0, 1))
            cuts = [found.cut(t) for t in (np.minimum(one, two), np.maximum(one, two))]
            at = [found.byte(c) - local[:-1] for c in cuts]
            sizes = [(cuts[0] - found.texts[:-1]).tolist(), (cuts[1] - cuts[0]).tolist()]
            forms, outputs = [], []
            for k, (start, stop) in enumerate(zip(local[:-1].tolist(), local[1:].tolist(), strict=True)):
                text = data[start:stop].tobytes()
                plain = not text or any(m in text for m in MARKS) or h[2][row + k] % 100 >= plain_from
                forms.append("plain" if plain else "spm" if h[3][row + k] % 100 < spm_below else "psm")
                outputs.append(_arranged(text, int(at[0][k]), int(at[1][k]), forms[-1]))
            known = [None if f == "plain" else v for f, v in zip(forms, sizes[0], strict=True)], [None if f == "plain" else v for f, v in zip(forms, sizes[1], strict=True)]
            yield pa.record_batch(
                [ids.slice(row, end - row), pa.array(n), pa.array(forms, pa.string()), *(pa.array(v, pa.int64()) for v in known),
                 pa.array(outputs, pa.binary()).cast(pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): each text with its middle last.

    The first four groups of eight digits of the hash of seed and id choose the
    two cuts, whether a text stays plain (plain_from of a hundred and above, and
    texts that are empty or hold a mark) and which of the two forms it takes
    (suffix first below spm_below of a hundred). restored() undoes it.
    """
    rows = with_text(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), "doc_id")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    part = lambda k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}")
    hashed = rows.select("doc_id", "text", *(part(k) for k in range(4)))
    return hashed.mapInArrow(lambda batches: _transformed(batches, plain_from, spm_below), SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed, from the output and its form alone."""
    out = F.coalesce(output, F.lit(""))
    mark = len(PREFIX)

    def parts(second: str) -> tuple[Column, Column, Column]:
        """What stands behind each of the three marks; a text with a mark of its own is never transformed."""
        b, m = F.locate(second, out), F.locate(MIDDLE, out)
        return F.substring(out, F.lit(mark + 1), b - mark - 1), F.substring(out, b + mark, m - b - mark), F.substring(out, m + mark, F.length(out))

    psm, spm = parts(SUFFIX), parts(PREFIX)
    return (
        F.when(form == "psm", F.concat(psm[0], psm[2], psm[1]))
        .when(form == "spm", F.concat(spm[1], spm[2], spm[0]))
        .otherwise(out)
    )
