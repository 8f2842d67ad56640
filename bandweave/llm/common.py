"""Shared helpers: table access, shared-folder materialisation, Arrow text batches, components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import forget, shared_dir  # noqa: F401  the operators take them from here
from ..storage import stored as written

#: Copies of the small side of a join whose key may be hot; the large side is dealt over them.
SALTS = 16
#: Bytes of text that a numpy kernel works on at a time.
SLICE_BYTES = 1 << 20
#: What empties an operator's cache in a worker.
CACHES: list[Callable[[], None]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim() -> None:
    """Hand a worker's free memory back, which its allocators would keep for as long as it lives."""
    pa.default_memory_pool().release_unused()
    if (libc := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        libc(0)


def let_go() -> None:
    """In a task: drop what tasks of other operators have left in this worker."""
    for clear in CACHES:
        clear()
    trim()


def with_text(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Only the keys and the text, so that further columns can't clash; null text is empty."""
    return df.select(*keys, F.coalesce(F.col(text), F.lit("")).alias(text))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (one more than rows) of a string column without nulls."""
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts come to about limit bytes; a longer text is a range of its own."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(rows, max(end, row + 1))
        yield row, end
        row = end


def text_slices(batch: pa.RecordBatch, text: str = "text", limit: int = 4 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch as batches of about limit bytes of text, without copying, so that what is made of one stays small."""
    _, offsets = text_buffers(batch.column(text).fill_null(""))
    for a, z in pieces(offsets, limit):
        yield batch.slice(a, z - a)


_MULT = 0x9E3779B97F4A7C15
_UNMULT = pow(_MULT, -1, 1 << 64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling-hash multiplier and of its inverse, modulo 2**64."""
    up = np.full(n, _MULT, np.uint64)
    down = np.full(n, _UNMULT, np.uint64)
    if n:
        up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class RollingHash:
    """Hashes of any byte ranges of one buffer in constant time each."""

    def __init__(self, data: np.ndarray):
        up, self._down = powers(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self._sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._down[starts])

    def grams(self, size: int) -> np.ndarray:
        """One hash for each start of size bytes."""
        if len(self._sums) <= size:
            return np.zeros(0, np.uint64)
        return mix((self._sums[size:] - self._sums[:-size]) * self._down[: len(self._sums) - size])


def lower_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def word_table() -> np.ndarray:
    """True for bytes of words: ASCII letters and digits, and every byte of a longer code point."""
    out = np.zeros(256, bool)
    out[48:58] = out[65:91] = out[97:123] = True
    out[128:] = True
    return out


LOWER, WORD = lower_table(), word_table()


def folded(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with the capital letters of ASCII and Latin-1 in lower case."""
    out = LOWER[data]
    capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[1:][capital] += 32
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words of consecutive texts; no word crosses texts."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = WORD[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # a text's start ends what came before
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """word_spans() and the hash of each lower-cased word."""
    starts, ends, rows = word_spans(data, offsets)
    return starts, ends, rows, RollingHash(folded(data)).ranges(starts, ends)


def summed(parts: list[np.ndarray]) -> np.ndarray:
    return reduce(np.add, parts)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: (node, component), the smallest node reachable.

    Alternates large-star and small-star contraction until the edges no longer
    change. Nodes without an edge to another node don't appear; null ends are
    ignored. Joins deal a node of many edges over SALTS copies of its minimum.
    """
    spark = edges.sparkSession
    edges = (
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("hi") != F.col("lo")))
        .distinct()
    )
    now = written(edges, "edges")
    if now.isEmpty():
        return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    seen = None
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        large = _star(both, F.col("v") > F.col("u")).distinct()
        small = large.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        small = _star(small, F.lit(True)).unionByName(
            small.groupBy("u").agg(F.min("v").alias("lo")).select(F.col("u").alias("hi"), "lo")
        )
        new = written(small.where("hi != lo").distinct(), "edges")
        mark = new.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        forget(now)
        now = new
        if mark == seen:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        seen = mark


def _star(pairs: DataFrame, keep) -> DataFrame:
    """Link each kept neighbour v of u to the smallest of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = pairs.where(keep).withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return (
        dealt.join(least, ["u", "salt"])
        .select(F.greatest("v", "m").alias("hi"), F.least("v", "m").alias("lo"))
        .where("hi != lo")
    )


def cut_long(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Offsets with further cuts, at white space where there is some, inside texts of over limit bytes; each part's row."""
    sizes = np.diff(offsets)
    if not (sizes > limit).any():
        return offsets, np.arange(len(sizes))
    cuts, owners = [int(offsets[0])], []
    for row, end in enumerate(offsets[1:].tolist()):
        while end - cuts[-1] > limit:
            low = cuts[-1] + limit // 2
            blank = np.flatnonzero(np.isin(data[low : cuts[-1] + limit], (10, 32)))
            cuts.append(low + int(blank[-1]) + 1 if len(blank) else cuts[-1] + limit)
            owners.append(row)
        cuts.append(end)
        owners.append(row)
    return np.array(cuts, np.int64), np.array(owners, np.int64)
