"""Spelling variants: words one edit apart, found by comparing tiles of padded code-point matrices.

Two words are near if one inserted, deleted or replaced code point makes one of
the other; then their common prefix and common suffix together reach the longer
length minus one. Words meet in blocks: a word is cut into QUARTERS, and an edit
leaves all but one of them as they were, so near words agree in all but one
quarter. The shorter of two words enters the blocks of the length above its own.
A block of over TILE words is dealt out to pairs of tiles, each a group of its own.

Null texts have no words; a null id counts as an empty one where it is hashed;
repeated rows are counted each time; texts and words of any length are taken
whole; equal counts are settled by the words' code points; further columns are
left behind; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
OUTSIDE = re.compile("[^A-Za-zÀ-ÿ]")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Code points of a text that are taken apart at a time, and different words that a task holds before it hands counts on.
SLICE_CHARS, HELD_WORDS = 1 << 20, 200_000
QUARTERS = 4
#: Words of a tile, and cells of the matrices that are compared at a time.
TILE, CELLS = 2048, 1 << 22
BLOCK = ("length", "quarter", "block", "low", "high")


def _slices(text: str) -> Iterator[str]:
    """The text in parts that end outside runs of letters."""
    start = 0
    while start < len(text):
        cut = OUTSIDE.search(text, start + SLICE_CHARS)
        end = cut.end() if cut else len(text)
        yield text[start:end]
        start = end


def _counted(batches: Iterator[pa.RecordBatch], drop_one_in: int, least: int) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for key, text in zip(*batch.columns, strict=True):
            seed = zlib.crc32(f"{key.as_py()}:".encode())
            for part in _slices(text.as_py().encode().translate(LOWER).decode()):
                for run, n in Counter(w for w in RUN.findall(part) if len(w) >= least).items():
                    h = zlib.crc32(run.encode(), seed)
                    if drop_one_in and h % drop_one_in == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least:
                            continue
                    held[run] += n
                if len(held) > HELD_WORDS:
                    yield out()
                    held.clear()
    yield out()


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 7, drop_one_in: int = 31) -> DataFrame:
    """(word, n) of the runs of Latin letters of at least so many code points, A to Z in lower case.

    A run whose hash with its document's id is divisible by drop_one_in loses one
    letter (0: none does). Counts are added up in each task before the shuffle.
    """
    rows = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text"))
    parts = rows.mapInArrow(lambda batches: _counted(batches, drop_one_in, least), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _blocks(words: DataFrame) -> DataFrame:
    """(word, n, length, quarter, block, low, high): each word in its blocks of two words or more, split into pairs of tiles."""
    size = F.length("word")
    long = words.select("word", "n", size.alias("_size"), F.explode(F.array(size, size + 1)).alias("length"))
    long = long.withColumn("quarter", F.explode(F.array(*map(F.lit, range(QUARTERS)))))
    start, end = F.floor(F.col("length") * F.col("quarter") / QUARTERS).cast("int"), F.floor(F.col("length") * (F.col("quarter") + 1) / QUARTERS).cast("int")
    tail = end - (F.col("length") - F.col("_size"))
    head, rest = F.substring("word", F.lit(1), start), F.substring("word", tail + 1, F.col("_size"))
    keyed = long.where(end > start).select("word", "n", "length", "quarter", F.xxhash64(head, rest).alias("block"))
    sizes = keyed.groupBy("length", "quarter", "block").agg(F.count("*").alias("_m")).where("_m > 1")
    tiles = F.ceil(F.col("_m") / TILE).cast("int")
    dealt = keyed.join(sizes, ["length", "quarter", "block"]).withColumn("_t", F.pmod(F.xxhash64("word"), tiles).cast("int"))
    dealt = dealt.withColumn("_u", F.explode(F.sequence(F.lit(0), tiles - 1)))
    return dealt.select(
        "word", "n", "length", "quarter", "block", F.least("_t", "_u").alias("low"), F.greatest("_t", "_u").alias("high"),
        (F.col("_t") == F.col("high")).alias("second"),
    )


def _padded(codes: np.ndarray, first: np.ndarray, size: np.ndarray, width: int, step: int, pad: int) -> np.ndarray:
    """A row of width for each word, from its first place on by steps; pad after its end."""
    place = np.arange(width)
    out = codes[np.clip(first[:, None] + step * place, 0, len(codes) - 1)]
    out[place >= size[:, None]] = pad
    return out


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading equal columns of each row."""
    differ = a != b
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


class _Words:
    """Words as one array of code points with the places where they begin."""

    def __init__(self, words: list[str]):
        self.size = np.array([len(w) for w in words], np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.size)[:-1])).astype(np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        self.kind = np.uint16 if codes.max(initial=0) < 0xFFFE else np.uint32
        self.codes = codes.astype(self.kind)
        self.pads = (np.iinfo(self.kind).max, np.iinfo(self.kind).max - 1)

    def shared(self, i: np.ndarray, j: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the common prefixes and suffixes of pairs of words."""
        both = [(self.first[k], self.size[k], pad) for k, pad in zip((i, j), self.pads, strict=True)]
        heads = [_padded(self.codes, f, s, width, 1, pad) for f, s, pad in both]
        tails = [_padded(self.codes, f + s - 1, s, width, -1, pad) for f, s, pad in both]
        return _agreeing(*heads), _agreeing(*tails)


def single_edits(words: list[str], ends: np.ndarray, first_of_second: np.ndarray, length: np.ndarray, quarter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): pairs of near words of the same group, each pair only in the first quarter in which the two meet.

    Groups are consecutive; ends has the end of each row's group, and row i is compared with rows first_of_second[i] to ends[i].
    """
    known = _Words(words)
    before = np.concatenate(([0], np.cumsum(np.maximum(ends - first_of_second, 0))))
    runs = [0, *(np.flatnonzero(np.diff(length)) + 1).tolist(), len(words)]
    found_i, found_j = [], []
    for row, end in zip(runs, runs[1:], strict=False):
        width = int(length[row])
        for at in range(int(before[row]), int(before[end]), max(1, CELLS // width)):
            pair = np.arange(at, min(int(before[end]), at + max(1, CELLS // width)))
            i = np.searchsorted(before, pair, side="right") - 1
            j = first_of_second[i] + pair - before[i]
            some = np.maximum(known.size[i], known.size[j]) == width  # two shorter words meet in blocks of their own length
            i, j = i[some], j[some]
            head, tail = known.shared(i, j, width)
            near = (head + tail >= width - 1) & (head < width)
            i, j, head, tail = i[near], j[near], head[near], tail[near]
            first = np.full(len(i), -1)
            for q in reversed(range(QUARTERS)):
                a, z = width * q // QUARTERS, width * (q + 1) // QUARTERS
                first[(z > a) & (head >= a) & (tail >= width - z)] = q
            own = first == quarter[i]
            found_i.append(i[own])
            found_j.append(j[own])
    return np.concatenate([np.zeros(0, np.int64), *found_i]), np.concatenate([np.zeros(0, np.int64), *found_j])


def _near(rows: pa.Table) -> pa.RecordBatch:
    """(word, n_near, near, near_n) of each row of whole groups that has near words."""
    words = rows["word"].to_pylist()
    n, length, quarter, low, high = (rows[c].to_numpy() for c in ("n", "length", "quarter", "low", "high"))
    second = rows["second"].to_numpy(zero_copy_only=False)
    new = _changes(rows)
    starts = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    ends = np.append(starts[1:], len(words))[group]
    seconds = np.bincount(group, second, len(starts)).astype(np.int64)
    index = np.arange(len(words))
    partner = np.where(low == high, index + 1, np.where(second, ends, ends - seconds[group]))
    i, j = single_edits(words, ends, partner, length, quarter)
    a, b = np.concatenate((i, j)), np.concatenate((j, i))
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = index
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    mine, place, count = np.unique(a, return_index=True, return_counts=True)
    pick = lambda at: pa.array([words[k] for k in at.tolist()], pa.string())
    best = b[place]
    return pa.record_batch([pick(mine), pa.array(count.astype(np.int64)), pick(best), pa.array(n[best].astype(np.int64))], ["word", "n_near", "near", "near_n"])


def _changes(rows: pa.Table) -> np.ndarray:
    """True where a group begins."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for name in BLOCK:
        v = rows[name].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return new


def _near_of_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by group; the group that a batch leaves open is held for the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch])
        last = int(np.flatnonzero(_changes(rows))[-1])
        if last:
            yield _near(rows.slice(0, last).combine_chunks())
        held = rows.slice(last).combine_chunks().to_batches()
    if held:
        yield _near(pa.Table.from_batches(held))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n): how many words are near, and the one of them of the largest n, ties by code points.

    words (word, n) holds each word once. Words without a near word don't appear.
    """
    dealt = _blocks(words.select("word", "n")).repartition(*BLOCK).sortWithinPartitions(*BLOCK, "second")
    parts = dealt.mapInArrow(_near_of_groups, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("_best")
    found = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", F.col("_best.near").alias("near"), (-F.col("_best.less")).alias("near_n"))


def _roots(links: DataFrame, steps: int) -> DataFrame:
    """(word, root): the end of each chain of links (word, form) of at most so many steps; every round doubles what is followed."""
    now = written(links.select("word", F.col("form").alias("root")), "spelling-links")
    for _ in range(math.ceil(math.log2(max(1, steps)))):
        far = now.select(F.col("word").alias("root"), F.col("root").alias("_far"))
        new = written(now.join(far, "root", "left").select("word", F.coalesce("_far", "root").alias("root")), "spelling-links")
        forget(now)
        now = new
    return now


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word, the near word it is a variant of, and the end of that chain.

    The form is the near word of the largest n, if that is at least ratio times
    the word's own; so a chain has no more steps than the largest n has powers
    of ratio.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    words = written(words.select("word", "n"), "spelling-words")
    most = words.agg(F.max("n")).first()[0] or 1
    near = words.join(near_words(words), "word", "left").withColumn("_is", F.col("near_n") >= ratio * F.col("n"))
    found = written(
        near.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("_is"), F.col("near")).alias("form"), F.when(F.col("_is"), F.col("near_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    forget(words)
    roots = _roots(found.where("form IS NOT NULL"), math.ceil(math.log(max(2, most), ratio)) + 1)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 7, least_n: int = 2, ratio: int = 10, drop_one_in: int = 31) -> DataFrame:
    """variants() of the words of documents that occur least_n times or more."""
    return variants(word_counts(docs, key, text, least, drop_one_in).where(F.col("n") >= least_n), ratio)
