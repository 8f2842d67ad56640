"""Fingerprints that share a variant, by the first bits of the variant: one near partner of each, or the components that meet.

Fingerprints stand in the first width bits of 64-bit integers. Two that differ
in at most radius (even) bits have a common variant within half of it of both,
and two with a common variant are that near, so nothing is left to verify here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .simhash import BITS, _masks, prefix_bits

#: Variants that are sorted at once, and pairs that are held before they are reduced or handed on.
SORTED, HELD = 1 << 19, 1 << 17
#: A prefix with more variants than this many times SORTED is divided by further bits.
DIVIDED = 16


class Runs:
    """Rows that share a variant, some million variants at a time."""

    def __init__(self, half: int):
        self.half = half
        self._cache: dict[tuple[int, int], np.ndarray] = {}

    def masks(self, bits: int, flips: int) -> np.ndarray:
        if (bits, flips) not in self._cache:
            self._cache[bits, flips] = _masks(bits, flips)
        return self._cache[bits, flips]

    def find(self, values: np.ndarray, left: np.ndarray, rows: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, place in run), run after run; values agree above their lowest bits, left: flips that remain to each."""
        if len(values) < 2:
            return
        sizes = np.array([len(self.masks(bits, f)) for f in range(self.half + 1)])
        variants = int(sizes[left].sum())
        if variants > DIVIDED * SORTED and bits > 8:
            part = (values >> np.uint64(bits - 8)) & np.uint64(255)
            for value in range(256):
                after = left - np.bitwise_count(part ^ np.uint64(value))
                near = after >= 0
                yield from self.find(values[near], after[near], rows[near], bits - 8)
            return
        classes = variants // SORTED + 1
        for c in range(classes):
            yield from self._class(values & np.uint64((1 << bits) - 1), left, rows, bits, c, classes)

    def _class(self, low, left, rows, bits, c, classes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        number, shift = np.arange(len(low), dtype=np.uint64), np.uint64(max(1, (len(low) - 1).bit_length()))
        parts = []
        for flips in range(self.half + 1):
            mine, masks = np.flatnonzero(left == flips), self.masks(bits, flips)
            step = max(1, SORTED // len(masks))
            for part in (mine[at : at + step] for at in range(0, len(mine), step)):
                packed = (((low[part][:, None] ^ masks[None, :]) << shift) | number[part][:, None]).reshape(-1)
                parts.append(packed if classes == 1 else packed[(packed >> shift) % np.uint64(classes) == c])
        packed = np.sort(np.concatenate(parts))
        same = np.concatenate(([False], (packed[1:] ^ packed[:-1]) >> shift == 0))
        shared = same | np.concatenate((same[1:], [False]))
        if shared.any():
            at = np.arange(len(same))
            place = at - np.maximum.accumulate(np.where(same, 0, at))
            owner = (packed[shared] & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
            yield rows[owner], place[shared]


def _with_prefix(rows: DataFrame, half: int, bits: int) -> DataFrame:
    """rows at every value that the first bits of a variant can take."""
    masks = ", ".join(f"{m}L" for m in _masks(bits, half).tolist())
    return rows.withColumn("prefix", F.expr(f"explode(transform(array({masks}), m -> m ^ shiftrightunsigned(fp, {BITS - bits})))"))


def _by_prefix(rows: DataFrame, half: int, bits: int) -> DataFrame:
    """_with_prefix(), the rows of a prefix together."""
    return _with_prefix(rows, half, bits).repartition("prefix").sortWithinPartitions("prefix")


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each prefix and its columns, from batches sorted by prefix."""
    key, held = None, []

    def whole():
        return key, [np.concatenate(c) for c in zip(*held, strict=True)]

    for b in batches:
        prefix = b.column("prefix").to_numpy(zero_copy_only=False)
        columns = [b.column(n).to_numpy(zero_copy_only=False) for n in names]
        cuts = [0, *(np.flatnonzero(np.diff(prefix)) + 1).tolist(), len(prefix)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if low == high:
                continue
            if held and prefix[low] != key:
                yield whole()
                held = []
            key = int(prefix[low])
            held.append([c[low:high] for c in columns])
    if held:
        yield whole()


def _starts(fps: np.ndarray, prefix: int, half: int, bits: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    values = fps.view(np.uint64) >> np.uint64(BITS - width)
    return values, half - np.bitwise_count((values >> np.uint64(width - bits)) ^ np.uint64(prefix)).astype(np.int64)


def _reduced(fp: np.ndarray, away: np.ndarray, partner: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, ...]:
    """The nearest partner of each fingerprint, and whether it has others."""
    order = np.lexsort((partner, away, fp))
    fp, away, partner, more = fp[order], away[order], partner[order], more[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(fp)), bool), fp[1:] != fp[:-1])))
    if len(first):
        others = np.minimum.reduceat(partner, first) != np.maximum.reduceat(partner, first)
        more = np.maximum.reduceat(more, first) | others
    return fp[first], away[first], partner[first], more


def nearest(fps: DataFrame, radius: int, width: int) -> DataFrame:
    """(fp, partner, more) of the distinct fps that have one within radius bits: a near one, and whether there are others."""
    half = radius // 2
    bits = prefix_bits(fps.count(), half)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, found, kept, limit = Runs(half), [], 0, HELD
        for prefix, (mine,) in _groups(batches, ["fp"]):
            values, left = _starts(mine, prefix, half, bits, width)
            for rows, place in runs.find(values, left, np.arange(len(mine)), width - bits):
                run_of = np.cumsum(place == 0) - 1
                crowd = np.bincount(run_of)[run_of] > 2
                later = np.flatnonzero(place > 0)
                a = np.concatenate((rows[later - place[later]], rows[later - 1]))
                b, crowd = np.tile(rows[later], 2), np.tile(crowd[later], 2)
                away = np.bitwise_count(values[a] ^ values[b])
                both = np.concatenate((mine[a], mine[b])), np.tile(away, 2), np.concatenate((mine[b], mine[a])), np.tile(crowd, 2)
                found.append(_reduced(*both))
                kept += len(found[-1][0])
                if kept > limit:
                    found = [_reduced(*map(np.concatenate, zip(*found, strict=True)))]
                    kept = len(found[0][0])
                    limit = max(HELD, 2 * kept)  # what can't be reduced isn't tried again at once
        if found:
            fp, _, partner, more = _reduced(*map(np.concatenate, zip(*found, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(partner), pa.array(more)], names=["fp", "partner", "more"])

    met = _by_prefix(fps, half, bits).mapInArrow(run, "fp bigint, partner bigint, more boolean")
    away = F.expr("bit_count(fp ^ partner)")
    return met.groupBy("fp").agg(
        F.min_by("partner", F.struct(away, "partner")).alias("partner"),
        (F.max("more") | (F.min("partner") != F.max("partner"))).alias("more"),
    )


#: A prefix has 32 bits at most; the table stands above them.
_TABLE_AT = 32


def meetings(rows: DataFrame, radius: int, width: int) -> DataFrame:
    """(a, b) of components: links that connect the same ones as all pairs within radius bits in a table do.

    rows: (table, fp, component). Those of a run are linked to its first, and a
    task hands on a forest, so what is made grows with the components and not
    with the pairs.
    """
    half = radius // 2
    rows = rows.select("table", "fp", "component").distinct()
    bits = prefix_bits(rows.count(), half)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, forest = Runs(half), Forest()
        for prefix, (fps, component) in _groups(batches, ["fp", "component"]):
            values, left = _starts(fps, prefix & ((1 << _TABLE_AT) - 1), half, bits, width)
            for mine, place in runs.find(values, left, np.arange(len(fps)), width - bits):
                met = component[mine]
                first = met[np.arange(len(met)) - place]
                forest.link(first[first != met], met[first != met])
        yield _pairs(forest.links())

    dealt = _with_prefix(rows, half, bits).withColumn("prefix", F.col("prefix") + F.shiftleft(F.col("table").cast("bigint"), _TABLE_AT))
    return dealt.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(run, "a bigint, b bigint").distinct()


class Forest:
    """What is linked, as each node's way to the smallest it reaches."""

    def __init__(self):
        self._root: dict[int, int] = {}

    def _find(self, a: int) -> int:
        root = self._root.setdefault(a, a)
        while root != self._root[root]:
            root = self._root[root]
        while a != root:
            self._root[a], a = root, self._root[a]
        return root

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in np.unique(np.stack((a, b), axis=1), axis=0).tolist():
            x, y = self._find(x), self._find(y)
            if x != y:
                self._root[max(x, y)] = min(x, y)

    def links(self) -> np.ndarray:
        found = [(r, x) for x in self._root if (r := self._find(x)) != x]
        return np.array(found, np.int64).reshape(-1, 2)


def _pairs(found: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["a", "b"])
