"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a common variant within r
bits of both. So every distinct fingerprint emits all variants within r bits,
the variants are shuffled, and those that collide give the linked pairs.

A variant is emitted in two steps, so that a few hundred bytes a fingerprint are
shuffled and not its 2081 variants: the fingerprint goes to each value that its
first bits can take within r flips (the shuffle is on that part of the
variant), and the task that gets it there flips what is left of the r bits in
the remaining ones. Fingerprints at one prefix that are too many to expand at
once are divided by further bits in the same way, so memory is bounded whatever
the number of near copies.

Of the fingerprints that share a variant each is linked to the smallest: they
are all within 2r bits of each other, and such stars keep components whole
without all pairs within a group. A task hands on its own components only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, with_text, written

BITS, RADIUS = 64, 4
#: Fingerprints whose prefixes are made at once, and variants that are sorted at once.
EXPANDED, SORTED = 4096, 1 << 20
SEED = 42
_BLOCK = 1 << 15
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str, shingle: int) -> int:
    """SimHash of the word shingles' XXH64, repeats included; zero without words.

    ASCII letters are lower-cased; words are what stands between ASCII white
    space; fewer words than a shingle make one shingle.
    """
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, counts, digest = len(words) - shingle + 1, np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):
        low, high = starts[at : min(n, at + _BLOCK)].tolist(), ends[at + shingle - 1 :][:_BLOCK].tolist()
        hashes = np.array([digest(joined[a:z], SEED) for a, z in zip(low, high, strict=False)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of the word shingles that fingerprint() counts, repeats included."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    low, high, digest = np.concatenate(([0], ends[:-1] + 1)).tolist(), ends[shingle - 1 :].tolist(), xxhash.xxh64_intdigest
    return np.array([digest(joined[a:z], SEED) for a, z in zip(low, high, strict=False)], np.uint64)


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    docs = with_text(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), "doc_id")
    return docs.mapInArrow(run, "doc_id bigint, fp bigint")


def _masks(bits: int, flips: int) -> np.ndarray:
    """All values of bits bits with at most flips ones."""
    return np.array(
        [sum(1 << b for b in c) for n in range(min(flips, bits) + 1) for c in combinations(range(bits), n)], np.uint64
    )


def prefix_bits(fingerprints: int, radius: int) -> int:
    """Bits to shuffle by: an evenly spread prefix gets a quarter of what its variants' free bits can number."""
    bits = 8
    while bits < 32 and fingerprints * len(_masks(bits, radius)) > 4 ** (bits - 1):
        bits += 1
    return bits


def _emit_prefixes(radius: int, prefix: int):
    masks = _masks(prefix, radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, EXPANDED):
                fps = b.column("fp").slice(at, EXPANDED).to_numpy(zero_copy_only=False).view(np.uint64)
                keys = (fps >> np.uint64(BITS - prefix))[:, None] ^ masks[None, :]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.reshape(-1).astype(np.int64)), pa.array(np.repeat(fps.view(np.int64), len(masks)))],
                    names=["prefix", "fp"],
                )

    return run


class _Balls:
    """Expands the fingerprints at a prefix and links those that collide."""

    def __init__(self, radius: int):
        self.radius, self.root = radius, {}
        self._cache: dict[tuple[int, int], np.ndarray] = {}

    def masks(self, bits: int, flips: int) -> np.ndarray:
        if (bits, flips) not in self._cache:
            self._cache[bits, flips] = _masks(bits, flips)
        return self._cache[bits, flips]

    def _find(self, a: int) -> int:
        root = self.root.setdefault(a, a)
        while root != self.root[root]:
            root = self.root[root]
        while a != root:
            self.root[a], a = root, self.root[a]
        return root

    def link(self, a: int, b: int) -> None:
        a, b = self._find(a), self._find(b)
        if a != b:
            self.root[max(a, b)] = min(a, b)

    def expand(self, fps: np.ndarray, left: np.ndarray, bits: int) -> None:
        """fps (sorted, distinct) agree with a variant's bits above the lowest bits; left: flips that remain to each."""
        if len(fps) < 2:
            return
        if len(fps) > 1 << (BITS - bits):  # their numbers don't fit beside a variant's bits
            self._divide(fps, left, bits)
            return
        sizes = np.array([len(self.masks(bits, f)) for f in range(self.radius + 1)])
        classes = int(sizes[left].sum()) // SORTED + 1
        for c in range(classes):
            self._collide(fps, left, bits, c, classes)

    def _collide(self, fps: np.ndarray, left: np.ndarray, bits: int, c: int, classes: int) -> None:
        """Link fingerprints that share one of the variants of remainder c."""
        low, number = fps & np.uint64((1 << bits) - 1), np.arange(len(fps), dtype=np.uint64)
        shift = np.uint64(max(1, (len(fps) - 1).bit_length()))
        parts = []
        for flips in range(self.radius + 1):
            mine, masks = np.flatnonzero(left == flips), self.masks(bits, flips)
            step = max(1, SORTED // len(masks))
            for part in (mine[at : at + step] for at in range(0, len(mine), step)):
                variants = low[part][:, None] ^ masks[None, :]
                packed = ((variants << shift) | number[part][:, None]).reshape(-1)
                parts.append(packed if classes == 1 else packed[(packed >> shift) % np.uint64(classes) == c])
        packed = np.concatenate(parts)
        packed.sort()
        same = np.concatenate(([False], (packed[1:] ^ packed[:-1]) >> shift == 0))
        if same.any():
            owner = (packed & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
            pairs = np.unique(self._partners(owner, same, len(fps)))
            self._verify(fps[pairs // len(fps)], fps[pairs % len(fps)])

    def _partners(self, owner: np.ndarray, same: np.ndarray, n: int) -> np.ndarray:
        """Pairs, as a * n + b, of the first of each run of equal variants with the others."""
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
        return owner[first[same]] * n + owner[same]

    def _divide(self, fps: np.ndarray, left: np.ndarray, bits: int) -> None:
        """Go on at each value of the next eight bits."""
        bits -= 8
        part = (fps >> np.uint64(bits)) & np.uint64(255)
        for value in range(256):
            after = left - np.bitwise_count(part ^ np.uint64(value))
            near = after >= 0
            self.expand(fps[near], after[near], bits)

    def _verify(self, a: np.ndarray, b: np.ndarray) -> None:
        near = np.bitwise_count(a ^ b) <= 2 * self.radius
        for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
            self.link(x, y)


def _collide(radius: int, bits: int):

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls, open_prefix, held = _Balls(radius), None, []

        def close() -> None:
            if held:
                fps = np.unique(np.concatenate(held))
                flipped = np.bitwise_count((fps >> np.uint64(BITS - bits)) ^ np.uint64(open_prefix))
                balls.expand(fps, radius - flipped.astype(np.int64), BITS - bits)

        for b in batches:  # sorted by prefix
            prefix = b.column("prefix").to_numpy(zero_copy_only=False)
            fps = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = np.flatnonzero(np.diff(prefix)) + 1
            for p, part in zip(prefix[np.concatenate(([0], cuts))].tolist(), np.split(fps, cuts), strict=True):
                if p != open_prefix:
                    close()
                    open_prefix, held = p, []
                held.append(part)
        close()
        found = [(x, r) for x in balls.root if (r := balls._find(x)) != x]
        both = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

    return run


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) of fingerprints: links whose components are those of all pairs within radius bits."""
    half = radius // 2
    bits = prefix_bits(fps.count(), half)
    dealt = fps.select("fp").distinct().mapInArrow(_emit_prefixes(half, bits), "prefix bigint, fp bigint")
    dealt = dealt.repartition("prefix").sortWithinPartitions("prefix")
    return dealt.mapInArrow(_collide(half, bits), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    component_id is the smallest doc_id reachable over fingerprints of at most
    radius (even) differing bits, itself included. Texts without words have
    fingerprint zero and link like any other. Repeated rows stay; a row with a
    null id gets its component's smallest id. Texts of any length are taken whole,
    further columns are left behind, and an empty table gives an empty result.
    """
    found = written(fingerprints(docs, shingle), "fingerprints")
    first = found.groupBy("fp").agg(F.min("doc_id").alias("doc"))
    pairs = links(found, radius)
    ends = first.select(F.col("fp").alias("b"), F.col("doc").alias("other"))
    edges = pairs.join(first.withColumnRenamed("fp", "a"), "a").join(ends, "b").select("doc", "other")
    whole = components(edges, "doc", "other")
    named = first.join(whole, F.col("doc") == F.col("node"), "left").select(
        "fp", F.coalesce("component", "doc").alias("component_id")
    )
    return found.join(named, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
