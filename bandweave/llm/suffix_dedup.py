"""Removal of byte strings of SIZE bytes that a document with a smaller id also has.

Anchors. Of every SIZE bytes the GRAM-byte strings with the smallest hash are
anchors, so two equal strings of SIZE bytes have equal anchors at equal places.
Only bytes around anchors that occur in several documents can repeat, and
everything that repeats around an anchor meets in the task of its hash. Anchors
whose whole surroundings are equal form a class, whose smallest document decides
for the others. What is left are classes that share an anchor in part.

Burrows-Wheeler merge. The surroundings of these (one a class) are strings over
symbols of SIZE / 2 bytes, so SIZE bytes are two symbols; a string is read from
each of SIZE / 2 places. A bucket's strings come in shards. Each shard's
transform is built once. The merge never compares suffixes again: it starts from
the shards' transforms one behind the other and refines the interleave, dealing
the places stably by the symbol before them, which orders them by one more
symbol a round. Places that the rounds did not separate have that many symbols
in common, so after two rounds the blocks are the intervals of strings of SIZE
bytes that repeat, and each block's smallest document keeps its copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, mix, pieces, text_buffers, with_text, written

SIZE, GRAM = 50, 20
SYMBOL = SIZE // 2
BEFORE = SIZE - GRAM
#: Text bytes of which one part of the anchors, or one bucket of segments, comes on average.
PART_BYTES = 8 << 20
#: Segments in a shard of a bucket.
SHARD = 2048
_LAST = np.uint64(2**64 - 1)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each run of width values, in log2(width) steps."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = pick(values[:-step], values[step:]) if len(values) > step else values[:0]
        done += step
    return values


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of all texts' anchors, and hashes of their surroundings, in order of place."""
    rolling, width = RollingHash(data), SIZE - GRAM + 1
    if len(data) < SIZE:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    grams = rolling.grams(GRAM)
    smallest = _sliding(grams, width, np.minimum)  # of each SIZE bytes
    whole = np.zeros(len(data) + 1, bool)  # starts of SIZE bytes inside one text
    for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        whole[a : max(a, z - SIZE + 1)] = True
    smallest = np.where(whole[: len(smallest)], smallest, np.uint64(0))
    padded = np.concatenate((np.zeros(width - 1, np.uint64), smallest, np.zeros(width - 1, np.uint64)))
    places = np.flatnonzero((_sliding(padded, width, np.maximum) == grams) & (grams != 0))
    row = np.searchsorted(offsets, places, side="right") - 1
    low = np.maximum(places - BEFORE, offsets[row])
    high = np.minimum(places + SIZE, offsets[row + 1])
    around = rolling.ranges(low, high) ^ mix(((places - low) * 256 + high - places).astype(np.uint64))
    return places, grams[places], around


def _emit(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for a, z in pieces(offsets, PART_BYTES // 2):
                cut = offsets[a : z + 1] - offsets[a]
                places, grams, around = anchors(data[offsets[a] : offsets[z]], cut)
                if not len(places):
                    continue
                row = np.searchsorted(cut, places, side="right") - 1
                part = (grams % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                found, first = np.unique(part[order], return_index=True)
                out = []
                for p, mine in zip(found.tolist(), np.split(order, first[1:]), strict=True):
                    rows, count = np.unique(row[mine], return_counts=True)
                    docs = np.stack((ids[a:z][rows], cut[rows + 1] - cut[rows], count))
                    pos = (places[mine] - cut[row[mine]]).astype("<u4")
                    out.append((p, docs.astype("<i8").tobytes(), grams[mine].tobytes(), around[mine].tobytes(), pos.tobytes()))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])],
                    names=["part", "docs", "grams", "around", "pos"],
                )

    return run


#: A span of bytes to remove (gram 0), or a place whose surroundings need comparing (end 0).
_SPANS = "doc_id bigint, start bigint, end bigint, gram bigint"


def _spans(doc, start, end, gram) -> pa.RecordBatch:
    cols = [np.ascontiguousarray(c).astype(np.int64) for c in (doc, start, end)] + [gram.view(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc_id", "start", "end", "gram"])


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part: decide within classes; hand on one place a class of the anchors that have several."""
    held, part = [], None
    for b in batches:
        for row in b.to_pylist():
            if row["part"] != part:
                yield from _decide(held)
                held, part = [], row["part"]
            held.append(row)
    yield from _decide(held)


def _decide(held: list[dict]) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    joined = lambda k, kind: np.frombuffer(b"".join(r[k] for r in held), kind)
    docs = np.concatenate([np.frombuffer(r["docs"], "<i8").reshape(3, -1) for r in held], axis=1)
    doc, size = np.repeat(docs[0], docs[2]), np.repeat(docs[1], docs[2])
    gram, around, pos = joined("grams", "<u8"), joined("around", "<u8"), joined("pos", "<u4").astype(np.int64)
    held.clear()
    order = np.argsort(gram)
    g = gram[order]
    starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    low, high = np.minimum.reduceat(doc[order], starts), np.maximum.reduceat(doc[order], starts)
    several = np.repeat(low != high, np.diff(np.append(starts, len(g))))
    order = order[several]
    if not len(order):
        return
    order = order[np.lexsort((doc[order], around[order], gram[order]))]
    g, c, d = gram[order], around[order], doc[order]
    new_gram = np.concatenate(([True], g[1:] != g[:-1]))
    new_class = new_gram | np.concatenate(([True], c[1:] != c[:-1]))
    first = d[np.maximum.accumulate(np.where(new_class, np.arange(len(d)), 0))]  # smallest document of the class
    later = order[d > first]
    yield _spans(doc[later], np.maximum(pos[later] - BEFORE, 0), np.minimum(pos[later] + SIZE, size[later]), np.zeros(len(later), np.uint64))
    groups = np.flatnonzero(new_gram)
    mixed = np.repeat(np.add.reduceat(new_class.astype(np.int64), groups) > 1, np.diff(np.append(groups, len(g))))
    own = order[(d == first) & mixed]
    yield _spans(doc[own], pos[own], np.zeros(len(own)), gram[own])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, doc_id, start, bytes) of the surroundings of places that need comparing."""
    for b in batches:
        out = []
        for row in b.to_pylist():
            raw = row["text"].encode()
            for pos, gram in zip(row["places"], row["grams"], strict=True):
                low = max(0, pos - BEFORE)
                out.append((gram, row["doc_id"], low, raw[low : pos + SIZE]))
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["gram", "doc_id", "start", "segment"])


class Shard:
    """The Burrows-Wheeler transform of the strings of some segments over symbols of SYMBOL bytes.

    Places are those with a whole symbol, and an end (symbol 0) for each string;
    strings are cyclic, so the place before a string's first is its end.
    """

    def __init__(self, segments: list[bytes]):
        data = np.frombuffer(b"".join(segments), np.uint8)
        lens = np.fromiter(map(len, segments), np.int64, len(segments))
        starts = np.cumsum(lens) - lens
        symbols = RollingHash(data).grams(SYMBOL)
        counts = np.maximum(lens - SYMBOL + 1, 0)
        segment = np.repeat(np.arange(len(lens)), counts)
        inside = np.arange(len(segment)) - np.repeat(np.cumsum(counts) - counts, counts)
        strings = np.minimum(counts, SYMBOL)  # a string for each of the first places
        first = np.cumsum(counts) - counts
        ends = len(segment) + np.cumsum(strings) - strings
        self.segment = np.concatenate((segment, np.full(int(strings.sum()), -1)))
        self.inside = np.concatenate((inside, np.zeros(int(strings.sum()), np.int64)))
        #: Symbol at each place; 0 is an end.
        self.symbol = np.concatenate((symbols[starts[segment] + inside] | np.uint64(1), np.zeros(int(strings.sum()), np.uint64)))
        #: The place before each place: a symbol earlier, a string's end before its first, its last before its end.
        head = np.repeat(np.arange(len(lens)), strings)
        residue = np.arange(len(head)) - np.repeat(np.cumsum(strings) - strings, strings)
        last = residue + (counts[head] - 1 - residue) // SYMBOL * SYMBOL
        before = np.where(inside >= SYMBOL, np.arange(len(segment)) - SYMBOL, ends[segment] + inside)
        self.before = np.concatenate((before, first[head] + last))
        self._sort(int(-(-int(counts.max(initial=1)) // SYMBOL)) + 1)

    def _sort(self, rounds: int) -> None:
        """Order the places by their cyclic strings: deal them by the symbol before, for a whole turn."""
        ranks = np.unique(self.symbol, return_inverse=True)[1].astype(np.uint64)
        order = np.arange(len(self.symbol))
        for _ in range(rounds):
            moved = self.before[order]
            order = moved[_stable(ranks[moved])[0]]
        self.order = order
        #: The transform: the symbol before each place in order.
        self.bwt = self.symbol[self.before[order]]


def _stable(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of small non-negative numbers, and the sorted numbers."""
    shift = np.uint64(max(1, (len(keys) - 1).bit_length()))
    packed = (keys.astype(np.uint64) << shift) | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    return (packed & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64), packed >> shift


def merge(shards: list[Shard], rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The refined interleave (shard of each place, in order) and the block of each place.

    Places of one block have their first rounds symbols in common.
    """
    turn = np.repeat(np.arange(len(shards)), [len(s.bwt) for s in shards])
    alphabet = np.unique(np.concatenate([s.bwt for s in shards]))
    block = np.zeros(len(turn), np.int64)
    codes = [np.searchsorted(alphabet, s.bwt) for s in shards]
    for _ in range(rounds):
        symbol = np.empty(len(turn), np.int64)
        for i, code in enumerate(codes):
            symbol[turn == i] = code  # each shard's transform is read in its own order
        order, dealt = _stable(symbol)
        turn, block = turn[order], block[order]
        new = np.concatenate(([False], (dealt[1:] != dealt[:-1]) | (block[1:] != block[:-1])))
        block = np.cumsum(new)
    return turn, block


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram: merge the shards of some whole groups of grams at a time."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("gram", "doc_id", "start", "segment")), strict=True):
            if len(held) >= 8 * SHARD and row[0] != held[-1][0]:
                yield _repeats(held)
                held = []
            held.append(row)
    if held:
        yield _repeats(held)


def _repeats(rows: list[tuple]) -> pa.RecordBatch:
    """Spans of strings of SIZE bytes that a smaller document has, too."""
    rows = [r for r in rows if len(r[3]) >= SIZE]
    shards = [Shard([r[3] for r in rows[a : a + SHARD]]) for a in range(0, len(rows), SHARD)]
    if not shards:
        return _spans(*(np.zeros(0),) * 3, np.zeros(0, np.uint64))
    turn, block = merge(shards)
    row, inside = np.empty(len(turn), np.int64), np.empty(len(turn), np.int64)
    for i, s in enumerate(shards):
        mine = turn == i
        row[mine] = np.where(s.segment[s.order] >= 0, s.segment[s.order] + i * SHARD, -1)
        inside[mine] = s.inside[s.order]
    lens, docs = np.array([len(r[3]) for r in rows]), np.array([r[1] for r in rows], np.int64)
    full = (row >= 0) & (inside + SIZE <= lens[row])
    row, inside, block = row[full], inside[full], block[full]
    if not len(row):
        return _spans(*(np.zeros(0),) * 3, np.zeros(0, np.uint64))
    starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    least = np.repeat(np.minimum.reduceat(docs[row], starts), np.diff(np.append(starts, len(row))))
    late = docs[row] > least
    key = np.sort(row[late] * 4096 + inside[late])  # segments are far shorter
    new = np.concatenate(([True], key[1:] != key[:-1] + 1)) if len(key) else np.zeros(0, bool)
    runs = np.flatnonzero(new)
    last = key[np.append(runs[1:], len(key)) - 1] if len(key) else key
    at = np.array([r[2] for r in rows], np.int64)[key[runs] // 4096]
    return _spans(docs[key[runs] // 4096], at + key[runs] % 4096, at + last % 4096 + SIZE, np.zeros(len(runs), np.uint64))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for row in b.to_pylist():
            raw = row["text"].encode()
            kept, at, removed, runs = hashlib.sha256(), 0, 0, []
            for a, z in sorted((s["start"], s["end"]) for s in row["spans"] or ()):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], z)
                else:
                    runs.append([a, z])
            for a, z in runs:
                kept.update(raw[at:a])
                at, removed = z, removed + z - a
            kept.update(raw[at:])
            out.append((row["doc_id"], len(raw), removed, len(runs), kept.hexdigest()))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = (*(pa.int64(),) * 4, pa.string())
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end): bytes covered by strings of SIZE bytes that a smaller document has; spans may overlap.

    Rows of a null id neither remove nor are removed from; rows of one id don't
    remove from each other, and must have one text: a span of one would be taken
    from all of them. Null texts are empty and texts of any length are taken whole;
    further columns are left behind; an empty table gives no spans.
    """
    spark = docs.sparkSession
    docs = with_text(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), "doc_id").where("doc_id IS NOT NULL")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // PART_BYTES) + 1)
    dealt = docs.mapInArrow(_emit(parts), "part bigint, docs binary, grams binary, around binary, pos binary")
    decided = dealt.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_classes, _SPANS)
    decided = written(decided, "spans", tidy=True)
    places = decided.where("end = 0").groupBy("doc_id").agg(
        F.collect_list("start").alias("places"), F.collect_list("gram").alias("grams")
    )
    segments = docs.join(places, "doc_id").mapInArrow(_segments, "gram bigint, doc_id bigint, start bigint, segment binary")
    merged = segments.repartition("gram").sortWithinPartitions("gram").mapInArrow(_bucket, _SPANS)
    merged = written(merged, "spans", tidy=True)  # the texts that segments are cut from and those that spans are cut from don't lie side by side
    return decided.where("end > 0").unionByName(merged).select("doc_id", "start", "end")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row; see repeated_spans."""
    spans = repeated_spans(docs).groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    docs = with_text(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), "doc_id")
    kinds = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return docs.join(spans, "doc_id", "left").mapInArrow(_kept, kinds)
