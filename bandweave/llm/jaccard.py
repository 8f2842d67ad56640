"""Near-duplicates by the Jaccard similarity of word shingles: ball hashing for candidates, whole sets to verify.

A SimHash of 64 bits within 4 bits misses most pairs of similarity 0.8. So each
distinct shingle set gets TABLES independent fingerprints of WIDTH one-bit
minwise hashes, of which two sets of similarity J differ in (1 - J) / 2 of the
bits; each is searched by the same meet-in-the-middle balls. Every pair is
verified by the sets themselves before it links anything.

Pairs are looked at in two rounds. In the first each fingerprint meets one
near one, and sets of equal fingerprints meet one of them; in a large group of
near copies this links nearly all. In the second, the sets that have partners
which they did not meet are compared with every one of another component by
blocks, so no candidate is left out, a group that is linked already is not
compared, and only what links components leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forget, let_go, mix, with_text, written
from .meeting import meetings, nearest
from .simhash import BITS, SEED, shingle_hashes

TABLES, WIDTH = 4, 40
#: Pairs of one set that are verified at one place.
_PAIRS = 64
#: Sets, and shingles in them, that a block has on average; two blocks are compared in one task.
_BLOCK_SETS, _BLOCK_SHINGLES = 64, 1 << 18
_BLOCK = 1 << 12
_TURNS = np.random.default_rng(SEED).integers(0, 1 << 63, TABLES * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Distinct hashes of the word shingles, ascending; none without words."""
    return np.unique(shingle_hashes(text, shingle))


def minwise(found: np.ndarray) -> np.ndarray:
    """TABLES fingerprints in the first WIDTH bits of 64-bit integers; zero of an empty set."""
    if not len(found):
        return np.zeros(TABLES, np.uint64)
    least = np.full(len(_TURNS), np.iinfo(np.uint64).max, np.uint64)
    spread = mix(found)
    for at in range(0, len(found), _BLOCK):
        least = np.minimum(least, (_TURNS[:, None] * spread[None, at : at + _BLOCK]).min(axis=1))
    bits = (mix(least) & np.uint64(1)).reshape(TABLES, WIDTH)
    return (bits << (np.uint64(BITS - 1) - np.arange(WIDTH, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)


def _key(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def _sketches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            keys, sizes, fps = [], [], []
            for t in b.column("text").to_pylist():
                found = shingle_set(t, shingle)
                keys.append(_key(found))
                sizes.append(len(found))
                fps.append(minwise(found))
            table = np.array(fps, np.uint64).reshape(-1, TABLES).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array(np.array(keys, np.uint64).view(np.int64)),
                    pa.array(sizes, pa.int64()),
                    *(pa.array(table[:, k].copy()) for k in range(TABLES)),
                ],
                names=["doc_id", "key", "size", *(f"fp{k}" for k in range(TABLES))],
            )

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, shingle).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(sets, pa.binary())], names=["key", "shingles"])

    return run


def _similar(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both))
            kept = b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            yield kept

    return run


def first_pairs(items: DataFrame, radius: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(a, b) of keys, a < b, to verify first, and (table, fp, key, size) of the sets that have partners beside those.

    A fingerprint's lead, another set of it in each table, meets the sets of
    the same fingerprint and the lead of one near fingerprint. Pairs whose
    sizes exclude a similarity of least are left out.
    """
    found, crowded, fits = [], [], F.least("na", "nb") >= least * F.greatest("na", "nb")
    for k in range(TABLES):  # each table's are written, so that plans stay small and few tasks run beside each other
        mine = items.select(F.col(f"fp{k}").alias("fp"), "key", "size")
        turn = F.xxhash64("key", F.lit(k))  # one to one, so the two are of one set
        lead = [F.min_by("key", turn).alias("a"), F.min_by("size", turn).alias("na"), F.count("*").alias("sets")]
        leads = written(mine.groupBy("fp").agg(*lead), "leads")
        near = nearest(leads.select("fp"), radius, WIDTH)
        met = near.join(leads, "fp").join(leads.toDF("partner", "b", "nb", "others"), "partner")
        met = written(met, "met")
        same = mine.join(leads.where("sets > 1"), "fp").select("a", "na", F.col("key").alias("b"), F.col("size").alias("nb"))
        pairs = met.select("a", "na", "b", "nb").union(same).where((F.col("a") != F.col("b")) & fits)
        found.append(written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs"))
        rest = met.where("more OR sets > 1 OR others > 1").select("fp").union(leads.where("sets > 2").select("fp")).distinct()
        crowded.append(written(mine.join(rest, "fp", "left_semi").select(F.lit(k).alias("table"), "fp", "key", "size"), "crowds"))
        forget(leads, met)
    pairs = written(reduce(DataFrame.unionByName, found).distinct(), "pairs")
    every = written(reduce(DataFrame.unionByName, crowded), "crowds")
    forget(*found, *crowded)
    return pairs, every


def _joined(radius: int, least: float):
    """Rows of two blocks, or of one: links of similar sets within radius bits in a table that join components."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        number = lambda name: rows.column(name).to_numpy()
        key, label = number("key"), number("component").copy()
        fps = np.stack([number(f"fp{k}") for k in range(TABLES)], axis=1).view(np.uint64)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("shingles")]
        here = (number("own") == number("own_a")) & (number("block") == number("block_a"))
        left, right = np.flatnonzero(here), np.flatnonzero(~here)
        alone = not len(right)
        right = left if alone else right
        known, codes = np.unique(np.concatenate(sets), return_inverse=True)
        sizes = np.array([len(x) for x in sets])
        codes = np.split(codes, np.cumsum(sizes)[:-1])
        flat, starts = np.concatenate([codes[r] for r in right]), np.cumsum(sizes[right]) - sizes[right]
        mark, links = np.zeros(len(known), bool), []
        for a in left.tolist():
            near = (np.bitwise_count(fps[right] ^ fps[a]) <= radius).any(axis=1) & (label[right] != label[a])
            if alone:
                near &= right > a
            if not near.any():
                continue
            mark[codes[a]] = True
            both = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[codes[a]] = False
            for b in right[near & (both >= least * (sizes[a] + sizes[right] - both))].tolist():
                if label[a] != label[b]:
                    label[label == label[b]] = label[a]
                    links.append((min(key[a], key[b]), max(key[a], key[b])))
        found = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": found[:, 0].copy(), "b": found[:, 1].copy()})

    return run


def other_links(crowded: DataFrame, items: DataFrame, sets: DataFrame, radius: int, least: float) -> DataFrame:
    """(a, b) of keys: links that join the components of (table, fp, key, component), as all similar pairs within radius bits in a table do.

    Components that meet form a cluster; its sets are dealt over blocks, a large
    component's over its own, and each two blocks are looked at in one task, all
    but those of one component. A task verifies what is near and hands on links
    that join components only, so a pair that is refused is no row.
    """
    clusters = components(meetings(crowded, radius, WIDTH)).toDF("component", "cluster")
    clusters = clusters.union(clusters.select("cluster", "cluster").distinct())
    members = items.drop("doc").join(crowded.select("key", "component").distinct().join(clusters, "component"), "key")
    members = written(members, "members")
    load = lambda *by: members.groupBy(*by).agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    full = F.greatest(F.col("n") / _BLOCK_SETS, F.col("s") / _BLOCK_SHINGLES)
    # own: the component that fills blocks of its own; 0 for the others (if 0 is a component, too, they are compared together)
    owners = load("cluster", "component").withColumn("own", F.when(full > 1, F.col("component")).otherwise(F.lit(0)))
    blocks = owners.groupBy("cluster", "own").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    blocks = written(blocks.select("cluster", "own", F.ceil(full).cast("int").alias("blocks")), "blocks")
    cells = blocks.select("cluster", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    one, other = cells.toDF("cluster", "own_a", "block_a"), cells.toDF("cluster", "own_b", "block_b")
    order = F.struct("own_a", "block_a") <= F.struct("own_b", "block_b")
    both = one.join(other, "cluster").where(order & ((F.col("own_a") != F.col("own_b")) | (F.col("own_a") == 0)))
    ends = F.array_distinct(F.array(*(F.struct(F.col(f"own_{x}").alias("own"), F.col(f"block_{x}").alias("block")) for x in "ab")))
    both = both.withColumn("end", F.explode(ends)).select("*", "end.own", "end.block").drop("end")
    placed = members.join(owners.select("cluster", "component", "own"), ["cluster", "component"]).join(blocks, ["cluster", "own"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).drop("blocks", "size")
    whole = placed.join(sets, "key").join(both, ["cluster", "own", "block"])
    links = whole.groupBy("cluster", "own_a", "block_a", "own_b", "block_b").applyInArrow(_joined(radius, least), "a bigint, b bigint")
    links = written(links, "similar")
    forget(members, blocks)
    return links


def _dealt(pairs: DataFrame, sets: DataFrame, end: str) -> DataFrame:
    """pairs with the set of one end; a key of many pairs is copied to several places."""
    other = "b" if end == "a" else "a"
    copies = pairs.groupBy(end).agg(F.ceil(F.count("*") / _PAIRS).cast("int").alias("copies"))
    salted = pairs.join(copies, end).withColumn("salt", F.pmod(F.xxhash64(other), F.col("copies")).cast("int")).drop("copies")
    spread = sets.join(copies.withColumnRenamed(end, "key"), "key").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))
    )
    spread = spread.select(F.col("key").alias(end), "salt", F.col("shingles").alias(f"s{end}"))
    return salted.join(spread, [end, "salt"]).drop("salt")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    whole = _dealt(_dealt(pairs, sets, "a"), sets, "b").select("a", "b", "sa", "sb")
    return whole.mapInArrow(_similar(least), "a bigint, b bigint").distinct()


def similar_groups(docs: DataFrame, shingle: int, radius: int, least: float) -> DataFrame:
    """(doc_id, component_id) of every row with an id: the smallest id reachable over pairs of similarity least or more.

    Equal sets, empty ones too, have similarity 1; null texts count as empty.
    """
    docs = docs.where(F.col("doc_id").isNotNull()).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    texts = with_text(docs, "doc_id")
    kinds = ", ".join(f"fp{k} bigint" for k in range(TABLES))
    rows = written(texts.mapInArrow(_sketches(shingle), f"doc_id bigint, key bigint, size bigint, {kinds}"), "sketches")
    every = [F.first(c).alias(c) for c in ("size", *(f"fp{k}" for k in range(TABLES)))]
    items = written(rows.groupBy("key").agg(F.min("doc_id").alias("doc"), *every), "sets")
    pairs, crowded = first_pairs(items.where("size > 0"), radius, least)
    ends = pairs.select("a").union(pairs.select("b")).union(crowded.select("key")).distinct().toDF("key")
    wanted = items.join(ends, "key", "left_semi").select(F.col("doc").alias("doc_id"), "key")
    sets = written(
        texts.join(rows.select("doc_id", "key").join(wanted, ["doc_id", "key"], "left_semi").distinct(), "doc_id").mapInArrow(
            _sets(shingle), "key bigint, shingles binary"
        ),
        "shingles",
    )
    similar = written(_verified(pairs, sets, least), "similar")
    groups = components(similar)
    apart = written(
        crowded.join(groups, F.col("key") == F.col("node"), "left").withColumn("component", F.coalesce("component", "key")).drop("node"),
        "crowds",
    )
    similar = similar.union(other_links(apart, items, sets, radius, least))
    forget(crowded, apart, pairs, sets)
    name = items.select("key", "doc")
    linked = similar.join(name.toDF("a", "da"), "a").join(name.toDF("b", "db"), "b").select(F.col("da").alias("a"), F.col("db").alias("b"))
    own = rows.select("doc_id", "key").distinct().join(name, "key")
    twice = own.groupBy("doc_id").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    groups = components(linked.union(twice.select("low", "high")))
    return own.join(groups, F.col("doc") == F.col("node"), "left").select("doc_id", F.coalesce("component", "doc").alias("component_id"))
