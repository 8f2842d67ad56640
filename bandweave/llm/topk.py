"""Exact top-k inner-product search by a three-phase uniform threshold.

Every vector's score with a query is the sum of BLOCKS partial scores, one for
each block of dimensions, and each task holds such lists for its own vectors.

1. Each task takes the k best entries of each query's local lists, resolves
   their whole scores and hands on the k best; the k-th best of all tasks'
   scores is a safe cutoff, since so many vectors reach it.
2. The cutoffs are broadcast. A vector that reaches the cutoff has a partial
   score of at least cutoff / BLOCKS in some list, so only such entries are
   collected.
3. The collected vectors' remaining partial scores are added exactly; each task
   returns its k best, and a final ranking keeps k of them for a query.

Queries are taken QUERY_BLOCK at a time, so that what is broadcast is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCKS = 4
QUERY_BLOCK = 4096
CANDIDATE_ROWS = 4096
#: Sums of products below this are exact in doubles.
EXACT = float(2**53)


def integer_vectors(df: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, v array<bigint>): floor(scale * x) of vectors whose components are all finite.

    A null id, a null vector and one with a null, NaN or infinite component take no part.
    """
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return df.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.col(vec_id).cast("bigint").alias("vec_id"),
        F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("v"),
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, cut or padded with zeros to width: a missing component adds nothing."""
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    ends = np.cumsum(sizes)
    for i, (n, end) in enumerate(zip(sizes.tolist(), ends.tolist(), strict=True)):
        out[i, : min(n, width)] = flat[end - n : end - n + min(n, width)]
    return out


def _partials(x: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
    """Exact partial score lists, candidates by queries, one for each block of dimensions."""
    top = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, q.shape[1])
    kind = np.float64 if top < EXACT else np.int64
    cuts = np.array_split(np.arange(q.shape[1]), min(BLOCKS, max(1, q.shape[1])))
    return [x[:, c].astype(kind) @ q[:, c].astype(kind).T for c in cuts]


def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, CANDIDATE_ROWS):
            part = b.slice(at, CANDIDATE_ROWS)
            ids = part.column("vec_id").to_numpy(zero_copy_only=False)
            yield ids, _matrix(part.column("v"), width)


class _Best:
    """The k best (score descending, id ascending) of each query over the batches of a task."""

    def __init__(self, queries: int, k: int):
        self.k, self.rows = k, [np.zeros((0, 2), np.int64) for _ in range(queries)]

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        both = np.concatenate((self.rows[query], np.stack((scores.astype(np.int64), ids), axis=1)))
        self.rows[query] = both[np.lexsort((both[:, 1], -both[:, 0]))[: self.k]]

    def batch(self, qids: np.ndarray) -> pa.RecordBatch:
        sizes = [len(r) for r in self.rows]
        rows = np.concatenate(self.rows) if self.rows else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(qids, sizes)), pa.array(rows[:, 1].copy()), pa.array(rows[:, 0].copy())],
            names=["query_id", "vec_id", "score"],
        )


_SCHEMA = "query_id bigint, vec_id bigint, score bigint"


def _local_lists(qids: np.ndarray, q: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(qids), k)
        for ids, x in _batches(batches, q.shape[1]):
            lists = _partials(x, q)
            total = sum(lists)
            for part in lists:
                part[ids[:, None] == qids[None, :]] = np.iinfo(np.int64).min // 4
            take = min(k, len(ids))
            gathered = np.concatenate([np.argpartition(-p, take - 1, axis=0)[:take] for p in lists])
            for j in range(len(qids)):
                at = np.unique(gathered[:, j])
                at = at[ids[at] != qids[j]]
                best.add(j, ids[at], total[at, j])
        yield best.batch(qids)

    return run


def _resolve(qids: np.ndarray, q: np.ndarray, cutoff: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(qids), k)
        for ids, x in _batches(batches, q.shape[1]):
            lists = _partials(x, q)
            enough = lists[0] >= cutoff / len(lists)
            for part in lists[1:]:
                enough |= part >= cutoff / len(lists)
            at, j = np.nonzero(enough)
            scores = sum(p[at, j] for p in lists)
            keep = (scores >= cutoff[j]) & (ids[at] != qids[j])
            at, j, scores = at[keep], j[keep], scores[keep]
            order = np.argsort(j, kind="stable")
            found, first = np.unique(j[order], return_index=True)
            for query, rows in zip(found.tolist(), np.split(order, first)[1:], strict=True):
                best.add(query, ids[at[rows]], scores[rows])
        yield best.batch(qids)

    return run


def top_k(
    df: DataFrame,
    is_query,
    k: int = 10,
    scale: int = 1024,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows by integer inner product.

    is_query is a condition on column vec_id. Ties go to the smaller id; fewer
    than k candidates give fewer rows. A row never answers a query of its own
    id. Repeated rows of an id are candidates of their own; as queries, one
    (the smallest vector) stands for an id. Vectors of other lengths count as
    padded with zeros. Further columns are left behind. Empty input gives an empty result.
    """
    spark = df.sparkSession
    vectors = integer_vectors(df, vec_id, vector, scale)
    queries = written(vectors.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    out = None
    for ids in _blocks(queries):
        block = queries.where(F.col("vec_id").between(*ids)).orderBy("vec_id").toArrow()
        qids = block.column("vec_id").to_numpy()
        width = max(len(v) for v in block.column("v").to_pylist())
        q = _matrix(block.column("v").combine_chunks(), width)
        local = vectors.mapInArrow(_local_lists(qids, q, k), _SCHEMA)
        safe = _ranked(local, k).groupBy("query_id").agg(F.min("score").alias("s"), F.count("*").alias("n"))
        known = {r.query_id: r.s for r in safe.collect() if r.n >= k}  # at most QUERY_BLOCK rows
        cutoff = np.array([known.get(i, -(2.0**62)) for i in qids.tolist()])
        part = _ranked(vectors.mapInArrow(_resolve(qids, q, cutoff, k), _SCHEMA), k)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = _ranked(spark.createDataFrame([], _SCHEMA), k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _blocks(queries: DataFrame) -> list[tuple[int, int]]:
    """Smallest and largest id of each block of at most QUERY_BLOCK queries."""
    n = queries.count()
    blocks = -(-n // QUERY_BLOCK)
    if blocks <= 1:
        low, high = queries.agg(F.min("vec_id"), F.max("vec_id")).first()
        return [(low, high)] if n else []
    cuts = queries.select("vec_id").repartitionByRange(blocks * 2, "vec_id")
    spans = cuts.groupBy(F.spark_partition_id().alias("p")).agg(
        F.min("vec_id").alias("low"), F.max("vec_id").alias("high")
    )
    return [(r.low, r.high) for r in spans.orderBy("low").collect()]


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
