"""Token ids in block files: one shared zstandard dictionary, one frame a document, an offset index.

A token file is a folder with

* blocks: Parquet rows of up to BLOCK_DOCS documents in ascending id order. Each
  has the ids of its documents, their token counts, the offsets of their frames
  and the frames; the SHA-256 of the dictionary that they need; the part that it
  belongs to and the number of tokens before it in that part.
* dictionary: its bytes and their SHA-256.
* parts: the number of tokens before each part.

One document is read by finding its block (first_id, last_id: Parquet statistics
skip the others), its offset, and unpacking that frame alone.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import with_text
from .lexicon import lexicon

#: Id appended to each document.
END = 1
BLOCK_DOCS, BLOCK_BYTES = 256, 1 << 20
LEVEL = 3
#: The dictionary is fitted on so many documents at most, and so many bytes of each; it affects sizes only.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 4096, 65536

_BLOCK = (
    "part bigint, seq bigint, first_id bigint, last_id bigint, before bigint, width int,"
    " dictionary_sha256 string, doc_ids binary, counts binary, offsets binary, frames binary"
)


def _serialised(text: str, path: str) -> bytes:
    words = lexicon(path)
    return words.serialised(text) + np.array(END, words.dtype).tobytes()


def _sampled(docs: DataFrame, path: str) -> list[bytes]:
    """Serialised ids of the SAMPLE_DOCS documents that have the smallest hashes, in that order.

    The greatest of those hashes is found first, by hashes alone, so that no texts but the sample's are gathered.
    """
    hashed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("hash"))
    last = hashed.select("hash").orderBy("hash").limit(SAMPLE_DOCS).agg(F.max("hash")).first()[0]
    picked = hashed.where(F.col("hash") <= F.lit(last).cast("bigint")).orderBy("hash", "doc_id", "text").limit(SAMPLE_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_serialised(t, path)[:SAMPLE_BYTES] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("hash"), pa.array(out, pa.binary())], names=["hash", "ids"])

    found = picked.mapInArrow(run, "hash bigint, ids binary")
    return [bytes(r.ids) for r in sorted(found.collect(), key=lambda r: (r.hash, bytes(r.ids)))]


def train_dictionary(docs: DataFrame, path: str) -> bytes:
    """Dictionary bytes; the samples themselves where they are too few for the trainer."""
    samples = _sampled(docs, path)
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples).as_bytes()
    except (ValueError, zstandard.ZstdError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    )


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _pack(path: str, dictionary: bytes):
    sha, names = hashlib.sha256(dictionary).hexdigest(), [c.split()[0] for c in _BLOCK.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype, squeeze = lexicon(path).dtype, _compressor(dictionary)
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        ids: list[int] = []
        counts: list[int] = []
        frames: list[bytes] = []

        def block() -> pa.RecordBatch:
            offsets = np.cumsum([0, *map(len, frames)]).astype("<u8").tobytes()
            known = [i for i in ids if i is not None]
            row = [
                part, seq, min(known, default=None), max(known, default=None), before, dtype.itemsize, sha,
                np.array([i if i is not None else np.iinfo(np.int64).min for i in ids], "<i8").tobytes(),
                np.array(counts, "<u4").tobytes(), offsets, b"".join(frames),
            ]
            return pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], schema=_arrow_block())

        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                raw = _serialised(text, path)
                ids.append(i)
                counts.append(len(raw) // dtype.itemsize)
                frames.append(squeeze.compress(raw))
                if len(ids) >= BLOCK_DOCS or sum(map(len, frames)) >= BLOCK_BYTES:
                    yield block()
                    seq, before = seq + 1, before + sum(counts)
                    ids, counts, frames = [], [], []
        if ids:
            yield block()

    return run


def _arrow_block() -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in _BLOCK.split(","))])


def write_token_files(docs: DataFrame, out: str, path: str) -> None:
    """Write documents (doc_id, text) to folder out in ascending id order.

    Null texts are empty; a null id sorts first and is kept; repeated rows are
    separate documents, equal ids in any order; texts of any length are one frame
    each; further columns are left behind; an empty table gives empty files. The
    smallest 64-bit integer stands for a null id and reads back as null.
    """
    spark = docs.sparkSession
    docs = with_text(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), "doc_id")
    dictionary = train_dictionary(docs, path)
    sha = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(sha, dictionary)], "sha256 string, dictionary binary").write.parquet(f"{out}/dictionary")
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(_pack(path, dictionary), _BLOCK).write.option("compression", "uncompressed").parquet(
        f"{out}/blocks"
    )
    blocks = spark.read.parquet(f"{out}/blocks")
    # A row for each part of the shuffle: as many as tasks.
    parts = blocks.groupBy("part").agg(
        F.min("first_id").alias("low"),
        F.sum(F.aggregate(_counts("counts"), F.lit(0).cast("bigint"), lambda a, c: a + c)).alias("n"),
    )
    order = Window.orderBy(F.asc_nulls_first("low"), "part").rowsBetween(Window.unboundedPreceding, -1)
    parts.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base")).write.parquet(f"{out}/parts")


def _counts(column: str):
    """Little-endian unsigned 32-bit integers of a binary column."""
    digits = F.hex(column)
    at = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)), F.lit(8))
    pair = lambda p, k: F.substring(digits, p + k, F.lit(2))
    return F.transform(
        at, lambda p: F.conv(F.concat(pair(p, 6), pair(p, 4), pair(p, 2), pair(p, 0)), 16, 10).cast("bigint")
    )


def _unpack(dictionary: bytes, sha: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = _decompressor(dictionary)
        for b in batches:
            for row in b.to_pylist():
                if row["dictionary_sha256"] != sha:
                    raise ValueError(f"frames need dictionary {row['dictionary_sha256']}, not {sha}")
                ids = np.frombuffer(row["doc_ids"], "<i8").tolist()
                offsets = np.frombuffer(row["offsets"], "<u8").tolist()
                start, cols = row["base"] + row["before"], ([], [], [], [])
                for i, a, z in zip(ids, offsets, offsets[1:], strict=False):
                    raw = np.frombuffer(expand.decompress(row["frames"][a:z]), f"<u{row['width']}").astype("<u4")
                    last = crc32(raw) if digest else raw.tobytes()
                    values = (i if i != np.iinfo(np.int64).min else None, start, len(raw), last)
                    for c, v in zip(cols, values, strict=True):
                        c.append(v)
                    start += len(raw)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.binary())
                arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
                names = ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def read_token_files(
    spark: SparkSession, folder: str, doc_ids: list[int] | None = None, digest: bool = False
) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids as little-endian unsigned 32-bit integers, or their ids_crc32 for digest.

    With doc_ids, only blocks that can hold them are read; each frame stands alone.
    """
    stored = spark.read.parquet(f"{folder}/dictionary").first()
    blocks = spark.read.parquet(f"{folder}/blocks").join(spark.read.parquet(f"{folder}/parts"), "part")
    if doc_ids is not None:
        low, high = min(doc_ids, default=0), max(doc_ids, default=-1)
        blocks = blocks.where((F.col("first_id") <= high) & (F.col("last_id") >= low))
    out = blocks.mapInArrow(
        _unpack(bytes(stored.dictionary), stored.sha256, digest),
        "doc_id bigint, start bigint, n_tokens bigint, " + ("ids_crc32 bigint" if digest else "ids binary"),
    )
    return out if doc_ids is None else out.where(F.col("doc_id").isin(doc_ids))


def one_document(frame: bytes, dictionary: bytes, width: int) -> np.ndarray:
    """Ids of one document from its frame alone."""
    return np.frombuffer(_decompressor(dictionary).decompress(frame), f"<u{width}")


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
