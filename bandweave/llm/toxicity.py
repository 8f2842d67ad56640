"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score of its
words; a leaky noisy-or combines them, so that a document is toxic if any
sentence is, or by a constant chance that stands for labels that no sentence
explains and that doesn't grow with the number of sentences. What the bias alone
gives a sentence is taken off again when documents are scored, or a long clean
text would become toxic by its length. Only documents have
labels: their likelihood trains the sentences' weights, which then point out the
offending sentences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, cut_long, let_go, pieces, text_buffers, text_slices, trim, with_text, word_hashes

BUCKETS = 1 << 18
#: The classifier is fitted on a uniform sample of so many labelled documents at most, those of the smallest hashes of ids.
SAMPLE_DOCS = 8000
#: Words have a weight if their documents' labels differ from the others' by so much (chi-squared, one degree).
LEAST_CHI2 = 16.0
EPOCHS, BATCH, RATE, DECAY = 40, 128, 0.2, 1e-5
THRESHOLD = 0.3
_STOPS = np.zeros(256, bool)
_STOPS[[*b".!?\n"]] = True


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    leak: float

    def risen(self, p: np.ndarray) -> np.ndarray:
        """Logarithms of what sentences leave clear beyond the bias alone: zero without telling words, whatever the length."""
        return np.minimum(0.0, np.log1p(-p) - np.log1p(-_sigmoid(np.array(self.bias))))

    def sums(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Summed weights of sentences given as starts in an array of word buckets."""
        return np.add.reduceat(self.weights[words], starts, dtype=np.float64)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def sentence_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Buckets of all words; starts of the sentences among them, their rows, and their byte ranges."""
    at, ends, rows, hashes = word_hashes(data, offsets)
    if not len(at):
        return (np.zeros(0, np.int64),) * 5
    stops = np.concatenate(([0], np.cumsum(_STOPS[data])))
    new = np.ones(len(at), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (stops[at[1:]] != stops[at[:-1]])
    starts = np.flatnonzero(new)
    last = np.append(starts[1:], len(at)) - 1
    return (hashes % np.uint64(BUCKETS)).astype(np.int64), starts, rows[starts], at[starts], ends[last]


def _parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
    """sentence_words() of slices of texts, with rows and byte places in the whole; and whether the first goes on a sentence.

    A long text comes in several slices; a sentence across a cut is one.
    """
    cuts, owners = cut_long(data, offsets)
    before, end = -1, 0
    for a, z in pieces(cuts, SLICE_BYTES // 4):  # hashing takes some eighty bytes for each
        part = cuts[a : z + 1]
        words, starts, rows, low, high = sentence_words(data[part[0] : part[-1]], part - part[0])
        if len(starts):
            rows, low, high = owners[a + rows], low + part[0], high + part[0]
            yield words, starts, rows, low, high, rows[0] == before and not _STOPS[data[end : low[0]]].any()
            before, end = rows[-1], high[-1]


def _bags(docs: DataFrame, label: str) -> DataFrame:
    """(label, words, starts): buckets and sentence starts of each document as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in text_slices(batch)):
            data, offsets = text_buffers(b.column("text"))
            words, starts, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            size, first = 0, np.zeros(b.num_rows + 1, np.int64)  # words before each document
            for found, at, row, _, _, goes_on in _parts(data, offsets):
                words.append(found)
                starts.append(size + at[int(goes_on) :])
                rows.append(row[int(goes_on) :])
                np.add.at(first, row + 1, np.diff(np.append(at, len(found))))
                size += len(found)
            flat, at, row = np.concatenate(words), np.concatenate(starts), np.concatenate(rows)
            first = np.cumsum(first)
            cut = np.searchsorted(row, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(label).cast(pa.int32()),
                    pa.array([flat[x:y].astype("<i4").tobytes() for x, y in zip(first, first[1:], strict=False)], pa.binary()),
                    pa.array([(at[cut[i] : cut[i + 1]] - first[i]).astype("<i4").tobytes() for i in range(b.num_rows)], pa.binary()),
                ],
                names=["label", "words", "starts"],
            )

    return docs.mapInArrow(run, "label int, words binary, starts binary")


def fit(labelled: DataFrame, label: str = "toxic") -> Model:
    """Fit on documents (doc_id, text, label): on those whose ids have the SAMPLE_DOCS smallest hashes.

    Rows of a null label or id are not learnt from. Documents of the same words
    count once, with the larger label, and are taken in one order, so a table
    always gives the same model. Null and empty texts are bags without sentences.
    Without both labels the leak alone is left.
    """
    labelled = labelled.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    labelled = with_text(labelled.withColumn("doc_id", F.col("doc_id").cast("bigint")), "doc_id", label)
    order = F.xxhash64("doc_id")
    hashes = labelled.select(order.alias("h")).distinct().orderBy("h").limit(SAMPLE_DOCS)
    last = hashes.agg(F.max("h")).first()[0]  # a number, so that the filter reaches the scan and no other text is moved
    rows = _bags(labelled.where(order <= F.lit(last)), label).toPandas()
    rows = rows.sort_values(["words", "starts", "label"], ascending=[True, True, False]).drop_duplicates("words")
    y = (rows["label"].to_numpy(dtype=np.int64) > 0).astype(float)
    model = Model(np.zeros(BUCKETS, np.float32), -7.0, float(np.clip(y.mean() if len(y) else 0.01, 1e-3, 0.2)))
    if not len(y) or y.min() == y.max():
        return model
    words = [np.frombuffer(w, "<i4") for w in rows["words"]]
    starts = [np.frombuffer(s, "<i4").astype(np.int64) for s in rows["starts"]]
    _descend(model, words, starts, y, _telling(words, y))
    del rows, words, starts
    trim()  # the driver's Python would keep what the sample took
    return model


def _telling(words: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Buckets whose documents have other labels than the rest, by Yates' corrected chi-squared."""
    seen = np.zeros((2, BUCKETS))
    for w, label in zip(words, y, strict=True):
        seen[int(label > 0), np.unique(w)] += 1
    n, ones = len(y), float(y.sum())
    with_word = seen.sum(axis=0)
    gap = np.abs(seen[1] * n - with_word * ones)
    spread = with_word * (n - with_word) * ones * (n - ones)
    chi2 = n * np.maximum(gap - n / 2, 0) ** 2 / np.maximum(spread, 1)
    return np.flatnonzero(chi2 >= LEAST_CHI2)


def _descend(model: Model, words: list, starts: list, y: np.ndarray, known: np.ndarray) -> None:
    """Mini-batch Adam on the documents' log-likelihood, over the known buckets."""
    place = np.full(BUCKETS, len(known), np.int32)  # the last place takes all other words and keeps weight zero
    place[known] = np.arange(len(known))
    words = [place[w] for w in words]
    size = len(known) + 3
    theta = np.zeros(size)  # weights, other words, bias, logit of the leak
    theta[-2], theta[-1] = model.bias, np.log(model.leak / (1 - model.leak))
    m, v, step = np.zeros(size), np.zeros(size), 0
    order = np.random.default_rng(0)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        perm = order.permutation(len(y))
        for at in range(0, len(perm), BATCH):
            docs = [d for d in perm[at : at + BATCH] if len(words[d])]
            if not docs:
                continue
            flat = np.concatenate([words[d] for d in docs])
            shift = np.cumsum([0, *(len(words[d]) for d in docs[:-1])])
            first = np.concatenate([starts[d] + s for d, s in zip(docs, shift, strict=True)])
            bags = np.cumsum([0, *(len(starts[d]) for d in docs[:-1])])
            sizes = np.array([len(starts[d]) for d in docs])
            p = _sigmoid(np.add.reduceat(theta[flat], first) + theta[-2])
            leak = _sigmoid(theta[-1:])[0]
            clear = np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-9)), bags) + np.log1p(-leak)
            hit = -np.expm1(clear)
            weight = np.where(y[docs] > 0, -(1 - hit) / np.maximum(hit, 1e-9), 1.0) / len(docs)
            slope = p * np.repeat(weight, sizes)
            grad = np.zeros(size)
            lengths = np.diff(np.append(first, len(flat)))
            grad[: len(known) + 1] = np.bincount(flat, np.repeat(slope, lengths), len(known) + 1)
            grad[: len(known)] += DECAY * theta[: len(known)]
            grad[len(known)] = 0
            grad[-2], grad[-1] = slope.sum(), leak * weight.sum()
            step += 1
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.weights[known] = theta[: len(known)]
    model.bias, model.leak = float(theta[-2]), float(_sigmoid(theta[-1:])[0])


def score_documents(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns keep, then score, predicted and offending: UTF-8 byte ranges of sentences that reach THRESHOLD.

    Every row gets a score, empty and null texts the leak's. Texts of any length
    are scored whole, sentences that lie across a slice's end too (only a word of
    over half a MiB is cut). Repeated rows and null ids stay; further columns
    don't matter; an empty table gives an empty result. Where keep has the text,
    it goes through the tasks once and comes back as it was, null or not.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.leak))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        known = Model(*shared.value)
        for b in (part for batch in batches for part in text_slices(batch)):
            data, offsets = text_buffers(b.column("text").fill_null(""))
            clear, bad = np.full(b.num_rows, np.log1p(-known.leak)), [[] for _ in range(b.num_rows)]
            held = [np.zeros((4, 0))]  # row, start, end and summed weights of the sentences
            for words, starts, rows, low, high, goes_on in _parts(data, offsets):
                part = np.stack((rows, low, high, known.sums(words, starts)))
                if goes_on:
                    held[-1][3, -1] += part[3, 0]
                    held[-1][2, -1] = part[2, 0]
                    part = part[:, 1:]
                if part.shape[1]:
                    held.append(part)
            rows, low, high = (x.astype(np.int64) for x in np.concatenate(held, axis=1)[:3])
            p = np.minimum(_sigmoid(np.concatenate(held, axis=1)[3] + known.bias), 1 - 1e-9)
            np.add.at(clear, rows, known.risen(p))
            for s in np.flatnonzero(p >= THRESHOLD).tolist():
                base = offsets[rows[s]]
                bad[rows[s]].append(f"{low[s] - base}:{high[s] - base}")
            score = np.clip(-np.expm1(clear), 0, 1)
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(k) for k in keep),
                    pa.array(score),
                    pa.array((score >= THRESHOLD).astype(np.int32)),
                    pa.array([",".join(s) for s in bad]),
                ],
                names=[*keep, "score", "predicted", "offending"],
            )

    texts = docs.select(*keep) if "text" in keep else with_text(docs, *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name in keep)
    return texts.mapInArrow(run, f"{kinds}, score double, predicted int, offending string")


def remainder(doc_id, divisor: int):
    """crc32 of the id's text modulo divisor; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents joined to their labels, without the held-out rows (remainder 2 of 4).

    A label is looked up once for each document; of labels that contradict each other the larger holds.
    """
    known = labels.where(F.col("toxic").isNotNull() & (remainder("doc_id", 4) != 2))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text").join(known, "doc_id")
