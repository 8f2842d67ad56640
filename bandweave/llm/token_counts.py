"""Token counts by a finite-state transducer run over chunks of text in parallel.

The bytes of a batch's texts, one behind the other, are cut into chunks of CHUNK
bytes wherever they fall, and all chunks take one transition at a time.

A chunk is a map from the state in which it is entered to the state in which it
is left, with the tokens emitted. Behind its first blank that map is the same for
every entry; a first pass in which chunks are dead up to there gives that part of
all of them. A prefix scan then composes the maps: a chunk behind one with a
blank knows its entry at once, and where chunks without a blank follow each other
(a word of over CHUNK bytes) entries are handed on, one chunk of every such run a
round. From its entry each chunk takes the transitions up to its first blank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import folded, text_buffers, with_text
from .transducer import DEAD, Full, Transducer, transducer

CHUNK = 256
#: Bytes of text that run at a time; fewer where the table is too small for them.
RUN_BYTES, LEAST_BYTES = 1 << 20, 4096


def _take(machine: Transducer, chunks: np.ndarray, state: np.ndarray, stop: np.ndarray, emitted: np.ndarray) -> np.ndarray:
    """Take the transitions of chunks (bytes, a chunk a column) up to row stop of each; emitted gets the changes."""
    state = state.copy()
    order = np.argsort(-stop, kind="stable")
    live = len(order)
    for i in range(int(stop.max(initial=0))):
        while live and stop[order[live - 1]] <= i:
            live -= 1
        if live == len(order):
            state, emitted[i] = machine.follow(state, chunks[i])
        else:
            mine = order[:live]
            state[mine], emitted[i, mine] = machine.follow(state[mine], chunks[i, mine])
    return state


def emissions(machine: Transducer, data: np.ndarray, entered: tuple) -> tuple[np.ndarray, tuple]:
    """The change of the token count at each byte of data, and the state behind it."""
    n = -(-len(data) // CHUNK)
    size = np.full(n, CHUNK)
    size[-1] = len(data) - CHUNK * (n - 1)
    chunks = np.zeros(n * CHUNK, np.int64)
    chunks[: len(data)] = data
    chunks = np.ascontiguousarray(chunks.reshape(n, CHUNK).T)
    blank = np.zeros(n * CHUNK, bool)
    blank[: len(data)] = (data == 32) | (data == 10) | (data == 9) | (data == 13)
    blank = blank.reshape(n, CHUNK)
    constant = blank.any(axis=1)
    head = np.where(constant, blank.argmax(axis=1) + 1, size)
    emitted = np.zeros((CHUNK, n), np.int8)
    left = _take(machine, chunks, np.full(n, DEAD), size, emitted)
    wave = np.flatnonzero(np.concatenate(([True], constant[:-1])))
    entries = np.concatenate(([machine.number(entered)], left[:-1]))
    while len(wave):
        again = np.zeros((CHUNK, len(wave)), np.int8)
        after = _take(machine, chunks[:, wave], entries[wave], head[wave], again)
        emitted[:, wave] += again  # a dead chunk has emitted nothing
        on = wave[~constant[wave]]
        left[on] = after[~constant[wave]]
        wave = on[on + 1 < n] + 1
        entries[wave] = left[wave - 1]
    return emitted.T.reshape(-1)[: len(data)], machine.state(int(left[-1]))


def _runs(machine: Transducer, data: np.ndarray) -> np.ndarray:
    """emissions() of all of data, in runs that hand on their last state."""
    out, at, state, size = [], 0, ("start", None), RUN_BYTES
    while at < len(data):
        try:
            part, state = emissions(machine, data[at : at + size], state)
        except Full:
            machine.clear()
            size = max(LEAST_BYTES, size // 2)
            continue
        out.append(part)
        at += size
        size = min(RUN_BYTES, size * 2)
    return np.concatenate(out) if out else np.zeros(0, np.int8)


def count_tokens(texts: list[str], machine: Transducer) -> np.ndarray:
    """Tokens of each text."""
    if not machine.compiled:
        return np.array([len(e.ids) for e in machine.library.encode_batch(texts, add_special_tokens=False)], np.int64)
    raw = [machine.readable(t) for t in texts]
    starts = np.cumsum([0, *(len(r) + 1 for r in raw)])[:-1]
    data = folded(np.frombuffer(b" ".join(raw) + b" ", np.uint8))
    if not len(texts):
        return np.zeros(0, np.int64)
    return np.add.reduceat(_runs(machine, data), starts, dtype=np.int64)


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    Null texts are empty and have no tokens, as have texts of white space; texts
    and words of any length are counted whole, in bounded memory; null ids and
    repeated rows stay; further columns don't matter; an empty table gives an
    empty result. Tokenizers of other steps than the transducer knows are
    counted by the library.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for b in batches:
            _, offsets = text_buffers(b.column("text"))
            tokens = count_tokens(b.column("text").to_pylist(), machine)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    docs = with_text(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), "doc_id")
    return docs.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
