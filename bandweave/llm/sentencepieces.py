"""SentencePiece models on the tokenizers library.

The model's protobuf gives pieces, scores and normaliser. A unigram model becomes
the library's Unigram with the same scores; a BPE model becomes its BPE, whose
merges are all splits of a piece into two pieces, best score first. The
normaliser, the metaspace mark, byte fallback and the decoder are rebuilt.

The rebuilt normaliser takes whole texts. No piece has the mark or a line end
behind another character, so nothing merges across the place before such a run:
normalised texts are cut there, and each distinct chunk is encoded once, LEARNT
at a time, and compared with what the sentencepiece library gives for
it. A model of other pieces is encoded whole. Ids of documents are decoded by
joining their pieces' bytes, which the tests hold against the rebuilt decoder and
the sentencepiece library.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from .common import CACHES, pieces, text_buffers, trim

MARK = "▁"
_CHUNKS = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
#: Bytes, about, that are remembered before the memo starts anew; of which one for each chunk; and the longest such chunk.
MEMO_BYTES, ENTRY_BYTES, LONGEST = 110 << 20, 160, 1000
BATCH_BYTES = 1 << 20
#: Chunks that the libraries encode at once.
LEARNT = 2048


def _merges(found: list[tuple[str, float]]) -> list[tuple[str, str]]:
    """Splits of each piece into two others, by the piece's score and then its parts' places."""
    place = {p: i for i, (p, _) in enumerate(found)}
    out = []
    for piece, score in found:
        for at in range(1, len(piece)):
            left, right = piece[:at], piece[at:]
            if left in place and right in place:
                out.append((-score, place[piece], place[left], place[right], left, right))
    return [(left, right) for *_, left, right in sorted(out)]


def build(model: sentencepiece_model_pb2.ModelProto) -> Tokenizer:
    """A tokenizers.Tokenizer equal to the SentencePiece model; adds no begin or end."""
    kind = sentencepiece_model_pb2.ModelProto.SentencePiece
    spec, rules = model.trainer_spec, model.normalizer_spec
    unk = next(i for i, p in enumerate(model.pieces) if p.type == kind.UNKNOWN)
    if spec.model_type == sentencepiece_model_pb2.TrainerSpec.UNIGRAM:
        core = models.Unigram([(p.piece, p.score) for p in model.pieces], unk, spec.byte_fallback)
    elif spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE:
        usable = [(p.piece, p.score) for p in model.pieces if p.type in (kind.NORMAL, kind.USER_DEFINED)]
        core = models.BPE(
            {p.piece: i for i, p in enumerate(model.pieces)},
            _merges(usable),
            unk_token=model.pieces[unk].piece,
            fuse_unk=True,
            byte_fallback=spec.byte_fallback,
        )
    else:
        raise ValueError("only unigram and BPE models can be rebuilt")
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(rules.precompiled_charsmap)] if rules.precompiled_charsmap else []
    if rules.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if rules.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    if rules.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    out.normalizer = normalizers.Sequence(steps)
    strip = [decoders.Strip(" ", 1, 0)] if rules.add_dummy_prefix else []
    out.decoder = decoders.Sequence(
        [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip]
    )
    return out


class Codec:
    """Encodes and decodes texts; mismatches counts chunks whose ids the sentencepiece library doesn't give."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        self.tokenizer = build(model)
        self.native = sentencepiece.SentencePieceProcessor(model_file=path)
        rules = model.normalizer_spec
        inner = [p.piece.lstrip(MARK) for p in model.pieces if p.type == p.NORMAL]
        self.cut = (
            not rules.precompiled_charsmap
            and not rules.remove_extra_whitespaces
            and rules.add_dummy_prefix
            and rules.escape_whitespaces
            and not any(MARK in p or "\n" in p for p in inner)
        )
        self.dtype = np.dtype("<u2" if len(model.pieces) <= 1 << 16 else "<u4")
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        #: Ids by chunk, and the chunks that the libraries disagree on.
        self._memo: dict[str, bytes] = {}
        self._size = 0
        self._wrong: set[str] = set()
        self._plain = build(model)
        self._plain.normalizer = normalizers.Sequence([])
        self._shown = [self._bytes(p) for p in model.pieces]
        self._prefix = rules.add_dummy_prefix
        self._lead = len(self.native.encode("\n"))  # the prefix and the line end

    def _native_chunks(self, chunks: list[str]) -> list[list[int]]:
        """The sentencepiece library puts the mark before each text: take it off, or hide the start behind a line end."""
        bare = [c[0] == MARK and c.strip(MARK) != "" for c in chunks]
        texts = [(c[1:] if b else "\n" + c).replace(MARK, " ") for c, b in zip(chunks, bare, strict=True)]
        found = self.native.encode(texts, num_threads=1)
        return [f if b else f[self._lead :] for b, f in zip(bare, found, strict=True)]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of chunks that are not remembered yet."""
        code, found = self._code, {}
        for at in range(0, len(new), LEARNT):  # what the libraries give for a chunk takes far more than its ids
            part = new[at : at + LEARNT]
            ids = [e.ids for e in self._plain.encode_batch_fast(part, add_special_tokens=False)]
            native = self._native_chunks(part)
            if ids != native:
                self._wrong.update(c for c, a, b in zip(part, ids, native, strict=True) if a != b)
            found.update(zip(part, [array(code, i).tobytes() for i in ids], strict=True))
        return found

    def _trim(self, new: dict[str, bytes]) -> None:
        """Keep what is remembered within bounds, after new has been added to it."""
        for chunk, ids in new.items():
            if len(chunk) > LONGEST:
                del self._memo[chunk]
            else:
                self._size += ENTRY_BYTES + len(chunk) + len(ids)
        if self._size > MEMO_BYTES:
            self._memo.clear()
            self._wrong.clear()
            self._size = 0

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[int]]:
        """Ids of each text, and how many of its chunks the libraries disagree on."""
        if not self.cut:
            ids = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            wrong = [int(a != b) for a, b in zip(ids, self.native.encode(texts, num_threads=1), strict=True)]
            return [np.array(i, self.dtype) for i in ids], wrong
        normal, memo = self.tokenizer.normalizer.normalize_str, self._memo
        split = [_CHUNKS.findall(normal(t)) for t in texts]
        new = self._learn(list({c for chunks in split for c in chunks if c not in memo}))
        memo.update(new)
        found = [b"".join(map(memo.__getitem__, chunks)) for chunks in split]
        wrong = [sum(c in self._wrong for c in chunks) if self._wrong else 0 for chunks in split]
        self._trim(new)
        return [np.frombuffer(f, self.dtype) for f in found], wrong

    def _bytes(self, piece) -> bytes:
        """What the decoder makes of one piece: a byte, or its characters with blanks for marks."""
        return bytes([int(piece.piece[1:-1], 16)]) if piece.type == piece.BYTE else piece.piece.replace(MARK, " ").encode()

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts, as the tokenizer's decoder gives them for ids of whole texts."""
        found = [b"".join(map(self._shown.__getitem__, i.tolist())) for i in ids]
        lead = b" " if self._prefix else b""
        return [f.removeprefix(lead).decode(errors="replace") for f in found]


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


CACHES.append(codec.cache_clear)


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns of docs, then n_pieces, ids_crc32, round_trip, n_mismatched and piece_ids.

    piece_ids are little-endian integers of 16 bits (32 for larger vocabularies),
    ids_crc32 that of the same as unsigned 32-bit integers. round_trip tells
    whether decoding gives the text again; a text that itself has the mark reads
    back with blanks, and where the model normalises, round_trip may be false.
    Null and empty texts have no ids and come back as empty; texts of any length
    are encoded whole; repeated rows and null ids stay; an empty table gives an
    empty result. Columns of docs named like the new ones are replaced.
    """
    new = "n_pieces bigint, ids_crc32 bigint, round_trip boolean, n_mismatched bigint, piece_ids binary"
    names = [c.split()[0] for c in new.split(", ")]
    held = [c for c in docs.columns if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already, and each thread keeps memory of its own
        known = codec(path)
        for b in batches:
            whole = b.column(text).fill_null("")
            _, offsets = text_buffers(whole)
            for a, z in pieces(offsets, BATCH_BYTES):
                texts = whole.slice(a, z - a).to_pylist()
                ids, wrong = known.encode(texts)
                back = known.decode(ids)
                made = [
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()),
                    pa.array([x == y for x, y in zip(texts, back, strict=True)]),
                    pa.array(wrong, pa.int64()),
                    pa.array([i.tobytes() for i in ids], pa.binary()),
                ]
                part = b.slice(a, z - a)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in held), *made], names=[*held, *names])
        trim()

    kept = docs.select(*(F.col(f"`{c}`") for c in held))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{kinds}, {new}")
