"""Word-level memo of a tokenizers-library model, for texts that the library splits at white space.

The library normalises a whole text and splits it before it merges; that part
costs most. Texts of common characters are split here by the tokenizer's own
pattern, and each distinct piece goes through the library's model once. All
other texts are cut at blanks and line ends and each distinct chunk goes through
the whole library. Both give the library's ids, which the tests compare.
"""

from __future__ import annotations

import functools
import json
import re
from array import array

import numpy as np
from tokenizers import Tokenizer

from .transducer import SPLIT, STEPS, byte_characters

#: Bytes, about, that the chunks, and the pieces, may take before their memo starts anew; of which one for each key; and
#: the longest key that is remembered.
MEMO_BYTES, ENTRY_BYTES, LONGEST = 80 << 20, 150, 1000

#: Characters that lower-case one to one, that NFC leaves alone and whose classes all Unicode versions share.
_COMMON = re.compile("[\\t\\n\\r\\x20-\\x7eÀ-ÖØ-öø-ÿ]*")
#: The pattern by which word_bpe_49k.json splits, for the characters above after lower-casing.
_SPLIT = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+"
)


class _Memo(dict):
    def __init__(self, compute):
        super().__init__()
        self._compute, self._size = compute, 0

    def __missing__(self, key):
        value = self._compute(key)
        if len(key) <= LONGEST:
            self._size += ENTRY_BYTES + len(key) + len(value)
            if self._size > MEMO_BYTES:
                self.clear()
                self._size = 0
            self[key] = value
        return value


class Lexicon:
    """ids(text) as Tokenizer.encode(text, add_special_tokens=False).ids gives them."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        patterns = [p["pattern"]["Regex"] for p in splits if p["type"] == "Split"]
        #: Only a tokenizer of just these steps may be memoised; others are encoded whole.
        self.words = steps == STEPS and patterns == [SPLIT]
        self._marks = tuple(t["content"] for t in spec.get("added_tokens", []))
        self._model = self.tokenizer.model
        chars = byte_characters()
        self._mapped = {c: "".join(chars[b] for b in chr(c).encode()) for c in range(256)}
        self._pieces = _Memo(self._piece)
        self._chunks = _Memo(self._chunk)

    def _bytes(self, ids) -> bytes:
        return array(self._code, ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.translate(self._mapped)
        return self._bytes([t.id for t in self._model.tokenize(shown)])

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            return self._pieces[chunk.lower()]
        if _COMMON.fullmatch(chunk) and not any(m in chunk for m in self._marks):
            return b"".join(map(self._pieces.__getitem__, _SPLIT.findall(chunk.lower())))
        return self._bytes(self.tokenizer.encode(chunk, add_special_tokens=False).ids)

    def serialised(self, text: str) -> bytes:
        """Little-endian ids of dtype."""
        if not self.words:
            return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self._chunks.__getitem__, text.replace("\n", " ").split(" ")))

    def ids(self, text: str) -> list[int]:
        return np.frombuffer(self.serialised(text), self.dtype).tolist()


@functools.lru_cache(maxsize=4)
def lexicon(path: str) -> Lexicon:
    """One for each worker process and file, so that the memo outlives a batch."""
    return Lexicon(path)
