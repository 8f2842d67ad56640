"""A byte-pair tokenizer compiled to a deterministic transducer that emits token counts.

The states are those of a text's prefix. Every transition is annotated with the
number by which one more byte changes the number of tokens so far, so the sum
along a text's path is its token count.

Inside a word the state follows from the merges alone. The encoding of a prefix
ends with the one token t that is a suffix of it and that the merges keep apart
from the last token of what stands before t; a sequence of tokens is an encoding
if each two neighbours, merged as one string, give themselves again. Only places
from which a token can still reach beyond the prefix matter for what follows: the
longest suffix that begins some token, with the last token and the token count,
relative to the present, at each of its places. Prefixes that agree in these are
one state. Around words the states follow the splitting expression.

The states that can be reached number millions for a vocabulary of 50,000, so
they are made when a byte first leads to them. The table of transitions is hashed
and bounded; when it is full it starts anew.
"""

from __future__ import annotations

import functools
import json
import marshal
import re

import numpy as np
from tokenizers import Tokenizer

#: The normaliser steps and the splitting expression that the states around words follow.
STEPS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters that NFC leaves alone, that lower-case one to one and whose classes all Unicode versions share.
COMMON = "\\t\\n\\r\\x20-\\x7eÀ-ÖØ-öø-ÿ"
_BLANK = b" \n\t\r"
_CONTRACTED = (b"'s", b"'t", b"'re", b"'ve", b"'m", b"'ll", b"'d")
#: Bytes that begin a word of any bytes up to the next blank, and a special token.
RAW, SPECIAL = 1, 2
#: Transitions that the table takes, in SLOTS slots; pairs of tokens and rewritten chunks (by characters) that are remembered.
TRANSITIONS, SLOTS = 700_000, 1 << 21
PAIRS, REWRITTEN = 300_000, 8 << 20
DEAD, START = 0, 1


class Full(Exception):
    """The table has no room for another transition."""


def byte_characters() -> list[str]:
    """The printable character that byte-level models use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Merges:
    """Tokens and merges of a byte-level model whose words end with a mark; tokens are numbers."""

    def __init__(self, model: dict):
        self.end = model["end_of_word_suffix"]
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        self.symbols: dict[int, list[int]] = {}
        self._pairs: dict[int, bool] = {}
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): (n, vocab[a + b]) for n, (a, b) in enumerate(pairs)}
        for token, number in vocab.items():
            shown = token[: -len(self.end)] if token.endswith(self.end) and token != self.end else token
            if not shown or any(c not in byte_of for c in shown):
                continue
            last = shown[-1] + token[len(shown) :]
            symbols = [vocab[c] for c in shown[:-1]] + [vocab[last]]
            if self.merged(symbols) == [number]:  # others are never made
                raw = bytes(byte_of[c] for c in shown)
                (self.inner if token == shown else self.final)[raw] = number
                self.symbols[number] = symbols
        begun = {t[:n] for t in self.inner for n in range(1, len(t))}
        self.begun = begun | {t[:n] for t in self.final for n in range(1, len(t) + 1)}

    def merged(self, symbols: list[int]) -> list[int]:
        """Merge the pair of the lowest rank, leftmost first, until none is left."""
        symbols, rank = list(symbols), self.rank
        while len(symbols) > 1:
            found = [(*r, i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := rank.get(p))]
            if not found:
                break
            _, new, i = min(found)
            symbols[i : i + 2] = [new]
        return symbols

    def apart(self, a: int | None, b: int) -> bool:
        """Whether b may follow a in an encoding; None is the start of the word."""
        if a is None:
            return True
        key = a << 24 | b
        if (known := self._pairs.get(key)) is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self.merged(self.symbols[a] + self.symbols[b]) == [a, b]
        return known


#: A place in a word: the bytes before it that begin some token; and of the places in them from which a token may
#: still reach on, and of the present one: how many bytes back, the last token there (None at the start), the count there.
Word = tuple[bytes, tuple[tuple[int, int | None, int], ...]]
EMPTY: Word = (b"", ((0, None, 0),))


def step(merges: Merges, word: Word, byte: int) -> tuple[Word, int]:
    """The place one byte on, and by how much the token count changes."""
    suffix, places = word
    suffix += bytes((byte,))
    for back, last, count in places:
        token = merges.inner.get(suffix[len(suffix) - back - 1 :])
        if token is not None and merges.apart(last, token):
            break
    change = count + 1
    held = [(back + 1, last, n - change) for back, last, n in places if suffix[len(suffix) - back - 1 :] in merges.begun]
    reach = held[0][0] if held else 0
    return (suffix[len(suffix) - reach :], (*held, (0, token, 0))), change


def finish(merges: Merges, word: Word) -> int:
    """By how much the token count changes when the word ends here."""
    suffix, places = word
    for back, last, count in places:
        token = merges.final.get(suffix[len(suffix) - back :]) if back else None
        if token is not None and merges.apart(last, token):
            return count + 1
    return 0


def _home(keys: np.ndarray) -> np.ndarray:
    """The slot at which a transition is first looked for."""
    return (keys * 0x9E3779B97F4A7C1 >> 24) & (SLOTS - 1)


class Transducer:
    """State 0 is dead up to the next blank, state 1 the start."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        patterns = [p["pattern"]["Regex"] for p in splits if p["type"] == "Split"]
        model = spec["model"]
        plain = not model.get("dropout") and not model.get("ignore_merges") and model.get("end_of_word_suffix")
        #: Whether the states here are those of the tokenizer.
        self.compiled = bool(plain) and steps == STEPS and patterns == [SPLIT]
        if not self.compiled:
            return
        self.merges = Merges(model)
        marks = [t["content"] for t in spec.get("added_tokens", [])]
        self._marks = re.compile("|".join(map(re.escape, marks)) or "(?!)")
        self._rare = re.compile(f"[^{COMMON}]" + "".join("|" + re.escape(m) for m in marks))
        self._byte_of = {c: b for b, c in enumerate(byte_characters())}
        self._rewritten: dict[str, str] = {}
        self._rewritten_size = 0
        self.clear()

    def clear(self) -> None:
        self._number: dict[bytes, int] = {}
        self._states: list[bytes] = []
        self.transitions = 0
        self._keys = np.full(SLOTS, -1, np.int64)
        self._next = np.zeros(SLOTS, np.int32)
        self._emits = np.zeros(SLOTS, np.int8)
        self.number(("dead", None))
        self.number(("start", None))

    def number(self, state: tuple) -> int:
        packed = marshal.dumps(state, 2)
        if (found := self._number.get(packed)) is None:
            found = self._number[packed] = len(self._states)
            self._states.append(packed)
        return found

    def state(self, number: int) -> tuple:
        return marshal.loads(self._states[number])

    def _slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of transitions (state * 256 + byte), and the places of those without one, whose slots are free."""
        slot = _home(keys)
        held = self._keys.take(slot)
        missing = []
        on = np.flatnonzero(held != keys)
        while len(on):
            free = self._keys.take(slot[on]) < 0
            missing.append(on[free])
            on = on[~free]
            slot[on] = (slot[on] + 1) & (SLOTS - 1)
            on = on[self._keys.take(slot[on]) != keys[on]]
        return slot, np.concatenate(missing) if missing else np.zeros(0, np.int64)

    def follow(self, states: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states and the changes of the token count; transitions that are new are made."""
        keys = states << 8 | data
        slot, missing = self._slots(keys)
        if len(missing):
            for key in np.unique(keys[missing]).tolist():
                self._learn(key)
            slot, _ = self._slots(keys)
        return self._next.take(slot).astype(np.int64), self._emits.take(slot)

    def _learn(self, key: int) -> None:
        if self.transitions >= TRANSITIONS:
            raise Full
        self.transitions += 1
        after, emitted = self._after(self.state(key >> 8), key & 255)
        slot = int(_home(np.array([key]))[0])
        while self._keys[slot] >= 0:
            slot = (slot + 1) & (SLOTS - 1)
        self._keys[slot], self._next[slot], self._emits[slot] = key, self.number(after), emitted

    def _after(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """The next state and the change of the token count."""
        mode, at = state
        blank, merges = byte in _BLANK, self.merges
        if mode == "dead":
            return (("start", None) if blank else state), 0
        if mode == "raw":
            if blank:
                return ("start", None), finish(merges, at)
            word, change = step(merges, at, byte)
            return ("raw", word), change
        if mode == "special":
            return (("start", None), 1) if blank else (state, 0)
        letter = byte >= 128 or 97 <= byte <= 122
        digit = 48 <= byte <= 57
        if mode == "mark":  # behind an apostrophe at the start of a word, or also a letter
            text = at + bytes((byte,))
            if text in _CONTRACTED:
                return ("start", None), finish(merges, self._spelled(text)[0]) + self._spelled(text)[1]
            if any(c.startswith(text) for c in _CONTRACTED):
                return ("mark", text), 0
            if len(at) == 1 and not (letter or digit or blank):
                word, change = self._spelled(text)
                return ("other", word), change
            one, count = self._spelled(b"'")
            count += finish(merges, one)
            before: tuple = ("start", None)
            for b in at[1:]:
                before, change = self._after(before, b)
                count += change
            after, change = self._after(before, byte)
            return after, count + change
        if mode == "letters" and letter or mode == "other" and not (letter or digit or blank):
            word, change = step(merges, at, byte)
            return (mode, word), change
        ended = finish(merges, at) if mode != "start" else 0
        if blank:
            return ("start", None), ended
        if digit:
            word, change = self._spelled(bytes((byte,)))
            return ("start", None), ended + change + finish(merges, word)
        if byte == RAW:
            return ("raw", EMPTY), ended
        if byte == SPECIAL:
            return ("special", None), ended
        if byte == 39:
            return ("mark", b"'"), ended
        word, change = step(merges, EMPTY, byte)
        return ("letters" if letter else "other", word), ended + change

    def _spelled(self, text: bytes) -> tuple[Word, int]:
        word, count = EMPTY, 0
        for b in text:
            word, change = step(self.merges, word, b)
            count += change
        return word, count

    def readable(self, text: str) -> bytes:
        """The text in bytes whose classes the states know: lower case, chunks with other characters split by the library."""
        if self._rare.search(text):
            text = " ".join(self._chunk(c) if self._rare.search(c) else c for c in text.replace("\n", " ").split(" "))
        return text.encode(errors="surrogatepass")

    def _chunk(self, chunk: str) -> str:
        """Each word as RAW and its bytes as characters of Latin-1's range, each special token as SPECIAL."""
        if (known := self._rewritten.get(chunk)) is None:
            out, at = [], 0
            for m in [*self._marks.finditer(chunk), None]:
                part = chunk[at : m.start() if m else None]
                if part:
                    shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                    raw = (bytes(map(self._byte_of.__getitem__, w)) for w, _ in shown if w)
                    out += [chr(RAW) + r.decode(errors="surrogateescape") for r in raw]
                if m:
                    out.append(chr(SPECIAL))
                    at = m.end()
            known = " ".join(out)
            if self._rewritten_size > REWRITTEN:
                self._rewritten.clear()
                self._rewritten_size = 0
            self._rewritten[chunk] = known
            self._rewritten_size += len(chunk) + len(known)
        return known


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One for each worker process and file: what is compiled stays for later batches."""
    return Transducer(path)
