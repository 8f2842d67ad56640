"""Language identification by cross-parsing entropy.

A suffix automaton of each language's sample of labelled text accepts exactly
the strings that occur in it. A text is parsed into phrases, each the longest
match from where the last one ended; log2(sample size) bits name a phrase. The
language whose phrases need the fewest bits wins.

Texts are parsed in lanes of LANE letters, all lanes and languages one step at a
time. A lane begins with a phrase of its own; afterwards the phrase that the lane
before left open is followed into it until it ends where one of the lane's own
begins, and the difference is made up, so that the count is that of one parse of
the whole text. A text with a lane in which the two never meet is parsed alone.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_long, pieces, text_buffers, with_text
from .toxicity import remainder

LANE = 384
BATCH_BYTES = 1 << 19
#: An automaton is built of about so many bytes for a language, in excerpts of labelled texts chosen by a hash of the id.
SAMPLE_BYTES, EXCERPT = 24_000, 600
_PLAIN_LETTER = re.compile("[A-Za-z]")

#: Class 0 separates words; ASCII letters are 1 to 26; other bytes follow.
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = np.arange(27, 155)
CLASSES = 155


def has_letter(text: str) -> bool:
    """Whether any character is of a letter category of Unicode; fractions, superscripts and Roman numerals aren't."""
    return _PLAIN_LETTER.search(text) is not None or any(map(str.isalpha, text))


def letters(text: str) -> np.ndarray:
    """Classes of the lower-cased text's bytes, with one separator between words."""
    return _squeeze(np.frombuffer(text.lower().encode(), np.uint8))[0]


def _squeeze(data: np.ndarray, firsts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Classes without repeated separators, and which bytes they are of; firsts are the places at which texts begin."""
    classes = _CLASS[data]
    keep = np.ones(len(classes), bool)
    keep[1:] = (classes[1:] != 0) | (classes[:-1] != 0)
    if firsts is not None:
        keep[firsts] = True
    return classes[keep], keep


def suffix_automaton(sample: np.ndarray) -> np.ndarray:
    """Transitions (state, class) -> state of the smallest automaton of all substrings; -1 is none."""
    to: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in sample.tolist():
        now = len(to)
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = now
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(to)
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    out = np.full((len(to), CLASSES), -1, np.int32)
    for state, edges in enumerate(to):
        for c, target in edges.items():
            out[state, c] = target
    return out


class Parser:
    """All languages' automata in one table of transitions over the classes that occur in any sample."""

    def __init__(self, samples: dict[str, bytes]):
        self.langs = sorted(samples)
        parts = [np.frombuffer(samples[lang], np.uint8) for lang in self.langs]
        used = np.unique(np.concatenate([*parts, [0]]))
        #: Class of each byte class in the table; the last has no transitions.
        self.place = np.full(CLASSES, len(used), np.uint8)
        self.place[used] = np.arange(len(used))
        width, tables, roots, base = len(used) + 1, [], [], 0
        for part in parts:
            table = suffix_automaton(part)
            table = np.concatenate((table[:, used], np.full((len(table), 1), -1, np.int32)), axis=1)
            tables.append(np.where(table >= 0, (table + base) * width, -1).astype(np.int32).reshape(-1))
            roots.append(base * width)
            base += len(table)
        self.next = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        self.roots = np.array(roots, np.int32)[:, None]
        self.bits = np.array([np.log2(max(2, len(p))) for p in parts])

    def parse(self, lanes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each lane (a column of classes of which the first sizes count) on its own, in each language.

        Returns where phrases begin (row, language, lane), and the state at the end of each lane and whether a phrase is open there.
        """
        shape = (len(self.langs), lanes.shape[1])
        begins = np.zeros((lanes.shape[0], *shape), bool)
        state, inner = np.broadcast_to(self.roots, shape).copy(), np.zeros(shape, bool)
        order = np.argsort(-sizes, kind="stable")
        ends = np.searchsorted(-sizes[order], -np.arange(lanes.shape[0]), side="left")
        placed = self.place[lanes[:, order]]
        for row, (step, live) in enumerate(zip(placed, ends, strict=True)):
            if not live:
                break
            step = step[:live]
            after = self.next[state[:, :live] + step]
            miss = after < 0  # the phrase so far ends before this letter
            begins[row, :, :live] = miss | ~inner[:, :live]
            after = np.where(miss, self.next[self.roots + step], after)
            alone = after < 0  # no phrase goes on from it: a phrase of its own
            inner[:, :live] = ~alone
            state[:, :live] = np.where(alone, self.roots, after)
        back = np.argsort(order, kind="stable")
        return begins[:, :, back], state[:, back], inner[:, back]

    def joined(self, lanes: np.ndarray, sizes: np.ndarray, begins: np.ndarray, entry: tuple[np.ndarray, np.ndarray], later: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many phrases more or fewer there are where a lane goes on from its entry (states, open), and the lanes that never meet their own parse.

        later: the lanes that go on from another one.
        """
        extra, apart = np.zeros(entry[0].shape, np.int64), np.zeros(len(sizes), bool)
        lang, lane = np.nonzero(np.broadcast_to(later, extra.shape))
        state, inner, roots = entry[0][lang, lane], entry[1][lang, lane], self.roots[:, 0]
        for row in range(lanes.shape[0]):
            over = sizes[lane] <= row
            if over.any():
                apart[lane[over]] = True
                lang, lane, state, inner = (x[~over] for x in (lang, lane, state, inner))
            if not len(lane):
                break
            step = self.place[lanes[row, lane]]
            after = self.next[state + step]
            miss = after < 0
            begin, own = miss | ~inner, begins[row, lang, lane]
            np.add.at(extra, (lang, lane), begin.astype(np.int64) - own)
            after = np.where(miss, self.next[roots[lang] + step], after)
            inner = after >= 0
            state = np.where(inner, after, roots[lang])
            apart_still = ~(begin & own)
            lang, lane, state, inner = (x[apart_still] for x in (lang, lane, state, inner))
        apart[lane] = True
        return extra, apart

    def alone(self, classes: np.ndarray) -> list[int]:
        """Phrases of one text in each language, letter by letter."""
        steps, out = self.place[classes].tolist(), []
        table = self.next.tolist() if len(steps) > len(self.next) else self.next
        for root in self.roots[:, 0].tolist():
            state, count = root, 0
            for step in steps:
                after = table[state + step]
                if after < 0:
                    count += state != root
                    after = table[root + step]
                    if after < 0:
                        count, after = count + 1, root
                state = after
            out.append(count + (state != root))
        return out


@functools.lru_cache(maxsize=2)
def _parser(samples: tuple[tuple[str, bytes], ...]) -> Parser:
    return Parser(dict(samples))


def learn(labelled: DataFrame, lang: str = "lang") -> tuple[tuple[str, bytes], ...]:
    """(language, classes of its sample) of labelled documents (doc_id, text, lang).

    Null languages and texts teach nothing. The sample of a language is bounded
    by SAMPLE_BYTES; all labelled rows can be drawn.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    rows = rows.select("doc_id", "text", F.col(lang).alias("lang"))
    wanted, parts = 4 * SAMPLE_BYTES // EXCERPT, 1_000_000
    shares = {r.lang: wanted / r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    if not shares:
        return ()
    share = F.create_map(*(F.lit(x) for k, v in shares.items() for x in (k, min(1.0, v))))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(parts))
    at = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.greatest(F.length("text") - EXCERPT, F.lit(1))) + 1
    drawn = rows.where(draw < share[F.col("lang")] * parts + 1).select(
        "lang", draw.alias("draw"), F.substring(F.col("text"), at.cast("int"), F.lit(EXCERPT)).alias("excerpt")
    )
    samples: dict[str, list[np.ndarray]] = {}
    for r in drawn.distinct().orderBy("lang", "draw", "excerpt").collect():  # about 4 * SAMPLE_BYTES a language
        mine = samples.setdefault(r.lang, [])
        if sum(map(len, mine)) < SAMPLE_BYTES:
            mine.append(letters(r.excerpt + " "))
    return tuple((k, np.concatenate(v).tobytes()) for k, v in sorted(samples.items()))


def predict(docs: DataFrame, samples: tuple[tuple[str, bytes], ...], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns keep, then lang_pred and score: how many fewer bits than the second language the first needs, 0 to 1.

    Null, empty and letterless texts (and all, if nothing was learned) are `und`
    with score 0. Equal languages go to the first in order of name. Repeated rows
    stay, texts of any length are parsed whole (in lanes), columns that aren't kept
    are left behind, and an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _parser(samples)
        for b in batches:
            texts = b.column("text").to_pylist()
            bits = count_phrases(known, texts) * known.bits[:, None]
            yield _decided(b, keep, known.langs, bits, texts)

    texts = with_text(docs, *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name in keep)
    return texts.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def count_phrases(known: Parser, texts: list[str]) -> np.ndarray:
    """Phrases of each text (a column) in each language, as of one parse of the whole text."""
    phrases = np.zeros((len(known.langs), len(texts)), np.int64)
    if not known.langs:
        return phrases
    low = pa.array([t.lower() for t in texts], pa.large_string())
    data, offsets = text_buffers(low)
    cuts, owners = cut_long(data, offsets)
    entry, apart = _Entry(len(known.langs)), set()
    for a, z in pieces(cuts, BATCH_BYTES):
        part, mine = cuts[a : z + 1], owners[a:z]
        new = np.concatenate(([a == 0 or owners[a - 1] != mine[0]], mine[1:] != mine[:-1])) & (np.diff(part) > 0)
        classes, kept = _squeeze(data[part[0] : part[-1]], part[:-1][new] - part[0])
        ends = np.concatenate(([0], np.cumsum(kept)))[part - part[0]]
        counts, rows, unmet = _lanes(known, classes, ends, mine, entry)
        np.add.at(phrases.T, rows, counts.T)
        apart.update(rows[unmet].tolist())
    for row in apart:
        phrases[:, row] = known.alone(letters(texts[row]))
    return phrases


class _Entry:
    """What the last lane left open: its text, states and open phrases, and whether it ended with a separator."""

    def __init__(self, langs: int):
        self.owner = -1
        self.state, self.inner = np.zeros((langs, 1), np.int32), np.zeros((langs, 1), bool)
        self.blank = False


def _lanes(known: Parser, classes: np.ndarray, ends: np.ndarray, owners: np.ndarray, entry: _Entry) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of all lanes of parts that end at ends, each lane's text, and whether it never meets its own parse."""
    begin = ends[:-1].copy()
    if len(classes) and owners[0] == entry.owner and entry.blank and begin[0] < ends[1] and classes[begin[0]] == 0:
        begin[0] += 1  # the separator is there already
    sizes = ends[1:] - begin
    each = -(-sizes // LANE)
    parts = np.repeat(np.arange(len(sizes)), each)
    rows = owners[parts]
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(each) - each, each)
    starts = begin[parts] + nth * LANE
    lens = np.minimum(LANE, ends[1:][parts] - starts)
    if not len(rows):
        return np.zeros((len(known.langs), 0), np.int64), rows, np.zeros(0, bool)
    at = np.minimum(starts[None, :] + np.arange(LANE)[:, None], len(classes) - 1)
    lanes = classes[at]
    begins, state, inner = known.parse(lanes, lens)
    before = tuple(np.concatenate((first, all_[:, :-1]), axis=1) for first, all_ in ((entry.state, state), (entry.inner, inner)))
    later = rows == np.concatenate(([entry.owner], rows[:-1]))
    extra, apart = known.joined(lanes, lens, begins, before, later)
    entry.owner, entry.state, entry.inner = int(rows[-1]), state[:, -1:], inner[:, -1:]
    entry.blank = bool(lanes[lens[-1] - 1, -1] == 0)
    return begins.sum(axis=0) + extra, rows, apart


def _decided(b: pa.RecordBatch, keep, langs: list[str], bits: np.ndarray, texts: list[str]) -> pa.RecordBatch:
    speaks = np.array([bool(langs) and has_letter(t) for t in texts], bool)
    if langs:
        best = bits.argmin(axis=0)
        ranked = np.sort(bits, axis=0)
        score = 1 - ranked[0] / np.maximum(ranked[1], 1e-9) if len(langs) > 1 else np.ones(len(texts))
    else:
        best, score = np.zeros(len(texts), int), np.zeros(len(texts))
    names = [langs[i] if s else "und" for i, s in zip(best.tolist(), speaks.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [*(b.column(k) for k in keep), pa.array(names, pa.string()), pa.array(np.where(speaks, score, 0.0))],
        names=[*keep, "lang_pred", "score"],
    )


def training_rows(docs: DataFrame) -> DataFrame:
    """Without the held-out rows (remainder 0 of 5)."""
    return docs.where(remainder("doc_id", 5) != 0)
