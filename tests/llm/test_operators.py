"""The operators against brute force, round trips and held-out rows, with the hard cases: nulls, empty and long
texts, repeated rows, empty tables, and further columns whose names clash with the operators' own."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import sqlcheck
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bandweave.llm import decontaminate, langid, pii, sentencepieces, simhash, suffix_dedup, token_counts, token_files, topk, toxicity
from bandweave.llm import queries as llm
from bandweave.llm.common import components, table

WORD_BPE, PIECES = public_tokenizers.path(llm.WORD_BPE), public_tokenizers.path(llm.PIECE_BPE)
HARD = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "Mail a.b@c-d.org, b@c, ip 10.0.0.1 and 300.1.1.1, card 4111 1111 1111 1111, phone +49 (30) 123456 7"),
    (5, "the same words stand here once more " * 40),
    (5, "the same words stand here once more " * 40),
    (6, "x" * 200_000),
    (7, "naïve 北京 🙂 <|endoftext|> [UNK] \u0000   ▁x"),
    (None, "no id but text 1.2.3.4"),
    (8, "+1-22 1.2.3.4.5.6.7.8 a@b.c.@d.e 4111-1111-1111-1111-4111 00010.1.1.1 " * 3),
]


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(i, t, "h", 1, "g") for i, t in HARD]
    return spark.createDataFrame(rows, "doc_id long, text string, prefix string, n_tokens int, score string")


@pytest.fixture(scope="module")
def docs(spark, data):
    return table(spark, data, "documents")


@pytest.fixture(scope="module")
def con(data):
    return sqlcheck.connection(data)


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


# SimHash


def slow_fingerprint(text, n):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows, radius):
    """Smallest id reachable by each (id, fingerprint)."""
    fps = {}
    for i, fp in rows:
        fps.setdefault(fp, []).append(i)
    root = {fp: fp for fp in fps}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    keys = list(fps)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    low = {}
    for fp, ids in fps.items():
        known = [i for i in ids if i is not None]
        low[find(fp)] = min([*known, *([low[find(fp)]] if low.get(find(fp)) is not None else [])], default=None)
    return {(i, f"{fp:016x}", low[find(fp)]) for i, fp in rows}


def test_simhash_matches_brute_force(docs):
    rows = [(i, slow_fingerprint(t, 4)) for i, t in texts_of(docs)]
    got = {tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()}
    assert got == slow_components(rows, 4)


def test_simhash_hard_cases(hard):
    rows = [(i, slow_fingerprint(t or "", 4)) for i, t in HARD]
    got = [tuple(r) for r in simhash.near_duplicates(hard).select("doc_id", "fingerprint", "component_id").collect()]
    assert len(got) == len(HARD)
    assert set(got) == slow_components(rows, 4)
    assert simhash.near_duplicates(hard.where("false")).count() == 0


def test_links_have_the_components_of_all_pairs(spark):
    """Planted fingerprints: chains of four flips and a crowd at one prefix."""
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 2**64, 40, dtype=np.uint64).tolist()
    fps = list(seeds)
    for s in seeds:
        for _ in range(6):
            for b in rng.choice(64, rng.integers(1, 7), replace=False):
                s ^= 1 << int(b)
            fps.append(s)
    fps += [int(seeds[0]) & ~0xFFFFFF | int(x) for x in rng.integers(0, 1 << 24, 300)]
    rows = [(i, fp) for i, fp in enumerate(dict.fromkeys(fps))]
    signed = np.array([fp for _, fp in rows], np.uint64).view(np.int64).tolist()
    found = simhash.links(spark.createDataFrame([(i, fp) for i, fp in enumerate(signed)], "doc_id long, fp long"), 4)
    pairs = found.collect()
    number = {s: i for i, s in enumerate(signed)}
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for r in pairs:
        a, b = find(number[r.a]), find(number[r.b])
        root[max(a, b)] = min(a, b)
    assert {(i, f"{fp:016x}", find(i)) for i, fp in rows} == slow_components(rows, 4)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 3)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {(i, 0) for i in range(1, 61)} | {(i, 100) for i in range(101, 160)}


# Language


def test_language_of_held_out_documents(docs):
    found = langid.predict(docs.withColumn("truth", F.col("lang")), langid.learn(langid.training_rows(docs)), ("doc_id", "truth"))
    rows = found.where(toxicity.remainder("doc_id", 5) == 0).where("truth IS NOT NULL AND lang_pred <> 'und'").collect()
    assert len(rows) > 20
    assert sum(r.truth == r.lang_pred for r in rows) >= 0.9 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_hard_cases(docs, hard):
    known = langid.learn(langid.training_rows(docs))
    found = langid.predict(hard, known)
    rows = {r.doc_id: r.lang_pred for r in found.collect()}
    assert found.count() == len(HARD)
    assert rows[1] == rows[2] == rows[3] == "und" != rows[5]
    assert langid.predict(hard.where("false"), known).count() == 0
    assert {r.lang_pred for r in langid.predict(hard, ()).collect()} == {"und"}


# Token files and counts


LIBRARY = Tokenizer.from_file(WORD_BPE)


def wanted_ids(text):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_token_files_round_trip(hard, tmp_path):
    folder = f"{tmp_path}/files"
    token_files.write_token_files(hard, folder, WORD_BPE)
    rows = sorted(token_files.read_token_files(hard.sparkSession, folder).collect(), key=lambda r: r.start)
    order = sorted(HARD, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in rows] == [i for i, _ in order]
    start = 0
    for r, (_, text) in zip(rows, order, strict=True):
        assert bytes(r.ids) == wanted_ids(text).tobytes()
        assert (r.start, r.n_tokens) == (start, len(wanted_ids(text)))
        start += r.n_tokens
    some = token_files.read_token_files(hard.sparkSession, folder, doc_ids=[7]).collect()
    assert [r.doc_id for r in some] == [7]


def test_token_files_of_nothing(hard, tmp_path):
    token_files.write_token_files(hard.where("false"), f"{tmp_path}/none", WORD_BPE)
    assert token_files.read_token_files(hard.sparkSession, f"{tmp_path}/none").count() == 0


def test_token_file_query(spark, data, docs):
    texts, start = dict(texts_of(docs)), 0
    for r in sorted(llm.op4_token_files(spark, data).collect(), key=lambda r: r.start):
        ids = wanted_ids(texts[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("which", ["docs", "hard"])
def test_token_counts_match_the_library(which, request):
    df = request.getfixturevalue(which)
    got = sorted(map(str, (tuple(r) for r in token_counts.token_counts(df, WORD_BPE).collect())))
    counts = [(i, len(t.encode()), len(wanted_ids(t)) - 1) for i, t in texts_of(df)]
    assert got == sorted(str((i, b, n, n > 2048)) for i, b, n in counts)


# Personal data

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def slow_spans(text):
    def good(kind, m):
        digits = re.sub(r"[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
            return 13 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    return {k: [m.span() for m in e.finditer(text) if good(k, m[0])] for k, e in BASE.items()}


@pytest.mark.parametrize("which", ["docs", "hard"])
def test_base_spans_match_the_expressions(which, request):
    df = request.getfixturevalue(which)
    wanted = []
    for i, t in texts_of(df):
        spans = slow_spans(t)
        listed = ",".join(f"{k}:{a}:{z}" for k in BASE for a, z in spans[k])
        wanted.append((i, *(len(spans[k]) for k in BASE), hashlib.sha256(listed.encode()).hexdigest()))
    got = [tuple(r)[:6] for r in pii.pii_spans(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, wanted))


def test_random_texts_have_the_base_spans():
    rng = np.random.default_rng(3)
    for _ in range(3000):
        text = "".join(rng.choice(list("aZ01239.@+-_% ()\n"), rng.integers(0, 60)))
        found = pii.find_spans(text)
        assert {k: found[k] for k in BASE} == slow_spans(text), text


def test_redaction_leaves_no_base_span(spark, hard):
    rows = hard.select("doc_id", pii.redact_column(F.col("text")).alias("t")).collect()
    assert not any(slow_spans(r.t or "")["email"] for r in rows)
    assert [r.t for r in rows if r.doc_id == 1] == [None]


# Repeated bytes


def test_repeats_match_sql(spark, data, con):
    sqlcheck.assert_same(llm.op6_suffix_dedup(spark, data), llm.ORACLE_SQL["op6_suffix_dedup"], con)


def slow_removed(rows):
    first = {}
    for i, t in rows:
        for s in {t[a : a + 50] for a in range(len(t) - 49)}:
            first[s] = min(i, first.get(s, i))
    out = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - 49):
            if first[t[a : a + 50]] < i:
                gone[a : a + 50] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats_match_brute_force_on_periodic_and_tiny_texts(spark):
    rng = np.random.default_rng(5)
    base = "".join(rng.choice(list("ab é"), 400))
    rows = [(0, None), (1, ""), (2, "a" * 500), (3, "a" * 49), (4, "b" + "a" * 60), (5, base), (6, base[100:151] + "x" + base[100:149])]
    rows += [(10 + k, base[a : a + int(n)] + "-" * int(k) + base[: int(n)]) for k, (a, n) in enumerate(rng.integers(0, 200, (30, 2)))]
    rows += [(50, "ab" * 300), (51, "ba" * 300)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_bytes int")
    got = sorted(tuple(r) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == slow_removed([(i, (t or "").encode()) for i, t in rows])


# SentencePiece


@pytest.mark.parametrize("which", ["docs", "hard"])
def test_pieces_match_the_model(which, request):
    df = request.getfixturevalue(which).drop("n_tokens")
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in sentencepieces.encode_documents(df.select("doc_id", "text"), PIECES).collect():
        ids = np.frombuffer(r.piece_ids, "<u2").tolist()
        assert ids == model.encode(r.text or ""), r.doc_id
        assert (r.n_pieces, r.n_mismatched) == (len(ids), 0)


# Toxicity


def auc(scores, labels):
    """Share of pairs in the right order; equal scores count half, so the order of rows doesn't matter."""
    high, low = scores[labels > 0][:, None], scores[labels == 0][None, :]
    return (high > low).mean() + (high == low).mean() / 2


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = llm.op9_toxicity(spark, folder).where("held_out").join(table(spark, folder, "labels").dropna(), "doc_id").collect()
    labels = np.array([r.toxic for r in rows])
    assert auc(np.array([r.score for r in rows]), labels) >= 0.8
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_toxicity_without_labels_and_of_hard_cases(hard):
    model = toxicity.fit(hard.withColumn("toxic", F.lit(None).cast("int")))
    assert toxicity.score_documents(hard.drop("score"), model).count() == len(HARD)
    assert toxicity.score_documents(hard.where("false").drop("score"), model).count() == 0


# Top k


def test_top_k_matches_sql(spark, data, con):
    sqlcheck.assert_same(llm.op10_exact_top_k(spark, data), llm.ORACLE_SQL["op10_exact_top_k"], con)


def test_top_k_with_ties_nulls_and_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [-1.0, 9.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0, k=2).orderBy("query_id", "rank").collect()]
    one = 1024 * 1024
    assert got == [(0, 1, 1, one), (0, 2, 100, one), (100, 1, 0, one), (100, 2, 1, one)]
    assert topk.top_k(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


# Decontamination


def test_decontamination_finds_copies_and_paraphrases_only(spark, docs, data):
    items = table(spark, data, "benchmark")
    some = items.orderBy("item_id").limit(8).collect()
    clean = "plain filler about nothing that any test would ask for " * 30
    planted = []
    for n, r in enumerate(some):
        words = r.text.split()
        changed = ["other" if k % 9 == 4 else w for k, w in enumerate(words)]
        planted += [(10_000 + n, f"{clean}{r.text} {clean}"), (20_000 + n, f"{clean}{' '.join(changed)} {clean}")]
    planted += [(30_000, clean), (30_001, None), (30_002, "")]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(both, items).collect()}
    for n, r in enumerate(some):
        assert (10_000 + n, r.item_id) in found
        assert (20_000 + n, r.item_id) in found
    assert not {i for i, _ in found if i >= 30_000}


def test_word_bound_never_drops_a_subsequence():
    rng = np.random.default_rng(9)
    for _ in range(300):
        text, words = rng.integers(0, 12, 120).astype(np.uint64), rng.integers(0, 12, rng.integers(1, 30)).astype(np.uint64)
        item = decontaminate.Item(0, words.tolist(), [])
        vocabulary = np.unique(words)
        codes = np.searchsorted(vocabulary, text)
        codes[vocabulary[np.minimum(codes, len(vocabulary) - 1)] != text] = len(vocabulary)
        low = rng.integers(0, 100, 20)
        high = np.minimum(120, low + rng.integers(1, 40, 20))
        kept = set(decontaminate._Places(codes, len(vocabulary)).may_hold(item, np.searchsorted(vocabulary, words), low, high).tolist())
        for i, (a, z) in enumerate(zip(low, high, strict=True)):
            if decontaminate.common_subsequence(item.words, text[a:z].tolist()) >= decontaminate.PARAPHRASED * len(words):
                assert i in kept


def test_decontamination_of_empty_tables(spark, docs, data):
    items = table(spark, data, "benchmark")
    assert decontaminate.contaminated(docs.where("false"), items).count() == 0
    assert decontaminate.contaminated(docs, items.where("false")).count() == 0


def test_each_text_of_a_repeated_item_is_sought(spark):
    """Items 1 and 2 share a text, item 1 has another; each document holds one of the texts, a third neither."""
    rng = np.random.default_rng(9)
    a, b, c = (" ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(40)) for _ in range(3))
    items = spark.createDataFrame([(1, a, 0), (1, b, 0), (2, b, 0), (2, b, 0), (None, c, 0), (3, None, 0)], "item_id long, text string, doc_id int")
    texts = spark.createDataFrame([(1001, f"before {a} after"), (1002, f"x {b} y"), (1003, c), (1004, "nothing here")], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(texts, items).collect())
    assert got == [(1001, 1), (1002, 1), (1002, 2)]


@pytest.mark.parametrize("text, lang", [("½", False), ("²³", False), ("Ⅷ", False), ("1234 _-", False), ("ª", True), ("ё", True), ("北", True), ("4 x", True)])
def test_only_letters_have_a_language(docs, text, lang):
    assert langid.has_letter(text) is lang
    learned = langid.learn(docs.limit(50))
    df = docs.sparkSession.createDataFrame([(1, text)], "doc_id long, text string")
    assert (langid.predict(df, learned).first().lang_pred != "und") is lang
