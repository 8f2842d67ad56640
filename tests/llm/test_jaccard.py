"""The pipeline's near-duplicates against all pairs of shingle sets."""

from __future__ import annotations

import random
import re

import corpus_pipeline
import numpy as np
import pyarrow as pa

from bandweave.llm import jaccard
from bandweave.llm.common import table

WORDS = [f"w{i}" for i in range(5000)]


def planted(bases=100, copies=3):
    """Texts of 60 to 600 words, and copies with random words replaced, of similarities from about 0.5 to 1."""
    rng, out = random.Random(3), []
    for _ in range(bases):
        words = rng.choices(WORDS, k=rng.randint(60, 600))
        out.append(" ".join(words))
        for _ in range(copies):
            changed, share = list(words), rng.uniform(0.002, 0.035)
            for at in rng.sample(range(len(words)), max(1, round(share * len(words)))):
                changed[at] = rng.choice(WORDS)
            out.append(" ".join(changed))
    rng.shuffle(out)
    return out


def brute_force(sets):
    """All pairs of similarity 0.8, and the smallest number reachable over them from each."""
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    near = [(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for a, b in near:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return near, find


def test_pairs_of_the_rules_similarity_meet(spark):
    texts = planted()
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    near, find = brute_force(sets)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.similar_groups(docs, corpus_pipeline.SHINGLE, corpus_pipeline.RADIUS, 0.8).collect()}
    met = sum(got[a] == got[b] for a, b in near)
    print(f"recall {met}/{len(near)}")
    assert len(near) > 100
    assert met >= 0.95 * len(near)
    assert all(find(d) == find(c) for d, c in got.items())  # nothing is linked that brute force doesn't link


def test_stage_keeps_the_first_of_each_group(spark, data):
    docs = table(spark, data, "documents")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    lowered = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for _, t in rows]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in lowered]
    _, find = brute_force([{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words])
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, data).collect()
    assert sorted(r.doc_id for r in kept) == [rows[i][0] for i in range(len(rows)) if find(i) == i]


def test_equal_empty_and_repeated_rows(spark):
    rows = [(1, None), (2, " \n"), (5, "A b c"), (4, "a  B c"), (4, "a  B c"), (6, "a b d"), (None, "a b c")]
    got = jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), 5, 4, 0.8)
    assert {tuple(r) for r in got.collect()} == {(1, 1), (2, 1), (5, 4), (4, 4), (6, 6)}


def crowd(texts=900, seed=5):
    """Copies of one text with a few words replaced: most pairs lie a little below similarity 0.8, many above."""
    rng = random.Random(seed)
    base, out = rng.choices(WORDS, k=260), []
    for _ in range(texts):
        changed = list(base)
        for at in rng.sample(range(len(base)), rng.randint(2, 8)):
            changed[at] = rng.choice(WORDS)
        out.append(" ".join(changed))
    return out


def test_no_pair_within_the_radius_is_lost_in_a_crowd(spark):
    texts = crowd()
    found = [jaccard.shingle_set(t, 5) for t in texts]
    fps = np.array([jaccard.minwise(f) for f in found])
    as_sets = [set(f.tolist()) for f in found]
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    candidates = links = 0
    for b in range(len(texts)):
        near = np.flatnonzero((np.bitwise_count(fps[:b] ^ fps[b]) <= corpus_pipeline.RADIUS).any(axis=1))
        candidates += len(near)
        for a in near.tolist():
            if len(as_sets[a] & as_sets[b]) >= 0.8 * len(as_sets[a] | as_sets[b]):
                links += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    print(candidates, links, sum(find(i) == i for i in range(len(texts))))
    assert candidates > 2 * links > 2000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = jaccard.similar_groups(docs, corpus_pipeline.SHINGLE, corpus_pipeline.RADIUS, 0.8).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, find(i)) for i in range(len(texts))]


def similar_blocks(texts, component):
    """What _joined hands on of texts that stand in one block."""
    sets = [jaccard.shingle_set(t, 5) for t in texts]
    fps, n = np.array([jaccard.minwise(s) for s in sets]).view(np.int64), len(texts)
    columns = {"key": range(n), "component": component, "shingles": [s.tobytes() for s in sets]}
    columns |= {f"fp{k}": fps[:, k] for k in range(jaccard.TABLES)}
    columns |= {c: np.zeros(n, np.int64) for c in ("own", "block", "own_a", "block_a", "own_b", "block_b")}
    found = jaccard._joined(corpus_pipeline.RADIUS, 0.8)(pa.table({k: pa.array(v) for k, v in columns.items()}))
    return list(zip(*(found.column(c).to_pylist() for c in "ab"), strict=True))


def test_rows_of_a_crowd_grow_with_its_texts_and_not_its_pairs():
    for n in (100, 400):
        texts = crowd(n)
        found = similar_blocks(texts, range(n))
        assert 0 < len(found) < n  # 259,290 pairs of 900 such texts left a task before
        again = similar_blocks(texts, [0] * n)
        assert again == []
