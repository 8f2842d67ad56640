"""Pairs of similar signatures that share a token: each once, over all tasks."""

from __future__ import annotations

from itertools import combinations

from bandweave.operators import similarity


def test_pairs_of_a_common_token_are_found_once_and_over_all_tasks(spark):
    sets = [["x", f"b{k % 5}", f"c{k % 7}", f"d{k % 3}"] for k in range(60)] + [["x"], ["x", "b1"], []]
    items = spark.createDataFrame([("s", s) for s in sets], "source string, signature array<string>")
    found = similarity.similar_signatures(items, 0.6)
    kinds = {tuple(sorted(s)) for s in sets if s}
    want = {frozenset(p) for p in combinations(kinds, 2) if len({*p[0]} & {*p[1]}) >= 0.6 * len({*p[0]} | {*p[1]})}
    rows = found.collect()
    assert {frozenset((tuple(r.a), tuple(r.b))) for r in rows} == want and len(rows) == len(want)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
