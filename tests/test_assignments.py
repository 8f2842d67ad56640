"""Assignments, runner-up and uniqueness against enumeration of all assignments; smallest teams against all subsets."""

from __future__ import annotations

import random
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from bandweave.operators import teams


def frames(spark, holds, parts, targets):
    rows = [(p, c, b) for p, cs in holds.items() for c, b in cs.items()]
    return (
        spark.createDataFrame(rows, "person string, capability string, band_code int"),
        spark.createDataFrame([(c,) for c in targets], "capability string"),
        spark.createDataFrame([(c, k) for c, ks in parts.items() for k in ks], "capability string, component string"),
    )


def every(holds, parts, targets):
    """Objectives, teams and takers of all assignments, best first."""
    ways = [[None, *(p for p in sorted(holds) if c in holds[p])] for c in targets]
    n = {c: sum(c in h for h in holds.values()) for c in targets}
    order = sorted((c for c in targets if n[c]), key=lambda c: (n[c], c))
    out = []
    for choice in product(*ways):
        who = dict(zip(targets, choice, strict=True))
        team = sorted({p for p in choice if p})
        pairs = {(p, k) for c, p in who.items() if p for k in parts.get(c, ())}
        high = sum(holds[p][c] == 3 for c, p in who.items() if p)
        out.append(((choice.count(None), len(team), len(pairs), -high), team, [(c, who[c]) for c in order if who[c]]))
    return sorted(out, key=lambda r: (r[0], r[1], [(order.index(c), p) for c, p in r[2]]))


def case(seed):
    rng = random.Random(seed)
    targets = [f"c{k}" for k in range(rng.randint(1, 5))]
    holds = {p: {c: rng.choice((2, 3)) for c in targets if rng.random() < rng.choice((0.2, 0.5))} for p in "abcdef"[: rng.randint(1, 5)]}
    return {p: h for p, h in holds.items() if h}, {c: rng.sample("xyz", rng.randint(0, 2)) for c in targets}, targets


FIXED = [
    ({"a": {"c0": 2}}, {"c0": ["x"]}, ["c0"]),  # the runner-up abandons the only target
    ({"a": {"c0": 2, "c1": 2}, "b": {"c1": 3}}, {"c0": ["x"], "c1": ["y"]}, ["c0", "c1", "c2"]),  # the runner-up has one more person
    ({"a": {"c0": 2}, "b": {"c1": 2}}, {}, ["c0", "c1"]),
    ({"a": {"c0": 2, "c1": 2}, "b": {"c0": 2, "c1": 2}}, {"c0": ["x"], "c1": ["x"]}, ["c0", "c1"]),  # not unique
    # greedy takes three where two are enough
    ({"a": {"1": 2, "2": 2, "3": 2, "4": 2}, "b": {"1": 2, "2": 2, "5": 2}, "c": {"3": 2, "4": 2, "6": 2}}, {str(k): ["x", str(k)] for k in range(1, 7)}, [str(k) for k in range(1, 7)]),
]


@pytest.mark.parametrize("given", [*FIXED, *(case(s) for s in (4,))], ids=lambda g: f"{len(g[0])}-{len(g[2])}")
def test_assignments_match_enumeration(spark, given):
    holds, parts, targets = given
    qualified, wanted, components = frames(spark, holds, parts, targets)
    found = teams.assignments(qualified, wanted, components)
    got = [
        ((r.abandoned, r.people, r.switching, -r.high_assignments), r.team, [tuple(t) for t in r.takers]) for r in found.orderBy("place").collect()
    ]
    slow = every(holds, parts, targets)
    assert got[0] == slow[0]
    assert [g[0] for g in got] == [s[0] for s in slow[: 2 if holds else 1]]
    row = teams.uniqueness(found).first()
    assert row.is_unique == (len(slow) < 2 or slow[1][0] > slow[0][0])
    taken = {r.capability: r.person for r in teams.assigned(found, wanted).collect()}
    assert taken == {c: dict(slow[0][2]).get(c) for c in targets}


def test_greedy_needs_more_people_than_the_best(spark):
    qualified, wanted, components = frames(spark, *FIXED[-1])
    assert teams.greedy_team(qualified) == ["a", "b", "c"]
    assert teams.assignments(qualified, wanted, components).first().team == ["b", "c"]


@pytest.mark.parametrize("seed", range(1))
def test_first_smallest_team_is_that_of_all_subsets(spark, seed):
    rng = random.Random(seed)
    holds = {p: {c: 2 for c in range(5) if rng.random() < 0.4} for p in "abcdefg"}
    holds = {p: h for p, h in holds.items() if h}
    group = {p: rng.randint(0, 2) for p in holds}
    rows = [(p, c, b) for p, h in holds.items() for c, b in h.items()]
    people = sorted(holds)
    subsets = sorted((sum(1 << people.index(p) for p in c), c) for n in range(1, len(people) + 1) for c in combinations(people, n))
    best = min(subsets, key=lambda s: (-len(set().union(*(holds[p] for p in s[1]))), len(s[1]), len({group[p] for p in s[1]}), s[0]))
    df = spark.createDataFrame(rows, "person string, capability int, band_code int")
    found = teams.first_smallest_team(df, spark.createDataFrame(list(group.items()), "person string, group_id int"))
    assert [r.person for r in found.orderBy("place").collect()] == sorted(best[1], reverse=True)


def test_nobody_qualifies(spark):
    qualified, wanted, components = frames(spark, {"a": {"c": 2}}, {}, ["c", "d"])
    none = teams.assignments(qualified.where("false"), wanted, components)
    assert [tuple(r[c] for c in teams.OBJECTIVE) for r in none.collect()] == [(2, 0, 0, 0)]
    assert teams.uniqueness(none).first().is_unique
    assert teams.assigned(none, wanted).where(F.col("person").isNull()).count() == 2
    assert teams.first_smallest_team(qualified.where("false"), qualified.select("person", F.lit(1).alias("group_id"))).count() == 0
