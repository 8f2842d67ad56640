"""Every plan of the catalogue against its SQL; plans without SQL against brute force."""

from __future__ import annotations

from itertools import combinations

import pytest
import sqlcheck
from pyspark.sql import functions as F

from bandweave.operators import scoring, teams
from bandweave.plans import catalogue

SQL = catalogue.oracle_sql()
QUERIES = catalogue.queries()


@pytest.fixture(scope="module")
def con(data):
    return sqlcheck.connection(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_plan_matches_sql(spark, data, con, name):
    sqlcheck.assert_same(QUERIES[name](spark, data), SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_plan_without_sql_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0


def test_entry_has_the_flagship_columns(spark, data):
    assert set(catalogue.entry(spark, data).columns) >= {"employee_id", "capability_id", "score", "band"}


HOLDS = {"a": {1, 2, 3}, "b": {3, 4}, "c": {4, 5}, "d": {1, 5}, "e": {2}}


@pytest.fixture(scope="module")
def qualified(spark):
    rows = [(p, t, 2 + (p in "ac")) for p, ts in HOLDS.items() for t in ts]
    return spark.createDataFrame(rows, "person string, capability int, band_code int")


def test_smallest_team_matches_brute_force(qualified):
    teams_of = [c for n in range(1, 6) for c in combinations(HOLDS, n)]
    covered = {c: set().union(*(HOLDS[p] for p in c)) for c in teams_of}
    high = {c: set().union(*(HOLDS[p] for p in c if p in "ac")) for c in teams_of}
    best = min(teams_of, key=lambda c: (-len(covered[c]), len(c), -len(high[c]), c))
    row = teams.smallest_team(qualified).first()
    assert (tuple(row.team), row.n_people, row.n_covered) == (best, len(best), len(covered[best]))


def test_greedy_team_picks_the_most_open_targets(qualified):
    assert teams.greedy_team(qualified) == ["a", "c"]


def test_smallest_team_of_nobody_is_empty(qualified):
    assert teams.smallest_team(qualified.where("false")).count() == 0


def test_noisy_or_keeps_bounds(spark):
    def score(*values):
        df = spark.createDataFrame([(v,) for v in values], "c double")
        return df.agg(scoring.noisy_or(F.col("c")).alias("s")).first().s

    assert score(0.5, 0.5, None) == 0.75
    assert score(1.0, 0.3) == 1.0
