"""Teams of more people than can be enumerated as subsets, against all small teams."""

from __future__ import annotations

import random
from itertools import combinations

from bandweave.operators import teams


def test_smallest_team_of_many_people_matches_brute_force(spark):
    rng = random.Random(2)
    for _ in range(3):
        holds = {p: {t: rng.choice((2, 3)) for t in rng.sample(range(8), rng.randint(1, 4))} for p in range(25)}
        every = set().union(*holds.values())
        for n in range(1, 9):
            found = [c for c in combinations(holds, n) if set().union(*(holds[p] for p in c)) == every]
            if found:
                break
        high = {c: len({t for p in c for t, b in holds[p].items() if b == 3}) for c in found}
        best = min(found, key=lambda c: (-high[c], [str(p) for p in c]))
        rows = [(p, t, b) for p, ts in holds.items() for t, b in ts.items()]
        row = teams.smallest_team(spark.createDataFrame(rows, "person long, capability int, band_code int")).first()
        assert (row.team, row.n_people, row.n_covered, row.n_high) == ([str(p) for p in best], n, len(every), high[best])
