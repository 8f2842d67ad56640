"""Teams that cover targets, and who of them takes which target.

A target is a capability that a departure leaves open, so targets are a
dimension; people may be many. Everything is a join or a grouping:

1. What is still open is a set. Each level lets someone who qualifies for the set's
   first target (the one of the fewest people) take all they can; the level at
   which nothing is open is the size of the smallest team. Different sets, not
   teams, are followed.
2. Going back over the levels leaves the sets that end in nothing; only along those
   are teams put together, so no team is made that can't be completed.
3. Targets are dealt to the members of every smallest team, one target a level. Of
   the states of one team that touch the same components the best two are kept;
   a state whose least possible number of components is above what two others
   can surely reach is dropped. The bound is one number a level.

The objective is (abandoned targets, people, pairs of person and component, assignments
in the highest band), the last maximised; ties go to the smaller team, then the smaller
takers of the targets in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import forget, stored

#: Assignments that a search keeps: the best and the runner-up.
KEPT = 2
#: Levels of dealing between two bounds, at which the states are written.
LEVELS = 4
OBJECTIVE = ("abandoned", "people", "switching", "high_assignments")


def qualifications(bands: DataFrame, threshold: int) -> DataFrame:
    """(person, capability, qualified, band_code) of the full grid given."""
    return bands.withColumn("qualified", F.col("band_code") >= threshold)


class _Matrix:
    """Who qualifies for what, written once; targets numbered from the one of the fewest people on."""

    def __init__(self, qualified: DataFrame):
        pairs = qualified.groupBy("person", "capability").agg(F.max((F.col("band_code") == 3).cast("int")).alias("high"))
        first = stored(pairs, "team-pairs")
        rare = first.groupBy("capability").agg(F.count("*").alias("n"))
        order = rare.agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "capability"))), lambda t: t["capability"]).alias("targets"))
        self.targets = stored(order.select(F.posexplode("targets").alias("place", "capability")), "team-targets")
        self.pairs = stored(first.join(self.targets, "capability").select("person", "place", "capability", "high"), "team-places")
        forget(first)
        self.holds = self.pairs.groupBy("person").agg(F.sort_array(F.collect_list("place")).alias("held"))
        self.n = self.pairs.select("place").distinct().count()

    def close(self) -> None:
        forget(self.pairs, self.targets)

    def starts(self, dropped: int = 0) -> DataFrame:
        """(start, open): all targets; with one dropped, a set for each that is left out."""
        spark, every = self.pairs.sparkSession, list(range(self.n))
        rows = [(k, [p for p in every if p != k]) for k in every] if dropped else [(-1, every)]
        return spark.createDataFrame(rows, "start int, open array<int>")

    def taken(self, states: DataFrame) -> DataFrame:
        """states with each person who qualifies for the first open target, and what that person leaves open."""
        wanted = states.withColumn("place", F.get("open", F.lit(0)))
        by = wanted.join(self.pairs.select("place", "person"), "place").join(self.holds, "person")
        return by.withColumn("next", F.array_except("open", "held")).drop("place", "held")


def _levels(matrix: _Matrix, starts: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """The sets (start, open) of each level that end with nothing open after the fewest people, and the tables to forget."""
    front, made, steps = stored(starts, "team-open"), [], []
    made.append(front)
    while front.where(F.size("open") == 0).isEmpty():
        if front.isEmpty():
            return [], made
        step = stored(matrix.taken(front).select("start", "open", "next").distinct(), "team-steps")
        front = stored(step.select("start", F.col("next").alias("open")).distinct(), "team-open")
        steps.append(step)
        made += [step, front]
    live = [front.where(F.size("open") == 0)]
    for step in reversed(steps):
        ends = live[0].select("start", F.col("open").alias("next"))
        live.insert(0, stored(step.join(ends, ["start", "next"], "left_semi").select("start", "open").distinct(), "team-live"))
        made.append(live[0])
    return live, made


def _teams(matrix: _Matrix, starts: DataFrame) -> DataFrame:
    """(start, team): every smallest team that covers a start's targets, of the starts that take the fewest people."""
    live, made = _levels(matrix, starts)
    kind = matrix.pairs.schema["person"].dataType.simpleString()
    if not live:
        teams = starts.where("false").select("start", F.array().cast(f"array<{kind}>").alias("team"))
    else:
        teams = live[0].select("start", "open", F.array().cast(f"array<{kind}>").alias("team"))
        for ends in live[1:]:
            step = matrix.taken(teams).withColumn("team", F.array_sort(F.array_append("team", F.col("person"))))
            step = step.select("start", F.col("next").alias("open"), "team").distinct()
            teams = step.join(ends, ["start", "open"], "left_semi")
        teams = teams.select("start", "team")
    teams = stored(teams, "teams")
    forget(*made)
    return teams


def _options(matrix: _Matrix, teams: DataFrame, components: DataFrame, starts: DataFrame) -> DataFrame:
    """teams with options: for each target of the start, in order, who of the team qualifies and what components it has."""
    touched = components.join(matrix.targets, "capability").groupBy("place").agg(F.array_sort(F.collect_set("component")).alias("parts"))
    members = teams.select("start", "team", F.explode("team").alias("person")).join(matrix.pairs, "person")
    members = members.join(starts.select("start", F.explode("open").alias("place")), ["start", "place"])
    by = members.groupBy("start", "team", "place").agg(F.array_sort(F.collect_list(F.struct("person", "high"))).alias("people"))
    kind = components.schema["component"].dataType.simpleString()
    parts = F.coalesce("parts", F.array().cast(f"array<{kind}>"))
    one = F.struct("place", "people", parts.alias("parts"))
    found = by.join(touched, "place", "left").groupBy("start", "team").agg(F.array_sort(F.collect_list(one)).alias("options"))
    return teams.join(found, ["start", "team"], "left").withColumn("options", F.coalesce("options", F.array().cast(found.schema["options"].dataType)))


def _with(person: Column, parts: Column) -> Column:
    """The pairs of a person with components."""
    return F.transform(parts, lambda c: F.struct(person.alias("person"), c.alias("component")))


def _reached(rest: Column, pairs: Column) -> Column:
    """Pairs after each remaining target goes to whom it costs the fewest new ones: what this state can surely reach."""

    def take(done: Column, option: Column) -> Column:
        cost = lambda x: F.struct(F.size(F.array_except(_with(x["person"], option["parts"]), done)).alias("n"), x["person"].alias("person"))
        return F.array_union(done, _with(F.array_min(F.transform(option["people"], cost))["person"], option["parts"]))

    return F.size(F.aggregate(rest, pairs, take))


def _least(rest: Column, pairs: Column) -> Column:
    """Pairs that no completion goes below: those there are, and one for each component that is still to be touched first."""
    ahead = F.array_distinct(F.flatten(F.transform(rest, lambda o: o["parts"])))
    return F.size(pairs) + F.size(F.array_except(ahead, F.transform(pairs, lambda p: p["component"])))


def _dealt(states: DataFrame, places: int, size: int | None = None) -> DataFrame:
    """The best KEPT assignments (start, team, path, switching, high), of the states (start, team, options).

    With a size the team grows by whoever takes a target and must have that size in the end.
    """
    kind = states.schema["team"].dataType.elementType.simpleString()
    part = states.schema["options"].dataType.elementType["parts"].dataType.elementType.simpleString()
    now = states.withColumns({
        "pairs": F.array().cast(f"array<struct<person: {kind}, component: {part}>>"), "high": F.lit(0),
        "path": F.array().cast(f"array<struct<place: int, person: {kind}>>"),
    })
    now = held = stored(now, "team-states")
    w = Window.partitionBy("start", "team", "pairs").orderBy(F.desc("high"), "path")
    for at in range(places):
        option, rest = F.get("options", F.lit(at)), F.slice("options", at + 2, 1 << 20)
        taker = F.col("taker.person")
        new = now.withColumn("_parts", option["parts"]).withColumn("_place", option["place"]).withColumn("taker", F.explode(option["people"]))
        new = new.withColumns({
            "pairs": F.array_sort(F.array_union("pairs", _with(taker, F.col("_parts")))), "high": F.col("high") + F.col("taker.high"),
            "path": F.array_append("path", F.struct(F.col("_place").alias("place"), taker.alias("person"))),
        })
        if size is not None:
            new = new.withColumn("team", F.array_sort(F.array_distinct(F.array_append("team", taker))))
            new = new.where(F.size("team") <= size).where(F.size("team") + (places - at - 1) >= size)
        new = new.drop("_parts", "_place", "taker").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= KEPT).drop("_n")
        if at % LEVELS < LEVELS - 1 and at < places - 1:
            now = new
            continue
        if size is None:
            new = new.withColumn("_most", _reached(rest, F.col("pairs"))).withColumn("_least", _least(rest, F.col("pairs")))
        new = stored(new, "team-states")
        forget(held)
        now = held = new
        if size is None:
            sure = [r[0] for r in new.select("_most").orderBy("_most").limit(KEPT).collect()]  # two numbers
            now = (new.where(F.col("_least") <= sure[-1]) if len(sure) == KEPT else new).drop("_most", "_least")
    done = now.where(F.size("team") == size) if size is not None else now
    best = done.select("start", "team", "path", F.size("pairs").alias("switching"), "high")
    best = stored(best.orderBy("switching", F.desc("high"), "team", "path").limit(KEPT), "team-best")
    forget(held)
    return best


def assignments(qualified: DataFrame, targets: DataFrame, components: DataFrame) -> DataFrame:
    """(place, abandoned, people, switching, high_assignments, team, takers): the best assignment (place 1) and the runner-up.

    qualified has person, capability, band_code, a row for each pair that qualifies;
    targets has capability; components has capability and component. takers are
    structs of capability and person. An assignment differs from another if any
    target goes to someone else or is abandoned. There is no runner-up where
    nobody qualifies for anything.
    """
    wanted = targets.select("capability").distinct()
    matrix = _Matrix(qualified.join(wanted, "capability", "left_semi"))
    total = wanted.count()
    parts = components.select("capability", "component").distinct()
    starts = matrix.starts()
    teams = _teams(matrix, starts)
    best = _dealt(_options(matrix, teams, parts, starts), matrix.n)
    forget(teams)
    found = [_named(matrix, best, total - matrix.n)]
    missing = KEPT - best.count()
    if missing and matrix.n:
        extra = _larger(matrix, parts, starts, best)
        lost = total - matrix.n
        if extra is None:
            less = matrix.starts(dropped=1)
            teams = _teams(matrix, less)
            extra, lost = _dealt(_options(matrix, teams, parts, less), matrix.n - 1), lost + 1
            forget(teams)
        found.append(_named(matrix, extra, lost).limit(missing))
    w = Window.orderBy("abandoned", "people", "switching", F.desc("high_assignments"), "team", "takers")  # of two rows
    out = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    out = stored(out.withColumn("place", F.row_number().over(w)), "team-assignments")
    matrix.close()
    return out


def _larger(matrix: _Matrix, parts: DataFrame, starts: DataFrame, best: DataFrame) -> DataFrame | None:
    """The best assignments of all targets to more people than are needed, of as few more as there are any."""
    people = matrix.pairs.select("person").distinct().count()
    least = best.select(F.size("team")).first()[0]
    every = starts.join(matrix.pairs.groupBy().agg(F.array_sort(F.collect_set("person")).alias("team")))  # one row; only where the best is the only one of its size
    kind = matrix.pairs.schema["person"].dataType.simpleString()
    grown = _options(matrix, every, parts, starts).withColumn("team", F.array().cast(f"array<{kind}>"))
    for size in range(least + 1, min(matrix.n, people) + 1):
        found = _dealt(grown, matrix.n, size)
        if not found.isEmpty():
            return found
        forget(found)
    return None


def _named(matrix: _Matrix, best: DataFrame, abandoned: int) -> DataFrame:
    """best with the objective, and capabilities instead of places."""
    long = best.select("start", "team", "switching", "high", "path", F.explode_outer("path").alias("_p"))
    long = long.join(F.broadcast(matrix.targets), F.col("_p.place") == F.col("place"), "left")  # KEPT rows, and the targets
    taker = F.when(F.col("place").isNotNull(), F.struct(F.col("place").alias("at"), "capability", F.col("_p.person").alias("person")))
    rows = long.groupBy("start", "team", "switching", "high", "path").agg(F.array_sort(F.collect_list(taker)).alias("_t"))
    takers = F.transform("_t", lambda t: F.struct(t["capability"].alias("capability"), t["person"].alias("person")))
    return rows.select(
        F.lit(abandoned).alias("abandoned"), F.size("team").alias("people"), "switching", F.col("high").alias("high_assignments"), "team",
        takers.alias("takers"),
    )


def assigned(found: DataFrame, targets: DataFrame) -> DataFrame:
    """(capability, person, people, switching, high_assignments) of the best of assignments(); person is null where a target is abandoned."""
    best = found.where("place = 1")
    taken = best.select(F.explode("takers").alias("t")).select("t.capability", "t.person")
    rows = targets.select("capability").distinct().join(taken, "capability", "left")
    return rows.crossJoin(F.broadcast(best.select(*OBJECTIVE)))  # one row


def uniqueness(found: DataFrame) -> DataFrame:
    """One row (found, runner_up, is_unique): the objectives as arrays whose smaller one is better; without a runner-up it is unique."""
    tuple_ = F.array("abandoned", "people", "switching", -F.col("high_assignments"))
    one = found.agg(F.max(F.when(F.col("place") == 1, tuple_)).alias("found"), F.max(F.when(F.col("place") == 2, tuple_)).alias("runner_up"))
    return one.withColumn("is_unique", F.coalesce(F.col("runner_up") > F.col("found"), F.lit(True)))


def smallest_team(qualified: DataFrame) -> DataFrame:
    """One row (team, n_people, n_covered, n_high): most covered, then fewest people, then most targets held by someone in the highest band, then by name."""
    matrix = _Matrix(qualified)
    teams = _teams(matrix, matrix.starts())
    held = teams.select("team", F.explode("team").alias("person")).join(matrix.pairs, "person").groupBy("team").agg(
        F.countDistinct("place").alias("n_covered"), F.countDistinct(F.when(F.col("high") == 1, F.col("place"))).alias("n_high"))
    names = F.transform("team", lambda p: p.cast("string")).alias("team")
    out = held.select(names, F.size("team").alias("n_people"), "n_covered", "n_high").orderBy(F.desc("n_high"), "team").limit(1)
    out = stored(out, "smallest-team")
    forget(teams)
    matrix.close()
    return out


def first_smallest_team(qualified: DataFrame, groups: DataFrame) -> DataFrame:
    """(person, place, contributions): the team of most targets, fewest people and fewest groups that comes first in the order of subsets.

    groups has person and group_id. People are numbered by name and a subset by the
    bits of its members, so of equal teams the one whose last member comes first
    is taken, and place counts from the last member. contributions are all the
    member's capabilities and bands.
    """
    matrix = _Matrix(qualified)
    teams = _teams(matrix, matrix.starts())
    every = teams.select("team", F.explode("team").alias("person")).join(groups.select("person", "group_id"), "person", "left")
    spread = every.groupBy("team").agg(F.countDistinct(F.coalesce(F.col("group_id").cast("string"), F.lit(""))).alias("n_groups"))
    first = spread.orderBy("n_groups", F.reverse(F.array_sort("team"))).limit(1)
    members = first.select(F.posexplode(F.reverse(F.array_sort("team"))).alias("place", "person"), "n_groups")
    given = qualified.groupBy("person", "capability").agg(F.max("band_code").alias("band_code"))
    has = given.groupBy("person").agg(F.array_sort(F.collect_list(F.struct("capability", "band_code"))).alias("contributions"))
    out = stored(members.join(has, "person"), "first-team")
    forget(teams)
    matrix.close()
    return out


def greedy_picks(qualified: DataFrame) -> DataFrame:
    """(pick, person, gained): in each round whoever covers most of what is open, ties by name. The pairs are written once."""
    pairs = stored(qualified.select("person", "capability").distinct(), "greedy-pairs")
    spark, left, picks = pairs.sparkSession, pairs, []
    while True:
        best = left.groupBy("person").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "person").first()
        if best is None:
            break
        picks.append((len(picks), best.person, best.n))
        done = pairs.where(F.col("person") == F.lit(best.person)).select("capability")
        rest = stored(left.join(done, "capability", "left_anti"), "greedy-open")
        forget(left) if left is not pairs else None
        left = rest
    forget(pairs)
    forget(left) if left is not pairs else None
    return spark.createDataFrame(picks, f"pick int, person {pairs.schema['person'].dataType.simpleString()}, gained bigint")


def greedy_team(qualified: DataFrame) -> list:
    """People in the order picked."""
    return [r.person for r in greedy_picks(qualified).orderBy("pick").collect()]


def closest_candidates(bands: DataFrame, open_targets: DataFrame) -> DataFrame:
    """(capability, person, band_code): the strongest band of each uncovered target, ties by name; none at the lowest band."""
    w = Window.partitionBy("capability").orderBy(F.desc("band_code"), "person")
    rows = bands.join(open_targets.select("capability"), "capability", "left_semi").where("band_code > 0")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("capability", "person", "band_code")
