"""Plans of teams: exact assignments, runner-up, uniqueness, greedy baseline, coverage plan."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import coverage_plan, teams
from ..storage import stored
from .bindings import EDGES, edges
from .registry import plan, read

LEADERS = """
    un AS (SELECT l_suppkey AS person, p_brand AS capability, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
    ld AS (
        SELECT person, capability, CASE WHEN r <= greatest(1, people // 60) THEN 3 WHEN r <= greatest(3, people // 20) THEN 2 ELSE 1 END AS band_code
        FROM (SELECT *, row_number() OVER (PARTITION BY capability ORDER BY n DESC, person) AS r FROM un) CROSS JOIN (SELECT count(*) AS people FROM supplier)
    ),
    lv AS (SELECT person FROM ld WHERE band_code >= 2 GROUP BY person ORDER BY count(*) DESC, person LIMIT 1),
    tg AS (SELECT capability FROM ld WHERE band_code >= 2 AND person = (SELECT person FROM lv)),
    q AS (SELECT person, capability, band_code FROM ld WHERE band_code >= 2 AND person <> (SELECT person FROM lv) AND capability IN (SELECT capability FROM tg)),
    co AS (
        SELECT capability, component FROM (
            SELECT p_brand AS capability, p_type AS component, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY 1, 2)
        WHERE r <= 2
    )
"""
#: All assignments, a target after the other, abandoning one being a choice; the better the smaller `o`, then team and takers.
WALK = f"""
    {LEADERS},
    pl AS (SELECT capability, row_number() OVER (ORDER BY count(*), capability) AS place FROM q GROUP BY capability),
    kc AS (SELECT capability, list(component ORDER BY component) AS parts FROM co GROUP BY capability),
    way AS (
        SELECT place, pl.capability, q.person, (q.band_code = 3)::INT AS high, coalesce(parts, []) AS parts FROM pl JOIN q USING (capability) LEFT JOIN kc USING (capability)
        UNION ALL SELECT place, capability, NULL, 0, [] FROM pl
    ),
    wk(place, team, pairs, high, lost, takers) AS (
        SELECT 0::BIGINT, []::BIGINT[], []::VARCHAR[], 0, 0, []::BIGINT[]
        UNION ALL
        SELECT way.place, CASE WHEN person IS NULL THEN team ELSE list_sort(list_distinct(list_append(team, person))) END,
               list_distinct(list_concat(pairs, list_transform(parts, lambda c: person || '/' || c))), wk.high + way.high,
               lost + (person IS NULL)::INT, list_append(takers, person)
        FROM wk JOIN way ON way.place = wk.place + 1
    ),
    al AS (
        SELECT *, (SELECT count(*) FROM tg) - (SELECT count(*) FROM pl) + lost AS abandoned, len(team) AS people, len(pairs) AS switching,
               row_number() OVER (ORDER BY lost, len(team), len(pairs), -high, team, takers) AS r
        FROM wk WHERE place = (SELECT count(*) FROM pl)
    ),
    best AS (SELECT * FROM al WHERE r = 1),
    tk AS (SELECT tg.capability, takers[pl.place] AS person FROM tg CROSS JOIN best LEFT JOIN pl USING (capability))
"""
GREEDY = """
    hold AS (SELECT person, list(DISTINCT capability) AS held FROM {0} GROUP BY person),
    gr(pick, person, gained, open) AS (
        SELECT 0, NULL::BIGINT, 0::BIGINT, (SELECT coalesce(list(DISTINCT capability), []) FROM {0})
        UNION ALL
        SELECT pick + 1, person, n, open FROM (
            SELECT g.pick, h.person, len(list_intersect(h.held, g.open)) AS n, list_filter(g.open, lambda x: NOT list_contains(h.held, x)) AS open,
                   row_number() OVER (ORDER BY len(list_intersect(h.held, g.open)) DESC, h.person) AS r
            FROM gr g CROSS JOIN hold h WHERE len(g.open) > 0)
        WHERE r = 1
    )
"""


def _leaders(spark, d):
    """Suppliers by brand, by orders: the first of each brand HIGH, those after them MODERATE, more of both where there are more people."""
    w = Window.partitionBy("capability").orderBy(F.desc("n"), "person")
    counted = edges(spark, d).groupBy("person", "capability").agg(F.countDistinct("unit").alias("n"))
    people = read(spark, d, "supplier").agg(F.count("*").alias("people"))
    ranked = counted.withColumn("r", F.row_number().over(w)).crossJoin(F.broadcast(people))  # one row
    few = lambda least, share: F.greatest(F.lit(least), F.floor(F.col("people") / share))
    band = F.when(F.col("r") <= few(1, 60), 3).when(F.col("r") <= few(3, 20), 2).otherwise(1)
    return ranked.select("person", "capability", band.alias("band_code"))


def _components(spark, d):
    """The two commonest types of a brand."""
    w = Window.partitionBy("capability").orderBy(F.desc("n"), "component")
    n = read(spark, d, "part").groupBy(F.col("p_brand").alias("capability"), F.col("p_type").alias("component")).agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(w)).where("r <= 2").select("capability", "component")


def _departure(spark, d):
    """Who covers most, their targets, and who else qualifies for these."""
    found = stored(_leaders(spark, d), "leaders")
    leaving = found.where("band_code >= 2").groupBy("person").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "person").first()
    person = leaving.person if leaving else None
    targets = found.where((F.col("person") == F.lit(person)) & (F.col("band_code") >= 2)).select("capability")
    qualified = found.where((F.col("person") != F.lit(person)) & (F.col("band_code") >= 2)).join(targets, "capability", "left_semi")
    return found, person, targets, qualified


def _assignments(spark, d):
    _, _, targets, qualified = _departure(spark, d)
    return targets, teams.assignments(qualified, targets, _components(spark, d))


@plan("opt01_assignment", f"""
    WITH RECURSIVE {WALK} SELECT capability, tk.person, abandoned::INT AS abandoned, people, switching, high AS high_assignments FROM tk CROSS JOIN best
""")
def opt01_assignment(spark, d):
    targets, found = _assignments(spark, d)
    return teams.assigned(found, targets)


@plan("opt02_runner_up", f"WITH RECURSIVE {WALK} SELECT r AS place, abandoned::INT AS abandoned, people, switching, high AS high_assignments FROM al WHERE r <= 2")
def opt02(spark, d):
    return _assignments(spark, d)[1].select("place", *teams.OBJECTIVE)


@plan("opt03_uniqueness", f"""
    WITH RECURSIVE {WALK}, o AS (SELECT r, [abandoned, people, switching, -high]::BIGINT[] AS o FROM al WHERE r <= 2)
    SELECT array_to_string(a.o, ',') AS found, array_to_string(b.o, ',') AS runner_up, coalesce(b.o > a.o, true) AS is_unique
    FROM (SELECT o FROM o WHERE r = 1) a LEFT JOIN (SELECT o FROM o WHERE r = 2) b ON true
""")
def opt03(spark, d):
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c)
    return teams.uniqueness(_assignments(spark, d)[1]).select(text("found"), text("runner_up"), "is_unique")


@plan("opt08_first_smallest_team", f"""
    WITH RECURSIVE {LEADERS}, ix AS (SELECT capability, 1::BIGINT << (row_number() OVER (ORDER BY capability) - 1) AS bit FROM q GROUP BY capability),
    ms AS (SELECT person, bit_or(bit) AS m, row_number() OVER (ORDER BY person) AS i FROM q JOIN ix USING (capability) GROUP BY person),
    tm(team, last, m) AS (
        SELECT []::BIGINT[], 0::BIGINT, 0::BIGINT
        UNION ALL SELECT list_append(team, person), i, tm.m | ms.m FROM tm JOIN ms ON i > last WHERE tm.m | ms.m <> tm.m
    ),
    gp AS (SELECT team, bit_count(any_value(tm.m)) AS covered, len(team) AS size, count(DISTINCT s_nationkey) AS groups, sum(1::HUGEINT << (i - 1)) AS rank
           FROM tm, unnest(team) t(p) JOIN supplier ON s_suppkey = p JOIN ms ON ms.person = p GROUP BY team),
    one AS (SELECT team FROM gp ORDER BY covered DESC, size, groups, rank LIMIT 1),
    mb AS (SELECT unnest(list_reverse(list_sort(team))) AS person, unnest(range(len(team))) AS place FROM one)
    SELECT place, person, string_agg(capability || ' ' || band_code, ', ' ORDER BY capability) AS contributions FROM mb JOIN q USING (person) GROUP BY 1, 2
""")
def opt08(spark, d):
    """Nations as the teams that people belong to."""
    _, _, _, qualified = _departure(spark, d)
    groups = read(spark, d, "supplier").select(F.col("s_suppkey").alias("person"), F.col("s_nationkey").alias("group_id"))
    shown = F.array_join(F.transform("contributions", lambda c: F.concat_ws(" ", c["capability"], c["band_code"])), ", ")
    return teams.first_smallest_team(qualified, groups).select("place", "person", shown.alias("contributions"))


@plan("opt01_smallest_team", f"""
    WITH RECURSIVE {EDGES}, qd AS (SELECT * FROM bd WHERE band_code >= 2),
    ix AS (SELECT capability, 1::BIGINT << (row_number() OVER (ORDER BY capability) - 1) AS bit FROM qd GROUP BY capability),
    al AS (SELECT bit_or(bit) AS every FROM ix),
    ms AS (SELECT person, bit_or(bit) AS m, coalesce(bit_or(bit) FILTER (WHERE band_code = 3), 0) AS h FROM qd JOIN ix USING (capability) GROUP BY person),
    tm(team, last, m, h) AS (
        SELECT []::BIGINT[], -1::BIGINT, 0::BIGINT, 0::BIGINT
        UNION ALL SELECT list_append(team, person), person, tm.m | ms.m, tm.h | ms.h FROM tm CROSS JOIN al JOIN ms ON person > last
        WHERE tm.m <> every AND tm.m | ms.m <> tm.m AND len(team) < 3
    )
    SELECT array_to_string(team, ',') AS team, len(team)::INT AS n_people, bit_count(m)::BIGINT AS n_covered, bit_count(h)::BIGINT AS n_high
    FROM tm CROSS JOIN al WHERE m = every ORDER BY n_people, n_high DESC, list_transform(team, lambda p: p::VARCHAR) LIMIT 1
""")
def opt01(spark, d):
    found = teams.smallest_team(_bands(spark, d).where("band_code >= 2"))
    return found.select(F.array_join("team", ",").alias("team"), "n_people", "n_covered", "n_high")


@plan("opt04_greedy_team", f"""
    WITH RECURSIVE {EDGES}, qd AS (SELECT person, capability FROM bd WHERE band_code >= 2), {GREEDY.format('qd')} SELECT pick - 1 AS pick, person FROM gr WHERE pick > 0
""")
def opt04(spark, d):
    return teams.greedy_picks(_bands(spark, d).where("band_code >= 2")).select("pick", "person")


@plan("opt04_greedy_leaders", f"""
    WITH RECURSIVE {LEADERS}, ql AS (SELECT person, capability FROM ld WHERE band_code >= 2), {GREEDY.format('ql')}
    SELECT pick - 1 AS pick, person, gained FROM gr WHERE pick > 0
""")
def opt04_leaders(spark, d):
    return teams.greedy_picks(_leaders(spark, d).where("band_code >= 2"))


@plan("qry08_coverage_plan", f"""
    WITH RECURSIVE {WALK}, {GREEDY.format('q')},
    nm AS (SELECT ['NONE', 'LOW', 'MODERATE', 'HIGH'] AS names),
    cl AS (SELECT capability, arg_max(person, (band_code, -person)) AS person, max(band_code) AS band_code FROM ld
           WHERE person <> (SELECT person FROM lv) AND band_code > 0 GROUP BY capability),
    ob AS (SELECT CASE r WHEN 1 THEN 'best' ELSE 'runner-up' END AS which, unnest(['abandoned', 'people', 'switching', 'high_assignments']) AS name,
                  unnest([abandoned, people, switching, high]) AS n FROM al WHERE r <= 2)
    SELECT 'target' AS section, capability AS subject, NULL AS detail, NULL::BIGINT AS value FROM tg
    UNION ALL SELECT 'member', tk.person::VARCHAR, string_agg(DISTINCT tk.capability || ' at ' || names[q.band_code + 1], '; ' ORDER BY tk.capability || ' at ' || names[q.band_code + 1]), count(DISTINCT component)
        FROM tk JOIN q USING (person, capability) LEFT JOIN co USING (capability) CROSS JOIN nm WHERE tk.person IS NOT NULL GROUP BY tk.person
    UNION ALL SELECT 'residual', tk.capability, coalesce('Nobody covers ' || tk.capability || '; closest is ' || cl.person || ' at ' || names[band_code + 1],
        'Nobody holds any evidence for ' || tk.capability), NULL FROM tk LEFT JOIN cl USING (capability) CROSS JOIN nm WHERE tk.person IS NULL
    UNION ALL SELECT 'greedy', (pick - 1)::VARCHAR, person::VARCHAR, gained FROM gr WHERE pick > 0
    UNION ALL SELECT 'objective', which, name, n FROM ob
    UNION ALL SELECT 'unique', 'best', NULL, coalesce(((SELECT (lost, people, switching, -high) FROM al WHERE r = 2) > (SELECT (lost, people, switching, -high) FROM al WHERE r = 1))::INT, 1)
""")
def qry08(spark, d):
    found, person, _, _ = _departure(spark, d)
    return coverage_plan.coverage_plan(found, _components(spark, d), person)


def _bands(spark, d):
    from .ordinal import _bands

    return _bands(spark, d)
