"""Funnels against a walk over each client's rows, and against SQL."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest

from tessera.llm.funnels import MINUTE, Funnel, count_funnels
from tessera.llm.queries import FUNNELS, ORACLE_SQL, QUERIES

T0 = datetime(2024, 3, 31, 0, 0)
SCHEMA = "client_id long, kind string, arrived_at timestamp_ntz, started string, gap long, step int, funnel string, code string, next string"


def walked(rows, funnels, percent=90):
    """The rows of ``count_funnels``, attempt by attempt."""
    seen = sorted({(c, t, k) for c, k, t in rows if None not in (c, k, t)})
    steps = max(len(f.steps) for f in funnels)
    found = {}
    for f in funnels:
        for c, t, k in seen:
            if k != f.steps[0]:
                continue
            gaps = found.setdefault((f.name, c), [[] for _ in range(steps)])
            gaps[0].append(0)
            at = t
            for i, kind in enumerate(f.steps[1:], 1):
                later = [y for x, y, z in seen if x == c and z == kind and y > at]
                if not later or (later[0] - t) > timedelta(microseconds=f.within):
                    break
                if any(x == c and z in f.excluded and at < y <= later[0] for x, y, z in seen):
                    break
                gaps[i].append((later[0] - at) // timedelta(microseconds=1))
                at = later[0]
    deepest = {k: sum(bool(g) for g in v) for k, v in found.items()}
    place = lambda g: sorted(g)[-(-percent * len(g) // 100) - 1] if g else None
    alike = lambda k: sum(x[0] == k[0] and d == deepest[k] for x, d in deepest.items())
    return sorted((*k, *map(len, v), deepest[k], *map(place, v[1:]), alike(k)) for k, v in found.items())


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "f", "c", "n") for r in rows], SCHEMA)


@pytest.mark.parametrize("seed", range(3))
def test_random_rows(spark, seed):
    """Ties, repeated rows, edges of 30 minutes, buckets that an attempt crosses, times before 1970, one hot client."""
    rng = random.Random(seed)
    kinds, rows = ["view", "click", "purchase", "error", "signup", "other", None], []
    for base in (T0, datetime(1969, 12, 31, 23, 50)):
        for _ in range(500):
            step = rng.choice([timedelta(minutes=10), timedelta(minutes=15), timedelta(seconds=59, microseconds=999_999), timedelta(microseconds=1)])
            rows.append((rng.choice([7, 7, 7, 1, 2, 3, None]), rng.choice(kinds), rng.choice([base + step * rng.randrange(12), None] if rng.random() < 0.1 else [base + step * rng.randrange(60)])))
    rows += rng.sample(rows, 50)
    funnels = [*FUNNELS, Funnel("D", ("view",)), Funnel("E", ("view", "view"), ("view", "click"), MINUTE), Funnel("F", ("click", "purchase"), (), 10 * MINUTE)]
    got = count_funnels(table(spark, rows), funnels)
    assert got.columns == ["funnel", "client_id", "n1", "n2", "n3", "n4", "deepest", "t2", "t3", "t4", "same_depth"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(walked(rows, funnels), key=repr)


def test_edges_of_a_step(spark):
    """Exactly 30 minutes is in time; an excluded row at the next step's own time ends the attempt, one at the step before doesn't."""
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [
        (1, "view", at(0)), (1, "click", at(30)), (2, "view", at(0)), (2, "click", at(30) + timedelta(microseconds=1)), (3, "view", at(0)), (3, "click", at(5)), (3, "error", at(5)),
        (4, "error", at(0)), (4, "view", at(0)), (4, "click", at(5)),
    ]
    deepest = {r.client_id: r.deepest for r in count_funnels(table(spark, rows), FUNNELS[:1]).collect()}
    assert deepest == {1: 2, 2: 1, 3: 1, 4: 2}
    assert count_funnels(table(spark, []), FUNNELS).count() == 0
    assert count_funnels(table(spark, [(1, None, T0), (None, "view", T0), (1, "view", None), (None, None, None)]), FUNNELS).count() == 0


def test_the_sessions_zone_does_not_matter(spark):
    """An hour that summer time leaves out counts as any other."""
    rows = [(1, "view", T0 + timedelta(hours=1, minutes=59)), (1, "click", T0 + timedelta(hours=2, minutes=1)), (1, "view", T0 + timedelta(hours=3, minutes=1))]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert sorted(map(tuple, count_funnels(table(spark, rows), FUNNELS[:1]).collect())) == walked(rows, FUNNELS[:1])
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_the_query_on_the_table(spark, data):
    con = duckdb.connect()
    con.sql(f"create view clicks as select * from '{data}/clicks.parquet'")
    found = con.sql(ORACLE_SQL["op11_funnels"])
    ours = QUERIES["op11_funnels"](spark, data).select(*found.columns)
    assert sorted(map(tuple, ours.collect()), key=repr) == sorted(found.fetchall(), key=repr)
