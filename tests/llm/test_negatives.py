"""Hard negatives against brute force and SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import negatives
from tessera.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, anchors, scale, positives=5, k=10, low=30, high=90):
    """(anchor, positive, rank, negative, scores) of rows (id, vector, label), one for each id."""
    v = {i: ([int(np.floor(scale * c)) for c in x], n) for i, x, n in rows}
    out = []
    for a in anchors:
        score = {i: sum(p * q for p, q in zip(v[a][0], x)) for i, (x, _) in v.items() if len(x) == len(v[a][0]) and i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if v[i][1] == v[a][1]][:positives]:
            hard = [i for i in order if v[i][1] != v[a][1] and low * score[p] <= 100 * score[i] <= high * score[p]][:k]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(hard, 1)]
    return sorted(out)


def mined(spark, rows, scale=8, **more):
    made = negatives.labelled_vectors(spark.createDataFrame(rows, SCHEMA), scale)
    return sorted(tuple(r) for r in negatives.hard_negatives(made, F.col("vec_id") % 10 == 0, **more).collect())


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_against_all_pairs_over_many_blocks(spark, monkeypatch, seed):
    """Small numbers, so there are ties at both limits; negative scores; labels of one row; blocks of a few vectors; several dimensions."""
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(negatives, "BLOCK", 11)
    monkeypatch.setattr(negatives, "GROUP", 3)
    monkeypatch.setattr(negatives, "SCORES", 40)
    rows = [(int(i), [float(c) for c in rng.integers(-3, 5, rng.choice([2, 4]))], int(rng.integers(0, 4))) for i in rng.permutation(120)]
    rows.append((500, [1.0, 1.0, 1.0, 1.0], 9))
    for more in ({}, {"positives": 2, "k": 3, "low": 0, "high": 100}):
        got = mined(spark, rows, 1, **more)
        assert got and got == brute(rows, [r[0] for r in rows if r[0] % 10 == 0], 1, **more)


def test_the_query_on_the_table(spark, data):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{data}/embeddings.parquet'")
    found = con.sql(ORACLE_SQL["op13_hard_negatives"])
    ours = QUERIES["op13_hard_negatives"](spark, data).select(*found.columns)
    assert sorted(map(tuple, ours.collect())) == sorted(found.fetchall())


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (10, [1.0, 1.0], 1), (10, [1.0, 1.0], 1), (10, [9.0, 9.0], 2), (11, [1.0, 1.0], 1), (12, [1.0, 0.5], 2), (13, None, 2), (14, [1.0, None], 2), (15, [1.0, nan], 2), (16, [inf, 1.0], 2),
        (None, [1.0, 1.0], 2), (17, [1.0, 0.5], None), (18, [0.75, 0.75], 3), (19, [], 1), (20, [], 1), (21, [], 2), (30, [5.0, 5.0, 5.0], 1), (40, [-1.0, -1.0], 4), (41, [1.0, 1.0], 4),
    ]
    # 40's positive has a negative score, 30 is alone in its dimension; without components all scores are 0, and 0 <= 0 <= 0
    assert mined(spark, rows) == [(10, 11, 1, 12, 128, 96), (10, 11, 2, 18, 128, 96), (20, 19, 1, 21, 0, 0)]
    assert mined(spark, rows[:1]) == [] and mined(spark, []) == []


def test_products_beyond_doubles_are_exact(spark):
    big = float(2**30)
    rows = [(10, [big, 3.0], 1), (11, [big, 1.0], 1), (12, [big - 1, 5.0], 2), (13, [big / 2, 1.0], 2), (14, [big / 2, 2.0], 3)]
    assert mined(spark, rows, 1, high=100) == brute(rows, [10], 1, high=100)
    with pytest.raises(Exception, match="doesn't fit into a long"):
        mined(spark, [(10, [2.0**40], 1), (11, [2.0**40], 1)], 1)
