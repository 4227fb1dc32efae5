"""Every query with SQL gives the rows of that SQL."""

import math
import os

import duckdb
import pytest

from tessera import stored_queries, value_queries  # noqa: F401  (they register their queries)
from tessera.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations stamps".split()


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{data}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return [plain(x) for x in value] if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sql, data, name):
    df = QUERIES[name](spark, data)
    rows = df.collect()
    found = sql.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    order = [found.columns.index(c) for c in columns]
    ours = sorted(([plain(r[c]) for c in columns] for r in rows), key=repr)
    theirs = sorted(([plain(r[i]) for i in order] for r in found.fetchall()), key=repr)
    assert ours == theirs


def test_draw_is_reproducible_and_possible(spark, data):
    rows = QUERIES["sample_draw"](spark, data)
    first = {r.vec_id: r.token_id for r in rows.collect()}
    assert first == {r.vec_id: r.token_id for r in rows.repartition(7).collect()}
    assert all(0 <= t < 64 for t in first.values())
