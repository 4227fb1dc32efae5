"""Top-k search and vector near-duplicates against brute force."""

import math

import numpy as np
import pytest

from tessera.llm import common, gridjoin, knn
from tessera.llm.common import connected_components, spanning_forest
from tessera.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def top(ids, x, k=20):
    """Brute force: (query, rank, vec, score) for queries divisible by 20."""
    v, out = np.floor(64 * x).astype(np.int64), []
    for i in np.flatnonzero(ids % 20 == 0):
        s = v @ v[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out += [(int(ids[i]), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(order)]
    return sorted(out)


def table(spark, ids, x, labels):
    return spark.createDataFrame([(int(i), [float(c) for c in v], int(n)) for i, v, n in zip(ids, x, labels)], SCHEMA)


def test_topk_on_the_table(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    assert sorted(tuple(r) for r in QUERIES["op1_topk"](spark, data).collect()) == top(ids, x)


def test_topk_with_copies_ties_and_chunks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 8)), 60, 0), rng.normal(size=(140, 8)), np.zeros((20, 8))]).astype(np.float32)
    ids = rng.permutation(len(x))
    df = knn.integer_vectors(table(spark, ids, x, ids))
    monkeypatch.setattr(knn, "CHUNK", 7)
    got = knn.top_k(df, df.where("vec_id % 20 = 0"), pivots=5)
    assert sorted(tuple(r) for r in got.collect()) == top(ids, x.astype(np.float64))


def test_topk_edges(spark):
    rows = [
        (20, [1.0, 2.0], 0), (1, [1.0, None], 0), (2, None, 0), (3, [math.nan, 1.0], 0), (4, [math.inf, 1.0], 0), (5, [1.0, 1.0], None),
        (None, [1.0, 1.0], 0), (7, [1.0, 1.0, 1.0], 0), (20, [1.0, 2.0], 0),
    ]
    df = knn.integer_vectors(spark.createDataFrame(rows, SCHEMA))
    assert [tuple(r) for r in knn.top_k(df, df.where("vec_id = 20")).collect()] == [(20, 1, 5, 64 * 64 * 3)]
    empty = df.limit(0)
    assert knn.top_k(empty, empty).count() == 0 and knn.top_k(df, empty).count() == 0


def test_bounds_skip_cells_of_clustered_vectors(spark):
    """Of clustered vectors a query needs few cells; those that it needs hold all of its best."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 16)) * 40
    x = np.concatenate([c + rng.normal(size=(60, 16)) * 0.5 for c in centres])
    df = knn.integer_vectors(table(spark, range(len(x)), x, np.zeros(len(x))))
    cells = knn.cells_of(df, 16, 20, 160)
    v = np.floor(64 * x.astype(np.float32).astype(np.float64))
    least, need = cells.bounds(v[::20], 20)
    where, _ = cells.of(v)
    scores = v[::20] @ v.T
    scores[np.arange(len(least)), np.arange(0, len(v), 20)] = -np.inf
    kth = np.sort(scores, 1)[:, -20]
    assert (least <= kth).all() and all(need[i, where[scores[i] >= kth[i]]].all() for i in range(len(least)))
    assert need.mean() < 0.2
    got = knn.top_k(df, df.where("vec_id % 20 = 0"), pivots=160)
    assert sorted(tuple(r) for r in got.collect()) == top(np.arange(len(x)), x.astype(np.float32).astype(np.float64))


def test_topk_of_large_and_missing_components(spark):
    big = [(20, [float(1 << 40), 1.0], 0), (1, [3.0, float(1 << 38) + 1], 0), (2, [-5.0, 7.0], 0), (40, [], 0), (3, [], 0), (4, [], 0)]
    df = knn.integer_vectors(spark.createDataFrame(big, "vec_id long, embedding array<double>, label int"))
    got = sorted(tuple(r) for r in knn.top_k(df, df.where("vec_id % 20 = 0")).collect())
    product = lambda a, b: sum(int(64 * x) * int(64 * y) for x, y in zip(a, b))
    assert got == [(20, 1, 1, product(big[0][1], big[1][1])), (20, 2, 2, product(big[0][1], big[2][1])), (40, 1, 3, 0), (40, 2, 4, 0)]
    with pytest.raises(Exception, match="ArithmeticError"):
        huge = knn.integer_vectors(spark.createDataFrame([(20, [2.0**50, 1.0], 0), (1, [2.0**50, 1.0], 0)], SCHEMA))
        knn.top_k(huge, huge).collect()
    with pytest.raises(Exception, match="too large"):
        knn.integer_vectors(spark.createDataFrame([(20, [2.0**70], 0)], SCHEMA)).collect()


def linked(ids, x, labels, cosine=0.93):
    n = np.linalg.norm(x, axis=1)
    near = (x @ x.T) / np.outer(n, n) >= cosine
    near &= np.equal.outer(labels, labels)
    np.fill_diagonal(near, False)
    links, comp = near.sum(1), ids.copy()
    np.fill_diagonal(near, True)
    while True:
        new = np.array([comp[r].min() for r in near])
        if (new == comp).all():
            return {int(i): (int(k), int(c), bool(i == c)) for i, k, c in zip(ids, links, comp)}
        comp = new


@pytest.mark.parametrize("block,tile", [(4, 2), (4, 8), (1024, 8)])
def test_grid_join_against_brute_force(spark, monkeypatch, block, tile):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 6))
    x = np.concatenate([
        centres[rng.integers(0, 30, 250)] + rng.normal(size=(250, 6)) * 0.15, np.repeat(centres[:1], 40, 0), 3 * centres[:5],
    ]).astype(np.float32)
    ids, labels = rng.permutation(len(x)) + 5, rng.integers(0, 2, len(x))
    monkeypatch.setattr(gridjoin, "BLOCK", block)
    monkeypatch.setattr(gridjoin, "TILE", tile)
    got = gridjoin.near_duplicates(table(spark, ids, x, labels))
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got.collect()} == linked(ids, x.astype(np.float64), labels)


def test_grid_join_edges(spark):
    rows = [
        (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [1.0, 0.0], None), (4, [0.0, 0.0], 0), (5, None, 0), (6, [math.nan, 1.0], 0), (7, [2.0, 0.0], 0),
        (8, [1.0, None], 0), (9, [1.0], 0), (10, [-0.0, 1.0], 1), (11, [0.0, 1.0], 1), (2, [1.0, 0.0], 0),
    ]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in gridjoin.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 8, 9)]
    assert got == sorted([(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (7, 3, 1, False), (10, 1, 10, True), (11, 1, 10, False), *alone])
    assert gridjoin.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_vectors_of_any_size_link(spark):
    rows = [
        (1, [1e200, 1e200], 0), (2, [1e-200, 1e-200], 0), (3, [5e-324, 5e-324], 0), (4, [1.7e308, 0.0], 0), (5, [1.0, 1e-9], 0), (6, [0.0, 1.0], 0),
    ] + [(10 + k, [1.0] * (k + 1), 0) for k in range(2, 14)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in gridjoin.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6)} | {10 + k: (0, 10 + k) for k in range(2, 14)}


@pytest.mark.parametrize("small", [0, 500_000])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(common, "SMALL_GRAPH", small)
    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, int(j)) for j in rng.integers(101, 200, 150)] + [(5, 5), (7, None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(v == 100 for k, v in got.items() if k >= 100)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    nodes, least = spanning_forest(np.array([3, 2, 9]), np.array([2, 1, 8]))
    assert dict(zip(nodes.tolist(), least.tolist())) == {3: 1, 2: 1, 9: 8}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, data, name):
    """Rows and types of the queries that SQL can express."""
    import duckdb

    con = duckdb.connect()
    for table in ("embeddings", "conversations", "clicks"):
        con.sql(f"create view {table} as select * from '{data}/{table}.parquet'")
    ours, theirs = QUERIES[name](spark, data), con.sql(ORACLE_SQL[name])
    order = [theirs.columns.index(c) for c in ours.columns]
    names = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert [names[t] for _, t in ours.dtypes] == [str(theirs.types[i]) for i in order]
    assert sorted(map(tuple, ours.collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in theirs.fetchall()), key=repr)
