"""Exact top-k search against all products."""

import numpy as np
import pytest

from granary.llm import topk
from granary.llm.common import table, written

SCHEMA = "label int, vec_id long, rank string, embedding array<double>"


def brute(rows, k=20, every=20, scale=64):
    """rows: (id, vector). The lists of all queries, with Python's integers."""
    ready = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(ready):
        if i is None or i % every:
            continue
        scores = [(-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(q, v)))), j is None, j or 0) for place, (j, v) in enumerate(ready) if place != at]
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found(spark, vectors, **how):
    df = spark.createDataFrame([(1, i, "x", v) for i, v in vectors], SCHEMA)
    return sorted((tuple(r) for r in topk.exact_top_k(df, **how).collect()), key=str)


def sample(seed, n, dim=12, spread=1.0):
    r = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in v]) for i, v in zip(r.permutation(3 * n)[:n], np.round(r.normal(size=(n, dim)) * spread, 1))]


@pytest.mark.parametrize("how", [{}, {"rows": 16, "group": 2}, {"rows": 100, "bytes_most": 12 * 8 * 7, "k": 3}])
def test_equals_all_products(spark, how):
    rows = sample(1, 300)
    rows += [(i, v) for i, v in rows[:40]] + [(i + 1000, rows[3][1]) for i in range(50)]  # repeated rows, one vector many times
    rows += [(None, rows[5][1]), (None, None), (20, None), (40, [1.0, None]), (60, [float("nan")] * 12), (80, [float("inf")]), (0, [0.5] * 3), (100, []), (-20, [1.0] * 20)]
    assert found(spark, rows, **how) == brute(rows, how.get("k", 20))


def test_few_rows_and_none(spark):
    assert found(spark, []) == []
    assert found(spark, [(20, [1.0])]) == []
    assert found(spark, [(20, [1.0]), (21, [1.0])]) == [(20, 1, 21, 4096)]
    assert found(spark, [(1, [1.0]), (3, None)]) == []


def test_large_components_are_exact(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([[2.0**40, -(2.0**40), 3], [2.0**40, -(2.0**40), 1], [2.0**20 + 1, 5, -7], [2.0**20, 5, -7], [-(2.0**50), 2.0**50, 1]])]
    assert found(spark, rows, every=1) == brute(rows, every=1)
    small = [(i, [2.0**k + i, -(2.0**k) + i * i]) for k in (10, 22) for i in range(30)]
    assert found(spark, small, every=1, rows=8) == brute(small, every=1)


def test_arrays_of_floats_and_clashing_columns(spark):
    df = spark.createDataFrame([(k, [0.1 * k, 0.3]) for k in range(30)], "stripe long, embedding array<float>").withColumnRenamed("stripe", "vec_id").selectExpr("*", "1 AS score", "2 AS query_id", "3 AS id", "'m' AS m")
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in df.collect()]
    assert sorted((tuple(r) for r in topk.exact_top_k(df).collect()), key=str) == brute(rows)


def test_blocks_that_cannot_reach_the_list_are_left_out(spark):
    r = np.random.default_rng(5)
    rows = []
    for k in range(4000):  # vectors of few terms, as of words
        v = np.zeros(40)
        v[(k % 10) * 4 : (k % 10) * 4 + 4] = r.integers(1, 9, 4)
        rows.append((1, k, "x", [float(x) for x in v]))
    df = spark.createDataFrame(rows, SCHEMA)
    index = topk.stripes(df.coalesce(1), "vec_id", "embedding", rows=4096)
    blocks, scored = index.selectExpr("sum(blocks)", "sum(scored)").first()
    assert 0 < scored < 0.5 * blocks
    assert found(spark, [(i, v) for _, i, _, v in rows], rows=512) == brute([(i, v) for _, i, _, v in rows])


def test_bounds_hold():
    r = np.random.default_rng(2)
    for scale in (5, 10**6, 10**12):
        m = r.integers(-scale, scale, (200, 9))
        s = topk.Stripe(m, np.arange(200), np.zeros(200, bool))
        q = r.integers(-scale, scale, (30, 9))
        p, b = topk.products(q, m), topk.bounds(q, s.high, s.low)
        assert all((p[:, i * topk.BLOCK : (i + 1) * topk.BLOCK].max(axis=1) <= b[:, i]).all() for i in range(b.shape[1]))


def test_the_index_reads_two_columns(spark):
    df = topk.quantised(table(spark, "/root/testdata/sf0.001", "embeddings"), "vec_id", "embedding", 64)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "label" not in plan.split("ReadSchema")[1] and written(df, "q").count() == 500
