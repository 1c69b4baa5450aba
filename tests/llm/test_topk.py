import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneltide.llm import nra_topk as N


def plain(rows, k, every):
    use = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        use[i] = min(use.get(i, v), v)
    q = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in use.items()}
    out = []
    for i in sorted(q):
        if i % every == 0:
            s = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i)[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


def rows_of(rnd, n, dims):
    f32 = lambda x: float(np.float32(x))
    rows = [(i, [f32(rnd.gauss(0, 0.3)) for _ in range(dims)]) for i in range(n)]
    for i in range(0, n, 5):
        rows[i] = (i, list(rows[0][1]))              # many equal vectors: ties
    return rows


@pytest.mark.parametrize("shard,block", [(4096, 512), (23, 4)])
def test_equals_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(N, "SHARD", shard)
    monkeypatch.setattr(N, "BLOCK", block)
    rows = rows_of(random.Random(shard), 150, 9)
    nan, inf = float("nan"), float("inf")
    rows += [(500, None), (510, [nan] * 9), (520, [inf] + [0.0] * 8), (530, [None] + [1.0] * 8), (None, [1.0] * 9), (540, []), (7, rows[7][1]),
             (550, [3.0, -2.0]), (8, [-9.0] * 9)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = sorted(tuple(r) for r in N.top_k(df, F.col("vec_id") % 10 == 0, 5).collect())
    assert got == plain(rows, 5, 10)


def test_few_rows_and_large_components(spark):
    rows = [(0, [1e12, 1.0]), (1, [1e12, -1.0]), (2, [-1e12, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    small = spark.createDataFrame([(0, [0.5]), (1, [0.25])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in N.top_k(small, F.col("vec_id") == 0, 5).collect()] == [(0, 1, 1, 128 * 64)]
    cell = N.nra_cell(np.array([q[0]]), np.array([0]), np.array([q[0], q[1], q[2]]), np.array([0, 1, 2]), 2)
    assert [c[:2] for c in cell] == [(0, 1), (0, 2)] and cell[0][2] == q[0][0] * q[1][0] + q[0][1] * q[1][1]
    assert N.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert N.top_k(small.limit(1), F.col("vec_id") == 0).count() == 0


def test_reading_stops_early_and_stays_exact():
    rnd = np.random.default_rng(0)
    c = rnd.integers(-100, 100, (2000, 6))
    c[:5] = 1000
    q = np.full((1, 6), 7)
    got = N.nra_cell(q, np.array([-1]), c, np.arange(2000), 5)
    assert [g[1] for g in got] == [0, 1, 2, 3, 4] and all(g[2] == 42000 for g in got)


@pytest.mark.parametrize("n", [500, 2000, 4096])
def test_many_queries_equal_brute_force(n):
    rnd = np.random.default_rng(n)
    c = rnd.integers(-10**6, 10**6, (n, 6))
    q = rnd.integers(-10**6, 10**6, (2000, 6))
    wrong = 0
    for a in range(0, len(q), N.BLOCK):
        got = {}
        for i, j, score in N.nra_cell(q[a:a + N.BLOCK], np.arange(-1 - a, -1 - a - len(q[a:a + N.BLOCK]), -1), c, np.arange(n), 5):
            got.setdefault(i, []).append((j, score))
        for i, scores in enumerate(q[a:a + N.BLOCK] @ c.T):
            best = np.lexsort((np.arange(n), -scores))[:5]
            wrong += got[-1 - a - i] != [(j, scores[j]) for j in best]
    assert not wrong


def test_components_and_scores_beyond_a_long(spark):
    rows = [(0, [1e300, 1.0]), (1, [3e13, 1.0]), (2, [2e13, 2.0]), (3, [1e13, 0.0]), (4, [-2e13, 1.0]), (5, [0.5, 0.5]), (6, [0.5, 0.25]), (7, [1e17, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in N.top_k(df, F.col("vec_id").isin(0, 1, 5), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    q = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if i not in (0, 7)}
    for i in (1, 5):                                            # 0 and 7 leave the integers: no part
        best = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i)[:5]
        assert got[i] == [(j, -s if -s in range(-2**63, 2**63) else None) for s, j in best]
    assert set(got) == {1, 5} and [s for _, s in got[1]][0] is None
