"""Whitening against the covariance and its eigenvectors computed in one process."""

import numpy as np
import pytest

from paneltide.llm import chebyshev_whiten as W

SCHEMA = "vec_id long, embedding array<float>"


def plain(vectors):
    """(n, deviations as ints, whitened by component, explained) of usable vectors."""
    x = [[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for v in vectors]
    n, dims = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(dims)]
    deviation = [sum((n * r[j] - s[j]) ** 2 for j in range(dims)) for r in x]
    c = np.array([[(n * r[j] - s[j]) / n for j in range(dims)] for r in x])
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = [i for i in range(min(8, dims)) if e[i] > e.sum() * 1e-12]
    return n, deviation, c @ u[:, k] / np.sqrt(e[k]), e[k] / e.sum()


def check(spark, rows, vectors, schema=SCHEMA):
    got = W.whiten(spark.createDataFrame(rows, schema), ["vec_id"]).collect()
    n, deviation, white, explained = plain([v for _, v in vectors])
    place = {i: j for j, (i, _) in enumerate(vectors)}
    assert len(got) == n * white.shape[1]
    mine = np.full(white.shape, np.nan)
    for r in got:
        assert r.n == n and int(r.deviation) == deviation[place[r.vec_id]]
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9) and r.identity_error < 1e-8
        mine[place[r.vec_id], r.component - 1] = r.whitened
    sign = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine * sign - white).max() < 1e-6


def vectors(rng, n, dims, decay=0.85):
    return [(i, [float(np.float32(c)) for c in rng.normal(size=dims) * decay ** np.arange(dims)]) for i in range(n)]


def test_equals_plain(spark):
    rows = vectors(np.random.default_rng(1), 400, 48)
    check(spark, rows, rows)


def test_narrow_vectors_and_few_rows(spark):
    rng = np.random.default_rng(2)
    for n, dims in ((50, 5), (4, 40), (300, 12)):
        rows = vectors(rng, n, dims)
        check(spark, rows, rows)


def test_unusable_vectors_take_no_part(spark):
    good = vectors(np.random.default_rng(3), 60, 10)
    bad = [(100, None), (101, [None] * 10), (102, [float("nan")] * 10), (103, [float("inf")] + [0.0] * 9), (104, []),
           (105, [3e38] + [0.0] * 9), (106, [1.0] * 9)]
    check(spark, good + bad, good)
    more = [(i, v, 1, 2.0) for i, v in good]
    check(spark, more, good, SCHEMA + ", n int, whitened double")


def test_no_variance_or_no_rows(spark):
    assert W.whiten(spark.createDataFrame([], SCHEMA), ["vec_id"]).collect() == []
    assert W.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 5, SCHEMA), ["vec_id"]).collect() == []
    got = W.whiten(spark.createDataFrame([(None, [0.0, 2.0]), (None, [1.0, 2.0])] * 3, SCHEMA), ["vec_id"]).collect()
    assert [(r.vec_id, r.component, abs(round(r.whitened, 9))) for r in got] == [(None, 1, 1.0)] * 6


def test_deviation_beyond_a_long_is_exact(spark):
    rows = [(i, [float(np.float32(2.0 ** 38 * ((i % 3) - 1))), float(i)]) for i in range(30)]
    df = W.whiten(spark.createDataFrame(rows, SCHEMA), ["vec_id"])
    _, deviation, _, _ = plain([v for _, v in rows])
    assert {r.vec_id: int(r.deviation) for r in df.collect()} == dict(enumerate(deviation))
    assert max(deviation) >= 2 ** 63
    longs = df.withColumn("deviation", W.deviation_long())
    assert longs.schema["deviation"].dataType.simpleString() == "bigint"
    assert {r.vec_id: r.deviation for r in longs.collect()} == {i: d if d < 2 ** 63 else None for i, d in enumerate(deviation)}


@pytest.mark.parametrize("spectrum", [[1e8, 1e4, 1e3, 10, 9, 8, 7, 6, *[1e-3] * 60], [10 - i / 50 for i in range(80)], [5.0] * 3 + [1.0] * 70])
def test_eigenvectors_are_certified(spectrum):
    rng = np.random.default_rng(4)
    basis, _ = np.linalg.qr(rng.normal(size=(len(spectrum), len(spectrum))))
    v = basis * spectrum @ basis.T
    passes = []
    e, u, residual = W.leading(lambda q: passes.append(1) or v @ q, len(spectrum), 8)
    assert np.allclose(e, spectrum[:8], rtol=1e-9) and residual < 1e-9 and len(passes) < 150
    assert np.abs(v @ u - u * e).max() < 1e-8 * spectrum[0]
    assert np.allclose(u.T @ u, np.eye(8), atol=1e-12)


def test_partial_sums_are_added_in_groups(spark, monkeypatch):
    monkeypatch.setattr(W, "GATHER", 2)
    rows = vectors(np.random.default_rng(6), 200, 40)
    check(spark, rows, rows)
