"""Histogram boosting against a plain version that tries every split of every leaf."""

import time

import numpy as np
import pytest

from paneltide.ml import boosting as B


def table(seed=0, n=300, d=5, missing=0.1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 1)
    y = x[:, 0] * 2 + np.where(x[:, 1] > 0, 1.5, -0.5) + rng.normal(size=n) * 0.3
    x[rng.random(x.shape) < missing] = np.nan
    return x, y


def brute_tree(x, g, h, p):
    """Best-first growth, every value and both sides for missing ones: [(rows, value)]."""
    def score(s):
        d = h[s].sum() + p.lam
        return g[s].sum() ** 2 / d if d > 0 else 0.0

    def best(rows):
        top = None
        for f in range(x.shape[1]):
            v = x[rows, f]
            for to_left in (False, True):
                for cut in np.unique(v[~np.isnan(v)]):
                    left = rows[(v <= cut) | (np.isnan(v) & to_left)]
                    right = np.setdiff1d(rows, left)
                    if min(len(left), len(right)) < max(1, p.min_rows) or min(h[left].sum(), h[right].sum()) < p.min_hessian:
                        continue
                    gain = score(left) + score(right) - score(rows)
                    if top is None or round(gain, 9) > round(top[0], 9):
                        top = (gain, left, right)
        return top if top and top[0] > 1e-9 else None

    leaves = [(np.arange(len(x)), 0)]
    while not p.leaves or len(leaves) < p.leaves:
        options = [(best(rows), i) for i, (rows, depth) in enumerate(leaves) if not p.depth or depth < p.depth]
        options = [(b, i) for b, i in options if b]
        if not options:
            break
        b, i = max(options, key=lambda o: o[0][0])
        depth = leaves.pop(i)[1] + 1
        leaves += [(b[1], depth), (b[2], depth)]
    return [(rows, -p.rate * g[rows].sum() / (h[rows].sum() + p.lam)) for rows, _ in leaves]


@pytest.mark.parametrize("p", [
    B.Params(rounds=4, rate=0.3, depth=3, lam=1.0, min_hessian=1.0),
    B.Params(rounds=4, rate=0.1, leaves=7, min_rows=20),
    B.Params(rounds=3, rate=0.1, leaves=9, depth=3),
    B.Params(rounds=3, rate=0.5, depth=4, min_rows=1)])
def test_squared_error_equals_brute_force(p):
    x, y = table()
    score = np.full(len(y), y.mean())
    for _ in range(p.rounds):
        for rows, value in brute_tree(x, score - y, np.ones(len(y)), p):
            score[rows] += value
    model = B.fit_arrays(x, y, p)
    assert np.allclose(model.outcome(x), score)
    assert all(len(t.left) == 2 * sum(v >= 0 for v in t.left) + 1 for t, in model.generations)


def test_logistic_with_weights_equals_brute_force():
    x, y = table(2)
    y = (y > 1).astype(float)
    w = np.where(y > 0, 4.0, 1.0)
    p = B.Params(rounds=4, rate=0.3, depth=3, lam=1.0, min_hessian=1.0, objective="logistic")
    mean = (y * w).sum() / w.sum()
    score = np.full(len(y), np.log(mean / (1 - mean)))
    for _ in range(p.rounds):
        prob = 1 / (1 + np.exp(-score))
        for rows, value in brute_tree(x, (prob - y) * w, prob * (1 - prob) * w, p):
            score[rows] += value
    assert np.allclose(B.fit_arrays(x, y, p, w=w).outcome(x), 1 / (1 + np.exp(-score)))


@pytest.mark.parametrize("k", [3, 5])
def test_softmax_probabilities_and_loss(k):
    x, y = table(3)
    y = np.digitize(y, np.quantile(y, np.arange(1, k) / k)).astype(float)
    p = B.Params(rounds=12, rate=0.3, depth=3, lam=1.0, min_hessian=1.0, objective="softmax", classes=k)
    score = np.zeros((len(y), k))
    for _ in range(3):                                   # one joint gradient a round
        prob = np.exp(score) / np.exp(score).sum(axis=1, keepdims=True)
        step = np.zeros_like(score)
        for c in range(k):
            for rows, value in brute_tree(x, prob[:, c] - (y == c), 2 * prob[:, c] * (1 - prob[:, c]), p):
                step[rows, c] = value
        score += step
    first = B.fit_arrays(x, y, B.Params(**{**p.__dict__, "rounds": 3}))
    assert np.allclose(first.raw(x), score)
    model = B.fit_arrays(x, y, p)
    losses = []
    for r in range(p.rounds + 1):
        prob = B.softmax(B.Booster(p, model.cols, model.edges, model.base, model.generations[:r]).raw(x))
        assert np.allclose(prob.sum(axis=1), 1)
        losses.append(-np.log(prob[np.arange(len(y)), y.astype(int)]).mean())
    assert all(b < a for a, b in zip(losses, losses[1:]))


@pytest.mark.parametrize("p", [
    B.Params(rounds=5, rate=0.3, depth=3, lam=1.0, min_hessian=1.0),
    B.Params(rounds=3, rate=0.1, leaves=6, min_rows=5, column_share=0.6),
    B.Params(rounds=3, rate=0.3, depth=2, lam=1.0, objective="softmax", classes=3)])
def test_passes_over_many_tasks_equal_one_task(spark, monkeypatch, p):
    monkeypatch.setattr(B, "STAGE_TREES", 3)
    x, y = table(4)
    if p.objective == "softmax":
        y = np.digitize(y, [-1, 1]).astype(float)
    names = [f"c{i}" for i in range(x.shape[1])]
    rows = [(*[None if np.isnan(v) else float(v) for v in r], float(t)) for r, t in zip(x, y)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names) + ", y double").repartition(4)
    df = B.materialize(df)
    many = B.fit(df, names, "y", p)
    one = B.fit_frame(df, names, "y", p)
    assert np.allclose(many.raw(x), one.raw(x))
    got = many.transform(df).collect()
    exp = many.outcome(np.array([[np.nan if r[c] is None else r[c] for c in names] for r in got], float))
    assert np.allclose([r.prediction for r in got], exp)


def test_forest_is_a_mean_of_bootstrapped_trees():
    x, y = table(5, missing=0.0)
    model = B.fit_arrays(x, y, B.Params(rounds=40, objective="forest"))
    assert sum(map(len, model.generations)) == 40
    made = model.outcome(x)
    assert made.min() >= y.min() and made.max() <= y.max() and np.corrcoef(made, y)[0, 1] > 0.95
    bounded = B.fit_arrays(x, y, B.Params(rounds=3, objective="forest", depth=2))
    assert max(max(t.depth) for g in bounded.generations for t in g) == 2


def test_shares_edges_fill_and_deadline(spark):
    x, y = table(6)
    a = B.fit_arrays(x, y, B.Params(rounds=6, depth=3, row_share=0.5, column_share=0.4))
    b = B.fit_arrays(x, y, B.Params(rounds=6, depth=3, row_share=0.5, column_share=0.4))
    assert np.array_equal(a.raw(x), b.raw(x))
    assert all(len({f for f, left in zip(t.feature, t.left) if left >= 0}) <= 2 for t, in a.generations)
    flat = B.fit_arrays(np.ones((50, 2)), np.arange(50.0), B.Params(rounds=3, depth=3))
    assert np.allclose(flat.outcome(np.ones((4, 2))), 24.5)
    with pytest.raises(TimeoutError):
        B.fit_arrays(x, y, B.Params(rounds=10**6, depth=3), until=time.monotonic() + 0.3)
    df = spark.createDataFrame([(1.0, 1.0), (None, 5.0), (3.0, 9.0), (3.0, None)], "a double, y double")
    model = B.fit_frame(df, ["a"], "y", B.Params(rounds=50, rate=0.5, depth=1), fill={"a": 3.0})
    assert np.allclose(model.outcome(np.array([[1.0], [np.nan], [3.0]])), [1.0, 7.0, 7.0], atol=1e-3)
    with pytest.raises(ValueError):
        B.fit_frame(df.limit(0), ["a"], "y", B.Params())


def test_many_distinct_values_fall_into_quantile_bins(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=3000)
    edges = B.edges_of_matrix(v[:, None], 50)[0]
    counts = np.bincount(B.to_bins(v[:, None], [edges])[:, 0])
    assert len(counts) == 50 and counts.min() > 40 and counts.max() < 80
    df = spark.createDataFrame([(float(a),) for a in v], "v double")
    near = B.edges_of(df, ["v"], 50)[0]
    assert 40 <= len(near) <= 50 and np.abs(np.searchsorted(np.sort(v), near) / 3000 - np.arange(1, len(near) + 1) / 50).max() < 0.05


def test_quantile_edges_of_many_tasks(spark, monkeypatch):
    v = np.random.default_rng(9).normal(size=5000)
    df = spark.createDataFrame([(float(a), float(i % 5), None) for i, a in enumerate(v)], "v double, few double, none double").repartition(7)
    monkeypatch.setattr(type(df), "approxQuantile", None)          # hundreds of quantiles of wide tables took longer than a fit
    near, few, none = B.edges_of(df, ["v", "few", "none"], 50)
    assert few.tolist() == [0.0, 1.0, 2.0, 3.0] and not len(none)
    assert len(near) == 49 and np.abs(np.searchsorted(np.sort(v), near, "right") / 5000 - np.arange(1, 50) / 50).max() <= 1 / 200


def test_a_pass_counts_only_the_smaller_sisters_and_reaches_no_row_twice(spark, monkeypatch):
    x, y = table(11, missing=0.0)
    asked, real = [], B._added
    monkeypatch.setattr(B, "_added", lambda parts, shape: asked.append(shape[1]) or real(parts, shape))
    monkeypatch.setattr(B, "GATHER_BYTES", 0)                       # tasks add the histograms first
    df = B.materialize(spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, d double, e double, y double"))
    p = B.Params(rounds=3, depth=4, min_rows=5)
    model = B.fit(df, list("abcde"), "y", p)
    assert len(asked) == 3 * 4 and all(n <= 4 for n in asked)       # a pass a level: 1, 1, at most 2 and 4 leaves
    assert np.allclose(model.raw(x), B.fit_arrays(x, y, p, edges=model.edges).raw(x))


@pytest.mark.parametrize("depth", [0, 5])
def test_forest_trees_equal_brute_force_in_any_task(spark, monkeypatch, depth):
    x, y = table(12, n=120, d=3, missing=0.2)
    p = B.Params(rounds=18, objective="forest", depth=depth)
    model = B.fit_arrays(x, y, p)
    counts = np.random.default_rng([p.seed, 11, 1, 0]).poisson(1.0, (len(y), 2))[:, 1].astype(float)
    rows = np.flatnonzero(counts)
    score = np.zeros(len(y))
    for at, value in brute_tree(x[rows], -(y * counts)[rows], counts[rows], B.Params(depth=depth, rate=1.0)):
        score[rows[at]] += value
    tree = model.generations[1][1]
    assert np.allclose(tree.value[tree.route(B.to_bins(x, model.edges))][rows], score[rows])
    monkeypatch.setattr(B, "_fit_in_one_task", None)               # a forest's trees are dealt over tasks
    df = B.materialize(spark.createDataFrame([(*[None if np.isnan(v) else float(v) for v in r], float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double"))
    order = df.toPandas().to_numpy(float)
    dealt = B.fit_frame(df, list("abc"), "y", p)
    assert np.allclose(dealt.raw(x), B.fit_arrays(order[:, :3], order[:, 3], p).raw(x))
    monkeypatch.setattr(B, "DENSE_ROWS", 1)
    monkeypatch.setattr(B.np, "ix_", B.np.ix_)
    assert np.allclose(B.fit_arrays(x, y, p).raw(x), model.raw(x))


def test_a_forest_of_several_batches_over_many_tasks(spark):
    x, y = table(13, missing=0.0)
    df = B.materialize(spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, d double, e double, y double"))
    model = B.fit(df, list("abcde"), "y", B.Params(rounds=18, objective="forest", depth=3))
    assert sum(map(len, model.generations)) == 18 and np.corrcoef(model.outcome(x), y)[0, 1] > 0.8


@pytest.mark.parametrize("depth", [0, 4])
def test_a_forest_is_the_same_whatever_a_task_holds(spark, monkeypatch, depth):
    x, y = table(14, n=200)
    y = np.round(y * 64) / 64                                      # sums without rounding
    cols = list("abcde")
    df = B.materialize(spark.createDataFrame([(*[None if np.isnan(v) else float(v) for v in r], float(t)) for r, t in zip(x, y)],
                                             "a double, b double, c double, d double, e double, y double"))
    order = df.toPandas().to_numpy(float)
    p = B.Params(rounds=18, objective="forest", depth=depth)
    one = B.fit_arrays(order[:, :5], order[:, 5], p).raw(x)
    monkeypatch.setattr(B, "FOREST_CELLS", 5 * 60)                 # nodes of more than 60 rows are split by passes
    dealt = B.fit_frame(df, cols, "y", p)
    assert all(len(t.left) > 1 for t in dealt.tops)
    assert np.allclose(dealt.raw(x), one)


def test_bootstraps_do_not_depend_on_blocks(monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 50)
    p = B.Params(objective="forest", rounds=4)
    whole = B._row_weights(p, 1, 4, (0, 0), 200)
    assert np.array_equal(whole, np.concatenate([B._row_weights(p, 1, 4, (9, a), b - a) for a, b in zip((0, 30, 120), (30, 120, 200))]))
    assert not np.array_equal(whole[:50], whole[50:100])


def test_forest_scores_meet_trees_where_they_are(spark, monkeypatch):
    x, y = table(15, n=150)
    names = "a double, b double, c double, d double, e double, y double"
    df = B.materialize(spark.createDataFrame([(*[None if np.isnan(v) else float(v) for v in r], float(t)) for r, t in zip(x, y)], names).repartition(3))
    model = B.fit_frame(df, list("abcde"), "y", B.Params(rounds=5, objective="forest"), fill=dict.fromkeys("abcde", 0.5))
    rows = df.toPandas().to_numpy(float)
    wanted = model.raw(rows[:, :5])[:, 0] / 5
    monkeypatch.setattr(B.Forest, "raw", None)
    monkeypatch.setattr(type(model.parts), "collect", None)        # trees as large as the table do not reach the driver
    scored = model.transform(df, "p").toPandas()
    assert list(scored.columns) == [*"abcde", "y", "p"]
    got = {tuple(np.nan_to_num(r[:6], nan=-9.0)): r[6] for r in scored.to_numpy(float)}
    assert np.allclose([got[tuple(np.nan_to_num(r, nan=-9.0))] for r in rows], wanted)


def test_columns_with_few_bins_share_a_count():
    rng = np.random.default_rng(16)
    n, widths = 500, [3, 256, 40, 8, 2, 60]
    bins = np.asfortranarray(np.stack([rng.integers(0, w - 1, n) for w in widths], 1).astype(np.uint8))
    bins[rng.random(bins.shape) < 0.1] = B.MISSING
    codes = B.Codes(bins, widths)
    assert len(codes.groups) < len(widths) and sorted(f for g in codes.groups for f in g) == list(range(6))
    g, h, r = rng.normal(size=n), rng.random(n), np.flatnonzero(rng.random(n) < 0.5)
    sums, use = np.zeros((3, 2, 6, 256)), np.array([True, True, False, True, True, True])
    codes.add_to(sums, [(0, None, g, h, None), (1, r, g[r], h[r], None)], use)
    for leaf, some in ((0, np.arange(n)), (1, r)):
        for f in range(6):
            for j, v in enumerate((g, h, np.ones(n))):
                assert np.allclose(sums[j, leaf, f], np.bincount(bins[some, f], v[some], 256) if use[f] else 0.0)
