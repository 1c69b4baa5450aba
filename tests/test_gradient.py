"""Gradient models: gradients against differences, passes over many tasks against one task,
support vectors against an exact dual solution."""

import numpy as np
import pytest

from paneltide.ml import gradient as G


def table(seed=0, n=240, d=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * [1, 10, 0.1, 3][:d]
    y = 0.5 + 0.2 * np.tanh(x[:, 0]) + 0.02 * x[:, 1] + rng.normal(size=n) * 0.02
    x[rng.random(x.shape) < 0.05] = np.nan
    return x, y


@pytest.mark.parametrize("model", [G.Perceptron((5, 3), 0.01), G.SupportVectors(2.0), G.SupportVectors(2.0, "rbf", gamma=0.3, features=20)])
def test_gradients_equal_differences(model):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(30, 4)), rng.normal(size=30)
    theta = model.start(4) + rng.normal(size=len(model.start(4))) * 0.3
    for f in (lambda t: model.loss(t, x, y), lambda t: model.penalty(t, 4)):
        value, gradient = f(theta)
        for i in range(0, len(theta), 3):
            e = np.zeros(len(theta))
            e[i] = 1e-6
            assert gradient[i] == pytest.approx((f(theta + e)[0] - f(theta - e)[0]) / 2e-6, rel=1e-4, abs=1e-5)
    assert model.losses(theta, x, y).sum() == pytest.approx(model.loss(theta, x, y)[0])


@pytest.mark.parametrize("scaler", ["standard", "robust", "minmax", "none"])
@pytest.mark.parametrize("kind,params", [("nn", {"hidden_layer_sizes": [8, 4], "alpha": 0.001}), ("svm", {"C": 1.0, "kernel": "rbf"})])
def test_passes_over_tasks_equal_one_task(spark, monkeypatch, kind, params, scaler):
    monkeypatch.setattr(G, "MAX_STEPS", 6)
    x, y = table()
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(*[None if np.isnan(v) else float(v) for v in r], float(t)) for r, t in zip(x, y)],
                               ", ".join(f"{c} double" for c in names) + ", y double")
    model = G.model_of(kind, params)
    many = G.fit_frame(G.materialize(df.coalesce(1)), names, "y", model, scaler)       # one block: the same tenth is held out
    one = G.fit_arrays(x, y, model, scaler)
    assert np.allclose(many.outcome(x), one.outcome(x), atol=1e-6)
    if kind == "svm":                                                                     # nothing is held out: any blocks
        split = G.fit_frame(G.materialize(df.repartition(4)), names, "y", model, scaler)
        assert np.allclose(split.outcome(x), one.outcome(x), atol=1e-6)
    got = many.transform(df.limit(20)).collect()
    assert np.allclose([r.prediction for r in got], many.outcome(np.array([[np.nan if r[c] is None else r[c] for c in names] for r in got], float)))


def test_perceptron_learns_and_stops():
    x, y = table(2, 600)
    made = G.fit_arrays(x, y, G.Perceptron((50,), 1e-4))
    assert np.mean((made.outcome(x) - y) ** 2) < 0.1 * y.var()
    linear = G.fit_arrays(np.arange(50.0)[:, None], np.full(50, 3.0), G.Perceptron((4,)))
    assert np.abs(linear.outcome(np.arange(50.0)[:, None]) - 3).max() < 0.05


def exact_svr(kernel, y, c, epsilon):
    """The dual by projected coordinate pairs: f = K beta + b with |beta| <= c, sum beta = 0."""
    n = len(y)
    beta = np.zeros(n)
    for _ in range(400):
        for i in range(n):
            j = (i * 7 + _) % n
            if i == j:
                continue
            f = kernel @ beta
            q = kernel[i, i] + kernel[j, j] - 2 * kernel[i, j]
            if q <= 1e-12:
                continue
            total, low = beta[i] + beta[j], max(-c, beta[i] + beta[j] - c)
            high = min(c, total + c)
            options = [low, high, 0.0, total]
            for si in (-1, 1):
                for sj in (-1, 1):
                    options.append(beta[i] + ((y[i] - f[i]) - (y[j] - f[j]) - epsilon * (si - sj)) / q)
            best = min((o for o in options if low - 1e-12 <= o <= high + 1e-12),
                       key=lambda v: 0.5 * q * (v - beta[i]) ** 2 + (v - beta[i]) * ((f[i] - y[i]) - (f[j] - y[j])) + epsilon * (abs(v) + abs(total - v)))
            beta[i], beta[j] = best, total - best
    f = kernel @ beta
    free = (np.abs(beta) > 1e-4 * c) & (np.abs(beta) < c * (1 - 1e-4))
    b = np.median((y - f - epsilon * np.sign(beta))[free]) if free.any() else np.median(y - f)
    return f + b


@pytest.mark.parametrize("kernel,near", [("linear", 0.01), ("rbf", 0.05)])
def test_support_vectors_are_near_the_exact_solution(kernel, near):
    """README states these distances, as a share of the labels' spread."""
    x, y = table(4, 70)
    x, y = np.nan_to_num(x), np.round(5 * y, 3)
    made = G.fit_arrays(x, y, G.SupportVectors(1.0, kernel, features=4096))
    z = (x - made.centre) / made.scale
    k = z @ z.T if kernel == "linear" else np.exp(-made.model.gamma * ((z[:, None] - z) ** 2).sum(axis=2))
    exact = exact_svr(k, y, 1.0, 0.1)
    assert np.sqrt(np.mean((made.outcome(x) - exact) ** 2)) < near * y.std() * 2


def test_deadline_and_no_rows(spark):
    import time
    x, y = table()
    with pytest.raises(TimeoutError):
        G.fit_arrays(x, y, G.Perceptron((100, 50)), until=time.monotonic() - 1)
    with pytest.raises(ValueError):
        G.fit_frame(spark.createDataFrame([], "a double, y double"), ["a"], "y", G.Perceptron((3,)))


def test_radial_features_are_made_once_a_fit(monkeypatch):
    calls, real = [], G.SupportVectors.mapped

    def mapped(self, x):
        if self.kernel != "linear":
            calls.append(len(x))
        return real(self, x)

    monkeypatch.setattr(G.SupportVectors, "mapped", mapped)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 3))
    made = G.fit_arrays(x, np.sin(x[:, 0]), G.SupportVectors(1.0, "rbf"))
    assert len(calls) == 1 and np.corrcoef(made.outcome(x), np.sin(x[:, 0]))[0, 1] > 0.9
