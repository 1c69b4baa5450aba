import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler

from paneltide.ml import models


def _data(spark, n=60, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = x @ np.array([0.5, -1.0, 2.0]) + 0.3 + rng.normal(scale=0.5, size=n)
    df = spark.createDataFrame([(float(a), float(b), float(c), float(t)) for (a, b, c), t in zip(x, y)],
                               "a double, b double, c double, y double")
    return df, x, y


def _fit(spark, df, kind, alpha, y):
    est = models.regressor(kind, {"alpha": alpha}, label="y", y_std=float(np.std(y)), n_rows=len(y))
    m = Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "c"], outputCol="features"), est]).fit(df)
    return np.array(m.stages[-1].coefficients.toArray())


def test_ridge_alpha_matches_closed_form(spark):
    df, x, y = _data(spark)
    alpha = 10.0
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)   # unnormalised ridge with intercept
    assert np.allclose(_fit(spark, df, "ridge", alpha, y), w, atol=1e-4)


def test_lasso_alpha_matches_coordinate_descent(spark):
    df, x, y = _data(spark)
    alpha = 0.1
    xc, yc = x - x.mean(0), y - y.mean()
    n = len(y)
    w = np.zeros(3)
    for _ in range(2000):                       # (1/2n)||y - Xw||^2 + alpha ||w||_1
        for j in range(3):
            r = yc - xc @ w + xc[:, j] * w[j]
            rho = xc[:, j] @ r / n
            z = xc[:, j] @ xc[:, j] / n
            w[j] = np.sign(rho) * max(abs(rho) - alpha, 0.0) / z
    assert np.allclose(_fit(spark, df, "lasso", alpha, y), w, atol=1e-3)


def test_onehot_unseen_category_is_all_zeros(spark):
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F
    train = spark.createDataFrame([("PG",), ("SF",), ("C",), ("SF",)], "pos string")
    test = spark.createDataFrame([("SF",), ("XX",)], "pos string")
    stages, outs = models.onehot_stages(["pos"])
    m = Pipeline(stages=stages).fit(train)
    got = {r.pos: r.v for r in m.transform(test).select("pos", vector_to_array(F.col(outs[0])).alias("v")).collect()}
    assert sum(got["XX"]) == 0.0 and sum(got["SF"]) == 1.0
    assert len(got["SF"]) == 3          # every known level kept (C, PG, SF)


def test_linear_pipeline_matches_least_squares(spark):
    df, x, y = _data(spark, n=80, seed=11)
    df = df.withColumnRenamed("y", "win_pct")
    m = models.fit_regression(df, ["a", "b", "c"], "linear", scaler="standard")
    pred = np.array([r.pred_score for r in models.predict(m, df).collect()])
    X = np.column_stack([x, np.ones(len(y))])
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    assert np.allclose(pred, X @ beta, atol=1e-6)


def test_an_ensemble_is_the_same_at_any_size(spark, monkeypatch):
    from paneltide.ml import boosting
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), float(round(2 * a + b * b, 1))) for a, b in np.round(rng.normal(size=(80, 2)), 1)]
    df = boosting.materialize(spark.createDataFrame(rows, "a double, b double, win_pct double"))
    few = {"rf": {"n_estimators": 3}, "gb": {"n_estimators": 3}}

    def scores():
        members = models.fit_ensemble(df, ["a", "b"], models.ENSEMBLES[2], member_params=few)
        return sorted((r.a, r.b, round(r.pred_score, 9)) for r in models.predict_ensemble(members, df).collect())

    one = scores()
    monkeypatch.setattr(boosting, "FOREST_CELLS", 2 * 20)          # as of a table too large for one task
    assert scores() == one
