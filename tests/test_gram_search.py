"""Gram search: coefficients of any configuration without another pass, and a search with a
configuration that cannot finish."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from paneltide.ml import deadline, gram, models, search


def panel(spark, n_teams=12, years=range(1998, 2008), seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(n_teams):
        level = rng.normal()
        for y in years:
            pts, ast = level + rng.normal() * 0.5, rng.normal() * 10
            rows.append((f"T{t}", y, float(0.5 + 0.2 * pts + 0.01 * ast + rng.normal() * 0.05), float(pts), None if rng.random() < 0.1 else float(ast),
                         float(level), float(rng.normal()), float(rng.normal()), float(t % 3)))
    return spark.createDataFrame(rows, "team string, season_end_year int, win_pct double, pts double, ast double, prev_win_pct double, "
                                       "win_pct_3y double, win_pct_5y double, stl double")


def plain(x, y, kind, alpha, scaler):
    """Fitted values of the configuration on the matrix itself."""
    z = np.where(np.isnan(x), np.nanmean(x, axis=0), x)
    k = {"none": np.ones(z.shape[1]), "standard": z.std(axis=0), "minmax": np.ptp(z, axis=0),
         "robust": np.subtract(*np.percentile(z, [75, 25], axis=0))}[scaler]
    s = z / np.where(k > 0, k, 1.0)
    s, t = s - s.mean(axis=0), y - y.mean()
    if kind == "ridge":
        w = np.linalg.solve(s.T @ s + alpha * np.eye(s.shape[1]), s.T @ t)
    else:
        w = np.zeros(s.shape[1])
        for _ in range(3000):
            for j in range(len(w)):
                rho, q = s[:, j] @ (t - s @ w + s[:, j] * w[j]) / len(t), s[:, j] @ s[:, j] / len(t)
                w[j] = np.sign(rho) * max(abs(rho) - alpha, 0.0) / q
    return s @ w + y.mean()


@pytest.mark.parametrize("scaler", ["standard", "robust", "minmax", "none"])
def test_every_linear_configuration_equals_its_own_fit(spark, scaler):
    cols = ["ast", "prev_win_pct", "pts", "stl", "win_pct_3y"]
    df = panel(spark)
    g = gram.collect(df, cols, "win_pct")
    data = df.select("win_pct", *cols).toPandas()
    configs = [(i, own, kind, alpha, scaler) for i, (own, kind, alpha) in enumerate(
        (own, kind, alpha) for own in (cols, ["pts"], ["ast", "pts", "stl"]) for kind in ("ridge", "lasso") for alpha in (0.001, 0.1, 10.0))]
    solved, errors = gram.solve_all(spark, g, [*configs, (99, [], "ridge", 1.0, scaler), (98, cols, "other", 1.0, scaler)], 3)
    assert set(errors) == {98, 99} and len(solved) == len(configs)
    filled = np.where(np.isnan(data[cols].to_numpy(float)), g.means, data[cols].to_numpy(float))
    scores = {}
    for r in gram.score_all(df.withColumn("row", F.monotonically_increasing_id()), g, solved, ["win_pct"]).collect():
        scores.setdefault(r.iteration, []).append((r.win_pct, r.score))
    for i, own, kind, alpha, _ in configs:
        exp = plain(data[own].to_numpy(float), data["win_pct"].to_numpy(), kind, alpha, scaler)
        assert np.allclose(filled @ solved[i][0] + solved[i][1], exp, atol=1e-8)
        assert np.allclose(sorted(s for _, s in scores[i]), sorted(exp), atol=1e-8)


@pytest.mark.parametrize("kind,alpha", [("ridge", 1.0), ("lasso", 0.001), ("linear", 0.0)])
def test_gram_equals_the_fitted_estimators(spark, kind, alpha):
    cols = ["ast", "pts", "stl"]
    df = panel(spark)
    (scored,) = search._fit_score(kind, {"alpha": alpha}, "standard", cols, df, [df])
    fitted = models.predict(models.fit_regression(df, cols, kind, {"alpha": alpha}, "standard"), df)
    a = {(r.team, r.season_end_year): r.pred_score for r in scored.collect()}
    b = {(r.team, r.season_end_year): r.pred_score for r in fitted.collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-4


def test_constant_and_empty_columns(spark):
    df = panel(spark).withColumns({"flat": F.lit(2.0), "none": F.lit(None).cast("double")})
    g = gram.collect(df, ["flat", "none", "pts"], "win_pct")
    for scaler in ("standard", "robust", "minmax", "none"):
        for kind in ("ridge", "lasso", "linear"):
            w, b = g.solve(["flat", "none", "pts"], kind, 0.01, scaler)
            assert w[0] == w[1] == 0.0 and np.isfinite(b) and w[2] > 0
    with pytest.raises(ValueError):
        gram.collect(df.limit(0), ["pts"], "win_pct")


def test_sums_of_many_tasks_are_added_in_groups(spark, monkeypatch):
    df = panel(spark).repartition(9)
    whole = gram.collect(df, ["pts", "stl"], "win_pct")
    monkeypatch.setattr(gram, "GATHER", 2)
    grouped = gram.collect(df, ["pts", "stl"], "win_pct")
    assert np.allclose(whole.zz, grouped.zz) and np.allclose(whole.zy, grouped.zy)


def test_work_past_its_limit_is_cancelled_and_other_work_goes_on(spark):
    from concurrent.futures import ThreadPoolExecutor

    def endless():
        return spark.range(10**15).selectExpr("sum(id % 7)").collect()

    with ThreadPoolExecutor(2) as pool:
        began = time.monotonic()
        late = pool.submit(lambda: deadline.within(spark, 2, endless))
        good = pool.submit(lambda: deadline.within(spark, 60, lambda: spark.range(1000).selectExpr("sum(id)").first()[0]))
        assert good.result() == 499500
        with pytest.raises(TimeoutError):
            late.result()
        assert time.monotonic() - began < 30
    with pytest.raises(ZeroDivisionError):
        deadline.within(spark, 60, lambda: 1 // 0)
    assert spark.range(5).count() == 5


def configs(*specs):
    return [Row(config_id=i, model_type=kind, model_params=json.dumps(params, sort_keys=True), preprocessor=scaler, feature_groups=groups)
            for i, (kind, params, scaler, groups) in enumerate(specs)]


FAMILIES = [("ridge", {"alpha": 1.0}, "standard", "basic_box|trend"), ("lasso", {"alpha": 0.001}, "robust", "basic_box"),
            ("lgb", {"n_estimators": 20, "learning_rate": 0.1, "max_depth": 3}, "none", "basic_box|trend"),
            ("xgb", {"n_estimators": 20, "learning_rate": 0.1, "max_depth": 3}, "none", "basic_box"),
            ("gb", {"n_estimators": 20, "learning_rate": 0.1, "max_depth": 3}, "none", "basic_box|trend"),
            ("rf", {"n_estimators": 20, "max_depth": 5}, "minmax", "basic_box|trend"), ("knn", {"n_neighbors": 3}, "standard", "basic_box"),
            ("ensemble", models.ENSEMBLES[2], "standard", "basic_box|trend")]


def test_one_configuration_that_cannot_finish_leaves_the_others(spark, monkeypatch):
    df = panel(spark)
    train, hold = df.where("season_end_year < 2006"), df.where("season_end_year >= 2006")
    real = search._fit_score

    def slow(kind, *a, **k):
        if kind == "knn":
            spark.range(10**15).selectExpr("sum(id % 7)").collect()
        return real(kind, *a, **k)

    monkeypatch.setattr(search, "_fit_score", slow)
    stuck = ("gb", {"n_estimators": 10**7, "learning_rate": 0.1, "max_depth": 3}, "none", "basic_box")
    empty = ("ridge", {"alpha": 1.0}, "none", "four_factors")
    hist, per = search.score_configs(spark, train, hold, configs(*FAMILIES, stuck, empty), limit_seconds=8)
    rows = {r.iteration: r for r in hist.collect()}
    assert {i: r.status for i, r in rows.items()} == {**{i: "ok" for i in range(1, 9)}, 7: "error", 9: "error", 10: "error"}
    assert "TimeoutError" in rows[7].error and "TimeoutError" in rows[9].error and "no feature columns" in rows[10].error
    assert per.count() == 2 * 7
    for r in rows.values():
        if r.status == "ok":
            assert 0 <= r.test_exact <= r.test_within1 <= r.test_within2 <= 1 and r.val_exact is not None


def test_lanes_agree_and_a_search_goes_on_where_it_stopped(spark, monkeypatch, tmpdir_path):
    df = panel(spark)
    train, hold = df.where("season_end_year < 2006"), df.where("season_end_year >= 2006")
    some = configs(*FAMILIES[2:5], FAMILIES[0])
    path = f"{tmpdir_path}/progress"
    hist, _ = search.score_configs(spark, train, hold, some[:2], path=path)
    assert hist.count() == 2
    hist, per = search.score_configs(spark, train, hold, some, path=path)
    one = {r.iteration: r for r in hist.collect()}
    assert sorted(one) == [1, 2, 3, 4] and per.count() == 8
    monkeypatch.setattr(search, "PANEL_BYTES", 0)          # every configuration as Spark jobs
    many = {r.iteration: r for r in search.score_configs(spark, train, hold, some)[0].collect()}
    assert {i: (r.val_overall, r.test_overall) for i, r in one.items()} == {i: (r.val_overall, r.test_overall) for i, r in many.items()}
    hist, per = search.score_configs(spark, train, hold, [])
    assert hist.count() == per.count() == 0


def test_linear_grid_is_whole(spark):
    grid = search.linear_configs(spark)
    assert len(grid) == 10 * 4 * 62 and {c.model_type for c in grid} == {"ridge", "lasso"}


def test_linear_scores_are_written_in_batches_and_their_tables_deleted(spark, monkeypatch):
    from paneltide import session
    df = panel(spark)
    train, hold = df.where("season_end_year < 2006"), df.where("season_end_year >= 2006")
    some = configs(*[("ridge", {"alpha": a}, "standard", "basic_box|trend") for a in (0.1, 1.0, 10.0)], ("ridge", {"alpha": 1.0}, "none", "four_factors"))
    whole = {r.iteration: r for r in search.score_configs(spark, train, hold, some)[0].collect()}
    dropped, real = [], session.drop_paths
    monkeypatch.setattr(session, "drop_paths", lambda s, paths: dropped.append(len(paths)) or real(s, paths))
    monkeypatch.setattr(search, "BATCH_SCORES", 1)
    batched = {r.iteration: r for r in search.score_configs(spark, train, hold, some)[0].collect()}
    assert batched == whole and len(dropped) == 4 and min(dropped) >= 1


def test_linear_scores_are_ranked_where_the_rows_are(spark, monkeypatch):
    df = panel(spark).withColumn("pts", F.round("pts", 0)).withColumn("ast", F.lit(1.0))       # equal scores
    train, hold = df.where("season_end_year < 2006"), df.where("season_end_year >= 2006")
    some = configs(*[("ridge", {"alpha": a}, s, "basic_box") for a in (0.1, 10.0) for s in ("standard", "none")], ("lasso", {"alpha": 0.001}, "robust", "basic_box|trend"))
    real, staged = gram.score_all, []
    monkeypatch.setattr(gram, "score_all", lambda *a: staged.append(1) or real(*a))
    one = {r.iteration: r for r in search.score_configs(spark, train, hold, some)[0].collect()}
    assert not staged
    monkeypatch.setattr(search, "GROUP_BYTES", 0)                  # as of groups too large for a task
    assert one == {r.iteration: r for r in search.score_configs(spark, train, hold, some)[0].collect()} and staged


def test_rank_measures_equal_the_ranks_of_spark(spark):
    from paneltide.operators import metrics, rank
    rng = np.random.default_rng(4)
    score = rng.integers(0, 30, 200) / 7.0
    score[:9] = [np.nan, np.inf, -np.inf, np.nan, 0.0, -0.0, -np.inf, np.inf, 1e300]
    true = rng.integers(1, 200, 200)
    df = spark.createDataFrame([(float(s), int(t)) for s, t in zip(score, true)], "score double, true_rank int")
    r = metrics.rank_metrics(rank.rank_many(df, [("score", "p", None)]).withColumn("rank_diff", F.col("p") - F.col("true_rank"))).first()
    assert gram.rank_measures(score, true) == (r.exact, r.within1, r.within2)


def test_forests_of_a_search_are_the_same_as_spark_jobs(spark, monkeypatch):
    df = panel(spark)
    train, hold = df.where("season_end_year < 2006"), df.where("season_end_year >= 2006")
    some = configs(("rf", {"n_estimators": 12, "max_depth": 5}, "minmax", "basic_box|trend"), FAMILIES[7])
    one = {r.iteration: (r.status, r.val_overall, r.test_overall) for r in search.score_configs(spark, train, hold, some)[0].collect()}
    assert {s for s, _, _ in one.values()} == {"ok"}
    monkeypatch.setattr(search, "PANEL_BYTES", 0)
    many, _ = search.score_configs(spark, train, hold, some)
    assert one == {r.iteration: (r.status, r.val_overall, r.test_overall) for r in many.collect()}


def test_the_best_forest_is_refitted_as_it_was_searched(spark):
    from paneltide.ml import boosting
    df = boosting.materialize(panel(spark))
    train, hold = df.where("season_end_year < 2006"), df.where("season_end_year >= 2006")
    hist, _ = search.score_configs(spark, train, hold, configs(FAMILIES[5]))
    model = models.fit_trees(train, hist.first().feature_cols.split(","), *FAMILIES[5][:2])
    wanted = {(r.team, r.season_end_year): round(r.prediction, 9) for r in model.transform(hold).collect()}
    assert wanted == {(r.team, r.season_end_year): round(r.pred_score, 9) for r in search.refit_best(hist, train, hold).collect()}
