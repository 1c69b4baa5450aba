"""Model-fitting queries (rows-only checks: driver tables are synthetic, so
these prove the pipelines run end to end, not predictive skill)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.formulas import per36, shooting_pcts
from ..functions.nulls import numeric_columns, out_round
from ..ml import boosting, evaluate, gradient, models, onehot
from ..ml.feature_groups import TREND_ONLY, columns_for
from ..operators import joins, metrics, panel, splits, windows
from ..session import materialize
from ..sources import driver_tables as dt
from .eval_queries import feature_matrix
from .panel_queries import outcome_trends
from .oracle_sql import PERF_AGE, with_ctes
from .registry import register

# Model configurations of the original scripts.
BASELINE_MODEL = ("linear", {})
FOREST_MODEL = ("rf", {"n_estimators": 100, "max_depth": 10})
BEST_SHIPPED = ("gb", {"n_estimators": 200, "learning_rate": 0.01, "max_depth": 3})
BEST_SHIPPED_GROUPS = ["basic_box", "basic_eff", "four_factors", "full_box", "rolling_box", "trend"]
STAR_MODEL = {"n_estimators": 400, "learning_rate": 0.05, "max_depth": 3}
AWARD_MODEL = {"n_estimators": 400, "learning_rate": 0.05, "max_depth": 5}
AWARD_SHARE = 0.8
POSITION_MODEL = {"n_estimators": 600, "learning_rate": 0.1, "max_depth": 4}
POSITION_SHARE = 0.9
STAR_NUMERIC = ["age", "g", "gs", "mp", "fg", "fga", "fg_pct", "p3", "p3a", "p3_pct", "p2", "p2a", "p2_pct",
                "efg_pct", "ft", "fta", "ft_pct", "orb", "drb", "trb", "ast", "stl", "blk", "tov", "pf", "pts",
                "trp_dbl"]
POSITION_BASE = ["age", "g", "gs", "mp", "fg", "fga", "fg_pct", "p3", "p3a", "p3_pct", "p2", "p2a", "p2_pct",
                 "efg_pct", "ft", "fta", "ft_pct", "orb", "drb", "trb", "ast", "stl", "blk", "tov", "pf", "pts"]

REPORT = ["mae", "rmse", "r2", "pearson", "spearman", "exact", "within1", "within2", "overall"]


def _report(scored):
    r = evaluate.period_report(scored)
    return r.select("season_end_year", "n", *[out_round(c).alias(c) for c in REPORT])


def _baseline_frame(spark, sf_dir, frame="inclusive"):
    t = outcome_trends(spark, sf_dir, frame).where(F.col("prev_win_pct").isNotNull())
    return splits.split_last_n(t, "season_end_year", 2)


@register("ml_linear")
def q_ml_linear(spark, sf_dir):
    """Standings baseline: OLS on the four trend features, standardised on
    train, scored per holdout period."""
    train, hold = _baseline_frame(spark, sf_dir)
    m = models.fit_regression(train, TREND_ONLY, *BASELINE_MODEL)
    return _report(models.predict(m, hold))


def player_team_frame(spark, sf_dir):
    """Player rows rolled up to teams, inner-joined to the team table (right side
    prefixed), with win share and its trend windows over the whole panel."""
    keys = ["season", "season_end_year", "team"]
    players = panel.player_team_panel(dt.perf(spark, sf_dir, with_age=True))
    teams = panel.team_season(dt.perf(spark, sf_dir), dt.outcome(spark, sf_dir)).na.drop(subset=["wins", "losses"])
    j = joins.join_prefixed(players, teams, keys=keys, prefix="t_", keep=("wins", "losses"))
    return windows.trend_features(panel.with_win_pct(j), "team", "season_end_year", "win_pct")


@register("ml_forest")
def q_ml_forest(spark, sf_dir):
    """Player-to-team forest: 100 trees of depth 10 on the trend features of the joined
    player and team panel (full-panel windows), scored on the last two periods."""
    f = materialize(player_team_frame(spark, sf_dir).select("season_end_year", "team", "win_pct", *TREND_ONLY))
    train, hold = splits.split_last_n(f, "season_end_year", 2)
    m = models.fit_regression(train, TREND_ONLY, FOREST_MODEL[0], FOREST_MODEL[1])
    return _report(models.predict(m, hold))


def _trend_model(spark, sf_dir, kind, params, scaler="standard"):
    f = materialize(outcome_trends(spark, sf_dir).where(F.col("prev_win_pct").isNotNull()))
    train, hold = splits.split_last_n(f, "season_end_year", 2)
    return _report(models.predict(models.fit_regression(train, TREND_ONLY, kind, params, scaler=scaler), hold))


@register("ml_ridge")
def q_ml_ridge(spark, sf_dir):
    """Ridge (alpha 1) on the robust-scaled trend features."""
    return _trend_model(spark, sf_dir, "ridge", {"alpha": 1.0}, "robust")


@register("ml_lasso")
def q_ml_lasso(spark, sf_dir):
    """Lasso (alpha 0.001) on the min-max-scaled trend features."""
    return _trend_model(spark, sf_dir, "lasso", {"alpha": 0.001}, "minmax")


@register("ml_boosted_deep")
def q_ml_boosted_deep(spark, sf_dir):
    """The deeper boosted preset (depth 6, rate 0.3, penalty 1), 50 rounds."""
    return _trend_model(spark, sf_dir, "xgb", {**models.MEMBER_PARAMS["xgb"], "n_estimators": 50}, "none")


@register("ml_boosted_leaves")
def q_ml_boosted_leaves(spark, sf_dir):
    """The leaf-wise boosted preset (31 leaves, 20 rows a leaf), 50 rounds."""
    return _trend_model(spark, sf_dir, "lgb", {**models.MEMBER_PARAMS["lgb"], "n_estimators": 50})


def _gradient_model(spark, sf_dir, kind, params):
    f = materialize(outcome_trends(spark, sf_dir).where(F.col("prev_win_pct").isNotNull()))
    train, hold = splits.split_last_n(f, "season_end_year", 2)
    m = gradient.fit_frame(train, TREND_ONLY, "win_pct", gradient.model_of(kind, params), "standard")
    return _report(models.predict(m, hold))


@register("ml_perceptron")
def q_ml_perceptron(spark, sf_dir):
    """One hidden layer of 50 units on the trend features, gradients summed over all rows."""
    return _gradient_model(spark, sf_dir, "nn", {"hidden_layer_sizes": [50], "alpha": 0.0001})


@register("ml_svr")
def q_ml_svr(spark, sf_dir):
    """Support vector regression with a radial kernel (random Fourier features)."""
    return _gradient_model(spark, sf_dir, "svm", {"C": 1.0, "kernel": "rbf"})


@register("ml_gbt")
def q_ml_gbt(spark, sf_dir):
    """Boosted trees on box + trend groups, windows computed inside each split."""
    f = materialize(feature_matrix(spark, sf_dir, split_col="is_holdout"))
    cols = columns_for(["basic_box", "trend"], f.columns)
    train, hold = f.where(~F.col("is_holdout")), f.where(F.col("is_holdout"))
    m = models.fit_regression(train, cols, "gb", {"n_estimators": 50, "learning_rate": 0.1, "max_depth": 3})
    return _report(models.predict(m, hold))


@register("ml_ensemble")
def q_ml_ensemble(spark, sf_dir):
    """Weighted voting of forest, boosting and ridge (0.4 / 0.4 / 0.2)."""
    f = materialize(feature_matrix(spark, sf_dir, split_col="is_holdout"))
    cols = columns_for(["four_factors", "trend"], f.columns)
    train, hold = f.where(~F.col("is_holdout")), f.where(F.col("is_holdout"))
    members = models.fit_ensemble(train, cols, models.ENSEMBLES[2])
    return _report(models.predict_ensemble(members, hold))


@register("ml_predictions")
def q_ml_predictions(spark, sf_dir):
    """Refit the shipped best configuration and return the detailed
    prediction table (features, score, ranks) for the holdout periods."""
    f = materialize(feature_matrix(spark, sf_dir, split_col="is_holdout"))
    cols = columns_for(BEST_SHIPPED_GROUPS, f.columns)
    train, hold = f.where(~F.col("is_holdout")), f.where(F.col("is_holdout"))
    m = models.fit_regression(train, cols, BEST_SHIPPED[0], BEST_SHIPPED[1], scaler="standard")
    d = evaluate.detailed_predictions(models.predict(m, hold))
    return d.select("season", "season_end_year", "team", "wins", "losses", "win_pct", *cols,
                    out_round("pred_score").alias("pred_score"), "pred_rank", "true_rank", "rank_diff")


# --- player classifiers ------------------------------------------------------------------


def _players(spark, sf_dir):
    p = dt.perf(spark, sf_dir, with_age=True)
    return p.withColumns(shooting_pcts(zero_fill=False))


def _fit_frame(df):
    """Indexers, scalers and boosting each pass over the training rows:
    materialise the joined, projected rows once instead of re-running the
    scan + join per pass."""
    return materialize(df)


def _test_last_periods(df, n=3):
    return splits.split_last_n(df, "season_end_year", n)


@register("ml_star")
def q_ml_star(spark, sf_dir):
    """Star label (awards contain AS): scaled numerics + one-hot position and
    team (unseen categories -> zeros), 400 boosted trees; test = last 3 periods."""
    p = _players(spark, sf_dir).withColumn("label", L.contains_ci(F.coalesce("awards", F.lit("")), "AS"))
    p = p.where(F.col("g") > 0).na.drop(subset=["label", *STAR_NUMERIC]).withColumn("label", F.col("label").cast("double"))
    p = _fit_frame(p.na.fill("", subset=["pos", "team"]).select("season_end_year", "label", "pos", "team", *STAR_NUMERIC))
    train, test = _test_last_periods(p)
    slots, width = onehot.dictionary(train, "team")
    train, test = (onehot.index(onehot.encode(f, "team", slots, "team_slot"), "team_slot", width) for f in (train, test))
    train = materialize(train)                      # every boosting round reads it
    model = models.classifier_pipeline(train, STAR_NUMERIC, ["pos"], "gbt", STAR_MODEL, slot_cols=["team_slot"]).fit(train)
    scored = model.transform(test).withColumn("pred", F.col("prediction"))
    return evaluate.binary_report(scored).withColumns({c: out_round(c) for c in ("precision", "recall", "f1")})


@register("ml_award")
def q_ml_award(spark, sf_dir):
    """Award label (NBA or MVP in awards), all numeric columns (missing -> 0),
    positive class weighted by neg/pos, probability threshold 0.5."""
    p = _players(spark, sf_dir).withColumn("label", L.contains_any_ci("awards").cast("double"))
    p = p.where(F.coalesce(F.col("g"), F.lit(0.0)) > 0)
    num = numeric_columns(p, exclude={"label", "player"})
    p = _fit_frame(p.na.fill(0.0, subset=num).select("label", *dict.fromkeys(["season_end_year", *num])))
    train, test = _test_last_periods(p)
    pos_rate = train.agg(F.avg("label")).first()[0] or 0.0
    if pos_rate == 0:
        raise RuntimeError("no positive samples in training data")
    w = (1.0 - pos_rate) / pos_rate
    train = train.withColumn("w", F.when(F.col("label") == 1.0, F.lit(w)).otherwise(F.lit(1.0)))
    p = models.tree_params("xgb", AWARD_MODEL, objective="logistic", row_share=AWARD_SHARE, column_share=AWARD_SHARE)
    model = boosting.fit_frame(train, num, "label", p, weight="w")
    scored = model.transform(test, "probability").withColumn("pred", (F.col("probability") >= 0.5).cast("double"))
    return evaluate.binary_report(scored).withColumns({c: out_round(c) for c in ("precision", "recall", "f1")})


@register("ml_position")
def q_ml_position(spark, sf_dir):
    """Three-class position (Guard / Wing / Big) from box and per-36 features,
    minutes floor 500, train <= 1999 < test; boosted trees on one softmax."""
    return _position(spark, sf_dir, L.position_three("pos"))


@register("ml_position_five")
def q_ml_position_five(spark, sf_dir):
    """The same with the five positions; half the rounds."""
    return _position(spark, sf_dir, L.position_five("pos"), POSITION_MODEL["n_estimators"] // 2)


def _position(spark, sf_dir, position, rounds=POSITION_MODEL["n_estimators"]):
    p = _players(spark, sf_dir).withColumn("pos3", position).where(F.col("pos3").isNotNull())
    p = p.where(F.col("mp") >= 500).withColumns(per36())
    feats = POSITION_BASE + [c for c in per36().keys()]
    p = _fit_frame(p.na.fill(0.0, subset=feats).select("season_end_year", "pos3", *feats))
    train, test = splits.split_threshold(p, "season_end_year", 1999)
    classes = sorted(r.pos3 for r in train.select("pos3").distinct().collect())     # 3 or 5 labels
    number = F.array_position(F.array(*map(F.lit, classes)), F.col("pos3")) - 1
    params = models.tree_params("xgb", {**POSITION_MODEL, "n_estimators": rounds}, objective="softmax", classes=len(classes),
                                row_share=POSITION_SHARE, column_share=POSITION_SHARE)
    model = boosting.fit_frame(train.withColumn("label", number), feats, "label", params)
    best = F.array_position("probability", F.array_max("probability")).cast("int")
    scored = model.transform(test, "probability").withColumn("pred", F.element_at(F.array(*map(F.lit, classes)), best))
    rep = metrics.class_report(scored, "pos3", "pred", classes)
    base = metrics.majority_baseline(train, test, "pos3")
    rep = rep.withColumn("majority_accuracy", F.lit(None).cast("double"))
    rep = rep.unionByName(base.select(F.concat(F.lit("majority="), "majority").alias("cls"),
                                      F.lit(None).cast("double").alias("precision"),
                                      F.lit(None).cast("double").alias("recall"),
                                      F.lit(None).cast("double").alias("f1"),
                                      F.col("n_test").cast("long").alias("support"),
                                      F.col("accuracy").alias("majority_accuracy")))
    return rep.withColumns({c: out_round(c) for c in ("precision", "recall", "f1", "majority_accuracy")})


@register("onehot", with_ctes(PERF_AGE) + """, p AS (SELECT player, season_end_year, coalesce(pos, '') AS pos,
  coalesce(team, '') AS team FROM perf_age),
yrs AS (SELECT season_end_year, dense_rank() OVER (ORDER BY season_end_year DESC) AS rk FROM (SELECT DISTINCT season_end_year FROM p)),
train AS (SELECT p.* FROM p JOIN yrs USING (season_end_year) WHERE rk > 3),
test AS (SELECT p.* FROM p JOIN yrs USING (season_end_year) WHERE rk <= 3)
SELECT player, season_end_year, pos, team,
  CAST(pos IN (SELECT pos FROM train) AS INTEGER)::DOUBLE AS pos_encoded,
  CAST(team IN (SELECT team FROM train) AS INTEGER)::DOUBLE AS team_encoded,
  (SELECT CAST(count(DISTINCT pos) AS BIGINT) FROM train) AS pos_width,
  (SELECT CAST(count(DISTINCT team) AS BIGINT) FROM train) AS team_width FROM test""")
def q_onehot(spark, sf_dir):
    """Categorical encoding fitted on train periods, applied to the last three: a category
    seen in training sets one of ``width`` slots, an unseen one none.  The categories are
    a distributed table and met by a join, not a list on the driver."""
    p = _players(spark, sf_dir).select("player", "season_end_year", "pos", "team").na.fill("", subset=["pos", "team"])
    train, test = _test_last_periods(p)
    for c in ("pos", "team"):
        seen = train.select(c).distinct()
        width = seen.agg(F.count(F.lit(1))).scalar()
        test = test.join(seen.withColumn("_seen", F.lit(1.0)), c, "left") \
            .withColumn(f"{c}_encoded", F.coalesce("_seen", F.lit(0.0))).drop("_seen").withColumn(f"{c}_width", width)
    return test.select("player", "season_end_year", "pos", "team", "pos_encoded", "team_encoded", "pos_width", "team_width")


@register("onehot_slots", with_ctes(PERF_AGE) + """, p AS (SELECT player, season_end_year, coalesce(team, '') AS team FROM perf_age),
yrs AS (SELECT season_end_year, dense_rank() OVER (ORDER BY season_end_year DESC) AS rk FROM (SELECT DISTINCT season_end_year FROM p)),
slots AS (SELECT team, dense_rank() OVER (ORDER BY team) - 1 AS team_slot
  FROM (SELECT DISTINCT team FROM p JOIN yrs USING (season_end_year) WHERE rk > 3))
SELECT player, season_end_year, team, team_slot, (SELECT CAST(count(*) AS BIGINT) FROM slots) AS width FROM p LEFT JOIN slots USING (team)""")
def q_onehot_slots(spark, sf_dir):
    """The slot of every row's team in the exact one-hot encoding fitted on the train periods."""
    p = _players(spark, sf_dir).select("player", "season_end_year", "team").na.fill("", subset=["team"])
    train, _ = _test_last_periods(p)
    slots, width = onehot.dictionary(train, "team")
    return onehot.encode(p, "team", slots, "team_slot").withColumn("width", F.lit(width).cast("long"))


# --- search -------------------------------------------------------------------------------

#: configurations that the registered search draws (``run_search`` takes any number, 1000 by
#: default; README has the seconds)
SEARCH_ITERATIONS, SEARCH_SEED = 120, 42


def _split_features(spark, sf_dir):
    f = materialize(feature_matrix(spark, sf_dir, split_col="is_holdout"))
    return f.where(~F.col("is_holdout")), f.where(F.col("is_holdout"))


def _with_seasons(hist, per):
    rows = per.groupBy("iteration").agg(F.sort_array(F.collect_list(F.struct(
        "season_end_year", "exact", "within1", "within2", "overall"))).alias("seasons"))
    return hist.join(rows, "iteration", "left").withColumn("seasons", F.to_json("seasons"))


@register("search_history")
def q_search_history(spark, sf_dir):
    """Seeded random search over feature groups x scalers x models on the
    team panel (windows inside each split); one history row per iteration, with its metrics per season."""
    from ..ml.search import run_search
    train, hold = _split_features(spark, sf_dir)
    return _with_seasons(*run_search(spark, train, hold, n_iter=SEARCH_ITERATIONS, seed=SEARCH_SEED))


@register("search_linear")
def q_search_linear(spark, sf_dir):
    """The whole grid of ridge and lasso configurations x scalers x feature groups, solved from
    one Gram matrix for each fit."""
    from ..ml.search import linear_configs, score_configs
    train, hold = _split_features(spark, sf_dir)
    return _with_seasons(*score_configs(spark, train, hold, linear_configs(spark), SEARCH_SEED))


@register("search_refit")
def q_search_refit(spark, sf_dir):
    """The configuration that validates best, refitted on all training periods: its
    detailed predictions for the holdout periods."""
    from ..ml.search import refit_best, run_search
    train, hold = _split_features(spark, sf_dir)
    hist, _ = run_search(spark, train, hold, n_iter=SEARCH_ITERATIONS, seed=SEARCH_SEED)
    d = refit_best(hist, train, hold)
    return d.select("season", "season_end_year", "team", "win_pct", out_round("pred_score").alias("pred_score"),
                    "pred_rank", "true_rank", "rank_diff", "iteration", "model_type")
