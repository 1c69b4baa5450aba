"""Feature builder, evaluation metrics and train-fitted preprocessing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.formulas import efficiency, four_factors, per36, win_pct
from ..functions.nulls import finite_all, out_round
from ..operators import metrics, panel, scaling, splits, windows
from ..sources import driver_tables as dt
from .oracle_sql import OUTCOME, PERF, TEAM_SEASON, r6, with_ctes
from .panel_queries import TREND_INCL, outcome_trends
from .registry import register

# --- evaluation over a deterministic predictor ----------------------------------------
# truth = win share, prediction = previous win share (rows that have one)


def eval_frame(spark, sf_dir):
    t = outcome_trends(spark, sf_dir, "inclusive")
    return t.where(F.col("prev_win_pct").isNotNull())


_EVAL = """e AS (SELECT * FROM t WHERE prev_win_pct IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY season_end_year ORDER BY win_pct DESC) AS true_rank,
  rank() OVER (PARTITION BY season_end_year ORDER BY prev_win_pct DESC) AS pred_rank FROM e),
m AS (SELECT season_end_year,
  avg(CAST(abs(pred_rank - true_rank) = 0 AS DOUBLE)) AS exact,
  avg(CAST(abs(pred_rank - true_rank) <= 1 AS DOUBLE)) AS within1,
  avg(CAST(abs(pred_rank - true_rank) <= 2 AS DOUBLE)) AS within2,
  CAST(count(*) FILTER (WHERE abs(pred_rank - true_rank) <= 1) AS INTEGER) AS hits_within1,
  CAST(count(*) AS INTEGER) AS n
  FROM r GROUP BY season_end_year)"""

RANK_COLS = ["exact", "within1", "within2", "overall"]


@register("rank_metrics", with_ctes(OUTCOME, TREND_INCL, _EVAL) + "SELECT season_end_year, "
          + ", ".join(r6(c, c) for c in ["exact", "within1", "within2"]) + ", "
          + r6("0.7 * within1 + 0.3 * exact", "overall") + ", hits_within1, n FROM m")
def q_rank_metrics(spark, sf_dir):
    """Per-period exact / within-1 / within-2 rank accuracy and weighted overall score."""
    ranked = metrics.with_ranks(eval_frame(spark, sf_dir), "win_pct", "prev_win_pct", by="season_end_year")
    m = metrics.rank_metrics(ranked, by="season_end_year")
    return m.withColumns({c: out_round(c) for c in RANK_COLS})


@register("rank_metrics_avg", with_ctes(OUTCOME, TREND_INCL, _EVAL) + "SELECT "
          + ", ".join(r6(f"avg({c})", c) for c in ["exact", "within1", "within2"]) + ", "
          + r6("avg(0.7 * within1 + 0.3 * exact)", "overall")
          + ", CAST(count(*) AS BIGINT) AS n_periods FROM m")
def q_rank_metrics_avg(spark, sf_dir):
    """Mean of the per-period rank metrics."""
    ranked = metrics.with_ranks(eval_frame(spark, sf_dir), "win_pct", "prev_win_pct", by="season_end_year")
    m = metrics.rank_metrics(ranked, by="season_end_year")
    return m.agg(*[out_round(F.avg(c)).alias(c) for c in RANK_COLS], F.count(F.lit(1)).alias("n_periods"))


_POOLED = """yrs AS (SELECT season_end_year, dense_rank() OVER (ORDER BY season_end_year DESC) AS rk
  FROM (SELECT DISTINCT season_end_year FROM t)),
tr AS (SELECT t.* FROM t JOIN yrs USING (season_end_year) WHERE rk > 2 AND prev_win_pct IS NOT NULL),
rec AS (SELECT * FROM tr WHERE season_end_year > (SELECT max(season_end_year) FROM tr) - 3)"""


@register("rank_pooled", with_ctes(OUTCOME, TREND_INCL, _POOLED) + """SELECT team, season_end_year,
  CAST(rank() OVER (ORDER BY win_pct DESC) AS INTEGER) AS true_rank,
  CAST(rank() OVER (ORDER BY prev_win_pct DESC) AS INTEGER) AS pred_rank FROM rec""")
def q_rank_pooled(spark, sf_dir):
    """In-sample validation ranks over the last three training periods pooled
    together (no partition): the distributed rank keeps this off one task."""
    train, _ = splits.split_last_n(eval_frame(spark, sf_dir), "season_end_year", 2)
    rec = splits.recent_mask(train, "season_end_year", 3).where("is_recent")
    r = metrics.with_ranks(rec, "win_pct", "prev_win_pct", by=())
    return r.select("team", "season_end_year", "true_rank", "pred_rank")


REG_COLS = ["mae", "rmse", "r2", "pearson"]


@register("reg_metrics", with_ctes(OUTCOME, TREND_INCL) + """, e AS (SELECT * FROM t WHERE prev_win_pct IS NOT NULL)
SELECT season_end_year, """ + r6("avg(abs(win_pct - prev_win_pct))", "mae") + ", "
          + r6("sqrt(avg((win_pct - prev_win_pct) * (win_pct - prev_win_pct)))", "rmse") + ", "
          + r6("1 - sum((win_pct - prev_win_pct) * (win_pct - prev_win_pct)) / (var_pop(win_pct) * count(win_pct))", "r2")
          + ", " + r6("corr(win_pct, prev_win_pct)", "pearson") + """, CAST(count(*) AS INTEGER) AS n
FROM e GROUP BY season_end_year""")
def q_reg_metrics(spark, sf_dir):
    """Per-period MAE, RMSE, R2 (1 - SSE/SST) and Pearson correlation."""
    m = metrics.reg_metrics(eval_frame(spark, sf_dir), "win_pct", "prev_win_pct", by="season_end_year")
    return m.withColumns({c: out_round(c) for c in REG_COLS})


@register("spearman", with_ctes(OUTCOME, TREND_INCL) + """, e AS (SELECT * FROM t WHERE prev_win_pct IS NOT NULL),
a AS (SELECT season_end_year,
  rank() OVER (PARTITION BY season_end_year ORDER BY win_pct DESC)
    + (count(*) OVER (PARTITION BY season_end_year, win_pct) - 1) / 2.0 AS ta,
  rank() OVER (PARTITION BY season_end_year ORDER BY prev_win_pct DESC)
    + (count(*) OVER (PARTITION BY season_end_year, prev_win_pct) - 1) / 2.0 AS pa FROM e)
SELECT season_end_year, """ + r6("corr(ta, pa)", "spearman") + ", CAST(count(*) AS INTEGER) AS n FROM a GROUP BY season_end_year")
def q_spearman(spark, sf_dir):
    """Per-period Spearman correlation from average ranks."""
    s = metrics.spearman(eval_frame(spark, sf_dir), "win_pct", "prev_win_pct", by="season_end_year")
    return s.withColumn("spearman", out_round("spearman"))


# --- classification report over a rule prediction -------------------------------------

from .relational_queries import _POS, CLASSES, CLS_SQL, classification_frame  # noqa: E402


def _cls_oracle():
    vals = ", ".join(f"('{c}')" for c in CLASSES)
    return with_ctes(PERF, _POS, CLS_SQL) + f""", k(cls) AS (VALUES {vals}),
per AS (SELECT k.cls,
  coalesce(count(*) FILTER (WHERE label = k.cls AND pred = k.cls) / NULLIF(count(*) FILTER (WHERE pred = k.cls), 0), 0.0)
    AS precision,
  coalesce(count(*) FILTER (WHERE label = k.cls AND pred = k.cls) / NULLIF(count(*) FILTER (WHERE label = k.cls), 0), 0.0)
    AS recall,
  CAST(count(*) FILTER (WHERE label = k.cls) AS BIGINT) AS support
  FROM cls, k GROUP BY k.cls),
per2 AS (SELECT *, coalesce(2 * precision * recall / NULLIF(precision + recall, 0), 0.0) AS f1 FROM per),
allr AS (
  SELECT cls, precision, recall, f1, support FROM per2
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM per2
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per2
  UNION ALL SELECT 'accuracy', avg(CAST(label = pred AS DOUBLE)), avg(CAST(label = pred AS DOUBLE)),
    avg(CAST(label = pred AS DOUBLE)), CAST(count(*) AS BIGINT) FROM cls)
SELECT cls, """ + ", ".join(r6(c, c) for c in ("precision", "recall", "f1")) + ", support FROM allr"


@register("class_report", _cls_oracle())
def q_class_report(spark, sf_dir):
    """Per-class precision / recall / F1 / support, macro and weighted averages, accuracy."""
    r = metrics.class_report(classification_frame(spark, sf_dir), "label", "pred", CLASSES)
    return r.withColumns({c: out_round(c) for c in ("precision", "recall", "f1")})


@register("confusion", with_ctes(PERF, _POS, CLS_SQL) + "SELECT label, " + ", ".join(
    f"CAST(count(*) FILTER (WHERE pred = '{c}') AS BIGINT) AS pred_{c}" for c in CLASSES)
          + " FROM cls GROUP BY label")
def q_confusion(spark, sf_dir):
    """Confusion matrix with zero cells."""
    return metrics.confusion(classification_frame(spark, sf_dir), "label", "pred", CLASSES)


# --- derived metric formulas --------------------------------------------------------------

EFF = ["ts_pct", "efg_pct_f", "ast_to_ratio"]
FF = ["efg_factor", "tov_factor", "oreb_factor", "ftr_factor"]
_EFF_SQL = """pts / (2 * (fga + 0.44 * fta + 1e-8)) AS ts_pct,
  (fg + 0.5 * p3) / (fga + 1e-8) AS efg_pct_f, ast / (tov + 1e-8) AS ast_to_ratio"""
_FF_SQL = """(fg + 0.5 * p3) / (fga + 1e-8) AS efg_factor,
  1 - tov / (fga + 0.44 * fta + tov + 1e-8) AS tov_factor,
  orb / (orb + drb + 1e-8) AS oreb_factor, fta / (fga + 1e-8) AS ftr_factor"""


@register("efficiency", with_ctes(PERF, OUTCOME, TEAM_SEASON) + """, x AS (SELECT season_end_year, team, """
          + _EFF_SQL + " FROM team_season) SELECT season_end_year, team, " + ", ".join(r6(c, c) for c in EFF) + " FROM x")
def q_efficiency(spark, sf_dir):
    """True shooting, effective FG and assist/turnover per team-season."""
    t = panel.team_totals(dt.perf(spark, sf_dir)).withColumns(efficiency())
    return t.select("season_end_year", "team", *[out_round(c).alias(c) for c in EFF])


@register("four_factors", with_ctes(PERF, OUTCOME, TEAM_SEASON) + """, x AS (SELECT season_end_year, team, """
          + _FF_SQL + " FROM team_season) SELECT season_end_year, team, " + ", ".join(r6(c, c) for c in FF) + " FROM x")
def q_four_factors(spark, sf_dir):
    """The four factors per team-season."""
    t = panel.team_totals(dt.perf(spark, sf_dir)).withColumns(four_factors())
    return t.select("season_end_year", "team", *[out_round(c).alias(c) for c in FF])


P36 = ["pts_per36", "ast_per36", "trb_per36", "stl_per36", "blk_per36", "tov_per36", "fga_per36", "fta_per36",
       "p3a_per36", "three_point_rate", "free_throw_rate", "ast_tov_ratio", "usage_proxy"]


def _per36_sql():
    ms = ["pts", "ast", "trb", "stl", "blk", "tov", "fga", "fta", "p3a"]
    parts = [f"{m} / (NULLIF(mp, 0) + 1e-6) * 36.0 AS {m}_per36" for m in ms]
    parts += ["p3a / (fga + 1e-6) AS three_point_rate", "fta / (fga + 1e-6) AS free_throw_rate",
              "ast / (tov + 1e-6) AS ast_tov_ratio", "(fga + 0.44 * fta) / (NULLIF(mp, 0) + 1e-6) AS usage_proxy"]
    return with_ctes(PERF) + ", x AS (SELECT player, season_end_year, team, " + ", ".join(parts) \
        + " FROM perf) SELECT player, season_end_year, team, " + ", ".join(r6(c, c) for c in P36) + " FROM x"


@register("per36", _per36_sql())
def q_per36(spark, sf_dir):
    """Per-36-minute rates, shot mix and usage per player row."""
    p = dt.perf(spark, sf_dir).withColumns(per36())
    return p.select("player", "season_end_year", "team", *[out_round(c).alias(c) for c in P36])


# --- the whole-table feature builder -----------------------------------------------------

FM_COLS = ["win_pct", "prev_win_pct", *EFF, *FF, "pts_3y", "ast_3y", "trb_3y", "stl_3y", "blk_3y",
           "win_pct_3y", "win_pct_5y", "win_pct_trend"]


def feature_matrix(spark, sf_dir, frame: str = "inclusive", split_col: str | None = None, holdout_n: int = 2):
    """Team-season panel -> drop rows without outcome -> win share, efficiency,
    four factors, rolling box means and win-share trend, NaN/inf -> NULL.
    All windows share one (entity, period) spec: one exchange."""
    t = panel.team_season(dt.perf(spark, sf_dir), dt.outcome(spark, sf_dir)).na.drop(subset=["wins", "losses"])
    t = t.withColumn("win_pct", win_pct())
    if split_col:
        t = splits.flag_last_n(t, "season_end_year", holdout_n, out=split_col)
    t = t.withColumns({**efficiency(), **four_factors()})
    t = windows.rolling_box(t, frame=frame, split_col=split_col)
    t = windows.trend_features(t, "team", "season_end_year", "win_pct", frame=frame, split_col=split_col)
    return finite_all(t)


def _fm_sql():
    w = "OVER (PARTITION BY team ORDER BY season_end_year {})"
    r3 = w.format("ROWS BETWEEN 2 PRECEDING AND CURRENT ROW")
    box = ", ".join(f"avg({m}) {r3} AS {m}_3y" for m in ("pts", "ast", "trb", "stl", "blk"))
    return with_ctes(PERF, OUTCOME, TEAM_SEASON) + f""", b AS (
  SELECT *, CAST(wins AS DOUBLE) / NULLIF(wins + losses, 0) AS win_pct, {_EFF_SQL}, {_FF_SQL}
  FROM team_season WHERE wins IS NOT NULL AND losses IS NOT NULL),
c AS (SELECT *, {box},
  lag(win_pct) {w.format('')} AS prev_win_pct,
  avg(win_pct) {r3} AS win_pct_3y,
  avg(win_pct) {w.format('ROWS BETWEEN 4 PRECEDING AND CURRENT ROW')} AS win_pct_5y FROM b),
d AS (SELECT *, win_pct_3y - lag(win_pct_3y) {w.format('')} AS win_pct_trend FROM c)
SELECT season_end_year, team, """ + ", ".join(r6(c, c) for c in FM_COLS) + " FROM d"


@register("feature_matrix", _fm_sql())
def q_feature_matrix(spark, sf_dir):
    """The whole-table team feature builder (efficiency, four factors, rolling box, trend)."""
    f = feature_matrix(spark, sf_dir)
    return f.select("season_end_year", "team", *[out_round(c).alias(c) for c in FM_COLS])


# --- train-fitted imputation and scaling -----------------------------------------------------

FEATS = ["prev_win_pct", "win_pct_3y", "win_pct_5y", "win_pct_trend"]


def _split_trends(spark, sf_dir):
    t = splits.flag_last_n(outcome_trends(spark, sf_dir, "inclusive"), "season_end_year", 2)
    return t, t.where(~F.col("is_holdout"))


_SPLIT = """yrs AS (SELECT season_end_year, dense_rank() OVER (ORDER BY season_end_year DESC) AS rk
  FROM (SELECT DISTINCT season_end_year FROM t)),
f AS (SELECT t.*, yrs.rk <= 2 AS is_holdout FROM t JOIN yrs USING (season_end_year)),
mu AS (SELECT """ + ", ".join(f"avg({c}) AS m_{c}" for c in FEATS) + """ FROM f WHERE NOT is_holdout),
imp AS (SELECT team, season_end_year, is_holdout, """ + ", ".join(
    f"coalesce({c}, m_{c}) AS {c}" for c in FEATS) + " FROM f, mu)"


@register("impute_train_mean", with_ctes(OUTCOME, TREND_INCL, _SPLIT) + "SELECT team, season_end_year, is_holdout, "
          + ", ".join(r6(c, c) for c in FEATS) + " FROM imp")
def q_impute_train_mean(spark, sf_dir):
    """Trend features with NULLs filled by training-period means."""
    allf, train = _split_trends(spark, sf_dir)
    out = scaling.apply_fill(allf, scaling.fit_means(train, FEATS))
    return out.select("team", "season_end_year", "is_holdout", *[out_round(c).alias(c) for c in FEATS])


def _scaled_sql(center: str, scale: str, agg_kind: str) -> str:
    if agg_kind == "quantile":
        stats = ", ".join(f"quantile_cont({c}, 0.5) AS c_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS s_{c}"
                          for c in FEATS)
    else:
        stats = ", ".join(f"{center.format(c=c)} AS c_{c}, {scale.format(c=c)} AS s_{c}" for c in FEATS)
    return with_ctes(OUTCOME, TREND_INCL, _SPLIT) + f""", st AS (SELECT {stats} FROM imp WHERE NOT is_holdout)
SELECT team, season_end_year, is_holdout, """ + ", ".join(
        r6(f"({c} - c_{c}) / CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 1.0 ELSE s_{c} END", c) for c in FEATS) \
        + " FROM imp, st"


def _scaled(spark, sf_dir, kind):
    allf, train = _split_trends(spark, sf_dir)
    (out,), _, _ = scaling.impute_and_scale(train, [allf], FEATS, kind)
    return out.select("team", "season_end_year", "is_holdout", *[out_round(c).alias(c) for c in FEATS])


@register("scale_standard", _scaled_sql("avg({c})", "stddev_pop({c})", "moments"))
def q_scale_standard(spark, sf_dir):
    """Mean imputation then standard scaling fitted on training periods (population std)."""
    return _scaled(spark, sf_dir, "standard")


@register("scale_robust", _scaled_sql("", "", "quantile"))
def q_scale_robust(spark, sf_dir):
    """Mean imputation then median / IQR scaling fitted on training periods."""
    return _scaled(spark, sf_dir, "robust")


@register("scale_minmax", _scaled_sql("min({c})", "max({c}) - min({c})", "moments"))
def q_scale_minmax(spark, sf_dir):
    """Mean imputation then min-max scaling fitted on training periods (constant -> 0)."""
    return _scaled(spark, sf_dir, "minmax")
