"""Projection, cleaning, filter, join, curve and label queries."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.nulls import finite_all, ne_safe, out_round, try_number
from ..operators import joins, panel, splits
from ..sources import driver_tables as dt
from .oracle_sql import OUTCOME, PERF, PERF_AGE, TEAM_SEASON, r6, with_ctes
from .registry import register

# --- projections ---------------------------------------------------------------


@register("proj_select", with_ctes(PERF) + "SELECT season, team, player, pts, fga FROM perf")
def q_proj_select(spark, sf_dir):
    """Column subset, then a dropped column."""
    return dt.perf(spark, sf_dir).select("season", "team", "player", "pts", "fga", "fta").drop("fta")


@register("proj_rename", with_ctes(OUTCOME) + """SELECT team AS team_abbr, wins AS w, losses AS l,
  season AS season_label FROM outcome""")
def q_proj_rename(spark, sf_dir):
    """Rename one column, then all columns positionally."""
    o = dt.outcome(spark, sf_dir).select("team", "wins", "losses", "season")
    return o.withColumnRenamed("team", "team_abbr").toDF("team_abbr", "w", "l", "season_label")


@register("proj_reorder", with_ctes(PERF, OUTCOME, TEAM_SEASON) + """SELECT season, season_end_year, team,
  """ + r6("pts", "pts") + ", " + r6("ast", "ast") + ", wins, losses FROM team_season")
def q_proj_reorder(spark, sf_dir):
    """Key columns moved to the front."""
    t = panel.team_season(dt.perf(spark, sf_dir), dt.outcome(spark, sf_dir))
    t = t.select("wins", "losses", "pts", "ast", "team", "season_end_year", "season")
    keys = ["season", "season_end_year", "team"]
    t = t.select(*keys, *[c for c in t.columns if c not in keys])
    return t.withColumns({"pts": out_round("pts"), "ast": out_round("ast")})


_MIXED_FOR_JOIN = """mixed AS (
  SELECT season, season_end_year, team, coalesce(sum(pts), 0.0) AS pts, coalesce(sum(fga), 0.0) AS fga,
    avg(age) AS age
  FROM perf_age WHERE (team IS DISTINCT FROM 'TOT') AND mp >= 200
    AND season IS NOT NULL AND season_end_year IS NOT NULL AND team IS NOT NULL
  GROUP BY season, season_end_year, team)"""


@register("join_prefixed", with_ctes(PERF_AGE, OUTCOME, TEAM_SEASON, _MIXED_FOR_JOIN) + """
SELECT m.season, m.season_end_year, m.team, """ + r6("m.pts", "pts") + ", " + r6("m.fga", "fga") + ", "
          + r6("m.age", "age") + ", " + r6("t.pts", "t_pts") + ", " + r6("t.fga", "t_fga") + ", "
          + r6("t.efg_pct", "t_efg_pct") + """, t.wins, t.losses
FROM mixed m JOIN team_season t ON m.season = t.season AND m.season_end_year = t.season_end_year
  AND m.team = t.team""")
def q_join_prefixed(spark, sf_dir):
    """Player-derived team rows inner-joined to team rows on three keys, right side prefixed t_."""
    players = panel.player_team_panel(dt.perf(spark, sf_dir, with_age=True))
    teams = panel.team_season(dt.perf(spark, sf_dir), dt.outcome(spark, sf_dir))
    j = joins.join_prefixed(players.select("season", "season_end_year", "team", "pts", "fga", "age"),
                            teams.select("season", "season_end_year", "team", "wins", "losses", "pts", "fga",
                                         "efg_pct"),
                            keys=["season", "season_end_year", "team"], prefix="t_", keep=("wins", "losses"))
    r = ["pts", "fga", "age", "t_pts", "t_fga", "t_efg_pct"]
    return j.select("season", "season_end_year", "team", *r, "wins", "losses") \
        .withColumns({c: out_round(c) for c in r})


# --- cleaning ------------------------------------------------------------------------


@register("clean_coerce", """SELECT p_partkey,
  TRY_CAST(trim(split_part(p_brand, '#', 2)) AS INTEGER) AS brand_no,
  TRY_CAST(trim(p_brand) AS DOUBLE) AS brand_as_number,
  TRY_CAST(trim(CAST(p_size AS VARCHAR)) AS DOUBLE) AS size_d,
  TRY_CAST(trim(split_part(p_type, ' ', 1)) AS INTEGER) AS type_head
FROM part""")
def q_clean_coerce(spark, sf_dir):
    """Text to numbers with try_cast: bad values become NULL, never an error."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey",
                    try_number(F.split_part("p_brand", F.lit("#"), F.lit(2)), "int").alias("brand_no"),
                    try_number("p_brand").alias("brand_as_number"),
                    try_number("p_size").alias("size_d"),
                    try_number(F.split_part("p_type", F.lit(" "), F.lit(1)), "int").alias("type_head"))


@register("clean_text", """SELECT s_suppkey, trim(replace(s_name, '#', '')) AS name_clean,
  trim(upper(n_name)) AS nation_upper
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""")
def q_clean_text(spark, sf_dir):
    """Trim, upper-case and strip a literal marker from names."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", "s_nationkey")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    j = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"], "left")   # 25-row dimension
    return j.select("s_suppkey", F.trim(F.replace("s_name", F.lit("#"), F.lit(""))).alias("name_clean"),
                    F.trim(F.upper("n_name")).alias("nation_upper"))


@register("clean_inf", with_ctes(PERF) + """SELECT player, season_end_year, team,
  """ + r6("CASE WHEN fta = 0 THEN NULL ELSE pts / fta END", "pts_per_fta") + """,
  """ + r6("CASE WHEN p3 = 0 THEN NULL ELSE p3a / p3 END", "p3a_per_p3") + """,
  """ + r6("fga", "fga") + " FROM perf")
def q_clean_inf(spark, sf_dir):
    """Ratios whose zero denominators would be +/-inf in pandas are NULL,
    then one pass maps any remaining NaN/inf on every floating column to NULL."""
    p = dt.perf(spark, sf_dir)
    r = p.select("player", "season_end_year", "team",
                 F.try_divide("pts", "fta").alias("pts_per_fta"),
                 F.try_divide("p3a", "p3").alias("p3a_per_p3"), "fga")
    r = finite_all(r)
    return r.withColumns({c: out_round(c) for c in ("pts_per_fta", "p3a_per_p3", "fga")})


@register("clean_fill", with_ctes(PERF) + """SELECT player, season, team, coalesce(awards, '') AS awards,
  coalesce(CASE WHEN fta = 0 THEN NULL ELSE ft / fta END, 0.0) AS ft_pct FROM perf""")
def q_clean_fill(spark, sf_dir):
    """Constant fills for missing text and undefined ratios."""
    p = dt.perf(spark, sf_dir).select("player", "season", "team", "awards",
                                      F.try_divide("ft", "fta").alias("ft_pct"))
    return p.na.fill({"awards": "", "ft_pct": 0.0})


# --- filters ---------------------------------------------------------------------------


@register("filter_not_in", with_ctes(PERF) + """SELECT player, season_end_year, team, pts FROM perf
  WHERE coalesce(team NOT IN ('2TM', '3TM', '4TM', '5TM'), true)""")
def q_filter_not_in(spark, sf_dir):
    """Combined multi-team rows removed; rows with a NULL team are kept."""
    return panel.drop_combined(dt.perf(spark, sf_dir)).select("player", "season_end_year", "team", "pts")


@register("filter_audit", with_ctes(PERF) + """SELECT CAST(count(*) AS BIGINT) AS n_rows,
  CAST(count(*) FILTER (WHERE team = 'TOT') AS BIGINT) AS n_tot,
  CAST(count(*) FILTER (WHERE (team IS DISTINCT FROM 'TOT') AND NOT (mp >= 200)) AS BIGINT) AS n_low_minutes,
  CAST(count(*) FILTER (WHERE NOT (coalesce(g, 0) > 0)) AS BIGINT) AS n_no_games,
  CAST(count(*) FILTER (WHERE (team IS DISTINCT FROM 'TOT') AND mp >= 200) AS BIGINT) AS n_kept
FROM perf""")
def q_filter_audit(spark, sf_dir):
    """Row counts before/after each filter step in one aggregate pass."""
    p = dt.perf(spark, sf_dir)
    keep_team = ne_safe("team", "TOT")
    return p.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count_if(F.col("team") == "TOT").alias("n_tot"),
                 F.count_if(keep_team & ~(F.col("mp") >= 200)).alias("n_low_minutes"),
                 F.count_if(~(F.coalesce(F.col("g"), F.lit(0.0)) > 0)).alias("n_no_games"),
                 F.count_if(keep_team & (F.col("mp") >= 200)).alias("n_kept"))


@register("filter_dropna", with_ctes(PERF, OUTCOME, TEAM_SEASON) + """SELECT season_end_year, team, wins, losses
  FROM team_season WHERE wins IS NOT NULL AND losses IS NOT NULL""")
def q_filter_dropna(spark, sf_dir):
    """Rows without outcome dropped."""
    t = panel.team_season(dt.perf(spark, sf_dir), dt.outcome(spark, sf_dir))
    return t.na.drop(subset=["wins", "losses"]).select("season_end_year", "team", "wins", "losses")


_LAST2 = """yrs AS (SELECT season_end_year, dense_rank() OVER (ORDER BY season_end_year DESC) AS rk
  FROM (SELECT DISTINCT season_end_year FROM outcome))"""


@register("split_last_n", with_ctes(OUTCOME, _LAST2) + """SELECT o.team, o.season_end_year, (y.rk <= 2) AS is_holdout
  FROM outcome o JOIN yrs y USING (season_end_year)""")
def q_split_last_n(spark, sf_dir):
    """Holdout flag for the last two periods (a literal filter on the period)."""
    o = dt.outcome(spark, sf_dir)
    return splits.flag_last_n(o, "season_end_year", 2).select("team", "season_end_year", "is_holdout")


@register("split_threshold", with_ctes(PERF) + """SELECT season_end_year <= 1999 AS is_train, season_end_year,
  CAST(count(*) AS BIGINT) AS n FROM perf GROUP BY 1, 2""")
def q_split_threshold(spark, sf_dir):
    """Row counts of a fixed-year train / test split per period."""
    p = dt.perf(spark, sf_dir)
    return p.groupBy("season_end_year").agg(F.count(F.lit(1)).alias("n")) \
        .select((F.col("season_end_year") <= 1999).alias("is_train"), "season_end_year", "n")


@register("split_recent", with_ctes(OUTCOME, _LAST2) + """, train AS (
  SELECT o.* FROM outcome o JOIN yrs y USING (season_end_year) WHERE y.rk > 2)
SELECT team, season_end_year, season_end_year > (SELECT max(season_end_year) FROM train) - 3 AS is_recent
FROM train""")
def q_split_recent(spark, sf_dir):
    """In-sample validation mask: last three training periods."""
    train, _ = splits.split_last_n(dt.outcome(spark, sf_dir), "season_end_year", 2)
    return splits.recent_mask(train, "season_end_year", 3).select("team", "season_end_year", "is_recent")


@register("set_train_periods", with_ctes(OUTCOME, _LAST2) + """SELECT DISTINCT season_end_year FROM outcome
  EXCEPT SELECT season_end_year FROM yrs WHERE rk <= 2""")
def q_set_train_periods(spark, sf_dir):
    """Training periods = all periods minus the holdout periods."""
    o = dt.outcome(spark, sf_dir)
    periods = o.select("season_end_year").distinct()
    return periods.where(~splits.in_last_n(o, "season_end_year", 2))


# --- dimension joins ---------------------------------------------------------------------

_DICT = """dict AS (SELECT n_name AS name, upper(substr(n_name, 1, 1)) || right(n_name, 1) AS code FROM nation
  WHERE n_regionkey <> 4),
names AS (SELECT s_suppkey, n_name AS name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey)"""


@register("dim_lookup", with_ctes(_DICT) + """SELECT s_suppkey, names.name, dict.code,
  dict.code IS NOT NULL AS mapped FROM names LEFT JOIN dict ON names.name = dict.name""")
def q_dim_lookup(spark, sf_dir):
    """Name to code through a dictionary (left join, unmatched -> NULL)."""
    names = dt.supplier_names(spark, sf_dir)
    d = dt.name_dictionary(spark, sf_dir)
    out = joins.dim_lookup(names, d, "name", "name", "code")
    return out.select("s_suppkey", "name", "code", F.col("code").isNotNull().alias("mapped"))


@register("dim_unknown", with_ctes(_DICT) + """SELECT DISTINCT names.name FROM names
  WHERE names.name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dict WHERE dict.name = names.name)""")
def q_dim_unknown(spark, sf_dir):
    """Distinct names the dictionary does not know, sorted."""
    return joins.unknown_keys(dt.supplier_names(spark, sf_dir), dt.name_dictionary(spark, sf_dir), "name", "name")


@register("dedup_first", with_ctes(_DICT) + """, looked AS (
  SELECT s_suppkey, dict.code FROM names LEFT JOIN dict ON names.name = dict.name),
ranked AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY s_suppkey) AS rn FROM looked)
SELECT code, s_suppkey FROM ranked WHERE rn = 1""")
def q_dedup_first(spark, sf_dir):
    """First supplier per code in an explicit order (keep-first deduplication)."""
    looked = joins.dim_lookup(dt.supplier_names(spark, sf_dir), dt.name_dictionary(spark, sf_dir),
                              "name", "name", "code").select("s_suppkey", "code")
    return panel.dedup_first(looked, "code", ["s_suppkey"]).select("code", "s_suppkey")


# --- curves (ageing and experience) ----------------------------------------------------

_AGE_BASE = """players AS (SELECT * FROM perf_age WHERE coalesce(team NOT IN ('2TM', '3TM', '4TM', '5TM'), true))"""


def _players(spark, sf_dir):
    return panel.drop_combined(dt.perf(spark, sf_dir, with_age=True))


@register("age_curve_total", with_ctes(PERF_AGE, _AGE_BASE) + """SELECT age, """ + r6("sum(pts)", "pts")
          + " FROM players WHERE age IS NOT NULL AND pts IS NOT NULL GROUP BY age")
def q_age_curve_total(spark, sf_dir):
    """Total points by age."""
    c = panel.curve(_players(spark, sf_dir), "age", "pts", "sum", out="pts")
    return c.withColumn("pts", out_round("pts")).orderBy("age")


@register("age_curve_avg", with_ctes(PERF_AGE, _AGE_BASE) + """SELECT age, """ + r6("avg(pts)", "pts")
          + " FROM players WHERE age IS NOT NULL AND pts IS NOT NULL GROUP BY age")
def q_age_curve_avg(spark, sf_dir):
    """Average points by age."""
    c = panel.curve(_players(spark, sf_dir), "age", "pts", "avg", out="pts")
    return c.withColumn("pts", out_round("pts")).orderBy("age")


@register("age_curve_rate", with_ctes(PERF_AGE, _AGE_BASE) + """SELECT age, """
          + r6("avg(CASE WHEN g = 0 THEN NULL ELSE pts / g END)", "pts_per_game")
          + " FROM players WHERE age IS NOT NULL AND pts IS NOT NULL GROUP BY age")
def q_age_curve_rate(spark, sf_dir):
    """Average points per game by age (mean of row ratios)."""
    c = panel.curve(_players(spark, sf_dir), "age", "pts", "rate", out="pts_per_game", rate_den="g")
    return c.withColumn("pts_per_game", out_round("pts_per_game")).orderBy("age")


@register("experience_curve", with_ctes(PERF, """players AS (SELECT * FROM perf
  WHERE coalesce(team NOT IN ('2TM', '3TM', '4TM', '5TM'), true)),
exp AS (SELECT player, CAST(count(DISTINCT season) AS INTEGER) AS seasons_played FROM players GROUP BY player)""")
          + """SELECT e.seasons_played, """ + r6("sum(p.pts)", "pts", 2) + """,
  """ + r6("avg(p.pts)", "pts_avg") + """, CAST(count(*) AS BIGINT) AS n_rows
FROM players p LEFT JOIN exp e ON p.player = e.player
WHERE e.seasons_played IS NOT NULL AND p.pts IS NOT NULL GROUP BY e.seasons_played""")
def q_experience_curve(spark, sf_dir):
    """Points by seasons of experience in one scan: per player, distinct
    seasons (a two-level partial aggregate) plus point sum and count; then
    per experience bucket.  Equal to joining experience back onto every row
    and aggregating the rows."""
    per_player = panel.experience_totals(panel.drop_combined(dt.perf(spark, sf_dir)))
    # rows with missing points are skipped (dropna), so players with none count nowhere
    per_player = per_player.where(F.col("n_pts") > 0)
    c = per_player.groupBy("seasons_played").agg(F.sum("pts").alias("pts"), F.sum("n_pts").alias("n_rows"))
    return c.select("seasons_played", out_round("pts", 2).alias("pts"),
                    out_round(F.try_divide(F.col("pts"), F.col("n_rows"))).alias("pts_avg"),
                    F.col("n_rows").cast("long").alias("n_rows")).orderBy("seasons_played")


@register("experience_curve_rate", with_ctes(PERF, """players AS (SELECT * FROM perf
  WHERE coalesce(team NOT IN ('2TM', '3TM', '4TM', '5TM'), true)),
exp AS (SELECT player, CAST(count(DISTINCT season) AS INTEGER) AS seasons_played FROM players GROUP BY player)""")
          + """SELECT e.seasons_played, """ + r6("avg(p.pts / NULLIF(p.g, 0))", "pts_per_game") + """
FROM players p JOIN exp e ON p.player = e.player WHERE p.pts IS NOT NULL AND e.seasons_played > 0
GROUP BY e.seasons_played""")
def q_experience_curve_rate(spark, sf_dir):
    """Points per game by seasons of experience: per player the distinct seasons and the
    sum and count of its rates, then per experience bucket."""
    rows = panel.drop_combined(dt.perf(spark, sf_dir)).where(F.col("pts").isNotNull())
    rate = F.try_divide("pts", "g")
    seasons = panel.experience_totals(panel.drop_combined(dt.perf(spark, sf_dir))).select("player", "seasons_played")
    rates = rows.groupBy("player").agg(F.sum(rate).alias("rate"), F.count(rate).alias("n"))
    c = rates.join(seasons, "player").where("seasons_played > 0") \
        .groupBy("seasons_played").agg(F.sum("rate").alias("rate"), F.sum("n").alias("n"))
    return c.select("seasons_played", out_round(F.try_divide(F.col("rate"), F.col("n"))).alias("pts_per_game"))


# --- labels ------------------------------------------------------------------------------


@register("label_contains", with_ctes(PERF) + """SELECT player, season, team,
  CAST(coalesce(contains(upper(awards), 'AS'), false) AS INTEGER) AS is_all_star FROM perf""")
def q_label_contains(spark, sf_dir):
    """Star label: awards text contains AS, case-insensitive."""
    p = dt.perf(spark, sf_dir)
    return p.select("player", "season", "team", L.contains_ci("awards", "AS").alias("is_all_star"))


@register("label_any_of", with_ctes(PERF) + """SELECT player, season, team,
  CAST(coalesce(contains(upper(awards), 'NBA') OR contains(upper(awards), 'MVP'), false) AS INTEGER) AS is_award
FROM perf""")
def q_label_any_of(spark, sf_dir):
    """Award label: awards text contains NBA or MVP."""
    p = dt.perf(spark, sf_dir)
    return p.select("player", "season", "team", L.contains_any_ci("awards").alias("is_award"))


_POS = """pos5 AS (SELECT player, season, season_end_year, team, pos, fga,
  CASE WHEN upper(trim(pos)) IN ('PG', 'SG', 'SF', 'PF', 'C') THEN upper(trim(pos))
       WHEN contains(upper(trim(pos)), '-') AND split_part(upper(trim(pos)), '-', 1) IN ('PG', 'SG', 'SF', 'PF', 'C')
       THEN split_part(upper(trim(pos)), '-', 1) END AS pos5 FROM perf),
pos3 AS (SELECT *, CASE pos5 WHEN 'PG' THEN 'Guard' WHEN 'SG' THEN 'Guard' WHEN 'SF' THEN 'Wing'
  WHEN 'PF' THEN 'Big' WHEN 'C' THEN 'Big' END AS pos3 FROM pos5)"""


@register("position_map", with_ctes(PERF, _POS) + "SELECT player, season, team, pos, pos5, pos3 FROM pos3")
def q_position_map(spark, sf_dir):
    """Five-way and three-way position labels from raw position text."""
    p = dt.perf(spark, sf_dir)
    return p.select("player", "season", "team", "pos", L.position_five("pos").alias("pos5"),
                    L.position_three("pos").alias("pos3"))


@register("label_encode", with_ctes(PERF, _POS) + """SELECT player, season, team, pos3,
  CAST(dense_rank() OVER (ORDER BY pos3) - 1 AS DOUBLE) AS pos_idx FROM pos3 WHERE pos3 IS NOT NULL""")
def q_label_encode(spark, sf_dir):
    """Alphabetical label encoding of the three-way position."""
    p = dt.perf(spark, sf_dir).select("player", "season", "team", L.position_three("pos").alias("pos3"))
    p = p.where(F.col("pos3").isNotNull())
    model = StringIndexer(inputCol="pos3", outputCol="pos_idx", stringOrderType="alphabetAsc").fit(p)
    return model.transform(p)


@register("class_distribution", with_ctes(PERF, _POS) + """SELECT pos3, CAST(count(*) AS BIGINT) AS n,
  """ + r6("count(*) / sum(count(*)) OVER ()", "share") + " FROM pos3 WHERE pos3 IS NOT NULL GROUP BY pos3")
def q_class_distribution(spark, sf_dir):
    """Class counts and shares of the three-way position."""
    p = dt.perf(spark, sf_dir).select(L.position_three("pos").alias("pos3")).where(F.col("pos3").isNotNull())
    return panel.class_distribution(p, "pos3").withColumn("share", out_round("share"))


@register("class_weight", with_ctes(PERF) + """, lab AS (SELECT season_end_year, CAST(coalesce(contains(upper(awards), 'NBA')
  OR contains(upper(awards), 'MVP'), false) AS INTEGER) AS y FROM perf WHERE coalesce(g, 0) > 0),
yrs AS (SELECT season_end_year, dense_rank() OVER (ORDER BY season_end_year DESC) AS rk
  FROM (SELECT DISTINCT season_end_year FROM lab)),
train AS (SELECT lab.* FROM lab JOIN yrs USING (season_end_year) WHERE rk > 3)
SELECT """ + r6("avg(CAST(y AS DOUBLE))", "pos_rate") + ", "
          + r6("(1 - avg(CAST(y AS DOUBLE))) / avg(CAST(y AS DOUBLE))", "scale_pos_weight")
          + ", CAST(count(*) AS BIGINT) AS n FROM train")
def q_class_weight(spark, sf_dir):
    """Positive rate of the award label on the training periods (all but the
    last three) and the neg/pos weight given to positives."""
    p = dt.perf(spark, sf_dir).where(F.coalesce(F.col("g"), F.lit(0.0)) > 0) \
        .select("season_end_year", L.contains_any_ci("awards").cast("double").alias("y"))
    # reduce to one row per period first (one scan); the split works on that
    per = p.groupBy("season_end_year").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    train, _ = splits.split_last_n(per, "season_end_year", 3)
    r = train.agg(F.try_divide(F.sum("pos"), F.sum("n")).alias("pos_rate"), F.sum("n").alias("n"))
    return r.select(out_round("pos_rate").alias("pos_rate"),
                    out_round(F.try_divide(F.lit(1.0) - F.col("pos_rate"), F.col("pos_rate"))).alias("scale_pos_weight"),
                    "n")


def classification_frame(spark, sf_dir):
    """Three-class label from position; a rule prediction (Guard when the
    quantity is small, else Big) so metrics have an SQL oracle without ML."""
    p = dt.perf(spark, sf_dir).select("season_end_year", L.position_three("pos").alias("label"), "fga")
    return p.where(F.col("label").isNotNull()) \
        .withColumn("pred", F.when(F.col("fga") < 20, F.lit("Guard")).otherwise(F.lit("Big")))


CLASSES = ["Big", "Guard", "Wing"]
CLS_SQL = """cls AS (SELECT season_end_year, pos3 AS label, CASE WHEN fga < 20 THEN 'Guard' ELSE 'Big' END AS pred
  FROM pos3 WHERE pos3 IS NOT NULL)"""


@register("majority_baseline", with_ctes(PERF, _POS, CLS_SQL) + """, maj AS (
  SELECT label AS majority FROM cls WHERE season_end_year <= 1999 GROUP BY label
  ORDER BY count(*) DESC, label LIMIT 1)
SELECT (SELECT majority FROM maj) AS majority, CAST(count(*) AS BIGINT) AS n_test,
  """ + r6("avg(CAST(label = (SELECT majority FROM maj) AS DOUBLE))", "accuracy") + """
FROM cls WHERE season_end_year > 1999""")
def q_majority_baseline(spark, sf_dir):
    """Accuracy on test periods of always predicting the training majority class."""
    from ..operators.metrics import majority_baseline_split
    c = classification_frame(spark, sf_dir).withColumn("is_train", F.col("season_end_year") <= 1999)
    r = majority_baseline_split(c, "label", "is_train")
    return r.withColumn("accuracy", out_round("accuracy"))


# --- search log (history analysis) -----------------------------------------------------

_LOG = """log AS (SELECT event_id AS iteration,
  CASE user_id % 4 WHEN 0 THEN 'basic_box|trend' WHEN 1 THEN 'trend|basic_box' WHEN 2 THEN 'basic_box'
    WHEN 3 THEN 'full_box|basic_box' END
    AS feature_groups,
  event_type AS model_type,
  CAST((event_id * 7919) % 61 AS DOUBLE) / 60.0 AS test_exact,
  CAST((event_id * 104729) % 61 AS DOUBLE) / 60.0 AS test_within1
  FROM events),
hist AS (SELECT *, 0.7 * test_within1 + 0.3 * test_exact AS test_overall FROM log)"""


@register("search_filtered", with_ctes(_LOG) + """SELECT iteration, feature_groups, model_type, """
          + r6("test_exact", "test_exact") + ", " + r6("test_within1", "test_within1")
          + " FROM hist WHERE test_exact > 0.4")
def q_search_filtered(spark, sf_dir):
    """History runs with exact-rank accuracy above 0.4, overall score dropped."""
    from ..ml.search import filter_history
    h = filter_history(dt.search_log(spark, sf_dir))
    return h.withColumns({c: out_round(c) for c in ("test_exact", "test_within1")})


@register("search_top10", with_ctes(_LOG) + """SELECT iteration, feature_groups, model_type, """
          + r6("test_overall", "test_overall") + " FROM hist ORDER BY test_overall DESC, iteration LIMIT 10")
def q_search_top10(spark, sf_dir):
    """Ten best runs by overall score, earlier iteration first on ties."""
    from ..ml.search import top_k
    t = top_k(dt.search_log(spark, sf_dir), 10)
    return t.select("iteration", "feature_groups", "model_type", out_round("test_overall").alias("test_overall"))


@register("search_best", with_ctes(_LOG) + "SELECT iteration, " + r6("test_overall", "test_overall")
          + " FROM hist ORDER BY test_overall DESC, iteration LIMIT 1")
def q_search_best(spark, sf_dir):
    """The first run reaching the best overall score."""
    from ..ml.search import best_run
    b = best_run(dt.search_log(spark, sf_dir))
    return b.select("iteration", out_round("test_overall").alias("test_overall"))


@register("search_summary", with_ctes(_LOG) + """, canon AS (SELECT *,
  array_to_string(list_sort(list_distinct(string_split(feature_groups, '|'))), '|') AS group_set FROM hist)
SELECT group_set, model_type, CAST(count(*) AS BIGINT) AS n_runs, """ + r6("avg(test_exact)", "avg_exact") + ", "
          + r6("avg(test_within1)", "avg_within1") + ", " + r6("max(test_overall)", "best_overall") + """
FROM canon GROUP BY GROUPING SETS ((group_set), (model_type))""")
def q_search_summary(spark, sf_dir):
    """Runs, mean exact / within-1 and best overall by canonical group set and by model type."""
    from ..ml.search import summarize_history
    s = summarize_history(dt.search_log(spark, sf_dir))
    return s.withColumns({c: out_round(c) for c in ("avg_exact", "avg_within1", "best_overall")})


def _group_values() -> str:
    from ..ml.feature_groups import FEATURE_GROUPS
    rows = ", ".join("('%s', [%s])" % (k, ", ".join("'%s'" % c for c in v)) for k, v in FEATURE_GROUPS.items())
    return f"grp(name, cols) AS (VALUES {rows})"


@register("feature_union", with_ctes(_LOG, _group_values()) + """, runs AS (
  SELECT iteration, unnest(string_split(feature_groups, '|')) AS g FROM hist),
cols AS (SELECT iteration, unnest(cols) AS c FROM runs JOIN grp ON runs.g = grp.name)
SELECT iteration, CAST(count(DISTINCT c) AS INTEGER) AS n_features,
  array_to_string(list_sort(list_distinct(list(c))), ',') AS feature_cols
FROM cols GROUP BY iteration""")
def q_feature_union(spark, sf_dir):
    """Sorted distinct union of the feature groups' columns per run."""
    from ..ml.feature_groups import feature_union
    h = dt.search_log(spark, sf_dir)
    u = h.select("iteration", feature_union(F.col("feature_groups")).alias("_cols"))
    return u.select("iteration", F.size("_cols").alias("n_features"), F.array_join("_cols", ",").alias("feature_cols"))


@register("distinct_players")
def q_distinct_players(spark, sf_dir):
    """Distinct players per season and up to it, from one stored sketch per season (about
    1.6 % standard error)."""
    from ..operators import sketches
    from ..session import materialize
    stored = materialize(sketches.period_sketches(dt.perf(spark, sf_dir).select("season_end_year", "player"), "season_end_year", "player"))
    return sketches.distinct_so_far(stored, "season_end_year")
