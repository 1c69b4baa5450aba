"""Stand-ins for the panel inputs, derived from the driver tables.

entity = supplier, period = ship year; player rows = line items.  Every
frame is a lazy projection/aggregate of the whole table, so its work grows
with the data.  The mapping is documented in FIXTURES.md section 2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formulas import season_label
from .tables import read_table

# Fixed values of the stand-in mapping.
POSITION_BY_LINE = {1: "PG", 2: " sg ", 3: "SF", 4: "PF", 5: "C", 6: "PG-SG", 7: "G-F"}
COMBINED_LINE = 7                 # line 7 plays the multi-team '2TM' row
COMBINED_CODE = "2TM"
AWARD_RULES = ((85000.0, "MVP-2,AS,NBA1"), (75000.0, "AS"))
AWARD_LINE, AWARD_LINE_TEXT = 6, "DPOY-4"
LOSS_FLAG = "R"
MISMATCH_SUPP_DIGIT, MISMATCH_BEFORE = 3, 1998   # outcome code spelled differently
SEARCH_GROUP_SPELLINGS = {0: "basic_box|trend", 1: "trend|basic_box", 2: "basic_box", 3: "full_box|basic_box"}
EXACT_MULT, WITHIN1_MULT, SCORE_MOD = 7919, 104729, 61
UNCOVERED_REGION = 4              # the name dictionary does not cover this region's nations

PERF_MEASURES = ("g", "gs", "mp", "fg", "fga", "p3", "p3a", "p2", "p2a", "ft", "fta",
                 "orb", "drb", "trb", "ast", "stl", "blk", "tov", "pf", "pts", "trp_dbl")


def _case(key: Column, mapping: dict, default=None) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(key == F.lit(k), F.lit(v)) if out is None else out.when(key == F.lit(k), F.lit(v))
    return out if default is None else out.otherwise(F.lit(default))


def supplier_team(suppkey: Column) -> Column:
    return F.concat(F.lit("S"), suppkey.cast("string"))


def perf(spark: SparkSession, sf_dir: str, with_age: bool = False) -> DataFrame:
    """Player-season-team rows.  ``with_age`` adds the part join (only the
    queries that need ``age`` pay for that shuffle join)."""
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                     "l_discount", "l_tax", "l_shipdate"])
    q, d, t, ln = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("l_linenumber")
    price = F.col("l_extendedprice")
    y = F.year("l_shipdate").cast("int")
    awards = F.when(price > AWARD_RULES[0][0], F.lit(AWARD_RULES[0][1])) \
        .when(price > AWARD_RULES[1][0], F.lit(AWARD_RULES[1][1])) \
        .when(ln == AWARD_LINE, F.lit(AWARD_LINE_TEXT))
    fg = q * (F.lit(1.0) - d)
    fta = q * d
    p3a = q * F.lit(0.3)
    p3 = q * t
    orb, drb = ln.cast("double"), q / F.lit(5.0)
    cols = {
        "player": F.col("l_partkey"),
        "team": F.when(ln == COMBINED_LINE, F.lit(COMBINED_CODE)).otherwise(supplier_team(F.col("l_suppkey"))),
        "season_end_year": y,
        "season": season_label(y),
        "pos": _case(ln, POSITION_BY_LINE),
        "awards": awards,
        "g": (ln + 1).cast("double"),
        "gs": ln.cast("double"),
        "mp": q * F.lit(60.0),
        "fg": fg, "fga": q,
        "p3": p3, "p3a": p3a,
        "p2": fg - p3, "p2a": q - p3a,
        "ft": fta * (F.lit(1.0) - t), "fta": fta,
        "orb": orb, "drb": drb, "trb": orb + drb,
        "ast": q * t, "stl": d * F.lit(100.0), "blk": t * F.lit(100.0),
        "tov": ln.cast("double"), "pf": ln.cast("double"),
        "pts": price,
        "trp_dbl": F.when(ln == 1, F.lit(1.0)).otherwise(F.lit(0.0)),
    }
    out = li.select(*[c.alias(n) for n, c in cols.items()], F.col("l_partkey").alias("_pk"))
    if with_age:
        part = read_table(spark, sf_dir, "part", ["p_partkey", "p_size"])
        # part grows with the data: a plain equi-join; AQE picks broadcast only
        # when the runtime size is under the threshold, and splits skewed keys.
        out = out.join(part, out["_pk"] == part["p_partkey"], "inner") \
            .withColumn("age", F.col("p_size").cast("double")).drop("p_partkey", "p_size")
    return out.drop("_pk")


def outcome_of(li: DataFrame) -> DataFrame:
    """Wins/losses per (team, season) of line items, a table or a stream: lines without /
    with the loss flag.  One supplier digit is coded differently before a cut-over
    year, the way a renamed franchise is (its outcome rows then do not match the
    stats)."""
    y = F.year("l_shipdate").cast("int")
    agg = li.groupBy(F.col("l_suppkey"), y.alias("season_end_year")).agg(
        F.count_if(F.col("l_returnflag") != LOSS_FLAG).cast("int").alias("wins"),
        F.count_if(F.col("l_returnflag") == LOSS_FLAG).cast("int").alias("losses"))
    mismatch = ((F.col("l_suppkey") % 10) == MISMATCH_SUPP_DIGIT) & (F.col("season_end_year") < MISMATCH_BEFORE)
    code = F.when(mismatch, F.concat(F.lit("X"), F.col("l_suppkey").cast("string"))) \
        .otherwise(supplier_team(F.col("l_suppkey")))
    return agg.select(code.alias("team"), "season_end_year", season_label("season_end_year").alias("season"),
                      "wins", "losses")


def outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of the whole line-item table."""
    return outcome_of(read_table(spark, sf_dir, "lineitem", ["l_suppkey", "l_returnflag", "l_shipdate"]))


def gappy_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer x order-year totals: series with calendar gaps."""
    o = read_table(spark, sf_dir, "orders", ["o_custkey", "o_totalprice", "o_orderdate"])
    return o.groupBy(F.col("o_custkey").alias("entity"),
                     F.year("o_orderdate").cast("int").alias("period")) \
        .agg(F.sum("o_totalprice").alias("measure"))


def name_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name -> code dictionary; codes are many-to-one (first letter + last
    character of the name), like a dictionary listing several old names of
    one franchise.  It covers four of the five regions, so names from the
    fifth are unknown to it, as newly seen team names are to a hand-kept
    dictionary."""
    n = read_table(spark, sf_dir, "nation", ["n_name", "n_regionkey"])
    return n.where(F.col("n_regionkey") != UNCOVERED_REGION) \
        .select(F.col("n_name").alias("name"),
                F.concat(F.upper(F.substring("n_name", 1, 1)), F.substring("n_name", -1, 1)).alias("code"))


def supplier_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact rows carrying a free-text name to translate (supplier x nation name)."""
    s = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"])
    n = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    # nation is a fixed 25-row dimension: proven size bound, broadcast it.
    return s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"], "left") \
        .select(F.col("s_suppkey"), F.col("n_name").alias("name"))


def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search history derived from the events table (one row per iteration)."""
    e = read_table(spark, sf_dir, "events", ["event_id", "user_id", "event_type"])
    exact = ((F.col("event_id") * EXACT_MULT) % SCORE_MOD).cast("double") / F.lit(60.0)
    within1 = ((F.col("event_id") * WITHIN1_MULT) % SCORE_MOD).cast("double") / F.lit(60.0)
    return e.select(
        F.col("event_id").alias("iteration"),
        _case(F.col("user_id") % 4, SEARCH_GROUP_SPELLINGS).alias("feature_groups"),
        F.col("event_type").alias("model_type"),
        exact.alias("test_exact"),
        within1.alias("test_within1"),
        (F.lit(0.7) * within1 + F.lit(0.3) * exact).alias("test_overall"))
