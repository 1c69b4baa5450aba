"""k-NN join, file sources and sinks, HTML rows and stream ingest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.nulls import out_round
from ..operators import clean, knn, panel
from ..sources import driver_tables as dt
from ..sources import files, html
from ..session import materialize, scratch_path
from ..sinks import writers
from .oracle_sql import OUTCOME, PERF, TEAM_SEASON, r6, with_ctes
from .panel_queries import TREND_COLS, TREND_INCL
from .registry import register

KNN_K = 5


@register("knn_join", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS DOUBLE) AS y
  FROM embeddings),
d AS (SELECT a.vec_id AS q, b.vec_id AS t, list_distance(a.v, b.v) AS dist, b.y
  FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, t) AS rn FROM d),
top AS (SELECT * FROM r WHERE rn <= 5),
votes AS (SELECT q, y, count(*) AS c FROM top GROUP BY q, y),
vote AS (SELECT q, first(y ORDER BY c DESC, y ASC) AS knn_vote FROM votes GROUP BY q)
SELECT top.q AS vec_id, round(avg(top.y), 6) + 0.0 AS knn_pred, min(top.t) FILTER (WHERE rn = 1) AS nearest_id,
  CAST(count(*) AS BIGINT) AS n_neighbors, any_value(vote.knn_vote) AS knn_vote
FROM top JOIN vote ON top.q = vote.q GROUP BY top.q""")
def q_knn_join(spark, sf_dir):
    """Leave-one-out k-NN over the embeddings: every vector's 5 nearest other
    vectors (Euclidean), mean label, nearest id and majority vote."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    r = knn.knn_regress(e, e, KNN_K, "vec_id", "embedding", "vec_id", "embedding", "label", exclude_self=True)
    return r.select(F.col("q_id").alias("vec_id"), out_round("knn_pred").alias("knn_pred"), "nearest_id",
                    "n_neighbors", "knn_vote")


# --- file sources ---------------------------------------------------------------------------

from pyspark.sql.types import IntegerType, StringType, StructField, StructType  # noqa: E402

OUTCOME_CSV_SCHEMA = StructType([StructField("team", StringType()), StructField("season_end_year", IntegerType()),
                                 StructField("wins", IntegerType()), StructField("losses", IntegerType())])


def _written_outcome_csv(spark, sf_dir) -> str:
    """Write the outcome table as one CSV directory per season (header on)."""
    path = scratch_path(spark, "outcome_csv")
    o = dt.outcome(spark, sf_dir).select("season", "team", "season_end_year", "wins", "losses")
    writers.write_partitioned(o, path, "season", fmt="csv", header=True)
    return path


@register("src_csv_roundtrip", with_ctes(OUTCOME) + "SELECT team, season_end_year, wins, losses, season FROM outcome")
def q_src_csv_roundtrip(spark, sf_dir):
    """CSV with header read back under an explicit schema; the season label
    comes from the file path (provenance), not from the data."""
    path = _written_outcome_csv(spark, sf_dir)
    df = files.read_csv(spark, path, OUTCOME_CSV_SCHEMA, recursive=True)
    return files.require_nonempty(df, path).withColumn("season", files.file_season()).drop("file_path")


#: other spellings of the outcome columns that season files use
OUTCOME_ALIASES = {"Tm": "team", "Team": "team", "W": "wins", "L": "losses"}


@register("src_csv_drift", with_ctes(OUTCOME) + "SELECT team, season_end_year, wins, losses FROM outcome")
def q_src_csv_drift(spark, sf_dir):
    """Season files whose headers drift: half of them spell the columns differently and in
    another order; all are read by name."""
    path = scratch_path(spark, "outcome_drift")
    o = dt.outcome(spark, sf_dir)
    even = F.col("season_end_year") % 2 == 0
    o.where(even).select("team", "season_end_year", "wins", "losses").write.option("header", True).csv(f"{path}/a")
    o.where(~even).select(F.col("losses").alias("L"), F.col("wins").alias("W"), "season_end_year", F.col("team").alias("Tm")) \
        .write.option("header", True).csv(f"{path}/b")
    return files.read_csv(spark, path, OUTCOME_CSV_SCHEMA, recursive=True, aliases=OUTCOME_ALIASES).drop("file_path")


@register("clean_header_rows", with_ctes(OUTCOME) + "SELECT team, season_end_year, wins, losses FROM outcome")
def q_clean_header_rows(spark, sf_dir):
    """Scraped tables repeat their header: every written part file brings its own, all are
    read as data, and the header rows are dropped before the types are set."""
    path = _written_outcome_csv(spark, sf_dir)
    raw = spark.read.schema("team string, season_end_year string, wins string, losses string") \
        .option("recursiveFileLookup", True).option("header", False).csv(path)
    body = clean.drop_repeated_headers(raw, "team")
    return clean.coerce_numeric(body, keep_text=["team"], int_cols=["season_end_year", "wins", "losses"])


@register("src_file_provenance", with_ctes(OUTCOME) + "SELECT team, wins, losses, season FROM outcome")
def q_src_file_provenance(spark, sf_dir):
    """Rows with the season taken from each file's partition directory."""
    path = _written_outcome_csv(spark, sf_dir)
    df = files.read_csv(spark, path, OUTCOME_CSV_SCHEMA, recursive=True)
    return df.select("team", "wins", "losses", files.file_season().alias("season"))


@register("src_glob", with_ctes(OUTCOME) + "SELECT season, count(*) AS n_rows FROM outcome GROUP BY season")
def q_src_glob(spark, sf_dir):
    """Directory glob scan (``*.csv``), error when nothing matches; rows per season."""
    path = _written_outcome_csv(spark, sf_dir)
    df = files.require_nonempty(files.read_csv(spark, path, OUTCOME_CSV_SCHEMA, glob="*.csv", recursive=True), path)
    return df.groupBy(files.file_season().alias("season")).agg(F.count(F.lit(1)).alias("n_rows"))


@register("src_parquet_scan", """SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice
FROM lineitem WHERE l_quantity >= 1""")
def q_src_parquet_scan(spark, sf_dir):
    """Column-pruned Parquet scan with a pushed-down filter (ReadSchema has 5 columns)."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice") \
        .where(F.col("l_quantity") >= 1)


@register("src_period_range", with_ctes(OUTCOME) + """SELECT team, season_end_year, wins, losses FROM outcome
WHERE season_end_year BETWEEN 1996 AND 1999""")
def q_src_period_range(spark, sf_dir):
    """Period-range read of a period-partitioned table: the range is a
    partition filter, so only those directories are listed and read."""
    path = scratch_path(spark, "outcome_by_year")
    o = dt.outcome(spark, sf_dir).select("team", "season_end_year", "wins", "losses")
    writers.write_partitioned(o, path, "season_end_year")
    back = spark.read.parquet(path).where(F.col("season_end_year").between(1996, 1999))
    return back.select("team", F.col("season_end_year").cast("int").alias("season_end_year"), "wins", "losses")


@register("ingest_quarantine", """WITH t AS (SELECT event_id,
  CASE WHEN event_id % 7 = 0 THEN '{broken ' || props ELSE props END AS raw FROM events)
SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CAST(json_extract_string(raw, '$.k') AS INTEGER) END AS k,
  CASE WHEN event_id % 7 = 0 THEN raw END AS _corrupt_record, event_id % 7 = 0 AS quarantined FROM t""")
def q_ingest_quarantine(spark, sf_dir):
    """Typed parse of the event property text, every seventh record broken first; records
    that do not parse are kept aside with their raw text, never dropped silently."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props")
    broken = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{broken "), "props")).otherwise(F.col("props"))
    schema = StructType([StructField("k", IntegerType())])
    p = files.parse_json_quarantine(e.withColumn("props", broken), "props", schema, keys=["event_id"])
    return p.withColumn("quarantined", F.col(files.CORRUPT).isNotNull())


# --- sinks --------------------------------------------------------------------------------


@register("sink_partitioned", with_ctes(PERF, OUTCOME, TEAM_SEASON) + """SELECT season, count(*) AS n_rows,
  """ + r6("sum(pts)", "pts", 2) + " FROM team_season GROUP BY season")
def q_sink_partitioned(spark, sf_dir):
    """Team-season table written one partition per season; one season is
    then rewritten (dynamic overwrite replaces only it); rows per season."""
    path = scratch_path(spark, "team_season")
    t = materialize(panel.team_season(dt.perf(spark, sf_dir), dt.outcome(spark, sf_dir)))
    writers.write_partitioned(t, path, "season")
    last = t.agg(F.max("season")).first()[0]
    writers.write_partitioned(t.where(F.col("season") == last), path, "season")
    back = spark.read.parquet(path)
    return back.groupBy("season").agg(F.count(F.lit(1)).alias("n_rows"), out_round(F.sum("pts"), 2).alias("pts"))


@register("search_best_json", """WITH h AS (
  SELECT event_id AS iteration, event_type AS model_type,
    CASE user_id % 4 WHEN 0 THEN 'basic_box|trend' WHEN 1 THEN 'trend|basic_box' WHEN 2 THEN 'basic_box'
      ELSE 'full_box|basic_box' END AS feature_groups,
    CAST((event_id * 7919) % 61 AS DOUBLE) / 60.0 AS test_exact,
    CAST((event_id * 104729) % 61 AS DOUBLE) / 60.0 AS test_within1 FROM events),
s AS (SELECT *, CAST(0.7 AS DOUBLE) * test_within1 + CAST(0.3 AS DOUBLE) * test_exact AS test_overall FROM h)
SELECT '{"feature_groups":"' || feature_groups || '","iteration":' || iteration || ',"model_type":"' || model_type
  || '","test_exact":' || test_exact || ',"test_overall":' || test_overall || ',"test_within1":' || test_within1 || '}'
  AS best_config
FROM s ORDER BY test_overall DESC, iteration LIMIT 1""")
def q_search_best_json(spark, sf_dir):
    """The best run as one JSON document with alphabetical fields."""
    from ..ml.search import best_config_json, best_run
    return best_config_json(best_run(dt.search_log(spark, sf_dir)))


# --- HTML pages and stream ingest ----------------------------------------------------------------


@register("html_rows")
def q_html_rows(spark, sf_dir):
    """Text blocks and table rows of every stored page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    return html.html_rows(pages)


@register("stream_ingest", with_ctes(OUTCOME) + "SELECT team, season_end_year, season, wins, losses FROM outcome")
def q_stream_ingest(spark, sf_dir):
    """Line-item files streamed with availableNow into a running outcome table."""
    from ..streaming.ingest import ingest_outcomes
    source = f"{sf_dir}/lineitem.parquet"
    target = ingest_outcomes(spark, source, spark.read.parquet(source).schema)
    return spark.read.parquet(target).select("team", F.col("season_end_year").cast("int").alias("season_end_year"),
                                             "season", "wins", "losses")


@register("stream_refresh", with_ctes(OUTCOME, TREND_INCL) + "SELECT team, season_end_year, wins, losses, "
          + ", ".join(r6(c, c) for c in TREND_COLS) + " FROM t")
def q_stream_refresh(spark, sf_dir):
    """Line items arriving in three drops, seasons split over them and early ones late: after
    each the panel and the trends behind the stream are brought up to date."""
    from ..streaming.refresh import refresh_panel
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey", "l_returnflag", "l_shipdate")
    source, path, checkpoint = (scratch_path(spark, n) for n in ("drops", "panel_tables", "drops_ckpt"))
    drop = F.pmod(F.lit(2005) - F.year("l_shipdate") + F.col("l_orderkey"), F.lit(3))
    for k in range(3):
        items.where(drop == k).write.mode("append").parquet(source)
        tables = refresh_panel(spark, source, items.schema, path, checkpoint)
    return tables.read("trend").select("team", "season_end_year", "wins", "losses", *[out_round(c).alias(c) for c in TREND_COLS])
