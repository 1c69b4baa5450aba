"""Incremental maintenance of the team panel and its trends behind a stream of fact files.

Every micro-batch is reduced to its deltas, wins and losses per (team, period), by one partial
aggregate.  Deltas are added to the touched periods of the stored panel, and the trends of the
teams that changed are computed anew from the first period that changed, so a season that
arrives late corrects the seasons after it.  Panel, trends and the number of the batch are
published in one version (``sinks.versioned``): a batch that failed half-way is not visible, and a
batch that is replayed after it was published changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.formulas import win_pct
from ..operators import windows
from ..session import materialize, scratch_path
from ..sinks.versioned import VersionedTables
from ..sources.driver_tables import outcome_of
from .ingest import _pattern

PERIOD = "season_end_year"


def refresh_batch(path: str, stream: str = "panel", deltas: Callable[[DataFrame], DataFrame] = outcome_of):
    """foreachBatch function: add the batch's deltas to the tables ``panel`` and ``trend``."""
    def run(batch: DataFrame, batch_id: int) -> None:
        tables = VersionedTables(batch.sparkSession, path)
        now = tables.current()
        if now.marks.get(stream, -1) >= batch_id:
            return
        delta = materialize(deltas(batch))
        touched = [r[0] for r in delta.select(PERIOD).distinct().collect()]        # periods: few
        if not touched:
            return
        panel, trend = tables.read("panel", now), tables.read("trend", now)
        in_touched = F.col(PERIOD).isin(*touched)
        merged = delta
        if panel is not None:
            merged = panel.where(in_touched).unionByName(delta).groupBy("team", PERIOD, "season").agg(
                F.sum("wins").cast("int").alias("wins"), F.sum("losses").cast("int").alias("losses"))
        merged = materialize(merged)
        whole = merged if panel is None else panel.where(~in_touched).unionByName(merged)
        since = delta.groupBy("team").agg(F.min(PERIOD).alias("_since"))
        series = whole.join(since, "team").withColumn("win_pct", win_pct())
        fresh = windows.trend_features(series, "team", PERIOD, "win_pct").where(F.col(PERIOD) >= F.col("_since")).drop("_since")
        fresh = materialize(fresh)
        if trend is not None:
            periods = [r[0] for r in fresh.select(PERIOD).distinct().collect()]
            kept = trend.where(F.col(PERIOD).isin(*periods)).join(fresh.select("team", PERIOD), ["team", PERIOD], "left_anti")
            fresh = kept.unionByName(fresh)
        tables.publish({"panel": merged, "trend": fresh}, PERIOD, {stream: batch_id})
    return run


def refresh_panel(spark: SparkSession, source: str, schema: StructType, path: str | None = None,
                  checkpoint: str | None = None, max_files: int = 1000) -> VersionedTables:
    """Bring the panel and trends below ``path`` up to date with the fact files of ``source``
    and stop; with the same checkpoint only files that are new are read."""
    path = path or scratch_path(spark, "panel_tables")
    checkpoint = checkpoint or scratch_path(spark, "panel_stream_ckpt")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(_pattern(source))
    q = src.writeStream.option("checkpointLocation", checkpoint).foreachBatch(refresh_batch(path)).trigger(availableNow=True).start()
    q.awaitTermination()
    return VersionedTables(spark, path)
