"""Incremental period ingest with Structured Streaming.

New fact files arrive in a directory; a stateful streaming aggregate keeps
running (team, period) outcome totals in the state store; every micro-batch
upserts only the periods it touched into a period-partitioned table.  The merged
periods are first written to a staging table and then replace their partitions
(dynamic partition overwrite), so a failed batch leaves the table readable and
its replay writes the same values.  ``trigger(availableNow=True)`` processes what
is there and stops, which is the batch-loop-over-arriving-seasons of the original,
made restartable by the checkpoint.  Row-offset trend windows stay in batch:
non-time windows are not supported on streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import drop_paths, path_exists, scratch_path
from ..sources.driver_tables import outcome_of

KEYS = ("team", "season_end_year")


def outcome_upsert(target: str, keys=KEYS, period: str = "season_end_year"):
    """foreachBatch function: merge updated keys into the touched partitions.  Only a
    target that does not exist counts as a first batch; a target that cannot be read
    fails the batch."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stage = scratch_path(spark, f"upsert_{batch_id}")
        if path_exists(spark, target):
            # the periods of one batch are few; as literals they prune partitions
            touched = [r[0] for r in batch.select(period).distinct().collect()]
            current = spark.read.parquet(target).where(F.col(period).isin(*touched))
            batch = current.join(batch.select(*keys), list(keys), "left_anti").unionByName(batch)
        batch.write.parquet(stage)
        spark.read.parquet(stage).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy(period).parquet(target)
        drop_paths(spark, [stage])
    return run


def _pattern(path: str) -> str:
    """A pattern that only ``path`` matches: streams take a pattern for a single file as
    well as for a folder, a plain path for a folder alone."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def ingest_outcomes(spark: SparkSession, source: str, schema: StructType, target: str | None = None,
                    checkpoint: str | None = None, max_files: int = 1000) -> str:
    """Stream fact files -> running wins/losses per (team, period) -> partitioned table.
    ``source`` is a table path: a folder of part files, or one file."""
    target = target or scratch_path(spark, "outcome_table")
    checkpoint = checkpoint or scratch_path(spark, "outcome_stream_ckpt")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(_pattern(source))
    q = outcome_of(src).writeStream.outputMode("update").option("checkpointLocation", checkpoint) \
        .foreachBatch(outcome_upsert(target)).trigger(availableNow=True).start()
    q.awaitTermination()
    return target
