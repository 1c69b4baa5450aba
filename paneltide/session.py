"""Session construction and shared-storage locations.

On a cluster the session is created by the platform; ``configure`` only sets
options that are still at their defaults.  Scratch data (checkpoints, written
intermediate tables, stream checkpoints) always lives under the shared folder
named by ``spark.checkpoint.dir``; on one machine without that setting it is a
folder of the warehouse.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import uuid

from pyspark.sql import SparkSession

# Options every plan in this package relies on.  AQE re-plans joins from
# runtime sizes, coalesces small shuffle partitions and splits skewed ones.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files of materialised stages are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "paneltide", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session: ``spark.checkpoint.dir``; where that is unset
    on a single machine, a folder in the warehouse.  A cluster without the
    setting and with a warehouse on local disks is an error: executors could not see
    each other's files."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if not sc.master.startswith("local[") and sc.master != "local" and warehouse.startswith(("file:", "/")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = f"{warehouse.rstrip('/')}/_scratch"
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


# staged tables of this process that nothing has deleted yet, innermost scope last
_STAGED: list[list[str]] = [[]]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique location below the shared folder."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/paneltide/{name}-{uuid.uuid4().hex[:12]}"
    if len(_STAGED) == 1 and not _STAGED[0]:
        atexit.register(_drop_at_exit, spark)
    _STAGED[-1].append(path)
    return path


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables through Spark's own file systems."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _drop_at_exit(spark: SparkSession) -> None:
    try:
        drop_paths(spark, [p for scope in _STAGED for p in scope])
    except Exception:  # the JVM may be gone; the folder is the session's own
        pass


@contextlib.contextmanager
def scratch_scope(spark: SparkSession):
    """Tables staged inside are deleted at the end, when their result has been written."""
    _STAGED.append([])
    try:
        yield
    finally:
        drop_paths(spark, _STAGED.pop())


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme (only used by tests that inspect files)."""
    return path[len("file:"):] if path.startswith("file:") else path


def default_parallelism(spark: SparkSession) -> int:
    try:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    except Exception:  # pragma: no cover - conf always present in practice
        return os.cpu_count() or 8


def materialize(df, how: str = "table"):
    """Write ``df`` once below the shared checkpoint folder and continue from
    the written data.  Lineage is cut, so a lost executor re-reads files
    instead of recomputing the plan.  Used where a computed frame is referenced
    more than once; otherwise each reference would re-run its whole plan, fact
    scans included.

    ``how="table"`` (default) writes Parquet: later reads prune columns, push
    filters down and give AQE real sizes.  ``how="checkpoint"`` uses a
    reliable RDD checkpoint (row format, no pruning)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if how == "checkpoint":
        return df.checkpoint(eager=True)
    path = scratch_path(spark, "stage")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def scale_conf(input_bytes: int, executors: int, cores_per_executor: int,
               target_partition_bytes: int = 256 << 20) -> dict:
    """Shuffle and scan sizing for a cluster run.

    The initial shuffle partition count is large enough that each
    partition of the biggest shuffle holds about ``target_partition_bytes``
    (and at least two waves of tasks); AQE then coalesces small partitions
    and splits skewed ones at run time.  Scan splits of 512 MB keep the task
    count of a 100 TB scan around 200 000.  Broadcasts stay capped at 64 MB."""
    slots = max(1, executors * cores_per_executor)
    partitions = max(2 * slots, -(-int(input_bytes) // int(target_partition_bytes)))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(512 << 20),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }
