"""Session helpers: one place that decides Spark settings and shared folders.

Library functions never create a session; they take the caller's. ``get_spark`` is
for tests, ``bench.py`` and command-line use.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every analysis relies on: AQE for runtime re-planning (coalescing small
# shuffles, splitting skewed join partitions, switching to broadcast when a side turns
# out small), UTC so dates and timestamps agree with the SQL oracle, the UI off.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # reliable checkpoints of the rank operators are removed once nothing references them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "quarry", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with ``BASE_CONF`` applied."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and materialised tables.

    Read from the session (``spark.checkpoint.dir`` or the context's checkpoint dir).
    Only a local-mode session without one gets a private temporary folder; on a cluster
    a machine-local folder would not survive executor loss, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/ABFS) for this cluster")
        configured = tempfile.mkdtemp(prefix="quarry-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def reliable_checkpoint(df):
    """``df.checkpoint(eager=True)`` into the shared checkpoint folder (set up if needed).

    Reliable checkpoints survive executor loss, unlike ``localCheckpoint``; the files are
    removed once the checkpointed data is no longer referenced (see ``BASE_CONF``).
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def run_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/quarry-scratch/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the run's folder."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> bool:
    """Delete a folder in whatever store it lies; False if there was none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True))


def remove_scratch(spark: SparkSession) -> bool:
    """Delete this application's intermediate tables, once no result that reads them is needed any more."""
    return delete_folder(spark, run_folder(spark))


def scale_conf(input_bytes: int, target_partition_bytes: int = 256 << 20, max_split_bytes: int = 512 << 20) -> dict:
    """Partition sizing for a cluster run over ``input_bytes`` of (compressed) input.

    Shuffles start with about one partition per ``target_partition_bytes`` of input (at
    least 200) and AQE coalesces them towards the same advisory size at run time; scans
    split files at ``max_split_bytes``. For 100 TB that is ~400k initial shuffle
    partitions, coalesced per stage to what the stage's data needs.
    """
    initial = max(200, input_bytes // target_partition_bytes)
    return {
        "spark.sql.shuffle.partitions": str(initial),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(initial),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(max_split_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
    }
