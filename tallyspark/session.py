"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins and coalesces shuffle
# partitions at runtime; skew-join splitting handles hot keys in joins.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tallyspark", extra: dict | None = None) -> SparkSession:
    """Return the active session, or build one with :data:`DEFAULT_CONF`.

    On a cluster the session already exists (spark-submit) and is returned
    untouched; only local runs and tests build their own.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Uses ``spark.checkpoint.dir`` as configured for the cluster. Only when it
    is unset and the master is local (tests) a fresh local folder is created
    and set; on a cluster an unset folder is an error, because executors can't see
    a folder of the driver. Works with classic sessions and, through the session
    conf, with Spark Connect sessions (no ``sparkContext`` there).
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 — Spark Connect has no SparkContext
        sc = None
    if sc is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return configured
    configured = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tallyspark-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cluster_conf(input_bytes: int, executor_cores: int = 4, executors: int = 1000,
                 target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings sized to the input, for ``spark-submit --conf`` on a cluster.

    * scan splits of ``target_partition_bytes`` (``maxPartitionBytes``);
    * initial shuffle partitions so that an average shuffle partition is
      about the target size, never fewer than the cluster's task slots, so
      a full dedup or keyed aggregation shuffle fits executor memory; AQE
      then coalesces small partitions to the advisory size;
    * skew handling: a partition 5× the median and above 4 × target is split
      (sort-merge joins), which covers a hot key left after aggregation.
    """
    slots = max(1, executor_cores * executors)
    parts = max(slots, int(input_bytes // target_partition_bytes) + 1)
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }
