"""Spark session and shared-folder helpers."""

from __future__ import annotations

import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "cohortlens",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir`` and register it; where none is named, a
    folder in the session's warehouse, never a machine's own temp folder."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext            # absent on Spark Connect sessions
    except Exception:  # noqa: BLE001
        sc = None
    if not d and sc is not None:
        d = sc.getCheckpointDir()
    if not d:
        # like the checkpoint folder of a cluster, the warehouse is a place that all executors reach
        d = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
        spark.conf.set("spark.checkpoint.dir", d)
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the shared checkpoint folder for
    materialised intermediate tables and file round trips."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_DROP_EXCHANGES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_DROPPING: dict = {"lock": threading.Lock(), "steps": 0, "before": None}


@contextmanager
def exchanges_dropped(spark: SparkSession):
    """Exchange files of the steps run inside go when their step ends; else they stay on disk until the driver's heap happens to be collected.
    Steps may run side by side: the setting is put back by the last of them."""
    with _DROPPING["lock"]:
        if not _DROPPING["steps"]:
            _DROPPING["before"] = spark.conf.get(_DROP_EXCHANGES, None)
            spark.conf.set(_DROP_EXCHANGES, "true")
        _DROPPING["steps"] += 1
    try:
        yield
    finally:
        with _DROPPING["lock"]:
            _DROPPING["steps"] -= 1
            if not _DROPPING["steps"]:
                if _DROPPING["before"] is None:
                    spark.conf.unset(_DROP_EXCHANGES)
                else:
                    spark.conf.set(_DROP_EXCHANGES, _DROPPING["before"])


def written(df, name: str = "table"):
    """``df`` as a Parquet table in the shared folder, read back: written once, read by any number of later steps."""
    path = scratch_path(df.sparkSession, name)
    with exchanges_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df):
    """Reliable checkpoint (written to the shared folder, survives executor
    loss); used between rounds of iterative operators."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions_for_iterations(df, target_bytes: int = 128 * 1024 * 1024):
    """Coalesce a materialised table for iterative learners: one partition
    per core, but never partitions larger than ~``target_bytes`` (row width
    estimated at 8 bytes per column).  Coalesce only merges partitions."""
    import math
    spark = df.sparkSession
    try:
        cores = spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001
        return df
    n = df.count()
    need = max(cores, math.ceil(n * 8 * max(len(df.columns), 1) / target_bytes))
    return df.coalesce(need) if df.rdd.getNumPartitions() > need else df
