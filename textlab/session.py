"""Spark session helpers.

The library never creates a session behind the user's back: operators take
DataFrames.  ``get_spark`` is for tests, the bench and local runs; on a cluster
the user's own session is used and only ``ensure_checkpoint_dir`` is called.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_spark(cpus: int | str | None = None, app: str = "textlab",
              shuffle_partitions: int | None = None,
              driver_memory: str = "8g", extra_conf: dict | None = None) -> SparkSession:
    """Local session tuned for tests / bench (UI off, AQE on, UTC)."""
    cpus = cpus or os.environ.get("BENCH_CPUS") or "*"
    parts = shuffle_partitions or (int(cpus) if str(cpus).isdigit() else os.cpu_count() or 8)
    builder = SparkSession.builder
    for k, v in (extra_conf or {}).items():
        builder = builder.config(k, v)
    spark = (
        builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # keep the automatic broadcast threshold at the Spark default so nothing
        # unbounded is broadcast implicitly.
        .config("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder, set from the session's configuration.

    On a cluster ``spark.checkpoint.dir`` must name a folder that the driver and
    every executor share; without it a non-local session is refused, because
    executors would write to their own disks and later reads would miss files.
    Only a local session (tests, bench) falls back to a fresh scratch folder.
    Nothing below the folder is removed by the library: set
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` for checkpoints, and
    expire the ``textlab-*`` folders of finished jobs.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not conf_dir:
        if not sc.master.split("[")[0] == "local":
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by the driver and all executors")
        conf_dir = tempfile.mkdtemp(prefix="textlab-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir
