"""Session helpers for tests, the bench and local runs.

Library functions never create a session; they take DataFrames. Only
entry points (tests, bench, examples) call :func:`local_session`.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "lakesmith") -> SparkSession:
    """A local session configured the way a cluster job would be.

    AQE stays on (runtime coalescing and skew-join splitting), the UI is
    off, the session clock is UTC so event-time casts are stable.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LAKESMITH_DRIVER_MEM", "8g"))
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``. Only where it is
    unset and everything runs in one process (local tests) is a scratch
    folder made for it; on a cluster that folder would be private to each
    machine, so a missing setting is an error there."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="lakesmith-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    try:
        spark.sparkContext.setCheckpointDir(path)
    except Exception:   # no SparkContext on this session (Spark Connect): the conf is used
        pass
    return path


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: a sibling of the checkpoint
    dir, so it lives on the cluster's shared storage, never local disk."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return base + "/_tables"
