"""Spark session defaults used by tests, the bench and the examples."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

# Settings that keep results deterministic and plans adaptive.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    # the Python line of each column expression isn't looked up while a plan is built
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # checkpoints of forked inputs are removed once their DataFrames are gone
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tallyloom") -> SparkSession:
    """Return a session with the library defaults applied.

    On a cluster ``master`` is left to spark-submit; locally it defaults to
    ``local[*]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; set one only if unset.

    A folder is created only for ``local`` masters (tests, a laptop), whose
    executor is the driver itself; on a cluster a machine-local folder would not
    be visible to other executors, so an unset ``spark.checkpoint.dir`` is an
    error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir is not set: configure a folder on shared storage "
                           "(HDFS, object store) that every executor can reach")
    path = tempfile.mkdtemp(prefix="tallyloom-ckpt-")
    sc.setCheckpointDir(path)
    return path
