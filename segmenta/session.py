"""Spark session settings shared by the library, the tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on.  Time zone: the inputs are timestamp_ntz and
# the oracle (DuckDB) runs in UTC, so date truncation must not shift days.
BASE_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(
    master: str | None = None,
    app_name: str = "segmenta",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or reuse) a session with the library's settings.

    On a cluster pass ``master=None`` and let spark-submit decide; tests and the
    bench pass ``local[N]`` and a small ``shuffle_partitions``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    # getOrCreate may hand back an existing session: re-apply runtime SQL conf.
    for key, value in conf.items():
        if spark.conf.isModifiable(key):  # not those fixed when the session was made
            spark.conf.set(key, value)
    ensure_checkpoint_dir(spark)
    return spark


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder for files that driver and executors share: below the checkpoint
    folder (on a cluster: ``spark.checkpoint.dir``)."""
    root = ensure_checkpoint_dir(spark)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """Return the checkpoint directory, setting one only when none is configured.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that setting
    always wins.  Only a local-mode session (tests) without it gets a scratch
    folder; on a cluster nothing machine-local is ever set, and the directory
    stays unset (no operator needs to checkpoint).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            return None
        configured = tempfile.mkdtemp(prefix="segmenta-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
