"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


#: Arrow batches are cut at this size: a worker holds several copies of a batch, and a machine runs many workers.
BATCH_BYTES = "8m"


def set_small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES for this session from now on, for results that are computed later, when their caller writes them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def get_session(app: str = "chartspark", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on; `master` and `conf` override the defaults."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cpus: int | None = None, app: str = "chartspark-local") -> SparkSession:
    """Session for tests and the bench: one JVM, as many shuffle partitions as cores."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    return get_session(
        app,
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the cluster's checkpoint folder.

    The folder comes from `spark.checkpoint.dir`. Where it is unset, a session that runs in this
    one process gets a temporary folder; executors elsewhere would not share it, so it is an
    error there.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="chartspark-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
