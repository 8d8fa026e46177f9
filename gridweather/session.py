"""Session settings shared by library, tests and bench."""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

from pyspark.sql import SparkSession


def build(app: str = "gridweather", cpus: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the operators expect; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Times are UTC throughout; skewed joins are split at run time; files are read and
    rows go to Python by the thousand, as texts and lists are long."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def is_local(master: str) -> bool:
    """Whether driver and executors are one process, and so see the same disk."""
    return re.fullmatch(r"local(\[.*\])?", master) is not None


def work_folder(spark: SparkSession) -> str:
    """Shared folder for written tables: the cluster's checkpoint folder; only a local session gets a folder of its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not is_local(spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="gridweather-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a folder nobody else uses, below the shared one."""
    return f"{work_folder(spark)}/{name}-{uuid4().hex}"


def checkpoint_folder(spark: SparkSession) -> None:
    """Let iterative fits cut their lineage in the shared folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_folder(spark))
