"""Session settings and the shared folder that holds checkpoints and written tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session for tests and benchmarks. On a cluster the submitted session is used as it is."""
    builder = (
        SparkSession.builder.appName("tabscope")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The reliable folder named by spark.checkpoint.dir.

    A local session that names none gets a folder of its own, which goes when Python ends: on a
    cluster a machine-local folder would be lost with its executor, so there it is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tabscope-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own, in the shared folder, for one written table."""
    return os.path.join(shared_folder(spark), f"tabscope-{uuid.uuid4().hex}", name)


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows to reliable storage and cut the lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
