"""Session factory and shipping of this package to executors."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession



def get_session(app: str = "quern", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per Spark context.

    Spark's own file server distributes the archive, so executors need no folder in common with the driver.
    """
    sc = spark.sparkContext
    if getattr(sc, "_quern_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quern-")
    archive = os.path.join(folder, "quern_src.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(archive)
    sc._quern_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: ``spark.checkpoint.dir``. Unset, a fresh folder on a single machine, and an error on a cluster."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return configured or current
    if not configured and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = configured or tempfile.mkdtemp(prefix="quern-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def cut(df):
    """Checkpoint ``df`` in the shared folder: lineage ends there and lost executors lose nothing."""
    checkpoint_dir(df.sparkSession)
    return _unestimated(df.checkpoint(eager=True))


def _unestimated(df):
    """The checkpoint ``df`` without Spark's estimate of its size, if that is past all sizes.

    A checkpoint keeps the estimate of the plan that made it, and that of a join is the product of both sides'. Where a loop joins its own
    results the number gets twice the digits each time, until the planner takes minutes and the driver's heap for it. Partitioning and order stay."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRDD" or plan.stats().sizeInBytes().bit_length() < 63:
        return df
    jvm, session = df.sparkSession._jvm, df._jdf.sparkSession()
    none = jvm.scala.Option.apply(None)
    plan = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), session, none, none)
    return type(df)(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, plan), df.sparkSession)
