"""Session defaults and durable lineage cuts."""

from __future__ import annotations

import re
import shutil
import tempfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session with the settings the library expects on a cluster too."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lorekeep")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def scratch(spark: SparkSession, name: str = "lorekeep") -> str:
    """A fresh folder name below the shared folder that the session names in ``spark.checkpoint.dir``.

    Where none is set, a local session gets a temporary one, as in tests. On a cluster that is an error: a folder of one
    machine cannot be read by the others.
    """
    context = spark.sparkContext
    base = spark.conf.get(CHECKPOINT_CONF, "") or context.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lorekeep-")
        context.setCheckpointDir(base)
    return f"{base}/{name}-{uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder, so lost executors do not replay the whole loop."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch(df.sparkSession, "checkpoints"))
    return df.checkpoint()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="lorekeep-")
        archive = shutil.make_archive(f"{folder}/lorekeep", "zip", package.parent, package.name)
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return spark
