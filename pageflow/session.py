"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the workers of a local session the package, whatever directory they run in; once for each application.

    A cluster gets the package as any other: on its PYTHONPATH or by --py-files.
    """
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if app in _shipped or not re.fullmatch(r"local(?:\[[\d*, ]+\])?", master):
        return
    _shipped.add(app)
    root = Path(__file__).parent
    target = os.path.join(tempfile.mkdtemp(prefix="pageflow-package-"), "pageflow_package.zip")
    with zipfile.PyZipFile(target, "w") as z:
        z.writepy(str(root))
    spark.sparkContext.addPyFile(target)


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table *name* below *sf_dir*, as a lazily read parquet scan."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session
    that names none (tests) gets a temporary folder; anywhere else a missing
    setting is an error, because a machine-local folder would not survive the
    loss of an executor.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return context._jsc.sc().getCheckpointDir().get()
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pageflow-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """*df* with its lineage cut by a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
