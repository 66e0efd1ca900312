"""Lets Python workers find this package, and cuts plans in the folder that all machines share."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Lets workers on this machine import the package; on a cluster use --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, root) if x)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut in the shared folder, so that what is encoded is encoded once."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="bindery-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()
