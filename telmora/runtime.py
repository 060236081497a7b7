"""Reliable checkpoints: the only place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the files.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a local master
    without that setting gets a folder of its own; a cluster without it is an error, because a
    machine-local folder would be lost with its executor.
    """
    spark = df.sparkSession
    _ensure_dir(spark)
    return df.checkpoint(eager=True)


def _ensure_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="telmora-checkpoint-")
    sc.setCheckpointDir(folder)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder for tables of one job, beside the checkpoints, where driver and executors see it."""
    _ensure_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
