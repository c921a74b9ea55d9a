"""Session-level helpers: tables, the shared folder and lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in spark.checkpoint.dir. Only a local session, whose executors are on
    this machine, may leave it unset and gets a temporary folder; on a cluster that is an error.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="skein-")
        spark.sparkContext.setCheckpointDir("file://" + os.path.abspath(current))
        current = spark.sparkContext.getCheckpointDir()
    return current


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: its lineage ends there.

    Reliable checkpoints survive the loss of any executor, unlike local ones.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
