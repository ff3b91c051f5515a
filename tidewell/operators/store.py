"""Frames that are read more than once, kept in the cluster's shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors share: that of ``spark.checkpoint.dir``.

    One machine without that setting (tests) gets a temporary folder; a cluster without it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="tidewell-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the shared folder: lineage ends, a lost executor costs a re-read."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
