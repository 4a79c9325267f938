"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The table, written by `checkpoint()` to the session's spark.checkpoint.dir.

    Where that is unset a folder of our own is taken, but in local mode only: on a cluster the
    other machines would not see it, so that is an error.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        found = sc.getConf().get("spark.checkpoint.dir")
        if not found and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="tidewright-"))
    return df.checkpoint()
