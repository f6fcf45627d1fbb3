"""Joins whose small side is counted before it is broadcast, and results that several steps read."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint only where it has at most `rows` rows; beyond that Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def held(df: DataFrame) -> DataFrame:
    """df, computed once and written as a checkpoint, so that it is not computed for each step that reads it and survives lost executors.

    Checkpoints go to the folder in spark.checkpoint.dir; where it is unset, in
    local mode to one of our own, and a cluster is refused.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir is to name a folder that all executors share")
        context.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}")
    return df.checkpoint()
