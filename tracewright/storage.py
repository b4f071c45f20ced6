"""Intermediate tables that several others are made of, written once where all executors read them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """``df``, computed once and written to the session's checkpoint folder, which survives lost executors.

    The folder is ``spark.checkpoint.dir``, or the one that was set on the context. Only a local session without
    either gets a temporary folder; on a cluster that is an error, as executors share no local disk.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="tracewright-"))
    return df.checkpoint()
