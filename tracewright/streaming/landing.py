"""Recordings as they arrive: a file stream over a folder, one batch plan for each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.recordings import MOST_BYTES


def arrivals(spark: SparkSession, path: str, pattern: str = "*.sav", most_bytes: int = MOST_BYTES) -> DataFrame:
    """New files of a folder with their content's hash and ``status``: ``ready``, or ``too_large`` without content and hash, as in ``recordings.landing``."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).schema("path string, modificationTime timestamp, length long, content binary").load(path)
    fits = F.col("length") <= most_bytes
    files = files.withColumns({"content": F.when(fits, F.col("content")), "status": F.when(fits, "ready").otherwise("too_large")})
    return files.withColumn("replay_sha", F.sha2("content", 256))


def analyse_arrivals(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs ``write(recordings, batch_id)`` on each batch's distinct recordings that are ready.

    A repeated batch has the same id, so ``write`` can replace what a lost driver left behind.
    """
    writer = stream.writeStream.foreachBatch(lambda df, k: write(df.where("status = 'ready'").dropDuplicates(["replay_sha"]), k)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def merged_segments(stream: DataFrame, keys: list[str], time: str, gap: str, late: str) -> DataFrame:
    """The streaming twin of segment merging: sessions of events no farther apart than ``gap``.

    Sessions close once the watermark, ``late`` behind the newest event, has passed them.
    """
    session = F.session_window(F.col(time), gap)
    out = stream.withWatermark(time, late).groupBy(*keys, session.alias("session")).agg(F.count("*").alias("members"))
    return out.select(*keys, F.col("session.start").alias("start_t"), F.col("session.end").alias("end_t"), "members")
