"""Tables and documents: telemetry as CSV or Parquet, analysis documents as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import to_bool, to_double

PHYSICAL = ("time_s", "x", "y", "z")
MEASURED = ("contact_state", "lap_index", "vx")
DRIVING = ("time_s", "x", "y", "speed", "distance", "lap_index", "pose_valid", "pose_break_before")


def read_csv(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """All columns as texts; a file without a required column is an error, not a NULL column."""
    df = spark.read.csv(path, header=True, quote='"')
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df


def physical_telemetry(spark: SparkSession, path: str, layout: str | None = None) -> DataFrame:
    """Physical rows with numbers; those without a time or a place are left out.

    A file of the 2026 ``layout`` of which any stream has lost its contact states, laps or velocities, by
    column or by value, is refused: what was measured must not pass for unmeasured, nor hide behind
    streams that are whole. The error names up to ten such streams.
    """
    df = read_csv(spark, path, PHYSICAL)
    df = df.withColumns({c: to_double(F.col(c)) for c in df.columns if c not in ("replay_sha", "stream", "shadow_id", "speed_source", "contact_state_name")})
    df = df.dropna(subset=list(PHYSICAL))
    if layout == "2026":
        present, keys = [c for c in MEASURED if c in df.columns], [c for c in ("replay_sha", "stream", "shadow_id") if c in df.columns]
        if lost := [c for c in MEASURED if c not in present]:
            raise ValueError(f"measured columns lost: {', '.join(lost)}")
        held = df.groupBy(*keys).agg(*[F.count(c).alias(f"_{c}") for c in MEASURED])
        lost = held.where(" or ".join(f"_{c} = 0" for c in MEASURED)).limit(10).collect()
        if lost:
            told = "; ".join(f"{'/'.join(str(r[k]) for k in keys) or 'all'}: {', '.join(c for c in MEASURED if not r[f'_{c}'])}" for r in lost)
            raise ValueError(f"measured columns lost: {told}")
    return df


def part_metadata(rows: DataFrame, keys: tuple[str, ...] = ("replay_sha", "stream")) -> DataFrame:
    """Rows, first and last time and rate of each part, numbered by start and end within its recording."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("time_s").alias("t0"), F.max("time_s").alias("t1"))
    out = out.withColumn("hz", F.when(F.col("t1") > F.col("t0"), (F.col("n") - 1) / (F.col("t1") - F.col("t0"))))
    return out.withColumn("part_no", F.row_number().over(Window.partitionBy(keys[0]).orderBy("t0", "t1", *keys[1:])))


def driving_rows(spark: SparkSession, path: str) -> DataFrame:
    """Driving rows: speed and distance are 0 where missing, other numbers NULL."""
    df = read_csv(spark, path, DRIVING)
    numbers = {c: to_double(F.col(c)) for c in ("time_s", "x", "y", "z") if c in df.columns}
    zero = {c: F.coalesce(to_double(F.col(c)), F.lit(0.0)) for c in ("speed", "distance")}
    flags = {c: F.coalesce(to_bool(F.col(c)), F.lit(False)) for c in ("pose_valid", "pose_break_before")}
    return df.withColumns(numbers | zero | flags | {"lap_index": to_double(F.col("lap_index")).cast("int")})


def write_telemetry(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Telemetry by recording, so that one recording reads one folder."""
    writer = df.write.mode("overwrite").partitionBy("replay_sha")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def write_documents(df: DataFrame, path: str) -> None:
    """Nested rows as JSON lines."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, only the fields of ``schema``, with ``status``; a broken line is a row too.

    A ``malformed`` row has its fields as far as they could be read and its text in ``broken``.
    """
    read = spark.read.schema(f"{schema}, broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)
    return read.withColumn("status", F.when(F.col("broken").isNull(), "ok").otherwise("malformed"))


def race_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``race_*.json`` files, newest first, one document a file."""
    meta = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "race_*.json").json(path)
    return meta.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified")).orderBy(F.desc("modified"))
