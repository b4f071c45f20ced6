"""Packages of physical telemetry for others: allowed columns only, with a manifest that readers verify."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that a package may hold, and what it never does.
ALLOWED = (
    "replay_sha", "stream", "i", "time_ms", "time_s", "qx", "qy", "qz", "qw", "x", "y", "z", "vx", "vy", "vz", "yaw", "slip", "speed", "speed_source", "speed_direct", "speed_derived", "step", "distance",
    "contact_state", "contact_state_name", "is_airborne", "lap_index", "vehicle_forward_heading_rad", "input_60", "input_61", "input_62", "input_63", "input_64", "input_65",
)
PRIVACY = {"header_copied": False, "nickname_exported": False, "chat_exported": False, "account_metadata_exported": False, "source_filename_exported": False}
CONTRACT = "telemetry_package_v1"


class PackageError(ValueError):
    """A package that can't be written, or isn't what its manifest says."""


def _hashes(spark: SparkSession, path: str) -> dict[str, tuple[int, str]]:
    """Length and SHA-256 of each data file by its path below ``path``; hashed where they lie, by Spark."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(f"{path}/data")
    below = F.regexp_extract("path", r"/(data/.*)$", 1)
    return {r["f"]: (r["length"], r["sha"]) for r in files.select(below.alias("f"), "length", F.sha2("content", 256).alias("sha")).collect()}


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def write_package(rows: DataFrame, path: str) -> dict:
    """Telemetry rows (``replay_sha, stream, time_s`` and more) as CSV by recording below ``path/data``, then ``path/manifest.json``.

    A column that isn't allowed is an error, not a column left out: whoever wrote it must know. The manifest
    comes last and holds schema, rows, files with hashes, the privacy block and figures of each stream.
    The driver gets a row for each stream and file.
    """
    spark = rows.sparkSession
    if wrong := [c for c in rows.columns if c not in ALLOWED]:
        raise PackageError(f"columns not allowed: {', '.join(wrong)}")
    if missing := [c for c in ("replay_sha", "stream", "time_s") if c not in rows.columns]:
        raise PackageError(f"columns missing: {', '.join(missing)}")
    rows.write.partitionBy("replay_sha").option("header", True).csv(f"{path}/data")
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    back = spark.read.schema(schema).option("header", True).csv(f"{path}/data")
    told = back.groupBy("replay_sha", "stream").agg(F.count("*").alias("records"), F.min("time_s").alias("t0"), F.max("time_s").alias("t1")).orderBy("replay_sha", "stream").collect()
    streams = [r.asDict() | {"hz": (r["records"] - 1) / (r["t1"] - r["t0"]) if r["t1"] is not None and r["t1"] > r["t0"] else None} for r in told]
    manifest = {"contract": CONTRACT, "schema": schema, "rows": sum(r["records"] for r in streams), "privacy": PRIVACY, "streams": streams, "files": {f: list(v) for f, v in sorted(_hashes(spark, path).items())}}
    target, files = _files(spark, f"{path}/manifest.json")
    out = files.create(target, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    return manifest


def read_package(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a package, after its files have been held against its manifest: none missing, changed, or more; nothing private."""
    target, files = _files(spark, f"{path}/manifest.json")
    if not files.exists(target):
        raise PackageError("no manifest: the package was not finished")
    stream = files.open(target)
    manifest = json.loads(bytes(stream.readAllBytes()))
    stream.close()
    if manifest.get("contract") != CONTRACT:
        raise PackageError(f"contract {manifest.get('contract')!r}")
    if manifest.get("privacy") != PRIVACY:
        raise PackageError("the privacy block says that something private was copied")
    if wrong := [c.split()[0] for c in manifest["schema"].split(", ") if c.split()[0] not in ALLOWED]:
        raise PackageError(f"columns not allowed: {', '.join(wrong)}")
    held, want = _hashes(spark, path), {f: tuple(v) for f, v in manifest["files"].items()}
    if wrong := sorted(f for f in set(held) | set(want) if held.get(f) != want.get(f)):
        raise PackageError(f"files that differ from the manifest: {', '.join(wrong[:5])}")
    rows = spark.read.schema(manifest["schema"]).option("header", True).csv(f"{path}/data")
    if (n := rows.count()) != manifest["rows"]:
        raise PackageError(f"{n} rows, {manifest['rows']} in the manifest")
    return rows
