"""The library's registered queries, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Microseconds in an hour and a minute: thresholds of replay milliseconds, scaled to the events table.
HOUR, MINUTE = 3_600_000_000, 60_000_000

EVENTS_SQL = """ev AS (
  SELECT user_id, event_id, epoch_us(ts) AS t, value, CAST(round_even(value * 100, 0) AS BIGINT) AS cents, event_type,
         CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"""


def query(sql: str | None = None):
    """Registers a function under its name; ``sql`` starts after the common table ``ev``."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            text = sql.strip()
            if text.startswith("RECURSIVE "):
                SQL[f.__name__] = f"WITH RECURSIVE {EVENTS_SQL}, {text.removeprefix('RECURSIVE ')}"
                return f
            SQL[f.__name__] = text if text.upper().startswith("SELECT") and " ev" not in text and "\nev" not in text else f"WITH {EVENTS_SQL}{' ' if text.upper().startswith('SELECT') else ', '}{text}"
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as streams: user, microseconds since 1970, value, cents, type and code ``k``."""
    e = table(spark, sf_dir, "events")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    return e.select(
        "user_id", "event_id", micros.alias("t"), "value", F.rint(F.col("value") * 100).cast("long").alias("cents"), "event_type", F.get_json_object("props", "$.k").cast("int").alias("k")
    )
