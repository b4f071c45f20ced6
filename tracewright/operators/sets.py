"""Set operations, ranking and budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import EQUAL_S


def complement(spans: DataFrame, intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The parts of each span (``lo, hi``) that no interval (``start_t, end_t``) covers."""
    i = intervals.join(spans.select(*keys, "lo", "hi"), list(keys)).where("end_t > lo and start_t < hi")
    i = i.select(*keys, F.greatest("start_t", "lo").alias("_s"), F.least("end_t", "hi").alias("_e"))
    ends = spans.select(*keys, F.col("hi").alias("_s"), F.col("hi").alias("_e"))
    starts = spans.select(*keys, F.col("lo").alias("_s"), F.col("lo").alias("_e"))
    w = Window.partitionBy(*keys).orderBy("_s", "_e").rowsBetween(Window.unboundedPreceding, -1)
    rows = i.unionByName(ends).unionByName(starts).withColumn("gap_start", F.max("_e").over(w))
    return rows.where("gap_start < _s").select(*keys, "gap_start", F.col("_s").alias("gap_end"))


def dedupe_by_precedence(df: DataFrame, keys: Sequence[str], precedence: Column, tie: Sequence[str]) -> DataFrame:
    """One row for each key: that of the lowest precedence, then the first by ``tie``."""
    w = Window.partitionBy(*keys).orderBy(precedence, *tie)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def top_changes(df: DataFrame, keys: Sequence[str], change: str, tie: str, n: int = 5, equal: float = EQUAL_S) -> DataFrame:
    """The ``n`` largest losses (positive changes) and gains of each group, ranked."""
    side = F.when(F.col(change) > equal, "loss").when(F.col(change) < -equal, "gain")
    rows = df.withColumn("side", side).where("side is not null")
    w = Window.partitionBy(*keys, "side").orderBy(F.desc(F.abs(change)), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def observation_budget(ranked: DataFrame, keys: Sequence[str], budget: int = 8) -> DataFrame:
    """Losses first, then gains, until the budget of a group is spent."""
    w = Window.partitionBy(*keys).orderBy(F.desc("side"), "rank")
    return ranked.withColumn("position", F.row_number().over(w)).where(F.col("position") <= budget)


def keep_best(df: DataFrame, keys: Sequence[str], score: Column, tie: Sequence[str], n: int) -> DataFrame:
    """The ``n`` rows of the highest score of each group."""
    w = Window.partitionBy(*keys).orderBy(score.desc(), *tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def drift_candidate_score(c: dict[str, Column]) -> Column:
    """Score of a toggle table: marker, adjacent effect table, its records, matches, matched share, intervals."""
    return (
        F.lit(1e6) + 2.5e5 * c["marker"].cast("double") + 1e5 * c["effect"].cast("double") + 1e4 * c["effect_records"] + 1e3 * c["matches"] + 100 * c["share"] + c["intervals"]
    )


def assign_roles(streams: DataFrame, keys: Sequence[str], hz: str = "hz", tie: str = "start_byte") -> DataFrame:
    """The stream of the highest rate is the local one, the others come over the network."""
    w = Window.partitionBy(*keys).orderBy(F.desc(hz), tie)
    ranked = streams.withColumn("shadow", F.row_number().over(w) - 1)
    return ranked.withColumn("role", F.when(F.col("shadow") == 0, "local_high_frequency").otherwise("network_low_frequency"))
