"""Aggregations of intervals, events and streams. Empty groups give NULL, not 0, for measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stats(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Count, sum, min, max, median (interpolated) and mean of the finite values of each group."""
    v = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    return df.withColumn("_v", v).groupBy(*keys).agg(
        F.count("_v").alias("n"), F.sum("_v").alias("total"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.percentile("_v", F.lit(0.5)).alias("median"), F.avg("_v").alias("mean")
    )


def percentiles(df: DataFrame, keys: Sequence[str], value: str, at: Sequence[float]) -> DataFrame:
    """Exact percentiles with linear interpolation, one column ``p50`` and so on for each."""
    return df.groupBy(*keys).agg(*[F.percentile(value, F.lit(float(p))).alias(f"p{round(100 * p)}") for p in at])


def upper_median(df: DataFrame, keys: Sequence[str], value: Column, out: str) -> DataFrame:
    """The value at index n div 2 of the ascending values."""
    rows = df.withColumn("_v", value).where("_v is not null")
    w = Window.partitionBy(*keys)
    rows = rows.withColumns({"_i": F.row_number().over(w.orderBy("_v")), "_n": F.count("*").over(w)})
    return rows.where("_i = _n div 2 + 1").select(*keys, F.col("_v").alias(out))


def sample_rate(df: DataFrame, keys: Sequence[str], order: Sequence[str], time_ms: str) -> DataFrame:
    """Records a second: 1000 over the upper median of the positive time steps."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = df.withColumn("_dt", F.col(time_ms) - F.lag(time_ms).over(w)).where("_dt > 0")
    return upper_median(step, keys, F.col("_dt"), "step_ms").withColumn("hz", 1000 / F.col("step_ms"))


def histogram(df: DataFrame, keys: Sequence[str], code: str) -> DataFrame:
    """A map from code to its number of rows, with the first and last code of each group."""
    counts = df.groupBy(*keys, code).agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(code).cast("string").alias("code"), "n")))
    return counts.groupBy(*keys).agg(F.map_from_entries(entries).alias("histogram"), F.count("*").alias("distinct_codes"), F.sum("n").alias("events"))


def toggle_balance(df: DataFrame, keys: Sequence[str], opens: Column, closes: Column) -> DataFrame:
    """Opens and closes of each group and whether they balance."""
    rows = df.withColumns({"_o": opens, "_c": closes}).groupBy(*keys).agg(F.count_if("_o").alias("opens"), F.count_if("_c").alias("closes"))
    return rows.withColumns({"intervals": F.least("opens", "closes"), "balanced": F.col("opens") == F.col("closes")})


def code_evidence(intervals: DataFrame, code: str, duration: str, semantic: str) -> DataFrame:
    """Per effect code: intervals, median duration, meanings and how many are unknown."""
    return intervals.groupBy(code).agg(
        F.count("*").alias("intervals"), F.percentile(duration, F.lit(0.5)).alias("median_duration"), F.array_sort(F.collect_set(semantic)).alias("semantics"),
        F.count_if(F.col(semantic).startswith("unknown")).alias("unknown"),
    )


def alignment_gate(flagged: DataFrame, keys: Sequence[str], aligned: str = "aligned", least: float = 0.5) -> DataFrame:
    """Whether a stream's events line up with its anchors; counts are withheld where they don't.

    ``flagged`` has a row for each anchor event with whether it is aligned; without any row the gate
    doesn't apply and counts are allowed.
    """
    rate = flagged.groupBy(*keys).agg(F.count(aligned).alias("anchor_events"), F.count_if(aligned).alias("aligned_events"))
    rate = rate.withColumn("rate", F.when(F.col("anchor_events") > 0, F.col("aligned_events") / F.col("anchor_events")))
    state = F.when(F.col("anchor_events") == 0, "not_applicable").when(F.col("rate") < least, "variant_mismatch").otherwise("aligned")
    return rate.withColumns({"gate": state, "counts_allowed": state != "variant_mismatch"})


def stream_totals(df: DataFrame, keys: Sequence[str], time: str, distance: str, speed: str, states: Sequence[str] = ()) -> DataFrame:
    """Duration, distance, average speed (distance over duration), top speed, distinct states."""
    out = df.groupBy(*keys).agg(
        (F.max(time) - F.min(time)).alias("duration"), (F.max(distance) - F.min(distance)).alias("distance"), F.max(speed).alias("max_speed"), F.count("*").alias("n_rows"),
        *[F.array_sort(F.collect_set(s)).alias(f"{s}_values") for s in states],
    )
    return out.withColumn("avg_speed", F.when(F.col("duration") > 0, F.col("distance") / F.col("duration")))


def lap_metrics(rows: DataFrame, keys: Sequence[str], speed: str, time: str, distance: str, moving: float = 0.5) -> DataFrame:
    """Speed and distance figures of each lap; the slowest moving speed leaves out standstill."""
    v = F.col(speed)
    return rows.groupBy(*keys).agg(
        (F.max(time) - F.min(time)).alias("duration"), (F.max(distance) - F.min(distance)).alias("distance"), F.avg(v).alias("avg_speed"), F.max(v).alias("max_speed"),
        F.percentile(speed, F.lit(0.5)).alias("median_speed"), F.min(v).alias("min_speed"), F.min(F.when(v >= moving, v)).alias("min_moving_speed"),
    )


def fastest(df: DataFrame, keys: Sequence[str], label: str, estimate: str, span: str) -> DataFrame:
    """The label with the least estimate, or span where there is none; the lower label on a tie."""
    basis = F.coalesce(estimate, span)
    best = df.where(basis.isNotNull()).groupBy(*keys).agg(F.min(F.struct(basis.alias("t"), F.col(label).alias("l"))).alias("m"))
    return best.select(*keys, F.col("m.l").alias("fastest"), F.col("m.t").alias("best_time"))


def shared_names(df: DataFrame, name: str, ident: str) -> DataFrame:
    """Names that more than one id carries, with the ids."""
    found = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.array_sort(F.collect_set(ident)).alias("ids"))
    return found.where(F.size("ids") > 1).withColumn("n_ids", F.size("ids"))


def preferred(df: DataFrame, keys: Sequence[str], value: str, rank: str, order: str, usable: Column | None = None) -> DataFrame:
    """The usable value of the highest rank; the latest in order on a tie."""
    rows = df if usable is None else df.where(usable)
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(rank, order)).alias(value))


def section_measures(rows: DataFrame, keys: Sequence[str], order: Sequence[str], speed: str, time: str, distance: str, turn_deg: str, peak: str, edge: int = 8) -> DataFrame:
    """Entry, exit, slowest, 20 % and mean speed of each section, its kind and efficiency.

    A section is a turn if its heading changes by 10 degrees or its signal peaks at 8. Efficiency is
    0.45 of the 20 % speed, 0.20 of the mean and 0.35 of the share of entry speed kept at the exit,
    each relative to the section's top speed and within 0 and 1.
    """
    up, down = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    n = rows.withColumns({"_a": F.row_number().over(up), "_z": F.row_number().over(down)})
    v = F.col(speed)
    out = n.groupBy(*keys).agg(
        F.avg(F.when(F.col("_a") <= edge, v)).alias("entry"), F.avg(F.when(F.col("_z") <= edge, v)).alias("exit"), F.min(v).alias("low"),
        F.percentile(speed, F.lit(0.2)).alias("p20"), F.avg(v).alias("mean"), F.max(v).alias("high"), (F.max(time) - F.min(time)).alias("duration"),
        (F.max(distance) - F.min(distance)).alias("length"), F.max_by(turn_deg, F.abs(turn_deg)).alias("turn_deg"), F.max(F.abs(peak)).alias("peak_deg"),
    )
    one = F.lit(1.0)
    share = lambda a, b: F.greatest(F.lit(0.0), F.least(one, F.when(b > 0, a / b).otherwise(0.0)))
    eff = 0.45 * share(F.col("p20"), F.col("high")) + 0.20 * share(F.col("mean"), F.col("high")) + 0.35 * share(F.col("exit"), F.col("entry"))
    turn = (F.abs("turn_deg") >= 10) | (F.col("peak_deg") >= 8)
    return out.withColumns({"kind": F.when(turn, "turn").otherwise("straight"), "efficiency": eff, "direction": F.when(F.col("turn_deg") > 0, "left").when(F.col("turn_deg") < 0, "right").otherwise("neutral")})


def marker_accounting(counts: DataFrame) -> DataFrame:
    """From ``n24, n19, cw``: the counts of the three combinations and whether they add up.

    Each wcw event uses a marker while there are any beyond those of cw; the rest are cww. As a
    marker may serve two wcw events, the sum can exceed the markers: a flag says so.
    """
    used = F.least("n19", F.greatest(F.lit(0), F.col("n24") - F.col("cw")))
    out = counts.withColumns({"wcw": F.col("n19"), "consumed": used})
    out = out.withColumn("cww", F.col("n24") - F.col("cw") - F.col("consumed"))
    return out.withColumn("consistent", F.col("cw") + F.col("wcw") + F.col("cww") == F.col("n24"))


def product_statistics(semantics: DataFrame, counts: Sequence[str]) -> DataFrame:
    """Each count as a struct (status, value, raw): primary if the gate allows it, else raw only."""
    allowed = F.coalesce("counts_allowed", F.lit(False))

    def one(c: str) -> Column:
        status = F.when(F.col(c).isNull(), "unavailable").when(allowed, "primary").otherwise("raw_only")
        return F.struct(status.alias("status"), F.when(allowed, F.col(c)).alias("value"), F.col(c).alias("raw")).alias(c)

    return semantics.select(*[c for c in semantics.columns if c not in counts], *[one(c) for c in counts])
