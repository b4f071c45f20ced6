"""Figures of intervals, windows and laps from the rows and episodes that fall into them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import angle_delta_deg, round_even
from .temporal import nearest, range_join


def measure_intervals(intervals: DataFrame, rows: DataFrame, keys: Sequence[str], interval_id: str, time: str, speed: str, distance: str, slip: str, width: float | None = None) -> DataFrame:
    """Each interval with its speeds, slip, length and place on the route.

    Entry and exit come from the rows nearest to its ends, the earlier one on a tie; the extremes
    and means from the rows inside, ends included, and are NULL without any. ``progress`` is the
    share of the stream's whole distance, NULL where that is 0. ``width`` as in ``range_join``.
    """
    r = rows.select(*keys, F.col(time).alias("_pt"), F.col(speed).alias("_v"), F.abs(slip).alias("_slip"), F.struct(F.col(speed).alias("v"), F.col(distance).alias("d")).alias("_m"))
    route = rows.groupBy(*keys).agg(F.min(distance).alias("_d0"), (F.max(distance) - F.min(distance)).alias("_total"))
    ends = nearest(intervals, r, keys, "start_t", "_pt", "_m").withColumnRenamed("near", "_first").drop("near_t")
    ends = nearest(ends, r, keys, "end_t", "_pt", "_m").withColumnRenamed("near", "_last").drop("near_t")
    inside = range_join(r.drop("_m"), intervals.select(*keys, interval_id, "start_t", "end_t"), keys, "_pt", width=width)
    inside = inside.groupBy(*keys, interval_id).agg(
        F.min("_v").alias("min_speed"), F.max("_v").alias("max_speed"), F.max("_slip").alias("peak_slip"), F.avg("_slip").alias("mean_slip"), F.count("*").alias("n_rows")
    )
    out = ends.join(inside, [*keys, interval_id], "left").join(route, list(keys), "left")
    share = lambda at: F.when(F.col("_total") != 0, (F.col(f"{at}.d") - F.col("_d0")) / F.col("_total"))
    return out.withColumns(
        {
            "n_rows": F.coalesce("n_rows", F.lit(0)),
            "entry_speed": F.col("_first.v"),
            "exit_speed": F.col("_last.v"),
            "length": F.col("_last.d") - F.col("_first.d"),
            "start_progress": share("_first"),
            "end_progress": share("_last"),
        }
    ).drop("_first", "_last", "_d0", "_total")


def measure_windows(windows: DataFrame, rows: DataFrame, episodes: DataFrame, keys: Sequence[str], window: str, order: Sequence[str], speed: str, width: float | None = None) -> DataFrame:
    """Each window with entry, least, exit and mean speed and the episodes that start in it.

    Windows hold their start but not their end; the last one of a stream holds both. ``order``
    begins with the rows' time. An episode (``start_t, end_t``) belongs to the window of its start.
    """
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("end_t"), F.desc(window))) == 1
    held = windows.select(*keys, window, F.col("start_t").alias("_ws"), F.col("end_t").alias("_we"), last.alias("_closed"))

    def within(points: DataFrame, time: str) -> DataFrame:
        return range_join(points, held, keys, time, "_ws", "_we", width).where((F.col(time) < F.col("_we")) | F.col("_closed"))

    at = F.struct(*order)
    speeds = within(rows, order[0]).groupBy(*keys, window).agg(
        F.min_by(speed, at).alias("entry_speed"), F.min(speed).alias("min_speed"), F.max_by(speed, at).alias("exit_speed"), F.avg(speed).alias("avg_speed")
    )
    begun = within(episodes.select(*keys, F.col("start_t").alias("_es"), (F.col("end_t") - F.col("start_t")).alias("_length")), "_es")
    begun = begun.groupBy(*keys, window).agg(F.count("*").alias("episodes"), F.sum("_length").alias("episode_time"))
    out = windows.withColumn("closed_end", last).join(speeds, [*keys, window], "left").join(begun, [*keys, window], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("episodes", "episode_time")})


def segments_by_owner(segments: DataFrame, keys: Sequence[str], owner: str, owner_at_end: str, segment: str, members: str) -> DataFrame:
    """The segments of each owner, that of their start: ids in order, counts, and how many end in another."""
    crosses = F.coalesce(F.col(owner_at_end) != F.col(owner), F.lit(False))
    return segments.groupBy(*keys, owner).agg(
        F.array_sort(F.collect_list(segment)).alias("segments"), F.count("*").alias("n_segments"), F.sum(members).alias("n_members"), F.count_if(crosses).alias("n_crossing")
    )


def starts_by_kind(intervals: DataFrame, keys: Sequence[str], kind: Mapping[str, Column], start: str = "start_t") -> DataFrame:
    """For each stream and kind the starts in order and their number; a kind without any has an empty list."""
    lists = {n: F.array_sort(F.collect_list(F.when(c, F.col(start)))) for n, c in kind.items()}
    out = intervals.groupBy(*keys).agg(*[c.alias(f"{n}_starts") for n, c in lists.items()])
    return out.withColumns({f"n_{n}": F.size(f"{n}_starts") for n in kind})


def episode_medians(episodes: DataFrame, keys: Sequence[str], entry: str, least: str, exit_: str, duration: str) -> DataFrame:
    """Medians of a lap's episodes; ``recovery`` is the median exit less the median of the least."""
    median = lambda c, n: F.percentile(c, F.lit(0.5)).alias(n)
    out = episodes.groupBy(*keys).agg(F.count("*").alias("episodes"), F.sum(duration).alias("duration"), median(entry, "entry"), median(least, "least"), median(exit_, "exit"))
    return out.withColumn("recovery", F.col("exit") - F.col("least"))


def differences(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, repeats counted, with ``side``; empty where they are equal."""
    return stored.exceptAll(derived).withColumn("side", F.lit("stored")).unionByName(derived.exceptAll(stored).withColumn("side", F.lit("derived")))


def summary(df: DataFrame, ident: str, status: str) -> DataFrame:
    """Rows, distinct ids and share of all rows by status; a null status is ``unknown``."""
    counted = df.groupBy(F.coalesce(status, F.lit("unknown")).alias("status")).agg(F.count("*").alias("n_rows"), F.countDistinct(ident).alias("n_ids"))
    return counted.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()))  # a row for each status


def section_native(sections: DataFrame, episodes: DataFrame, keys: Sequence[str], section: str, width: float, sums: Sequence[str] = (), latency: str = "latency_ms") -> DataFrame:
    """Sections (``start_t, end_t``) with the logical drifts that overlap them and the boost latency of those.

    ``drifts`` and ``drift_time`` count and add up episodes (``start_t, end_t``) that overlap by more than a
    point, cut to the section; ``sums`` are columns of the episodes to add up; of ``latency`` the median, the
    90th percentile, both rounded, the least and the largest of those episodes that have one. Sections
    without an episode have 0 drifts and NULL latencies. Pairs meet in the time bucket in which they
    begin to overlap.
    """
    e = episodes.select(*keys, F.col("start_t").alias("_es"), F.col("end_t").alias("_ee"), F.col(latency).alias("_latency"), *sums)
    bucket = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / F.lit(width)), F.floor(F.col(b) / F.lit(width))))
    left = sections.select(*keys, section, "start_t", "end_t").withColumn("_bucket", bucket("start_t", "end_t"))
    met = left.join(e.withColumn("_bucket", bucket("_es", "_ee")), [*keys, "_bucket"]).where("_es < end_t and _ee > start_t")
    met = met.where(F.floor(F.greatest("start_t", "_es") / F.lit(width)) == F.col("_bucket"))
    at = lambda p: round_even(F.percentile("_latency", F.lit(p)), 0).cast("long")
    got = met.groupBy(*keys, section).agg(
        F.count("*").alias("drifts"), F.sum(F.least("end_t", "_ee") - F.greatest("start_t", "_es")).alias("drift_time"), *[F.sum(c).alias(c) for c in sums],
        F.count("_latency").alias("latencies"), at(0.5).alias("latency_median"), at(0.9).alias("latency_p90"), F.min("_latency").alias("latency_min"), F.max("_latency").alias("latency_max"),
    )
    zero = ("drifts", "drift_time", *sums, "latencies")
    return sections.join(got, [*keys, section], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})


def section_trajectory(rows: DataFrame, keys: Sequence[str], order: Sequence[str], axis: str, values: Sequence[str], step: float = 2.5, points: int = 64, valid: Column | None = None, broken: Column | None = None) -> DataFrame:
    """Points of each section (``keys``) at equal distances: ``step`` apart, or as far as ``points`` of them need.

    ``rows`` are those of the sections. Values are linear between two rows; a bracket with an invalid
    end, without length, or up to a ``broken`` row gives no point.
    """
    w, whole = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys)
    flag = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    base = rows.withColumns({"_d0": F.first(axis).over(w), "_end": F.max(axis).over(whole), "_d1": F.lead(axis).over(w), "_ok": flag, "_to": flag if broken is None else flag & ~F.coalesce(broken, F.lit(False)), "_first": F.row_number().over(w) == 1})
    base = base.withColumns({f"_{v}": F.lead(v).over(w) for v in values} | {"_ok1": F.lead("_to").over(w), "_step": F.greatest(F.lit(float(step)), (F.col("_end") - F.col("_d0")) / points)})
    # a target on a row belongs to the bracket that ends there, but for the first one
    low = F.when(F.col("_first"), F.lit(0)).otherwise(F.floor((F.col(axis) - F.col("_d0")) / F.col("_step")) + 1)
    high = F.least(F.floor((F.col("_d1") - F.col("_d0")) / F.col("_step")), F.lit(points - 1))
    made = base.withColumns({"_a": low.cast("long"), "_z": high.cast("long")}).where(f"_d1 > `{axis}` and _ok and _ok1 and _z >= _a").withColumn("point", F.explode(F.sequence("_a", "_z")))
    at = F.col("_d0") + F.col("point") * F.col("_step")
    share = (at - F.col(axis)) / (F.col("_d1") - F.col(axis))
    return made.select(*keys, "point", at.alias("d"), *[(F.col(v) + (F.col(f"_{v}") - F.col(v)) * share).alias(v) for v in values])


def heading_change(rows: DataFrame, keys: Sequence[str], order: Sequence[str], x: str = "x", y: str = "y", reach: int = 4) -> DataFrame:
    """The turn in degrees of each span (``keys``) from the chord of its first rows to that of its last; 0 for short spans."""
    w, back = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    placed = rows.withColumns({"_i": F.row_number().over(w) - 1, "_j": F.row_number().over(back) - 1})
    pick = lambda side, k, v: F.max(F.when(F.col(side) == k, F.col(v)))
    ends = placed.where((F.col("_i") <= reach) | (F.col("_j") <= reach)).groupBy(*keys).agg(
        F.max(F.when(F.col("_j") == 0, F.col("_i"))).alias("_last"), *[pick(s, k, v).alias(f"_{s[1]}{k}{v}") for s in ("_i", "_j") for k in (0, reach) for v in (x, y)]
    )
    turn = angle_delta_deg(F.col(f"_i{reach}{x}") - F.col(f"_i0{x}"), F.col(f"_i{reach}{y}") - F.col(f"_i0{y}"), F.col(f"_j0{x}") - F.col(f"_j{reach}{x}"), F.col(f"_j0{y}") - F.col(f"_j{reach}{y}"))
    return ends.select(*keys, F.when(F.col("_last") >= reach, turn).otherwise(0.0).alias("heading_change"))
