"""Joins of points and intervals in time, always within a stream.

Range joins carry the stream's keys and a time bucket as equality, so that Spark plans a hash or
sort-merge join with a residual condition, however long a stream is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], time: str, start: str = "start_t", end: str = "end_t",
               width: float | None = None, closed_end: bool = True, how: str = "inner") -> DataFrame:
    """Points with the intervals of their stream that hold them.

    The interval's columns, keys aside, must not clash with the point's. ``width`` is the width of
    the time buckets, about that of the longer intervals; without it the stream alone is the key.
    """
    inside = (F.col(time) >= F.col(start)) & ((F.col(time) <= F.col(end)) if closed_end else (F.col(time) < F.col(end)))
    right = intervals.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in intervals.columns if c not in keys])
    on = None
    for k in keys:
        on = (F.col(k) == F.col(f"_r_{k}")) if on is None else on & (F.col(k) == F.col(f"_r_{k}"))
    left = points
    if width is not None:
        left = points.withColumn("_bucket", F.floor(F.col(time) / F.lit(width)))
        right = right.withColumn("_r_bucket", F.explode(F.sequence(F.floor(F.col(start) / F.lit(width)), F.floor(F.col(end) / F.lit(width)))))
        on = on & (F.col("_bucket") == F.col("_r_bucket"))
    if how in ("left_semi", "left_anti"):
        return left.join(right, on & inside, how).select(*points.columns)
    joined = left.join(right, on & inside, how)
    return joined.select(*points.columns, *[c for c in intervals.columns if c not in keys])


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, right_time: str, value: str, tolerance: float | None = None, later_on_tie: bool = False) -> DataFrame:
    """``left`` with the nearest row of ``right`` in its stream: ``near_t`` and ``near``.

    One union and one pass of windows in both directions; no join. On a tie the earlier row is taken
    unless ``later_on_tie``. Beyond ``tolerance`` both are NULL.
    """
    names = left.columns
    a = left.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.struct(*names).alias("_row"))
    kind = dict(right.dtypes)
    x = F.struct(F.col(right_time).alias("t"), F.col(value).alias("v"))
    a = a.withColumn("_x", F.lit(None).cast(f"struct<t:{kind[right_time]},v:{kind[value]}>"))
    b = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), x.alias("_x"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side")
    # looking ahead is looking back in descending order: both windows read each row once
    v = Window.partitionBy(*keys).orderBy(F.desc("_t"), "_side")
    rows = a.unionByName(b)
    rows = rows.withColumns(
        {
            "_before": F.last("_x", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "_after": F.last("_x", ignorenulls=True).over(v.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        }
    ).where("_side = 1")
    back, on = F.col("_t") - F.col("_before.t"), F.col("_after.t") - F.col("_t")
    choose_after = F.col("_before").isNull() | ((on <= back) if later_on_tie else (on < back))
    best = F.when(F.col("_after").isNull(), F.col("_before")).otherwise(F.when(choose_after, F.col("_after")).otherwise(F.col("_before")))
    rows = rows.withColumn("_best", best)
    if tolerance is not None:
        rows = rows.withColumn("_best", F.when(F.abs(F.col("_best.t") - F.col("_t")) <= tolerance, F.col("_best")))
    return rows.select(*[F.col(f"_row.{c}").alias(c) for c in names], F.col("_best.t").alias("near_t"), F.col("_best.v").alias("near"))


def value_at(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, axis: str, value: str, out: str = "value_at") -> DataFrame:
    """``left`` with ``value`` of ``right`` interpolated at ``at`` of its ``axis``.

    Outside the axis's span the result is NULL: nothing is extrapolated or snapped.
    """
    names = left.columns
    a = left.select(*keys, F.col(at).cast("double").alias("_t"), F.lit(1).alias("_side"), F.struct(*names).alias("_row"))
    a = a.withColumns({"_d": F.lit(None).cast("double"), "_v": F.lit(None).cast("double")})
    b = right.select(*keys, F.col(axis).cast("double").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(axis).cast("double").alias("_d"), F.col(value).cast("double").alias("_v"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side")
    v = Window.partitionBy(*keys).orderBy(F.desc("_t"), F.desc("_side"))
    pair = F.when(F.col("_side") == 0, F.struct("_d", "_v"))
    rows = a.unionByName(b).withColumn("_p", pair)
    rows = rows.withColumns(
        {
            "_lo": F.last("_p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "_hi": F.last("_p", ignorenulls=True).over(v.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        }
    ).where("_side = 1")
    exact = F.col("_lo._d") == F.col("_t")
    share = (F.col("_t") - F.col("_lo._d")) / F.when(F.col("_hi._d") > F.col("_lo._d"), F.col("_hi._d") - F.col("_lo._d"))
    got = F.when(exact, F.col("_lo._v")).when(F.col("_lo").isNotNull() & F.col("_hi").isNotNull(), F.col("_lo._v") + (F.col("_hi._v") - F.col("_lo._v")) * share)
    return rows.select(*[F.col(f"_row.{c}").alias(c) for c in names], got.alias(out))


def mark_intervals(points: DataFrame, intervals: DataFrame, keys: Sequence[str], time: str, flag: str, start: str = "start_t", end: str = "end_t") -> DataFrame:
    """``points`` with ``flag``: whether an interval holds them, its end left out.

    Intervals are first merged into their union, so each point meets one of them at most and the
    last one that began decides; it is one ordered pass.
    """
    names = points.columns
    rows = points.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.struct(*names).alias("_row"))
    rows = rows.withColumn("_e", F.lit(None).cast(dict(intervals.dtypes)[end]))
    ivs = intervals.select(*keys, F.col(start).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.col(end).alias("_e"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.unionByName(ivs).withColumn("_until", F.max("_e").over(w)).where("_side = 1")
    return both.select(*[F.col(f"_row.{c}").alias(c) for c in names], F.coalesce(F.col("_t") < F.col("_until"), F.lit(False)).alias(flag))


def overlaps(a: DataFrame, b: DataFrame, keys: Sequence[str], a_id: str, label: str, width: float | None = None) -> DataFrame:
    """For each interval of ``a``: how many of ``b`` overlap it, ends included, for how long, which labels.

    Intervals have ``start_t`` and ``end_t``. With ``width`` both sides are dealt into time buckets; a
    pair is counted in the bucket in which it begins to overlap.
    """
    r = b.select(*keys, F.col("start_t").alias("_bs"), F.col("end_t").alias("_be"), F.col(label).alias("_label"))
    left, on = a, list(keys)
    if width is not None:
        lit = F.lit(width)
        left = a.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start_t") / lit), F.floor(F.col("end_t") / lit))))
        r = r.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_bs") / lit), F.floor(F.col("_be") / lit))))
        on = [*keys, "_bucket"]
    j = left.join(r, on).where("_bs <= end_t and _be >= start_t")
    if width is not None:
        j = j.where(F.floor(F.greatest("start_t", "_bs") / F.lit(width)) == F.col("_bucket"))
    length = F.greatest(F.least("end_t", "_be") - F.greatest("start_t", "_bs"), F.lit(0))
    found = j.groupBy(*keys, a_id).agg(F.count("*").alias("n"), F.sum(length).alias("overlap"), F.array_sort(F.collect_set("_label")).alias("labels"))
    return a.join(found, [*keys, a_id], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "overlap": F.coalesce("overlap", F.lit(0)), "labels": F.coalesce("labels", F.array().cast("array<string>"))})


def first_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str], a_id: str, b_value: str, out: str, width: float | None = None) -> DataFrame:
    """Each interval of ``a`` with ``b_value`` of the first interval of ``b`` that overlaps it.

    With ``width`` both sides are dealt into time buckets, as in ``overlaps``.
    """
    r = b.select(*keys, F.col("start_t").alias("_bs"), F.col("end_t").alias("_be"), F.col(b_value).alias("_v"))
    left, on = a.select(*keys, a_id, "start_t", "end_t"), list(keys)
    if width is not None:
        spread = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / F.lit(width)), F.floor(F.col(hi) / F.lit(width))))
        left, r, on = left.withColumn("_bucket", spread("start_t", "end_t")), r.withColumn("_bucket", spread("_bs", "_be")), [*keys, "_bucket"]
    j = left.join(r, on).where("_bs <= end_t and _be >= start_t")
    first = j.groupBy(*keys, a_id).agg(F.min(F.struct("_bs", "_v")).alias("_m")).select(*keys, a_id, F.col("_m._v").alias(out))
    return a.join(first, [*keys, a_id], "left")


def counts_inside(intervals: DataFrame, points: DataFrame, keys: Sequence[str], interval_id: str, time: str, kinds: Mapping[str, Column]) -> DataFrame:
    """For each interval the number of points inside, ends included, of every kind.

    Ends and points are put in order once; what is counted up to an interval's end, less what is
    counted before its start, lies inside. No point meets an interval, however many overlap.
    """
    none = [F.lit(0).alias(f"_k_{n}") for n in kinds]
    given = [F.when(c, 1).otherwise(0).alias(f"_k_{n}") for n, c in kinds.items()]
    ident = F.lit(None).cast(intervals.schema[interval_id].dataType).alias("_id")
    # at one time: starts, points, ends
    rows = points.select(*keys, ident, F.col(time).alias("_t"), F.lit(1).alias("_side"), *given)
    for side, end in ((0, "start_t"), (2, "end_t")):
        rows = rows.unionByName(intervals.where("start_t <= end_t").select(*keys, F.col(interval_id).alias("_id"), F.col(end).alias("_t"), F.lit(side).alias("_side"), *none))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.where("_t is not null").withColumns({f"_k_{n}": F.sum(f"_k_{n}").over(w) for n in kinds}).where("_side <> 1")
    upto = lambda n, side: F.max(F.when(F.col("_side") == side, F.col(f"_k_{n}")))
    found = rows.groupBy(*keys, F.col("_id").alias(interval_id)).agg(*[(upto(n, 2) - upto(n, 0)).alias(n) for n in kinds])
    out = intervals.join(found, [*keys, interval_id], "left")
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in kinds})


def first_after(intervals: DataFrame, points: DataFrame, keys: Sequence[str], interval_id: str, time: str, window: float, out: str = "latency") -> DataFrame:
    """Time from an interval's end to the first point at or after it within ``window``, else NULL.

    One ordered pass from late to early; no join.
    """
    names, kind = intervals.columns, points.schema[time].dataType
    ends = intervals.select(*keys, F.col("end_t").alias("_t"), F.lit(0).alias("_side"), F.struct(*names).alias("_row"), F.lit(None).cast(kind).alias("_pt"))
    p = points.where(F.col(time).isNotNull()).select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(ends.schema["_row"].dataType).alias("_row"), F.col(time).alias("_pt"))
    w = Window.partitionBy(*keys).orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ends.unionByName(p).withColumn("_next", F.last("_pt", ignorenulls=True).over(w)).where("_side = 0")
    gap = F.col("_next") - F.col("_t")
    return rows.select(*[F.col(f"_row.{c}").alias(c) for c in names], F.when(gap <= window, gap).alias(out))


def near_any(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, right_time: str, tolerance: float) -> DataFrame:
    """Rows of ``left`` with a row of ``right`` in their stream at most ``tolerance`` away."""
    w = F.lit(2 * tolerance if tolerance > 0 else 1)
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col(right_time).alias("_rt"))
    r = r.withColumn("_b", F.explode(F.sequence(F.floor((F.col("_rt") - tolerance) / w), F.floor((F.col("_rt") + tolerance) / w))))
    on = F.floor(F.col(time) / w) == F.col("_b")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    return left.join(r, on & (F.abs(F.col(time) - F.col("_rt")) <= tolerance), "left_semi")


def evidence_matrix(events: DataFrame, anchors: DataFrame, keys: Sequence[str], time: str, code: str, anchor_time: str, kind: str, tolerance: float) -> DataFrame:
    """Per action code: its number of events and how many are near an anchor of each kind."""
    e = events.select(*keys, F.col(time).alias("_t"), F.col(code).alias("code")).withColumn("_id", F.monotonically_increasing_id())
    a = anchors.select(*keys, (F.col(anchor_time) - tolerance).alias("_lo"), (F.col(anchor_time) + tolerance).alias("_hi"), F.col(kind).alias("kind"))
    hits = range_join(e, a, keys, "_t", "_lo", "_hi", 2 * tolerance if tolerance > 0 else 1).select("code", "kind", "_id").distinct()
    near = hits.groupBy("code", "kind").agg(F.count("*").alias("near"))
    total = e.groupBy("code").agg(F.count("*").alias("events"))
    return total.join(near, "code", "left").select("code", "events", "kind", F.coalesce("near", F.lit(0)).alias("near"))


def anchored_buckets(starts: DataFrame, anchors: Mapping[str, DataFrame], keys: Sequence[str], start_id: str, time: str, tolerance: float) -> DataFrame:
    """Starts with one flag for each anchor table that has a row near them, and ``any_anchor``."""
    out = starts
    for name, table in anchors.items():
        hit = near_any(starts, table, keys, time, "t", tolerance).select(*keys, start_id, F.lit(True).alias(name))
        out = out.join(hit, [*keys, start_id], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    flag = F.lit(False)
    for name in anchors:
        flag = flag | F.col(name)
    return out.withColumn("any_anchor", flag)


def classify_context(starts: DataFrame, air: DataFrame, landings: DataFrame, drifts: DataFrame, keys: Sequence[str], start_id: str,
                     after_landing: float = 200, after_drift: float = 350, lasting: tuple[float, float] = (100, 1000)) -> DataFrame:
    """Subtype of each effect start by what surrounds it, first match wins.

    In a validated air interval: ``air_boost``; soon after a landing: ``landing_boost``; in a drift, or
    soon after one: ``drift_small_boost`` with ``relation`` during or post and the drift's id; else
    ``other_small_boost``. Effects outside the ``lasting`` durations are ``unknown_speed_effect``.
    ``starts``: ``start_t, duration``; ``air``: ``start_t, end_t``; ``landings``: ``t``; ``drifts``: ``start_t, end_t, id``.
    """
    s = starts.select(*keys, start_id, "start_t")
    width = max(after_landing, after_drift, lasting[1])

    def around(table: DataFrame, name: str, value: Column, closed: bool = True) -> DataFrame:
        return range_join(s, table, keys, "start_t", "_s", "_e", width, closed).groupBy(*keys, start_id).agg(F.min(value).alias(name))

    since = F.col("start_t") - F.col("_s")
    in_air = around(air.select(*keys, F.col("start_t").alias("_s"), F.col("end_t").alias("_e")), "_air", F.lit(True), closed=False)
    landed = around(landings.select(*keys, F.col("t").alias("_s"), (F.col("t") + after_landing).alias("_e")), "_landing", since)
    during = around(drifts.select(*keys, F.col("start_t").alias("_s"), F.col("end_t").alias("_e"), F.col("id").alias("_d")), "_during", F.struct("_s", "_d"))
    post = around(drifts.select(*keys, F.col("end_t").alias("_s"), (F.col("end_t") + after_drift).alias("_e"), F.col("id").alias("_d")), "_post", F.struct(since.alias("gap"), F.col("_d")))
    out = starts
    for part in (in_air, landed, during, post):
        out = out.join(part, [*keys, start_id], "left")
    subtype = (
        F.when(~F.col("duration").between(*lasting), "unknown_speed_effect")
        .when(F.col("_air"), "air_boost")
        .when(F.col("_landing").isNotNull(), "landing_boost")
        .when(F.col("_during").isNotNull() | F.col("_post").isNotNull(), "drift_small_boost")
        .otherwise("other_small_boost")
    )
    out = out.withColumn("subtype", subtype)
    drift = F.col("subtype") == "drift_small_boost"
    return out.select(
        *starts.columns, "subtype", F.when(drift, F.when(F.col("_during").isNotNull(), "during").otherwise("post")).alias("relation"),
        F.when(drift, F.coalesce("_during._d", "_post._d")).alias("drift_id"), F.when(F.col("subtype") == "landing_boost", F.col("_landing")).alias("landing_delta"),
    )
