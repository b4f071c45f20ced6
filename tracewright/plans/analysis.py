"""From recordings to analysis tables: bronze (decoded), silver (rows, intervals), gold (segments).

Each table is a DataFrame keyed by ``replay_sha`` (and ``stream``), so that a run over many
recordings is the same plan as a run over one. Times of native tables are in milliseconds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import matching, sections, semantics, sets, temporal
from ..operators import sequences as seq
from ..sources import native_tables, recordings
from ..storage import kept
from .catalog import Catalog
from .rebuild import BUCKETS, rebuild

#: Effect codes.
NITRO, SMALL_BOOST, MAP_PROPULSION = 1.0, 2001.0, 2003.0
STREAM, ORDER = ["replay_sha", "stream"], ["i"]
CONTRACT = "trajectory_analysis"
LOCAL = "role = 'local_high_frequency'"


@dataclass
class Silver:
    rows: DataFrame  # telemetry by stream, with breaks, laps and roles
    tables: DataFrame  # the native table of each stream, or why it has none
    drifts: DataFrame  # logical drift groups by stream, ms
    effects: DataFrame  # effect intervals by stream with their meaning, ms
    air: DataFrame  # air intervals by stream, ms
    actions: DataFrame  # action events, which are the local vehicle's


def stitched(rows: DataFrame) -> DataFrame:
    """Rows of physical parts as rows of logical vehicles: ``stream`` is the vehicle, ``i`` its order, ``part`` the part.

    Where two parts meet, a row less than a millisecond after the one before it, of another part, is a
    repeat and goes.
    """
    parts = recordings.stream_parts(rows)
    owner = matching.stitch_parts(parts, ["replay_sha"]).select("replay_sha", F.col("part_id").alias("stream"), "vehicle")
    named = rows.join(owner, STREAM).withColumnRenamed("stream", "part").withColumnRenamed("vehicle", "stream").withColumn("stream", F.col("stream").cast("int"))
    w = Window.partitionBy(*STREAM).orderBy("time_ms", "part", "i")
    repeat = (F.lag("part").over(w) != F.col("part")) & (F.col("time_ms") - F.lag("time_ms").over(w) < 1)
    kept = named.withColumn("_repeat", F.coalesce(repeat, F.lit(False))).where("not _repeat").drop("_repeat")
    return kept.withColumn("i", (F.row_number().over(w) - 1).cast(dict(rows.dtypes)["i"]))


def silver(files: DataFrame) -> Silver:
    """Telemetry and intervals of recordings ``(replay_sha, content)``; each recording is decoded once."""
    found = kept(recordings.streams(recordings.stream_candidates(files)))
    rows = kept(stitched(kept(recordings.telemetry(recordings.decode(files, found)))))
    rows = seq.repair_breaks(seq.pose_breaks(rows, STREAM, ORDER), STREAM, ORDER)
    rows = rows.withColumn("speed", F.col("speed_fixed")).drop("speed_fixed")
    rows = rows.withColumn("moved", F.when(F.col("break_before"), 0.0).otherwise(F.col("step")))
    rows = seq.cumulative(rows.drop("distance"), STREAM, ORDER, "moved", "distance").drop("moved")
    vehicles = recordings.stream_parts(rows)
    roles = sets.assign_roles(vehicles.withColumnRenamed("part_id", "stream"), ["replay_sha"], tie="stream").select("replay_sha", "stream", "shadow", "role")
    rows = kept(rows.join(roles.drop("shadow"), STREAM))
    rises = seq.rising_edges(rows, STREAM, ORDER, F.col("input_64") != 0).select(*STREAM, F.col("time_ms").alias("t"))
    tables = kept(native_tables.assign_tables(kept(native_tables.drift_tables(files)), roles, rises))
    drifts = seq.logical_groups(native_tables.vehicle_drifts(tables), STREAM)
    air = seq.state_intervals(rows, STREAM, ORDER, "contact_state", 0, "time_ms", 100)
    effects = classify_effects(native_tables.vehicle_effects(tables), air, drifts, STREAM)
    local = rows.where(LOCAL).select(*STREAM).distinct()
    return Silver(rows, tables, drifts, effects, air, native_tables.action_events(files).join(local, "replay_sha"))


def classify_effects(effects: DataFrame, air: DataFrame, drifts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Effect intervals with ``semantic``: by code, and small boosts by what surrounds them in the stream of ``keys`` (the recording, if not given)."""
    key = keys or ["replay_sha"]
    small = effects.where(F.col("code") == SMALL_BOOST)
    landings = air.where("not open_end").select(*key, F.col("end_t").alias("t"))
    named = temporal.classify_context(small, air.where("validated"), landings, drifts.withColumnRenamed("group", "id"), key, "ordinal").withColumnRenamed("subtype", "semantic")
    other = effects.where(F.col("code") != SMALL_BOOST).withColumn(
        "semantic", F.when(F.col("code") == NITRO, "nitro").when(F.col("code") == MAP_PROPULSION, "map_propulsion_effect").otherwise("unknown_speed_effect")
    )
    return named.select(*effects.columns, "semantic", "drift_id").unionByName(other.withColumn("drift_id", F.lit(None).cast("long")))


def laps(rows: DataFrame) -> DataFrame:
    """Runs of one lap number with their time inside the movement window; none where any is unknown."""
    runs = seq.state_runs(rows, STREAM, ORDER, "lap_index", "time_s", refuse_null=True)
    return seq.lap_time_semantics(runs, seq.movement_window(rows, STREAM, "time_s", "speed", F.col("pose_valid")), STREAM)


def segments(s: Silver, gap_ms: float = 150, window_ms: float = 2000) -> DataFrame:
    """Analysis segments: merged drifts, with the lap of their first drift and their recovery's end."""
    merged = seq.merge_segments(s.drifts, STREAM, gap_ms)
    ended = seq.recovery_end(merged, s.effects, STREAM, s.air.where("validated"), window_ms)
    driven = s.rows.select(*STREAM, "time_ms", "lap_index")
    start = temporal.nearest(ended, driven, STREAM, "start_t", "time_ms", "lap_index")
    end = temporal.nearest(start.withColumnRenamed("near", "lap").drop("near_t"), driven, STREAM, "end_t", "time_ms", "lap_index")
    return end.withColumn("crosses_lap", F.col("near") != F.col("lap")).drop("near", "near_t")


def episodes(s: Silver) -> DataFrame:
    """One row a logical drift: speeds, effects and events inside, latency of the first boost after it."""
    key = STREAM
    d = s.drifts.withColumnRenamed("group", "drift")
    p = s.rows.select(*key, F.col("time_ms").alias("_t"), "speed", "slip", "distance", "lap_index")
    inside = temporal.range_join(p, d.select(*key, "drift", "start_t", "end_t"), key, "_t", width=2000).groupBy(*key, "drift").agg(
        F.min_by("speed", "_t").alias("entry_speed"), F.max_by("speed", "_t").alias("exit_speed"), F.min("speed").alias("min_speed"), F.max("speed").alias("max_speed"), F.avg("speed").alias("avg_speed"),
        F.max(F.abs(F.degrees("slip"))).alias("peak_slip_deg"), F.avg(F.abs(F.degrees("slip"))).alias("mean_slip_deg"), (F.max("distance") - F.min("distance")).alias("length"), F.min_by("lap_index", "_t").alias("lap"),
    )
    boosts = s.effects.where("semantic like '%boost'")
    kinds = {f"{n}_starts": F.col("semantic") == n for n in ("air_boost", "landing_boost", "drift_small_boost", "nitro")}
    out = temporal.counts_inside(d, s.effects, key, "drift", "start_t", kinds)
    out = temporal.counts_inside(out, s.actions.where("time_ms is not null"), key, "drift", "time_ms", {"events": F.lit(True)})
    out = temporal.first_after(out, boosts, key, "drift", "start_t", 2000, "first_boost_ms")
    out = out.join(inside, [*key, "drift"], "left")
    number = F.row_number().over(Window.partitionBy(*key, "lap").orderBy("start_t"))
    return out.withColumn("episode_id", F.when(F.col("lap").isNotNull(), F.format_string("L%d-D%02d", "lap", number)))


def action_semantics(s: Silver) -> DataFrame:
    """Counts of the combinations of each recording's own vehicle, withheld where the action table doesn't line up with the effects."""
    events = s.actions.where("time_ms is not null")
    counts, _ = semantics.combinations(events, STREAM)
    out = counts.join(semantics.alignment(events, s.effects, STREAM), STREAM).withColumnRenamed("allowed", "counts_allowed")
    return agg.product_statistics(out, ["cw", "wcw", "cww"])


def action_document(s: Silver) -> DataFrame:
    """The whole document of action semantics of each recording's own vehicle; see ``operators.semantics``."""
    local = s.rows.where(LOCAL).select(*STREAM).distinct()
    # effects of a table that isn't valid were never decoded
    found = s.tables.select(*STREAM, F.col("count_offset").isNotNull().alias("drift_table"), F.coalesce("effect_valid", F.lit(False)).alias("effect_table"))
    own = lambda df: df.join(local, STREAM, "left_semi")
    return semantics.action_semantics(local.join(found, STREAM), s.actions, own(s.effects), own(native_tables.vehicle_drifts(s.tables)), own(s.drifts), STREAM)


def combo_placements(s: Silver) -> DataFrame:
    """When each combination was placed, in seconds, of recordings whose counts are the game's own."""
    return semantics.placements(s.actions, action_document(s), STREAM)


def lap_table(s: Silver) -> DataFrame:
    """Figures of each lap with its drifts and boosts; NULL, not 0, for streams without native tables."""
    m = agg.lap_metrics(s.rows, [*STREAM, "role", "lap_index"], "speed", "time_s", "distance")
    e = episodes(s).groupBy(*STREAM, F.col("lap").alias("lap_index")).agg(F.count("*").alias("drifts"), (F.sum("duration") / 1000).alias("drift_s"), F.sum("drift_small_boost_starts").alias("small_boosts"))
    known = s.tables.where("count_offset is not null").select(*STREAM, F.lit(True).alias("_known"))
    j = m.join(e, [*STREAM, "lap_index"], "left").join(known, STREAM, "left")
    return j.withColumns({c: F.when(F.col("_known"), F.coalesce(c, F.lit(0))) for c in ("drifts", "drift_s", "small_boosts")}).drop("_known")


def turn_sections(rows: DataFrame, step: float = 1.0) -> DataFrame:
    """Geometric turns of each lap, with speeds, kind and efficiency."""
    keys = [*STREAM, "lap_index"]
    usable = F.col("pose_valid") & ~F.col("break_before")
    samples = seq.resample(rows, keys, ORDER, "distance", ["time_s", "x", "y", "speed"], step, usable)
    samples = seq.turn_signal(samples, keys)
    found = sections.hysteresis_sections(samples, keys)
    inside = temporal.range_join(samples, found.select(*keys, *[c for c in found.columns if c not in keys and c not in samples.columns]), keys, "at", "start_d", "end_d", width=100)
    measured = agg.section_measures(inside, [*keys, "section"], ["k"], "speed", "time_s", "at", "peak_deg", "signal")
    return found.join(measured.drop("direction", "turn_deg", "peak_deg"), [*keys, "section"])


def representative_lap(found: DataFrame, lap_times: DataFrame) -> DataFrame:
    """Of each stream the lap with the most sections, then the shortest."""
    n = found.groupBy(*STREAM, "lap_index").agg(F.count("*").alias("n_sections")).join(lap_times.select(*STREAM, "lap_index", "span"), [*STREAM, "lap_index"])
    return n.groupBy(*STREAM).agg(F.min(F.struct((-F.col("n_sections")).alias("n"), "span", "lap_index")).alias("m")).select(*STREAM, F.col("m.lap_index").alias("lap_index"))


def stream_summary(s: Silver) -> DataFrame:
    """Each stream with its role, totals, sample rate and states, and what became of its native table."""
    totals = agg.stream_totals(s.rows, [*STREAM, "role"], "time_s", "distance", "speed", ["contact_state", "lap_index"])
    rate = agg.sample_rate(s.rows, STREAM, ORDER, "time_ms").select(*STREAM, "step_ms", "hz")
    table = s.tables.select(*STREAM, F.col("status").alias("table_status"), "count_offset", "matches", "share", "retriggers", "outside", "eligible", "refused")
    return totals.join(rate, STREAM, "left").join(table, STREAM, "left")


def training_sections(s: Silver) -> DataFrame:
    """Turns of every lap, with what happened in each and whether its lap is the stream's representative one.

    ``drifts``, ``boosts`` and ``nitros`` count those that begin within the turn's time; they are NULL, not 0, for a
    stream without a native table.
    """
    found = turn_sections(s.rows)
    keys = [*STREAM, "lap_index"]
    times = s.rows.where("lap_index is not null").groupBy(*keys).agg((F.max("time_s") - F.min("time_s")).alias("span"))
    best = representative_lap(found, times).withColumn("representative", F.lit(True))
    at = s.rows.select(*keys, "time_ms", F.col("distance").alias("_d"))
    inside = temporal.range_join(at, found.select(*keys, "section", "start_d", "end_d"), keys, "_d", "start_d", "end_d", width=100)
    spans = inside.groupBy(*keys, "section").agg(F.min("time_ms").alias("start_t"), F.max("time_ms").alias("end_t"))
    starts = s.drifts.select(*STREAM, F.col("start_t").alias("t"), F.lit("drift").alias("what")).union(s.effects.select(*STREAM, "start_t", F.when(F.col("code") == SMALL_BOOST, "boost").when(F.col("code") == NITRO, "nitro").otherwise("other")))
    spans = spans.withColumn("_id", F.concat_ws("/", "lap_index", "section"))
    counted = temporal.counts_inside(spans, starts, STREAM, "_id", "t", {n: F.col("what") == n for n in ("drift", "boost", "nitro")}).drop("_id")
    known = s.tables.select(*STREAM, F.col("count_offset").isNotNull().alias("_known"))
    out = found.join(counted, [*keys, "section"], "left").join(known, STREAM, "left").join(best, keys, "left")
    counts = {f"{n}s": F.when(F.col("_known"), F.coalesce(n, F.lit(0))) for n in ("drift", "boost", "nitro")}
    return out.withColumns(counts | {"representative": F.coalesce("representative", F.lit(False))}).drop("_known", "drift", "boost", "nitro")


def documents(s: Silver) -> DataFrame:
    """One nested document a recording: streams, laps, segments, episodes, sections and action semantics."""
    pack = lambda df, name: df.groupBy("replay_sha").agg(F.collect_list(F.struct(*[c for c in df.columns if c != "replay_sha"])).alias(name))
    out = s.rows.select("replay_sha").distinct()
    for name, df in (("streams", stream_summary(s)), ("laps", lap_table(s)), ("segments", segments(s)), ("episodes", episodes(s)), ("sections", training_sections(s))):
        out = out.join(pack(df, name), "replay_sha", "left")
    told = action_document(s)
    one = told.select("replay_sha", F.struct(*[c for c in told.columns if c != "replay_sha"]).alias("actions"))
    return out.join(one, "replay_sha", "left").withColumns({"contract": F.lit(CONTRACT), "schema_version": F.lit(1)})


def rebuild_documents(catalog: Catalog, files: DataFrame, out: str, buckets: int = BUCKETS, force: bool = False) -> DataFrame:
    """The documents of all visible, active recordings ``files`` (``replay_sha, content``) below ``out``, bucket by bucket; see ``rebuild``.

    Recordings whose documents were made count as analysed in the catalog from then on.
    """
    report = rebuild(files.sparkSession, catalog, files, lambda some: documents(silver(some)), out, CONTRACT, buckets, force)
    if report.where("status = 'rebuilt'").head(1):
        made = files.sparkSession.read.parquet(f"{out}/data").select("replay_sha")
        catalog.mark_analysed(made)
    return report
