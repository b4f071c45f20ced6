"""What the action events of a stream come to: combinations, boosts and their evidence, behind one gate.

A count is given as the game's own only where the action table lines up with the effect table; raw
counts stay in any case. A table that was never decoded gives NULL, an empty one 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import aggregates as agg
from . import matching, temporal

#: Effect codes, action codes, the codes that must fall on small boosts, and the figures of the gate.
NITRO, SMALL_BOOST = 1.0, 2001.0
AIR, LANDING, WCW, MARKER, CW = 8, 9, 19, 24, 25
ANCHOR_CODES = (2, 8, 9, 18, 19, 20, 24)
TOLERANCE_MS, PAIR_MS, LEAST_RATE = 2, 500, 0.5
NO_ANCHORS, NO_EFFECTS = "not_applicable_no_anchor_code_events", "not_applicable_no_code2001_effect_intervals"
UNAVAILABLE, UNVALIDATED, READY = "native_action_event_table_unavailable", "production_semantics_variant_unvalidated", "production_semantics_ready"


def alignment(events: DataFrame, effects: DataFrame, keys: Sequence[str], tolerance: float = TOLERANCE_MS) -> DataFrame:
    """Per stream with an event or a small boost: how many anchor-code events begin a small boost, and whether counts may be given.

    Columns: ``anchor_events, aligned_events, rate, boosts, gate, allowed``. Without anchor events or
    without small boosts the gate doesn't apply, and counts are allowed.
    """
    anchors = events.where(F.col("action_code").isin(*ANCHOR_CODES)).select(*keys, F.col("time_ms").alias("t"))
    boosts = effects.where(F.col("code") == SMALL_BOOST).select(*keys, "start_t")
    near = temporal.near_any(anchors, boosts, keys, "t", "start_t", tolerance)
    tally = lambda df, n: df.groupBy(*keys).agg(F.count("*").alias(n))
    out = events.select(*keys).union(boosts.select(*keys)).distinct()
    for df, n in ((anchors, "anchor_events"), (near, "aligned_events"), (boosts, "boosts")):
        out = out.join(tally(df, n), list(keys), "left").withColumn(n, F.coalesce(n, F.lit(0)))
    out = out.withColumn("rate", F.when(F.col("anchor_events") > 0, F.round(F.col("aligned_events") / F.col("anchor_events"), 6)))
    gate = F.when(F.col("anchor_events") == 0, NO_ANCHORS).when(F.col("boosts") == 0, NO_EFFECTS).when(F.col("rate") < LEAST_RATE, "variant_mismatch").otherwise("aligned")
    return out.withColumns({"gate": gate, "allowed": gate != "variant_mismatch"})


def combinations(events: DataFrame, keys: Sequence[str], tolerance: float = PAIR_MS) -> tuple[DataFrame, DataFrame]:
    """Counts of the three combinations of each stream, and the events that are evidence of one.

    Counts: ``n24, n19, n25, cw, standalone, wcw, cww, consumed, consistent, adjacent``. ``cw`` is a code-25 event
    paired with the nearest free marker, no marker or code 19 between them; ``wcw`` a code-19 event; the
    markers left after both are ``cww``, the last ones by index. ``adjacent`` counts the code-19 events next to a
    marker by index. Evidence: ``kind, record_index, t``, the paired marker for ``cw``.
    """
    code = F.col("action_code")
    pairs = matching.greedy_pairs(events, keys, "record_index", "time_ms", code == CW, code == MARKER, code.isin(MARKER, WCW), tolerance)
    paired = pairs.groupBy(*keys).agg(F.count("right_index").alias("cw"), F.count_if(F.col("right_index").isNull()).alias("standalone"))
    w = Window.partitionBy(*keys).orderBy("record_index")
    beside = lambda f: F.coalesce((f("action_code").over(w) == MARKER) & (F.abs(f("record_index").over(w) - F.col("record_index")) == 1), F.lit(False))
    flagged = events.withColumn("_beside", beside(F.lag) | beside(F.lead))
    counts = flagged.groupBy(*keys).agg(
        *[F.count_if(code == c).alias(n) for n, c in (("n24", MARKER), ("n19", WCW), ("n25", CW))], F.count_if((code == WCW) & F.col("_beside")).alias("adjacent")
    ).join(paired, list(keys), "left")
    counts = agg.marker_accounting(counts.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("cw", "standalone")}))

    markers = events.where(code == MARKER).withColumn("_n", F.row_number().over(w)).join(counts.select(*keys, (F.col("cw") + F.col("consumed")).alias("_skip")), list(keys))
    one = lambda df, kind, index, t: df.select(*keys, F.lit(kind).alias("kind"), F.col(index).cast("long").alias("record_index"), F.col(t).cast("double").alias("t"))
    evidence = one(pairs.where("right_index is not null"), "cw", "right_index", "right_t")
    evidence = evidence.union(one(events.where(code == WCW), "wcw", "record_index", "time_ms")).union(one(markers.where("_n > _skip"), "cww", "record_index", "time_ms"))
    return counts, evidence


def code_matrix(events: DataFrame, effects: DataFrame, drifts: DataFrame, keys: Sequence[str], tolerance: float = TOLERANCE_MS) -> DataFrame:
    """Per stream and action code: events, and how many are near a small boost's, a nitro's or a drift's start, a drift's end, a marker, an air or a landing event."""
    at = lambda df, kind, t: df.select(*keys, F.lit(kind).alias("kind"), (F.col(t) - tolerance).alias("_lo"), (F.col(t) + tolerance).alias("_hi"))
    anchors = {
        "on_code2001_start": (effects.where(F.col("code") == SMALL_BOOST), "start_t"), "on_code1_start": (effects.where(F.col("code") == NITRO), "start_t"),
        "on_drift_start": (drifts, "start_t"), "on_drift_end": (drifts, "end_t"),
        **{f"on_code{c}": (events.where(F.col("action_code") == c), "time_ms") for c in (MARKER, AIR, LANDING)},
    }
    rows = None
    for kind, (df, t) in anchors.items():
        rows = at(df, kind, t) if rows is None else rows.union(at(df, kind, t))
    width = 2 * tolerance if tolerance > 0 else 1
    e = events.select(*keys, "action_code", "record_index", F.col("time_ms").alias("_t"))
    hits = temporal.range_join(e, rows, keys, "_t", "_lo", "_hi", width).select(*keys, "action_code", "record_index", "kind").distinct()
    near = hits.groupBy(*keys, "action_code").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in anchors])
    total = events.groupBy(*keys, "action_code").agg(F.count("*").alias("count"))
    return total.join(near, [*keys, "action_code"], "left").withColumns({k: F.coalesce(k, F.lit(0)) for k in anchors})


def action_semantics(streams: DataFrame, actions: DataFrame, effects: DataFrame, drifts: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One document a stream of ``streams`` (keys, ``drift_table, effect_table``: whether each was decoded).

    ``actions`` are ``record_index, time_ms, action_code`` (rows without a time say that a table is missing),
    ``effects`` ``ordinal, code, start_t``, ``drifts`` raw intervals and ``groups`` their logical ones with ``members``. Fields:
    ``status, game_facing``; ``alignment``; ``histogram``; ``air_boost, landing_boost`` and ``combo.cw, wcw, cww``, which are
    NULL unless the gate allows them, beside the raw ``combo.n24`` and so on; ``drift``, ``small_boost`` with the
    boosts that an air, landing or marker event begins, ``nitro``; ``unknown_codes`` and the evidence
    ``matrix`` by code. A group is one recording's stream: lists in it are those of its codes.
    """
    keys = list(keys)
    events = actions.where("time_ms is not null")
    gate = alignment(events, effects, keys)
    counts, _ = combinations(events, keys)
    codes = events.groupBy(*keys, "action_code").agg(F.count("*").alias("n"))
    code = F.col("action_code")
    told = codes.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(code.cast("string").alias("key"), F.col("n").alias("value"))))).alias("histogram"),
        F.sum("n").alias("n_events"), *[F.coalesce(F.max(F.when(code == c, F.col("n"))), F.lit(0)).alias(n) for n, c in (("_air", AIR), ("_landing", LANDING))],
        F.array_sort(F.collect_list(F.when(~code.isin(AIR, LANDING, WCW, MARKER, CW), F.struct("action_code", F.col("n").alias("count"))))).alias("unknown_codes"),
    )
    boosts = effects.where(F.col("code") == SMALL_BOOST).select(*keys, "ordinal", "start_t")
    kinds = {"air_anchored": AIR, "landing_anchored": LANDING, "combo_anchored": MARKER}
    anchored = temporal.anchored_buckets(boosts, {n: events.where(code == c).select(*keys, F.col("time_ms").alias("t")) for n, c in kinds.items()}, keys, "ordinal", "start_t", TOLERANCE_MS)
    boost = anchored.groupBy(*keys).agg(F.count("*").alias("_raw"), *[F.count_if(n).alias(f"_{n}") for n in kinds], F.count_if("any_anchor").alias("_classified"))
    nitro = effects.where(F.col("code") == NITRO).groupBy(*keys).agg(F.count("*").alias("_nitro"))
    raw = drifts.groupBy(*keys).agg(F.count("*").alias("_drifts"))
    logical = groups.groupBy(*keys).agg(F.count("*").alias("_logical"), F.count_if(F.col("members") > 1).alias("_merged"))
    matrix = code_matrix(events, effects, drifts, keys)
    matrix = matrix.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[c for c in matrix.columns if c not in keys]))).alias("matrix"))

    out = streams.select(*keys, "drift_table", "effect_table")
    for df in (gate, counts, told, boost, nitro, raw, logical, matrix):
        out = out.join(df, keys, "left")
    known = F.col("n_events").isNotNull()
    facing = known & F.coalesce("allowed", F.lit(True))
    shown = lambda c, n: F.when(facing, F.coalesce(c, F.lit(0))).alias(n)
    held = lambda c, n, table: F.when(F.col(table), F.coalesce(c, F.lit(0))).alias(n)

    def counted(c: str) -> Column:
        return F.when(known, F.coalesce(c, F.lit(0))).alias(c)

    return out.select(
        *keys, F.when(~known, UNAVAILABLE).when(facing, READY).otherwise(UNVALIDATED).alias("status"), facing.alias("game_facing"),
        F.struct(F.coalesce("gate", F.lit(NO_ANCHORS)).alias("status"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("anchor_events", "aligned_events", "boosts")], "rate").alias("alignment"),
        "histogram", shown("_air", "air_boost"), shown("_landing", "landing_boost"),
        F.struct(shown("cw", "cw"), shown("wcw", "wcw"), shown("cww", "cww"), *[counted(c) for c in ("n24", "n19", "n25", "standalone", "adjacent")], F.when(known, F.col("consistent")).alias("consistent")).alias("combo"),
        F.struct(held("_drifts", "raw_intervals", "drift_table"), held("_logical", "logical_count", "drift_table"), held("_merged", "merged_groups", "drift_table")).alias("drift"),
        F.struct(
            held("_raw", "raw_count", "effect_table"), *[held(f"_{n}", n, "effect_table") for n in kinds], held("_classified", "classified", "effect_table"),
            F.when(F.col("effect_table"), F.coalesce(F.col("_raw") - F.col("_classified"), F.lit(0))).alias("unresolved"),
        ).alias("small_boost"),
        held("_nitro", "nitro", "effect_table"), "unknown_codes", "matrix",
    )


def placements(actions: DataFrame, semantics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Times in seconds of the combinations, ``keys, kind, ordinal, t``, of streams whose counts are the game's own; none of the others."""
    keys = list(keys)
    _, evidence = combinations(actions.where("time_ms is not null"), keys)
    seen = evidence.join(semantics.where("game_facing").select(*keys), keys)
    order = Window.partitionBy(*keys, "kind").orderBy("t", "record_index")
    return seen.select(*keys, "kind", (F.row_number().over(order) - 1).alias("ordinal"), (F.col("t") / 1000).alias("t"))
