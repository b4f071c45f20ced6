"""Queries of recordings and their native tables: decoding, states, tables of vehicles, action semantics, meshes, the cache."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.scalar import round_even
from .operators import comparison, meshes, semantics
from .operators import sequences as seq
from .plans import native_cache
from .registry import events, query
from .sources import maps, native_tables, recordings, synthetic
from .storage import kept

U = ["user_id"]
LAYOUT_NAMES = ("2026", "2025", "2021")


@lru_cache(maxsize=512)
def _cars(layout: str, scale: float, yaw: float) -> bytes:
    """The two vehicles of a recording; users share some 360 such pairs, 26 MB."""
    more = {"2026": {"second_phase": recordings.ALIAS_PHASE, "second_shift": 3.0}, "2025": {"second_phase": 100}, "2021": {}}[layout]
    wave = 0.0 if layout == "2021" else 2.0
    cars = [
        synthetic.vehicle_records(240, 17, 0, scale, layout=layout, wave=wave, yaw=yaw, presses=[(20, 24), (60, 70), (120, 130)], **more),
        synthetic.vehicle_records(120, 50, 30, 0.5, 40.0, layout=layout, wave=wave, presses=[(10, 12), (50, 55), (90, 95)]),
    ]
    gap = b"\xff" * 512
    return b"".join(c + gap for c in cars)


def _recording(u: int) -> bytes:
    """A container of user ``u``: two vehicles in one of three layouts, toggle tables of which up to three are marked, an action table.

    The vehicles of 2026 have a second pose within their records, the first of 2025 the same path twice. Marked tables begin
    with the drift key of the second vehicle or the first, or with neither; some are left out.
    """
    layout, m = LAYOUT_NAMES[u % 3], u % 30
    scale = 0.25 if layout == "2021" else 0.2 + u % 25 / 100
    effects = lambda t: synthetic.effect_table([(t, 1, 2001.0), (t + 300, 0, 2001.0), (t + 3000, 1, 1.0), (t + 3100, 0, 1.0)])
    tables = [synthetic.toggle_table([(100, 500), (600, 1000 + m)], marked=False) + synthetic.effect_table([] if u % 2 == 0 else [(1, 1, 1.0)])]
    if u % 7:
        tables.append(synthetic.toggle_table([(1500, 1800), (3300, 3600), (5000 + m, 5400)]) + effects(5850))
        if u % 5:
            tables.append(synthetic.toggle_table([(530 - m, 900), (2530 - m, 2900), (4530, 4900)]) + effects(5950))
    tables.append(synthetic.toggle_table([(340 + m, 700), (1020 + m, 1400), (2040 + m, 2400)]) + effects(6050 + m))
    actions = synthetic.action_table([1000, 1283, 2000 + m, 6000], [24, 25, 19, 24])
    return _cars(layout, scale, u % 7 / 10) + b"".join(t + b"\xff" * 64 for t in tables) + actions


def _recordings(spark: SparkSession, d: str) -> DataFrame:
    """Synthetic recordings, one for each user of the events, made in tasks; what reads them twice keeps them.

    The users are dealt by a hash over a fixed number of tasks: dealt as they stand, their ids would be merged into
    one task, as their few bytes say nothing of the files made of them.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for u in batch.column("user_id").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([f"sha{u:05d}"]), pa.array([_recording(u)], pa.binary())], names=["replay_sha", "content"])

    users = spark.read.parquet(f"{d}/events.parquet").select("user_id").where("user_id is not null").distinct()
    spread = users.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("user_id"))
    return spread.mapInArrow(make, "replay_sha string, content binary")


_USERS_SQL = "u AS (SELECT DISTINCT user_id AS u, user_id % 3 AS layout, user_id % 30 AS m, printf('sha%05d', user_id) AS replay_sha FROM ev)"

#: Tables of each recording in the order of their bytes, with the score of their structure; ``kind`` 1 and 2 begin with the drift key of vehicle 0 and 1.
_TABLES_SQL = _USERS_SQL + """, k AS (SELECT u.*, kind, place, marked, effects FROM u, (VALUES (0, 0, 0, 0), (3, 1, 1, 4), (2, 2, 1, 4), (1, 3, 1, 4)) AS x(kind, place, marked, effects)
  WHERE kind IN (0, 1) OR (u % 7 <> 0 AND (kind = 3 OR u % 5 <> 0))),
t AS (SELECT *, kind <> 0 OR u % 2 = 0 AS eligible, CASE WHEN kind = 0 THEN 2 ELSE 3 END AS n FROM k),
s AS (SELECT t.*, stream, CASE WHEN layout = 0 AND kind = stream + 1 THEN 3 ELSE 0 END AS matches FROM t, (VALUES (0), (1)) AS v(stream) WHERE eligible),
r AS (SELECT *, 250000 * marked + 10000 * effects + 1000 * matches + 100.0 * matches / n + n AS score FROM s),
a AS (SELECT u, 0 AS stream, arg_max(place, (score, -place)) AS place FROM r WHERE stream = 0 GROUP BY u),
b AS (SELECT r.u, 1 AS stream, arg_max(r.place, (score, -r.place)) AS place FROM r JOIN a ON a.u = r.u WHERE r.stream = 1 AND r.place <> a.place GROUP BY r.u),
v AS (SELECT u.*, stream FROM u, (VALUES (0), (1)) AS x(stream)), ab AS (SELECT * FROM a UNION ALL SELECT * FROM b), c AS (SELECT v.*, place FROM v LEFT JOIN ab USING (u, stream)),
f AS (SELECT c.*, r.kind, r.n, r.matches FROM c LEFT JOIN r USING (u, stream, place))"""

_TOLD_SQL = """i AS (SELECT f.*, ordinal, CASE kind WHEN 0 THEN list_value(100, 600) WHEN 1 THEN list_value(340 + m, 1020 + m, 2040 + m) WHEN 2 THEN list_value(530 - m, 2530 - m, 4530) ELSE list_value(1500, 3300, 5000 + m) END[ordinal + 1] AS start_t,
  CASE kind WHEN 0 THEN list_value(500, 1000 + m) WHEN 1 THEN list_value(700, 1400, 2400) WHEN 2 THEN list_value(900, 2900, 4900) ELSE list_value(1800, 3600, 5400) END[ordinal + 1] AS end_t
  FROM f, (VALUES (0), (1), (2)) AS o(ordinal) WHERE ordinal < n)"""


@query(_USERS_SQL + """ SELECT replay_sha, stream, list_value('2026', '2025', '2021')[layout + 1] AS profile, n_rows, last_ms, CASE WHEN layout < 2 THEN 11.765 WHEN stream = 0 THEN 14.706 ELSE 10.0 END AS speed,
  CASE WHEN layout = 0 THEN 2 END AS laps, CASE WHEN layout = 0 THEN 5 * n_rows END AS contact, CASE WHEN layout = 0 THEN pressed END AS pressed,
  round_even((CASE WHEN stream = 1 THEN 0.0 ELSE u % 7 / 10 END) * 1000, 0) / 1000 AS yaw, round_even((CASE WHEN stream = 1 THEN 99.5 WHEN layout = 2 THEN 59.75 ELSE (0.2 + u % 25 / 100) * 239 END) * 1000, 0) / 1000 AS last_x
FROM u, (VALUES (0, 240, 4063, 24), (1, 120, 5980, 12)) AS s(stream, n_rows, last_ms, pressed)""")
def sav_decode(spark: SparkSession, d: str) -> DataFrame:
    r = kept(_recordings(spark, d))
    found = kept(recordings.streams(recordings.stream_candidates(r)))
    rows = recordings.telemetry(recordings.decode(r, found))
    out = rows.groupBy("replay_sha", "stream").agg(
        F.count("*").alias("n_rows"), F.max("time_ms").alias("last_ms"), F.round(F.avg("speed"), 3).alias("speed"), F.max("lap_index").alias("laps"), F.sum("contact_state").alias("contact"),
        F.sum(F.col("input_64").cast("int")).alias("pressed"), round_even(F.avg("yaw"), 3).alias("yaw"), round_even(F.max_by("x", "i"), 3).alias("last_x"),
    )
    return out.join(found.select("replay_sha", "stream", "profile"), ["replay_sha", "stream"])


@query(_USERS_SQL + """, l AS (SELECT c, stream, n, i, (i + c) % 23 < 4 AS down, i > 0 AND ((i + c) % 23 < 4) <> ((i - 1 + c) % 23 < 4) AS changed
  FROM (VALUES (0), (1), (2), (3), (5)) AS l(c), (VALUES (0, 240), (1, 120)) AS s(stream, n), generate_series(0, 239) AS g(i) WHERE i < n),
g AS (SELECT stream, 60 + c AS lane, count(*) FILTER (changed) AS changes, count(*) FILTER (down) AS down FROM l GROUP BY stream, c)
SELECT replay_sha, stream, lane, changes, 0 AS low, 1 AS high, down FROM u, g WHERE layout = 0""")
def state_bytes(spark: SparkSession, d: str) -> DataFrame:
    r = kept(_recordings(spark, d))
    found = recordings.streams(recordings.stream_candidates(r))
    lanes = recordings.discover_states(r, found)
    return lanes.select("replay_sha", "stream", "lane", "changes", F.array_min("states").alias("low"), F.array_max("states").alias("high"), F.element_at("counts", -1).alias("down"))


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    """The vehicles of every recording with their tables, of one pass over the contents."""
    candidates, tables, rises = native_tables.scan_files(_recordings(spark, d), input_lane=4)
    found = kept(recordings.streams(candidates))
    rises = rises.join(found.select("replay_sha", "profile", "start_byte", "stream"), ["replay_sha", "profile", "start_byte"]).select("replay_sha", "stream", "t")
    vehicles = found.select("replay_sha", "stream", F.col("stream").alias("shadow"))  # the first vehicle has the higher rate
    return native_tables.assign_tables(kept(tables), vehicles, kept(rises))


@query(_TABLES_SQL + ", " + _TOLD_SQL + """, e AS (SELECT u, count(*) AS n_tables, count(*) FILTER (eligible) AS n_eligible FROM t GROUP BY u),
p AS (SELECT u, stream, t AS rise FROM u, (VALUES (0, 340), (0, 1020), (0, 2040), (1, 530), (1, 2530), (1, 4530)) AS x(stream, t) WHERE layout = 0),
q AS (SELECT p.*, coalesce(bool_or(abs(rise - start_t) <= 34), false) AS at_start, coalesce(bool_or(rise >= start_t AND rise < end_t), false) AS inside FROM p LEFT JOIN i USING (u, stream) GROUP BY ALL),
o AS (SELECT u, stream, count(*) AS n_rises, count(*) FILTER (inside AND NOT at_start) AS retriggers, count(*) FILTER (NOT inside AND NOT at_start) AS outside FROM q GROUP BY ALL)
SELECT replay_sha, stream, CASE WHEN kind IS NOT NULL THEN 'replay_native_drift_table_validated' ELSE 'native_action_object_drift_table_not_validated' END AS status,
  CASE kind WHEN 0 THEN 100 WHEN 1 THEN 340 + m WHEN 2 THEN 530 - m WHEN 3 THEN 1500 END AS first_start, n AS intervals, matches, coalesce(n_rises, 0) AS n_rises,
  CASE WHEN kind IS NOT NULL THEN coalesce(retriggers, 0) END AS retriggers, CASE WHEN kind IS NOT NULL THEN coalesce(outside, 0) END AS outside, n_eligible - stream AS eligible, n_tables - n_eligible AS refused
FROM f JOIN e USING (u) LEFT JOIN o USING (u, stream)""")
def vehicle_tables(spark: SparkSession, d: str) -> DataFrame:
    a = _assigned(spark, d)
    return a.select("replay_sha", "stream", "status", F.get("intervals", F.lit(0))[0].alias("first_start"), F.col("n").alias("intervals"), "matches", "n_rises", "retriggers", "outside", "eligible", "refused")


@query(_TABLES_SQL + ", " + _TOLD_SQL + " SELECT replay_sha, stream, ordinal, start_t, end_t FROM i")
def drift_table_decode(spark: SparkSession, d: str) -> DataFrame:
    return native_tables.vehicle_drifts(_assigned(spark, d))


@query(_TABLES_SQL + """ SELECT replay_sha, stream, ordinal, code, code_bits, began + a AS start_t, began + b AS end_t, b - a AS duration
FROM (SELECT *, CASE kind WHEN 1 THEN 6050 + m WHEN 2 THEN 5950 ELSE 5850 END AS began FROM f WHERE kind > 0), (VALUES (0, 2001.0::DOUBLE, 1157242880, 0, 300), (1, 1.0::DOUBLE, 1065353216, 3000, 3100)) AS s(ordinal, code, code_bits, a, b)""")
def effect_table_decode(spark: SparkSession, d: str) -> DataFrame:
    return native_tables.vehicle_effects(_assigned(spark, d))


@query(_USERS_SQL + """ SELECT replay_sha, record_index, t + moves * m AS time_ms, action_code
FROM u, (VALUES (0, 1000, 24, 0), (1, 1283, 25, 0), (2, 2000, 19, 1), (3, 6000, 24, 0)) AS s(record_index, t, action_code, moves)""")
def action_table_decode(spark: SparkSession, d: str) -> DataFrame:
    return native_tables.action_events(_recordings(spark, d)).select("replay_sha", "record_index", "time_ms", "action_code")


def greedy_sql(left: str, right: str, wall: str, tolerance: float) -> str:
    """Common tables up to ``pairs`` of ``matching.greedy_pairs`` over a table ``src (user_id, i, t, c)``; conditions are on ``c``."""
    return f"""s AS (SELECT *, {left} AS is_left, {right} AS is_right, count(*) FILTER ({wall}) OVER (PARTITION BY user_id ORDER BY i) AS upto, count(*) FILTER ({wall}) OVER (PARTITION BY user_id ORDER BY i) - CAST({wall} AS INTEGER) AS before FROM src),
l0 AS (SELECT a.user_id, a.i, a.t, a.upto, a.before, min(abs(b.t - a.t)) AS nearest FROM s a LEFT JOIN s b ON b.user_id = a.user_id AND b.is_right WHERE a.is_left GROUP BY ALL),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY nearest NULLS LAST, i) AS n FROM l0),
c AS (SELECT l.user_id, l.n, l.i, l.t, list(struct_pack(d := abs(b.t - l.t), i := b.i, t := b.t) ORDER BY abs(b.t - l.t), b.i) FILTER (b.i IS NOT NULL) AS near
  FROM l LEFT JOIN s b ON b.user_id = l.user_id AND b.is_right AND abs(b.t - l.t) <= {tolerance} AND CASE WHEN b.i > l.i THEN b.before - l.upto ELSE l.before - b.upto END = 0 GROUP BY ALL),
g AS (SELECT DISTINCT user_id, 0::BIGINT AS n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS STRUCT(d DOUBLE, i BIGINT, t DOUBLE)) AS pick FROM l
  UNION ALL SELECT user_id, n, CASE WHEN p IS NULL THEN used ELSE list_append(used, p.i) END, p
  FROM (SELECT g.user_id, c.n, g.used, list_filter(coalesce(c.near, []), lambda x: NOT list_contains(g.used, x.i))[1] AS p FROM g JOIN c ON c.user_id = g.user_id AND c.n = g.n + 1)),
pairs AS (SELECT user_id, c.i AS left_index, c.t AS left_t, pick.i AS right_index, pick.t AS right_t, pick.d AS distance FROM g JOIN c USING (user_id, n))"""


#: Action and effect tables of users: of every third one the effects begin off the actions, of another third there are none.
_ACTIONS_SQL = (
    "RECURSIVE a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, CAST(t // 36000000 AS DOUBLE) AS t, list_value(24, 25, 19, 8, 9, 40)[k % 6 + 1] AS c, event_type, k FROM ev), "
    "src AS (SELECT user_id, i, t, c FROM a WHERE user_id % 11 <> 0), " + greedy_sql("c = 25", "c = 24", "c IN (24, 19)", 500) + """,
fx AS (SELECT user_id, CASE WHEN event_type <> 'error' THEN 2001 ELSE 1 END AS code, t + CASE WHEN user_id % 3 = 1 THEN 7 ELSE 0 END AS start_t, event_id FROM a WHERE user_id % 3 < 2),
dr AS (SELECT user_id, t AS start_t, t + 200 AS end_t, 1 + k % 2 AS members FROM a WHERE event_type = 'purchase'),
st AS (SELECT DISTINCT user_id FROM a),
al AS (SELECT user_id, count(*) FILTER (c IN (24, 19, 8, 9)) AS anchor_events, count(*) FILTER (c IN (24, 19, 8, 9) AND EXISTS (SELECT 1 FROM fx WHERE fx.user_id = src.user_id AND code = 2001 AND abs(start_t - src.t) <= 2)) AS aligned_events FROM src GROUP BY user_id),
bo AS (SELECT user_id, count(*) FILTER (code = 2001) AS boosts, count(*) FILTER (code = 1) AS nitros, count(*) FILTER (code = 2001 AND EXISTS (SELECT 1 FROM src WHERE src.user_id = fx.user_id AND c IN (8, 9, 24) AND abs(start_t - src.t) <= 2)) AS classified FROM fx GROUP BY user_id),
ga AS (SELECT user_id, coalesce(anchor_events, 0) AS anchor_events, coalesce(aligned_events, 0) AS aligned_events, coalesce(boosts, 0) AS boosts, anchor_events IS NOT NULL AS known,
  CASE WHEN coalesce(anchor_events, 0) = 0 THEN 'not_applicable_no_anchor_code_events' WHEN coalesce(boosts, 0) = 0 THEN 'not_applicable_no_code2001_effect_intervals' WHEN aligned_events / anchor_events < 0.5 THEN 'variant_mismatch' ELSE 'aligned' END AS gate
  FROM st LEFT JOIN al USING (user_id) LEFT JOIN bo USING (user_id)),
tally AS (SELECT user_id, count(*) FILTER (c = 24) AS n24, count(*) FILTER (c = 19) AS n19, count(*) FILTER (c = 8) AS air, count(*) FILTER (c = 40) AS unknown FROM src GROUP BY user_id),
cw AS (SELECT user_id, count(right_index) AS cw, count(*) - count(right_index) AS standalone FROM pairs GROUP BY user_id),
co AS (SELECT user_id, n24, n19, air, unknown, coalesce(cw, 0) AS cw, coalesce(standalone, 0) AS standalone, least(n19, greatest(0, n24 - coalesce(cw, 0))) AS consumed FROM tally LEFT JOIN cw USING (user_id)),
ad AS (SELECT user_id, count(*) FILTER (c = 19 AND (coalesce(c0, 0) = 24 OR coalesce(c1, 0) = 24)) AS adjacent FROM (SELECT *, lag(c) OVER w AS c0, lead(c) OVER w AS c1 FROM src WINDOW w AS (PARTITION BY user_id ORDER BY i)) GROUP BY user_id),
dd AS (SELECT user_id, count(*) AS drifts, count(*) FILTER (members > 1) AS merged FROM dr GROUP BY user_id)"""
)


def _actions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Streams, actions, effects, drifts and their groups of the users, in units of 36 seconds."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    code = F.array(*[F.lit(c).cast("long") for c in (24, 25, 19, 8, 9, 40)])[F.col("k") % 6]
    e = events(spark, d).select("user_id", "event_id", (F.row_number().over(w) - 1).alias("record_index"), F.expr("t div 36000000").alias("time_ms"), code.alias("action_code"), "event_type", "k")
    user = F.col("user_id")
    shift = F.when(user % 3 == 1, 7).otherwise(0)
    effects = e.where(user % 3 < 2).select("user_id", F.col("event_id").alias("ordinal"), F.when(F.col("event_type") != "error", 2001.0).otherwise(1.0).alias("code"), (F.col("time_ms") + shift).alias("start_t"))
    drifts = e.where("event_type = 'purchase'").select("user_id", F.col("time_ms").alias("start_t"), (F.col("time_ms") + 200).alias("end_t"), (1 + F.col("k") % 2).alias("members"))
    streams = e.select("user_id").distinct().withColumns({"drift_table": user % 4 != 0, "effect_table": user % 5 != 0})
    return streams, e.where(user % 11 != 0), effects, drifts, drifts


@query(_ACTIONS_SQL + """
SELECT user_id, CASE WHEN NOT known THEN 'native_action_event_table_unavailable' WHEN gate <> 'variant_mismatch' THEN 'production_semantics_ready' ELSE 'production_semantics_variant_unvalidated' END AS status,
  known AND gate <> 'variant_mismatch' AS game_facing, gate, anchor_events, aligned_events, boosts, CASE WHEN known AND gate <> 'variant_mismatch' THEN cw END AS cw, CASE WHEN known AND gate <> 'variant_mismatch' THEN n19 END AS wcw,
  CASE WHEN known AND gate <> 'variant_mismatch' THEN n24 - cw - consumed END AS cww, CASE WHEN known AND gate <> 'variant_mismatch' THEN air END AS air_boost, n24, n19, standalone, adjacent, cw + n19 + (n24 - cw - consumed) = n24 AS consistent,
  CASE WHEN user_id % 4 <> 0 THEN coalesce(drifts, 0) END AS raw_drifts, CASE WHEN user_id % 4 <> 0 THEN coalesce(merged, 0) END AS merged, CASE WHEN user_id % 5 <> 0 THEN boosts END AS raw_boosts,
  CASE WHEN user_id % 5 <> 0 THEN coalesce(classified, 0) END AS classified, CASE WHEN user_id % 5 <> 0 THEN boosts - coalesce(classified, 0) END AS unresolved, CASE WHEN user_id % 5 <> 0 THEN coalesce(nitros, 0) END AS nitro,
  CASE WHEN unknown > 0 THEN unknown END AS unknown_40
FROM ga LEFT JOIN co USING (user_id) LEFT JOIN ad USING (user_id) LEFT JOIN dd USING (user_id) LEFT JOIN (SELECT user_id, nitros, classified FROM bo) AS nb USING (user_id)""")
def action_semantics(spark: SparkSession, d: str) -> DataFrame:
    s = semantics.action_semantics(*_actions(spark, d), U)
    return s.select(
        "user_id", "status", "game_facing", F.col("alignment.status").alias("gate"), "alignment.anchor_events", "alignment.aligned_events", "alignment.boosts", "combo.cw", "combo.wcw", "combo.cww", "air_boost",
        "combo.n24", "combo.n19", "combo.standalone", "combo.adjacent", "combo.consistent", F.col("drift.raw_intervals").alias("raw_drifts"), F.col("drift.merged_groups").alias("merged"),
        F.col("small_boost.raw_count").alias("raw_boosts"), "small_boost.classified", "small_boost.unresolved", "nitro", F.get("unknown_codes", F.lit(0))["count"].alias("unknown_40"),
    )


@query(_ACTIONS_SQL + """,
mk AS (SELECT user_id, i, t, row_number() OVER (PARTITION BY user_id ORDER BY i) AS n FROM src WHERE c = 24),
ok AS (SELECT user_id FROM ga WHERE known AND gate <> 'variant_mismatch'),
ec AS (SELECT user_id, 'cw' AS kind, right_index AS i, right_t AS t FROM pairs WHERE right_index IS NOT NULL UNION ALL SELECT user_id, 'wcw', i, t FROM src WHERE c = 19 UNION ALL SELECT user_id, 'cww', i, t FROM mk JOIN co USING (user_id) WHERE n > cw + consumed)
SELECT user_id, kind, row_number() OVER (PARTITION BY user_id, kind ORDER BY t, i) - 1 AS ordinal, t / 1000 AS t FROM ec JOIN ok USING (user_id)""")
def combo_placements(spark: SparkSession, d: str) -> DataFrame:
    given = _actions(spark, d)
    return semantics.placements(given[1], semantics.action_semantics(*given, U), U)


@query("""a AS (SELECT user_id, CAST(t // 36000000 AS DOUBLE) AS t, list_value(24, 25, 19, 8, 9, 40)[k % 6 + 1] AS c, event_type, event_id FROM ev),
x AS (SELECT user_id, 'b' AS kind, t + CASE WHEN user_id % 3 = 1 THEN 7 ELSE 0 END AS place FROM a WHERE user_id % 3 < 2 AND event_type <> 'error' UNION ALL SELECT user_id, 'n', t + CASE WHEN user_id % 3 = 1 THEN 7 ELSE 0 END FROM a WHERE user_id % 3 < 2 AND event_type = 'error'
  UNION ALL SELECT user_id, 's', t FROM a WHERE event_type = 'purchase' UNION ALL SELECT user_id, 'e', t + 200 FROM a WHERE event_type = 'purchase' UNION ALL SELECT user_id, CAST(c AS VARCHAR), t FROM a WHERE c IN (24, 8, 9) AND user_id % 11 <> 0),
h AS (SELECT DISTINCT a.user_id, a.c, a.event_id, x.kind FROM a JOIN x ON x.user_id = a.user_id AND abs(x.place - a.t) <= 2 WHERE a.user_id % 11 <> 0),
m AS (SELECT user_id, c, count(*) FILTER (kind = 'b') AS b, count(*) FILTER (kind = 'n') AS n, count(*) FILTER (kind = 's') AS s, count(*) FILTER (kind = 'e') AS e, count(*) FILTER (kind = '24') AS k24, count(*) FILTER (kind = '8') AS k8, count(*) FILTER (kind = '9') AS k9 FROM h GROUP BY ALL)
SELECT a.user_id, a.c AS action_code, count(*) AS count, coalesce(any_value(b), 0) AS on_code2001_start, coalesce(any_value(n), 0) AS on_code1_start, coalesce(any_value(s), 0) AS on_drift_start, coalesce(any_value(e), 0) AS on_drift_end,
  coalesce(any_value(k24), 0) AS on_code24, coalesce(any_value(k8), 0) AS on_code8, coalesce(any_value(k9), 0) AS on_code9 FROM a LEFT JOIN m ON m.user_id = a.user_id AND m.c = a.c WHERE a.user_id % 11 <> 0 GROUP BY a.user_id, a.c""")
def code_matrix(spark: SparkSession, d: str) -> DataFrame:
    _, actions, effects, drifts, _ = _actions(spark, d)
    return semantics.code_matrix(actions, effects, drifts, U)


@query("""r AS (SELECT user_id, event_id, t / 3.6e9 AS t, CASE WHEN k % 9 <> 0 THEN CAST(cents AS DOUBLE) END AS v, CAST(sum(cents) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS d, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i FROM ev),
m AS (SELECT *, median(v) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM r),
w AS (SELECT user_id, event_id AS corner, t / 3.6e9 AS drift_start, t / 3.6e9 + 10 AS drift_end, CASE WHEN k % 3 = 0 THEN t / 3.6e9 + 20 END AS recovery_end, lead(t / 3.6e9) OVER (PARTITION BY user_id ORDER BY t, event_id) AS next_drift, k % 3 <> 1 AS observable, user_id % 2 = 1 AS low_frequency, k % 4 AS boosts FROM ev WHERE event_type = 'click'),
z AS (SELECT user_id, min(t) AS first_t, max(t) AS last_t FROM r GROUP BY user_id),
q AS (SELECT w.*, first_t, last_t, least(drift_end + 5, next_drift, last_t) AS until FROM w JOIN z USING (user_id)),
o AS (SELECT *, recovery_end IS NULL AND (NOT observable OR (low_frequency AND boosts = 0)) AND until > drift_end + 1e-6 AS lasts FROM q),
u AS (SELECT *, CASE WHEN lasts THEN until ELSE coalesce(recovery_end, drift_end) END AS metric_end, CASE WHEN recovery_end IS NOT NULL THEN 'native_small_boost_recovery_end' WHEN lasts THEN 'gameplay_min_small_boost_tail_0p25s' ELSE 'native_drift_end_no_tail' END AS metric_source FROM o),
x AS (SELECT user_id, corner, what, greatest(least(place, last_t), first_t) AS place FROM (SELECT *, unnest([struct_pack(what := 'a', place := drift_start), struct_pack(what := 'b', place := drift_end), struct_pack(what := 'c', place := metric_end), struct_pack(what := 'p', place := drift_start + 4), struct_pack(what := 'q', place := drift_start + 6)], recursive := true) FROM u)),
n AS (SELECT x.user_id, corner, what, arg_min(m.i, (abs(m.t - place), m.t)) AS i, arg_max((m.t, m.d), m.t) FILTER (m.t <= place) AS lo, arg_min((m.t, m.d), m.t) FILTER (m.t >= place) AS hi, any_value(place) AS place FROM x JOIN m ON m.user_id = x.user_id GROUP BY ALL),
f AS (SELECT user_id, corner, what, i, CASE WHEN lo[1] = place OR hi[1] = lo[1] THEN lo[2] ELSE lo[2] + (hi[2] - lo[2]) * (place - lo[1]) / (hi[1] - lo[1]) END AS d FROM n),
j AS (SELECT user_id, corner, max(d) FILTER (what = 'a') AS d0, max(d) FILTER (what = 'b') AS d1, max(d) FILTER (what = 'c') AS d2, max(d) FILTER (what = 'p') AS d3, max(d) FILTER (what = 'q') AS d4, max(i) FILTER (what = 'a') AS ia, max(i) FILTER (what = 'b') AS ib, max(i) FILTER (what = 'c') AS ic FROM f GROUP BY ALL),
s AS (SELECT j.user_id, corner, max(m.m) FILTER (m.i = ia) AS entry, max(m.m) FILTER (m.i = ib) AS at_end, min(v) FILTER (m.i <= ib) AS low, max(v) FILTER (m.i >= ib) AS peak FROM j JOIN m ON m.user_id = j.user_id AND m.i BETWEEN ia AND greatest(ib, ic) GROUP BY ALL)
SELECT user_id, corner, metric_source, round_even(metric_end * 1e4, 0) / 1e4 AS metric_end, round_even(entry * 1000, 0) / 1000 AS entry_speed, low AS min_speed, round_even((CASE WHEN metric_end > drift_end + 1e-6 THEN coalesce(peak, at_end) ELSE at_end END) * 1000, 0) / 1000 AS exit_speed,
  CASE WHEN metric_end > drift_end + 1e-6 AND peak IS NOT NULL THEN 'own_recovery_window_peak' WHEN at_end IS NOT NULL THEN 'native_drift_end_median_fallback' END AS exit_source,
  round_even((d3 - d0 + d1 - d4) * 1000, 0) / 1000 AS drift_distance, round_even(greatest(d1 - d0 - (d3 - d0 + d1 - d4), 0) * 1000, 0) / 1000 AS gap_distance, round_even((d2 - d1) * 1000, 0) / 1000 AS recovery_distance, round_even((d2 - d0) * 1000, 0) / 1000 AS total_distance
FROM u JOIN j USING (user_id, corner) JOIN s USING (user_id, corner)""")
def corner_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = seq.cumulative(events(spark, d), U, ["t", "event_id"], "cents", "distance")
    hours = F.col("t") / 3.6e9
    rows = e.select("user_id", hours.alias("t"), F.col("cents").cast("double").alias("speed"), F.col("distance").cast("double").alias("distance"), (F.col("k") % 9 != 0).alias("pose_valid"))
    click = e.where("event_type = 'click'")
    nxt = F.lead(hours).over(Window.partitionBy("user_id").orderBy("t", "event_id"))
    w = click.select(
        "user_id", F.col("event_id").alias("corner"), hours.alias("drift_start"), (hours + 10).alias("drift_end"), F.when(F.col("k") % 3 == 0, hours + 20).alias("recovery_end"), nxt.alias("next_drift"),
        (F.col("k") % 3 != 1).alias("observable"), (F.col("user_id") % 2 == 1).alias("low_frequency"), (F.col("k") % 4).alias("boosts"), F.lit(0).alias("nitros"),
    )
    drifts = w.select("user_id", "corner", F.explode(F.array(*[F.struct((F.col("drift_start") + a).alias("start_t"), (F.col("drift_start") + b).alias("end_t")) for a, b in ((0, 4), (6, 10))])).alias("x")).select("user_id", "corner", "x.*")
    m = comparison.corner_metrics(w, drifts, rows, U, "corner", tail=5)
    return m.select("user_id", "corner", "metric_source", round_even(F.col("metric_end"), 4).alias("metric_end"), "entry_speed", "min_speed", "exit_speed", "exit_source", "drift_distance", "gap_distance", "recovery_distance", "total_distance")


_MESH_SQL = """m AS (SELECT user_id, (k * 3) % 50 AS ax, CAST(cents % 97 AS DOUBLE) / 7 AS ay, event_id % 11 AS az, (k * 5) % 50 AS bx, CAST(cents % 89 AS DOUBLE) / 7 AS "by", CASE WHEN k % 10 = 0 THEN 'nan'::DOUBLE ELSE event_id % 7 END AS bz, (k * 7) % 50 AS cx, CAST(cents % 83 AS DOUBLE) / 7 AS cy, event_id % 5 AS cz, event_type = 'error' OR user_id % 13 = 0 AS hidden FROM ev),
v AS (SELECT user_id, hidden, unnest([struct_pack(x := ax, y := ay, z := az), struct_pack(x := bx, y := "by", z := bz), struct_pack(x := cx, y := cy, z := cz)], recursive := true) FROM m),
b AS (SELECT user_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1, count(*) AS vertices FROM v WHERE NOT hidden AND NOT isnan(z) GROUP BY user_id),
n AS (SELECT user_id, count(*) FILTER (NOT hidden) AS triangles FROM m GROUP BY user_id),
p AS (SELECT n.user_id, triangles, coalesce(vertices, 0) AS vertices, unnest([struct_pack(o := 0, plane := 'xy', min_a := x0, max_a := x1, min_b := y0, max_b := y1, depth := z1 - z0), struct_pack(o := 1, plane := 'xz', min_a := x0, max_a := x1, min_b := z0, max_b := z1, depth := y1 - y0),
  struct_pack(o := 2, plane := 'yz', min_a := y0, max_a := y1, min_b := z0, max_b := z1, depth := x1 - x0)], recursive := true) FROM n LEFT JOIN b USING (user_id)),
r AS (SELECT *, CASE WHEN vertices > 0 AND greatest(max_a - min_a, max_b - min_b) > 1e-9 THEN depth / greatest(max_a - min_a, max_b - min_b) ELSE 'inf'::DOUBLE END AS thickness FROM p),
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY thickness, o) = 1),
tr AS (SELECT *, plane = 'xy' AND vertices > 0 AS promoted, least(1130 / greatest(max_a - min_a, 1e-6), 1130 / greatest(max_b - min_b, 1e-6)) AS scale FROM best)"""


def _meshes(spark: SparkSession, d: str) -> DataFrame:
    """Triangles of users, one for each event, some hidden, some corners not finite."""
    e = events(spark, d)
    double = lambda c: c.cast("double")
    k, cents, i = F.col("k"), F.col("cents"), F.col("event_id")
    return e.select(
        "user_id", "event_id", double(k * 3 % 50).alias("ax"), (double(cents % 97) / 7).alias("ay"), double(i % 11).alias("az"), double(k * 5 % 50).alias("bx"), (double(cents % 89) / 7).alias("by"),
        F.when(k % 10 == 0, float("nan")).otherwise(double(i % 7)).alias("bz"), double(k * 7 % 50).alias("cx"), (double(cents % 83) / 7).alias("cy"), double(i % 5).alias("cz"),
        ((F.col("event_type") == "error") | (F.col("user_id") % 13 == 0)).alias("hidden"),
    )


@query(_MESH_SQL + """ SELECT user_id, plane, triangles, vertices, CASE WHEN vertices > 0 THEN round_even(thickness * 1e9, 0) / 1e9 ELSE thickness END AS thickness, triangles >= 4 AND thickness <= 0.25 AS flat, CASE WHEN vertices = 0 THEN 'no_visible_geometry' WHEN plane <> 'xy' THEN 'plane_is_not_xy' ELSE 'official' END AS status,
  CASE WHEN promoted THEN round_even(scale * 1e6, 0) / 1e6 END AS scale, CASE WHEN promoted THEN round_even((1200 - greatest(max_a - min_a, 1e-6) * scale) / 2 * 1e6, 0) / 1e6 END AS offset_x, CASE WHEN promoted THEN round_even((1200 - greatest(max_b - min_b, 1e-6) * scale) / 2 * 1e6, 0) / 1e6 END AS offset_y FROM tr""")
def map_transforms(spark: SparkSession, d: str) -> DataFrame:
    best = kept(meshes.best_projection(meshes.mesh_projections(_meshes(spark, d), U), U))
    t = meshes.map_transform(best, U)
    shown = best.select("user_id", "plane", "triangles", "vertices", F.when(F.col("vertices") > 0, round_even(F.col("thickness"), 9)).otherwise(F.col("thickness")).alias("thickness"), "flat")
    return shown.join(t, U).select(*shown.columns, "status", *[round_even(F.col(c), 6).alias(c) for c in ("scale", "offset_x", "offset_y")])


@query(_MESH_SQL + """ SELECT ev.user_id, event_id, CASE WHEN promoted THEN round_even(((1200 - greatest(max_a - min_a, 1e-6) * scale) / 2 + ((k * 3) % 50 - min_a) * scale) * 1e6, 0) / 1e6 END AS canvas_x,
  CASE WHEN promoted THEN round_even((1200 - ((1200 - greatest(max_b - min_b, 1e-6) * scale) / 2 + (CAST(cents % 97 AS DOUBLE) / 7 - min_b) * scale)) * 1e6, 0) / 1e6 END AS canvas_y FROM ev JOIN tr USING (user_id)""")
def canvas_points(spark: SparkSession, d: str) -> DataFrame:
    triangles = _meshes(spark, d)
    t = meshes.map_transform(meshes.best_projection(meshes.mesh_projections(triangles, U), U), U)
    points = triangles.select("user_id", "event_id", F.col("ax").alias("x"), F.col("ay").alias("y"))
    return meshes.to_canvas(points, t, U).select("user_id", "event_id", round_even(F.col("canvas_x"), 6).alias("canvas_x"), round_even(F.col("canvas_y"), 6).alias("canvas_y"))


#: What is wrong with the stored row of user ``u`` by ``u % 12``, as (rest, mode, status); the others are sound.
_FAULTS = (
    (0, "rebuilt", "native_action_cache_missing"), (1, "rebuilt", "native_action_cache_contract_mismatch"), (2, "rebuilt", "native_action_cache_repeated"), (3, "rebuilt", "native_action_cache_source_size_mismatch"),
    (4, "rebuilt", "native_action_cache_tail_window_mismatch"), (5, "rebuilt", "native_action_cache_tail_hash_mismatch"), (6, "rebuilt", "native_action_cache_count_mismatch"), (7, "rebuilt", "native_action_cache_intervals_invalid"),
    (8, "rebuilt_from_tail", "native_action_scanner_contract_mismatch"), (9, "rebuilt", "native_action_cache_effects_invalid"),
)


@query(_TABLES_SQL + f""", x AS (SELECT u, count(*) AS n_tables, CAST(sum(n) AS BIGINT) AS n_intervals FROM t GROUP BY u),
w AS (SELECT * FROM (VALUES {', '.join(f"({r}, '{m}', '{s}')" for r, m, s in _FAULTS)}) AS w(rest, mode, status))
SELECT replay_sha, coalesce(mode, 'reuse') AS mode, coalesce(status, 'native_action_cache_valid') AS status, n_tables, n_intervals, true AS agrees FROM u JOIN x USING (u) LEFT JOIN w ON u.u % 12 = rest""")
def native_cache_refresh(spark: SparkSession, d: str) -> DataFrame:
    source = kept(_recordings(spark, d)).withColumn("size_bytes", F.octet_length("content").cast("long"))
    rest = F.substring("replay_sha", 4, 5).cast("int") % 12
    sound = kept(native_cache.scan_rows(source.withColumn("base", F.lit(0).cast("long"))))
    bad = lambda r, wrong, right: F.when(rest == r, wrong).otherwise(right)
    turned = F.transform("tables", lambda t: t.withField("intervals", F.transform(t["intervals"], lambda i: F.array(i[1], i[0]))))
    late = F.transform("tables", lambda t: t.withField("effects", F.transform(t["effects"], lambda e: e.withField("end_ms", e["start_ms"] - 1))))
    stored = sound.where(rest != 0).withColumns({
        "contract": bad(1, F.lit("another"), F.col("contract")), "size_bytes": bad(3, F.col("size_bytes") + 1, F.col("size_bytes")), "tail_start": bad(4, F.col("tail_start") + 1, F.col("tail_start")),
        "tail_sha256": bad(5, F.lit("00"), F.col("tail_sha256")), "n_tables": bad(6, F.col("n_tables") + 1, F.col("n_tables")), "tables": F.when(rest == 7, turned).when(rest == 9, late).otherwise(F.col("tables")),
        "scanner_contract": bad(8, F.lit("native_action_scanner_v2"), F.col("scanner_contract")),
    })
    stored = kept(stored.union(stored.where(rest == 2)))
    now = kept(native_cache.refreshed(source, stored))
    return now.join(native_cache.audit(source, now.drop("mode", "status")).select("replay_sha", "agrees"), "replay_sha").select("replay_sha", "mode", "status", "n_tables", "n_intervals", "agrees")


#: Fixed value: names that the text search looks for.
SOUGHT = ("old", "widget", "ring", "in", "no such name")


@query("""p AS (SELECT p_partkey, p_name, p_partkey % 3 AS form FROM part), s AS (SELECT unnest(['old', 'widget', 'ring', 'in', 'no such name']) AS name)
SELECT p_partkey, name, CASE WHEN form = 1 THEN 'utf-16-le' WHEN form = 2 THEN 'gbk,utf-16-le,utf-8' ELSE 'gbk,utf-8' END AS encodings FROM p JOIN s ON contains(p_name, name)""")
def text_search(spark: SparkSession, d: str) -> DataFrame:
    plain, wide = F.encode("p_name", "UTF-8"), F.encode("p_name", "UTF-16LE")
    rest = F.col("p_partkey") % 3
    parts = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.when(rest == 1, wide).when(rest == 2, F.concat(plain, wide)).otherwise(plain).alias("payload"))
    return maps.search_texts(parts, "p_partkey", "payload", SOUGHT).withColumn("encodings", F.array_join("encodings", ","))
