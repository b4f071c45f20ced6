"""Native tables at the end of a recording: drift toggles, speed effects and action events.

A table begins with a count; where it is must be proven by its structure. More than one proof
refuses: an ambiguous table is unavailable, never guessed.
"""

from __future__ import annotations

import struct
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import matching, temporal
from ..operators.sets import drift_candidate_score
from ..storage import kept
from . import recordings as files

#: Fixed values of the formats.
LAST_MS = 600_000
MARKER = bytes.fromhex("7EA01EC2")
TRAILER, TAIL = 374, 196_608
EFFECT = np.dtype([("t", "<u4"), ("state", "u1"), ("code", "<f4")])
TOGGLE = np.dtype([("t", "<u4"), ("state", "u1")])
ACTION = np.dtype([("t", "<u4"), ("code", "<u4"), ("reserved", "<u4")])


def _count(data: bytes, at: int) -> int | None:
    return struct.unpack_from("<I", data, at)[0] if 0 <= at <= len(data) - 4 else None


def read_toggles(data: bytes, at: int, empty: bool = False) -> np.ndarray | None:
    """Intervals (start, end) of the toggle table at ``at``, or None if it isn't one.

    States alternate from 1; pairs may be inverted; starts never go back; half the intervals at
    least have a length, and all span 300 ms.
    """
    n = _count(data, at)
    if n is None or n > 1000 or n % 2 or (n == 0 and not empty) or at + 4 + 5 * n > len(data):
        return None
    rows = np.frombuffer(data, TOGGLE, n, at + 4)
    if n == 0:
        return np.zeros((0, 2), np.int64)
    if (rows["state"] != np.arange(1, n + 1) % 2).any() or (rows["t"] > LAST_MS).any():
        return None
    pairs = np.sort(rows["t"].astype(np.int64).reshape(-1, 2), axis=1)
    if (np.diff(pairs[:, 0]) < 0).any() or (pairs[:, 1] > pairs[:, 0]).sum() < max(1, len(pairs) // 2) or pairs[-1, 1] - pairs[0, 0] < 300:
        return None
    return pairs


def read_effects(data: bytes, at: int, most: int = 5000) -> tuple[str, list[tuple[float, int, int, int]]]:
    """(status, intervals (code, code bits, start, end)) of the effect table at ``at``; opens close first in, first out by code."""
    n = _count(data, at)
    if n is None:
        return "count_offset_out_of_range", []
    if n > most:
        return "record_count_out_of_range", []
    if at + 4 + 9 * n > len(data):
        return "table_exceeds_file", []
    rows = np.frombuffer(data, EFFECT, n, at + 4)
    bits = np.ascontiguousarray(rows["code"]).view("<i4")
    waiting: dict[int, deque] = {}
    out, before = [], -1
    for t, state, code, key in zip(rows["t"].tolist(), rows["state"].tolist(), rows["code"].tolist(), bits.tolist()):
        if state > 1:
            return "invalid_state_value", []
        if t < before or t > LAST_MS:
            return "invalid_or_nonmonotonic_time", []
        if not abs(code) <= 1e7:
            return "invalid_effect_code", []
        before, queue = t, waiting.setdefault(key, deque())
        if state:
            queue.append(t)
        elif not queue:
            return "effect_end_without_start", []
        else:
            out.append((code, key, queue.popleft(), t))
    if any(waiting.values()):
        return "unclosed_effect_start", []
    return ("adjacent_speed_effect_table_validated" if n else "adjacent_speed_effect_table_empty_validated"), out


def tail_start(size: int, tail: int = TAIL) -> int:
    """First byte of a file of ``size`` bytes at which a table may be looked for."""
    return max(0, size - max(32_768, tail))


def _set(flags: np.ndarray) -> np.ndarray:
    """``np.flatnonzero`` of flags few of which are set: eight at a time are passed over."""
    n = len(flags) // 8 * 8
    near = (8 * np.flatnonzero(flags[:n].view(np.uint64))[:, None] + np.arange(8)).ravel()
    return np.concatenate((near[flags[near]], n + np.flatnonzero(flags[n:])))


def drift_candidates(data: bytes, tail: int = TAIL, base: int = 0) -> Iterator[dict]:
    """Every toggle table of the tail, with the effect table that follows it.

    ``data`` are the bytes of a file from ``base`` on; offsets are those in the file.
    """
    low = max(0, tail_start(base + len(data), tail) - base)
    b = np.frombuffer(data, np.uint8)
    if len(b) < 14:
        return
    # few bytes pass the states of the first two rows; only there is a count put together
    at = low + _set((b[low + 8 : len(b) - 5] == 1) & (b[low + 13 :] == 0))
    n = b[at].astype(np.int64) | b[at + 1].astype(np.int64) << 8 | b[at + 2].astype(np.int64) << 16 | b[at + 3].astype(np.int64) << 24
    likely = at[(n >= 4) & (n <= 1000) & (n % 2 == 0)]
    seen = set()
    found = data.find(MARKER, low)
    marked = []
    while found >= 0:
        marked.append(found + 4)
        found = data.find(MARKER, found + 1)
    for o in [*likely.tolist(), *marked]:
        has_marker = data[max(0, o - 4) : o] == MARKER
        pairs = None if o in seen else read_toggles(data, o, empty=has_marker)
        if pairs is None:
            continue
        seen.add(o)
        end = o + 4 + 10 * len(pairs)
        status, effects = read_effects(data, end)
        valid = status.startswith("adjacent_speed_effect_table")
        yield {"count_offset": base + o, "marker": has_marker, "effect_valid": valid, "effect_status": status, "effect_records": 2 * len(effects), "intervals": pairs.tolist(), "effects": effects}


def file_tables(content: pa.Buffer) -> Iterator[dict]:
    """``drift_candidates`` of a whole file, of which only the tail is copied; effects by the names of their fields."""
    base = max(0, tail_start(content.size) - len(MARKER))
    for c in drift_candidates(content.slice(base).to_pybytes(), base=base):
        yield c | {"effects": [dict(zip(("code", "code_bits", "start_ms", "end_ms"), e)) for e in c["effects"]]}


#: The fields of a table in Arrow.
_TABLE = [
    ("count_offset", pa.int64()), ("marker", pa.bool_()), ("effect_valid", pa.bool_()), ("effect_status", pa.string()), ("effect_records", pa.int64()), ("intervals", pa.list_(pa.list_(pa.int64()))),
    ("effects", pa.list_(pa.struct([("code", pa.float64()), ("code_bits", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64())]))),
]
_DRIFT = (
    "replay_sha string, count_offset long, marker boolean, effect_valid boolean, effect_status string, effect_records long, intervals array<array<long>>, "
    "effects array<struct<code:double,code_bits:int,start_ms:long,end_ms:long>>"
)


def drift_tables(recordings: DataFrame) -> DataFrame:
    """Candidates of the drift table; eligible are marked ones and those an effect table proves."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ({"replay_sha": sha} | t for sha, content in files.each_file(batches) for t in file_tables(content))
        yield from files.gathered(rows, pa.schema([("replay_sha", pa.string()), *_TABLE]))

    return _eligible(recordings.select("replay_sha", "content").mapInArrow(scan, _DRIFT))


def _eligible(tables: DataFrame) -> DataFrame:
    return tables.withColumn("eligible", F.col("marker") | (F.col("effect_valid") & (F.size("intervals") > 0)))


def scan_files(recordings: DataFrame, input_lane: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``stream_candidates``, ``drift_tables`` and the rises of an input, of one pass over the contents, which need not be kept.

    Rises (``replay_sha, profile, start_byte, t`` in ms) are the moments at which input ``input_lane`` turns on within a
    candidate; those of a stream of ``recordings.streams`` have its profile and start.
    """
    kinds = pa.schema([
        ("replay_sha", pa.string()), ("candidates", pa.list_(pa.struct([*files.CANDIDATE, ("rises", pa.list_(pa.int64()))]))), ("tables", pa.list_(pa.struct(_TABLE))),
    ])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ({"replay_sha": sha, "candidates": files.file_candidates(np.frombuffer(content, np.uint8), input_lane), "tables": list(file_tables(content))} for sha, content in files.each_file(batches))
        yield from files.gathered(rows, kinds)

    fields = lambda ddl: ddl.removeprefix("replay_sha string, ")
    found = kept(recordings.select("replay_sha", "content").mapInArrow(scan, f"replay_sha string, candidates array<struct<{fields(files.CANDIDATES)}, rises array<long>>>, tables array<struct<{fields(_DRIFT)}>>"))
    each = found.select("replay_sha", F.explode("candidates").alias("c"))
    rises = each.select("replay_sha", "c.profile", "c.start_byte", F.explode("c.rises").alias("t"))
    tables = found.select("replay_sha", F.explode("tables").alias("t")).select("replay_sha", "t.*")
    return each.select("replay_sha", "c.*").drop("rises"), _eligible(tables), rises


def best_tables(tables: DataFrame, rises: DataFrame | None = None, tolerance_ms: float = 34) -> DataFrame:
    """The best eligible table of each recording: ``replay_sha, b`` with ``b.intervals`` and ``b.effects``.

    ``rises`` (``replay_sha, t`` in ms) are the moments at which the recording's own vehicle began to press the
    drift key: a table whose intervals begin at them gains by each match and by their share. Starts
    meet rises by time bucket. On equal scores more intervals win, then the earlier table.
    """
    eligible = tables.where("eligible").withColumn("n", F.size("intervals"))
    if rises is None:
        ranked = eligible.withColumn("matches", F.lit(0).cast("long"))
    else:
        starts = eligible.select("replay_sha", "count_offset", F.posexplode("intervals").alias("k", "i")).select("replay_sha", "count_offset", "k", F.col("i")[0].alias("start_t"))
        near = temporal.near_any(starts, rises.select("replay_sha", "t"), ["replay_sha"], "start_t", "t", tolerance_ms)
        found = near.groupBy("replay_sha", "count_offset").agg(F.count("*").alias("matches"))
        ranked = eligible.join(found, ["replay_sha", "count_offset"], "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    share = F.when(F.col("n") > 0, F.col("matches") / F.col("n")).otherwise(1.0) if rises is not None else F.lit(0)
    c = {"marker": F.col("marker").cast("int"), "effect": F.col("effect_valid").cast("int"), "effect_records": F.col("effect_records"), "matches": F.col("matches"), "share": share, "intervals": F.col("n")}
    return ranked.groupBy("replay_sha").agg(F.max_by(F.struct("intervals", "effects"), F.struct(drift_candidate_score(c), F.col("n"), -F.col("count_offset"))).alias("b"))


def drift_intervals(tables: DataFrame, rises: DataFrame | None = None) -> DataFrame:
    """Drift intervals of the best eligible table of each recording; ``rises`` as in ``best_tables``."""
    rows = best_tables(tables, rises).select("replay_sha", F.posexplode("b.intervals").alias("ordinal", "i"))
    return rows.select("replay_sha", "ordinal", F.col("i")[0].alias("start_t"), F.col("i")[1].alias("end_t"))


def effect_intervals(tables: DataFrame, rises: DataFrame | None = None) -> DataFrame:
    """Effect intervals next to the best eligible drift table of each recording; ``rises`` as in ``best_tables``."""
    rows = best_tables(tables, rises).select("replay_sha", F.posexplode("b.effects").alias("ordinal", "e"))
    return rows.select("replay_sha", "ordinal", "e.code", "e.code_bits", F.col("e.start_ms").alias("start_t"), F.col("e.end_ms").alias("end_t"), (F.col("e.end_ms") - F.col("e.start_ms")).alias("duration"))


#: What a vehicle's choice of a table comes to.
TABLE_FOUND, TABLE_EMPTY = "replay_native_drift_table_validated", "replay_native_drift_table_validated_empty"
TABLE_MISSING, TABLE_REFUSED = "native_action_object_drift_table_not_found", "native_action_object_drift_table_not_validated"


def assign_tables(tables: DataFrame, vehicles: DataFrame, rises: DataFrame, tolerance_ms: float = 34) -> DataFrame:
    """Each vehicle with the drift table that is its own: ``replay_sha, stream, shadow, count_offset, status`` and figures.

    ``vehicles`` (``replay_sha, stream, shadow``) choose by ascending ``shadow``, their role's rank, each the eligible
    table of the highest score whose offset no earlier one has claimed; on equal scores more
    intervals win, then the earlier table. ``rises`` (``replay_sha, stream, t`` in ms) are the moments at
    which a vehicle began to press the drift key: a table scores by how many of its starts are near one.

    ``matches`` and ``share`` are those of the chosen table, ``retriggers`` its vehicle's rises inside an interval but not
    at a start, ``outside`` the rises in no interval, ``n_rises`` all; ``eligible`` and ``refused`` count the tables
    it could choose from and those without proof. Vehicles without a table keep a row with NULLs, so that a
    missing table is never an empty one. ``intervals`` and ``effects`` are the table's contents.
    """
    key, own = ["replay_sha"], ["replay_sha", "stream"]
    eligible = tables.where("eligible").withColumn("n", F.size("intervals"))
    starts = eligible.select(*key, "count_offset", F.posexplode("intervals").alias("k", "i")).select(*key, "count_offset", "k", F.col("i")[0].alias("start_t"))
    near = temporal.near_any(starts.join(vehicles.select(*own), key), rises.select(*own, "t"), own, "start_t", "t", tolerance_ms)
    matched = near.groupBy(*own, "count_offset").agg(F.count("*").alias("matches"))
    scored = eligible.drop("intervals", "effects").join(vehicles.select(*own, "shadow"), key).join(matched, [*own, "count_offset"], "left")
    scored = scored.withColumn("matches", F.coalesce("matches", F.lit(0))).withColumn("share", F.when(F.col("n") > 0, F.col("matches") / F.col("n")).otherwise(1.0))
    c = {"marker": F.col("marker"), "effect": F.col("effect_valid"), **{x: F.col(x) for x in ("effect_records", "matches", "share")}, "intervals": F.col("n")}
    claims = matching.claim_in_order(scored, key, "shadow", "count_offset", [-drift_candidate_score(c), -F.col("n"), F.col("count_offset")])

    seen = tables.groupBy(*key).agg(F.count("*").alias("_tables"), F.count_if("eligible").alias("_eligible"))
    before = Window.partitionBy(*key).orderBy("shadow").rowsBetween(Window.unboundedPreceding, -1)
    out = vehicles.select(*own, "shadow").join(claims, [*key, "shadow"], "left").join(seen, key, "left")
    out = out.withColumns({"eligible": F.coalesce("_eligible", F.lit(0)) - F.count("count_offset").over(before), "refused": F.coalesce(F.col("_tables") - F.col("_eligible"), F.lit(0))})
    out = out.join(scored.select(*own, "count_offset", "marker", "effect_valid", "matches", "share", "n"), [*own, "count_offset"], "left")
    out = out.join(eligible.select(*key, "count_offset", "intervals", "effects"), [*key, "count_offset"], "left")
    found = F.when(F.col("n") > 0, TABLE_FOUND).when(F.col("n") == 0, TABLE_EMPTY)
    out = out.withColumn("status", F.coalesce(found, F.when(F.coalesce("_tables", F.lit(0)) == 0, TABLE_MISSING), F.lit(TABLE_REFUSED))).drop("_tables", "_eligible")

    spans = out.select(*own, F.explode("intervals").alias("i")).select(*own, F.col("i")[0].alias("start_t"), F.col("i")[1].alias("end_t"))
    pressed = rises.select(*own, "t").withColumn("rise", F.monotonically_increasing_id())
    at = temporal.near_any(pressed, spans, own, "t", "start_t", tolerance_ms).select("rise", F.lit(True).alias("at_start"))
    told = temporal.mark_intervals(pressed, spans, own, "t", "inside").join(at, "rise", "left")
    told = told.groupBy(*own).agg(
        F.count("*").alias("n_rises"), F.count_if(F.col("inside") & F.col("at_start").isNull()).alias("retriggers"), F.count_if(~F.col("inside") & F.col("at_start").isNull()).alias("outside"),
    )
    out = out.join(told, own, "left").withColumn("n_rises", F.coalesce("n_rises", F.lit(0)))
    return out.withColumns({x: F.when(F.col("count_offset").isNotNull(), F.coalesce(x, F.lit(0))) for x in ("retriggers", "outside")})


def vehicle_drifts(assigned: DataFrame) -> DataFrame:
    """Drift intervals of every vehicle of ``assign_tables``: ``replay_sha, stream, ordinal, start_t, end_t``."""
    rows = assigned.select("replay_sha", "stream", F.posexplode("intervals").alias("ordinal", "i"))
    return rows.select("replay_sha", "stream", "ordinal", F.col("i")[0].alias("start_t"), F.col("i")[1].alias("end_t"))


def vehicle_effects(assigned: DataFrame) -> DataFrame:
    """Effect intervals next to the drift table of every vehicle of ``assign_tables``."""
    rows = assigned.select("replay_sha", "stream", F.posexplode("effects").alias("ordinal", "e"))
    return rows.select("replay_sha", "stream", "ordinal", "e.code", "e.code_bits", F.col("e.start_ms").alias("start_t"), F.col("e.end_ms").alias("end_t"), (F.col("e.end_ms") - F.col("e.start_ms")).alias("duration"))


def locate_actions(data: bytes, most: int = 5000) -> tuple[str, int | None]:
    """Where the action table's count is: by the fixed trailer, else by structure; ambiguity refuses."""
    size = len(data)
    if size <= TRAILER + 4:
        return "file_smaller_than_container_trailer", None
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    word = lambda at: b[at] | b[at + 1] << 8 | b[at + 2] << 16 | b[at + 3] << 24
    n = np.arange(1, most + 1)
    at = size - TRAILER - 4 - 12 * n
    n, at = n[at >= 0], at[at >= 0]
    hit = at[word(at) == n]
    if len(hit) > 1:
        return "action_event_count_ambiguous", None
    if len(hit):
        return "trailer_fixed_point", int(hit[0])
    low = max(0, size - TRAILER - 4 - 12 * most)
    at = np.arange(low, size - TRAILER - 3)
    n = word(at)
    keep = (n >= 4) & (n <= most) & (at + 4 + 12 * n <= size) & (size - (at + 4 + 12 * n) <= 8192)
    found = []
    for o, k in zip(at[keep].tolist(), n[keep].tolist()):
        rows = np.frombuffer(data, ACTION, k, o + 4)
        t = rows["t"].astype(np.int64)
        ok = (rows["reserved"] == 0).all() and (t > 0).all() and (t <= LAST_MS).all() and (rows["code"] >= 1).all() and (rows["code"] <= 200).all() and (np.diff(t) >= 0).all()
        if not ok:
            continue
        if o - 12 >= 0:
            p = np.frombuffer(data, ACTION, 1, o - 12)[0]
            if p["reserved"] == 0 and 0 < p["t"] <= min(LAST_MS, t[0]) and 1 <= p["code"] <= 200:
                continue  # the table begins earlier
        found.append((k, o))
    longest = [o for k, o in found if k == max(x for x, _ in found)]
    if not longest:
        return "action_event_count_unresolved", None
    return ("structural", longest[0]) if len(longest) == 1 else ("action_event_count_ambiguous", None)


_ACTIONS = "replay_sha string, status string, record_index int, record_offset long, time_ms long, action_code long"


def action_events(recordings: DataFrame) -> DataFrame:
    """Action events of each recording; one row with NULLs and the reason where there is no table."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sha, content in zip(batch.column("replay_sha").to_pylist(), batch.column("content").to_pylist()):
                data = content or b""
                status, at = locate_actions(data)
                rows = np.zeros(0, ACTION)
                if at is not None:
                    rows = np.frombuffer(data, ACTION, _count(data, at), at + 4)
                    t = rows["t"].astype(np.int64)
                    if (t > LAST_MS).any():
                        status, rows = "action_event_time_out_of_range", rows[:0]
                    elif (np.diff(t) < 0).any():
                        status, rows = "action_event_time_not_monotonic", rows[:0]
                    elif (rows["reserved"] != 0).any():
                        status, rows = "action_event_reserved_field_nonzero", rows[:0]
                n = len(rows)
                arrays = [pa.array(np.arange(n, dtype=np.int32)), pa.array(at + 4 + 12 * np.arange(n)) if n else pa.array([], pa.int64()), pa.array(rows["t"].astype(np.int64)), pa.array(rows["code"].astype(np.int64))]
                if not n:
                    arrays = [pa.nulls(1, pa.int32()), *[pa.nulls(1, pa.int64())] * 3]
                yield pa.RecordBatch.from_arrays([pa.array([sha] * max(n, 1)), pa.array([status] * max(n, 1)), *arrays], names=[c.split()[0] for c in _ACTIONS.split(", ")])

    return recordings.select("replay_sha", "content").mapInArrow(scan, _ACTIONS)


def needs_scan(recordings: DataFrame, bronze: DataFrame, contract: str) -> DataFrame:
    """Recordings without rows of this scanner contract in the bronze table: the ones to scan again."""
    done = bronze.where(F.col("contract") == contract).select("replay_sha").distinct()
    return recordings.join(done, "replay_sha", "left_anti")
