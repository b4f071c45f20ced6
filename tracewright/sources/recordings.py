"""Binary recordings: fixed-stride vehicle records and the native tables near the end of a file.

A recording is a row ``(replay_sha, content)``. Byte work is vectorised within one recording and
yields rows; everything between recordings and between streams is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import airborne, contact_state_name, forward_heading, is_finite, null_if_nan, quaternion_yaw, slip_angle, speed_choice, wrap_pi
from ..operators.matching import blockwise
from ..operators.sequences import cumulative, derivative, steps
from ..storage import kept

#: Limits of the clock and geometry gates.
LAST_MS, LONGEST_STEP_MS, LEAST_RECORDS, LEAST_MS = 600_000, 100, 80, 2_000
LEAST_FORWARD, MOST_FROZEN, LEAST_ROTATIONS, LEAST_SPAN, FARTHEST = 0.30, 0.90, 0.80, 20.0, 1e5


@dataclass(frozen=True)
class Layout:
    """Stride and byte offsets of a record; None where a format lacks the field."""

    name: str
    stride: int
    quaternion: int
    position: int
    velocity: int | None = None
    contact: int | None = None
    lap: int | None = None
    inputs: int | None = None


#: The known record layouts.
LAYOUTS = (
    Layout("2021", 141, 20, 36),
    Layout("2025", 218, 16, 32, velocity=44),
    Layout("2026", 230, 8, 24, velocity=173, contact=52, lap=76, inputs=60),
)
#: Lanes looked at around a record's start, and the limits of what may be a state.
FIRST_LANE, LAST_LANE, MOST_STATE, LEAST_CHANGES, MOST_CHANGES = -96, 96, 7, 8, 2500
#: Records whose lanes are profiled at a time.
LANE_RECORDS = 1 << 16
#: Phase of a second pose within a 2026 record, which a scan mistakes for another vehicle.
ALIAS_PHASE = 137


#: Rows whose clocks are compared at a time.
LANE_ROWS = 1 << 12
#: Rows of results that a scan of files gathers into one batch.
BATCH_ROWS = 256
#: Bytes of a file up to which it is read.
MOST_BYTES = 64 << 20


def landing(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Recordings of a folder, one row for each distinct content, with ``status``.

    Files above ``most_bytes`` are never read: they have a row of their own with ``too_large``, no hash
    and no content. ``ready`` ones are for decoding.
    """
    files = spark.read.format("binaryFile").load(path)
    columns = ["replay_sha", "path", "modificationTime", "length", "content", "status"]
    ready = files.where(F.col("length") <= most_bytes).withColumns({"replay_sha": F.sha2("content", 256), "status": F.lit("ready")})
    # one path a content is chosen by hashes alone; contents are not shuffled to be compared
    chosen = kept(ready.groupBy("replay_sha").agg(F.min("path").alias("_path")).select("_path"))
    ready = ready.join(chosen, F.col("path") == F.col("_path"), "left_semi")
    large = files.where(F.col("length") > most_bytes).select("path", "modificationTime", "length")
    large = large.withColumns({"replay_sha": F.lit(None).cast("string"), "content": F.lit(None).cast("binary"), "status": F.lit("too_large")})
    return ready.select(columns).union(large.select(columns))


def _field(data: np.ndarray, at: np.ndarray, kind: str, n: int = 1) -> np.ndarray:
    """``n`` values of a 4-byte kind at each of evenly spaced byte offsets; offsets beyond the end give zeros."""
    if len(at) and at[0] >= 0 and at[-1] + 4 * n <= len(data):
        step = int(at[1] - at[0]) if len(at) > 1 else 4 * n
        return np.ndarray((len(at), 4 * n), np.uint8, np.ascontiguousarray(data), int(at[0]), (step, 1)).copy().view(kind)
    where = at[:, None] + np.arange(4 * n)
    raw = np.where(where < len(data), data[np.minimum(where, len(data) - 1)], 0).astype(np.uint8)
    return np.ascontiguousarray(raw).view(kind)


def lane_runs(data: np.ndarray, stride: int) -> Iterator[tuple[int, np.ndarray]]:
    """(residue, clocks) of every run whose clock never goes back and really advances."""
    if len(data) < stride * LEAST_RECORDS:
        return
    # a step forward of clocks below LAST_MS adds 1 to LONGEST_STEP_MS to the lowest byte, 0 or 1 to the third, and leaves the highest 0;
    # lanes without enough such steps hold no run
    moved, most, n = np.zeros(stride, np.int64), LANE_ROWS * stride, len(data) - stride - 3
    for a in range(0, n, most):
        m = min(most, n - a)
        now, then = data[a : a + m + 3], data[a + stride : a + stride + m + 3]
        step = then - now
        forward = np.zeros(-(-m // stride) * stride, bool)
        np.less(step[:m] - np.uint8(1), LONGEST_STEP_MS, out=forward[:m])
        for seen in (step[2 : m + 2] <= 1, then[2 : m + 2] <= LAST_MS >> 16, (then | now)[3:] == 0):
            forward[:m] &= seen
        rows = forward.view(np.uint8).reshape(-1, stride)
        for k in range(0, len(rows), 255):  # as many as a byte can count
            moved += rows[k : k + 255].sum(axis=0, dtype=np.uint8)
    for residue in np.flatnonzero(moved >= LEAST_FORWARD * (LEAST_RECORDS - 1)):
        times = _field(data, np.arange(residue, len(data) - 3, stride), "<u4")[:, 0]
        low = times < LAST_MS
        good = np.zeros(len(times) + 1, np.int8)
        np.logical_and(times[1:] - times[:-1] <= LONGEST_STEP_MS, low[1:] & low[:-1], out=good[1:-1].view(bool))
        edge = np.flatnonzero(good[1:] != good[:-1])
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a + 1 < LEAST_RECORDS:
                continue
            t = times[a : b + 1].astype(np.int64)
            forward = np.count_nonzero(t[1:] > t[:-1]) / (b - a)
            if t[-1] - t[0] >= LEAST_MS and forward >= LEAST_FORWARD and 1 - forward <= MOST_FROZEN:
                yield int(residue + a * stride), t


def _candidate(data: np.ndarray, layout: Layout, start: int, t: np.ndarray) -> dict | None:
    at = start + layout.stride * np.arange(len(t))
    if at[-1] + max(layout.quaternion + 16, layout.position + 12) > len(data):
        return None
    # a row for each component, as rows are passed over faster than columns
    q, p = (np.array(_field(data, at + o, "<f4", n).T, float, order="C") for o, n in ((layout.quaternion, 4), (layout.position, 3)))
    whole = np.isfinite(q).all(axis=0)
    q, seen = (q, p) if whole.all() else (q[:, whole], p[:, whole])
    n = seen.shape[1]
    if n < LEAST_RECORDS or not (np.abs(seen) <= FARTHEST).all():  # NaN is not, nor is infinity
        return None
    norm = np.sqrt((q * q).sum(axis=0))
    share = np.count_nonzero((norm > 0.8) & (norm < 1.2)) / n
    span = float(np.hypot(seen[0].max() - seen[0].min(), seen[1].max() - seen[1].min()))
    if share < LEAST_ROTATIONS or span <= LEAST_SPAN:
        return None
    nine = p[:, np.rint(np.arange(9) * (len(t) - 1) / 8).astype(int)].T
    return {
        "profile": layout.name, "start_byte": start, "end_byte": int(at[-1] + layout.stride), "records": len(t), "t0": int(t[0]), "t1": int(t[-1]), "rotations": share, "span": span,
        "score": 3 * share + 2 * min(span, 1.0) + 1 + min(len(t) / 10000, 1.0), "nine": nine.ravel().tolist(),
    }


CANDIDATES = "replay_sha string, profile string, start_byte long, end_byte long, records long, t0 long, t1 long, rotations double, span double, score double, nine array<double>"


#: The fields of a candidate in Arrow.
CANDIDATE = [
    ("profile", pa.string()), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("records", pa.int64()), ("t0", pa.int64()), ("t1", pa.int64()), ("rotations", pa.float64()),
    ("span", pa.float64()), ("score", pa.float64()), ("nine", pa.list_(pa.float64())),
]


def each_file(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Buffer]]:
    """(hash, bytes) of every recording; a NULL content has no bytes."""
    for batch in batches:
        for sha, content in zip(batch.column("replay_sha").to_pylist(), batch.column("content")):
            yield sha, content.as_buffer() if content.is_valid else pa.py_buffer(b"")


def gathered(rows: Iterable[dict], kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``rows`` in batches of some hundred, so that files with few results do not make a batch each."""
    rows = iter(rows)
    while some := list(islice(rows, BATCH_ROWS)):
        yield pa.RecordBatch.from_pylist(some, kinds)


def file_candidates(data: np.ndarray, input_lane: int | None = None) -> list[dict]:
    """Candidates of every layout in a file's bytes; with ``input_lane`` also ``rises``: when that input goes down."""
    found = []
    for layout in LAYOUTS:
        for start, t in lane_runs(data, layout.stride):
            c = _candidate(data, layout, start, t)
            if c and input_lane is not None:
                c["rises"] = input_rises(data, layout, start, t, input_lane).tolist()
            if c:
                found.append(c)
    return found


def input_rises(data: np.ndarray, layout: Layout, start: int, t: np.ndarray, lane: int) -> np.ndarray:
    """The clocks ``t`` of a run's records at which input ``lane`` (0 to 5) turns on, the first record included; none in layouts without inputs.

    They are those of ``sequences.rising_edges`` over the decoded records; bytes beyond the file's end are off.
    """
    if layout.inputs is None:
        return t[:0]
    values = data[start + layout.inputs + lane :: layout.stride][: len(t)]
    down = np.zeros(len(t), bool)
    down[: len(values)] = values != 0
    return t[down & ~np.concatenate(([False], down[:-1]))]


def stream_candidates(recordings: DataFrame) -> DataFrame:
    """Runs of records that pass the clock and the geometry gate, of every layout."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ({"replay_sha": sha} | c for sha, content in each_file(batches) for c in file_candidates(np.frombuffer(content, np.uint8)))
        yield from gathered(rows, pa.schema([("replay_sha", pa.string()), *CANDIDATE]))

    return recordings.select("replay_sha", "content").mapInArrow(scan, CANDIDATES)


def _distinct_trajectories(c: dict[str, np.ndarray]) -> dict[str, Sequence]:
    """The first of a recording's candidates, in byte order, that cover the same bytes on the same path."""
    first: list[int] = []
    span = np.maximum(1, c["t1"] - c["t0"])
    hz, size = (c["records"] - 1) * 1000 / span, c["end_byte"] - c["start_byte"]
    paths = [np.reshape(x, (9, 3)) for x in c["nine"]]
    for i in range(len(span)):
        for k in first:
            overlap = min(c["end_byte"][i], c["end_byte"][k]) - max(c["start_byte"][i], c["start_byte"][k])
            apart = np.linalg.norm(paths[i] - paths[k], axis=1)
            if (
                overlap > 0.95 * max(1, min(size[i], size[k]))
                and abs(span[i] - span[k]) <= max(250, 0.03 * max(span[i], span[k]))
                and abs(hz[i] - hz[k]) <= max(1, 0.05 * max(hz[i], hz[k]))
                and apart.mean() < 0.20
                and apart.max() < 0.75
            ):
                break
        else:
            first.append(i)
    return {n: c[n][first] for n in c if n not in ("replay_sha", "_block", "_less")}


def streams(candidates: DataFrame) -> DataFrame:
    """The vehicle streams of each recording, in byte order, with ``stream``.

    The best score's layout is the recording's; embedded poses and repeated trajectories go.
    """
    candidates = kept(candidates)  # a scan of whole files, which three tables below are made of
    best = candidates.groupBy("replay_sha").agg(F.max_by("profile", F.struct("score", "records")).alias("profile"))
    same = candidates.join(best, ["replay_sha", "profile"])
    p = same.select("replay_sha", F.col("start_byte").alias("_s"), F.col("end_byte").alias("_e"), F.col("records").alias("_n"))
    stride = next(x.stride for x in LAYOUTS if x.name == "2026")
    inside = (F.col("_n") > F.col("records")) & (F.col("_s") <= F.col("start_byte")) & (F.col("_e") >= F.col("end_byte"))
    alias = (F.col("profile") == "2026") & inside & (F.pmod(F.col("start_byte") - F.col("_s"), F.lit(stride)) == ALIAS_PHASE)
    left = same.alias("c").join(p.withColumnRenamed("replay_sha", "_sha"), (F.col("replay_sha") == F.col("_sha")) & alias, "left_anti")
    left = left.withColumns({"_block": F.lit(0), "_less": -F.col("records")})
    distinct = blockwise(left, ["replay_sha"], _distinct_trajectories, CANDIDATES.removeprefix("replay_sha string, "), ["start_byte", "_less"]).select(*[c.split()[0] for c in CANDIDATES.split(", ")])
    return distinct.withColumn("stream", F.row_number().over(Window.partitionBy("replay_sha").orderBy("start_byte")) - 1)


def state_lanes(data: np.ndarray, start: int, stride: int, records: int) -> list[dict]:
    """Lanes of bytes around the records that look like a state: 2 to 8 values up to 7 which change, but not too often.

    A lane lies at the same offset from every record's start. What is known of each lane, counts by value and
    the number of changes, adds up over stretches of records, so that memory doesn't grow with them.
    """
    lanes = np.arange(FIRST_LANE, LAST_LANE + 1)
    lanes = lanes[(start + lanes >= 0) & (start + stride * (records - 1) + lanes < len(data))]
    counts, changes = np.zeros((len(lanes), MOST_STATE + 1), np.int64), np.zeros(len(lanes), np.int64)
    last, alive = None, np.ones(len(lanes), bool)
    for at in range(0, records, LANE_RECORDS):
        first = start + stride * np.arange(at, min(at + LANE_RECORDS, records))
        v = data[first[:, None] + lanes]
        alive &= (v <= MOST_STATE).all(axis=0)
        whole = v if last is None else np.vstack((last, v))
        changes += (whole[1:] != whole[:-1]).sum(axis=0)
        counts += np.stack([(v == k).sum(axis=0) for k in range(MOST_STATE + 1)], axis=1)
        last = v[-1:]
    distinct = (counts > 0).sum(axis=1)
    found = alive & (distinct >= 2) & (changes >= LEAST_CHANGES) & (changes <= min(MOST_CHANGES, max(LEAST_CHANGES, records // 2)))
    return [{"lane": int(lanes[k]), "changes": int(changes[k]), "states": np.flatnonzero(counts[k]).tolist(), "counts": counts[k][counts[k] > 0].tolist()} for k in np.flatnonzero(found)]


def _with_streams(recordings: DataFrame, found: DataFrame) -> DataFrame:
    """Contents with the list of their streams, NULL without any: a file travels once, however many vehicles it holds.

    Contents are the left side of a left join, so that they are never broadcast, nor gathered in one task.
    """
    each = found.groupBy("replay_sha").agg(F.collect_list(F.struct("stream", "profile", "start_byte", "records")).alias("streams"))
    return recordings.select("replay_sha", "content").join(each, "replay_sha", "left")


def _each_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Layout, np.ndarray]]:
    for batch in batches:
        for sha, content, rows in zip(batch.column("replay_sha").to_pylist(), batch.column("content"), batch.column("streams").to_pylist()):
            data = np.frombuffer(content.as_buffer(), np.uint8) if rows else None
            for row in rows or []:
                yield {"replay_sha": sha} | row, next(x for x in LAYOUTS if x.name == row["profile"]), data


_LANES = "replay_sha string, stream int, lane int, changes long, states array<int>, counts array<long>"


def discover_states(recordings: DataFrame, found: DataFrame) -> DataFrame:
    """For each stream of ``streams`` the lanes that look like a state: ``replay_sha, stream, lane, changes, states, counts``."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("replay_sha", pa.string()), ("stream", pa.int32()), ("lane", pa.int32()), ("changes", pa.int64()), ("states", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
        for row, layout, data in _each_stream(batches):
            lanes = state_lanes(data, row["start_byte"], layout.stride, row["records"])
            yield pa.RecordBatch.from_pylist([{"replay_sha": row["replay_sha"], "stream": row["stream"]} | x for x in lanes], kinds)

    return _with_streams(recordings, found).mapInArrow(look, _LANES)


_ROWS = (
    "replay_sha string, stream int, i int, time_ms long, qx double, qy double, qz double, qw double, x double, y double, z double, vx double, vy double, vz double, "
    "contact_state int, lap_index int, " + ", ".join(f"input_{k} int" for k in range(60, 66))
)


def decode(recordings: DataFrame, found: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row for each record of each stream; fields that the layout lacks are NULL. ``columns`` are those to read, all unless given."""
    kinds = dict(c.split() for c in _ROWS.split(", "))
    names = [c for c in kinds if columns is None or c in columns]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, layout, data in _each_stream(batches):
            n = row["records"]
            at = row["start_byte"] + layout.stride * np.arange(n)

            def number(start: int | None, k: int) -> pa.Array:
                return pa.nulls(n, pa.float64()) if start is None else pa.array(_field(data, at + start + 4 * k, "<f4")[:, 0].astype(float))  # noqa: B023

            def whole(start: int | None) -> pa.Array:
                return pa.nulls(n, pa.int32()) if start is None else pa.array(_field(data, at + start, "<i4")[:, 0])  # noqa: B023

            made = {"replay_sha": lambda: pa.array([row["replay_sha"]] * n, pa.string()), "stream": lambda: pa.array([row["stream"]] * n, pa.int32()), "i": lambda: pa.array(np.arange(n, dtype=np.int32))}  # noqa: B023
            made["time_ms"] = lambda: pa.array(_field(data, at, "<u4")[:, 0].astype(np.int64))  # noqa: B023
            for group, start in (("qx qy qz qw", layout.quaternion), ("x y z", layout.position), ("vx vy vz", layout.velocity)):
                made |= {c: lambda start=start, k=k: number(start, k) for k, c in enumerate(group.split())}  # noqa: B023
            made |= {"contact_state": lambda: whole(layout.contact), "lap_index": lambda: whole(layout.lap)}  # noqa: B023
            for j in range(6):
                made[f"input_{60 + j}"] = lambda j=j: pa.nulls(n, pa.int32()) if layout.inputs is None else pa.array(data[at + layout.inputs + j].astype(np.int32))  # noqa: B023
            yield pa.RecordBatch.from_arrays([made[c]() for c in names], names=names)

    return _with_streams(recordings, found).mapInArrow(read, ", ".join(f"{c} {kinds[c]}" for c in names))


def telemetry(records: DataFrame) -> DataFrame:
    """Decoded records with motion: speed and its source, yaw, slip, distance, states by name."""
    keys, order = ["replay_sha", "stream"], ["i"]
    df = records.withColumns({"time_s": F.col("time_ms") / 1000.0} | {c: null_if_nan(F.col(c)) for c in ("x", "y", "z", "vx", "vy", "vz")})
    for c in ("x", "y", "z"):
        df = derivative(df, keys, order, c, "time_s", f"_d{c}")
    derived = F.sqrt(F.col("_dx") ** 2 + F.col("_dy") ** 2 + F.col("_dz") ** 2)
    yaw = quaternion_yaw(F.col("qx"), F.col("qy"), F.col("qz"), F.col("qw"))
    flat = F.hypot("_dx", "_dy")
    heading = F.when(flat > 1e-9, F.atan2("_dy", "_dx")).otherwise(yaw)
    df = df.withColumns(
        {
            "speed_derived": derived, "yaw": yaw, "slip": slip_angle(wrap_pi(yaw - heading)), "vehicle_forward_heading_rad": forward_heading(F.col("qx"), F.col("qy"), F.col("qz"), F.col("qw")),
            "_speed": speed_choice(F.col("vx"), F.col("vy"), F.col("vz"), derived), "contact_state_name": contact_state_name(F.col("contact_state")), "is_airborne": airborne(F.col("contact_state")),
        }
    )
    df = df.withColumns({"speed": F.col("_speed.speed"), "speed_source": F.col("_speed.source"), "speed_direct": F.when(is_finite(F.col("vx")), F.col("_speed.speed"))})
    df = cumulative(steps(df, keys, order), keys, order, "step", "distance")
    return df.drop("_dx", "_dy", "_dz", "_speed")


def stream_parts(rows: DataFrame) -> DataFrame:
    """Ends and rate of each physical stream, for stitching."""
    first, last = (lambda c: F.min_by(c, "i")), (lambda c: F.max_by(c, "i"))
    out = rows.groupBy("replay_sha", F.col("stream").alias("part_id")).agg(
        F.min("time_s").alias("t0"), F.max("time_s").alias("t1"), F.count("*").alias("n"),
        *[first(c).alias(f"{c}0") for c in ("x", "y", "z")], *[last(c).alias(f"{c}1") for c in ("x", "y", "z")],
    )
    return out.withColumn("hz", F.when(F.col("t1") > F.col("t0"), (F.col("n") - 1) / (F.col("t1") - F.col("t0"))).otherwise(0.0))
