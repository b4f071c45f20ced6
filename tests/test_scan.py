"""One pass over the contents of recordings, against the operators that each read them."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracewright import queries_native
from tracewright.operators import sequences as seq
from tracewright.sources import native_tables, recordings, synthetic

KINDS = "replay_sha string, content binary"


def test_contents_are_read_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def make(batches):
        for batch in batches:
            for u in batch.column("id").to_pylist():
                made.add(1)
                yield pa.RecordBatch.from_arrays([pa.array([f"sha{u:05d}"]), pa.array([queries_native._recording(u)], pa.binary())], names=["replay_sha", "content"])

    monkeypatch.setattr(queries_native, "_recordings", lambda s, d: s.range(6).mapInArrow(make, KINDS))
    got = queries_native.drift_table_decode(spark, "").orderBy("replay_sha", "stream", "ordinal").collect()
    assert made.value == 6  # 18 when candidates, key presses and tables were each read from the contents
    assert [(r.stream, r.start_t) for r in got if r.replay_sha == "sha00003"] == [(0, 343), (0, 1023), (0, 2043), (1, 527), (1, 2527), (1, 4530)]


def test_one_pass_gives_what_each_scan_gives(spark):
    one = synthetic.vehicle_records(240, presses=[(0, 3), (20, 24), (239, 240)], second_phase=recordings.ALIAS_PHASE, second_shift=3.0)
    two = synthetic.vehicle_records(120, 50, 30, 0.5, 40.0, presses=[(90, 120)])
    old = synthetic.vehicle_records(240, 17, 0, 0.25, layout="2021", wave=0.0)
    table = synthetic.toggle_table([(340, 700), (1020, 1400), (2040, 2400)]) + synthetic.effect_table([(100, 1, 2001.0), (400, 0, 2001.0)]) + b"\xff" * 64
    contents = [one + b"\xff" * 512 + two + b"\xff" * 512 + table + table, b"\xff" * 300_000 + table, old + b"\xff" * 512, b"\x01" * 3, b"", None]
    r = spark.createDataFrame([(f"r{k}", None if c is None else bytearray(c)) for k, c in enumerate(contents)], KINDS)
    candidates, tables, rises = native_tables.scan_files(r, 4)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(candidates) == rows(recordings.stream_candidates(r)) and candidates.count() == 4
    assert rows(tables) == rows(native_tables.drift_tables(r)) and tables.count() == 3
    found = recordings.streams(candidates)
    told = rises.join(found, ["replay_sha", "profile", "start_byte"]).select("replay_sha", "stream", "t")
    rows_of = recordings.decode(r, found, ["replay_sha", "stream", "i", "time_ms", "input_64"])
    edges = seq.rising_edges(rows_of, ["replay_sha", "stream"], ["i"], F.col("input_64") != 0)
    assert rows(told) == rows(edges.select("replay_sha", "stream", F.col("time_ms").alias("t")))
    assert sorted((x.stream, x.t) for x in told.collect()) == [(0, 0), (0, 340), (0, 4063), (1, 4530)]


def test_a_press_beyond_the_end_is_none():
    layout = next(x for x in recordings.LAYOUTS if x.name == "2026")
    data = np.frombuffer(synthetic.vehicle_records(100, presses=[(10, 12), (99, 100)]), np.uint8)
    t = 17 * np.arange(100)
    assert recordings.input_rises(data, layout, 0, t, 4).tolist() == [170, 1683]
    assert recordings.input_rises(data[: 99 * layout.stride + 40], layout, 0, t, 4).tolist() == [170]
    assert recordings.input_rises(data, recordings.LAYOUTS[0], 0, t, 4).tolist() == []


def test_results_of_many_files_share_a_batch():
    rows = [{"replay_sha": f"r{k}", "count_offset": k} for k in range(3 * recordings.BATCH_ROWS + 1)]
    batches = list(recordings.gathered(rows, pa.schema([("replay_sha", pa.string()), ("count_offset", pa.int64())])))
    assert [b.num_rows for b in batches] == [recordings.BATCH_ROWS] * 3 + [1] and list(recordings.gathered([], batches[0].schema)) == []


def test_lanes_are_counted_over_any_number_of_rows():
    data = synthetic.vehicle_records(1200) + b"\0" * 77
    (run,) = [x for x in recordings.lane_runs(np.frombuffer(data, np.uint8), 230) if x[0] == 0]
    assert run[1].tolist() == list(range(0, 1200 * 17, 17))
    flags = np.zeros(1003, bool)
    flags[[0, 7, 8, 500, 999, 1002]] = True
    for n in (0, 5, 8, 1003):
        assert native_tables._set(flags[:n]).tolist() == np.flatnonzero(flags[:n]).tolist()
