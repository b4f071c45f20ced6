"""Recordings in memory, for tests and for the queries that decode bytes."""

from __future__ import annotations

import struct

import numpy as np

from .native_tables import MARKER, TRAILER
from .recordings import LAYOUTS


def vehicle_records(
    n: int = 240, step_ms: int = 17, start_ms: int = 0, scale: float = 0.2, shift: float = 0.0, layout: str = "2026", wave: float = 2.0, yaw: float = 0.0,
    presses: list[tuple[int, int]] | None = None, second_phase: int | None = None, second_shift: float = 0.0,
) -> bytes:
    """Records of ``layout`` on a gentle wave: two laps, speed 11.765 and full contact, where the layout has them.

    ``presses`` are the records (first, after the last) in which the drift key is down. ``second_phase`` puts
    a second pose so many bytes after each record's start: the same path, or one moved by ``second_shift``, which lacks
    the last record.
    """
    of = next(x for x in LAYOUTS if x.name == layout)
    out, i = np.zeros((n, of.stride), np.uint8), np.arange(n)

    def put(at: int, kind: str, *values: np.ndarray | float, rows: int = n) -> None:
        raw = np.stack([np.broadcast_to(v, n) for v in values], axis=1).astype(kind)
        out[:rows, at : at + 4 * len(values)] = raw.view(np.uint8)[:rows]

    def pose(o: int, moved: float, rows: int = n) -> None:
        put(o, "<u4", start_ms + i * step_ms, rows=rows)
        put(o + of.quaternion, "<f4", 0.0, 0.0, np.sin(yaw / 2), np.cos(yaw / 2), rows=rows)
        put(o + of.position, "<f4", scale * i + shift, wave * np.sin(i / 30) + moved, 0.0, rows=rows)

    pose(0, 0.0)
    if second_phase is not None:
        pose(second_phase, second_shift, n if not second_shift else n - 1)
    if of.contact is not None:
        put(of.contact, "<i4", 5)
        put(of.lap, "<i4", np.where(i < n // 2, 1, 2))
        for c in range(6):
            down = (i + c) % 23 < 4
            if presses is not None and c == 4:
                down = np.any([(a <= i) & (i < b) for a, b in presses] or [np.zeros(n, bool)], axis=0)
            out[:, of.inputs + c] = down
    if of.velocity is not None:
        put(of.velocity, "<f4", 11.765, 0.0, 0.0)
    return out.tobytes()


def toggle_table(intervals: list[tuple[int, int]], marked: bool = True) -> bytes:
    rows = b"".join(struct.pack("<IBIB", a, 1, b, 0) for a, b in intervals)
    return (MARKER if marked else b"") + struct.pack("<I", 2 * len(intervals)) + rows


def effect_table(records: list[tuple[int, int, float]]) -> bytes:
    return struct.pack("<I", len(records)) + b"".join(struct.pack("<IBf", *r) for r in records)


def action_table(times: list[int], codes: list[int], trailer: int = TRAILER) -> bytes:
    rows = b"".join(struct.pack("<III", t, c, 0) for t, c in zip(times, codes))
    return struct.pack("<I", len(times)) + rows + b"\xff" * trailer


def recording(vehicles: list[bytes], intervals: list[tuple[int, int]], effects: list[tuple[int, int, float]], times: list[int], codes: list[int]) -> bytes:
    """A container: vehicles, filler, drift table with its effects, action table, trailer."""
    gap = b"\xff" * 512
    body = b"".join(v + gap for v in vehicles)
    return body + toggle_table(intervals) + effect_table(effects) + b"\xff" * 64 + action_table(times, codes)
