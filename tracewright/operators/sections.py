"""Geometry: turn sections by hysteresis, triangles, surface coverage."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import point_in_triangle


def hysteresis_sections(samples: DataFrame, keys: Sequence[str], axis: str = "at", signal: str = "signal", valid: str = "ok", enter: float = 6.5, hold: float = 4.0,
                        bridge: float = 4.0, widen: float = 3.5, least: tuple[float, float] = (5.0, 12.0), merge: float = 3.0) -> DataFrame:
    """Turns on samples at equal distances: a turn begins at ``enter`` and lasts while held.

    It ends where the signal stays under ``hold`` for more than ``bridge``. Turns are widened both ways;
    those shorter than ``least[0]`` whose peak is under ``least[1]`` are dropped; overlapping turns, and
    turns of one direction within ``merge``, become one.
    """
    kinds = dict(samples.dtypes)

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(axis, kind="stable")
        d, v, ok = pdf[axis].to_numpy(float), pdf[signal].to_numpy(float), pdf[valid].to_numpy(bool)
        low, high = d[0], d[-1]
        d, v = d[ok], v[ok]
        held = np.flatnonzero(np.abs(v) >= hold)
        found: list[list] = []
        # stretches of held samples no farther apart than the bridge, from their first entry on
        for run in np.split(held, np.flatnonzero(np.diff(d[held]) > bridge) + 1) if len(held) else []:
            into = run[np.abs(v[run]) >= enter]
            if not len(into):
                continue
            run = run[run >= into[0]]
            part = v[run[0] : run[-1] + 1]
            peak = part[np.abs(part).argmax()]
            a, b = max(low, d[run[0]] - widen), min(high, d[run[-1]] + widen)
            if b - a >= least[0] or abs(peak) >= least[1]:
                found.append([a, b, float(peak)])
        merged: list[list] = []
        for a, b, peak in found:
            last = merged[-1] if merged else None
            if last and (a <= last[1] or (a - last[1] <= merge and (peak > 0) == (last[2] > 0))):
                last[1] = max(last[1], b)
                last[2] = max(last[2], peak, key=abs)
            else:
                merged.append([a, b, peak])
        out = pd.DataFrame(merged, columns=["start_d", "end_d", "peak_deg"])
        out.insert(0, "section", np.arange(1, len(out) + 1))
        for c in reversed(list(keys)):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", section long, start_d double, end_d double, peak_deg double"
    out = samples.select(*keys, axis, signal, valid).groupBy(*keys).applyInPandas(cut, schema)
    return out.withColumn("direction", F.when(F.col("peak_deg") > 0, "left").when(F.col("peak_deg") < 0, "right").otherwise("neutral"))


def triangle_cells(triangles: DataFrame, keys: Sequence[str], cell: float, eps: float = 0.35) -> DataFrame:
    """Triangles (``tri_id, ax .. cy``) once for each grid cell that their bounding box touches."""
    x, y = [F.col(c) for c in ("ax", "bx", "cx")], [F.col(c) for c in ("ay", "by", "cy")]
    span = lambda v: F.sequence(F.floor((F.least(*v) - eps) / cell), F.floor((F.greatest(*v) + eps) / cell))
    return triangles.withColumn("cell_x", F.explode(span(x))).withColumn("cell_y", F.explode(span(y)))


def on_surface(points: DataFrame, triangles: DataFrame, keys: Sequence[str], cell: float = 50.0, eps: float = 0.35) -> DataFrame:
    """``points`` (``x, y``) with ``on_surface``: whether a triangle of their cell holds them."""
    t = triangle_cells(triangles, keys, cell, eps)
    names = points.columns
    p = points.withColumns({"_id": F.monotonically_increasing_id(), "cell_x": F.floor(F.col("x") / cell), "cell_y": F.floor(F.col("y") / cell)})
    side = t.select(*keys, "cell_x", "cell_y", *[F.col(c).alias(f"_{c}") for c in ("ax", "ay", "bx", "by", "cx", "cy")])
    inside = point_in_triangle(F.col("x"), F.col("y"), [F.col(f"_{c}") for c in ("ax", "ay", "bx", "by", "cx", "cy")], eps)
    j = p.join(side, [*keys, "cell_x", "cell_y"], "left").withColumn("_in", F.coalesce(inside, F.lit(False)))
    return j.groupBy("_id", *names).agg(F.max("_in").alias("on_surface")).drop("_id")


def coverage(points: DataFrame, triangles: DataFrame, keys: Sequence[str], group: Sequence[str], most: int = 100) -> DataFrame:
    """Share of each group's points, every n-th of them, that lie on the surface; NULL without any."""
    w = Window.partitionBy(*group)
    rows = points.withColumns({"_i": F.row_number().over(w.orderBy("i")) - 1, "_n": F.count("*").over(w)})
    kept = rows.where(f"_i % greatest(1, ceil(_n / {most})) = 0").drop("_i", "_n")
    return on_surface(kept, triangles, keys).groupBy(*group).agg(F.avg(F.col("on_surface").cast("int")).alias("coverage"), F.count("*").alias("sampled"))
