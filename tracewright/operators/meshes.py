"""Projections of triangle meshes onto planes, and the transform of a map onto its canvas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import is_finite

#: Planes in the order in which equal ones are preferred, as (name, two axes, depth).
PLANES = (("xy", "x", "y", "z"), ("xz", "x", "z", "y"), ("yz", "y", "z", "x"))
CORNERS = ("a", "b", "c")
CANVAS, PAD, LEAST_SPAN = 1200.0, 35.0, 1e-6
#: Triangles, and thickness, from which a map counts as flat.
LEAST_TRIANGLES, FLAT = 4, 0.25


def _reach(axis: str, over: Column) -> list[Column]:
    """Least and greatest coordinate of a triangle's corners of which all three coordinates are finite."""
    at = [F.when(_whole(c), F.col(f"{c}{axis}")) for c in CORNERS]
    return [F.min(F.when(over, F.least(*at))).alias(f"min_{axis}"), F.max(F.when(over, F.greatest(*at))).alias(f"max_{axis}")]


def _whole(corner: str) -> Column:
    return is_finite(F.col(f"{corner}x")) & is_finite(F.col(f"{corner}y")) & is_finite(F.col(f"{corner}z"))


def mesh_bounds(triangles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bounds of each mesh of ``triangles`` (``ax, ay, az, bx, ... cz, hidden``): ``min_x, max_x, ..., triangles, vertices``.

    Hidden triangles and corners that are not finite are left out; a mesh without any keeps a row with
    NULL bounds. One aggregation, merged before the shuffle.
    """
    seen = ~F.coalesce(F.col("hidden"), F.lit(False))
    corners = sum((F.when(_whole(c), 1).otherwise(0) for c in CORNERS), F.lit(0))
    return triangles.groupBy(*keys).agg(*_reach("x", seen), *_reach("y", seen), *_reach("z", seen), F.count_if(seen).alias("triangles"), F.coalesce(F.sum(F.when(seen, corners)), F.lit(0)).alias("vertices"))


def mesh_projections(triangles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each mesh and plane: bounds, spans, depth and ``thickness``, the depth as a share of the larger span.

    Without a visible corner, or where both spans vanish, the thickness is infinite.
    """
    rows = mesh_bounds(triangles, keys)

    def plane(order: int, name: str, a: str, b: str, d: str) -> Column:
        span = {x: F.coalesce(F.col(f"max_{x}") - F.col(f"min_{x}"), F.lit(0.0)) for x in (a, b, d)}
        wide = F.greatest(span[a], span[b])
        ends = [F.coalesce(f"{m}_{x}", F.lit(0.0)).alias(f"{m}_{s}") for s, x in (("a", a), ("b", b), ("depth", d)) for m in ("min", "max")]
        thick = F.when((F.col("vertices") > 0) & (wide > 1e-9), span[d] / wide).otherwise(F.lit(float("inf")))
        return F.struct(F.lit(order).alias("plane_order"), F.lit(name).alias("plane"), *ends, span[a].alias("span_a"), span[b].alias("span_b"), span[d].alias("depth"), thick.alias("thickness"))

    return rows.select(*keys, "triangles", "vertices", F.explode(F.array(*[plane(k, *p) for k, p in enumerate(PLANES)])).alias("p")).select(*keys, "triangles", "vertices", "p.*")


def best_projection(projections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The thinnest plane of each mesh, the first of ``PLANES`` on a tie, and whether the mesh is ``flat``."""
    columns = [c for c in projections.columns if c not in keys]
    best = projections.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct("thickness", "plane_order")).alias("p")).select(*keys, "p.*")
    return best.withColumn("flat", (F.col("triangles") >= LEAST_TRIANGLES) & (F.col("thickness") <= FLAT)).drop("plane_order")


def map_transform(best: DataFrame, keys: Sequence[str], canvas: float = CANVAS, pad: float = PAD) -> DataFrame:
    """The transform of each mesh onto a square canvas, y upwards; refused, with NULLs, unless its plane is ``xy``.

    ``scale`` fits the larger span between the margins, ``offset_x`` and ``offset_y`` centre the map.
    """
    promoted = (F.col("plane") == "xy") & (F.col("vertices") > 0)
    span_a, span_b = F.greatest(F.col("span_a"), F.lit(LEAST_SPAN)), F.greatest(F.col("span_b"), F.lit(LEAST_SPAN))
    scale = F.least((canvas - 2 * pad) / span_a, (canvas - 2 * pad) / span_b)
    row = {"scale": scale, "offset_x": (canvas - span_a * scale) / 2, "offset_y": (canvas - span_b * scale) / 2, "world_min_x": F.col("min_a"), "world_min_y": F.col("min_b"), "world_max_x": F.col("max_a"), "world_max_y": F.col("max_b")}
    status = F.when(F.col("vertices") == 0, "no_visible_geometry").when(F.col("plane") != "xy", "plane_is_not_xy").otherwise("official")
    return best.select(*keys, status.alias("status"), *[F.when(promoted, c).alias(n) for n, c in row.items()], F.lit(canvas).alias("canvas"))


def to_canvas(points: DataFrame, transforms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``points`` (``x, y`` in world units) with ``canvas_x, canvas_y``; NULL where the map has no transform."""
    t = transforms.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("scale", "offset_x", "offset_y", "world_min_x", "world_min_y", "canvas")])
    j = points.join(t, list(keys), "left")
    x = F.col("_offset_x") + (F.col("x") - F.col("_world_min_x")) * F.col("_scale")
    y = F.col("_canvas") - (F.col("_offset_y") + (F.col("y") - F.col("_world_min_y")) * F.col("_scale"))
    return j.select(*points.columns, x.alias("canvas_x"), y.alias("canvas_y"))
