"""Scalar column functions for motion data. All of them keep NULL as NULL: absent is not zero."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

#: Names of the wheel contact states 0 to 5.
CONTACT_STATES = ("in_air", "none_contact", "one_contact", "two_contact", "three_contact", "full_contact")
#: Below this many seconds a time difference counts as none.
EQUAL_S = 0.0005


def null_if_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def to_double(x: Column) -> Column:
    """A finite number, or NULL for anything else."""
    value = x.try_cast("double")
    return F.when(is_finite(value), value)


def to_bool(x: Column) -> Column:
    """Whether a text reads ``true`` or ``1``; NULL stays."""
    return F.lower(F.trim(x.cast("string"))).isin("true", "1")


def round_even(x: Column, digits: int) -> Column:
    """Half-even rounding by scaling, the same bit for bit wherever doubles are IEEE."""
    scale = float(10**digits)
    return F.rint(x * scale) / scale


def clamp01(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def wrap_pi(x: Column) -> Column:
    """An angle in [-pi, pi)."""
    return F.pmod(x + math.pi, F.lit(2 * math.pi)) - math.pi


def hypot3(dx: Column, dy: Column, dz: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def quaternion_yaw(x: Column, y: Column, z: Column, w: Column) -> Column:
    return F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def forward_heading(x: Column, y: Column, z: Column, w: Column) -> Column:
    """Heading in the ground plane of the local -Y axis turned by a quaternion."""
    return F.atan2(-(1 - 2 * (x * x + z * z)), -2 * (x * y - w * z))


def angle_delta_deg(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Signed turn in degrees from vector a to vector b; 0 if either is shorter than 1e-9."""
    short = (F.hypot(ax, ay) < 1e-9) | (F.hypot(bx, by) < 1e-9)
    return F.when(short, 0.0).otherwise(F.degrees(F.atan2(ax * by - ay * bx, ax * bx + ay * by)))


def contact_state_name(state: Column) -> Column:
    name = F.when(state.isNull(), None)
    for k, n in enumerate(CONTACT_STATES):
        name = name.when(state == k, n)
    return name.otherwise(F.concat(F.lit("unknown_"), state.cast("string")))


def airborne(state: Column) -> Column:
    """True in the air, false in full contact, else unknown."""
    return F.when(state == 0, True).when(state == 5, False)


def slip_angle(raw: Column) -> Column:
    """Slip folded to [-pi/2, pi/2] around a quarter turn, with the sign of ``raw``; 0 if not finite."""
    size = F.least(F.lit(math.pi / 2), F.abs(F.abs(raw) - math.pi / 2))
    return F.when(is_finite(raw), F.when(raw >= 0, size).otherwise(-size)).otherwise(0.0)


def speed_choice(vx: Column, vy: Column, vz: Column, derived: Column) -> Column:
    """Struct (speed, source): the recorded velocity's norm where it is finite, else the derived one."""
    norm = hypot3(vx, vy, vz)
    good = is_finite(vx) & is_finite(vy) & is_finite(vz)
    return F.struct(
        F.when(good, norm).otherwise(derived).alias("speed"),
        F.when(good, "replay_linear_velocity").otherwise("position_derived").alias("source"),
    )


def delta(subject: Column, baseline: Column) -> Column:
    """Subject minus baseline: above 0 is slower or more. NULL if either is missing."""
    return subject - baseline


def delta_direction(d: Column, equal: float = EQUAL_S) -> Column:
    return F.when(F.abs(d) < equal, "equal").when(d > 0, "loss").when(d < 0, "gain")


def signed_text(x: Column, digits: int = 3) -> Column:
    """``x`` with its sign, rounded by its exact binary value; Java's formats round the shortest decimal text of it."""

    @F.arrow_udf(StringType())
    def text(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f"{v:+.{digits}f}" for v in values.to_pylist()], pa.string())

    return text(x.cast("double"))


def observation(label: Column, d: Column) -> Column:
    """A sentence about one window's difference; NULL where the difference is unknown."""
    said = F.when(delta_direction(d) == "loss", "slower").when(delta_direction(d) == "gain", "faster").otherwise("equal")
    return F.when(d.isNotNull(), F.concat_ws(" ", label, signed_text(d), F.lit("s"), said))


def display_speed(v: Column) -> Column:
    """Whole display units: 15.4 a metre per second, never below 0."""
    return F.floor(F.greatest(F.lit(0.0), v * 15.4)).cast("long")


def to_canvas(x: Column, y: Column, scale: float, shift_x: float, shift_y: float, flip_height: float | None = None) -> Column:
    """World to picture coordinates; with a height, the vertical axis points down."""
    v = y * scale + shift_y
    return F.struct((x * scale + shift_x).alias("u"), (v if flip_height is None else flip_height - v).alias("v"))


def point_in_triangle(px: Column, py: Column, t: list[Column], eps: float = 0.35) -> Column:
    """Whether a point is inside ``ax, ay, bx, by, cx, cy`` or within ``eps`` of its edges' cross products."""
    ax, ay, bx, by, cx, cy = t

    def side(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        return (x1 - x0) * (py - y0) - (y1 - y0) * (px - x0)

    s = [side(ax, ay, bx, by), side(bx, by, cx, cy), side(cx, cy, ax, ay)]
    return ((s[0] >= -eps) & (s[1] >= -eps) & (s[2] >= -eps)) | ((s[0] <= eps) & (s[1] <= eps) & (s[2] <= eps))


@F.arrow_udf(IntegerType())
def _bits(x: pa.Array) -> pa.Array:
    import numpy as np

    raw = x.fill_null(0).to_numpy(zero_copy_only=False).astype("<f4").view("<i4")
    return pa.array(raw, mask=np.asarray(x.is_null()))


def float_bits(x: Column) -> Column:
    """The bit pattern of a 32-bit float as an integer: the identity of an effect code."""
    return _bits(x.cast("float"))
