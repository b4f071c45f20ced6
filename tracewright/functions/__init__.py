from .names import archive_rank, display_alias, filename_hint, filename_time, name_is_usable, normalize_name, positive_ids
from .scalar import (
    angle_delta_deg, clamp01, contact_state_name, delta, delta_direction, display_speed, float_bits, forward_heading, hypot3, is_finite,
    null_if_nan, point_in_triangle, quaternion_yaw, round_even, signed_text, slip_angle, speed_choice, to_bool, to_canvas, to_double, wrap_pi,
)

__all__ = [n for n in dir() if not n.startswith("_") and n not in ("names", "scalar")]
