"""Column helpers shared by every layer."""

from .dates import (
    day_name, days_between, month_key, month_label, months_between_boundaries, truncate_to, weekday_number,
)
from .money import cents_to_dollars, ratio_pct, round_half_away, round_half_even, safe_div
from .text import surrogate_key, value_map

__all__ = [
    "cents_to_dollars", "day_name", "days_between", "month_key", "month_label", "months_between_boundaries",
    "ratio_pct", "round_half_away", "round_half_even", "safe_div", "surrogate_key", "truncate_to", "value_map",
    "weekday_number",
]
