from shelflife.functions.dates import horizon_days, month_end, month_start, serial_to_date
from shelflife.functions.keys import composite_key, strip_dashes
from shelflife.functions.logic import days_range, floor_at_zero, if_else, or_zero
from shelflife.functions.numbers import divide, percent_text, round_half_even

__all__ = [
    "composite_key",
    "days_range",
    "divide",
    "floor_at_zero",
    "horizon_days",
    "if_else",
    "month_end",
    "month_start",
    "or_zero",
    "percent_text",
    "round_half_even",
    "serial_to_date",
    "strip_dashes",
]
