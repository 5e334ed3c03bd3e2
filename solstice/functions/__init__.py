"""Column expressions (built-in Spark functions only; no Python UDFs)."""

from solstice.functions.numeric import sround, c_to_f, delta_c_to_f, tenths, f_to_c, inch_to_mm
from solstice.functions.dates import doy, circular_doy_distance, band_offsets, shift_doy, to_date_col
from solstice.functions.classify import (
    percentile_from_quantiles, severity, severity_level, direction, severity_display,
    period_verdict, ordinal_suffix, ordinal, deviation,
)
from solstice.functions.text import window_label, period_label, days_label, primary_statement, supporting_line, headline
from solstice.functions.geo import haversine_km, bbox_deltas

__all__ = [
    "sround", "c_to_f", "delta_c_to_f", "tenths", "f_to_c", "inch_to_mm",
    "doy", "circular_doy_distance", "band_offsets", "shift_doy", "to_date_col",
    "percentile_from_quantiles", "severity", "severity_level", "direction", "severity_display",
    "period_verdict", "ordinal_suffix", "ordinal", "deviation",
    "window_label", "period_label", "days_label", "primary_statement", "supporting_line", "headline",
    "haversine_km", "bbox_deltas",
]
