"""Column -> Column helpers; everything here stays in the JVM."""

from barlake.functions.numbers import (
    basis_bps, exact_sum, finite, guarded_ratio, is_finite, maybe_numeric, to_float, to_int, truthy,
)
from barlake.functions.text import clean_key, interval_of, note_label, slug, symbol_in_path, symbol_or
from barlake.functions.times import (
    bucket_floor, iso_utc, iso_utc_millis, marker_times, mixed_time_ms, timeframe_ms, ts_from_ms,
)

__all__ = [
    "basis_bps", "bucket_floor", "clean_key", "exact_sum", "finite", "guarded_ratio", "interval_of", "is_finite",
    "iso_utc", "iso_utc_millis", "marker_times", "maybe_numeric", "mixed_time_ms", "note_label", "slug",
    "symbol_in_path", "symbol_or", "timeframe_ms", "to_float", "to_int", "truthy", "ts_from_ms",
]
