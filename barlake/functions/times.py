"""Epoch-millisecond time handling; everything is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barlake.functions.text import stripped
from barlake.schemas import TIMEFRAMES

# Accepted timestamp texts (upper case, T between date and time).
NUMBER_TEXT = r"^[+-]?\d+(\.\d+)?$"
DATE_TIME_TEXT = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?$"
SECONDS_BELOW = 1e12
LAST_DATE_MS = 8.64e15
FIRST_YEAR_MS, LAST_YEAR_MS = -62_135_596_800_000, 253_402_300_799_999


def ts_from_ms(ms: Column) -> Column:
    """The timestamp; null outside the years 1 to 9999."""
    return F.when(ms.between(FIRST_YEAR_MS, LAST_YEAR_MS), F.timestamp_millis(ms))


def timeframe_ms(timeframe: str) -> int:
    """Bucket width; an unknown timeframe counts as one minute."""
    return TIMEFRAMES.get(timeframe, 1) * 60_000


def bucket_floor(ms: Column, width_ms: int | Column) -> Column:
    """Start of the epoch-aligned bucket that holds ``ms`` (floors, also before 1970)."""
    width = F.lit(width_ms) if isinstance(width_ms, int) else width_ms
    return ms - F.pmod(ms, width)


def _whole_seconds(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss")


def iso_utc(ms: Column) -> Column:
    """ISO text with +00:00; a fraction (six digits) only when there is one."""
    fraction = F.when(F.pmod(ms, F.lit(1000)) != 0, F.date_format(F.timestamp_millis(ms), ".SSSSSS"))
    return F.concat(_whole_seconds(ms), F.coalesce(fraction, F.lit("")), F.lit("+00:00"))


def iso_utc_millis(ms: Column) -> Column:
    """ISO text with three fraction digits and Z."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def mixed_time_ms(text: Column) -> Column:
    """Number or date text to epoch milliseconds.

    Numbers below 1e12 are seconds, others milliseconds. Text without a zone
    is UTC, a bare date is midnight, anything else is null.
    """
    t = stripped(text)
    number = t.try_cast("double")
    ms = F.when(number < SECONDS_BELOW, number * 1000).otherwise(number)
    scaled = F.when(F.abs(ms) <= LAST_DATE_MS, F.floor(ms + 0.5))
    iso = F.upper(F.regexp_replace(t, " ", "T"))
    seconds = F.regexp_replace(iso, r"T(\d{2}:\d{2})(?=$|[Z+-])", "T$1:00")
    zoned = F.regexp_replace(seconds, r"(T.*[+-]\d{2})(\d{2})$", "$1:$2")
    dated = F.when(iso.rlike(DATE_TIME_TEXT), F.unix_millis(F.try_to_timestamp(zoned)))
    return F.when(t.rlike(NUMBER_TEXT), scaled).otherwise(dated)


def marker_times(marks: Column) -> Column:
    """Marker texts as sorted, distinct ISO times; what does not parse is dropped."""
    ms = F.filter(F.transform(marks, mixed_time_ms), lambda x: x.isNotNull())
    return F.transform(F.array_sort(F.array_distinct(ms)), iso_utc_millis)
