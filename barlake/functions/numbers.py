"""Tolerant number parsing and guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barlake.functions.text import stripped

# Texts that count as whole numbers, as numbers without and with exponent / infinities, and as zero.
# Text is matched before it is cast, because a cast that fails is slow.
WHOLE_NUMBER = r"^\s*[+-]?\d+\s*$"
DECIMAL_NUMBER = r"^[+-]?(\d+\.\d*|\d*\.\d+|\d+)$"
ANY_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf(inity)?|nan))\s*$"
ZERO = r"^[+-]?(0+\.?0*|\.0+)$"


def to_float(text: Column) -> Column:
    """Number text to double; blank or bad text, the words true and false too, to null.

    The text nan / inf passes through. The pattern also keeps out Java's own
    spellings ("1d", "0x1p3"); the expression is kept small, as a row of many
    such columns is one compiled method.
    """
    return F.when(text.rlike(ANY_NUMBER), text.try_cast("double"))


def to_int(text: Column) -> Column:
    """As :func:`to_float`, but whole: decimals truncate toward zero, NaN / Inf / overflow give null."""
    return F.when(text.rlike(WHOLE_NUMBER), text.try_cast("bigint")).otherwise(to_float(text).try_cast("bigint"))


def maybe_numeric(text: Column) -> Column:
    """Trimmed text with its numeric readings, as struct(value_str, value_long, value_double).

    Whole numbers fill both numeric fields, decimals only the double; text
    with an exponent stays text; blank is all null.
    """
    t = stripped(text)
    filled = F.when(t != "", t)
    return F.struct(
        filled.alias("value_str"),
        F.when(t.rlike(WHOLE_NUMBER), t.try_cast("bigint")).alias("value_long"),
        F.when(t.rlike(DECIMAL_NUMBER), t.try_cast("double")).alias("value_double"),
    )


def truthy(text: Column) -> Column:
    """Null for blank, false and zero, so that ``coalesce`` falls through them."""
    t = stripped(text)
    return F.when(~((t == "") | (t == "false") | t.rlike(ZERO)), text)


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def finite(value: Column) -> Column:
    """The value if it is a finite number, else null."""
    return F.when(is_finite(value), value)


def exact_sum(value: Column) -> Column:
    """Sum of finite doubles that hardly depends on the order of addition.

    Values below 2 ** 33 are cut at 2 ** -20. The upper parts add without
    error up to 2 ** 33, the lower parts with a far smaller one than a plain
    sum. Beyond 2 ** 33 the sum is no worse than a plain one.
    """
    upper = F.when(F.abs(value) < 2.0**33, F.rint(value * 2.0**20) / 2.0**20).otherwise(value)
    return F.sum(upper) + F.sum(value - upper)


def guarded_ratio(buy: Column, sell: Column) -> Column:
    return F.when(buy.isNotNull() & (sell != 0), buy / sell)


def basis_bps(mark: Column, index: Column) -> Column:
    """Mark over index in basis points; null when either is missing or index is 0."""
    return F.when(mark.isNotNull() & (index != 0), (mark / index - 1) * 10000)
