"""Exact medians of groups of any size.

The built-in exact median gathers all distinct values of a group in one task.
Here values are first counted per bin of a fixed, order-keeping grid (a
map-side combined count of a few thousand bins per group). Only values in the
bin that holds the middle are looked at again, on a finer grid, and only the
values of that fine bin are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FINE_BITS = 24  # grid steps per power of two, as a power of two
COARSE_SHIFT = 12


def order_bin(value: Column) -> Column:
    """Whole number that never decreases with the value: 2**FINE_BITS steps per power of two."""
    steps = 1 << FINE_BITS
    size = F.abs(value)
    exponent = F.floor(F.log2(size))
    step = exponent * steps + F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * steps)
    shifted = step + 1100 * steps  # exponents start at -1074
    return F.when(value == 0, F.lit(0).cast("bigint")).when(value > 0, shifted).otherwise(-shifted)


def _holding_middle(bins: DataFrame, group: list[str], by: str) -> DataFrame:
    """Of bins with counts ``_n``, those that hold a middle rank; ``_before`` moves up to their start."""
    upto = F.sum("_n").over(Window.partitionBy(*group).orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    return (
        bins.withColumn("_upto", F.col("_before") + upto)
        .withColumn("_before", F.col("_upto") - F.col("_n"))
        .where(
            F.col("_lo").between(F.col("_before") + 1, F.col("_upto"))
            | F.col("_hi").between(F.col("_before") + 1, F.col("_upto"))
        )
        .drop("_n")
    )


def _coarse_middle(bins: DataFrame, keys: list[str]) -> DataFrame:
    total = F.sum("_n").over(Window.partitionBy(*keys))
    ranked = bins.withColumns({
        "_lo": F.floor((total + 1) / 2), "_hi": F.floor((total + 2) / 2), "_before": F.lit(0).cast("bigint"),
    })
    return _holding_middle(ranked, keys, "_coarse").drop("_upto")


def exact_median(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per key with ``median``; null and non-finite values must be filtered out before."""
    fine_bin = order_bin(F.col("_v"))
    keyed = values.select(*keys, F.col(value).alias("_v")).withColumns(
        {"_fine": fine_bin, "_coarse": F.shiftright(fine_bin, COARSE_SHIFT)}
    )
    exact = [*keys, "_coarse", "_fine", "_v"]
    ranks = ["_lo", "_hi", "_before"]
    # equal values collapse first, so that a value most rows share is one row in the join
    distinct = keyed.groupBy(*exact).agg(F.count("*").alias("_n"))
    middle = _coarse_middle(distinct.groupBy(*keys, "_coarse").agg(F.sum("_n").alias("_n")), keys)
    counted = distinct.join(middle, [*keys, "_coarse"])

    fine = counted.groupBy(*keys, "_coarse", *ranks, "_fine").agg(F.sum("_n").alias("_n"))
    middle = _holding_middle(fine, [*keys, "_coarse"], "_fine").drop("_upto", "_lo", "_hi")

    last = counted.drop("_before").join(middle, [*keys, "_coarse", "_fine"])
    found = _holding_middle(last, [*keys, "_coarse", "_fine"], "_v")

    def at(rank: str) -> Column:
        return F.max(F.when(F.col(rank).between(F.col("_before") + 1, F.col("_upto")), F.col("_v")))

    return found.groupBy(*keys).agg(((at("_lo") + at("_hi")) / 2).alias("median"))
