"""Literal in / out cases of the Column helpers."""

import math

import pytest
from pyspark.sql import functions as F

from barlake import functions as fn


def values(spark, expression, inputs, type_="string"):
    rows = spark.createDataFrame(list(enumerate(inputs)), f"i INT, x {type_}")
    return [r[1] for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_to_int(spark):
    cases = {
        "1.9": 1, "-1.9": -1, " 7 ": 7, "": None, "x": None, "true": None, "false": None, '"NaN"': None, "1e3": 1000,
        "inf": None, "nan": None, "1e300": None, "9223372036854775807": 9223372036854775807, "+5": 5, "7d": None,
        "1_000": None, None: None,
    }
    assert values(spark, fn.to_int, cases) == list(cases.values())


def test_to_float(spark):
    cases = {
        "1.5": 1.5, "": None, " ": None, "x": None, "true": None, "false": None, '"NaN"': None, "inf": math.inf,
        "-Infinity": -math.inf, "1d": None, "1F": None, "0x1p3": None, "5.": 5.0, ".5": 0.5, " 2 ": 2.0, None: None,
    }
    assert values(spark, fn.to_float, cases) == list(cases.values())
    assert math.isnan(values(spark, fn.to_float, ["nan"])[0])


def test_maybe_numeric(spark):
    cases = {
        "12": ("12", 12, 12.0), "1.": ("1.", None, 1.0), ".5": (".5", None, 0.5), "1e3": ("1e3", None, None),
        " x ": ("x", None, None), "": (None, None, None), "-3": ("-3", -3, -3.0), "+1.25": ("+1.25", None, 1.25),
        ".": (".", None, None), None: (None, None, None),
    }
    assert [tuple(v) for v in values(spark, fn.maybe_numeric, cases)] == list(cases.values())


def test_truthy(spark):
    cases = {"": None, "0": None, "0.0": None, "false": None, "5": "5", "x": "x", None: None}
    assert values(spark, fn.truthy, cases) == list(cases.values())


def test_finite(spark):
    assert values(spark, fn.finite, [1.0, math.nan, math.inf, -math.inf, None, -0.5], "double") == [
        1.0, None, None, None, None, -0.5]


def test_ratio_and_basis(spark):
    pairs = spark.createDataFrame(
        [(0, 101.0, 100.0), (1, 101.0, 0.0), (2, 101.0, None), (3, None, 100.0)], "i INT, a DOUBLE, b DOUBLE")
    rows = pairs.orderBy("i").select(
        fn.basis_bps(F.col("a"), F.col("b")), fn.guarded_ratio(F.col("a"), F.col("b"))).collect()
    assert rows[0][0] == pytest.approx(100.0) and rows[0][1] == 1.01
    assert all(tuple(r) == (None, None) for r in rows[1:])


def test_bucket_floor(spark):
    ms = [1704087000000, -1, 0]
    assert values(spark, lambda x: fn.bucket_floor(x, 8 * 3_600_000), ms, "bigint") == [1704067200000, -28800000, 0]
    assert fn.timeframe_ms("8h") == 28_800_000 and fn.timeframe_ms("9x") == 60_000


def test_mixed_time(spark):
    day = 1704067200000
    cases = {
        "1704067200": day, "1704067200000": day, "1704067200.5": day + 500, "2024-01-01": day,
        "2024-01-01 00:00:00": day, "2024-01-01T02:00:00+02:00": day, "2024-01-01T02:00:00+0200": day,
        "2024-01-01T00:00:00.250Z": day + 250, "2024-01-01t00:00z": day, "x": None, "": None, "2024-13-01": None,
        "12:00": None, "2024-01": None, "1e3": None, "-1": -1000, "99999999999999999999": None, None: None,
    }
    assert values(spark, fn.mixed_time_ms, cases) == list(cases.values())


def test_marker_times(spark):
    marks = [["2024-01-02", "1704067200", "bad", "2024-01-01T00:00:00Z", None]]
    assert values(spark, fn.marker_times, marks, "array<string>") == [
        ["2024-01-01T00:00:00.000Z", "2024-01-02T00:00:00.000Z"]]


def test_iso(spark):
    ms = [1704067200000, 1704067200007, -1]
    assert values(spark, fn.iso_utc, ms, "bigint") == [
        "2024-01-01T00:00:00+00:00", "2024-01-01T00:00:00.007000+00:00", "1969-12-31T23:59:59.999000+00:00"]


def test_slug(spark):
    cases = {" a b/c?? ": "a_b_c", "??": "note", "": "note", "._x_.": "x", "é" * 3: "note", "a" * 200: "a" * 120}
    assert values(spark, fn.slug, cases) == list(cases.values())


def test_path_labels(spark):
    paths = ["s3/symbol=007/kline_1.parquet", "x/mark_price_kline_D.parquet", "x/y.parquet"]
    assert values(spark, fn.symbol_in_path, paths) == ["007", "", ""]
    assert values(spark, lambda p: fn.interval_of(p, "kline"), paths) == ["1", "", ""]


def test_note_label(spark):
    rows = spark.createDataFrame(
        [(0, "c", "s", "t", "id"), (1, "", "s", " ", "id"), (2, None, "", "t", "id"), (3, "", "", "", "id")],
        "i INT, c STRING, s STRING, t STRING, d STRING")
    labels = rows.orderBy("i").select(fn.note_label(*map(F.col, "cstd"))).collect()
    assert [r[0] for r in labels] == ["c | t", "s", "t", "id"]
