"""Operators against plain-Python models on small, awkward data."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from barlake.operators import events, notes, quantiles, resample, series
from barlake.plans import timeseries
from barlake.schemas import LAST_VALUE_COLUMNS, SERIES_COLUMNS, TIMEFRAMES
from barlake.streaming.resample import latest_bars, run_append, run_updates, stream_resample

SCHEMA = "symbol STRING, ts_ms BIGINT, " + ", ".join(f"{c} DOUBLE" for c in SERIES_COLUMNS)
HOUR = 3_600_000


def awkward_rows(seed, symbols=("A", "B"), minutes=600, gap=0.3):
    rnd = random.Random(seed)
    odd = [None, None, math.nan, math.inf, -math.inf]
    rows = []
    for symbol in symbols:
        for minute in range(minutes):
            if rnd.random() >= gap:
                rows.append((symbol, 1704060000000 + minute * 60_000,
                             *[rnd.choice(odd) if rnd.random() < 0.4 else round(rnd.uniform(1, 50), 2) for _ in SERIES_COLUMNS]))
    blank = 1704060000000 + (minutes + 5000) * 60_000
    rows += [("A", blank + i * 60_000, *[None] * len(SERIES_COLUMNS)) for i in range(3)]
    rnd.shuffle(rows)
    return rows


def fin(x):
    return x is not None and math.isfinite(x)


def bars_of(rows, width):
    """One bar per (symbol, bucket), read row by row in time order."""
    bars = {}
    for row in sorted(rows, key=lambda r: (r[0], r[1])):
        v = dict(zip(SERIES_COLUMNS, row[2:]))
        bar = bars.setdefault((row[0], row[1] // width * width), dict.fromkeys(SERIES_COLUMNS))
        start = next((v[c] for c in ("kline_open", "kline_close") if fin(v[c])), None)
        if bar["kline_open"] is None:
            bar["kline_open"] = start
        for name, pick in (("kline_high", max), ("kline_low", min)):
            seen = [x for x in (bar[name], v[name], v["kline_close"]) if fin(x)]
            bar[name] = pick(seen) if seen else None
        for name in ("kline_close", *LAST_VALUE_COLUMNS):
            bar[name] = v[name] if fin(v[name]) else bar[name]
        for name in ("kline_volume", "kline_turnover"):
            seen = [x for x in (bar[name], v[name]) if fin(x)]
            bar[name] = sum(seen) if seen else None
    return bars


def as_bars(df):
    return {(r.symbol, r.ts_ms): {c: r[c] for c in SERIES_COLUMNS} for r in df.collect()}


def assert_same(found, expected):
    assert found.keys() == expected.keys()
    for key, bar in expected.items():
        assert found[key] == pytest.approx(bar, nan_ok=True), key


@pytest.fixture(scope="module")
def rows():
    return awkward_rows(7)


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("timeframe", ["5m", "1h", "8h", "1d"])
def test_resample_matches_row_by_row_reading(frame, rows, timeframe):
    assert_same(as_bars(resample.resample(frame, timeframe)), bars_of(rows, TIMEFRAMES[timeframe] * 60_000))


@pytest.mark.parametrize("scale", [1.0, 1e-9, 1e200])
def test_sums_do_not_depend_on_the_order_of_addition(spark, scale):
    rnd = random.Random(3)
    base = dict.fromkeys(SERIES_COLUMNS)
    turnovers = [rnd.choice([-1, 1]) * round(rnd.uniform(0, 10 ** rnd.randint(0, 6)), 4) * scale for _ in range(2000)]
    data = [("A", i * 40_000, *{**base, "kline_volume": 0.1, "kline_turnover": x}.values()) for i, x in enumerate(turnovers)]
    sums = set()
    for parts in (1, 3, 7):
        bar = resample.resample(spark.createDataFrame(data, SCHEMA).repartition(parts), "1d").first()
        assert bar.kline_turnover == pytest.approx(math.fsum(turnovers), rel=1e-12)
        sums.add((bar.kline_volume, bar.kline_turnover))
    if scale <= 1:
        assert sums == {(math.fsum([0.1] * 2000), math.fsum(turnovers))}


def test_one_minute_and_unknown_stay_unchanged(frame):
    for timeframe in ("1m", "weird"):
        assert resample.resample(frame, timeframe).exceptAll(frame).isEmpty()


def test_documented_bucket(spark):
    names = ["kline_open", "kline_high", "kline_low", "kline_close", "kline_volume", "basis_bps"]
    lines = [(None, 11.0, None, 10.0, None, 5.0), (12.0, 13.0, 9.0, math.nan, 2.0, None), (8.0, None, 7.0, 14.0, 3.0, None)]
    data = [("A", i * 60_000, *[dict(zip(names, v)).get(c) for c in SERIES_COLUMNS]) for i, v in enumerate(lines)]
    bar = resample.resample(spark.createDataFrame(data, SCHEMA), "5m").first()
    assert [bar[c] for c in names] == [10.0, 14.0, 7.0, 14.0, 5.0, 5.0]


def test_all_timeframes_equal_single_ones(frame, rows):
    every = resample.resample_all(frame)
    for timeframe, minutes in TIMEFRAMES.items():
        if minutes > 1:
            assert_same(as_bars(every.where(F.col("timeframe") == timeframe)), bars_of(rows, minutes * 60_000))
    assert every.where("timeframe = '1m'").count() == len(rows)


def test_nested_resampling_agrees(frame):
    assert_same(as_bars(resample.resample(resample.resample(frame, "5m"), "1h")), as_bars(resample.resample(frame, "1h")))


def test_all_timeframes_shuffle_rows_once(frame):
    plan = resample.resample_all(frame, ["5m", "1h", "1d"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Cartesian" not in plan and "NestedLoop" not in plan


def test_tie_breaker_fixes_first_and_last(spark):
    base = {c: None for c in SERIES_COLUMNS}
    data = [("A", 0, *{**base, "kline_close": float(i)}.values(), i) for i in range(50)]
    df = spark.createDataFrame(data, SCHEMA + ", id INT").repartition(8)
    bar = resample.resample(df, "5m", F.struct("ts_ms", "id")).first()
    assert (bar.kline_open, bar.kline_close) == (0.0, 49.0)


def test_funding_resample(spark):
    data = [("A", 0, 0.1), ("A", 60_000, math.nan), ("A", 120_000, None), ("A", 8 * HOUR, 0.2), ("A", 9 * HOUR, 0.3)]
    df = spark.createDataFrame(data, "symbol STRING, ts_ms BIGINT, funding_rate DOUBLE")
    found = {(r.ts_ms, r.funding_rate) for r in resample.resample_funding(df, "8h").collect()}
    assert found == {(0, 0.1), (8 * HOUR, 0.3)}
    assert resample.resample_funding(df, "1m").count() == 5


# --- wide join --------------------------------------------------------------------------


def test_wide_join_is_exact_and_multiplies_duplicates(spark):
    k = spark.createDataFrame(
        [("A", 0, "1"), ("A", 60_000, "1"), ("A", 0, "5"), (None, 0, "1")], "symbol STRING, ts_ms BIGINT, interval STRING"
    ).selectExpr("*", *[f"1.0D AS {c}" for c in ("open", "high", "low", "close", "volume", "turnover")])
    m = spark.createDataFrame([("A", 0, "1", 1.0), ("A", 0, "1", 2.0), ("A", 60_000, "5", 9.0), (None, 0, "1", 3.0)],
                              "symbol STRING, ts_ms BIGINT, interval STRING, close DOUBLE"
                              ).selectExpr("*", "close AS open", "close AS high", "close AS low")
    oi = spark.createDataFrame([("A", 0, "5min", 5.0), ("A", 60_000, None, 6.0), ("A", 0, "1h", 7.0)],
                               "symbol STRING, ts_ms BIGINT, period STRING, open_interest DOUBLE")
    ar = oi.selectExpr("symbol", "ts_ms", "period", "0.6D AS buy_ratio", "0.4D AS sell_ratio", "1.5D AS long_short_ratio")
    wide = timeseries.wide_1m(k, m, m, m, oi, ar)
    found = sorted((r.symbol or "", r.ts_ms, r.mark_close, r.index_close, r.open_interest) for r in wide.collect())
    assert len(found) == 8 + 1 + 1  # 2 x 2 x 2 copies, one plain minute, one null key
    assert found[0] == ("", 0, None, None, None)
    assert found[-1] == ("A", 60_000, None, None, 6.0)


# --- series -------------------------------------------------------------------------------


def test_series_bounds(frame, rows):
    start, end = 1704060000000 + 600_000, 1704060000000 + 1_200_000
    found = [r.ts_ms for r in series.series(frame, " a ", start, end).collect()]
    assert found == sorted(r[1] for r in rows if r[0] == "A" and start <= r[1] <= end)
    assert series.series(frame, "A").count() == sum(r[0] == "A" for r in rows)


def test_symbol_list_takes_first_filled_source(spark):
    def source(*symbols):
        return spark.createDataFrame([(s,) for s in symbols], "symbol STRING")

    listed = series.symbol_list([None, source("", None), source("B", "A", "B", ""), source("C")])
    assert [r.symbol for r in listed.collect()] == ["A", "B"]
    assert series.symbol_list([None, source()]) is None


def test_row_counts_and_coverage(spark, frame, rows):
    counts = {r.table_name: (r.rows, r.symbols) for r in series.row_counts({"x": frame, "none": frame.limit(0)}).collect()}
    assert counts == {"x": (len(rows), 2), "none": (0, 0)}
    covered = {(r.symbol, r.series): r.finite_rows for r in series.coverage(frame).collect()}
    for i, column in enumerate(SERIES_COLUMNS):
        assert covered["A", column] == sum(fin(r[2 + i]) for r in rows if r[0] == "A")
    only = frame.withColumn("basis_bps", F.lit(float("nan")))
    assert {r.empty_series for r in series.empty_series(series.coverage(only)).collect()} == {1}


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def test_pack_and_unpack_are_inverse(frame, rows):
    pages = series.pack(frame, page="4h")
    back = sorted((tuple(r) for r in series.unpack(pages).collect()), key=key)
    assert back == sorted([(r[0], r[1], *[x if fin(x) else None for x in r[2:]]) for r in rows], key=key)
    for page in pages.collect():
        assert page.rows == len(page.ts) == len(page.kline_close) and page.ts_ms == sorted(page.ts_ms)
        assert {t // (4 * HOUR) for t in page.ts_ms} == {page.page_ms // (4 * HOUR)}


def test_pack_keeps_copies_in_time_order(spark):
    copies = [("A", 0, 1.0)] * 1000 + [("A", 0, float(i)) for i in range(500)] + [("A", 60_000, None), ("B", 0, 2.0)] * 3
    df = spark.createDataFrame(copies, "symbol STRING, ts_ms BIGINT, kline_close DOUBLE").repartition(4)
    pages = series.pack(df, ["kline_close"], page="5m")
    back = sorted((tuple(r) for r in series.unpack(pages, ["kline_close"]).collect()), key=key)
    assert back == sorted(copies, key=key)
    assert all(r.ts_ms == sorted(r.ts_ms) for r in pages.collect())


def test_pack_with_funding(spark, frame):
    funding = spark.createDataFrame(
        [("A", 1704060000000, 0.1), ("A", 86_400_000, 0.2), ("ZZZ", 0, 0.3)], "symbol STRING, ts_ms BIGINT, funding_rate DOUBLE")
    pages = {(r.symbol, r.page_ms): r for r in series.pack_with_funding(frame, funding).collect()}
    assert ("ZZZ", 0) not in pages and pages["A", 86_400_000].rows == 0
    assert pages["A", 86_400_000].kline_close == [] and pages["A", 86_400_000].funding_rate == [0.2]
    day = 1704060000000 // 86_400_000 * 86_400_000
    assert pages["A", day].funding_ts == ["2023-12-31T22:00:00+00:00"] and pages["B", day].funding_rate == []


# --- median and event study ------------------------------------------------------------------


def test_order_bin_keeps_order(spark):
    rnd = random.Random(1)
    xs = [0.0, -0.0, 5e-324, 1e308, -1e308, 1.0, 1 - 2**-53, 1 + 2**-52, 2.0, 4.0 - 2**-51]
    xs += [rnd.choice([-1, 1]) * 2.0 ** rnd.randint(-60, 60) * rnd.choice([1, 1 - 2**-53, 1 + 2**-52, rnd.random()]) for _ in range(5000)]
    df = spark.createDataFrame([(x,) for x in xs], "v DOUBLE").select("v", quantiles.order_bin(F.col("v")).alias("b"))
    ordered = sorted((r.v, r.b) for r in df.collect())
    assert all(a[1] <= b[1] for a, b in zip(ordered, ordered[1:]))


def test_exact_median(spark):
    rnd = random.Random(3)
    groups = {
        1: [rnd.gauss(0, 0.01) for _ in range(2001)], 2: [rnd.gauss(0, 0.01) for _ in range(2000)],
        3: [0.5] * 3000 + [1.0], 4: [7.0], 5: [1.0, 2.0], 6: [-1.0, 0.0, 0.0, 1.0], 7: [1.0 + i * 2**-52 for i in range(999)],
        8: [1e-300, 1e300], 9: [-3.0] * 10 + [5.0] * 10,
    }
    data = [(k, v) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(data, "k INT, v DOUBLE").repartition(6)
    found = {r.k: r.median for r in quantiles.exact_median(df, ["k"], "v").collect()}
    assert found == {k: statistics.median(vs) for k, vs in groups.items()}


def study_of(rows, hours):
    price = {(r[0], r[1]): r[5] if fin(r[5]) else None for r in rows}
    moves = {h: [] for h in hours}
    for (symbol, ts), start in price.items():
        row = next(r for r in rows if (r[0], r[1]) == (symbol, ts))
        if fin(row[-1]) and row[-1] > 20:
            for h in hours:
                end = price.get((symbol, ts + h * HOUR))
                moves[h].append(end / start - 1 if start and end is not None else None)
    return moves


@pytest.mark.parametrize("by_symbol", [False, True])
def test_event_study(frame, rows, by_symbol, tmp_path):
    predicate = (F.col("basis_bps") > 20) & (F.col("basis_bps") < float("inf")) & ~F.isnan("basis_bps")
    result = events.event_study(frame, predicate, [1, 3, 200], by_symbol=by_symbol).collect()
    stored = events.event_study(frame, predicate, [1, 3, 200], by_symbol=by_symbol, work_path=str(tmp_path / "moves"))
    assert sorted(stored.collect()) == sorted(result)
    for symbols in ([("A",), ("B",)] if by_symbol else [("A", "B")]):
        expected = study_of([r for r in rows if r[0] in symbols], [1, 3, 200])
        for h, moves in expected.items():
            row = next(r for r in result if r.horizon_hours == h and (not by_symbol or r.symbol == symbols[0]))
            known = [m for m in moves if m is not None]
            assert (row.event_count, row.move_count) == (len(moves), len(known))
            assert (row.up_count, row.down_count) == (sum(m > 0 for m in known), sum(m < 0 for m in known))
            if known:
                assert row.median_move == pytest.approx(statistics.median(known))
                assert row.mean_move == pytest.approx(statistics.fmean(known))
                assert (row.max_up, row.max_down) == (max(known), min(known))
                assert row.win_rate == pytest.approx(sum(m > 0 for m in known) / len(known))
            else:
                assert row.median_move is None and row.win_rate is None


def test_copies_of_a_minute_are_one_event(spark):
    data = [("A", 0, 10.0)] * 300 + [("A", HOUR, 11.0)] * 300
    df = spark.createDataFrame(data, "symbol STRING, ts_ms BIGINT, kline_close DOUBLE")
    row = events.event_study(df, F.col("ts_ms") == 0, [1]).first()
    assert (row.event_count, row.up_count, row.mean_move) == (1, 1, pytest.approx(0.1))


def test_study_files(spark, frame, tmp_path):
    result = events.event_study(frame, F.col("kline_close") > 40, [1, 3])
    events.write_csv(result, str(tmp_path / "csv"))
    events.write_markdown(result, str(tmp_path / "md"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "csv"))
    assert back.columns == result.columns and back.count() == 2
    lines = [r.value for r in spark.read.text(str(tmp_path / "md")).collect()]
    assert len(lines) == 4 and lines[0].startswith("| horizon_hours | event_count") and lines[2].startswith("| 1 | ")


# --- notes --------------------------------------------------------------------------------------


NOTE = ("folder_symbol STRING, id STRING, symbol STRING, title STRING, body STRING, timeframe STRING, created_at STRING, "
        "saved_at STRING, snapshot STRUCT<timeframe: STRING, view_state: STRUCT<x_range: ARRAY<STRING>>>, "
        "ai_summary STRUCT<status: STRING>")


def note(id_, tf=None, x=None, snap_tf=None, symbol="A", title="t", body="b", created="", saved="", ai=None):
    return (symbol, id_, symbol, title, body, tf, created, saved, (snap_tf, (x,)), ai)


def test_note_validation_and_index(spark):
    data = [note("1", symbol=" a "), note("2", symbol="", title=""), note("3", title=" "), note("4", body=None),
            note("5", created="2024-01-03", saved="2024-01-01"), note("6", saved="2024-01-02", ai=(" ok ",))]
    df = spark.createDataFrame(data, NOTE)
    reasons = {r.id: r.reject_reason for r in notes.validate_notes(df).collect()}
    assert reasons == {"1": None, "2": "missing symbol", "3": "missing title", "4": "missing body", "5": None, "6": None}
    index = notes.newest_first(notes.snapshot_index(df.where("folder_symbol = 'A'"))).collect()
    assert [r.id for r in index] == ["4", "3", "6", "5"]
    assert index[2].ai_status == "ok" and index[3].label == "2024-01-03 | t" and index[0].label == "t"
    assert notes.snapshot(df, "a", "5").count() == 1 and notes.snapshot(df, "a", "../5").isEmpty()
    assert {r.symbol: r.snapshots for r in notes.snapshot_counts(df).collect()}["A"] == 4


def test_snapshot_bars(spark, frame, rows):
    first = min(r[1] for r in rows)
    x = ["2023-12-31 23:00:00", str(first + 5 * HOUR)]
    df = spark.createDataFrame([
        note("range", "1h", x), note("open", "4h"), note("state", "", x, "8h"), note("minute", "1m", x),
        note("bad", "7x", x, "8h"), note("none", "1h", ["2030-01-01", "2030-01-02"]), note("other", "1h", symbol="QQQ"),
    ], NOTE)
    charts: dict = {}
    for r in notes.snapshot_bars(df, frame).collect():
        charts.setdefault(r.chart, {})[r.symbol, r.ts_ms] = {c: r[c] for c in SERIES_COLUMNS}
    shows = {r.id: r.chart for r in notes.snapshot_charts(df).collect()}
    assert set(charts) < set(shows.values()) and shows["minute"] == shows["bad"] and len(set(shows.values())) == 6
    found = {i: charts[c] for i, c in shows.items() if c in charts}
    assert set(found) == {"range", "open", "state", "minute", "bad"}
    lo, hi = 1704063600000, first + 5 * HOUR
    mine = [r for r in rows if r[0] == "A"]

    def inside(bars):
        return {k: v for k, v in bars.items() if lo <= k[1] <= hi}

    assert_same(found["range"], inside(bars_of(mine, HOUR)))
    assert_same(found["open"], bars_of(mine, 4 * HOUR))
    assert_same(found["state"], inside(bars_of(mine, 8 * HOUR)))
    assert found["minute"].keys() == found["bad"].keys() == inside({(r[0], r[1]): 0 for r in mine}).keys()


# --- streaming -------------------------------------------------------------------------------------


def test_streamed_bars_over_several_batches(spark, frame, rows, tmp_path):
    for part in range(3):  # three files of mixed times, one batch each
        chunk = spark.createDataFrame(rows[part::3], SCHEMA)
        chunk.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run_updates(stream_resample(stream, "1h", "30 days"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("batch").distinct().count() >= 3
    assert_same(as_bars(latest_bars(spark, str(tmp_path / "out"))), bars_of(rows, HOUR))


@pytest.mark.parametrize("in_order", [True, False])
def test_versions_of_streamed_bars_are_compacted(spark, frame, rows, tmp_path, in_order):
    """Twenty batches in cycles of four: closed bars once, the same bars at the end, also after a batch has run again."""
    source, out, cp = (str(tmp_path / name) for name in ("in", "out", "cp"))
    ordered = sorted(rows, key=lambda r: r[1])
    size = -(-len(ordered) // 20)
    for i in range(20):
        chunk = ordered[i * size:(i + 1) * size] if in_order else ordered[i::20]
        spark.createDataFrame(chunk, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
        run_updates(stream_resample(stream, "1h", "30 days"), out, cp, cycle=4, open_ms=3 * HOUR).awaitTermination()
        return as_bars(latest_bars(spark, out))

    expected = bars_of(rows, HOUR)
    assert_same(run(), expected)
    stored = spark.read.parquet(out)
    versions = stored.count()
    closed = stored.where("part like 'closed%'")
    assert closed.count() and stored.select("part").distinct().count() <= 4 + 2 + 5 + 1
    if in_order:
        assert closed.groupBy("symbol", "ts_ms").count().where("count > 1").count() == 0
        assert versions <= 2 * len(expected)
    commits = tmp_path / "cp" / "commits"
    last = max(int(f.name) for f in commits.iterdir() if f.name.isdigit())
    (commits / str(last)).unlink()
    (commits / f".{last}.crc").unlink(missing_ok=True)
    assert_same(run(), expected)


def test_appended_bars_appear_when_closed(spark, frame, rows, tmp_path):
    ordered = sorted(rows, key=lambda r: r[1])
    for i, chunk in enumerate((ordered[:400], ordered[400:])):
        spark.createDataFrame(chunk, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
        run_append(stream_resample(stream, "1h", "10 minutes"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    expected = {k: v for k, v in bars_of(rows, HOUR).items() if k[1] + HOUR <= ordered[-1][1] - 600_000}
    assert_same(as_bars(spark.read.parquet(str(tmp_path / "out"))), expected)
