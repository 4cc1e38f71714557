"""JSON parsing, files to tables, incremental refresh, streaming ingest."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from barlake.plans.timeseries import open_wide
from barlake.sources import dynamic, ingest, lines, market, notes, report, routing, tables
from barlake.streaming.ingest import stream_ingest

BAD_LINES = ["", "  ", "\t", "{bad", "[1,2]", '"str"', '[{"ts":5}]', "null", "7", '{"ts":1} x', '{"ts":1}}', "{'ts':1}"]


def texts(spark, values, symbol="AAA"):
    return spark.createDataFrame([(v, symbol) for v in values], "value STRING, path_symbol STRING")


def test_status_of_bad_lines(spark):
    rows = lines.with_doc(texts(spark, BAD_LINES + ["{}", '{"ts":NaN}']), "STRUCT<ts: STRING>").collect()
    blank, malformed, other, ok = lines.BLANK, lines.MALFORMED, lines.NOT_OBJECT, lines.OK
    assert [r.status for r in rows] == [
        blank, blank, blank, malformed, other, other, other, other, other, malformed, malformed, malformed, ok, ok]


def test_kline_lines(spark):
    good = [
        '{"ts": 1704067200000, "open": "1.50", "high": 2, "low": "1e0", "close": " 1.55 ", "volume": "10", '
        '"turnover": "15.5", "raw": ["1704067200000", "1.50", 2, 1, 1, 10, 15.5], "extra": []}',
        '{"ts": "1.9", "open": "nan", "high": NaN, "low": "", "raw": [1,2], "extra": {"a": 1}}',
        "{}",
        '{"ts": true, "raw": "[1]", "extra": [ {"a": "b c"} ]}',
    ]
    rows = market.klines(texts(spark, BAD_LINES + good)).collect()
    assert len(rows) == 4
    first, second, third, fourth = rows
    assert (first.symbol, first.ts_ms, first.open, first.low, first.close, first.turnover) == (
        "AAA", 1704067200000, 1.5, 1.0, 1.55, 15.5)
    assert first.ts.isoformat() == "2024-01-01T00:00:00" and first.ts_from_raw_ms == 1704067200000
    assert first.has_volume_turnover and first.extra_json == "[]"
    assert first.raw_json == '["1704067200000","1.50",2,1,1,10,15.5]'
    assert second.ts_ms == 1 and math.isnan(second.open) and second.high is None and second.low is None
    assert not second.has_volume_turnover and second.ts_from_raw_ms == 1 and second.extra_json is None
    assert third.ts_ms is None and third.has_volume_turnover is False and third.raw_json is None
    assert fourth.ts_ms == 1 and fourth.raw_json is None and fourth.extra_json == '[{"a":"b c"}]'


def test_metric_lines(spark):
    funding = market.funding_history(texts(spark, [
        '{"symbol": "BBB", "ts": null, "fundingRateTimestamp": "1704067200000", "fundingRate": "0.0001"}',
        '{"symbol": "", "ts": 5, "fundingRateTimestamp": "x", "fundingRate": ""}',
    ])).collect()
    assert [(r.symbol, r.ts_ms, r.collector_ts_ms, r.funding_rate) for r in funding] == [
        ("BBB", 1704067200000, None, 0.0001), ("AAA", 5, 5, None)]
    assert [r.funding_rate_timestamp_raw for r in funding] == ["1704067200000", "x"]
    ratio = market.account_ratio(texts(spark, [
        '{"symbol": "", "ts": 1, "buyRatio": "0.6", "sellRatio": "0"}', '{"timestamp": 2, "buyRatio": "0.6"}',
        '{"timestamp": 3, "buyRatio": 0.6, "sellRatio": 0.3}',
    ])).collect()
    assert [(r.symbol, r.ts_ms, r.long_short_ratio) for r in ratio] == [
        ("AAA", 1, None), ("AAA", 2, None), ("AAA", 3, 2.0)]
    interest = market.open_interest(texts(spark, ['{"timestamp": "9", "openInterest": "12345.6"}'])).first()
    assert (interest.ts_ms, interest.source_timestamp_ms, interest.open_interest) == (9, 9, 12345.6)


def test_risk_limit_numbers_before_dropping(spark):
    doc = {"rows": [{"id": "1"}, 5, "{}", None, {"id": 2, "maxLeverage": "12.5"}], "generatedAtIso": "2024"}
    rows = market.risk_limit(texts(spark, [json.dumps(doc, indent=1), '{"rows": null}', '{"rows": {"a": 1}}', "[]"])).collect()
    assert [(r.symbol, r.row_num, r.id, r.max_leverage) for r in rows] == [("AAA", 1, 1, None), ("AAA", 5, 2, 12.5)]


def test_flatten(spark):
    docs = [
        '{"a":{"b":1},"c":[1,2.50,"x"],"e":{},"n":null,"t":" x ","f":28.0,"big":1e10}',
        '{"a_b":1,"a":{"b":2},"k":1,"k":3}', '{"time":0}', '{"ts":0,"timestamp":"","time":"7","symbol":"ZZZ"}',
        '{"ts":NaN,"v":Infinity}',
    ]
    rows = dynamic.generic_jsonl(texts(spark, docs)).collect()
    assert rows[0].fields == {
        "a_b": "1", "c": '[1,2.5,"x"]', "n": None, "t": "x", "f": "28.0", "big": "10000000000.0"}
    assert rows[1].fields == {"a_b": "2", "k": "3"}
    assert (rows[2].ts_ms, rows[3].ts_ms, rows[3].symbol) == (0, 7, "ZZZ")
    assert rows[4].fields == {"ts": "NaN", "v": "Infinity"} and rows[4].ts_ms is None


def test_flatten_depth(spark):
    def nested(n):
        return '{"a":' * n + "1" + "}" * n

    deep = texts(spark, [nested(4), nested(30), nested(100), '{"l":[{"x":{"y":1}}],"id":12345678901234567890,"d":1.0}'])
    four, thirty, hundred, mixed = [r.fields for r in dynamic.generic_jsonl(deep).collect()]
    assert (four, thirty, hundred) == tuple({"_".join(["a"] * n): "1"} for n in (4, 30, 100))
    assert mixed == {"l": '[{"x":{"y":1}}]', "id": "12345678901234567890", "d": "1.0"}


def test_text_that_goes_on_after_its_object(spark):
    broken = ['{"ts":1},"x":2', '{"ts":1},"end":5', '{"ts":1},"doc":{"ts":9}', '{"ts":1},{"ts":2}', '{"ts":1} {"ts":2}',
              '{"ts":1}],"x":[2', '{"ts":1}],"doc":[{"ts":9}', '{"ts":1}],"end":[', '{"ts":1}]']
    rows = texts(spark, [*broken, "[1]", '"x"', "5", "null", "", " ", '{"ts":7}'])
    assert [r.ts_ms for r in market.klines(rows).collect()] == [7]
    counts = report.ingest_report(rows.withColumns({"dataset": F.lit("d"), "path": F.lit("p")})).first()
    assert (counts.rows, counts.malformed, counts.not_object, counts.blank) == (1, len(broken), 4, 2)


def test_kept_json_keeps_its_order(spark):
    row = market.klines(texts(spark, ['{"ts":9223372036854775807,"raw":[{"z":1,"a":1.50}, 2],"extra":[ {"b":1,"a":2} ],"open":"true","high":true,"low":Infinity}'])).first()
    assert (row.raw_json, row.extra_json) == ('[{"z":1,"a":1.5},2]', '[{"b":1,"a":2}]')
    assert (row.ts_ms, row.ts, row.open, row.high, row.low) == (2**63 - 1, None, None, 1.0, float("inf"))
    state = dynamic.meta(texts(spark, ['{"endpointState":{"k":{"n":1},"b":2},"k_n":2}'])).first()
    assert state.endpoint_state_json == '{"k":{"n":1},"b":2}' and state.fields["k_n"] == "2"


def test_keys_that_meet_are_taken_in_the_order_of_the_text(spark):
    docs = ['{"a":{"b_c":1,"b":{"c":2}}}', '{"a":{"b":{"c":2},"b_c":1}}', '{"":{"x":1},"x":2}', '{"z":"\\u00e9{}\\"{","q":"' + "{" * 100_000 + '"}', '{"half":"\\ud800"}']
    rows = [r.fields for r in dynamic.generic_jsonl(texts(spark, docs)).collect()]
    assert [r.get("a_b_c") for r in rows[:2]] == ["2", "1"] and rows[2] == {"x": "2"}
    assert rows[3] == {"z": 'é{}"{', "q": "{" * 100_000} and rows[4] == {"half": "?"}
    broken = ['{"a":' * 5000 + "1" + "}" * 5000, '{"a":1} {"a":2}', "[{}]", None, '{"a":1}]', '{"t":"a\tb"}']
    assert dynamic.generic_jsonl(texts(spark, broken)).count() == 0


def test_strings_flags_and_lists_differ_in_one_parse(spark):
    line = '{"ts":"true","open":true,"high":"Infinity","low":Infinity,"close":"\\\\\\"1","volume":"\\u0031","raw":"[1]","extra":["\\\\","a\\"b",{"z":"\\u00e9","a":true}]}'
    row = market.klines(texts(spark, [line, '{"raw":[true,"\\"x"],"extra":{"a":[1]}}'])).orderBy("ts_from_raw_ms").collect()
    assert (row[0].ts_ms, row[0].open, row[0].high, row[0].low, row[0].close, row[0].volume) == (None, 1.0, float("inf"), float("inf"), None, 1.0)
    assert row[0].raw_json is None and json.loads(row[0].extra_json) == ["\\", 'a"b', {"z": "é", "a": True}]
    assert (row[1].ts_from_raw_ms, json.loads(row[1].raw_json), row[1].extra_json) == (1, [True, '"x'], None)
    plan = market.klines(texts(spark, [line]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_widen_and_names(spark):
    rows = dynamic.generic_jsonl(texts(spark, ['{"x":"1.5","y":"text"}', '{"z":2}']))
    assert {r.field for r in dynamic.field_names(rows).collect()} == {"x", "y", "z"}
    wide = dynamic.widen(rows, {"x": "double", "y": "double", "z": "bigint"}).orderBy("z").collect()
    assert [(r.x, r.y, r.z) for r in wide] == [(1.5, None, None), (None, None, 2)]


def test_keys_become_columns_of_views(spark, tmp_path):
    source, lake = tmp_path / "s", str(tmp_path / "lake")
    write(source / "AAA" / "raw" / "instrument.json", '{"symbol":"aaa","f":{"tick":"0.5","n":1},"Status":"on","status":"off"}')
    write(source / "BBB" / "raw" / "instrument.json", '{"f":{"tick":2,"n":"x"},"empty":""}')
    ingest.refresh(spark, str(source), lake)
    tables.open_tables(spark, lake)
    view = spark.table("instrument")
    types = dict(view.dtypes)
    assert (types["f_tick"], types["f_n"], types["empty"]) == ("double", "string", "string")
    assert sum(c.lower() == "status" for c in view.columns) == 1 and "fields" in view.columns
    rows = view.select("symbol", "record_symbol", "f_tick", "f_n").orderBy("symbol").collect()
    assert [tuple(r) for r in rows] == [("AAA", "aaa", 0.5, "1"), ("BBB", "BBB", 2.0, "x")]


def test_key_types_follow_changed_partitions(spark, tmp_path):
    source, lake = tmp_path / "s", str(tmp_path / "lake")
    for symbol, text in (("AAA", '{"n":1,"m":"","k":2}'), ("BBB", '{"n":2,"m":null,"k":2.5}')):
        write(source / symbol / "raw" / "instrument.json", text)

    def types():
        ingest.refresh(spark, str(source), lake)
        view = tables.open_tables(spark, lake)["instrument"]
        return {k: t for k, t in view.dtypes if k in ("n", "m", "k", "z")}

    assert types() == {"n": "bigint", "m": "string", "k": "double"}
    write(source / "BBB" / "raw" / "instrument.json", '{"n":"x","m":5,"z":1}')
    later(source / "BBB" / "raw" / "instrument.json", 5)
    assert types() == {"n": "string", "m": "bigint", "k": "bigint", "z": "bigint"}
    # a partition that lost its rows no longer widens a type; a table without notes is read once
    write(source / "BBB" / "raw" / "instrument.json", "[]")
    later(source / "BBB" / "raw" / "instrument.json", 10)
    assert types() == {"n": "bigint", "m": "string", "k": "bigint"}
    rows = tables.read_dataset(spark, lake, "instrument")
    assert dict(dynamic.with_key_columns(rows).dtypes)["n"] == "bigint"


def test_listed_symbols_open_no_file(spark, source, tmp_path):
    lake = str(tmp_path / "lake")
    ingest.ingest(spark, str(source), lake)
    found = tables.listed_symbols(spark, lake, ["nothing", "market_kline"])
    assert [r.symbol for r in found.collect()] == ["007", "AAA"]
    assert "content" not in found._jdf.queryExecution().executedPlan().toString()
    assert tables.listed_symbols(spark, lake, ["nothing"]) is None


def test_meta(spark):
    docs = [
        '{"symbol":"","listingTimeMs":"1704067200000","endpointState":{"k":{"n":"5","d":{"z":1}},"flag":true},"o":{"x":1}}',
        '{"symbol":"QQQ","endpointState":[1,2]}', '{"k":1}',
    ]
    first, second, third = dynamic.meta(texts(spark, docs)).collect()
    assert first.symbol == "AAA" and first.listing_time.isoformat() == "2024-01-01T00:00:00"
    assert first.fields == {
        "symbol": None, "listingTimeMs": "1704067200000", "o": '{"x":1}', "k_n": "5", "k_d": '{"z":1}', "flag": "true"}
    assert second.symbol == "QQQ" and second.endpoint_state_json == "[1,2]" and second.fields == {"symbol": "QQQ"}
    assert third.endpoint_state_json is None and third.fields == {"k": "1"}


def test_routing(spark):
    cases = {
        "file:/r/aaa/kline_1.jsonl": ("AAA", "market_kline", "1"),
        "file:/r/AAA/mark_price_kline_D.jsonl": ("AAA", "mark_price_kline", "D"),
        "file:/r/AAA/premium_index_price_kline_1.jsonl": ("AAA", "premium_index_price_kline", "1"),
        "file:/r/AAA/funding_history.jsonl": ("AAA", "funding_history", None),
        "file:/r/AAA/liq.jsonl": ("AAA", "other", "liq"),
        "file:/r/AAA/raw/ticker.json": ("AAA", "ticker", None),
        "file:/r/AAA/ticker.json": ("AAA", None, None),
        "file:/r/AAA/raw/liq.jsonl": ("AAA", None, None),
        "file:/r/AAA/kline_1.jsonl/part-0.txt": ("AAA", "market_kline", "1"),
        "file:/r/open_interest_5min.jsonl/symbol=BBB/part-0.txt": ("BBB", "open_interest", "5min"),
    }
    rows = routing.route(spark.createDataFrame([(p,) for p in cases], "path STRING")).collect()
    assert [(r.path_symbol, r.dataset, r.label) for r in rows] == list(cases.values())


def test_symbol_files_and_selection(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# comment\n\n bbb \nAAA\n")
    listed = routing.read_symbols_file(spark, str(tmp_path / "list.txt"))
    chosen = routing.select_symbols(listed, spark.createDataFrame([("aaa",), (" ",), (None,)], "symbol STRING"))
    assert sorted(r.symbol for r in chosen.collect()) == ["AAA", "BBB"]


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content)


def candle(ts, close, **more):
    return json.dumps({"ts": ts, "open": str(close), "high": close, "low": close, "close": close, **more}) + "\n"


@pytest.fixture
def source(tmp_path):
    root = tmp_path / "symbols"
    for symbol, price in (("AAA", 10.0), ("007", 20.0)):
        folder = root / symbol
        write(folder / "kline_1.jsonl", candle(0, price, volume=1, turnover=2) + "\n{bad\n" + candle(60000, price + 1))
        write(folder / "kline_60.jsonl", candle(0, price))
        write(folder / "mark_price_kline_1.jsonl", candle(0, price * 1.01))
        write(folder / "index_price_kline_1.jsonl", candle(0, price) + candle(60000, 0))
        write(folder / "premium_index_price_kline_1.jsonl", candle(60000, 0.1))
        write(folder / "open_interest_5min.jsonl", '{"timestamp": "0", "openInterest": "5"}\n')
        write(folder / "open_interest_1h.jsonl", '{"timestamp": "0", "openInterest": "500"}\n')
        write(folder / "account_ratio_5min.jsonl", '{"ts": 0, "buyRatio": "0.6", "sellRatio": "0.4"}\n')
        write(folder / "funding_history.jsonl", '{"symbol": "OTHER", "ts": 0, "fundingRate": "0.0001"}\n')
        write(folder / "liquidations.jsonl", '{"time": 5, "side": {"name": "Buy"}}\n')
        write(folder / "risk_limit.json", '{"rows": [{"id": 1}, {"id": 2}]}')
        write(folder / "meta.json", '{\n "listingTimeMs": 5\n}')
        write(folder / "raw" / "instrument.json", '{"lot": {"step": "0.1"}}')
        write(folder / "raw" / "ticker.json", "[1]")
    return root


def test_files_to_wide_table(spark, source, tmp_path):
    lake = str(tmp_path / "lake")
    ingest.ingest(spark, str(source), lake)
    opened = tables.open_tables(spark, lake)
    assert set(opened) == {d.name for d in routing.DATASETS} - {"ticker"}
    klines = opened["market_kline"]
    assert {(r.symbol, r.symbol_partition, r.interval) for r in klines.collect()} == {
        (s, s, i) for s in ("AAA", "007") for i in ("1", "60")}
    funding = opened["funding_history"].first()
    assert funding.record_symbol == "OTHER" and funding.symbol in ("AAA", "007")
    assert opened["risk_limit"].count() == 4
    wide = {(r.symbol, r.ts_ms): r for r in open_wide(opened).collect()}
    assert len(wide) == 4
    row = wide["AAA", 0]
    assert (row.kline_close, row.kline_volume, row.open_interest, row.long_short_ratio) == (
        10.0, 1.0, 5.0, pytest.approx(1.5))
    assert row.basis_bps == pytest.approx(100.0) and row.premium_close is None
    assert wide["AAA", 60000].basis_bps is None and wide["007", 60000].premium_close == 0.1
    assert spark.sql("SELECT count(*) AS n FROM symbol_timeseries_1m").first().n == 4


def test_partition_pruning_and_shape_of_wide_plan(spark, source, tmp_path):
    lake = str(tmp_path / "lake")
    ingest.ingest(spark, str(source), lake)
    wide = open_wide(tables.open_tables(spark, lake))
    one = wide.where((F.col("symbol") == "AAA") & (F.col("ts_ms") >= 0))
    plan = one._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    # six inputs, and once more the candles without a time, which go round the joins
    assert len(scans) == 7 and all("symbol" in s.split("PartitionFilters")[1].split("]")[0] for s in scans)
    assert sum("(interval" in s.split("PartitionFilters")[1] for s in scans) == 5
    assert all("GreaterThanOrEqual(ts_ms,0)" in s for s in scans)
    assert "raw_json" not in plan and "rangepartitioning" not in plan and "Python" not in plan


def test_selected_symbols_only(spark, source, tmp_path):
    lake = str(tmp_path / "lake")
    ingest.ingest(spark, str(source), lake, symbols=spark.createDataFrame([("AAA",), ("NONE",)], "symbol STRING"))
    assert {r.symbol for r in tables.read_dataset(spark, lake, "market_kline").collect()} == {"AAA"}


def test_missing_inputs_give_no_wide_table(spark, tmp_path):
    assert tables.open_tables(spark, str(tmp_path / "nothing")) == {}
    assert open_wide({}) is None


def later(path, seconds):
    time = os.stat(path).st_mtime + seconds
    os.utime(path, (time, time))


def test_refresh_rebuilds_only_what_changed(spark, source, tmp_path):
    lake = str(tmp_path / "lake")

    def rows(name):
        table = tables.read_dataset(spark, lake, name)
        return sorted((r.symbol, r.ts_ms, r.close) for r in table.where("interval = '1'").collect())

    assert ingest.refresh(spark, str(source), lake) == 28
    assert ingest.refresh(spark, str(source), lake) == 0
    before = rows("market_kline")
    changed = source / "AAA" / "kline_1.jsonl"
    write(changed, candle(0, 99.0))
    later(changed, 5)
    assert ingest.refresh(spark, str(source), lake) == 1
    assert rows("market_kline") == [r for r in before if r[0] == "007"] + [("AAA", 0, 99.0)]
    # a source that lost all rows loses its partition
    write(changed, "{bad\n")
    later(changed, 10)
    write(source / "AAA" / "kline_5.jsonl", candle(0, 1.0))
    assert ingest.refresh(spark, str(source), lake) == 2
    assert rows("market_kline") == [r for r in before if r[0] == "007"]
    assert ingest.refresh(spark, str(source), lake) == 0
    assert ingest.refresh(spark, str(source), lake, overwrite=True) == 29


def test_refresh_rereads_all_parts_of_a_changed_source(spark, tmp_path):
    source, lake = tmp_path / "s", str(tmp_path / "lake")
    write(source / "AAA" / "kline_1.jsonl" / "part-0.txt", candle(0, 1.0))
    write(source / "AAA" / "kline_1.jsonl" / "part-1.txt", candle(60000, 2.0))
    assert ingest.refresh(spark, str(source), lake) == 2
    write(source / "AAA" / "kline_1.jsonl" / "part-1.txt", candle(60000, 3.0))
    later(source / "AAA" / "kline_1.jsonl" / "part-1.txt", 5)
    assert ingest.refresh(spark, str(source), lake) == 2
    closes = tables.read_dataset(spark, lake, "market_kline").orderBy("ts_ms").select("close").collect()
    assert [r.close for r in closes] == [1.0, 3.0]


def test_odd_folder_names_survive(spark, tmp_path):
    source, lake = tmp_path / "s", str(tmp_path / "lake")
    odd = source / "A B+C%41=é" / "kline_1.jsonl"
    write(odd, candle(0, 1.0))
    assert ingest.refresh(spark, str(source), lake) == 1
    assert [r.symbol for r in tables.read_dataset(spark, lake, "market_kline").collect()] == ["A B+C%41=É"]
    write(odd, "{bad\n")
    later(odd, 5)
    assert ingest.refresh(spark, str(source), lake) == 1
    assert tables.read_dataset(spark, lake, "market_kline") is None


def test_stream_ingest_takes_each_file_once(spark, source, tmp_path):
    lake, checkpoint = str(tmp_path / "lake"), str(tmp_path / "cp")

    def run():
        stream_ingest(spark, str(source), lake, checkpoint, "market_kline").awaitTermination()
        return tables.read_dataset(spark, lake, "market_kline").count()

    assert run() == 6
    assert run() == 6
    write(source / "BBB" / "kline_1.jsonl", candle(0, 1.0))
    assert run() == 7
    # a refresh takes its turn on the same table, and so does the stream after it
    write(source / "CCC" / "kline_1.jsonl", candle(0, 1.0))
    ingest.refresh(spark, str(source), lake)
    assert tables.read_dataset(spark, lake, "market_kline").count() == 8 == run()
    write(source / "DDD" / "kline_1.jsonl", candle(0, 1.0))
    assert run() == 9 and ingest.refresh(spark, str(source), lake) == 0


def test_stream_appends_new_files_only(spark, tmp_path):
    """Old table files stay, the key types of new rows are noted, small batches add up."""
    source, lake, checkpoint = tmp_path / "src", str(tmp_path / "lake"), str(tmp_path / "cp")

    def files():
        return {r.path for r in tables.stored_files(spark, f"{lake}/other").collect()}

    write(source / "AAA" / "orders.jsonl" / "part-0", '{"ts": 1, "size": 1}')
    stream_ingest(spark, str(source), lake, checkpoint).awaitTermination()
    first = files()
    for i in range(1, 4):
        write(source / "AAA" / "orders.jsonl" / f"part-{i}", json.dumps({"ts": i, "size": "x" if i == 2 else i, f"k{i}": i}))
    stream_ingest(spark, str(source), lake, checkpoint, max_files=2).awaitTermination()
    assert first < files()
    rows = tables.open_tables(spark, lake)["other"].select("size", "k1", "k3").collect()
    assert sorted(r["size"] for r in rows) == ["1", "1", "3", "x"]
    assert {(r.k1, r.k3) for r in rows} == {(None, None), (1, None), (None, 3)}
    assert ingest.refresh(spark, str(source), lake) == 0


@pytest.mark.parametrize("dies", ["before", "after"])
def test_repeated_batch_adds_nothing(spark, tmp_path, monkeypatch, dies):
    """A batch that dies before or after its rows were appended is run again with the same checkpoint."""
    source, lake, checkpoint = tmp_path / "src", str(tmp_path / "lake"), str(tmp_path / "cp")
    write(source / "AAA" / "kline_1.jsonl" / "part-0", candle(0, 1.0))
    stream_ingest(spark, str(source), lake, checkpoint).awaitTermination()
    write(source / "AAA" / "kline_1.jsonl" / "part-1", candle(60000, 1.0))
    write(source / "BBB" / "kline_1.jsonl", candle(0, 1.0))

    with monkeypatch.context() as broken:
        if dies == "before":
            broken.setattr(ingest, "write_dataset", lambda *a, **k: 1 / 0)
        else:
            kept = ingest.record
            broken.setattr(ingest, "record", lambda plan, root, done: 1 / 0 if done else kept(plan, root, done))
        with pytest.raises(Exception):
            stream_ingest(spark, str(source), lake, checkpoint).awaitTermination()
    assert tables.read_dataset(spark, lake, "market_kline").count() == (1 if dies == "before" else 3)
    stream_ingest(spark, str(source), lake, checkpoint).awaitTermination()
    rows = tables.read_dataset(spark, lake, "market_kline").select("symbol", "ts_ms").collect()
    assert sorted(map(tuple, rows)) == [("AAA", 0), ("AAA", 60000), ("BBB", 0)]
    assert ingest.refresh(spark, str(source), lake) == 0


def test_refresh_in_rounds_goes_on_where_it_died(spark, source, tmp_path, monkeypatch):
    whole, lake = str(tmp_path / "whole"), str(tmp_path / "lake")
    ingest.refresh(spark, str(source), whole)
    monkeypatch.setattr(ingest, "ROUND_FILES", 5)
    kept, runs = ingest.record, []

    def dying(plan, root, done):
        runs.append(plan.count())
        if len(runs) == 3:
            raise RuntimeError("lost")
        kept(plan, root, done)

    with monkeypatch.context() as broken:
        broken.setattr(ingest, "record", dying)
        with pytest.raises(RuntimeError):
            ingest.refresh(spark, str(source), lake)
    left = 28 - sum(runs[:2])
    assert ingest.refresh(spark, str(source), lake) == left < 28
    for name in tables.open_tables(spark, whole):
        counts = [tables.read_dataset(spark, root, name).count() for root in (whole, lake)]
        assert counts[0] == counts[1], name
    assert ingest.refresh(spark, str(source), lake) == 0


def test_lake_without_notes_is_noted_whole(spark, tmp_path):
    """A table that was written without key types gets them for all its partitions with the first refresh."""
    source, lake = tmp_path / "src", str(tmp_path / "lake")
    for symbol in "AB":
        write(source / symbol / "orders.jsonl", json.dumps({"ts": 1, f"key{symbol}": 1}))
    paths = [r.path for r in ingest.source_files(spark, str(source)).collect()]
    other = ingest.DATASETS[[d.name for d in ingest.DATASETS].index("other")]
    tables.write_dataset(ingest.parse_files(spark, paths, other), lake, other)
    write(source / "A" / "orders.jsonl", json.dumps({"ts": 2, "keyA": 2}))
    ingest.append_new(ingest.source_files(spark, str(source)).where("path_symbol = 'A'"), str(source), lake)
    assert {"keyA", "keyB"} <= set(tables.open_tables(spark, lake)["other"].columns)


def test_report(spark):
    rows = [("AAA", "a/kline_1.jsonl", v) for v in ["{}", "", "{bad", "[1]", '{"a":1}']] + [("AAA", "a/kline_5.jsonl", "{}")]
    frame = spark.createDataFrame(rows, "path_symbol STRING, path STRING, value STRING").withColumn("dataset", F.lit("market_kline"))
    row = report.ingest_report(frame).first()
    assert (row.files, row.lines, row.rows, row.blank, row.malformed, row.not_object) == (2, 6, 3, 1, 1, 1)


def test_notes_from_files(spark, tmp_path):
    good = {"saved_at": "2024-01-02", "title": "t", "body": "b", "snapshot": {"view_state": {"x_range": ["2024-01-01", 5]}},
            "ai_summary": {"status": " ok "}}
    write(tmp_path / "AAA" / "n1" / "note.json", json.dumps(good, indent=2))
    write(tmp_path / "AAA" / "n2" / "note.json", json.dumps({"title": "x", "ai_summary": "text", "snapshot": [1]}))
    for i, text in enumerate(["{bad", "[1]", "{}", " "]):
        write(tmp_path / "AAA" / f"bad{i}" / "note.json", text)
    write(tmp_path / "AAA" / "none" / "other.json", "{}")
    rows = {r.id: r for r in notes.read_notes(spark, str(tmp_path)).collect()}
    assert set(rows) == {"n1", "n2"} and rows["n1"].folder_symbol == "AAA"
    assert rows["n1"].snapshot.view_state.x_range == ["2024-01-01", "5"] and rows["n1"].ai_summary.status == " ok "
    assert rows["n2"].title == "x" and rows["n2"].ai_summary is None and rows["n2"].snapshot is None


def test_union_by_name(spark):
    a, b = spark.createDataFrame([(1, 2)], "x INT, y INT"), spark.createDataFrame([(3, 4)], "x INT, z INT")
    assert [tuple(r) for r in tables.union_by_name(a, b).collect()] == [(1, 2, None), (3, None, 4)]


def test_write_by_symbol(spark, tmp_path):
    rows = spark.createDataFrame([("A", i * 60000, float(i)) for i in range(3000)] + [("B", 0, 1.0)] * 5,
                                 "symbol STRING, ts_ms BIGINT, v DOUBLE")
    tables.write_by_symbol(rows, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.select("symbol", "ts_ms", "v").exceptAll(rows).isEmpty() and back.count() == 3005


def test_notes_of_many_partitions_are_one_folder(spark, tmp_path):
    source, lake = tmp_path / "s", tmp_path / "lake"
    for n in range(40):
        write(source / f"S{n}" / "meta.json", f'{{"n":{n}}}')
    ingest.refresh(spark, str(source), str(lake))
    folders = [p for p in (lake / tables.KEY_TYPES).rglob("*") if p.is_dir()]
    assert [p.name for p in folders] == ["meta"]
    assert tables.read_key_types(spark, str(lake), "meta").where("field = 'n'").count() == 40


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    for n in range(200):
        write(tmp_path / f"S{n}" / "meta.json", "{}")
    spark.sparkContext.setJobGroup("listing", "listing")
    assert routing.source_files(spark, str(tmp_path)).count() == 200
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setJobGroup("tests", "tests")
    assert max(tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s)) <= 64


def test_files_are_listed_by_tasks(spark, tmp_path):
    """What Spark's own listing finds, with no file's status on the driver."""
    root = tmp_path / "A b+c%41=é"
    for name in ("S1/x.json", "S2/raw/x.json/symbol=Q%3A1/part-0", "S2/.hidden/x.json", "S3/_no/x.json", "_k=v/x.json", "S4/_no.json", "x.json"):
        write(root / name, name)
    (tmp_path / "elsewhere").mkdir()
    write(tmp_path / "elsewhere" / "y.json", "y")
    write(tmp_path / "elsewhere" / "empty.json", "")
    (root / "link").symlink_to(tmp_path / "elsewhere")
    (root / "broken").symlink_to(tmp_path / "nothing")
    visible = lines.visible_names()
    found = lines.listed(spark, str(root), lambda parts: visible(parts[-1]))
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(root)).select("path", "modificationTime", "length")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, scan.collect())) and found.count() == 5
    assert "Scan binaryFile" not in found._jdf.queryExecution().toString()
    assert lines.listed(spark, str(tmp_path / "nothing"), lambda parts: True) is None


def test_documents_are_read_as_a_text_scan_does(spark, tmp_path):
    rows = spark.createDataFrame([("é \r\n",), ("x" * 300_000,), ("{}",)], "value STRING").coalesce(1)
    for codec in ("none", "gzip", "bzip2", "deflate", "lz4", "snappy"):
        rows.write.option("compression", codec).text(str(tmp_path / codec))
    files = lines.listed(spark, str(tmp_path), lambda parts: not parts[-1].startswith((".", "_")))
    read = lines.document_texts(files.withColumn("more", F.lit(1)))
    assert read.columns == ["value", "path", "modified_at", "bytes", "more"]
    assert {r.value for r in read.collect()} == {r.value for r in lines.read_texts(spark, [str(tmp_path)], whole_files=True).collect()}
    assert read.count() == 6


def test_written_documents_replace_what_their_folders_held(spark, tmp_path):
    """A file for each row, also for rows of one key, of a null key or text and of odd characters; other folders stay."""
    def land(*rows):
        lines.write_documents(spark.createDataFrame(rows, "symbol STRING, id STRING, value STRING"), str(tmp_path / "d"), ["symbol", "id"])
        return sorted((p.parent.parent.name, p.parent.name, p.read_text()) for p in (tmp_path / "d").rglob("*") if p.is_file())

    first = land(("A", "1", "x"), ("A", "1", "y"), ("A", "1", "y"), ("b/é:%", "2", None), (None, "3", "z"))
    assert first == sorted([
        ("symbol=A", "id=1", "x\n"), ("symbol=A", "id=1", "y\n"), ("symbol=A", "id=1", "y\n"),
        ("symbol=b%2Fé%3A%25", "id=2", "\n"), ("symbol=__HIVE_DEFAULT_PARTITION__", "id=3", "z\n")])
    assert land(("A", "1", "new")) == sorted([*(f for f in first if f[0] != "symbol=A"), ("symbol=A", "id=1", "new\n")])


def test_notes_in_keyed_folders(spark, tmp_path):
    """Many folders of notes, some written again: all are found, the newer ones by their time, beside plain ones."""
    def land(name, numbers):
        rows = [("S", f"n{i}", json.dumps({"title": name})) for i in numbers]
        lines.write_documents(spark.createDataFrame(rows, "symbol STRING, id STRING, value STRING"), str(tmp_path / "note.json"), ["symbol", "id"])

    land("a", range(1200))
    write(tmp_path / "_P" / "n0" / "note.json", '{"title": "plain"}')
    write(tmp_path / "_P" / "n0" / "deep" / "note.json", '{"title": "not one"}')
    first = notes.read_notes(spark, str(tmp_path)).agg(F.max("modified_at")).first()[0]
    land("b", range(0, 1200, 100))
    found = notes.read_notes(spark, str(tmp_path))
    assert {(r.folder_symbol, r.title, r["count"]) for r in found.groupBy("folder_symbol", "title").count().collect()} == {
        ("S", "a", 1188), ("S", "b", 12), ("_P", "plain", 1)}
    assert "FileScan" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.id for r in notes.read_notes(spark, str(tmp_path), since=first).collect()} == {f"n{i}" for i in range(0, 1200, 100)}


def instruments(folder, **docs):
    for symbol, text in docs.items():
        write(folder / symbol / "raw" / "instrument.json", text)


def test_documents_lie_in_a_fixed_number_of_folders(spark, tmp_path):
    source, lake = tmp_path / "s", str(tmp_path / "lake")
    instruments(source, **{f"S{i}": f'{{"n":{i}}}' for i in range(150)})
    assert ingest.refresh(spark, str(source), lake) == 150
    view = tables.open_tables(spark, lake)["instrument"]
    assert {(r.symbol, r.symbol_partition, r.record_symbol, r.n) for r in view.collect()} == {(f"S{i}", f"S{i}", f"S{i}", i) for i in range(150)}
    assert len(view.inputFiles()) <= routing.BUCKETS and "bucket" not in view.columns
    assert [r.symbol for r in tables.listed_symbols(spark, lake, ["instrument"]).limit(2).collect()] == ["S0", "S1"]


def test_second_refresh_of_documents_that_share_a_folder(spark, tmp_path, monkeypatch):
    """A changed and a lost document: the others of their folder stay, and a round that died is made again."""
    source, lake = tmp_path / "s", str(tmp_path / "lake")
    monkeypatch.setattr(routing, "BUCKETS", 2)
    monkeypatch.setattr(ingest, "BUCKETS", 2)
    instruments(source, **{f"S{i}": f'{{"n":{i}}}' for i in range(9)})
    ingest.refresh(spark, str(source), lake)

    def rows():
        return {(r.symbol, r.n) for r in tables.open_tables(spark, lake)["instrument"].collect()}

    instruments(source, S1=" ", S2='{"n":"x"}')
    later(source / "S1" / "raw" / "instrument.json", 5)
    later(source / "S2" / "raw" / "instrument.json", 5)
    with monkeypatch.context() as broken:
        broken.setattr(ingest, "record", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ingest.refresh(spark, str(source), lake)
    ingest.refresh(spark, str(source), lake)
    assert rows() == {(f"S{i}", "x" if i == 2 else str(i)) for i in range(9) if i != 1}
    assert len(tables.open_tables(spark, lake)["instrument"].inputFiles()) <= 2
    assert ingest.refresh(spark, str(source), lake) == 0


def test_documents_stored_with_a_folder_for_each_symbol(spark, tmp_path):
    """A lake of an earlier version is read as it is, and stored anew by the next refresh or batch."""
    source, lake = tmp_path / "s", str(tmp_path / "lake")
    instruments(source, A='{"n":1}', B='{"n":2}')
    files = ingest.source_files(spark, str(source))
    dataset = routing.BY_NAME["instrument"]
    old = ingest.parse_files(spark, [r.path for r in files.collect()], dataset).withColumnRenamed("symbol", "record_symbol")
    old.withColumnRenamed("path_symbol", "symbol").write.partitionBy("symbol").parquet(f"{lake}/instrument")
    files.select("path", "modified_at").write.parquet(f"{lake}/{ingest.MANIFEST}")
    view = tables.open_tables(spark, lake)["instrument"]
    assert {(r.symbol, r.n) for r in view.collect()} == {("A", 1), ("B", 2)}
    instruments(source, C='{"n":3}')
    ingest.append_new(ingest.source_files(spark, str(source)).where("path_symbol = 'C'"), str(source), lake)
    assert {(r.symbol, r.n) for r in tables.open_tables(spark, lake)["instrument"].collect()} == {("A", 1), ("B", 2), ("C", 3)}
    assert ingest.refresh(spark, str(source), lake) == 0


def test_documents_do_not_pass_through_the_driver(spark, tmp_path, monkeypatch):
    """No name of a document's file is gathered: a reader that gets names would fail, and all come in one round."""
    source, lake = tmp_path / "s", str(tmp_path / "lake")
    for i in range(30):
        write(source / f"S{i}" / "meta.json", f'{{"listingTimeMs": {i}, "endpointState": {{"k": {{"n": {i}}}}}}}')
    monkeypatch.setattr(ingest, "read_texts", lambda *a, **k: 1 / 0)
    monkeypatch.setattr(ingest, "ROUND_FILES", 7)
    assert ingest.refresh(spark, str(source), lake) == 30
    assert {(r.symbol, r.k_n) for r in tables.open_tables(spark, lake)["meta"].collect()} == {(f"S{i}", i) for i in range(30)}


def test_documents_in_part_files_of_one_symbol(spark, tmp_path):
    """Part files are documents each, and all of them are read again when one changes."""
    source, lake = tmp_path / "s", str(tmp_path / "lake")
    texts = spark.createDataFrame([("S1", '{"p":1}'), ("S1", '{"p":2}'), ("S2", '{"p":3}'), ("S3", "{bad")], "symbol STRING, value STRING")
    lines.write_documents(texts, str(source / "raw" / "ticker.json"), ["symbol"])

    def rows():
        ingest.refresh(spark, str(source), lake)
        return sorted((r.symbol, r.p) for r in tables.open_tables(spark, lake)["ticker"].select("symbol", "p").collect())

    assert rows() == [("S1", 1), ("S1", 2), ("S2", 3)]
    part = source / "raw" / "ticker.json" / "symbol=S1" / "part-00000.txt"
    write(part, '{"p":7}')
    later(part, 5)
    assert rows() == [("S1", 2), ("S1", 7), ("S2", 3)]
