"""SQL twins of the registered queries, for DuckDB over the same Parquet tables."""

from __future__ import annotations

from barlake.plans import queries as q
from barlake.schemas import EVENT_HORIZON_HOURS, LAST_VALUE_COLUMNS, SERIES_COLUMNS, TIMEFRAMES, WIDE_COLUMNS

MINUTE = 60_000

# --- building blocks -------------------------------------------------------------

TICKS = """b AS (
  SELECT event_id, user_id, upper(event_type) AS symbol, epoch_us(ts) // 1000 AS ms, epoch_us(ts) AS us,
         value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size
  FROM events)"""


def floor_to(ms: str, width: int | str) -> str:
    return f"(({ms}) // {width}) * {width}"


def candles(name: str, price: str, minutes: int = 1, shift: int = 0, sums: bool = False) -> str:
    extra = ", sum(price) AS volume, sum(price * price) AS turnover" if sums else ""
    return f"""{name} AS (
  SELECT symbol, {floor_to(f'ms + {shift}', minutes * MINUTE)} AS ts_ms,
         arg_min({price}, us) AS open, max({price}) AS high, min({price}) AS low, arg_max({price}, us) AS close{extra}
  FROM b GROUP BY 1, 2)"""


K = candles("k", "price", sums=True)
M = candles("m", "price * 1.001", shift=30_000)
I = candles("i", "size", shift=15_000)
P = candles("p", "(price - size) / 100", shift=45_000)
OI = f"""oi AS (
  SELECT symbol, {floor_to('ms', 5 * MINUTE)} AS ts_ms, sum(size) AS open_interest FROM b GROUP BY 1, 2)"""
AR = f"""ar AS (
  SELECT symbol, ts_ms, buy_ratio, 1 - buy_ratio AS sell_ratio,
         CASE WHEN 1 - buy_ratio <> 0 THEN buy_ratio / (1 - buy_ratio) END AS long_short_ratio
  FROM (SELECT symbol, {floor_to('ms', 5 * MINUTE)} AS ts_ms, avg(size) / 99 AS buy_ratio FROM b GROUP BY 1, 2))"""
F = f"""f AS (
  SELECT symbol, {floor_to('ms', 60 * MINUTE)} AS ts_ms, arg_max(price, us) / 10000 AS funding_rate
  FROM b GROUP BY 1, 2)"""


def _prices(alias: str, prefix: str) -> str:
    return ", ".join(f"{alias}.{c} AS {prefix}_{c}" for c in ("open", "high", "low", "close"))


W = f"""w AS (
  SELECT k.symbol, k.ts_ms, {_prices('k', 'kline')}, k.volume AS kline_volume, k.turnover AS kline_turnover,
         {_prices('m', 'mark')}, {_prices('i', 'index')}, {_prices('p', 'premium')},
         oi.open_interest, ar.buy_ratio, ar.sell_ratio, ar.long_short_ratio,
         CASE WHEN i.close <> 0 AND m.close IS NOT NULL THEN ((m.close / i.close) - 1) * 10000 END AS basis_bps
  FROM k
  LEFT JOIN m USING (symbol, ts_ms) LEFT JOIN i USING (symbol, ts_ms) LEFT JOIN p USING (symbol, ts_ms)
  LEFT JOIN oi USING (symbol, ts_ms) LEFT JOIN ar USING (symbol, ts_ms))"""
WIDE = f"WITH {', '.join([TICKS, K, M, I, P, OI, AR, W])}"
SUMS = ("kline_volume", "kline_turnover")


def _listed(columns: list[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" if c in SUMS else c for c in columns)


def _bars(width: str, source: str = "w") -> str:
    """Bars of one width: every value in the derived tables is finite, so null is the only gap."""
    last = ", ".join(f"arg_max({c}, ts_ms) FILTER ({c} IS NOT NULL) AS {c}" for c in LAST_VALUE_COLUMNS)
    return f"""
  arg_min(coalesce(kline_open, kline_close), ts_ms) FILTER (coalesce(kline_open, kline_close) IS NOT NULL) AS kline_open,
  max(greatest(kline_high, kline_close)) AS kline_high, min(least(kline_low, kline_close)) AS kline_low,
  arg_max(kline_close, ts_ms) FILTER (kline_close IS NOT NULL) AS kline_close,
  round(sum(kline_volume), 6) AS kline_volume, round(sum(kline_turnover), 6) AS kline_turnover, {last}"""


def _resample(minutes: int) -> str:
    if minutes == 1:
        return f"{WIDE} SELECT symbol, ts_ms, {_listed(SERIES_COLUMNS)} FROM w"
    bucket = floor_to("ts_ms", minutes * MINUTE)
    return f"""{WIDE} SELECT symbol, bucket AS ts_ms, {_bars('')}
FROM (SELECT *, {bucket} AS bucket FROM w) GROUP BY symbol, bucket"""


TIMEFRAME_ROWS = ", ".join(f"('{tf}', {minutes * MINUTE})" for tf, minutes in TIMEFRAMES.items())
TF = f"tf(timeframe, width) AS (VALUES {TIMEFRAME_ROWS})"


def _json_time(ms: str) -> str:
    return f"epoch_ms(CAST({ms} AS BIGINT))"


def _iso(ms: str, format_: str) -> str:
    return f"strftime(epoch_ms(CAST({ms} AS BIGINT)), '{format_}')"


ORACLES: dict[str, str] = {}

# --- ingest -------------------------------------------------------------------------

_RAW7 = """'["' || ms || '","' || price || '","' || price || '","' || price || '","' || price || '","' || size || '","' || size || '"]'"""

ORACLES["jsonl_kline_ingest"] = f"""WITH {TICKS}, r AS (
  SELECT *, CASE WHEN size = 23 THEN 9223372036854775807 WHEN size <> 6 THEN ms END AS ts_ms,
         CASE WHEN size NOT IN (6, 11, 15, 16) THEN ms END AS raw_ms
  FROM b WHERE size NOT IN (0, 1, 2, 3, 4, 5, 17, 18, 19, 20, 21))
SELECT event_id, symbol, ts_ms, CASE WHEN size <> 23 THEN ts_ms END AS ts_at, raw_ms AS ts_from_raw_ms, raw_ms AS ts_from_raw_at,
  CASE WHEN size IN (6, 7, 8, 12, 14, 22) THEN NULL WHEN size = 13 THEN 1.0 ELSE price END AS open,
  CASE WHEN size <> 6 THEN price END AS high, CASE WHEN size <> 6 THEN price END AS low,
  CASE WHEN size <> 6 THEN price END AS close, CASE WHEN size <> 6 THEN size END AS volume,
  CAST(NULL AS DOUBLE) AS turnover,
  size NOT IN (6, 10, 11, 15, 16) AS has_volume_turnover,
  CASE WHEN size IN (6, 11, 15, 16) THEN NULL WHEN size = 10 THEN '["' || ms || '",1,true,null,"x"]'
       ELSE {_RAW7} END AS raw_json,
  CASE WHEN size IN (6, 10, 11, 15) THEN NULL WHEN size = 16 THEN '[1,{{"z":"b","a":1.5}}]' ELSE '[]' END AS extra_json
FROM r"""

ORACLES["jsonl_funding_ingest"] = f"""WITH {TICKS}, r AS (
  SELECT *, CASE WHEN size < 60 THEN ms END AS c, {floor_to('ms', 60 * MINUTE)} AS h FROM b)
SELECT event_id, CASE WHEN size < 30 THEN symbol ELSE 'REC_' || symbol END AS symbol, symbol AS path_symbol,
  coalesce(c, h) AS ts_ms, coalesce(c, h) AS ts_at, c AS collector_ts_ms, c AS collector_ts_at,
  h AS funding_rate_timestamp_ms, h AS funding_rate_timestamp_at, CAST(h AS VARCHAR) AS funding_rate_timestamp_raw,
  price AS funding_rate FROM r"""

ORACLES["jsonl_open_interest_ingest"] = f"""WITH {TICKS}, r AS (
  SELECT *, CASE WHEN size NOT IN (1, 2, 3) THEN ms END AS c,
         CASE WHEN size <> 3 THEN {floor_to('ms', 5 * MINUTE)} END AS s FROM b)
SELECT event_id, symbol, coalesce(c, s) AS ts_ms, c AS collector_ts_ms, s AS source_timestamp_ms,
  s AS source_timestamp_at, CAST(s AS VARCHAR) AS source_timestamp_raw,
  CASE WHEN size <> 2 THEN size END AS open_interest FROM r"""

ORACLES["jsonl_account_ratio_ingest"] = f"""WITH {TICKS}, r AS (
  SELECT *, size / 99 AS buy, CASE WHEN size <> 0 THEN 1 - size / 99 END AS sell FROM b)
SELECT event_id, symbol, ms AS ts_ms, CAST(NULL AS BIGINT) AS collector_ts_ms, ms AS source_timestamp_ms,
  CAST(ms AS VARCHAR) AS source_timestamp_raw, buy AS buy_ratio, sell AS sell_ratio,
  CASE WHEN sell <> 0 THEN buy / sell END AS long_short_ratio FROM r"""

_GENERIC_FIELDS = [
    ("ts", "'0'", "0", "0.0"), ("timestamp", "NULL", "NULL", "NULL"),
    ("time", "CAST(ms AS VARCHAR)", "ms", "CAST(ms AS DOUBLE)"),
    ("a_b_c", "CAST(size AS VARCHAR)", "NULL", "size"), ("a_e", "CAST(price AS VARCHAR)", "NULL", "price"),
    ("list", """'[1,"' || size || '",{"x":[2]}]'""", "NULL", "NULL"), ("text", "'}user ' || user_id || '{'", "NULL", "NULL"),
    ("x_y_z", "CAST(-user_id AS VARCHAR)", "-user_id", "CAST(-user_id AS DOUBLE)"),
    ("none", "NULL", "NULL", "NULL"), ("u", "CAST(-user_id AS VARCHAR)", "-user_id", "CAST(-user_id AS DOUBLE)"),
]
_DEEP = "'deep' || repeat('_k', CAST(size AS INT) % 30 + 1)"
_LONG_ID = "'12345678901' || lpad(CAST(user_id AS VARCHAR), 9, '0')"
ORACLES["jsonl_generic_flatten"] = f"""WITH {TICKS}
SELECT event_id, symbol, ms AS ts_ms, {_DEEP} AS field, '7' AS value_str, CAST(7 AS BIGINT) AS value_long, 7.0::DOUBLE AS value_double FROM b
UNION ALL SELECT event_id, symbol, ms, 'id', {_LONG_ID}, NULL, CAST({_LONG_ID} AS DOUBLE) FROM b UNION ALL """ + " UNION ALL ".join(
    f"SELECT event_id, symbol, ms AS ts_ms, '{name}' AS field, CAST({text} AS VARCHAR) AS value_str, "
    f"CAST({whole} AS BIGINT) AS value_long, CAST({number} AS DOUBLE) AS value_double FROM b"
    for name, text, whole, number in _GENERIC_FIELDS
)
ORACLES["jsonl_generic_wide"] = f"""WITH {TICKS}
SELECT event_id, symbol, ms AS ts_ms, size AS a_b_c, price AS a_e, '[1,"' || size || '",{{"x":[2]}}]' AS list,
  CAST(NULL AS BIGINT) AS text, -user_id AS u FROM b"""
ORACLES["generic_field_names"] = (
    "SELECT field FROM (VALUES ('id'), " + ", ".join(f"('{f[0]}')" for f in _GENERIC_FIELDS)
    + f") AS t(field) WHERE EXISTS (SELECT 1 FROM events) UNION (WITH {TICKS} SELECT DISTINCT {_DEEP} FROM b)"
)
ORACLES["ingest_report"] = f"""WITH {TICKS}
SELECT symbol, 'market_kline' AS dataset, count(DISTINCT user_id) AS files, count(*) AS lines,
  count(*) FILTER (size > 5 AND size NOT BETWEEN 17 AND 21) AS rows, count(*) FILTER (size IN (0, 1)) AS blank,
  count(*) FILTER (size IN (2, 5) OR size BETWEEN 17 AND 21) AS malformed, count(*) FILTER (size IN (3, 4)) AS not_object
FROM b GROUP BY symbol"""
ORACLES["duplicate_keys"] = f"""WITH {TICKS}
SELECT symbol, {floor_to('ms', MINUTE)} AS ts_ms, count(*) AS copies FROM b GROUP BY 1, 2 HAVING count(*) > 1"""
ORACLES["risk_limit_explode"] = """WITH o AS (
  SELECT o_orderpriority AS symbol, strftime(o_orderdate, '%Y-%m-%d') AS generated_at_iso, o_orderkey AS id,
         o_totalprice AS riskLimit FROM orders)
SELECT symbol, generated_at_iso, CAST(1 AS BIGINT) AS row_num, id, riskLimit AS risk_limit_value,
  0.5::DOUBLE AS maintenance_margin, NULL::DOUBLE AS initial_margin, CAST(1 AS BIGINT) AS is_lowest_risk,
  NULL::DOUBLE AS max_leverage, NULL::DOUBLE AS mm_deduction FROM o
UNION ALL
SELECT symbol, generated_at_iso, 4, id, riskLimit, NULL, 0.01, 0, 12.5, NULL FROM o"""
ORACLES["meta_expand"] = """
SELECT CASE WHEN c_acctbal < 0 THEN c_mktsegment ELSE c_name END AS symbol,
  c_custkey * 86400000 AS listing_time_at, c_custkey * 86400000 AS collected_from_at,
  CAST(NULL AS BIGINT) AS collected_to_at,
  '{"kline":{"next":"' || c_custkey || '","deep":{"z":' || c_custkey || '}},"flag":true}' AS endpoint_state_json,
  c_custkey AS kline_next, '{"z":' || c_custkey || '}' AS kline_deep, true AS flag,
  'seg ' || c_mktsegment AS note, '{"x":[' || c_custkey || ']}' AS extra
FROM customer"""
_PART_FIELDS = [
    ("symbol", "p_name", "NULL", "NULL"), ("priceFilter_tickSize", "CAST(p_retailprice AS VARCHAR)", "NULL", "p_retailprice"),
    ("priceFilter_range_min", "'0'", "0", "0.0"),
    ("priceFilter_range_max", "CAST(p_partkey AS VARCHAR)", "p_partkey", "CAST(p_partkey AS DOUBLE)"),
    ("status", "p_brand", "NULL", "NULL"), ("tags", """'["' || p_type || '",1]'""", "NULL", "NULL"),
]
ORACLES["snapshot_flatten"] = " UNION ALL ".join(
    f"SELECT p_name AS symbol, CAST(p_partkey AS VARCHAR) AS path_symbol, '{name}' AS field, "
    f"CAST({text} AS VARCHAR) AS value_str, CAST({whole} AS BIGINT) AS value_long, CAST({number} AS DOUBLE) AS value_double "
    "FROM part" for name, text, whole, number in _PART_FIELDS
)

_NATION = "CASE WHEN s_suppkey >= 3 THEN 'N' || s_nationkey END"
ORACLES["instrument_view"] = f"""SELECT 'S' || s_suppkey AS symbol, s_name AS record_symbol, s_acctbal AS "priceFilter_tickSize",
  s_suppkey AS "priceFilter_range_max", {_NATION} AS status, '["' || s_suppkey || '",1]' AS tags FROM supplier"""
ORACLES["instrument_view_second_run"] = """SELECT 'S' || s_suppkey AS symbol, s_name AS record_symbol,
  CASE WHEN s_suppkey % 5 = 1 THEN 'x' || s_acctbal ELSE CAST(s_acctbal AS VARCHAR) END AS "priceFilter_tickSize",
  CASE WHEN s_suppkey % 5 = 1 THEN s_suppkey + 0.5 ELSE s_suppkey END::DOUBLE AS "priceFilter_range_max",
  CASE WHEN s_suppkey % 5 = 1 THEN '[]' ELSE '["' || s_suppkey || '",1]' END AS tags FROM supplier WHERE s_suppkey <> 1"""
ORACLES["ticker_view"] = f"""SELECT 'S' || s_suppkey AS symbol, 'S' || s_suppkey AS record_symbol, s_acctbal AS "lastPrice",
  s_suppkey + 0.5::DOUBLE AS turnover, {_NATION} AS phone FROM supplier"""
ORACLES["meta_view"] = f"""SELECT 'S' || s_suppkey AS symbol, 'S' || s_suppkey AS record_symbol, s_suppkey * 86400000 AS listing_time_at,
  s_suppkey * 86400000 AS "listingTimeMs", s_suppkey AS kline_next, '{{"z":' || s_suppkey || '}}' AS kline_deep, {_NATION} AS note,
  '{{"kline":{{"next":"' || s_suppkey || '","deep":{{"z":' || s_suppkey || '}}}}}}' AS endpoint_state_json FROM supplier"""

# --- symbols, routing, labels -----------------------------------------------------------

_SYMBOLS = """s AS (
  SELECT upper(trim(c_mktsegment)) AS symbol FROM customer UNION SELECT upper(event_type) FROM events)"""
_NAMES = "[" + ", ".join(f"'{n}'" for n in q.FILE_NAMES) + "]"
_PATHS = f"""n AS (
  SELECT event_id, symbol, ms, size, ({_NAMES})[(user_id % {len(q.FILE_NAMES)}) + 1] AS name FROM b),
paths AS (SELECT *, '/data/symbols/' || lower(symbol) || '/' || name AS path FROM n)"""
_ROUTES = {
    "kline_1.jsonl": ("market_kline", "1"), "mark_price_kline_1.jsonl": ("mark_price_kline", "1"),
    "index_price_kline_15.jsonl": ("index_price_kline", "15"),
    "premium_index_price_kline_D.jsonl": ("premium_index_price_kline", "D"),
    "funding_history.jsonl": ("funding_history", None), "open_interest_5min.jsonl": ("open_interest", "5min"),
    "account_ratio_1h.jsonl": ("account_ratio", "1h"), "liquidations.jsonl": ("other", "liquidations"),
    "risk_limit.json": ("risk_limit", None), "meta.json": ("meta", None),
    "raw/instrument.json": ("instrument", None), "raw/ticker.json": ("ticker", None),
    "kline_5.jsonl/part-00001.txt": ("market_kline", "5"),
}
_ROUTE_ROWS = ", ".join(
    f"('{name}', '{dataset}', {repr(label) if label else 'CAST(NULL AS VARCHAR)'})"
    for name, (dataset, label) in _ROUTES.items()
)
_ROUTED = f"""routes(name, dataset, label) AS (VALUES {_ROUTE_ROWS}),
routed AS (SELECT paths.*, dataset, label FROM paths LEFT JOIN routes USING (name))"""

ORACLES["symbol_selection"] = f"WITH {_SYMBOLS} SELECT symbol FROM s"
ORACLES["missing_symbols"] = f"""WITH {_SYMBOLS}
SELECT symbol FROM s WHERE symbol NOT IN (SELECT upper(event_type) FROM events)"""
ORACLES["selected_files"] = f"""WITH {TICKS}, {_PATHS}, {_ROUTED}
SELECT symbol AS path_symbol, dataset, count(*) AS files FROM routed GROUP BY 1, 2"""
ORACLES["dataset_routing"] = f"""WITH {TICKS}, {_PATHS}, {_ROUTED}
SELECT event_id, path, symbol AS path_symbol, dataset, label FROM routed"""
ORACLES["path_labels"] = f"""WITH {TICKS}
SELECT event_id, symbol AS symbol_partition, CAST(user_id AS VARCHAR) AS interval, '' AS no_interval FROM b"""
ORACLES["union_by_name"] = f"""WITH {TICKS}, {M}, {OI}, {AR}
SELECT *, '1' AS interval FROM m UNION ALL BY NAME SELECT *, '5min' AS period FROM oi
UNION ALL BY NAME SELECT *, '5min' AS period FROM ar"""

# --- wide table, series, listings ---------------------------------------------------------

ORACLES["timeseries_1m_wide"] = f"""{WIDE}
SELECT {_listed([c for c in WIDE_COLUMNS if c != 'ts'])}, ts_ms AS ts_at FROM w"""
ORACLES["basis_bps"] = f"""{WIDE}
SELECT symbol, count(basis_bps) AS n, min(basis_bps) AS lowest, max(basis_bps) AS highest,
  count(*) FILTER (index_close = 0) AS zero_index FROM w GROUP BY symbol"""
ORACLES["series_filter_bounds"] = f"""{WIDE}
SELECT symbol, ts_ms, {_listed(SERIES_COLUMNS)} FROM w
WHERE symbol = '{q.SYMBOL.upper()}' AND ts_ms >= {q.START_MS} AND ts_ms <= {q.END_MS} ORDER BY ts_ms"""
ORACLES["funding_series"] = f"""WITH {TICKS}, {F}
SELECT symbol, ts_ms, funding_rate FROM f WHERE symbol = '{q.SYMBOL.upper()}' AND ts_ms >= {q.START_MS} ORDER BY ts_ms"""
ORACLES["sql_over_views"] = f"""{WIDE}
SELECT symbol, ts_ms, {_listed([c for c in SERIES_COLUMNS if c not in ('kline_open', 'kline_high', 'kline_low')])} FROM w
WHERE symbol = '{q.SYMBOL.upper()}' AND ts_ms >= {q.START_MS} ORDER BY ts_ms"""
_VIEWS = {
    "market_kline": "(SELECT symbol FROM k UNION ALL SELECT symbol FROM k5 UNION ALL SELECT symbol FROM k60)",
    "mark_price_kline": "m", "index_price_kline": "i", "premium_index_price_kline": "p", "open_interest": "oi",
    "account_ratio": "ar", "funding_history": "f", "symbol_timeseries_1m": "w",
}
ORACLES["view_counts"] = (
    f"{WIDE}, {F}, {candles('k5', 'price', 5)}, {candles('k60', 'price', 60)} " + " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS rows, count(DISTINCT symbol) AS symbols FROM {view}"
        for name, view in _VIEWS.items()
    )
)
ORACLES["symbol_list"] = f"WITH {TICKS} SELECT DISTINCT symbol FROM b ORDER BY symbol"
ORACLES["stored_symbols"] = f"WITH {TICKS} SELECT DISTINCT symbol FROM b WHERE symbol <> 'VIEW' ORDER BY symbol"
ORACLES["series_coverage"] = f"{WIDE} " + " UNION ALL ".join(
    f"SELECT symbol, '{c}' AS series, count({c}) AS finite_rows, count({c}) > 0 AS has_data FROM w GROUP BY symbol"
    for c in SERIES_COLUMNS
)
ORACLES["series_empty"] = f"{WIDE} SELECT symbol, CAST(1 + " + " + ".join(
    f"(CASE WHEN count({c}) = 0 THEN 1 ELSE 0 END)" for c in SERIES_COLUMNS if c != "open_interest"
) + " AS BIGINT) AS empty_series FROM w GROUP BY symbol"

# --- resample ---------------------------------------------------------------------------------

for _tf, _minutes in TIMEFRAMES.items():
    ORACLES[f"resample_{_tf}"] = _resample(_minutes)
ORACLES["resample_all_timeframes"] = f"""{WIDE}, {TF}
SELECT timeframe, symbol, bucket AS ts_ms, {_bars('')}
FROM (SELECT w.*, timeframe, (ts_ms // width) * width AS bucket FROM w, tf) GROUP BY timeframe, symbol, bucket"""
ORACLES["resample_funding_8h"] = f"""WITH {TICKS}, {F}
SELECT symbol, {floor_to('ts_ms', 480 * MINUTE)} AS ts_ms, arg_max(funding_rate, f.ts_ms) AS funding_rate
FROM f GROUP BY 1, 2"""

_EVERY = "CASE WHEN (ts_ms // 60000) % {} = 0 THEN NULL ELSE {} END AS {}"
_GAPS = {"kline_open": 2, "kline_close": 3, "kline_high": 5, "kline_volume": 7, "mark_close": 2, "basis_bps": 3}
# what isn't finite counts as missing
_GAPPED = f"{WIDE}, g AS (SELECT * REPLACE ({', '.join(_EVERY.format(n, c, c) for c, n in _GAPS.items())}) FROM w)"
ORACLES["nonfinite_resample_1h"] = f"""{_GAPPED} SELECT symbol, bucket AS ts_ms, {_bars('')}
FROM (SELECT *, {floor_to('ts_ms', 60 * MINUTE)} AS bucket FROM g) GROUP BY symbol, bucket"""
ORACLES["nonfinite_coverage"] = f"{_GAPPED} " + " UNION ALL ".join(
    f"SELECT symbol, '{c}' AS series, count({c}) AS finite_rows, count({c}) > 0 AS has_data FROM g GROUP BY symbol"
    for c in SERIES_COLUMNS
)

# --- parallel arrays ------------------------------------------------------------------------------


def _joined(value: str) -> str:
    return f"string_agg(coalesce(CAST({value} AS VARCHAR), 'null'), ',' ORDER BY ts_ms)"


_ISO_SECONDS = "%Y-%m-%dT%H:%M:%S+00:00"
ORACLES["series_pack"] = f"""{WIDE}, {F},
wp AS (SELECT symbol, {floor_to('ts_ms', 1440 * MINUTE)} AS page_ms, count(*) AS rows,
         {_joined(_iso('ts_ms', _ISO_SECONDS))} AS ts,
         {', '.join(f"{_joined(f'CAST(round({c} * 100) AS BIGINT)')} AS {c}" for c in SERIES_COLUMNS)}
       FROM w GROUP BY 1, 2),
fp AS (SELECT symbol, {floor_to('ts_ms', 1440 * MINUTE)} AS page_ms,
         {_joined(_iso('ts_ms', _ISO_SECONDS))} AS funding_ts,
         {_joined('CAST(round(funding_rate * 1000000) AS BIGINT)')} AS funding_rate
       FROM f WHERE symbol IN (SELECT symbol FROM w) GROUP BY 1, 2)
SELECT symbol, page_ms, coalesce(rows, 0) AS rows, coalesce(ts, '') AS ts, coalesce(funding_ts, '') AS funding_ts,
  {', '.join(f"coalesce({c}, '') AS {c}" for c in SERIES_COLUMNS)}, coalesce(funding_rate, '') AS funding_rate
FROM wp FULL JOIN fp USING (symbol, page_ms)"""
ORACLES["series_pack_1h"] = f"""WITH r AS ({_resample(60)})
SELECT symbol, {floor_to('ts_ms', 1440 * MINUTE)} AS page_ms, count(*) AS rows,
  {_joined(_iso('ts_ms', _ISO_SECONDS))} AS ts, {_joined('CAST(round(kline_high * 100) AS BIGINT)')} AS kline_high
FROM r GROUP BY 1, 2"""
ORACLES["nonfinite_pack"] = f"""{_GAPPED}
SELECT symbol, {floor_to('ts_ms', 1440 * MINUTE)} AS page_ms, count(*) AS rows,
  {_joined('CAST(round(kline_open * 100) AS BIGINT)')} AS kline_open, {_joined('CAST(round(mark_close * 100) AS BIGINT)')} AS mark_close
FROM g GROUP BY 1, 2"""
ORACLES["series_unpack"] = _resample(1)

# --- event study --------------------------------------------------------------------------------------


def _moves(condition: str, hours: list[int]) -> str:
    rows = ", ".join(f"({h})" for h in hours)
    return f"""{WIDE}, h(horizon_hours) AS (VALUES {rows}), e AS (
  SELECT w.symbol, w.ts_ms AS event_ts_ms, CAST(horizon_hours AS BIGINT) AS horizon_hours, w.kline_close AS price,
         w.ts_ms + horizon_hours * 3600000 AS target
  FROM w, h WHERE {condition}),
moves AS (
  SELECT e.symbol, event_ts_ms, horizon_hours, CASE WHEN price <> 0 THEN later.kline_close / price - 1 END AS move
  FROM e LEFT JOIN w later ON later.symbol = e.symbol AND later.ts_ms = e.target)"""


def _study(keys: str) -> str:
    return f"""{_moves('basis_bps > 0', EVENT_HORIZON_HOURS)}
SELECT {keys}, count(*) AS event_count, count(move) AS move_count, count(*) FILTER (move > 0) AS up_count,
  count(*) FILTER (move < 0) AS down_count, round(avg(move), 6) AS mean_move, round(median(move), 6) AS median_move,
  max(move) AS max_up, min(move) AS max_down, avg(CASE WHEN move > 0 THEN 1.0 WHEN move <= 0 THEN 0.0 END) AS win_rate
FROM moves GROUP BY {keys}"""


ORACLES["event_study_overall"] = _study("horizon_hours")
ORACLES["event_study_by_symbol"] = _study("symbol, horizon_hours")
ORACLES["event_study_ticks"] = f"""WITH {TICKS}, m AS (
  SELECT symbol, {floor_to('ms', 60 * MINUTE)} AS ts_ms, arg_max(price, event_id) AS price, bool_or(size > 90) AS event FROM b GROUP BY 1, 2),
moves AS (
  SELECT m.symbol, CAST(h AS BIGINT) AS horizon_hours, CASE WHEN m.price <> 0 THEN later.price / m.price - 1 END AS move
  FROM m CROSS JOIN (VALUES (1), (4)) t(h) LEFT JOIN m later ON later.symbol = m.symbol AND later.ts_ms = m.ts_ms + h * 3600000 WHERE m.event)
SELECT symbol, horizon_hours, count(*) AS event_count, count(move) AS move_count, count(*) FILTER (move > 0) AS up_count,
  count(*) FILTER (move < 0) AS down_count, round(avg(move), 6) AS mean_move, round(median(move), 6) AS median_move,
  max(move) AS max_up, min(move) AS max_down, avg(CASE WHEN move > 0 THEN 1.0 WHEN move <= 0 THEN 0.0 END) AS win_rate
FROM moves GROUP BY symbol, horizon_hours"""
ORACLES["event_study_markdown"] = f"""WITH s AS ({_study('symbol, horizon_hours')})
SELECT '| symbol | horizon_hours | event_count | up_count | down_count |' AS value
UNION ALL SELECT '| --- | --- | --- | --- | --- |'
UNION ALL SELECT '| ' || symbol || ' | ' || horizon_hours || ' | ' || event_count || ' | ' || up_count || ' | '
  || down_count || ' |' FROM s"""
ORACLES["event_forward_moves"] = f"""{_moves('kline_volume > 50', [1, 20])}
SELECT symbol, event_ts_ms, horizon_hours, move FROM moves"""

ORACLES["event_study_csv"] = f"""WITH s AS ({_study('symbol, horizon_hours')})
SELECT symbol, horizon_hours, event_count, up_count, down_count FROM s"""

# --- scalars ------------------------------------------------------------------------------------------------

ORACLES["iso_text"] = f"""WITH {TICKS}
SELECT event_id,
  {_iso('ms', '%Y-%m-%dT%H:%M:%S')} || CASE WHEN ms % 1000 <> 0 THEN {_iso('ms', '.%f')} ELSE '' END || '+00:00' AS iso,
  {_iso('ms', '%Y-%m-%dT%H:%M:%S.%gZ')} AS iso_millis, {_iso(floor_to('ms', MINUTE), _ISO_SECONDS)} AS iso_minute
FROM b"""
_SECOND, _MIDNIGHT = floor_to("ms", 1000), floor_to("ms", 1440 * MINUTE)
_SPELLINGS = [_SECOND] * 6 + [_MIDNIGHT, "NULL", "NULL", "NULL", _MIDNIGHT]
ORACLES["timestamp_normalise"] = f"WITH {TICKS} " + " UNION ALL ".join(
    f"SELECT event_id, CAST({n} AS BIGINT) AS spelling, CAST({ms} AS BIGINT) AS ms FROM b"
    for n, ms in enumerate(_SPELLINGS)
)
_ISO_MILLIS = "%Y-%m-%dT%H:%M:%S.%gZ"
ORACLES["marker_list_normalise"] = f"""WITH {TICKS}
SELECT event_id, {_iso(_MIDNIGHT, _ISO_MILLIS)} || CASE WHEN {_SECOND} <> {_MIDNIGHT}
  THEN ',' || {_iso(_SECOND, _ISO_MILLIS)} ELSE '' END AS markers FROM b"""
_SLUG = "regexp_replace(regexp_replace(trim(t), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g')"
ORACLES["slugify"] = f"""WITH x AS (
  SELECT 'page' AS kind, page_id AS id, url AS t FROM pages
  UNION ALL SELECT 'turn', conv_id * 1000 + turn, text FROM conversations)
SELECT kind, id, substr(coalesce(nullif({_SLUG}, ''), 'note'), 1, 120) AS slug FROM x"""
_TEXT = "CAST(user_id AS VARCHAR)"
_NUMBERS = [  # as_int, as_float, value_str, value_long, value_double
    ("user_id", "user_id", _TEXT, "user_id", "user_id"),
    ("user_id", f"{_TEXT} || '.9'", f"{_TEXT} || '.9'", "NULL", f"{_TEXT} || '.9'"),
    ("-user_id", f"'-' || {_TEXT} || '.9'", f"'-' || {_TEXT} || '.9'", "NULL", f"'-' || {_TEXT} || '.9'"),
    ("user_id * 1000", "user_id * 1000", f"{_TEXT} || 'e3'", "NULL", "NULL"),
    ("NULL", "NULL", f"'x' || {_TEXT}", "NULL", "NULL"),
    ("NULL", "NULL", "NULL", "NULL", "NULL"),
    ("NULL", "NULL", "'true'", "NULL", "NULL"),
    ("user_id", "user_id", f"{_TEXT} || '.'", "NULL", "user_id"),
    ("0", f"'.' || {_TEXT}", f"'.' || {_TEXT}", "NULL", f"'.' || {_TEXT}"),
    ("user_id", "user_id", f"'+' || {_TEXT}", "user_id", "user_id"),
    ("NULL", "NULL", f"{_TEXT} || 'd'", "NULL", "NULL"),
    ("NULL", "NULL", "'1e400'", "NULL", "NULL"),
    ("user_id", f"{_TEXT} || '.5'", f"{_TEXT} || '.5'", "NULL", f"{_TEXT} || '.5'"),
    ("NULL", "NULL", _TEXT, "user_id", "user_id"),
]
ORACLES["numeric_parse"] = f"WITH {TICKS} " + " UNION ALL ".join(
    f"SELECT event_id, CAST({n} AS BIGINT) AS spelling, CAST({i} AS BIGINT) AS as_int, CAST({f} AS DOUBLE) AS as_float, "
    f"CAST({s} AS VARCHAR) AS value_str, CAST({l} AS BIGINT) AS value_long, CAST({d} AS DOUBLE) AS value_double FROM b"
    for n, (i, f, s, l, d) in enumerate(_NUMBERS)
)
ORACLES["clean_symbols"] = "SELECT upper(trim(p_name)) AS symbol, count(*) AS n FROM part GROUP BY 1"

# --- notes ----------------------------------------------------------------------------------------------------

_NOTE_SYMBOLS = "['CLICK', 'ERROR', 'PURCHASE', 'SIGNUP', 'VIEW']"
_NOTE_TIMEFRAMES = "['', '1h', '4h', '15m', '1m', 'bad']"
NOTES = f"""n AS (
  SELECT *, 'c' || conv_id || '_' || turn AS id, ({_NOTE_SYMBOLS})[(conv_id % 5) + 1] AS symbol,
    ({_NOTE_TIMEFRAMES})[(turn % 6) + 1] AS tf, 1704067200000 + (conv_id % 28) * 86400000 AS start_ms,
    CASE WHEN turn <> 2 THEN 'turn ' || turn END AS title_, CASE WHEN conv_id % 7 <> 3 THEN text END AS body_
  FROM conversations),
notes AS (
  SELECT id, symbol, role, body_, turn, conv_id AS conv, start_ms, nullif(tf, '') AS timeframe, title_ AS title,
    strftime(epoch_ms(start_ms), '%Y-%m-%d') || 'T00:00:00+00:00' AS saved_at,
    CASE WHEN role <> 'user' THEN strftime(epoch_ms(start_ms), '%Y-%m-%d') || 'T12:00' END AS created_at
  FROM n)"""
_INDEX = f"""WITH {NOTES}
SELECT symbol, id, coalesce(created_at, saved_at) || coalesce(' | ' || title, '') AS label, coalesce(title, '') AS title,
  saved_at, created_at, timeframe, CASE WHEN role = 'assistant' THEN 'ok' END AS ai_status FROM notes"""
ORACLES["snapshot_index"] = _INDEX
ORACLES["snapshots_of_symbol"] = f"{_INDEX} WHERE symbol = '{q.SYMBOL.upper()}'"
ORACLES["snapshot_by_id"] = f"""WITH {NOTES} SELECT id, coalesce(title, ' ' || chr(9) || chr(10)) AS title, coalesce(body_, chr(10) || chr(9)) AS body,
  coalesce(timeframe, '') AS timeframe FROM notes WHERE symbol = 'VIEW' AND id = 'c4_0'"""
ORACLES["note_files"] = f"""WITH {NOTES} SELECT symbol, id,
  CASE WHEN conv % 10 = 3 THEN CASE WHEN conv % 7 = 3 THEN chr(10) || chr(9) ELSE 'again' END
       ELSE coalesce(body_, chr(10) || chr(9)) END AS body, conv % 10 = 3 AS again FROM notes WHERE turn < 2"""
ORACLES["snapshot_counts"] = f"WITH {NOTES} SELECT symbol, count(*) AS snapshots FROM notes GROUP BY symbol"
ORACLES["note_validation"] = f"""WITH {NOTES}
SELECT id, symbol, title, nullif(trim(body_), '') AS body, timeframe, created_at,
  title IS NOT NULL AND coalesce(trim(body_), '') <> '' AS valid,
  CASE WHEN title IS NULL THEN 'missing title' WHEN coalesce(trim(body_), '') = '' THEN 'missing body' END AS reject_reason FROM notes"""
_PINNED = """v AS (SELECT id, symbol, coalesce(tf.timeframe, '1m') AS timeframe, coalesce(width, 60000) AS width,
        CASE WHEN turn <> 1 THEN start_ms END AS x0, CASE WHEN turn <> 1 THEN start_ms + 30 * 3600000 END AS x1
      FROM notes LEFT JOIN tf ON tf.timeframe = coalesce(notes.timeframe, '8h'))"""
ORACLES["snapshot_views"] = f"""WITH {TF}, {NOTES}, {_PINNED}
SELECT symbol, id, timeframe, x0 AS x0_ms, x1 AS x1_ms FROM v"""
_CHART = "symbol || '|' || timeframe || '|' || coalesce(CAST(x0 AS VARCHAR), '') || '|' || coalesce(CAST(x1 AS VARCHAR), '')"
ORACLES["snapshot_charts"] = f"WITH {TF}, {NOTES}, {_PINNED} SELECT id, {_CHART} AS chart FROM v"
ORACLES["snapshot_bars"] = f"""{WIDE}, {TF}, {NOTES}, {_PINNED},
charts AS (SELECT DISTINCT {_CHART} AS chart, symbol, timeframe, width, x0, x1 FROM v),
shown AS (SELECT w.*, chart, timeframe, x0, x1, (ts_ms // width) * width AS bucket FROM charts JOIN w USING (symbol))
SELECT chart, timeframe, symbol, bucket AS ts_ms, {_bars('')}
FROM shown WHERE (x0 IS NULL OR bucket >= x0) AND (x1 IS NULL OR bucket <= x1) GROUP BY chart, timeframe, symbol, bucket"""

# --- incremental and streaming -----------------------------------------------------------------------------------

ORACLES["incremental_changed_files"] = f"""WITH {TICKS}, {_PATHS}, {_ROUTED}
SELECT path, dataset, label, symbol AS path_symbol, max(ms) AS modified_ms FROM routed
WHERE dataset IS NOT NULL GROUP BY ALL
HAVING max(ms) > coalesce(max(ms) FILTER (size < 50), -1)"""
_FUNDING_TABLE = f"""WITH {TICKS}, r AS (
  SELECT *, CASE WHEN size < 60 THEN ms END AS c, {floor_to('ms', 60 * MINUTE)} AS h FROM b)
SELECT symbol, CASE WHEN size < 30 THEN symbol ELSE 'REC_' || symbol END AS record_symbol, coalesce(c, h) AS ts_ms,
  c AS collector_ts_ms, h AS funding_rate_timestamp_ms, price AS funding_rate FROM r"""
for _name in ("stream_ingest_funding", "refresh_then_stream", "stream_then_refresh"):
    ORACLES[_name] = _FUNDING_TABLE
ORACLES["refresh_second_run"] = f"{_FUNDING_TABLE} WHERE symbol <> 'SIGNUP' AND (symbol <> 'VIEW' OR size >= 50)"
ORACLES["ingest_to_wide"] = f"{WIDE} SELECT {_listed([c for c in WIDE_COLUMNS if c != 'ts'])} FROM w"
_TICK_ROWS = ", ".join(
    {"kline_volume": "size AS kline_volume", "kline_turnover": "size * price AS kline_turnover"}.get(
        c, f"{'price' if c.startswith('kline_') else 'size'} AS {c}")
    for c in SERIES_COLUMNS
)
_STREAM = f"""WITH {TICKS}, w AS (SELECT symbol, ms AS ts_ms, {_TICK_ROWS} FROM b)
SELECT symbol, bucket AS ts_ms, {_bars('')}
FROM (SELECT *, {floor_to('ts_ms', 60 * MINUTE)} AS bucket FROM w) GROUP BY symbol, bucket"""
ORACLES["stream_resample_1h"] = _STREAM
ORACLES["stream_append_1h"] = f"""{_STREAM}
HAVING bucket + {60 * MINUTE} <= (SELECT max(ts_ms) FROM w) - {1440 * MINUTE}"""
