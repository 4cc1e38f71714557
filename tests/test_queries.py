"""Every registered query against its SQL twin, and the driver contract."""

import duckdb
import pytest
from compare import TABLES, differences, oracle_connection

import __spark_entry__ as entry
from barlake.plans.oracles import ORACLES
from barlake.plans.queries import QUERIES

# too few rows at the smallest scale for this one to have any
MAY_BE_EMPTY = {"duplicate_keys"}


@pytest.fixture(scope="module")
def conn(sf_dir):
    return oracle_connection(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, conn, name):
    problems = differences(entry.queries()[name](spark, sf_dir), entry.oracle_sql()[name], conn)
    if name in MAY_BE_EMPTY:
        problems = [p for p in problems if p != "no rows"]
    assert not problems


@pytest.fixture(scope="module")
def tied_dir(tmp_path_factory, sf_dir):
    """The tables with every event three times, at the same time and with other prices and sizes."""
    folder = tmp_path_factory.mktemp("tied")
    for name in TABLES:
        if name != "events":
            (folder / f"{name}.parquet").symlink_to(f"{sf_dir}/{name}.parquet")
    duckdb.sql(f"""COPY (SELECT event_id + i * 1000000 AS event_id, ts, user_id, event_type, value + i % 2 AS value,
        '{{"k": ' || (CAST(json_extract_string(props, '$.k') AS INT) + i * 7) % 100 || '}}' AS props
        FROM '{sf_dir}/events.parquet', range(3) AS t(i) ORDER BY 1) TO '{folder}/events.parquet'""")
    return str(folder)


@pytest.mark.parametrize("name", [
    "ingest_to_wide", "sql_over_views", "stream_append_1h", "stream_resample_1h", "resample_1m", "resample_all_timeframes",
    "series_filter_bounds", "series_pack", "series_unpack", "snapshot_bars", "timeseries_1m_wide", "funding_series",
])
def test_ticks_of_one_time(spark, tied_dir, name):
    sql = oracle_connection(tied_dir)
    sql.execute("SET threads = 1")  # the SQL takes the first of tied rows it meets: the smallest id, in the order of the file
    assert not differences(entry.queries()[name](spark, tied_dir), entry.oracle_sql()[name], sql)


@pytest.fixture(scope="module")
def unordered_dir(tmp_path_factory, tied_dir):
    """The same ticks in the order of time, those of one time from the largest id to the smallest."""
    folder = tmp_path_factory.mktemp("unordered")
    for name in TABLES:
        if name != "events":
            (folder / f"{name}.parquet").symlink_to(f"{tied_dir}/{name}.parquet")
    duckdb.sql(f"COPY (FROM '{tied_dir}/events.parquet' ORDER BY ts, event_id DESC) TO '{folder}/events.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", [
    "sql_over_views", "stream_append_1h", "stream_resample_1h", "resample_1m", "resample_all_timeframes",
    "series_filter_bounds", "series_pack", "series_unpack", "snapshot_bars", "funding_series",
])
def test_ticks_of_one_time_count_in_table_order(spark, unordered_dir, name):
    sql = oracle_connection(unordered_dir)
    sql.execute("SET threads = 1")
    assert not differences(entry.queries()[name](spark, unordered_dir), entry.oracle_sql()[name], sql)


@pytest.fixture(scope="module")
def folder_dir(tmp_path_factory, tied_dir):
    """The same ticks in a folder of three files, each with one of the three of a time."""
    folder = tmp_path_factory.mktemp("folder")
    (folder / "events.parquet").mkdir()
    for name in TABLES:
        if name != "events":
            (folder / f"{name}.parquet").symlink_to(f"{tied_dir}/{name}.parquet")
    for i in range(3):
        duckdb.sql(f"""COPY (FROM '{tied_dir}/events.parquet' WHERE event_id // 1000000 = {i} ORDER BY event_id)
            TO '{folder}/events.parquet/part-000{(i + 1) % 3}.parquet'""")
    return str(folder)


@pytest.mark.parametrize("name", [
    "stream_append_1h", "stream_resample_1h", "resample_1m", "resample_all_timeframes", "series_filter_bounds", "series_pack", "series_unpack",
    "funding_series",
])
def test_ticks_of_one_time_count_in_the_order_of_file_names(spark, folder_dir, name):
    sql = duckdb.connect()
    sql.execute("SET TimeZone = 'UTC'")
    sql.execute("SET threads = 1")
    sql.execute(f"CREATE VIEW events AS FROM '{folder_dir}/events.parquet/*.parquet'")
    assert not differences(entry.queries()[name](spark, folder_dir), entry.oracle_sql()[name], sql)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0
