"""Event times a fraction of a second before the border of a range."""

import duckdb
import compare

import __spark_entry__ as entry
from ledgerline import catalog


def test_events_just_before_a_border_count_where_the_sql_counts_them(spark, sf, tmp_path):
    con = duckdb.connect()
    late = "date_trunc('day', ts) + INTERVAL 5 HOUR + INTERVAL 59 MINUTE + INTERVAL 59700 MILLISECOND"
    made = f"SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN {late} ELSE ts END AS ts) FROM '{sf}/events.parquet'"
    con.execute(f"COPY ({made}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    name = "t03_rolling_visitors"
    assert compare.difference(entry.queries()[name](spark, str(tmp_path)), con, catalog.ORACLES[name]) is None
