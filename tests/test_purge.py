"""The retention purge deletes from the table."""

import os
from datetime import datetime, timedelta

import pytest

from ledgerline.sources import sinks

AS_OF = datetime(2025, 4, 10, 12)


@pytest.fixture
def events(spark):
    rows = [(i, datetime(2025, 1, 1) + timedelta(hours=i)) for i in range(24 * 20)]
    return spark.createDataFrame(rows, "event_id bigint, created_at timestamp_ntz")


def _ids(spark, path):
    return sorted(r.event_id for r in spark.read.parquet(path).collect())


def test_old_dates_and_the_border_go(spark, events, tmp_path):
    path = str(tmp_path / "events")
    sinks.append_events(events, path)
    first = {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("event_date=2025-01-1")}
    # 90 days before: 10 January, noon.
    gone = sinks.purge_events(spark, path, AS_OF)
    want = [i for i in range(24 * 20) if i >= 9 * 24 + 12]
    assert _ids(spark, path) == want and len(gone) == 9
    assert not [d for d in os.listdir(path) if "2025-01-0" in d]
    # Later dates are not written again.
    assert all(sorted(os.listdir(f"{path}/{d}")) == f for d, f in first.items() if d != "event_date=2025-01-10")
    assert sinks.purge_events(spark, path, AS_OF) == [] and _ids(spark, path) == want


def test_a_border_without_later_rows_goes_as_well(spark, events, tmp_path):
    path = str(tmp_path / "events")
    sinks.append_events(events.where("event_id <> 239"), path)
    sinks.purge_events(spark, path, datetime(2025, 4, 10, 23, 30))
    assert _ids(spark, path) == list(range(240, 480)) and "event_date=2025-01-10" not in os.listdir(path)
