"""Queries over whole tables: every row has a result, and dates in summer time equal a plain loop."""

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest

from spindrift.plans.binding import Tables
from spindrift.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
ZONE = ZoneInfo("Europe/Helsinki")


@pytest.mark.parametrize("name", ["key_allowlist", "json_merge", "date_coerce", "next_weekday_departure"])
def test_every_event(spark, name):
    t = Tables(spark, SF)
    assert QUERIES[name](t).select("event_id").distinct().count() == t.events.count()


def test_every_job(spark):
    t = Tables(spark, SF)
    assert QUERIES["source_inventory"](t).groupBy().sum("listings").first()[0] == t.job.count()


def test_dates_of_a_year(spark):
    at = [datetime(2024, 1, 1, 3, 30) + timedelta(hours=17 * k) for k in range(520)]
    t = Tables(spark, SF)
    t._made["events"] = spark.createDataFrame([(k, x) for k, x in enumerate(at)], "event_id long, ts timestamp_ntz")
    plain = lambda local: local.astimezone(UTC).replace(tzinfo=None)
    got = {r.event_id: r["at"] for r in QUERIES["date_coerce"](t).collect()}
    left = {r.event_id: r.leave for r in QUERIES["next_weekday_departure"](t).collect()}
    for k, x in enumerate(at):
        day = plain(datetime(x.year, x.month, x.day, tzinfo=ZONE))
        assert got[k] == (day if k % 4 == 0 else x if k % 4 == 1 else None), x
        local = x.replace(tzinfo=UTC).astimezone(ZONE)
        ahead = {4: 3, 5: 2}.get(local.weekday(), 1)
        morning = datetime(local.year, local.month, local.day, 8, tzinfo=None) + timedelta(days=ahead)
        assert left[k] == plain(morning.replace(tzinfo=ZONE)), x
