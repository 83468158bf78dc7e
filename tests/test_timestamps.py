import datetime as dt
import zoneinfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlspike.functions.timestamps import with_instant


def us(*a, tz="UTC"):
    return round(dt.datetime(*a, tzinfo=zoneinfo.ZoneInfo(tz)).timestamp() * 1_000_000)


NY = "America/New_York"
CASES = [
    ("2024-05-06T07:08:09Z", NY, us(2024, 5, 6, 7, 8, 9)),
    ("2024-05-06t07:08:09z", NY, us(2024, 5, 6, 7, 8, 9)),
    (" \t2024-05-06T07:08:09Z\n", NY, us(2024, 5, 6, 7, 8, 9)),
    (chr(160) + "2024-05-06T07:08:09Z" + chr(0x2003), NY, us(2024, 5, 6, 7, 8, 9)),
    ("2024-05-06T07:08:09.123456789+05:30", NY, us(2024, 5, 6, 1, 38, 9) + 123456),
    ("2024-05-06 07:08", NY, us(2024, 5, 6, 7, 8, tz=NY)),
    ("2024-05-06T07:08:09-04", "UTC", us(2024, 5, 6, 11, 8, 9)),
    ("2024-05-06T07:08:09-04:00[America/New_York]", "UTC", us(2024, 5, 6, 11, 8, 9)),
    ("2024-05-06T07:08:09-05:00[America/New_York]", "UTC", None),
    ("2024-05-06 07:08:09.5 -0400 EDT", "UTC", us(2024, 5, 6, 11, 8, 9) + 500000),
    ("2024-05-06 07:08:09.5 -0400 EST", "UTC", None),
    ("2024-05-06 07:08:09 Asia/Kolkata", "UTC", us(2024, 5, 6, 1, 38, 9)),
    ("2024-05-06 07:08:09 Nowhere/Land", "UTC", None),
    ("20240506T070809Z", NY, us(2024, 5, 6, 7, 8, 9)),
    ("2024/05/06 07:08:09", "UTC", us(2024, 5, 6, 7, 8, 9)),
    ("25/05/2024 07:08:09", "UTC", us(2024, 5, 25, 7, 8, 9)),
    ("05/25/2024 07:08:09", "UTC", us(2024, 5, 25, 7, 8, 9)),
    ("05/06/2024 07:08:09", "UTC", None),
    ("06/06/2024 07:08:09", "UTC", us(2024, 6, 6, 7, 8, 9)),
    ("Mon, 06 May 2024 07:08:09 GMT", NY, us(2024, 5, 6, 7, 8, 9)),
    ("Tue, 06 May 2024 07:08:09 GMT", NY, None),
    ("Monday, 06-May-24 07:08:09 GMT", NY, us(2024, 5, 6, 7, 8, 9)),
    ("Mon May  6 07:08:09 2024", "UTC", us(2024, 5, 6, 7, 8, 9)),
    ("May 6, 2024, 12:08 am", "UTC", us(2024, 5, 6, 0, 8)),
    ("May 6, 2024 12:08:09 PM CEST", "UTC", us(2024, 5, 6, 10, 8, 9)),
    ("May 6, 2024, 13:08 am", "UTC", None),
    ("1715000000", NY, 1715000000 * 1_000_000),
    ("1715000000.25", NY, 1715000000 * 1_000_000 + 250000),
    ("1715000000123", NY, 1715000000123 * 1000),
    ("1715000000123456", NY, 1715000000123456),
    ("2024-11-03T01:30:00", NY, None),
    ("2024-03-10T02:30:00", NY, None),
    ("2024-11-03T01:30:00", "UTC", us(2024, 11, 3, 1, 30)),
    ("0001-01-01T00:00:00Z", NY, None),
    ("2024-02-30T00:00:00Z", NY, None),
    ("2024-05-06T24:00:00Z", NY, None),
    ("2024-05-06", NY, None),
    ("pending", NY, None),
    ("", NY, None),
    (None, NY, None),
    ("2024-05-06 07:08:09", None, None),
    ("x" * 20000, NY, None),
]


def test_cascade(spark):
    rows = [(i, t, z) for i, (t, z, _) in enumerate(CASES)]
    got = {r["i"]: r["out"] for r in with_instant(spark.createDataFrame(rows, "i int, t string, z string"), "t", "out", "z").collect()}
    assert got == {i: c[2] for i, c in enumerate(CASES)}


def test_policies(spark):
    rows = spark.createDataFrame([("2024-11-03T01:30:00",), ("2024-03-10T02:30:00",), ("05/06/2024 00:00:00",)], "t string").withColumn("z", F.lit(NY))

    def run(**kw):
        return [r["o"] for r in with_instant(rows, "t", "o", "z", **kw).collect()]

    fold = us(2024, 11, 3, 1, 30, tz=NY)
    assert run(ambiguous="earlier")[0] == fold
    assert run(ambiguous="later")[0] == fold + 3_600_000_000
    assert run(nonexistent="forward")[1] == us(2024, 3, 10, 7, 30)
    assert run(date_order="day_first")[2] == us(2024, 6, 5, tz=NY)
    assert run(date_order="month_first")[2] == us(2024, 5, 6, tz=NY)
    with pytest.raises(ValueError):
        run(ambiguous="both")


def test_empty_and_clashing_columns(spark):
    d = spark.createDataFrame([], "t string, z string, out int, `a.b` int")
    assert with_instant(d, "t", "out", "z").collect() == []
    d = spark.createDataFrame([("1715000000", 5, 6)], "t string, out int, `a.b` int")
    assert with_instant(d.union(d), "t", "out").select("out", "`a.b`").collect() == [(1715000000000000, 6)] * 2


@settings(max_examples=1, deadline=None)
@given(st.lists(st.datetimes(dt.datetime(1990, 1, 1), dt.datetime(2035, 1, 1)), min_size=300, max_size=300))
def test_round_trip_in_zones(spark, times):
    zones = ["Europe/Berlin", "Australia/Sydney", NY, "Asia/Kolkata"]
    rows, want = [], {}
    for i, t in enumerate(times):
        t = t.replace(tzinfo=dt.UTC)
        rows.append((i, t.astimezone(zoneinfo.ZoneInfo(zones[i % 4])).isoformat(), zones[i % 4]))
        want[i] = (t - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(microseconds=1)
    got = with_instant(spark.createDataFrame(rows, "i int, t string, z string"), "t", "o", "z").collect()
    assert {r["i"]: r["o"] for r in got} == want
