"""Covered time and capture instants: brute force and defined cases."""

import datetime as dt
import random
import zoneinfo

from pyspark.sql import functions as F

from framelode.operators.coverage import covered_periods, to_ms
from framelode.operators.instants import asset_instants, utc_millis


def brute(rows):
    out = set()
    for k in {r[0] for r in rows if r[0] is not None}:
        spans = sorted((s, e) for a, s, e in rows if a == k and s is not None and e is not None and e > s)
        now = None
        for s, e in spans:
            if now and s <= now[1]:
                now[1] = max(now[1], e)
            else:
                if now:
                    out |= {(k, "period", *now), (k, "gap", now[1], s)}
                now = [s, e]
        if now:
            out.add((k, "period", *now))
    return out


def covered(spark, rows, **kw):
    df = spark.createDataFrame(rows, "k string, s long, e long, kind string, _b string")
    return {tuple(r) for r in covered_periods(df, ["k"], "s", "e", **kw).collect()}


def test_periods_against_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(3000):
        s = rnd.randrange(0, 40_000)
        rows.append(("hot" if rnd.random() < 0.4 else f"k{rnd.randrange(20)}", s, s + rnd.choice([-3, 0, 1, 5, 30, 300]), "x", "y"))
    rows += [(None, 1, 2, "x", "y"), ("k1", None, 5, "x", "y"), ("k1", 7, None, "x", "y"), ("long", 0, 30_000, "x", "y"), ("long", 100, 200, "x", "y"), ("long", 30_000, 30_010, "x", "y")]
    assert covered(spark, rows, bucket=500) == brute([r[:3] for r in rows])


def test_periods_empty(spark):
    assert covered(spark, []) == set()


def test_to_ms(spark):
    df = spark.createDataFrame([(1.0004,), (1.0006,), (None,), (float("nan"),)], "t double")
    assert [r[0] for r in df.select(to_ms("t")).collect()] == [1000, 1001, None, None]


CASES = [
    ("2024-03-01T00:00:00Z", "Asia/Seoul", "2024-03-01T00:00:00"),
    ("2024-03-01T09:00:00.1239+09:00", "Europe/Zurich", "2024-03-01T00:00:00.123"),
    ("2025:06:30 09:04:39", "Europe/Lisbon", "2025-06-30T08:04:39"),
    ("2024/11/28 22:01:11 GMT+9", "Asia/Seoul", "2024-11-28T13:01:11"),
    ("20260329_013341", "Asia/Tokyo", "2026-03-28T16:33:41"),
    ("20241119T122011Z", "Asia/Tokyo", "2024-11-19T12:20:11"),
    ("Tue, 02 Dec 2025 08:52:38 +0000", "Asia/Tokyo", "2025-12-02T08:52:38"),
    ("2025년 5월 26일 오후 6:26:04", "Pacific/Auckland", "2025-05-26T06:26:04"),
    ("2025년 5월 26일 오전 12:26:04", "Asia/Seoul", "2025-05-25T15:26:04"),
    ("Apr 4, 2024 1:15:51 AM", "Europe/Lisbon", "2024-04-04T00:15:51"),
    ("2026-06-05 15:51:06 WEST", "Europe/Lisbon", "2026-06-05T14:51:06"),
    ("13.08.2025 19:24:50", "Europe/Zurich", "2025-08-13T17:24:50"),
    ("19/06/2026 10:30:23", "Asia/Tokyo", "2026-06-19T01:30:23"),
    ("10/18/2025 03:48:17", "Asia/Tokyo", "2025-10-17T18:48:17"),
    ("05/05/2025 03:00:00", "Asia/Tokyo", "2025-05-04T18:00:00"),
    ("04/05/2025 03:00:00", "Asia/Tokyo", None),
    ("2024-04-16 19:48", "Asia/Kathmandu", "2024-04-16T14:03:00"),
    ("1724272018430", "Asia/Tokyo", "2024-08-21T20:26:58.430"),
    ("1728931580.000", "Asia/Tokyo", "2024-10-14T18:46:20"),
    ("3852942478", "Asia/Tokyo", "2026-02-03T05:47:58"),
    ("0", "Asia/Tokyo", None),
    ("12", "Asia/Tokyo", None),
    ("0000:00:00 00:00:00", "Asia/Tokyo", None),
    ("1970-01-01T00:00:00Z", "Asia/Tokyo", None),
    ("1904-01-01T00:00:00.000000Z", "Asia/Tokyo", None),
    ("2025-02-30 10:00:00", "Asia/Tokyo", None),
    ("2025-02-20 25:00:00", "Asia/Tokyo", None),
    ("2025-03-30 02:30:00", "Europe/Zurich", None),
    ("2025-10-26 02:30:00", "Europe/Zurich", None),
    ("2025-10-26 03:30:00", "Europe/Zurich", "2025-10-26T02:30:00"),
    ("2025-04-06 01:45:00", "Australia/Lord_Howe", None),
    ("2025-10-05 02:10:00", "Australia/Lord_Howe", None),
    ("n/a", "Asia/Tokyo", None),
    ("", "Asia/Tokyo", None),
    (None, "Asia/Tokyo", None),
    ("2025-05-05 10:00:00", None, None),
    ("2025-05-05 10:00:00Z", None, "2025-05-05T10:00:00"),
    ("2025-05-05 10:00:00 XYZ", "Asia/Tokyo", None),
]


def test_instants(spark):
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CASES)], "i int, t string, z string")
    got = {r[0]: r[1] for r in df.select("i", utc_millis(F.col("t"), F.col("z"))).collect()}
    for i, (text, zone, want) in enumerate(CASES):
        ms = None if want is None else round(dt.datetime.fromisoformat(want).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
        assert got[i] == ms, (text, zone, got[i], ms)


def test_local_times_against_zoneinfo(spark):
    """Clock times around every change of the zones, against the zone database of Python."""
    rnd = random.Random(3)
    rows = []
    for z in ["Europe/Zurich", "Europe/Lisbon", "America/Denver", "America/St_Johns", "Pacific/Auckland", "Australia/Lord_Howe", "Asia/Kathmandu"]:
        for day in ["2024-03-10", "2024-03-31", "2024-10-27", "2024-11-03", "2025-04-06", "2025-09-28", "2025-10-05", "2026-03-29", "2025-06-15"]:
            for _ in range(12):
                rows.append((f"{day} {rnd.randrange(0, 5):02d}:{rnd.randrange(60):02d}:00", z))
    df = spark.createDataFrame(rows, "t string, z string")
    got = {(r[0], r[1]): r[2] for r in df.select("t", "z", utc_millis(F.col("t"), F.col("z"))).collect()}
    for t, z in rows:
        wall, tz = dt.datetime.fromisoformat(t), zoneinfo.ZoneInfo(z)
        found = set()
        for fold in (0, 1):
            u = wall.replace(tzinfo=tz, fold=fold).astimezone(dt.timezone.utc)
            if u.astimezone(tz).replace(tzinfo=None) == wall:
                found.add(round(u.timestamp() * 1000))
        assert got[t, z] == (found.pop() if len(found) == 1 else None), (t, z)


def test_asset_instants_copies_and_empty(spark):
    a = spark.createDataFrame([("a", "T", "2025-05-05 10:00:00"), ("a", "T", "2025-05-05 10:00:00"), (None, "T", "2025-05-05 10:00:00"), ("b", "no", "2025-05-05 10:00:00")], "asset_id string, trip_id string, creation_time string")
    z = spark.createDataFrame([("T", "Asia/Tokyo")], "trip_id string, time_zone string")
    assert {tuple(r) for r in asset_instants(a, z).collect()} == {("a", 1746406800000), ("b", None)}
    assert asset_instants(a.limit(0), z).count() == 0
