from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from siftwell.operators.moments import normalise_moments, zone_intervals

ORIGINS = [("ny", "America/New_York", "mdy"), ("be", "Europe/Berlin", "dmy"), ("sy", "Australia/Sydney", "dmy"), ("ut", "UTC", "mdy")]


def run(spark, rows, extra=False):
    df = spark.createDataFrame([(i, o, t) for i, (o, t) in enumerate(rows)], "id bigint, origin string, created_at string")
    if extra:
        df = df.withColumn("utc_micros", F.lit("x")).withColumn("field", F.lit(1)).withColumn("zone_name", F.lit("q"))
    origins = spark.createDataFrame(ORIGINS, "origin string, zone_name string, slash_order string")
    return {r["id"]: r for r in normalise_moments(df, origins, fields=("created_at",)).collect()}


def micros(text):
    return int(datetime.fromisoformat(text).replace(tzinfo=UTC).timestamp() * 1_000_000)


CASES = [
    ("ny", "2024-07-01T10:00:00Z", "2024-07-01 10:00:00"), ("ny", "2024-07-01 10:00", "2024-07-01 14:00:00"), ("be", "2024-07-01", "2024-06-30 22:00:00"), ("be", "3/4/2024 5:06", "2024-04-03 03:06:00"),
    ("ny", "3/4/2024 5:06 PM", "2024-03-04 22:06:00"), ("ny", "12/5/24 12:00 am", "2024-12-05 05:00:00"), ("ny", "03.04.2024 05:06", "2024-04-03 09:06:00"), ("be", "16. März 2023 10:14", "2023-03-16 09:14:00"),
    ("ut", "21-Nov-2024 12:32", "2024-11-21 12:32:00"), ("ut", "Mon, 10 Feb 2025 15:41:36 +0800", "2025-02-10 07:41:36"), ("ut", "Jan 20, 2025 5:25 PM", "2025-01-20 17:25:00"), ("ny", "2025-01-17 16:05 EDT", "2025-01-17 20:05:00"),
    ("ut", "2024-10-24T17:39:49[America/New_York]", "2024-10-24 21:39:49"), ("ut", "2024-07-17 13:18:38 America/New_York", "2024-07-17 17:18:38"), ("ny", "1700000000", "2023-11-14 22:13:20"), ("ny", "1700000000123", "2023-11-14 22:13:20.123"),
    ("ny", "20260222T000255Z", "2026-02-22 00:02:55"), ("ny", "\t2024-01-02T03:04:05.678+05:30 ", "2024-01-01 21:34:05.678"),
    ("be", "2023-10-29 02:36:00", "2023-10-29 00:36:00"), ("be", "2024-03-31 02:30", "2024-03-31 01:30:00"), ("ny", "2024-03-10 02:39", "2024-03-10 07:39:00"), ("sy", "2024-04-07 02:54:15", "2024-04-06 15:54:15"),
    ("zz", "2024-01-01 00:00", "2024-01-01 00:00:00"), (None, "2024-01-01 00:00", "2024-01-01 00:00:00"),
]
NOT = ["", " ", None, "n/a", "soon", "2025-02-30", "31/31/2024", "0000-00-00", "2024-13-04", "13:00", "2024-01-01 25:00", "x" * 5000]


def test_layouts(spark):
    got = run(spark, [(o, t) for o, t, _ in CASES] + [("ny", t) for t in NOT], extra=True)
    for i, (_, text, want) in enumerate(CASES):
        assert i in got, text
        assert got[i]["utc_micros"] == micros(want), text
    assert set(got) == set(range(len(CASES)))


def test_how_found(spark):
    got = run(spark, [("be", "2023-10-29 02:36"), ("be", "2024-03-31 02:30"), ("be", "2024-05-01 02:30"), ("be", "2024-05-01T02:30Z")])
    assert [got[i]["how_found"] for i in range(4)] == ["ambiguous", "nonexistent", "direct", "stated"]


def test_repeated_and_empty(spark):
    origins = spark.createDataFrame([*ORIGINS, ORIGINS[0]], "origin string, zone_name string, slash_order string")
    df = spark.createDataFrame([(1, "ny", "2024-01-01")] * 2, "id bigint, origin string, created_at string")
    assert normalise_moments(df, origins, fields=("created_at",)).count() == 2
    assert normalise_moments(df.limit(0), origins, fields=("created_at",)).count() == 0
    assert normalise_moments(df, origins.limit(0), fields=("created_at",)).first()["utc_micros"] == micros("2024-01-01 00:00:00")


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/Berlin", "Asia/Kolkata", "Australia/Lord_Howe"])
def test_against_zoneinfo(spark, zone):
    """Every 37 hours of some years, and around each change: the same as the standard library's fold=0."""
    z, texts = ZoneInfo(zone), []
    at = datetime(2022, 1, 1)
    while at < datetime(2025, 1, 1):
        texts.append(at)
        at += timedelta(hours=37, minutes=11)
    for _, hi, off in dict(zone_intervals([zone]))[zone]:
        change = datetime(1970, 1, 1) + timedelta(seconds=hi + off)
        if 2022 <= change.year <= 2024:
            texts += [change + timedelta(minutes=m) for m in (-61, -31, -1, 0, 1, 29, 31, 59, 61)]
    df = spark.createDataFrame([(i, "o", t.strftime("%Y-%m-%d %H:%M")) for i, t in enumerate(texts)], "id bigint, origin string, created_at string")
    origins = spark.createDataFrame([("o", zone, "mdy")], "origin string, zone_name string, slash_order string")
    got = {r["id"]: r["utc_micros"] for r in normalise_moments(df, origins, fields=("created_at",)).collect()}
    for i, t in enumerate(texts):
        want = t.replace(second=0, tzinfo=z, fold=0).astimezone(UTC)
        assert got[i] == int(want.timestamp()) * 1_000_000, (zone, t)


def test_length_does_not_matter(spark):
    texts = [" " * 200 + "2024-05-01 10:00" + "\n" * 100, "x" * 5000, " " * 500]
    df = spark.createDataFrame([(i, "o", t) for i, t in enumerate(texts)], "id bigint, origin string, created_at string")
    origins = spark.createDataFrame([("o", "UTC", "mdy")], "origin string, zone_name string, slash_order string")
    assert [(r["id"], r["utc_micros"]) for r in normalise_moments(df, origins, fields=("created_at",)).collect()] == [(0, 1714557600000000)]
