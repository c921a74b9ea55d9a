import pytest

from skein.functions.instants import parse
from skein.operators import times

CASES = [
    ("2025-11-16T19:50:25+08:00", "UTC", True, False, "2025-11-16T11:50:25.000Z"),
    ("1772961710892", None, None, False, "2026-03-08T09:21:50.892Z"),
    ("1772961710892123", None, None, False, "2026-03-08T09:21:50.892Z"),
    ("1702452452.541", None, None, False, "2023-12-13T07:27:32.541Z"),
    ("2023-11-08T18:19:09.898789085Z", None, None, False, "2023-11-08T18:19:09.898Z"),
    ("20240114T153117Z", "Asia/Kolkata", None, False, "2024-01-14T15:31:17.000Z"),
    ("2025-07-07 14:34:02 [America/New_York]", "UTC", None, False, "2025-07-07T18:34:02.000Z"),
    ("2025-07-07 14:34:02 America/New_York", "UTC", None, False, "2025-07-07T18:34:02.000Z"),
    ("2024-09-05 18:34:42 EDT", "UTC", None, False, "2024-09-05T22:34:42.000Z"),
    ("2025-11-02 01:30:00", "America/New_York", None, False, "2025-11-02T05:30:00.000Z"),  # occurs twice: the first
    ("2025-03-09 02:30:00", "America/New_York", None, False, "2025-03-09T07:30:00.000Z"),  # skipped: offset before
    ("03/06/2025 00:36", "America/New_York", False, False, "2025-03-06T05:36:00.000Z"),
    ("03/06/2025 00:36", "Europe/Berlin", True, False, "2025-06-02T22:36:00.000Z"),
    ("11.12.2025 17:16:50", "Europe/Berlin", True, False, "2025-12-11T16:16:50.000Z"),
    ("Fri Feb 6 22:57:40 2026 +0530", None, None, False, "2026-02-06T17:27:40.000Z"),
    ("Sat, 23 May 2026 07:52:00 +0200", None, None, False, "2026-05-23T05:52:00.000Z"),
    ("Jan 11, 2024 3:09:13 PM", "UTC", None, False, "2024-01-11T15:09:13.000Z"),
    ("Apr 14, 2025 12:24:53 AM", "UTC", None, False, "2025-04-14T00:24:53.000Z"),
    ("2024年8月20日 02:30:54", "Asia/Shanghai", None, False, "2024-08-19T18:30:54.000Z"),
    ("2025-08-14T23:01:13-04:00", None, None, True, "2025-08-15"),
    ("9 May 2026", "UTC", None, True, "2026-05-09"),
    ("February 10, 2025", None, None, True, "2025-02-10"),
    ("20260212", None, None, True, "2026-02-12"),
    ("2026-2-9", None, None, True, "2026-02-09"),
    ("17/09/2025", None, None, True, "2025-09-17"),
]


@pytest.mark.parametrize("raw,zone,first,day,want", CASES)
def test_parse(raw, zone, first, day, want):
    assert parse(raw, zone, first, day) == want


@pytest.mark.parametrize("raw", [None, "", " ", "0", "-", "null", "unknown", "Invalid Date", "0000-00-00", "2025-02-30", "20251399", "2025-13-45T99:99:00Z", "yesterday", "TBD", "9" * 300, "1e999", "02/03/2025"])
def test_no_time(raw):
    assert parse(raw, "UTC", None, False) is None


def test_long_texts_are_read_whole():
    assert parse(" " * 500 + "2024-01-01T00:00:00Z" + " " * 500, None, None, False) == "2024-01-01T00:00:00.000Z"
    for text in ("x" * 10**6, "9" * 10**6, "2024-01-01 " * 10**5, "1 " * 10**5, "Jan " * 10**5):
        assert parse(text, "UTC", None, False) is None


def test_rows_survive_the_dictionary(spark, tmp_path):
    schema = "src string, raw string, zone string, day_first boolean, as_day boolean, norm2 string"
    rows = [("a", "2024-01-01T00:00:00Z", None, None, False, "x"), ("b", None, None, None, False, None), ("c", "2024-01-01T00:00:00Z", None, None, False, "x"), ("d", "?", "UTC", True, True, None)]
    path = str(tmp_path / "words")
    df = spark.createDataFrame(rows, schema)
    for _ in range(2):
        got = {r.src: r.norm for r in times.normalise(df, path).collect()}
        assert got == {"a": "2024-01-01T00:00:00.000Z", "b": None, "c": "2024-01-01T00:00:00.000Z", "d": None}
    assert spark.read.parquet(path).count() == 2
    assert times.normalise(df.limit(0), path).count() == 0
    grown = df.union(spark.createDataFrame([("e", "2024-02-01", "UTC", None, True, None)], schema))
    assert times.normalise(grown, path).count() == 5 and spark.read.parquet(path).count() == 3
