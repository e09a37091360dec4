"""Printed dates and month arithmetic."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from docketry.functions import dates

PRINTED = [
    ("2024-02-05", dt.date(2024, 2, 5)), ("5/2/2024", dt.date(2024, 2, 5)), ("05-02-2024", dt.date(2024, 2, 5)), ("5 Februari 2024", dt.date(2024, 2, 5)), ("5 Ogo 2024.", dt.date(2024, 8, 5)),
    ("march 5, 2024", dt.date(2024, 3, 5)), ("05.02.2024", dt.date(2024, 2, 5)), ("Disember 2023", dt.date(2023, 12, 1)), ("Mac 2023", dt.date(2023, 3, 1)), ("1/2/68", dt.date(2068, 2, 1)),
    ("1/2/69", dt.date(1969, 2, 1)), ("31/02/2024", None), ("not a date", None), ("", None), (None, None),
]


def test_printed_dates(spark):
    df = spark.createDataFrame([(t,) for t, _ in PRINTED], "t string").coalesce(1)
    assert [r[0] for r in df.select(dates.parse_printed_date(F.col("t"))).collect()] == [d for _, d in PRINTED]


def test_statement_dates(spark):
    cases = [("23 Jan 2026", dt.date(2026, 1, 23)), ("05/02/2026", dt.date(2026, 2, 5)), ("2026/1/3", dt.date(2026, 1, 3)), (" 3 january 2026 ", dt.date(2026, 1, 3)), ("2026-13-01", None), ("not a date", None)]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string").coalesce(1)
    assert [r[0] for r in df.select(dates.parse_date(F.col("t"))).collect()] == [d for _, d in cases]


def test_whole_months_clamp_month_ends(spark):
    cases = [((2025, 2, 28), (2025, 3, 31), 1, 3), ((2026, 1, 31), (2026, 6, 30), 5, 0), ((2024, 1, 31), (2024, 2, 29), 1, 0), ((2024, 3, 15), (2024, 3, 15), 0, 0)]
    df = spark.createDataFrame([(dt.date(*a), dt.date(*b)) for a, b, *_ in cases], "a date, b date").coalesce(1)
    got = df.select(dates.whole_months(F.col("a"), F.col("b")), dates.leftover_days(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [tuple(c[2:]) for c in cases]
