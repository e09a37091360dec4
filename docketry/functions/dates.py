"""Dates: printed formats, calendar months, whole-month gaps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Printed date formats in the order they are tried; a pattern guards each, as parsers are laxer than the formats say.
STATEMENT_FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", "d MMMM yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
)


def try_date(text: Column, fmt: str) -> Column:
    return F.to_date(F.try_to_timestamp(text, F.lit(fmt)))


def parse_date(text: Column, formats=STATEMENT_FORMATS) -> Column:
    """The first format that fits; null for null, blank and unreadable texts. Month names in any letter case."""
    bare = F.initcap(F.trim(text))
    return F.coalesce(*(F.when(bare.rlike(pattern), try_date(bare, fmt)) for pattern, fmt in formats))


def parse_iso_or_dmy(text: Column) -> Column:
    """ISO, else day-month-year with dashes."""
    return parse_date(text, (STATEMENT_FORMATS[0], STATEMENT_FORMATS[5]))


def month_of(col: Column) -> Column:
    return F.trunc(col, "MM")


def month_key(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM")


def months_in_range(start: Column, end: Column) -> Column:
    """First days of all months from start's to end's, both included; empty when the end is in an earlier month."""
    return F.when(month_of(start) <= month_of(end), F.sequence(month_of(start), month_of(end), F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))


def whole_months(start: Column, end: Column) -> Column:
    """Whole calendar months from start to end, month ends clamped: 28 Feb to 31 Mar is one month (and three days)."""
    rough = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    return (rough - (F.add_months(start, rough) > end).cast("int")).cast("int")


def leftover_days(start: Column, end: Column) -> Column:
    return F.datediff(end, F.add_months(start, whole_months(start, end)))


def years_since(start: Column, as_of: Column) -> Column:
    """Calendar years between, never negative."""
    return F.greatest(F.lit(0), F.year(as_of) - F.year(start))


# Malay month names by the English ones, and the formats of printed dates in the order in which they are tried.
MALAY_MONTHS = {
    "januari": "january", "februari": "february", "mac": "march", "mei": "may", "jun": "june", "julai": "july", "ogos": "august", "oktober": "october", "disember": "december",
    "ogo": "aug", "okt": "oct", "dis": "dec",
}
PRINTED_FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2} [A-Za-z]{3,9} \d{4}$", "d MMMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^[A-Za-z]{3,9} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^[A-Za-z]{3,9} \d{4}$", "MMMM yyyy"),
    (r"^[A-Za-z]{3} \d{4}$", "MMM yyyy"),
)


def parse_printed_date(text: Column) -> Column:
    """Ten printed formats with English or Malay months; a month alone is its first day. Two-digit years from 69 are the last century's."""
    names = F.create_map(*[F.lit(x) for pair in MALAY_MONTHS.items() for x in pair])
    words = F.split(F.lower(F.regexp_replace(F.trim(text), r"[.,;]+$", "")), r"\s+")
    english = F.initcap(F.array_join(F.transform(words, lambda w: F.coalesce(names[w], w)), " "))
    short = F.when(english.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), try_date(english, "d/M/yy"))
    return F.coalesce(parse_date(english, PRINTED_FORMATS), F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short))
