"""Dates in questions and documents."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
#: Date forms, tried in this order.
FORMATS = ["yyyy-MM-dd", "d-M-yyyy", "d/M/yyyy", "M/d/yyyy", "d-MMM-yyyy", "d MMM yyyy", "MMM d, yyyy"]


def parse_date(c: Column) -> Column:
    """The first of seven forms that fits; null when none does."""
    s = F.trim(c)
    return F.coalesce(*[F.try_to_date(s, f) for f in FORMATS])


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("date").alias("start"), end.cast("date").alias("end"))


def _months(first: Column, n: int) -> Column:
    """``n`` whole months from the day ``first``."""
    return _span(first, F.date_sub(F.add_months(first, n), 1))


def _year(digits: Column) -> Column:
    """A year of two or four digits, of this century."""
    return (F.lit(2000) + F.right(digits, F.lit(2)).try_cast("int")).cast("int")


#: Days of a unit in "last 3 weeks".
UNITS = {"day": 1, "week": 7, "month": 30}


def parse_date_range(c: Column, today: Column) -> Column:
    """struct<start, end> of the first of these that a text names, both ends included; null without.

    last N days, weeks or months (of 30 days); last month; last year; this or last quarter;
    Qn YYYY; Qn FYyy or FYyyyy, the year from April; Month YYYY (of several the earliest month).
    Years are of this century.
    """
    s, today = F.lower(F.coalesce(c, F.lit(""))), today.cast("date")
    month, quarter, year = (F.trunc(today, unit) for unit in ("month", "quarter", "year"))
    found = []

    ago = F.regexp_extract_all(s, F.lit(r"last\s+\d{1,3}\s*(?:day|week|month)"), F.lit(0))
    ago = F.get(ago, F.lit(0))
    days = F.regexp_substr(ago, F.lit(r"\d+")).try_cast("int")
    unit = F.regexp_substr(ago, F.lit("[a-z]+$"))
    for name, n in UNITS.items():
        found.append((F.endswith(unit, F.lit(name)), _span(F.date_sub(today, days * n), today)))

    found.append((s.contains("last month"), _months(F.add_months(month, -1), 1)))
    found.append((s.contains("last year"), _months(F.add_months(year, -12), 12)))
    found.append((s.contains("this quarter"), _months(quarter, 3)))
    found.append((s.contains("last quarter"), _months(F.add_months(quarter, -3), 3)))

    for shape, first_month in ((r"\bq[1-4]\s*20\d\d\b", 1), (r"\bq[1-4]\s*fy\s*(?:20)?\d\d\b", 4)):
        named = F.regexp_substr(s, F.lit(shape))
        start = F.make_date(_year(named), F.lit(first_month), F.lit(1))
        nth = F.substring(named, 2, 1).try_cast("int")
        found.append((named.isNotNull(), _months(F.add_months(start, 3 * (nth - 1)), 3)))

    names = F.array(*map(F.lit, MONTHS))
    named = F.regexp_extract_all(s, F.lit(rf"(?:{'|'.join(MONTHS)})\s+20\d\d"), F.lit(0))
    dated = F.transform(named, lambda x, i: F.struct(F.array_position(names, F.regexp_substr(x, F.lit("^[a-z]+"))).cast("int").alias("month"), i.alias("place"), _year(x).alias("year")))
    first = F.array_min(dated)
    found.append((first.isNotNull(), _months(F.make_date(first["year"], first["month"], F.lit(1)), 1)))

    out = F.lit(None)
    for test, span in reversed(found):
        out = F.when(test, span).otherwise(out)
    return out
