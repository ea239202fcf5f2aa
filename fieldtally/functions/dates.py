"""Timestamps, month keys and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import clip

# fixed values: English month abbreviations
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def parse_timestamp(c: Column) -> Column:
    """Timestamp, or null when the text is no date."""
    return c.try_cast("timestamp")


def month_key(ts: Column) -> Column:
    """``YYYY-MM``; null for a null timestamp."""
    return F.date_format(ts, "yyyy-MM")


def month_token(c: Column) -> Column:
    """``Feb25_2`` -> ``2025-02``. An unknown month gives ``00``, no match the trimmed text."""
    text = F.trim(c)
    # One match per row; where it holds, the places of name and year are fixed.
    name, year = F.lower(F.substring(text, 1, 3)), F.substring(text, 4, 2)
    number = F.lpad(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name).cast("string"), 2, "0")
    return F.when(text.rlike(r"^[A-Za-z]{3}\d{2}"), F.concat(F.lit("20"), year, F.lit("-"), number)).otherwise(text)


def months_since(ts: Column, as_of: Column) -> Column:
    """Whole elapsed days over 30.44, bounded to [0, 24]; as_of is explicit."""
    days = F.floor((F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(86_400_000_000))
    return clip(days / F.lit(30.44), 0, 24)


def age_months(days: Column) -> Column:
    """Days to months with one decimal, halves to even."""
    return F.rint(days / F.lit(30.4375) * 10) / 10


def age_agrees_flag(months: Column, rebuilt: Column) -> Column:
    return F.coalesce(F.abs(months - rebuilt) <= 1, F.lit(False)).cast("int")


def calendar_columns(ts: Column) -> list[Column]:
    return [
        F.month(ts).alias("index_month_num"),
        F.quarter(ts).alias("index_quarter"),
        F.year(ts).alias("index_year"),
    ]
