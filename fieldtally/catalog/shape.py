"""Small helpers that give query results a plain, comparable shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of decimals, without a negative zero."""
    return df.select(*[
        (F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields])


def ts_text(c) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def as_of() -> Column:
    return F.to_timestamp(F.lit("2002-01-01 00:00:00"))


def as_of_events() -> Column:
    return F.to_timestamp(F.lit("2024-03-01 00:00:00"))
