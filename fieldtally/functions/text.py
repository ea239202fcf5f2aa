"""Text, flag and name columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import COUNTIES, FALSE_WORDS, TRUE_WORDS


def clean_text(c: Column, lower: bool = False) -> Column:
    trimmed = F.trim(c.cast("string"))
    return F.lower(trimmed) if lower else trimmed


def yes_no(c: Column) -> Column:
    """1 for yes, 0 for no, null for anything else."""
    word = clean_text(c, lower=True)
    return F.when(word == "yes", 1).when(word == "no", 0)


def loose_boolean(c: Column) -> Column:
    """1/0 for the usual spellings of true and false, null for anything else."""
    word = clean_text(c, lower=True)
    return F.when(word.isin(*TRUE_WORDS), 1).when(word.isin(*FALSE_WORDS), 0)


def mixed_flag(c: Column) -> Column:
    """1/0 for yes/no and true/false in any case, or 1/0; null otherwise."""
    word = F.lower(c.cast("string"))
    return F.when(word.isin("true", "yes", "1"), 1).when(word.isin("false", "no", "0"), 0)


def sex_flag(c: Column) -> Column:
    word = F.lower(c)
    return F.when(word.isin("male", "m"), 1).when(word.isin("female", "f"), 0)


def sex_text(c: Column) -> Column:
    word = clean_text(c, lower=True)
    return F.when(word == "m", "male").when(word == "f", "female").otherwise(word)


def known_name(c: Column, names=COUNTIES) -> Column:
    """The lower-case name when it is on the list, else null (S22: null stays null)."""
    word = clean_text(c, lower=True)
    return F.when(word.isin(*names), word)


def known_name_flag(c: Column, names=COUNTIES) -> Column:
    return F.coalesce(clean_text(c, lower=True).isin(*names), F.lit(False)).cast("int")


def snake_case(name: str) -> str:
    """The runs of ASCII letters and digits of the lower-case name, joined by ``_``."""
    return "_".join(re.findall("[a-z0-9]+", name.lower()))


def snake_case_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake_case(name) for name in df.columns])


def trim_strings(df: DataFrame) -> DataFrame:
    """Trim every string column in one projection."""
    return df.select(*[
        F.trim(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in df.schema.fields
    ])


def first_present(df: DataFrame, *names: str) -> str | None:
    """The first of these columns that the table has; decided while planning."""
    return next((name for name in names if name in df.columns), None)


def json_map(c: Column) -> Column:
    """A JSON object as map<string,string>; an empty map for anything else."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    parsed = F.from_json(c, "map<string,string>")
    return F.when(F.startswith(F.trim(c), F.lit("{")), F.coalesce(parsed, empty)).otherwise(empty)
