"""Dose-schedule scores. A schedule is a list of (column, minimum age)."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CORE_SCHEDULE_MONTHS, MALARIA_SCHEDULE_MONTHS, SCHEDULE_DAYS, VITAMIN_A_SCHEDULE_MONTHS
from .numbers import clip, to_number, total


def expected_doses(age: Column, schedule=CORE_SCHEDULE_MONTHS) -> Column:
    """Doses due by this age; 0 for an unknown age."""
    per_age = Counter(low for _, low in schedule)
    reached = total((age >= low).cast("int") * n for low, n in sorted(per_age.items()))
    return F.coalesce(reached, F.lit(0))


def expected_doses_with_region(age: Column, endemic: Column) -> Column:
    """Core doses, plus the malaria doses in an endemic region."""
    extra = F.when(endemic, expected_doses(age, MALARIA_SCHEDULE_MONTHS)).otherwise(0)
    return expected_doses(age) + extra


def flag_or_zero(c: Column) -> Column:
    return F.coalesce(to_number(c), F.lit(0.0))


def clean_doses(df: DataFrame, names) -> DataFrame:
    """The dose flags the table has as 0.0/1.0, null as not received."""
    return df.withColumns({n: flag_or_zero(F.col(n)) for n in names if n in df.columns})


def received_doses(df: DataFrame, names) -> Column:
    """Sum of the cleaned dose flags the table has."""
    present = [F.col(n) for n in names if n in df.columns]
    return total(present) if present else F.lit(0.0)


def completeness(received: Column, expected: Column) -> Column:
    return clip(F.when(expected > 0, received / expected), 0, 1)


def vitamin_a_completeness(df: DataFrame, age: Column) -> Column:
    """Age-eligible vitamin A doses received over doses due."""
    parts = [
        F.when(age >= low, flag_or_zero(F.col(name))).otherwise(0.0)
        for name, low in VITAMIN_A_SCHEDULE_MONTHS if name in df.columns
    ]
    received = total(parts) if parts else F.lit(0.0)
    return completeness(received, expected_doses(age, VITAMIN_A_SCHEDULE_MONTHS))


def series_complete(df: DataFrame, names) -> Column:
    """1.0 when the present cleaned flags of the series add up to their number."""
    present = [n for n in names if n in df.columns]
    return (received_doses(df, present) == float(len(present))).cast("double")


def booster_gap(first: Column, second: Column, age: Column, min_age: int = 20) -> Column:
    test = (first == 1) & (second == 0) & (age >= min_age)
    return F.coalesce(test, F.lit(False)).cast("double")


def expected_names(age_days: Column, schedule=SCHEDULE_DAYS) -> Column:
    """Names of the doses due at this age in days, in schedule order."""
    names = F.array(*[F.when(age_days >= low, F.lit(name)) for name, low in schedule])
    return F.array_compact(names)


def due_names(df: DataFrame, age_days: Column, schedule=SCHEDULE_DAYS) -> Column:
    """Names of doses due by age and not received; an absent flag column is not received."""
    items = []
    for name, low in schedule:
        missing = F.coalesce(F.col(name) != 1, F.lit(True)) if name in df.columns else F.lit(True)
        items.append(F.when((age_days >= low) & missing, F.lit(name)))
    return F.array_compact(F.array(*items))


def schedule_labels(df: DataFrame, age_days: str = "age_days", schedule=SCHEDULE_DAYS) -> DataFrame:
    """Due list, counts and the three labels of the child-month table."""
    age = F.col(age_days)
    due = F.col("_due")
    flag = lambda name: F.col(name) if name in df.columns else F.lit(0)
    return (
        df.withColumn("_due", due_names(df, age, schedule))
        .withColumn("_expected", F.size(expected_names(age, schedule)))
        .select(
            *df.columns,
            F.array_join(due, ";").alias("due_vaccines_rebuilt"),
            (F.col("_expected") - F.size(due)).alias("num_received_vaccines"),
            F.size(due).alias("num_due_vaccines_rebuilt"),
            F.size(due).alias("num_overdue_vaccines"),
            (F.size(due) > 0).cast("int").alias("default_30d"),
            (F.size(due) == 0).cast("int").alias("fully_immunized_for_age_gap"),
            F.coalesce((flag("has_penta_1") == 1) & (flag("has_penta_3") == 0), F.lit(False))
            .cast("int").alias("dropout_risk"),
        )
    )
