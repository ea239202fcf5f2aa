"""Schema and rule checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import FEATURE_GROUPS, FEATURES, INPUT_RANGES


def require_columns(df: DataFrame, required) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def keep_columns(df: DataFrame, allowed) -> DataFrame:
    """The allowed columns that exist, in the allowed order."""
    return df.select(*[c for c in allowed if c in df.columns])


def null_only(df: DataFrame, columns) -> list[str]:
    """Columns with no value at all: one aggregate, one row to the driver."""
    columns = list(columns)
    if not columns:
        return []
    row = df.agg(*[F.count(c).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[f"c{i}"] == 0]


def drop_null_only(df: DataFrame, columns) -> DataFrame:
    return df.drop(*null_only(df, [c for c in columns if c in df.columns]))


def select_features(df: DataFrame, keep=(), features=FEATURES) -> DataFrame:
    """The fixed feature order; absent ones become null doubles."""
    return df.select(*keep, *[
        F.col(f).cast("double").alias(f) if f in df.columns else F.lit(None).cast("double").alias(f) for f in features])


def usable_features(df: DataFrame) -> dict[str, list[str]]:
    """Numeric, binary and categorical features that have any value."""
    empty = set(null_only(df, [f for f in FEATURES if f in df.columns]))
    kinds: dict[str, list[str]] = {"numeric": [], "binary": [], "categorical": []}
    for group, names in FEATURE_GROUPS.items():
        kinds[group.rsplit("_", 1)[1]] += [n for n in names if n in df.columns and n not in empty]
    return kinds


def group_availability(df: DataFrame, groups=FEATURE_GROUPS) -> DataFrame:
    """Features defined and features with data, per group."""
    known = [f for names in groups.values() for f in names if f in df.columns]
    row = df.agg(*[F.count(f).alias(f) for f in known])
    items = []
    for g, names in groups.items():
        filled = sum(((F.col(n) > 0).cast("int") for n in names if n in known), F.lit(0))
        items.append(F.struct(F.lit(g).alias("feature_group"), F.lit(len(names)).alias("defined"), filled.alias("with_data")))
    return row.select(F.inline(F.array(*items)))


def rule_failures(df: DataFrame, ranges=INPUT_RANGES) -> DataFrame:
    """Add ``failed_rules``: the names of the columns outside their accepted range."""
    tests = []
    for name, (low, high) in ranges.items():
        if name not in df.columns:
            continue
        c = F.col(name)
        bad = (c < low) if high is None else (c < low) | (c > high)
        tests.append(F.when(bad, F.lit(name)))
    return df.withColumn("failed_rules", F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>"))


def rule_violations(df: DataFrame, ranges=INPUT_RANGES) -> DataFrame:
    """Rows that break each rule; rules without a violation are not listed."""
    return rule_failures(df, ranges).select(F.explode("failed_rules").alias("rule")).groupBy("rule").agg(
        F.count("*").alias("violations"))


def dataset_checks(df: DataFrame, key: str, target: str) -> DataFrame:
    """Target in {0,1}, unique key and positive rate, in one row.

    The key is reduced to one row per value first, so uniqueness needs no global set.
    """
    require_columns(df, [key, target])
    valid = F.coalesce(F.col(target).isin(0, 1), F.lit(False)).cast("int")
    per_key = df.groupBy(key).agg(F.count("*").alias("n"), F.sum(target).alias("p"), F.sum(1 - valid).alias("bad"))
    rate = F.col("positives") / F.col("n_rows")
    return per_key.agg(
        F.sum("n").alias("n_rows"), F.count(key).alias("n_keys"), F.sum("p").alias("positives"),
        F.sum("bad").alias("invalid_targets"), F.sum((F.col("n") > 1).cast("int")).alias("repeated_keys"),
    ).select(
        "*", rate.alias("positive_rate"), (F.col("repeated_keys") == 0).cast("int").alias("key_unique"),
        (F.col("invalid_targets") == 0).cast("int").alias("target_valid"),
        (~rate.between(0.02, 0.95)).cast("int").alias("odd_positive_rate"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
