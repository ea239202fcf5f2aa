"""Repeatable splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .prefix import running_totals


def hash_bucket(keys, seed: int, buckets: int = 10000) -> Column:
    """A repeatable bucket from the row's key; no shuffle, the same on every run."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % buckets


def split_flag(keys, share: float, seed: int) -> Column:
    """True for the given share of rows. Independent of the label, so each class is split alike."""
    return hash_bucket(keys, seed) < int(round(share * 10000))


def stratified_split(df: DataFrame, keys, label: str, share: float, seed: int, out: str = "part") -> DataFrame:
    """``test`` for exactly round(share * n) rows of each class, ``train`` for the rest.

    Each class is cut at its own quantile of the key's hash, found from running counts of
    the hashes. Rows with equal keys stay together, so only such repeats move the cut.
    """
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    hashed = df.withColumn("_h", F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint"))
    counts = hashed.groupBy(label, "_h").agg(F.count("*").alias("_n"))
    run = running_totals(counts.withColumn("_cell", F.shiftright("_h", 48)), ["_n"], [F.col("_h").asc()], groups=[label])
    sizes = counts.groupBy(label).agg(F.sum("_n").alias("_size")).withColumnRenamed(label, "_class")
    inside = run.join(sizes, F.col(label).eqNullSafe(F.col("_class"))).filter(F.col("cum__n") <= F.round(F.col("_size") * F.lit(share)))
    cuts = inside.groupBy("_class").agg(F.max("_h").alias("_cut"))
    part = F.when(F.col("_h") <= F.col("_cut"), "test").otherwise("train")
    return hashed.join(cuts, F.col(label).eqNullSafe(F.col("_class")), "left").select(*df.columns, part.alias(out))


def class_shares(df: DataFrame, part: str, label: str) -> DataFrame:
    return df.groupBy(part).agg(F.count("*").alias("n"), F.sum(label).alias("positives"), F.avg(label).alias("positive_share"))


def month_roles(df: DataFrame, month: str, valid_months: int = 1, test_months: int = 1) -> DataFrame:
    """(month, split): the last months test, those before them validation, the rest train.

    Works on distinct months only. Too few months make the roles null; see ``temporal_split``.
    """
    months = df.select(month).filter(F.col(month).isNotNull()).distinct()
    back = F.row_number().over(W.orderBy(F.col(month).desc()))
    role = F.when(back <= test_months, "test").when(back <= test_months + valid_months, "valid").otherwise("train")
    enough = F.count("*").over(W.partitionBy()) >= valid_months + test_months + 1
    return months.select(month, F.when(enough, role).alias("split"))


def temporal_split(df: DataFrame, month: str, valid_months: int = 1, test_months: int = 1) -> DataFrame:
    """Rows with their split; rows without a month are left out. Fails when months are too few."""
    roles = month_roles(df, month, valid_months, test_months).select(F.col(month).alias("_m"), F.coalesce(
        "split", F.raise_error(F.lit("Need at least 3 distinct months for temporal split")).cast("string")).alias("split"))
    return df.join(roles, F.col(month) == F.col("_m")).drop("_m")


def in_months(df: DataFrame, month: str, months) -> DataFrame:
    return df.filter(F.col(month).isin(*months))
