"""Category codes and name masking from distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import fresh_path
from ..sources.tables import layer


def category_table(df: DataFrame, columns) -> DataFrame:
    """(column_name, value, code): 0-based position of each distinct text in sorted order.

    All columns are read in one pass. The distinct values are range-sorted by bounds that
    Spark draws from them, so a shared prefix or a large column is many pieces, and written
    once; a piece's start is the number of values in the pieces before it.
    """
    spark = df.sparkSession
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in columns])
    values = df.select(F.inline(pairs)).filter("value is not null").distinct()
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = values.repartitionByRange(pieces, "column_name", "value").sortWithinPartitions("column_name", "value")
    laid = layer(laid.withColumn("_at", F.monotonically_increasing_id()), fresh_path(spark, "codes") + ".parquet")
    laid = laid.withColumn("_piece", F.shiftright("_at", 33))
    # One row for each column and piece.
    before = W.partitionBy("column_name").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    starts = laid.groupBy("column_name", "_piece").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    starts = starts.select("column_name", "_piece", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    coded = laid.join(starts, ["column_name", "_piece"]).select(
        "column_name", "value", (F.col("_start") + F.col("_at") - F.col("_first")).cast("int").alias("code"))
    return layer(coded, fresh_path(spark, "codes") + ".parquet")


def encode_categories(df: DataFrame, outputs: dict[str, str], table: DataFrame | None = None, unknown: int = -1) -> DataFrame:
    """Add a code column per text column; null and unseen values give ``unknown``.

    Pass a fitted ``table`` to encode new data, or when ``df`` is costly to read twice.
    Spark broadcasts the per-column part while it is small.
    """
    table = category_table(df, list(outputs)) if table is None else table
    out = df
    for i, (column, name) in enumerate(outputs.items()):
        part = table.filter(F.col("column_name") == column).select(F.col("value").alias(f"_v{i}"), F.col("code").alias(f"_c{i}"))
        out = out.join(part, F.col(column) == F.col(f"_v{i}"), "left").withColumn(
            name, F.coalesce(f"_c{i}", F.lit(unknown))).drop(f"_v{i}", f"_c{i}")
    return out


def letters(n: Column) -> Column:
    """A to Z, then AA, AB and so on, for 0, 1 and so on: another text for every number."""
    rest, out = n.cast("bigint"), F.lit("")
    for _ in range(7):  # 26 ** 7 is beyond any int
        out = F.when(rest >= 0, F.concat(F.char(rest % 26 + 65), out)).otherwise(out)
        rest = F.floor(rest / 26) - 1
    return out


def mask_names(df: DataFrame, column: str, prefix: str = "County ") -> DataFrame:
    """Replace the n-th name by ``prefix`` and the n-th label of ``letters``; null stays null."""
    coded = encode_categories(df, {column: "_code"})
    masked = F.when(F.col("_code") >= 0, F.concat(F.lit(prefix), letters(F.col("_code"))))
    return coded.select(*[masked.alias(c) if c == column else F.col(c) for c in df.columns])
