"""Segmented scans: running values along an order that restart at each key.

All rows are range-sorted once by (keys, order), by bounds that Spark draws from the rows
themselves. So a hot key, rows without a time and a narrow range of values fall into many
pieces of about equal size, wherever they lie. A window adds up inside (key, piece); the
totals of a key's earlier pieces, a row per key and piece, are carried on top.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path
from .prefix import running_totals


def range_pieces(df: DataFrame, order, groups=(), deal=()) -> DataFrame:
    """The rows in order, with ``_piece`` and ``_at``, which grow along it within a group.

    They are written once, so all readers see the same pieces. Rows that are equal in all of
    ``groups`` and ``order`` stay in one piece; end the order with a key where such rows are
    many. Spark reads the rows twice, for the bounds and for the sort: ``deal`` names columns
    to shuffle them by before, so that the second read is of shuffle files and not of the
    source. Rows that come out of a shuffle need none.
    """
    spark = df.sparkSession
    by = [*[F.col(g).asc_nulls_first() for g in groups], *order]
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if deal:
        # The column keeps the two shuffles apart.
        df = df.repartition(pieces, *deal).withColumn("_dealt", F.spark_partition_id())
    laid = df.repartitionByRange(pieces, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    path = fresh_path(spark, "pieces")
    laid.write.parquet(path)
    return spark.read.schema(laid.schema).parquet(path).withColumn("_piece", F.shiftright("_at", 33).cast("int")).drop("_dealt")


def segmented_totals(df: DataFrame, sums, order, groups=(), deal=()) -> DataFrame:
    """Add ``cum_<s>``, the total of ``s`` up to and including each row, in ``order``."""
    laid = range_pieces(df, order, groups, deal)
    return running_totals(laid, sums, [F.col("_at").asc()], groups, cell="_piece").drop("_at", "_piece")


def segmented_rank(df: DataFrame, order, groups=(), out: str = "rank", deal=()) -> DataFrame:
    """Add the 1-based place of each row in its group's order."""
    ranked = segmented_totals(df.withColumn("_one", F.lit(1).cast("bigint")), ["_one"], order, groups, deal)
    return ranked.withColumn(out, F.col("cum__one")).drop("_one", "cum__one")
