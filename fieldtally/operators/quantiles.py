"""Counts per value, exact quantiles and most frequent values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scan import range_pieces


def value_counts(df: DataFrame, value: str, groups=()) -> DataFrame:
    """Rows per (group, value), nulls dropped: the compact form all order statistics start from."""
    return df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("n"))


def exact_quantiles(df: DataFrame, value: str, shares, groups=(), out: str = "quantiles") -> DataFrame:
    """Linear-interpolated quantiles per group as ``array<double>``, in the order of ``shares``.

    Unlike the built-in ``percentile``, which keeps every distinct value of a group in
    one buffer, this selects by counts: the totals of cells tell which one holds each wanted
    rank, and only rows of those cells are looked at.
    """
    return quantiles_from_counts(value_counts(df, value, groups), value, shares, groups, out)


CELL_BITS = 16  # a cell of the search for ranks has 2^16 rows at most


def ranked_cells(counts: DataFrame, value: str, groups=()) -> DataFrame:
    """The counts range-sorted by group and value, with ``_at`` in that order and ``_cell``,
    a run of at most 2^CELL_BITS rows. So a cell does not grow with the table, as a piece does."""
    laid = range_pieces(counts, [F.col(value).asc()], groups)
    return laid.drop("_piece").withColumn("_cell", F.shiftright("_at", CELL_BITS))


def quantiles_from_counts(counts: DataFrame, value: str, shares, groups=(), out: str = "quantiles") -> DataFrame:
    """``exact_quantiles`` for a table of (groups, value, n).

    The counts are range-sorted by group and value, so every group, wherever its values
    lie, is cut where its own values are. ``cells`` holds one row per group and cell,
    ``wanted`` one per group, share and cell that has one of the share's two neighbouring
    ranks. Only the values of wanted cells are added up one by one.
    """
    groups = list(groups)
    keys = [*groups, "_cell"]
    match = F.expr(" AND ".join(f"`{k}` <=> `_r_{k}`" for k in keys))
    counts = ranked_cells(counts, value, groups)
    run = W.partitionBy(*groups).orderBy("_cell").rowsBetween(W.unboundedPreceding, W.currentRow)
    cells = counts.groupBy(*keys).agg(F.sum("n").alias("_cn"))
    cells = cells.select("*", F.sum("_cn").over(run).alias("_upto"), F.sum("_cn").over(W.partitionBy(*groups)).alias("_total"))
    listed = ", ".join(f"double('{s}')" for s in shares)
    wanted = (
        cells.selectExpr("*", f"posexplode(array({listed})) AS (_i, _share)")
        .selectExpr(*[f"`{k}` AS `_r_{k}`" for k in keys], "_i", "_upto", "_upto - _cn AS _from",
                    "floor((_total - 1) * _share) AS _lo", "ceil((_total - 1) * _share) AS _hi",
                    "(_total - 1) * _share - floor((_total - 1) * _share) AS _w")
        .filter("(_lo >= _from AND _lo < _upto) OR (_hi >= _from AND _hi < _upto)")
    )
    inner = W.partitionBy(*keys).orderBy("_at").rowsBetween(W.unboundedPreceding, W.currentRow)
    near = counts.join(wanted.select(*[f"_r_{k}" for k in keys]), match, "left_semi").select("*", F.sum("n").over(inner).alias("_cum"))
    hit = near.join(wanted, match).selectExpr(
        *groups, "_i", "_w",
        f"CASE WHEN _lo >= _from + _cum - n AND _lo < _from + _cum THEN double(`{value}`) END AS _a",
        f"CASE WHEN _hi >= _from + _cum - n AND _hi < _from + _cum THEN double(`{value}`) END AS _b")
    pick = lambda i, c: f"max(CASE WHEN _i = {i} THEN {c} END)"
    mixed = [f"{pick(i, '_a')} + ({pick(i, '_b')} - {pick(i, '_a')}) * {pick(i, '_w')}" for i in range(len(shares))]
    # One short array per group: len(shares) entries.
    return hit.groupBy(*groups).agg(F.expr(f"array({', '.join(mixed)})").alias(out))


def most_frequent(df: DataFrame, value: str, groups=(), out: str = "mode") -> DataFrame:
    """Most frequent value per group, the smallest on ties; counted before it is compared."""
    counts = value_counts(df, value, groups)
    best = F.min_by(F.col(value), F.struct(-F.col("n"), F.col(value)))
    return counts.groupBy(*groups).agg(best.alias(out))


def exact_median(df: DataFrame, value: str, groups=(), out: str = "median") -> DataFrame:
    q = exact_quantiles(df, value, [0.5], groups, "_q")
    return q.select(*groups, F.col("_q")[0].alias(out))
