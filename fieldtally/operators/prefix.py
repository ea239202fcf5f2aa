"""Running totals without a single-task sort.

Rows fall into cells that keep their order. Inside a cell a window adds up locally; the
cells' own totals, a small table, are added up on top. The largest piece any task sorts is
one cell of one group. Where no column cuts the rows evenly, ``scan`` lays the cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def whole_keys(df: DataFrame, keys) -> tuple[DataFrame, list[str]]:
    """Adds non-null stand-ins for ``keys`` (the value or a default, and whether it is
    null) and names them. A window and a join on them with ``=`` share one partitioning;
    ``<=>`` would shuffle the rows of the window once more."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    names, columns = [], {}
    for i, k in enumerate(keys):
        default = F.lit("") if isinstance(kinds[k], T.StringType) else F.lit("1970-01-01") if isinstance(kinds[k], (T.DateType, T.TimestampType)) else F.lit(0)
        columns[f"_z{i}"], columns[f"_n{i}"] = F.coalesce(F.col(k), default.cast(kinds[k])), F.col(k).isNull()
        names += [f"_z{i}", f"_n{i}"]
    return df.withColumns(columns), names


def running_totals(df: DataFrame, sums, order, groups=(), cell: str | list[str] = "_cell", cell_order: Column | list[Column] | None = None) -> DataFrame:
    """Add ``cum_<s>``, the total of ``s`` up to and including each row, in ``order``.

    ``cell`` names columns that never decrease (or, for a descending order, never
    increase) along ``order``; ``cell_order`` sorts the cells the same way. The rows are
    shuffled once, by group and cell.
    """
    groups, cells_by = list(groups), [cell] if isinstance(cell, str) else list(cell)
    cell_order = [F.col(c).asc_nulls_last() for c in cells_by] if cell_order is None else cell_order
    cell_order = cell_order if isinstance(cell_order, list) else [cell_order]
    keyed, keys = whole_keys(df, [*groups, *cells_by])
    inner = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = keyed.select("*", *[F.sum(s).over(inner).alias(f"_in_{s}") for s in sums])
    outer = W.partitionBy(*keys[:2 * len(groups)]).orderBy(*cell_order).rowsBetween(W.unboundedPreceding, -1)
    cells = keyed.groupBy(*keys, *cells_by).agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    cells = cells.select(*[F.col(k).alias(f"_r{k}") for k in keys], *[F.sum(f"_t_{s}").over(outer).alias(f"_b_{s}") for s in sums])
    joined = local.join(cells, F.expr(" AND ".join(f"`{k}` = `_r{k}`" for k in keys)), "inner")
    return joined.selectExpr(*[f"`{c}`" for c in df.columns],
                             *[f"coalesce(`_b_{s}`, 0) + `_in_{s}` AS `cum_{s}`" for s in sums])
