"""Latest-row, first-row and position operators.

``row_number() = 1`` lets Spark prune each map task to one row per key before the
shuffle (WindowGroupLimit), so a key holding a third of the table sends one row
per task, not its whole history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scan import segmented_rank, segmented_totals


def latest_rows(df: DataFrame, keys, ts: str, tiebreak, nulls_first: bool = False) -> DataFrame:
    """One row per key: the newest ``ts``, then the highest tiebreak.

    Null timestamps lose by default; ``nulls_first`` gives them the meaning of
    ``DISTINCT ON … ORDER BY ts DESC``, where they win (E2).
    """
    newest = F.col(ts).desc_nulls_first() if nulls_first else F.col(ts).desc_nulls_last()
    order = [newest, *[F.col(t).desc_nulls_last() for t in tiebreak]]
    return top_row(df, keys, order)


def top_row(df: DataFrame, keys, order) -> DataFrame:
    """The first row per key in the given order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def removed_report(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows before and after a collapse, distinct keys, rows removed."""
    b = before.agg(F.count("*").alias("rows_before"), F.count_distinct(key).alias("keys_before"))
    a = after.agg(F.count("*").alias("rows_after"))
    return b.withColumn("rows_after", a.scalar()).withColumn(
        "rows_removed", F.col("rows_before") - F.col("rows_after"))


def record_rank(df: DataFrame, key: str, ts: str, tiebreak, out: str) -> DataFrame:
    """1-based position of each row in its key's time order, nulls last.

    A running number over one key cannot be pre-aggregated, so the rows are range-sorted by
    (key, time, tiebreak) and numbered in pieces (see ``scan``). No task sees a whole hot
    key, nor all of its rows without a time.
    """
    order = [F.col(ts).asc_nulls_last(), *[F.col(t).asc_nulls_last() for t in tiebreak]]
    return segmented_rank(df, order, [key], out, [key, ts, *tiebreak])


def rows_at_positions(df: DataFrame, score: str, tiebreak, positions) -> DataFrame:
    """Rows at given shares of the ascending score order (0-based floor(n*share)).

    ``positions`` maps a name to (share, from_end). The wanted scores come from the counts
    of each score; only rows that tie at a wanted score are ordered, in pieces by ranges of
    the tiebreak. So neither the table nor a third of it with one score is sorted by one task.
    """
    counts = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("_score")).agg(F.count("*").alias("_n"))
    ranked = segmented_totals(counts, ["_n"], [F.col("_score").asc()])
    nulls = df.filter(F.col(score).isNull()).agg(F.count("*")).scalar()
    n = df.agg(F.count("*")).scalar()
    # Rows without a score come first, as in the order of the whole table.
    ranked = ranked.withColumn("_upto", F.col("cum__n") + nulls).withColumn("_total", n)
    wanted = F.array(*[
        F.struct(F.lit(name).alias("example"), (
            F.col("_total") + F.floor(-(F.col("_total") * F.lit(share))) if from_end else F.floor(F.col("_total") * F.lit(share))).alias("_pos"))
        for name, (share, from_end) in positions.items()])
    hit = ranked.select("*", F.inline(wanted)).filter("_pos >= _upto - _n AND _pos < _upto")
    hit = hit.select("_score", "example", (F.col("_pos") - F.col("_upto") + F.col("_n") + 1).alias("_place"))
    tied = df.join(hit, F.col(score) == F.col("_score")).drop("_score")
    placed = segmented_rank(tied, [F.col(t).asc() for t in tiebreak], ["example"], "_rank_here", tiebreak)
    # Of names that want one row the first is given, as before.
    rank = F.array_position(F.array(*[F.lit(name) for name in positions]), F.col("example"))
    found = placed.filter("_rank_here = _place").select(*df.columns, "example", rank.alias("_rank"))
    keys = [*tiebreak, score]
    return top_row(found, keys, [F.col("_rank").asc()]).drop("_rank")
