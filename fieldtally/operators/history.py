"""Prior-event features of a person's history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .prefix import whole_keys
from .scan import range_pieces


def prior_events(df: DataFrame, key: str, ts: str, tiebreak, follow_up: str, default: str) -> DataFrame:
    """Earlier follow-ups, earlier defaults and days since the previous event.

    Histories are range-sorted by (key, time, tiebreak) and cut into pieces (see ``scan``).
    Inside a piece a window counts what came before; the totals and newest times of the
    key's earlier pieces are added on top.
    """
    flags = {"_f": F.coalesce(F.col(follow_up), F.lit(0)).cast("bigint"), "_d": F.coalesce(F.col(default), F.lit(0)).cast("bigint")}
    laid = range_pieces(df.withColumns(flags), [F.col(ts).asc_nulls_last(), *[F.col(t).asc() for t in tiebreak]], [key], [key, ts, *tiebreak])
    base, keys = whole_keys(laid, [key, "_piece"])
    piece = W.partitionBy(*keys).orderBy("_at")
    before_row = piece.rowsBetween(W.unboundedPreceding, -1)
    local = base.select("*", F.lag(ts).over(piece).alias("_prev"),
                        *[F.coalesce(F.sum(c).over(before_row), F.lit(0)).alias(f"_in{c}") for c in flags])
    earlier = W.partitionBy(*keys[:2]).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    pieces = base.groupBy(*keys, "_piece").agg(F.max(ts).alias("_end"), *[F.sum(c).alias(f"_t{c}") for c in flags])
    pieces = pieces.select(*[F.col(k).alias(f"_r{k}") for k in keys], F.max("_end").over(earlier).alias("_last"),
                           *[F.coalesce(F.sum(f"_t{c}").over(earlier), F.lit(0)).alias(f"_up{c}") for c in flags])
    joined = local.join(pieces, F.expr(" AND ".join(f"`{k}` = `_r{k}`" for k in keys)))
    gap = F.floor((F.unix_micros(ts) - F.unix_micros(F.coalesce("_prev", "_last"))) / F.lit(86_400_000_000))
    return joined.select(
        *df.columns, (F.col("_in_f") + F.col("_up_f")).alias("prior_follow_up_flag_count"),
        (F.col("_in_d") + F.col("_up_d")).alias("prior_default_flag_count"), gap.alias("days_since_last_iz_event"))
