"""Visit lists, top rows and top drivers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.risk import driver_reason, list_tier, reason_codes, score_tier
from .latest import top_row


def at_or_above(df: DataFrame, score: str, threshold: float) -> DataFrame:
    return df.filter(F.col(score) >= threshold)


def risk_list(df: DataFrame, threshold: float = 0.5, score: str = "predicted_risk", tiebreak=()) -> DataFrame:
    """Rows at or above the threshold with list tier and reasons, highest first."""
    kept = at_or_above(df, score, threshold)
    return kept.withColumn("risk_tier", list_tier(F.col(score))).withColumn("reason_codes", reason_codes(kept)).orderBy(
        F.col(score).desc(), *[F.col(t) for t in tiebreak])


def action_list(df: DataFrame, score: str, tiebreak, n: int = 20) -> DataFrame:
    """The n highest scores; ties by the key."""
    return df.orderBy(F.col(score).desc(), *[F.col(t) for t in tiebreak]).limit(n)


def example_per_tier(df: DataFrame, score: str, tiebreak) -> DataFrame:
    """The highest-scoring row of each tier."""
    tiered = df.withColumn("risk_tier", score_tier(F.col(score)))
    return top_row(tiered, ["risk_tier"], [F.col(score).desc(), *[F.col(t).asc() for t in tiebreak]])


def tier_counts(df: DataFrame, score: str, tiers=("HIGH", "MEDIUM", "LOW")) -> DataFrame:
    """Rows per tier, 0 for tiers without any: one aggregate unfolded to fixed rows."""
    tier = score_tier(F.col(score))
    row = df.agg(*[F.count_if(tier == t).alias(t) for t in tiers])
    return row.select(F.inline(F.array(*[F.struct(F.lit(t).alias("risk_tier"), F.col(t).alias("n")) for t in tiers])))


def batch_counts(df: DataFrame, score: str, batch=()) -> DataFrame:
    tier = score_tier(F.col(score))
    return df.groupBy(*batch).agg(*[F.count_if(tier == t).alias(f"n_{t.lower()}") for t in ("HIGH", "MEDIUM", "LOW")])


def top_drivers(effects: str, values: str, names, n: int = 3):
    """The n largest effects of a row as structs, by size, then by feature position.

    ``names`` has one name per effect, so the structs are listed and not formed by a lambda,
    and sorted in their natural order: Spark compiles the one and compares natively for the other.
    """
    e, v = F.col(effects), F.col(values)
    items = F.array(*[F.struct(
        (-F.abs(e[i])).alias("k"), F.lit(i).alias("i"), e[i].alias("shap_value"), v[i].alias("feature_value"),
        F.lit(name).alias("feature")) for i, name in enumerate(names)])
    return F.when(e.isNotNull(), F.slice(F.sort_array(items), 1, n))


def top_reasons(df: DataFrame, keys, effects: str, names, n: int = 5) -> DataFrame:
    """One row per row and leading effect: rank, feature, effect rounded to 4 digits, whether
    it increases or decreases the score, and the reason in words."""
    ranked = df.select(*keys, F.posexplode(top_drivers(effects, effects, names, n)).alias("i", "d"))
    effect = F.col("d.shap_value")
    return ranked.select(
        *keys, (F.col("i") + 1).alias("rank"), F.col("d.feature").alias("feature"), F.round(effect, 4).alias("shap"),
        F.when(effect > 0, "INCREASES").otherwise("DECREASES").alias("direction"), driver_reason(F.col("d.feature")).alias("reason"))
