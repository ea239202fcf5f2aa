"""Targets, tiers, reason texts and driver sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    ACTIONS, DRIVER_REASONS, FRIENDLY_NAMES, HIGH_EXTRAS_FULL, LIST_TIERS, REASON_ADMIN,
    REASON_DUE, REASON_NO_VISIT, REASON_SUPERVISION, SCORE_TIERS,
)
from .numbers import positive_flag


def target_columns(needs: Column, due: Column, missed: Column) -> list[Column]:
    """Composite label and its three components; unknown counts as not set."""
    need = F.coalesce(needs.cast("int"), F.lit(0))
    over = positive_flag(due)
    miss = F.coalesce((missed != "") & (missed != "nan"), F.lit(False)).cast("int")
    return [
        F.greatest((need == 1).cast("int"), over, miss).alias("is_defaulter"),
        need.alias("_target_needs_fu"),
        over.alias("_target_due_pos"),
        miss.alias("_target_missed_flag"),
    ]


def score_tier(score: Column, tiers=SCORE_TIERS) -> Column:
    """LOW / MEDIUM / HIGH; each tier ends below its limit."""
    out = None
    for name, limit in tiers:
        if limit is None:
            return F.when(score.isNotNull(), out.otherwise(name))
        out = F.when(score < limit, name) if out is None else out.when(score < limit, name)
    return out


def list_tier(score: Column, edges=LIST_TIERS[0], labels=LIST_TIERS[1]) -> Column:
    """medium / high / critical; right-closed, the lowest edge belongs to the first."""
    out = None
    for i, label in enumerate(labels):
        above = score >= edges[i] if i == 0 else score > edges[i]
        test = above & (score <= edges[i + 1])
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def reason_codes(df: DataFrame, limit: int = 3) -> Column:
    """Up to three rule texts, in rule order. An absent column takes the rule's default."""
    def col(name, default):
        return F.col(name) if name in df.columns else F.lit(default)

    rules = (
        (col("num_due_vaccines_rebuilt", 0) > 0, REASON_DUE),
        (col("days_since_last_supervision", None).cast("double") > 60, REASON_SUPERVISION),
        (col("homevisit_count_30d", 0) == 0, REASON_NO_VISIT),
        (col("county_valid_flag", 1) == 0, REASON_ADMIN),
    )
    return F.slice(F.array_compact(F.array(*[F.when(test, F.lit(text)) for test, text in rules])), 1, limit)


def lookup(key: Column, table: dict[str, str], default: Column) -> Column:
    """A small fixed text table as one literal map."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def friendly_name(feature: Column) -> Column:
    return lookup(feature, FRIENDLY_NAMES, feature)


def driver_reason(feature: Column) -> Column:
    return lookup(feature, DRIVER_REASONS, F.concat(F.lit("Feature: "), feature))


def driver_direction(value: Column) -> Column:
    return F.when(value > 0, "increases_risk").otherwise("decreases_risk")


def plain_english(feature: Column, value: Column, effect: Column) -> Column:
    """One sentence per driver, by feature."""
    verb = F.when(effect > 0, "increases").otherwise("reduces")
    tail = F.concat(F.lit(" — this "), verb, F.lit(" defaulter risk"))
    whole = value.cast("bigint").cast("string")
    fmt = lambda pattern, c: F.format_string(pattern, c)
    return (
        F.when(feature == "vax_completeness_score",
               F.concat(F.lit("Child has received "), fmt("%.0f", value * 100), F.lit("% of expected vaccines"), tail))
        .when(feature == "patient_age_in_months",
              F.concat(F.lit("Child is "), fmt("%.0f", value), F.lit(" months old — age context "), verb,
                       F.lit(" defaulter risk")))
        .when(feature == "due_count_clean",
              F.concat(F.lit("Child has "), whole, F.lit(" outstanding vaccine dose(s)"), tail))
        .when(feature == "months_since_reported",
              F.concat(F.lit("Last CHW contact was "), fmt("%.1f", value), F.lit(" month(s) ago"), tail))
        .when(feature == "chw_supervision_frequency",
              F.concat(F.lit("This CHW area had "), whole, F.lit(" supervision visit(s)"), tail))
        .when(feature == "maternal_anc_visits",
              F.concat(F.lit("Mother attended "), whole, F.lit(" ANC visit(s)"), tail))
        .when((feature == "measles_booster_gap") & (value == 1),
              F.concat(F.lit("Child received MR1 but is missing the 18-month MR2 booster"), tail))
        .when(feature == "measles_booster_gap", F.lit("Measles booster gap not detected"))
        .otherwise(F.concat(friendly_name(feature), F.lit(" value="), fmt("%.2f", value), F.lit(" "), verb,
                            F.lit(" defaulter risk")))
    )


def recommended_action(tier: Column, top_feature: Column, extras=HIGH_EXTRAS_FULL) -> Column:
    base = lookup(tier, ACTIONS, F.lit(None).cast("string"))
    extra = F.when(tier == "HIGH", lookup(top_feature, extras, F.lit(""))).otherwise("")
    return F.concat(base, F.coalesce(extra, F.lit("")))
