"""Per-area, per-worker and per-month aggregates.

All use partial aggregation, so a hot key costs one row per map task. Null keys are
dropped, as they can join nothing (S2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import months_since
from ..functions.text import clean_text, first_present
from .quantiles import exact_median


def supervision_by_area(sup: DataFrame, as_of: Column, key: str = "chw_area") -> DataFrame:
    """Dated visits, last date, mean scores and any-flags per area; ready percentages win over raw scores."""
    flag = lambda name: F.col(f"{name}_binary") if f"{name}_binary" in sup.columns else F.coalesce(
        (F.col(name) == "yes").cast("int"), F.lit(0))
    competency = first_present(sup, "pct_immunization_pct", "calc_immunization_score")
    assessment = first_present(sup, "pct_assessment_pct", "calc_assessment_score")
    return (
        sup.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("chw_area_key")).agg(
            F.count("reported").alias("chw_supervision_frequency"),
            F.max("reported").alias("chw_last_supervision_date"),
            F.avg(competency).alias("chw_immunization_competency"),
            F.avg(assessment).alias("chw_overall_assessment_pct"),
            F.max(flag("has_all_tools")).alias("chw_has_all_tools"),
            F.max(flag("has_proper_protective_equipment")).alias("chw_has_ppe"),
        )
        .withColumn("months_since_last_supervision", months_since(F.col("chw_last_supervision_date"), as_of))
        .withColumn("chw_immunization_competency_pct", F.col("chw_immunization_competency"))
    )


def workload_by_area(pop: DataFrame, key: str = "chw_area", value: str = "u2_pop") -> DataFrame:
    """Median workload per area; a table that already has it passes through."""
    if "chw_workload_u2" in pop.columns:
        return pop.select(F.col(key).alias("chw_area_key"), "chw_workload_u2")
    known = pop.filter(F.col(key).isNotNull())
    return exact_median(known.select(F.col(key).alias("chw_area_key"), F.col(value)), value, ["chw_area_key"], "chw_workload_u2")


def visit_rate_by_area(hv: DataFrame, key: str = "chw_area", item: str = "family_id", ts: str = "reported") -> DataFrame:
    """Visits, distinct months and visits per month; null rate for no dated month."""
    if "monthly_homevisit_rate" in hv.columns:
        return hv.select(F.col(key).alias("chw_area_key"), "monthly_homevisit_rate")
    # Month first: the distinct count then works on one row per (area, month).
    by_month = hv.filter(F.col(key).isNotNull()).groupBy(
        F.col(key).alias("chw_area_key"), F.trunc(F.col(ts), "month").alias("_m")).agg(F.count(item).alias("_n"))
    return by_month.groupBy("chw_area_key").agg(
        F.sum("_n").alias("total_homevisits"), F.count("_m").alias("hv_distinct_months"),
    ).withColumn("monthly_homevisit_rate", F.try_divide(
        F.col("total_homevisits").cast("double"), F.nullif(F.col("hv_distinct_months"), F.lit(0))))


def any_yes(df: DataFrame, key: str = "contact_parent_id", flag: str = "on_fp", out: str = "on_fp_binary") -> DataFrame:
    """1 for keys with at least one yes, 0 for the others."""
    word = clean_text(F.col(flag), lower=True)
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.when(word == "yes", 1).otherwise(0)).alias(out))


def max_over_union(tables, key: str, value: str, out: str) -> DataFrame:
    """Per-key maximum over several tables; each is reduced before the union."""
    parts = [t.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(value).alias(out)) for t in tables]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(key).agg(F.max(out).alias(out))


MATERNAL = ("maternal_anc_visits", "maternal_anc_defaulter", "maternal_muac_risk", "maternal_iron_folate")


def maternal_by_area(preg: DataFrame) -> DataFrame | None:
    """Maternal means per area over the columns that exist; None when no area column does."""
    key = first_present(preg, "contact_parent_parent_id", "chw_area")
    if key is None:
        return None
    has = lambda c: c in preg.columns
    parts = {}
    if has("number_of_anc_attended"):
        parts["maternal_anc_visits"] = F.col("number_of_anc_attended")
    if has("is_anc_defaulter_binary"):
        parts["maternal_anc_defaulter"] = F.col("is_anc_defaulter_binary")
    elif has("is_anc_defaulter"):
        parts["maternal_anc_defaulter"] = F.coalesce(
            F.lower(F.col("is_anc_defaulter").cast("string")).isin("true", "yes", "1"), F.lit(False)).cast("double")
    if has("muac_risk"):
        parts["maternal_muac_risk"] = F.col("muac_risk")
    elif has("muac_color"):
        parts["maternal_muac_risk"] = F.coalesce(F.lower("muac_color") != "green", F.lit(True)).cast("double")
    if has("iron_folate_binary"):
        parts["maternal_iron_folate"] = F.col("iron_folate_binary")
    elif has("takes_iron_or_folate_supplements"):
        parts["maternal_iron_folate"] = F.coalesce(
            F.lower("takes_iron_or_folate_supplements") == "yes", F.lit(False)).cast("double")
    if not parts:
        return None
    return preg.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("chw_area_key")).agg(
        *[F.avg(c).alias(name) for name, c in parts.items()])


def person_month_cohort(ev: DataFrame, tiebreak: str) -> DataFrame:
    """One row per (child, month); the last value is the newest non-null one (S3)."""
    order = F.struct("event_datetime", tiebreak)
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c)
    return ev.filter(F.col("child_key").isNotNull() & F.col("year_month").isNotNull()).groupBy(
        "child_key", F.col("year_month").alias("index_month")).agg(
        F.max("event_datetime").alias("index_date"), last("sex"), F.max("age_days").alias("age_days"),
        last("county_clean"), F.max("county_valid_flag").alias("county_valid_flag"),
        F.avg("row_missingness_pct").alias("row_missingness_pct"),
    )


def observation_mart(ev: DataFrame) -> DataFrame:
    return ev.groupBy("child_key", F.trunc("event_datetime", "month").alias("index_month")).agg(
        F.min("event_datetime").alias("first_event_datetime"), F.max("event_datetime").alias("last_event_datetime"),
        F.max("patient_age_in_days").alias("age_days"), F.max("patient_sex").alias("sex"))


def worker_month_mart(sup: DataFrame) -> DataFrame:
    return sup.groupBy("chw_key", F.trunc("supervision_datetime", "month").alias("index_month")).agg(
        F.count("*").alias("supervision_events"), F.avg("calc_immunization_score").alias("mean_immunization_score"))


def area_month_mart(reg: DataFrame) -> DataFrame:
    return reg.groupBy("county_clean", "sub_county_clean", F.col("registry_snapshot_month").alias("index_month")).agg(
        F.count_distinct("chw_key").alias("active_chws"))


def supervision_months(sup: DataFrame) -> DataFrame:
    """Worker-month supervision: count, mean score, tool share, 0 when dated."""
    return sup.filter("chw_key is not null and year_month is not null").groupBy("chw_key", "year_month").agg(
        F.count("supervision_event_key").alias("supervision_events_last_90d"),
        F.avg("calc_immunization_score").alias("mean_immunization_score_90d"),
        F.avg("has_all_tools").alias("pct_tools_available_90d"),
        F.max(F.when(F.col("supervision_datetime").isNotNull(), 0)).alias("days_since_last_supervision"))


def homevisit_months(hv: DataFrame) -> DataFrame:
    return hv.filter("chw_key is not null and year_month is not null").groupBy("chw_key", "year_month").agg(
        F.count("chw_key").alias("homevisit_count_30d"), F.count("chw_key").alias("homevisit_count_90d"))


def area_population(pop: DataFrame, keys=("county_clean", "sub_county_clean")) -> DataFrame:
    keys = [k for k in keys if k in pop.columns]
    known = pop
    for k in keys:
        known = known.filter(F.col(k).isNotNull())
    return known.groupBy(*keys).agg(
        F.max("u2_pop_clean").alias("u2_population_context"), F.max("u5_pop_clean").alias("u5_population_context"),
        F.max("wra_pop_clean").alias("wra_population_context"))


def trailing_activity(ev: DataFrame, key: str, ts: str, days: dict[str, int]) -> DataFrame:
    """Events in the trailing windows, per key and day, the day included.

    Counted per (key, day) first, so a hot key holds one row per day.
    """
    daily = ev.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).groupBy(
        key, F.to_date(ts).alias("activity_date")).agg(F.count("*").alias("events_on_day"))
    w = W.partitionBy(key).orderBy(F.unix_date("activity_date"))
    return daily.select(key, "activity_date", "events_on_day", *[
        F.sum("events_on_day").over(w.rangeBetween(-(n - 1), 0)).alias(name) for name, n in days.items()])


def monthly_coverage(df: DataFrame, month: str, flag: str) -> DataFrame:
    return df.filter(F.col(month).isNotNull()).groupBy(month).agg(
        F.count("*").alias("n"), F.sum(flag).alias("positives"), F.avg(flag).alias("positive_rate"))


def group_prevalence(df: DataFrame, group: str, flag: str, min_rows: int = 0) -> DataFrame:
    """Rows and rate per group, small groups left out."""
    return df.filter(F.col(group).isNotNull()).groupBy(group).agg(
        F.count("*").alias("n"), F.sum(flag).alias("positives"), F.avg(flag).alias("rate"),
    ).filter(F.col("n") >= min_rows)


def subgroup_risk(df: DataFrame, group: str, score: str = "predicted_risk") -> DataFrame:
    """Size and mean score per group; rows without a group form one too."""
    return df.groupBy(group).agg(F.count("*").alias("n"), F.avg(score).alias("mean_predicted_risk"))
