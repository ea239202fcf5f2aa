"""One cleaner per source table for the person table; each is a single projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import INACTIVE_SUPERVISION_COLUMNS, MALARIA_DOSES, SCORED_MODULES, YES_NO_COLUMNS
from ..functions.dates import month_key, month_token, parse_timestamp
from ..functions.numbers import finite_unit, guarded_ratio, non_negative, to_number
from ..functions.text import json_map, mixed_flag, sex_flag, yes_no
from ..operators.checks import drop_null_only, keep_columns


def _with(df: DataFrame, columns: dict) -> DataFrame:
    """Replace or append columns in one projection."""
    return df.withColumns(columns) if columns else df


def _reported(df: DataFrame) -> dict:
    return {"reported": parse_timestamp(F.col("reported"))} if "reported" in df.columns else {}


def not_endemic(df: DataFrame):
    if "is_in_malaria_endemic_region" not in df.columns:
        return F.lit(True)
    c = F.lower("is_in_malaria_endemic_region")
    return c.isNull() | (c == "no")


def clean_visits(df: DataFrame) -> DataFrame:
    out = {"month_clean": month_token(F.col("month"))}
    for c in ("patient_age_in_months", "patient_age_in_years", "patient_age_in_days"):
        if c in df.columns:
            out[c] = to_number(F.col(c))
    out["due_count_clean"] = non_negative(F.col("due_count"))
    for c in YES_NO_COLUMNS:
        if c in df.columns:
            out[f"{c}_binary"] = yes_no(F.col(c))
    out["patient_sex_binary"] = sex_flag(F.col("patient_sex"))
    for c in MALARIA_DOSES:
        if c in df.columns:
            number = to_number(F.col(c))
            out[c] = F.when(number.isNull() & not_endemic(df), 0.0).otherwise(number)
    if "screening" in df.columns:
        out["screening_parsed"] = json_map(F.col("screening"))
    return drop_null_only(_with(df, out | _reported(df)), ["vaccination_upto_date"])


def clean_registry(df: DataFrame) -> DataFrame:
    return _with(df, _reported(df) | {"chw_phone": F.col("chw_phone").cast("string")})


def clean_supervision(df: DataFrame) -> DataFrame:
    out = _reported(df)
    for c in df.columns:
        if c.startswith("perce_"):
            out[c] = finite_unit(F.col(c))
    for m in SCORED_MODULES:
        if {f"calc_{m}_score", f"calc_{m}_denominator"} <= set(df.columns):
            out[f"pct_{m}_pct"] = guarded_ratio(F.col(f"calc_{m}_score"), F.col(f"calc_{m}_denominator"))
    for c in ("has_all_tools", "has_proper_protective_equipment", "has_essential_medicines"):
        if c in df.columns:
            out[f"{c}_binary"] = mixed_flag(F.col(c))
    return _with(df, out).drop(*INACTIVE_SUPERVISION_COLUMNS)


def clean_home_visits(df: DataFrame) -> DataFrame:
    if "reported" not in df.columns:
        return df
    out = _with(df, _reported(df))
    return out.withColumn("year_month", month_key(F.col("reported")))


def clean_population(df: DataFrame) -> DataFrame:
    if "chw_workload_u2" in df.columns:
        return df
    kept = keep_columns(df, ["county", "month", "chw_area", "chw_uuid", "u2_pop", "reportedm"])
    return kept.withColumn("u2_pop", to_number(F.col("u2_pop")))


def clean_postnatal(df: DataFrame) -> DataFrame:
    days = F.col("days_since_delivery") if "days_since_delivery" in df.columns else F.lit(None).cast("double")
    label = F.col("is_immunization_defaulter") if "is_immunization_defaulter" in df.columns else F.lit(None).cast("string")
    return _with(df, _reported(df) | {
        "days_since_delivery_clean": non_negative(days), "is_immunization_defaulter_binary": yes_no(label)})


def clean_pregnancies(df: DataFrame) -> DataFrame:
    """Registrations of pregnancies: dates, flags, nutrition risk (not green; unknown stays null)."""
    out = _reported(df)
    if "date_of_birth" in df.columns:
        out["date_of_birth"] = parse_timestamp(F.col("date_of_birth"))
    for c in ("marked_as_pregnant", "is_anc_defaulter", "currently_pregnant"):
        if c in df.columns:
            out[f"{c}_binary"] = mixed_flag(F.col(c))
    if "muac_color" in df.columns:
        out["muac_risk"] = (F.lower("muac_color") != "green").cast("double")
    if "takes_iron_or_folate_supplements" in df.columns:
        out["iron_folate_binary"] = yes_no(F.col("takes_iron_or_folate_supplements"))
    if "number_of_anc_attended" in df.columns:
        out["number_of_anc_attended"] = to_number(F.col("number_of_anc_attended"))
    return _with(df, out)


def clean_pregnancy_visits(df: DataFrame) -> DataFrame:
    out = _reported(df)
    if "number_of_anc_attended" in df.columns:
        out["number_of_anc_attended"] = to_number(F.col("number_of_anc_attended"))
    for c in ("is_anc_defaulter", "currently_pregnant", "marked_as_pregnant"):
        if c in df.columns:
            out[f"{c}_binary"] = mixed_flag(F.col(c))
    return _with(df, out)


def clean_family_planning(df: DataFrame) -> DataFrame:
    """Also for refills; a table that is already one row per household passes through."""
    if "on_fp_binary" in df.columns and "reported" not in df.columns:
        return df
    out = _reported(df)
    if "on_fp" in df.columns:
        out["on_fp_binary"] = yes_no(F.col("on_fp"))
    return _with(df, out)


CLEANERS = {
    "iz": clean_visits, "active_chps": clean_registry, "supervision": clean_supervision,
    "homevisit": clean_home_visits, "population": clean_population, "pnc": clean_postnatal,
    "preg_reg": clean_pregnancies, "preg_reg2": clean_pregnancies,
    "preg_visit": clean_pregnancy_visits, "preg_visit2": clean_pregnancy_visits,
    "fp": clean_family_planning, "refill": clean_family_planning,
}


def clean_all(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: CLEANERS.get(name, lambda d: d)(df) for name, df in tables.items()}
