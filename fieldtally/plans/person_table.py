"""The one-row-per-person table: dedup, scores, label, context joins, collapse.

The steps over the visits are one lazy plan that runs when the table is written or read; the
registry's latest rows and the category codes, small tables that are read more than once, are
written while it is built.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CORE_DOSES, DOSE_SERIES, MALARIA_DOSES
from ..functions import schedule as S
from ..functions.dates import months_since
from ..functions.numbers import to_number
from ..functions.risk import target_columns
from ..functions.text import yes_no
from ..operators import aggregates as A
from ..operators.codes import category_table, encode_categories
from ..operators.joins import add_absent, full_join, left_join, union_common
from ..operators.latest import latest_rows, top_row
from ..session import fresh_path
from ..sources.tables import layer

CODES = {
    "sub_county_name": "sub_county_encoded", "county_name": "county_name_encoded",
    "community_unit": "community_unit_encoded", "county": "county_encoded",
}

REGISTRY_COLUMNS = ["chw_area_uuid", "community_unit", "county_name", "sub_county_name"]


def latest_visit_per_month(iz: DataFrame, tiebreak) -> DataFrame:
    month = "month_clean" if "month_clean" in iz.columns else "month"
    base = iz if month == "month_clean" else iz.withColumn("month_clean", F.col("month"))
    return latest_rows(base, ["patient_id", "month_clean"], "reported", tiebreak)


def add_dose_scores(df: DataFrame, as_of: Column) -> DataFrame:
    age = F.col("patient_age_in_months")
    endemic = F.coalesce(F.col("is_in_malaria_endemic_region") == "yes", F.lit(False)) \
        if "is_in_malaria_endemic_region" in df.columns else F.lit(False)
    df = S.clean_doses(df, CORE_DOSES + MALARIA_DOSES).withColumns({
        "age_expected_vaccine_count": S.expected_doses(age),
        "age_expected_vaccine_count_endemic": S.expected_doses_with_region(age, endemic)})
    core, every = S.received_doses(df, CORE_DOSES), S.received_doses(df, CORE_DOSES + MALARIA_DOSES)
    series = {flag: S.series_complete(df, names) for flag, names in DOSE_SERIES.items() if any(n in df.columns for n in names)}
    has_pair = {"has_measles_9_months", "has_measles_18_months"} <= set(df.columns)
    return df.withColumns({
        "vax_received_core": core,
        "vax_completeness_score": S.completeness(core, F.col("age_expected_vaccine_count")),
        "vax_received_total": every,
        "vax_completeness_all": S.completeness(every, F.col("age_expected_vaccine_count_endemic")),
        **series,
        "measles_booster_gap": S.booster_gap(F.col("has_measles_9_months"), F.col("has_measles_18_months"), age)
        if has_pair else F.lit(0.0),
        "months_since_reported": months_since(F.col("reported"), as_of),
    })


def add_target(df: DataFrame) -> DataFrame:
    needs = F.col("needs_follow_up_binary") if "needs_follow_up_binary" in df.columns else yes_no(F.col("needs_follow_up"))
    due = F.col("due_count_clean") if "due_count_clean" in df.columns else to_number(F.col("due_count"))
    missed = F.col("vaccines_due_missed") if "vaccines_due_missed" in df.columns else F.lit("")
    return df.select("*", *target_columns(needs, due, missed))


def join_registry(df: DataFrame, registry: DataFrame | None, tiebreak) -> DataFrame:
    df = df.withColumn("chw_area_key", F.col("contact_parent_id"))
    if registry is None:
        return df
    one = latest_rows(registry, ["chw_area_uuid"], "reported", tiebreak).select(*REGISTRY_COLUMNS)
    return left_join(df, one, "chw_area_key", "chw_area_uuid")


def join_maternal(df: DataFrame, *parts: DataFrame | None) -> DataFrame:
    present = [p for p in parts if p is not None]
    if not present:
        return df
    means = A.maternal_by_area(union_common(*present))
    return add_absent(df, A.MATERNAL) if means is None else left_join(df, means, "chw_area_key")


def join_audit_label(df: DataFrame, pnc: DataFrame | None, tiebreak) -> DataFrame:
    """First known postnatal label per patient; for audit, not a feature."""
    if pnc is None:
        return add_absent(df, ["_pnc_iz_defaulter"])
    known = pnc.filter("is_immunization_defaulter_binary is not null and patient_id is not null")
    first = top_row(known, ["patient_id"], [F.col(t).asc() for t in tiebreak]).select(
        "patient_id", F.col("is_immunization_defaulter_binary").alias("_pnc_iz_defaulter"))
    return left_join(df, first, "patient_id")


def household_planning(*tables: DataFrame | None, key: str = "contact_parent_id") -> DataFrame | None:
    present = [t for t in tables if t is not None and {"on_fp_binary", key} <= set(t.columns)]
    return A.max_over_union(present, key, "on_fp_binary", "household_on_fp") if present else None


def area_context(tables: dict[str, DataFrame], as_of: Column) -> DataFrame | None:
    """All area aggregates side by side, one row per area, so the visits are joined once.

    Each part leaves its aggregation partitioned by area; joining them needs no further shuffle.
    """
    get, parts = tables.get, []
    if get("supervision") is not None:
        parts.append(A.supervision_by_area(get("supervision"), as_of).drop("chw_last_supervision_date"))
    if get("population") is not None:
        parts.append(A.workload_by_area(get("population")))
    if get("homevisit") is not None:
        parts.append(A.visit_rate_by_area(get("homevisit")).select("chw_area_key", "monthly_homevisit_rate"))
    registrations = [t for t in (get("preg_reg"), get("preg_reg2")) if t is not None]
    maternal = A.maternal_by_area(union_common(*registrations)) if registrations else None
    if maternal is not None:
        parts.append(maternal)
    return reduce(lambda a, b: full_join(a, b, ["chw_area_key"]), parts) if parts else None


def build_person_table(tables: dict[str, DataFrame], as_of: Column, tiebreaks: dict[str, list[str]]) -> DataFrame:
    """All steps over cleaned tables. ``tiebreaks`` names unique columns per table."""
    get = tables.get
    iz = tables["iz"]
    visits = latest_visit_per_month(iz, tiebreaks["iz"])
    # The newest of the months' newest. What follows looks at one row at a time or at tables of one
    # row per key, so it is done for the kept rows only; the codes alone need the other visits.
    df = latest_rows(visits, ["patient_id"], "reported", tiebreaks["iz"])
    df = df.withColumn("vitamin_a_completeness", S.vitamin_a_completeness(df, F.col("patient_age_in_months")))
    fp = household_planning(get("fp"), get("refill"))
    if fp is not None:
        df = left_join(df, fp, "contact_parent_id")
    if "is_in_malaria_endemic_region" in df.columns:
        df = df.withColumn("is_malaria_endemic_binary", yes_no(F.col("is_in_malaria_endemic_region")))
    if "month_clean" not in iz.columns:
        df = df.select(*[c for c in df.columns if c != "month_clean"], "month_clean")
    registry, registry_tiebreak = get("active_chps"), tiebreaks.get("active_chps", [])
    if registry is not None:
        # Joined to the kept visits and, for the codes, to all: a row per area is found and written once.
        wanted = dict.fromkeys([*REGISTRY_COLUMNS, "reported", *registry_tiebreak])
        registry = layer(latest_rows(registry.select(*wanted), ["chw_area_uuid"], "reported", registry_tiebreak),
                         fresh_path(iz.sparkSession, "registry") + ".parquet")
    df = add_target(add_dose_scores(df, as_of))
    df = join_registry(df, registry, registry_tiebreak)
    context = area_context(tables, as_of)
    if context is not None:
        df = left_join(df, context, "chw_area_key")
    if get("preg_reg") is not None or get("preg_reg2") is not None:
        df = add_absent(df, A.MATERNAL)
    df = join_audit_label(df, get("pnc"), tiebreaks.get("pnc", []))
    # Codes come from all visits and not from the collapsed ones (S14), by a narrow second read of key and names only.
    codes = {c: out for c, out in CODES.items() if c in df.columns}
    if codes:
        narrow = visits.select("contact_parent_id", *[c for c in codes if c in visits.columns])
        names = join_registry(narrow.distinct(), registry, registry_tiebreak)
        df = encode_categories(df, codes, category_table(names, list(codes)))
    return df
