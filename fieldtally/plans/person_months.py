"""The person-month layers: silver cleaners, cohort, labels, contexts, feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import AGE_BANDS_DAYS, DAY_DOSES, SCHEDULE_DAYS
from ..functions import numbers as N
from ..functions import text as X
from ..functions.dates import age_agrees_flag, age_months, calendar_columns, month_key, parse_timestamp
from ..functions.schedule import schedule_labels
from ..operators import aggregates as A
from ..operators.checks import require_columns
from ..operators.history import prior_events
from ..operators.joins import full_join, left_join
from ..operators.latest import latest_rows, record_rank


def add_missing_share(df: DataFrame) -> DataFrame:
    return df.withColumn("row_missingness_pct", N.missing_share(*[F.col(c) for c in df.columns]))


def silver_visits(raw: DataFrame) -> DataFrame:
    df = require_columns(X.snake_case_columns(raw), ["uuid", "patient_id", "reported"])
    has = lambda c: c in df.columns
    ts = parse_timestamp(F.col("reported"))
    out = {
        "event_datetime": ts, "event_date": F.to_date(ts), "year_month": month_key(ts),
        "iz_event_key": X.clean_text(F.col("uuid")), "child_key": X.clean_text(F.col("patient_id")),
    }
    if has("patient_sex"):
        out["sex"] = X.sex_text(F.col("patient_sex"))
    for c in ("patient_age_in_days", "patient_age_in_months", "patient_age_in_years"):
        if has(c):
            out[c] = N.non_negative(F.col(c))
    if has("patient_age_in_days"):
        days = out["patient_age_in_days"]
        out["age_days"] = days
        out["age_months_rebuilt"] = age_months(days)
        out["age_band"] = N.bands(days, *AGE_BANDS_DAYS)
        out["age_consistency_flag"] = age_agrees_flag(out["patient_age_in_months"], age_months(days)) \
            if has("patient_age_in_months") else F.lit(None).cast("int")
    if has("county"):
        out["county_raw"] = F.col("county")
        out["county_clean"] = X.known_name(F.col("county"))
        out["county_valid_flag"] = X.known_name_flag(F.col("county"))
    if has("accuracy"):
        out["gps_accuracy_m"] = N.to_number(F.col("accuracy"))
        out["gps_reliable_flag"] = N.at_most_flag(F.col("accuracy"), 100)
    for c in df.columns:
        if c.startswith(("has_", "needs_", "is_")) or c in ("visited", "client_available"):
            out[c] = X.loose_boolean(F.col(c))
    for c in DAY_DOSES:
        out[c] = F.coalesce(X.loose_boolean(F.col(c)), F.lit(0)) if has(c) else F.lit(0)
    if has("due_count"):
        out["due_count_raw"] = N.non_negative(F.col("due_count"))
    for c in ("follow_up_date", "immunization_follow_up_date"):
        if has(c):
            out[c] = parse_timestamp(F.col(c))
    return add_missing_share(df.withColumns(out))


def silver_supervision(raw: DataFrame) -> DataFrame:
    df = require_columns(X.snake_case_columns(raw), ["uuid", "chw_uuid", "reported"])
    ts = parse_timestamp(F.col("reported"))
    out = {"supervision_event_key": X.clean_text(F.col("uuid")), "chw_key": X.clean_text(F.col("chw_uuid")),
           "supervision_datetime": ts, "year_month": month_key(ts)}
    for c in ("last_visit_date", "next_supervision_visit_date"):
        if c in df.columns:
            out[c] = parse_timestamp(F.col(c))
    for c in ("has_all_tools", "has_proper_protective_equipment", "has_essential_medicines",
              "calc_has_all_tools", "calc_has_proper_protective_equipment"):
        if c in df.columns:
            out[c] = X.loose_boolean(F.col(c))
    for m in ("assessment", "immunization"):
        score, den = f"calc_{m}_score", f"calc_{m}_denominator"
        for c in (score, den):
            if c in df.columns:
                out[c] = N.to_number(F.col(c))
        if {score, den} <= set(df.columns):
            out[f"{m}_score_valid_flag"] = N.positive_flag(F.col(den))
    return add_missing_share(df.withColumns(out))


def silver_registry(raw: DataFrame, tiebreak=None) -> DataFrame:
    """Clean registry rows; with a ``tiebreak``, each row's place in its worker's history too."""
    df = require_columns(X.snake_case_columns(raw), ["chw_uuid", "reported"])
    ts = parse_timestamp(F.col("reported"))
    out = {"chw_key": X.clean_text(F.col("chw_uuid")), "registry_snapshot_datetime": ts, "registry_snapshot_month": month_key(ts)}
    for c in ("chw_name", "chw_area_name", "community_unit", "sub_county_name"):
        if c in df.columns:
            out[c.removesuffix("_name") + "_clean"] = X.clean_text(F.col(c), lower=True)
    county = X.first_present(df, "county_name", "county")
    if county:
        out["county_clean"] = X.known_name(F.col(county))
        out["county_valid_flag"] = X.known_name_flag(F.col(county))
    if tiebreak:
        # Ranking shuffles whole rows: the columns that a row itself gives are added after it.
        keys = {c: out.pop(c) for c in ("chw_key", "registry_snapshot_datetime")}
        ranked = record_rank(df.withColumns(keys), "chw_key", "registry_snapshot_datetime", tiebreak, "chw_registry_record_rank")
        rows = ranked.withColumns(out).select(*dict.fromkeys([*df.columns, *keys, *out, "chw_registry_record_rank"]))
    else:
        rows = df.withColumns(out)
    return add_missing_share(rows.withColumn("is_active_chw", F.lit(1)))


def newest_registry(registry: DataFrame, tiebreak) -> DataFrame:
    """One row per worker with its names and places, for all contexts."""
    newest = latest_rows(registry, ["chw_key"], "registry_snapshot_datetime", tiebreak)
    return newest.select(*[c for c in ("chw_key", "county_clean", "sub_county_clean", "chw_area_clean", "community_unit_clean") if c in newest.columns])


def silver_home_visits(raw: DataFrame) -> DataFrame:
    df = require_columns(X.snake_case_columns(raw), ["chw_uuid", "reported"])
    ts = parse_timestamp(F.col("reported"))
    out = {"chw_key": X.clean_text(F.col("chw_uuid"))}
    if "family_id" in df.columns:
        out["family_key"] = X.clean_text(F.col("family_id"))
    return add_missing_share(df.withColumns(out | {"homevisit_datetime": ts, "year_month": month_key(ts)}))


def silver_population(raw: DataFrame) -> DataFrame:
    df = X.snake_case_columns(raw)
    out = {"chw_key": X.clean_text(F.col("chw_uuid"))} if "chw_uuid" in df.columns else {}
    sizes = [c for c in ("u2_pop", "u5_pop", "wra_pop") if c in df.columns]
    out |= {f"{c}_clean": N.non_negative(F.col(c)) for c in sizes}
    if sizes:
        out["population_context_valid_flag"] = N.any_present_flag(*[N.non_negative(F.col(c)) for c in sizes])
    return add_missing_share(df.withColumns(out))


def month_labels(cohort: DataFrame, visits: DataFrame, tiebreak, schedule=SCHEDULE_DAYS, carry: dict[str, str] | None = None) -> DataFrame:
    """Cohort with the dose flags of the month's newest visit, due list and labels.

    ``carry`` names further columns of that visit to take along, and what to call them.
    """
    newest = latest_rows(visits, ["child_key", "year_month"], "event_datetime", tiebreak)
    doses = [c for c in DAY_DOSES if c in newest.columns]
    more = [F.col(c).alias(name) for c, name in (carry or {}).items()]
    right = newest.select("child_key", F.col("year_month").alias("index_month"), *doses, *more)
    return schedule_labels(left_join(cohort, right, ["child_key", "index_month"]), "age_days", schedule)


def worker_context(sup: DataFrame, hv: DataFrame, newest: DataFrame) -> DataFrame:
    """Supervision and home-visit months side by side, with the newest registry row."""
    both = full_join(A.supervision_months(sup), A.homevisit_months(hv), ["chw_key", "year_month"])
    return left_join(both, newest, "chw_key").withColumnRenamed("year_month", "index_month")


def area_context(pop: DataFrame, newest: DataFrame) -> DataFrame:
    """Population maxima per county and sub-county of the worker's newest registry row."""
    keep = [c for c in ("chw_key", "county_clean", "sub_county_clean") if c in newest.columns]
    joined = left_join(pop, newest.select(*keep), "chw_key") if "chw_key" in pop.columns else pop
    return A.area_population(joined)


def feature_table(labels: DataFrame, workers: DataFrame, areas: DataFrame, tiebreak,
                  area_keys=("county_clean", "sub_county_clean")) -> DataFrame:
    """Label rows with calendar, history, worker and area features.

    The worker key has to be in the label rows, and the worker side gives up the county
    columns that would clash, so both context joins arrive (S15).
    """
    base = require_columns(labels, ["child_key", "index_month", "index_date", "chw_key"])
    base = base.select("*", *calendar_columns(F.col("index_date"))).withColumn(
        "core_fields_complete_flag", N.all_present_flag(F.col("child_key"), F.col("index_month"), F.col("age_days")))
    base = prior_events(base, "child_key", "index_date", tiebreak, "num_due_vaccines_rebuilt", "default_30d")
    clash = [c for c in workers.columns if c in base.columns and c not in ("chw_key", "index_month")]
    joined = left_join(base, workers.drop(*clash), ["chw_key", "index_month"])
    keys = [k for k in area_keys if k in joined.columns and k in areas.columns]
    return left_join(joined, areas, keys) if keys else joined
