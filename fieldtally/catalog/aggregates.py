"""Per-area, per-worker and per-month aggregates and marts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..plans import cleaners as C
from ..plans import person_months as M
from .joins import cohort, narrow_silver, newest_workers, planning, preg_parts, registry_silver
from .registry import query
from .shape import as_of_events, rounded, ts_text

_MONTHS_SINCE = "round(least(greatest(floor((epoch_us(TIMESTAMP '2024-03-01') - epoch_us(chw_last_supervision_date)) / 86400000000.0) / 30.44, 0), 24), 6)"


@query("d01_supervision_by_area", uses="sup_area", sql=f"""
  SELECT chw_area_key, chw_supervision_frequency, strftime(chw_last_supervision_date, '%Y-%m-%d %H:%M:%S') AS chw_last_supervision_date,
    round(chw_immunization_competency, 6) AS chw_immunization_competency_pct, round(chw_overall_assessment_pct, 6) AS chw_overall_assessment_pct,
    chw_has_all_tools, chw_has_ppe, {_MONTHS_SINCE} AS months_since_last_supervision FROM sup_area""")
def _(t):
    out = A.supervision_by_area(C.clean_supervision(t.supervision), as_of_events())
    return rounded(out.withColumn("chw_last_supervision_date", ts_text("chw_last_supervision_date")).drop("chw_immunization_competency"))


@query("d01_supervision_raw_scores", uses="supervision", sql="""
  SELECT chw_area AS chw_area_key, round(avg(calc_immunization_score), 6) AS chw_immunization_competency,
    max(CASE WHEN has_all_tools = 'yes' THEN 1 ELSE 0 END) AS chw_has_all_tools FROM supervision GROUP BY 1""")
def _(t):
    """Without ready percentages and flags the raw score and text are used."""
    out = A.supervision_by_area(t.supervision, as_of_events())
    return rounded(out.select("chw_area_key", "chw_immunization_competency", "chw_has_all_tools"))


@query("d02_median_workload", uses="pop_area", sql="SELECT chw_area_key, round(chw_workload_u2, 6) AS chw_workload_u2 FROM pop_area")
def _(t):
    return rounded(A.workload_by_area(C.clean_population(t.population)))


@query("d02_median_by_worker_large", uses="homevisit", sql="""
  SELECT chw_area AS chw_area_key, round(quantile_cont(CAST(l_partkey AS DOUBLE), 0.5), 6) AS chw_workload_u2 FROM homevisit GROUP BY 1""")
def _(t):
    """The same median over the largest table, with many values per area."""
    return rounded(A.workload_by_area(t.homevisit.withColumn("u2_pop", F.col("l_partkey").cast("double"))))


@query("d03_homevisit_rate", uses="hv_area", sql="""
  SELECT chw_area_key, CAST(total_homevisits AS BIGINT) AS total_homevisits, hv_distinct_months, round(monthly_homevisit_rate, 6) AS monthly_homevisit_rate FROM hv_area""")
def _(t):
    return rounded(A.visit_rate_by_area(C.clean_home_visits(t.homevisit)))


@query("d04_any_yes_household", uses="planning", sql="""
  SELECT contact_parent_id, max(CASE WHEN lower(trim(on_fp)) = 'yes' THEN 1 ELSE 0 END) AS on_fp_binary FROM planning WHERE contact_parent_id IS NOT NULL GROUP BY 1""")
def _(t):
    return A.any_yes(t.planning)


@query("d05_max_over_union", uses="planning", sql="""
  SELECT contact_parent_id, max(CASE lower(trim(on_fp)) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END) AS household_on_fp
  FROM planning WHERE contact_parent_id IS NOT NULL GROUP BY 1""")
def _(t):
    return planning(t)


@query("d06_maternal_means", uses="preg_area", sql="""
  SELECT chw_area_key, round(maternal_anc_visits, 6) AS maternal_anc_visits, round(maternal_anc_defaulter, 6) AS maternal_anc_defaulter,
    round(maternal_muac_risk, 6) AS maternal_muac_risk, round(maternal_iron_folate, 6) AS maternal_iron_folate FROM preg_area""")
def _(t):
    a, b = preg_parts(t)
    return rounded(A.maternal_by_area(a.unionByName(b)))


@query("d06_maternal_raw_columns", uses="preg", sql="""
  SELECT contact_parent_parent_id AS chw_area_key, round(avg(CASE WHEN lower(is_anc_defaulter) IN ('true', 'yes', '1') THEN 1.0 ELSE 0.0 END), 6) AS maternal_anc_defaulter,
    round(avg(CASE WHEN lower(muac_color) = 'green' THEN 0.0 ELSE 1.0 END), 6) AS maternal_muac_risk,
    round(avg(CASE WHEN lower(takes_iron_or_folate_supplements) = 'yes' THEN 1.0 ELSE 0.0 END), 6) AS maternal_iron_folate
  FROM preg WHERE contact_parent_parent_id IS NOT NULL GROUP BY 1""")
def _(t):
    return rounded(A.maternal_by_area(t.preg.drop("number_of_anc_attended")))


@query("d07_person_month_cohort", uses="cohort", sql="""
  SELECT child_key, index_month, strftime(index_date, '%Y-%m-%d %H:%M:%S') AS index_date, sex, age_days, county_clean, county_valid_flag,
    round(row_missingness_pct, 6) AS row_missingness_pct FROM cohort""")
def _(t):
    return rounded(cohort(t).withColumn("index_date", ts_text("index_date")))


@query("d08_observation_mart", uses="slv_iz", sql="""
  SELECT child_key, CAST(date_trunc('month', event_datetime) AS DATE) AS index_month, strftime(min(event_datetime), '%Y-%m-%d %H:%M:%S') AS first_event_datetime,
    strftime(max(event_datetime), '%Y-%m-%d %H:%M:%S') AS last_event_datetime, max(age_days) AS age_days, max(patient_sex) AS sex FROM slv_iz GROUP BY 1, 2""")
def _(t):
    out = A.observation_mart(narrow_silver(t))
    return out.withColumns({c: ts_text(c) for c in ("first_event_datetime", "last_event_datetime")})


@query("d09_worker_month_mart", uses="supervision", sql="""
  SELECT trim(chw_uuid) AS chw_key, CAST(date_trunc('month', reported) AS DATE) AS index_month, count(*) AS supervision_events,
    round(avg(calc_immunization_score), 6) AS mean_immunization_score FROM supervision GROUP BY 1, 2""")
def _(t):
    return rounded(A.worker_month_mart(M.silver_supervision(t.supervision)))


@query("d10_area_month_mart", uses="slv_registry", sql="""
  SELECT county_clean, sub_county_clean, registry_snapshot_month AS index_month, count(DISTINCT chw_key) AS active_chws FROM slv_registry GROUP BY 1, 2, 3""")
def _(t):
    return A.area_month_mart(registry_silver(t))


@query("d11_supervision_months", uses="sup_months", sql="""
  SELECT chw_key, year_month, supervision_events_last_90d, round(mean_immunization_score_90d, 6) AS mean_immunization_score_90d,
    round(pct_tools_available_90d, 6) AS pct_tools_available_90d, days_since_last_supervision FROM sup_months""")
def _(t):
    return rounded(A.supervision_months(M.silver_supervision(t.supervision)))


@query("d11_homevisit_months", uses="hv_months", sql="SELECT * FROM hv_months")
def _(t):
    return A.homevisit_months(M.silver_home_visits(t.homevisit))


@query("d12_area_population", uses="population registry_latest", sql="""
  SELECT r.county_clean, r.sub_county_clean, max(CASE WHEN u2_pop >= 0 THEN u2_pop END) AS u2_population_context,
    max(CASE WHEN u5_pop >= 0 THEN u5_pop END) AS u5_population_context, max(CASE WHEN wra_pop >= 0 THEN wra_pop END) AS wra_population_context
  FROM population p LEFT JOIN registry_latest r ON p.chw_uuid = r.chw_key WHERE r.county_clean IS NOT NULL AND r.sub_county_clean IS NOT NULL GROUP BY 1, 2""")
def _(t):
    return M.area_context(M.silver_population(t.population), newest_workers(t))
