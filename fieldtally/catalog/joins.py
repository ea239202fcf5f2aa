"""Joins, match reports and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import missing_share
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators.latest import latest_rows
from ..plans import cleaners as C
from ..plans import person_months as M
from ..plans.person_table import (
    add_target, household_planning, join_audit_label, join_maternal, join_registry, latest_visit_per_month,
)
from ..session import fresh_path
from ..sources.tables import layer
from .registry import query
from .scans import person_tables
from .shape import as_of_events, rounded

REG_KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]
REG_LATEST = """reg AS (SELECT chw_area_uuid, community_unit, county_name, sub_county_name FROM registry
  QUALIFY row_number() OVER (PARTITION BY chw_area_uuid ORDER BY reported DESC NULLS LAST, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) = 1)"""


def visits(t):
    """Latest visit per person and month, with the area key."""
    iz = latest_visit_per_month(C.clean_visits(t.iz), ["visit_no"])
    return iz.select("visit_no", "patient_id", "contact_parent_id", "needs_follow_up_binary", "due_count_clean",
                     "vaccines_due_missed", "month_clean", F.col("contact_parent_id").alias("chw_area_key"))


def supervision_area(t):
    return A.supervision_by_area(C.clean_supervision(t.supervision), as_of_events())


@query("c01_join_registry", uses="iz_latest registry", sql=f"""WITH {REG_LATEST}
  SELECT v.visit_no, r.community_unit, r.county_name, r.sub_county_name FROM iz_latest v LEFT JOIN reg r ON v.contact_parent_id = r.chw_area_uuid""")
def _(t):
    reg = C.clean_registry(t.registry)
    return join_registry(visits(t).drop("chw_area_key"), reg, REG_KEYS).select("visit_no", "community_unit", "county_name", "sub_county_name")


@query("c02_join_supervision", uses="iz_latest sup_area", sql="""
  SELECT v.visit_no, s.chw_supervision_frequency, round(s.chw_immunization_competency, 6) AS chw_immunization_competency_pct,
    round(s.chw_overall_assessment_pct, 6) AS chw_overall_assessment_pct, s.chw_has_all_tools, s.chw_has_ppe
  FROM iz_latest v LEFT JOIN sup_area s ON v.contact_parent_id = s.chw_area_key""")
def _(t):
    return rounded(J.left_join(visits(t), supervision_area(t), "chw_area_key").select(
        "visit_no", "chw_supervision_frequency", "chw_immunization_competency_pct", "chw_overall_assessment_pct", "chw_has_all_tools", "chw_has_ppe"))


@query("c03_join_workload", uses="iz_latest pop_area", sql="""
  SELECT v.visit_no, round(p.chw_workload_u2, 6) AS chw_workload_u2 FROM iz_latest v LEFT JOIN pop_area p ON v.contact_parent_id = p.chw_area_key""")
def _(t):
    return rounded(J.left_join(visits(t), A.workload_by_area(C.clean_population(t.population)), "chw_area_key").select("visit_no", "chw_workload_u2"))


@query("c04_join_visit_rate", uses="iz_latest hv_area", sql="""
  SELECT v.visit_no, round(h.monthly_homevisit_rate, 6) AS monthly_homevisit_rate FROM iz_latest v LEFT JOIN hv_area h ON v.contact_parent_id = h.chw_area_key""")
def _(t):
    rate = A.visit_rate_by_area(C.clean_home_visits(t.homevisit)).select("chw_area_key", "monthly_homevisit_rate")
    again = A.visit_rate_by_area(rate.withColumnRenamed("chw_area_key", "chw_area"))  # ready rates pass through
    return rounded(J.left_join(visits(t), again, "chw_area_key").select("visit_no", "monthly_homevisit_rate"))


def preg_parts(t):
    p = C.clean_pregnancies(t.preg)
    return p.filter("reported < '1998-01-01'"), p.filter("reported >= '1998-01-01'")


@query("c05_join_maternal", uses="iz_latest preg_area", sql="""
  SELECT v.visit_no, round(maternal_anc_visits, 6) AS maternal_anc_visits, round(maternal_anc_defaulter, 6) AS maternal_anc_defaulter,
    round(maternal_muac_risk, 6) AS maternal_muac_risk, round(maternal_iron_folate, 6) AS maternal_iron_folate
  FROM iz_latest v LEFT JOIN preg_area m ON v.contact_parent_id = m.chw_area_key""")
def _(t):
    return rounded(join_maternal(visits(t), *preg_parts(t)).select("visit_no", *A.MATERNAL))


@query("c05_maternal_without_area_key", uses="iz_latest", sql="SELECT visit_no, NULL::DOUBLE AS maternal_anc_visits FROM iz_latest")
def _(t):
    """No usable area column: the maternal columns stay null."""
    a, b = preg_parts(t)
    keyless = [p.drop("contact_parent_parent_id") for p in (a, b)]
    return join_maternal(visits(t), *keyless).select("visit_no", "maternal_anc_visits")


AUDIT = """audit AS (SELECT patient_id, CASE lower(trim(is_immunization_defaulter)) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS lab FROM pnc
  WHERE is_immunization_defaulter IS NOT NULL QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY record_no) = 1)"""


def pnc(t):
    return C.clean_postnatal(t.pnc)


@query("c06_join_audit_label", uses="iz_latest pnc", sql=f"WITH {AUDIT} SELECT v.visit_no, a.lab AS _pnc_iz_defaulter FROM iz_latest v LEFT JOIN audit a USING (patient_id)")
def _(t):
    return join_audit_label(visits(t), pnc(t), ["record_no"]).select("visit_no", "_pnc_iz_defaulter")


PLANNING = """fp AS (SELECT contact_parent_id AS k, max(CASE lower(trim(on_fp)) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END) AS household_on_fp
  FROM planning WHERE contact_parent_id IS NOT NULL GROUP BY 1)"""


def planning(t):
    p = C.clean_family_planning(t.planning)
    return household_planning(p.filter("o_orderstatus = 'F'"), p.filter("o_orderstatus != 'F'"))


@query("c07_join_household_planning", uses="iz_latest planning", sql=f"WITH {PLANNING} SELECT v.visit_no, f.household_on_fp FROM iz_latest v LEFT JOIN fp f ON v.contact_parent_id = f.k")
def _(t):
    return J.left_join(visits(t), planning(t), "contact_parent_id").select("visit_no", "household_on_fp")


def narrow_silver(t):
    """Silver visits without the doses the month labels do not use."""
    s = M.silver_visits(t.iz.drop(*[c for c in t.iz.columns if c.startswith(("has_malaria", "has_vitamin"))]))
    return s.withColumn("row_missingness_pct", missing_share(F.col("month"), F.col("county_raw"), F.col("patient_sex")))


def cohort(t):
    return A.person_month_cohort(narrow_silver(t), "visit_no")


@query("c08_join_month_status", uses="cohort slv_iz", sql="""
  WITH newest AS (SELECT * FROM slv_iz QUALIFY row_number() OVER (PARTITION BY child_key, year_month ORDER BY event_datetime DESC NULLS LAST, visit_no DESC) = 1)
  SELECT c.child_key, c.index_month, c.age_days, n.has_bcg, n.has_penta_1, n.has_penta_3, n.has_measles_9_months
  FROM cohort c LEFT JOIN newest n ON c.child_key = n.child_key AND c.index_month = n.year_month""")
def _(t):
    return M.month_labels(cohort(t), narrow_silver(t), ["visit_no"]).select(
        "child_key", "index_month", "age_days", "has_bcg", "has_penta_1", "has_penta_3", "has_measles_9_months")


CONTEXT_COLS = """coalesce(s.chw_key, h.chw_key) AS chw_key, coalesce(s.year_month, h.year_month) AS year_month, s.supervision_events_last_90d,
    round(s.mean_immunization_score_90d, 6) AS mean_immunization_score_90d, h.homevisit_count_30d"""


@query("c09_full_outer_months", uses="sup_months hv_months", sql=f"""
  SELECT {CONTEXT_COLS} FROM sup_months s FULL OUTER JOIN hv_months h ON s.chw_key = h.chw_key AND s.year_month = h.year_month""")
def _(t):
    both = J.full_join(A.supervision_months(M.silver_supervision(t.supervision)), A.homevisit_months(M.silver_home_visits(t.homevisit)), ["chw_key", "year_month"])
    return rounded(both.select("chw_key", "year_month", "supervision_events_last_90d", "mean_immunization_score_90d", "homevisit_count_30d"))


def registry_silver(t):
    return M.silver_registry(t.registry)


def newest_workers(t):
    return M.newest_registry(registry_silver(t), REG_KEYS)


def worker_context(t, newest=None):
    return M.worker_context(M.silver_supervision(t.supervision), M.silver_home_visits(t.homevisit), newest_workers(t) if newest is None else newest)


@query("c10_join_registry_context", uses="sup_months hv_months registry_latest", sql="""
  WITH b AS (SELECT coalesce(s.chw_key, h.chw_key) AS chw_key, coalesce(s.year_month, h.year_month) AS index_month, s.pct_tools_available_90d, h.homevisit_count_90d
    FROM sup_months s FULL OUTER JOIN hv_months h ON s.chw_key = h.chw_key AND s.year_month = h.year_month)
  SELECT b.chw_key, index_month, round(pct_tools_available_90d, 6) AS pct_tools_available_90d, homevisit_count_90d, r.county_clean, r.sub_county_clean, r.chw_area_clean, r.community_unit_clean
  FROM b LEFT JOIN registry_latest r ON b.chw_key = r.chw_key""")
def _(t):
    return rounded(worker_context(t).select("chw_key", "index_month", "pct_tools_available_90d", "homevisit_count_90d", "county_clean",
                                            "sub_county_clean", "chw_area_clean", "community_unit_clean"))


@query("c11_population_registry", uses="population registry_latest", sql="""
  SELECT p.c_custkey, r.county_clean, r.sub_county_clean FROM population p LEFT JOIN registry_latest r ON p.chw_uuid = r.chw_key""")
def _(t):
    newest = newest_workers(t).select("chw_key", "county_clean", "sub_county_clean")
    return J.left_join(M.silver_population(t.population), newest, "chw_key").select("c_custkey", "county_clean", "sub_county_clean")


def labelled(t):
    """Child-month labels with the worker key of the month's newest visit."""
    return M.month_labels(cohort(t), narrow_silver(t), ["visit_no"], carry={"contact_parent_id": "chw_key"})


LABELLED = """newest AS (SELECT * FROM slv_iz QUALIFY row_number() OVER (PARTITION BY child_key, year_month ORDER BY event_datetime DESC NULLS LAST, visit_no DESC) = 1),
  lab AS (SELECT c.*, n.chw_key FROM cohort c LEFT JOIN newest n ON c.child_key = n.child_key AND c.index_month = n.year_month),
  areas AS (SELECT r.county_clean, r.sub_county_clean, max(CASE WHEN u2_pop >= 0 THEN u2_pop END) AS u2, max(CASE WHEN u5_pop >= 0 THEN u5_pop END) AS u5,
      max(CASE WHEN wra_pop >= 0 THEN wra_pop END) AS wra
    FROM population p LEFT JOIN registry_latest r ON p.chw_uuid = r.chw_key WHERE r.county_clean IS NOT NULL AND r.sub_county_clean IS NOT NULL GROUP BY 1, 2)"""


@query("c12_join_worker_context", uses="cohort slv_iz hv_months", sql="""
  WITH newest AS (SELECT * FROM slv_iz QUALIFY row_number() OVER (PARTITION BY child_key, year_month ORDER BY event_datetime DESC NULLS LAST, visit_no DESC) = 1)
  SELECT c.child_key, c.index_month, n.chw_key, h.homevisit_count_30d FROM cohort c
  LEFT JOIN newest n ON c.child_key = n.child_key AND c.index_month = n.year_month
  LEFT JOIN hv_months h ON n.chw_key = h.chw_key AND c.index_month = h.year_month""")
def _(t):
    joined = J.left_join(labelled(t), worker_context(t).drop("county_clean"), ["chw_key", "index_month"])
    return joined.select("child_key", "index_month", "chw_key", "homevisit_count_30d")


@query("c13_join_area_context", uses="population registry_latest", sql="""
  WITH areas AS (SELECT r.county_clean, r.sub_county_clean, max(CASE WHEN u2_pop >= 0 THEN u2_pop END) AS u2, max(CASE WHEN u5_pop >= 0 THEN u5_pop END) AS u5
    FROM population p LEFT JOIN registry_latest r ON p.chw_uuid = r.chw_key WHERE r.county_clean IS NOT NULL AND r.sub_county_clean IS NOT NULL GROUP BY 1, 2)
  SELECT r.chw_key, r.county_clean, r.sub_county_clean, a.u2 AS u2_population_context, a.u5 AS u5_population_context
  FROM registry_latest r LEFT JOIN areas a ON r.county_clean = a.county_clean AND r.sub_county_clean = a.sub_county_clean""")
def _(t):
    newest = newest_workers(t)
    areas = M.area_context(M.silver_population(t.population), newest)
    base = newest.select("chw_key", "county_clean", "sub_county_clean")
    return J.left_join(base, areas, ["county_clean", "sub_county_clean"]).drop("wra_population_context")


@query("c13_feature_table", uses="cohort slv_iz hv_months registry_latest population", sql=f"""WITH {LABELLED}
  SELECT lab.child_key, lab.index_month, lab.chw_key, CAST(month(lab.index_date) AS INT) AS index_month_num, h.homevisit_count_30d, r.sub_county_clean,
    a.u2 AS u2_population_context, lab.county_clean FROM lab
  LEFT JOIN hv_months h ON lab.chw_key = h.chw_key AND lab.index_month = h.year_month
  LEFT JOIN registry_latest r ON lab.chw_key = r.chw_key AND h.chw_key IS NOT NULL
  LEFT JOIN areas a ON lab.county_clean = a.county_clean AND r.sub_county_clean = a.sub_county_clean""")
def _(t):
    """The whole person-month feature table; the label layer is written first, as later steps read it more than once."""
    newest = layer(newest_workers(t), fresh_path(t.spark, "workers") + ".parquet")
    areas = M.area_context(M.silver_population(t.population), newest)
    labels = layer(labelled(t), fresh_path(t.spark, "labels") + ".parquet")
    ft = M.feature_table(labels, worker_context(t, newest), areas, ["index_month"])
    return ft.select("child_key", "index_month", "chw_key", "index_month_num", "homevisit_count_30d", "sub_county_clean", "u2_population_context", "county_clean")


@query("c14_match_rates", uses="iz_latest registry sup_area pop_area hv_area preg_area", sql=f"""WITH {REG_LATEST},
  x AS (SELECT r.community_unit, s.chw_supervision_frequency, p.chw_workload_u2, h.monthly_homevisit_rate, m.maternal_anc_visits FROM iz_latest v
    LEFT JOIN reg r ON v.contact_parent_id = r.chw_area_uuid LEFT JOIN sup_area s ON v.contact_parent_id = s.chw_area_key
    LEFT JOIN pop_area p ON v.contact_parent_id = p.chw_area_key LEFT JOIN hv_area h ON v.contact_parent_id = h.chw_area_key
    LEFT JOIN preg_area m ON v.contact_parent_id = m.chw_area_key)
  SELECT j AS join_name, CASE j WHEN 'registry' THEN count(community_unit) WHEN 'supervision' THEN count(chw_supervision_frequency) WHEN 'population' THEN count(chw_workload_u2)
      WHEN 'homevisit' THEN count(monthly_homevisit_rate) ELSE count(maternal_anc_visits) END AS matched, count(*) AS total,
    round(CASE j WHEN 'registry' THEN count(community_unit) WHEN 'supervision' THEN count(chw_supervision_frequency) WHEN 'population' THEN count(chw_workload_u2)
      WHEN 'homevisit' THEN count(monthly_homevisit_rate) ELSE count(maternal_anc_visits) END / count(*), 6) AS match_rate
  FROM x, (SELECT unnest(['registry','supervision','population','homevisit','maternal']) AS j) GROUP BY j""")
def _(t):
    tabs = person_tables(t)
    df = join_registry(visits(t).drop("chw_area_key"), tabs["active_chps"], REG_KEYS)
    df = J.left_join(df, A.supervision_by_area(tabs["supervision"], as_of_events()), "chw_area_key")
    df = J.left_join(df, A.workload_by_area(tabs["population"]), "chw_area_key")
    df = J.left_join(df, A.visit_rate_by_area(tabs["homevisit"]), "chw_area_key")
    df = join_maternal(df, tabs["preg_reg"], tabs["preg_reg2"])
    return rounded(J.match_report(df, {"registry": "community_unit", "supervision": "chw_supervision_frequency", "population": "chw_workload_u2",
                                       "homevisit": "monthly_homevisit_rate", "maternal": "maternal_anc_visits"}))


@query("c15_label_agreement", uses="iz_target pnc", sql=f"""WITH {AUDIT}
  SELECT count(*) AS matched, round(avg(CASE WHEN v.is_defaulter = a.lab THEN 1.0 ELSE 0.0 END), 6) AS agreement,
    CASE WHEN avg(CASE WHEN v.is_defaulter = a.lab THEN 1.0 ELSE 0.0 END) < 0.7 THEN 1 ELSE 0 END AS low_agreement
  FROM iz_target v JOIN audit a USING (patient_id)""")
def _(t):
    return rounded(J.agreement(join_audit_label(add_target(visits(t)), pnc(t), ["record_no"]), "is_defaulter", "_pnc_iz_defaulter"))


@query("g01_union_common", uses="preg", sql="SELECT record_no, contact_parent_parent_id, muac_color FROM preg")
def _(t):
    a = t.preg.filter("reported < '1998-01-01'").select("record_no", "contact_parent_parent_id", "muac_color", "reported")
    b = t.preg.filter("reported >= '1998-01-01'").select("muac_color", "contact_parent_parent_id", "record_no", "is_anc_defaulter")
    return J.union_common(a, b)


@query("g02_union_planning", uses="planning", sql=f"WITH {PLANNING} SELECT k AS contact_parent_id, household_on_fp FROM fp")
def _(t):
    return planning(t)
