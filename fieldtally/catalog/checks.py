"""Projections, filters, schema and rule checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import CORE_DOSES, INACTIVE_SUPERVISION_COLUMNS
from ..functions.numbers import all_present_flag, missing_share
from ..functions.text import snake_case_columns
from ..operators import checks as K
from ..operators.aggregates import group_prevalence
from ..operators.ranking import at_or_above
from ..operators.splits import in_months
from ..plans.cleaners import clean_population, clean_visits
from ..plans.person_table import add_target, latest_visit_per_month
from .registry import query
from .shape import rounded


@query("b01_snake_case", sql="SELECT o_orderkey AS order_key, o_totalprice AS total_price_usd FROM orders")
def _(t):
    return snake_case_columns(t.orders.select(F.col("o_orderkey").alias(" Order Key "), F.col("o_totalprice").alias("Total-Price (USD)")))


@query("b02_require_columns", sql="SELECT event_id, user_id FROM events")
def _(t):
    return K.require_columns(t.events, ["event_id", "user_id"]).select("event_id", "user_id")


@query("b06_keep_allowed", uses="population", sql="SELECT chw_area, chw_uuid, u2_pop FROM population")
def _(t):
    return clean_population(t.population)


@query("b07_drop_null_only", uses="features", sql="SELECT l_orderkey, price FROM features")
def _(t):
    return K.drop_null_only(t.features.select("l_orderkey", "price", "absent"), ["price", "absent", "not_there"])


@query("b08_drop_inactive", uses="supervision", sql="SELECT event_id, calc_immunization_score FROM supervision")
def _(t):
    return t.supervision.select("event_id", "calc_immunization_score", "calc_cancer_denominator").drop(*INACTIVE_SUPERVISION_COLUMNS)


@query("b09_select_features", uses="iz_clean", sql="""
  SELECT visit_no, patient_age_in_months, due_count_clean, CAST(patient_sex_binary AS DOUBLE) AS patient_sex_binary,
    CAST(has_bcg AS DOUBLE) AS has_bcg, CAST(NULL AS DOUBLE) AS chw_workload_u2, CAST(NULL AS DOUBLE) AS county_encoded, 50 AS n_features FROM iz_clean""")
def _(t):
    x = K.select_features(clean_visits(t.iz), ["visit_no"])
    return x.select("visit_no", "patient_age_in_months", "due_count_clean", "patient_sex_binary", "has_bcg", "chw_workload_u2",
                    "county_encoded", F.lit(len(x.columns) - 1).alias("n_features"))


USABLE = ["patient_age_in_months", "due_count_clean", "patient_sex_binary", *CORE_DOSES]


@query("b10_drop_null_features", uses="iz_clean", sql=" UNION ALL ".join(
    f"SELECT '{f}' AS feature, '{'numeric' if i < 2 else 'binary'}' AS kind, count({f}) AS n FROM iz_clean" for i, f in enumerate(USABLE)))
def _(t):
    """Every feature that has a value, with its kind and values; the other features are dropped."""
    x = K.select_features(clean_visits(t.iz))
    kinds = [(f, k) for k, names in K.usable_features(x).items() for f in names]
    row = x.agg(*[F.count(f).alias(f) for f, _ in kinds])
    return row.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(k).alias("kind"), F.col(f).alias("n")) for f, k in kinds])))


@query("b11_reindex_scoring", uses="features", sql="""
  SELECT CAST(quantity AS DOUBLE) AS quantity, CAST(NULL AS DOUBLE) AS not_seen, price FROM features""")
def _(t):
    return K.select_features(t.features, features=["quantity", "not_seen", "price"])


@query("b12_risk_threshold", uses="scored", sql="SELECT l_orderkey, l_linenumber, l_partkey, p FROM scored WHERE p >= 0.7")
def _(t):
    return at_or_above(t.scored.select("l_orderkey", "l_linenumber", "l_partkey", "p"), "p", 0.7)


@query("b13_min_group_size", uses="iz_target", sql="""
  SELECT county, count(*) AS n, sum(is_defaulter)::BIGINT AS positives, round(avg(is_defaulter), 6) AS rate
  FROM iz_target WHERE county IS NOT NULL GROUP BY 1 HAVING count(*) >= 20""")
def _(t):
    return rounded(group_prevalence(target_rows(t), "county", "is_defaulter", 20))


def target_rows(t):
    return add_target(latest_visit_per_month(clean_visits(t.iz), ["visit_no"]))


@query("b14_range_violations", uses="iz_clean", sql="""
  SELECT 'patient_age_in_months' AS rule, count(*) AS violations FROM iz_clean WHERE patient_age_in_months < 0 OR patient_age_in_months > 60 HAVING count(*) > 0
  UNION ALL SELECT 'monthly_homevisit_rate', count(*) FROM iz_clean WHERE due_count - 1 < 0 HAVING count(*) > 0
  UNION ALL SELECT 'due_count_clean', count(*) FROM iz_clean WHERE due_count_clean * 9 > 20 HAVING count(*) > 0""")
def _(t):
    x = clean_visits(t.iz)
    return K.rule_violations(x.select("patient_age_in_months", (F.col("due_count_clean") * 9).alias("due_count_clean"),
                                      (F.col("due_count") - 1).alias("monthly_homevisit_rate"), "has_bcg"))


@query("b14_quarantined_rows", uses="iz_clean", sql="""
  SELECT visit_no, 'due_count_clean' AS failed_rules FROM iz_clean WHERE due_count_clean * 9 > 20""")
def _(t):
    x = clean_visits(t.iz).select("visit_no", (F.col("due_count_clean") * 9).alias("due_count_clean"), "has_bcg")
    return K.rule_failures(x).filter(F.size("failed_rules") > 0).select("visit_no", F.array_join("failed_rules", ";").alias("failed_rules"))


@query("b15_dataset_checks", uses="iz_target", sql="""
  SELECT count(*) AS n_rows, count(DISTINCT visit_no) AS n_keys, sum(is_defaulter)::BIGINT AS positives, 0::BIGINT AS invalid_targets,
    (count(*) - count(DISTINCT visit_no))::BIGINT AS repeated_keys, round(avg(is_defaulter), 6) AS positive_rate, 1 AS key_unique, 1 AS target_valid,
    CASE WHEN avg(is_defaulter) BETWEEN 0.02 AND 0.95 THEN 0 ELSE 1 END AS odd_positive_rate FROM iz_target""")
def _(t):
    return rounded(K.dataset_checks(target_rows(t), "visit_no", "is_defaulter"))


@query("b16_month_filter", uses="iz_clean", sql="SELECT visit_no, month_clean FROM iz_clean WHERE month_clean IN ('2098-01', '2098-02', '2099-12')")
def _(t):
    return in_months(clean_visits(t.iz).select("visit_no", "month_clean"), "month_clean", ["2098-01", "2098-02", "2099-12"])


@query("b17_core_complete_flag", uses="slv_iz", sql="""
  SELECT visit_no, CASE WHEN child_key IS NOT NULL AND year_month IS NOT NULL AND age_days IS NOT NULL THEN 1 ELSE 0 END AS core_fields_complete_flag FROM slv_iz""")
def _(t):
    from ..plans.person_months import silver_visits
    s = silver_visits(t.iz)
    return s.select("visit_no", all_present_flag(F.col("child_key"), F.col("year_month"), F.col("age_days")).alias("core_fields_complete_flag"))


@query("b18_row_missing_share", uses="iz", sql="""
  SELECT visit_no, round(CAST((month IS NULL)::INT + (county IS NULL)::INT + (patient_sex IS NULL)::INT + (uuid IS NULL)::INT AS DOUBLE) / 4, 6) AS row_missingness_pct FROM iz""")
def _(t):
    return rounded(t.iz.select("visit_no", missing_share(*[F.col(c) for c in ("month", "county", "patient_sex", "uuid")]).alias("row_missingness_pct")))
