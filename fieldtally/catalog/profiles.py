"""Profiles, prevalence tables and dashboard aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import AGE_BANDS_MONTHS, CORE_DOSES, MALARIA_DOSES
from ..functions.numbers import bands, missing_share
from ..functions.risk import score_tier
from ..operators import aggregates as A
from ..operators import checks as K
from ..operators import profiles as P
from ..operators import ranking as R
from ..operators.joins import left_join
from ..operators.quantiles import exact_median
from ..plans.cleaners import clean_home_visits, clean_population, clean_visits
from .checks import target_rows
from .joins import supervision_area, visits
from .registry import query
from .shape import rounded


@query("d13_subgroup_risk", uses="scored", sql="""
  SELECT CASE WHEN county_code = 3 THEN NULL ELSE county_code END AS county_code, count(*) AS n, round(avg(p), 6) AS mean_predicted_risk FROM scored GROUP BY 1""")
def _(t):
    """The null group is kept."""
    x = t.scored.select(F.nullif(F.col("county_code"), F.lit(3)).alias("county_code"), F.col("p").alias("predicted_risk"))
    return rounded(A.subgroup_risk(x, "county_code"))


@query("d14_scoring_monitor", uses="scored", sql="""
  SELECT count(*) AS n_scored, round(avg(p), 6) AS mean_predicted_risk, round(avg(CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS pct_high_risk FROM scored""")
def _(t):
    return rounded(t.scored.agg(F.count("*").alias("n_scored"), F.avg("p").alias("mean_predicted_risk"),
                                F.avg((F.col("p") >= 0.5).cast("double")).alias("pct_high_risk")))


_MEANS = ("price", "quantity", "discount", "even", "unit_price")


@query("d15_mean_comparison", uses="features", sql=" UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(avg({f}) FILTER (event_datetime < '1998-01-01'), 6) AS reference_mean, round(avg({f}) FILTER (event_datetime >= '1998-01-01'), 6) AS current_mean FROM features" for f in _MEANS))
def _(t):
    x = t.features.select(*_MEANS, "event_datetime")
    return rounded(P.mean_comparison(x.filter("event_datetime < '1998-01-01'").drop("event_datetime"), x.filter("event_datetime >= '1998-01-01'").drop("event_datetime")))


FEATURES = ["price", "quantity", "discount", "even", "constant", "absent", "unit_price"]


def _report_sql(f, group):
    return (f"SELECT '{f}' AS feature, {group} AS feature_group, round(100.0 * avg(CASE WHEN {f} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_pct, "
            f"count(DISTINCT {f}) AS n_unique, round(avg({f}), 6) AS mean, round(stddev_samp({f}), 6) AS std FROM features")


GROUPS = {"amounts": ("price", "unit_price"), "flags": ("even",)}
REPORT_SQL = " UNION ALL ".join(
    _report_sql(f, next((f"'{g}'" for g, n in GROUPS.items() if f in n), "NULL")) for f in FEATURES)


@query("d16_feature_report", uses="features", sql=REPORT_SQL)
def _(t):
    return rounded(P.feature_report(t.features, FEATURES, GROUPS))


@query("d16_feature_headline", uses="features", sql=f"""WITH r AS ({REPORT_SQL})
  SELECT count(*) FILTER (null_pct > 50) AS over_50_null, count(*) FILTER (null_pct = 0) AS fully_present, count(*) FILTER (std = 0) AS zero_variance FROM r""")
def _(t):
    return P.feature_headline(P.feature_report(t.features, FEATURES))


def _profile_sql(table, cols):
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_share, count(DISTINCT {c}) AS n_unique FROM {table}" for c in cols)


PROFILED = ["county", "month", "patient_sex", "accuracy", "patient_id", "contact_parent_id", "visit_no", "reported", *CORE_DOSES, *(c for c in MALARIA_DOSES if c not in CORE_DOSES)]


@query("d17_missingness_profile", uses="iz", sql=_profile_sql("iz", PROFILED))
def _(t):
    return rounded(P.column_profile(t.iz, PROFILED))


_AUDITED = {"price": "double", "absent": "double", "even": "int", "discount": "double", "quantity": "double", "constant": "int", "unit_price": "double"}


@query("d18_completeness_audit", uses="features", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(100.0 * avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_pct, count(DISTINCT {c}) AS n_unique, '{k}' AS dtype FROM features"
    for c, k in _AUDITED.items()))
def _(t):
    return rounded(P.completeness_audit(t.features.select(*_AUDITED)))


@query("d18_completeness_headline", uses="features", sql=f"""
  WITH m AS ({" UNION ALL ".join(f"SELECT avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS x FROM features" for c in _AUDITED)})
  SELECT count(*) FILTER (x > 0.8) AS over_80_missing, count(*) FILTER (x = 0) AS fully_present, count(*) AS n_columns FROM m""")
def _(t):
    return P.completeness_headline(P.completeness_audit(t.features.select(*_AUDITED)))


@query("d19_dataset_headline", uses="iz_target", sql="""
  SELECT count(*) AS n_rows, count(DISTINCT patient_id) AS n_patients, count(DISTINCT contact_parent_id) AS n_areas, count(DISTINCT county) AS n_counties,
    count(DISTINCT month_clean) AS n_months, min(month_clean) AS first_month, max(month_clean) AS last_month, round(avg(is_defaulter), 6) AS positive_share,
    round(avg(1 - is_defaulter), 6) AS negative_share FROM iz_target""")
def _(t):
    return rounded(P.headline(target_rows(t), "patient_id", "contact_parent_id", "county", "month_clean", "is_defaulter"))


_DOSES = CORE_DOSES + tuple(c for c in MALARIA_DOSES if c not in CORE_DOSES)


@query("d20_flag_coverage", uses="iz", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS vaccine, sum({c})::BIGINT AS received_n, round(100.0 * avg({c}), 6) AS pct_received, round(100.0 * avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS pct_null FROM iz" for c in _DOSES))
def _(t):
    return rounded(P.flag_coverage(t.iz, _DOSES))


@query("d21_value_counts_null", uses="iz", sql="SELECT lower(patient_sex) AS value, count(*) AS n FROM iz GROUP BY 1")
def _(t):
    return P.value_counts_with_null(t.iz, F.lower("patient_sex"))


@query("d22_describe_age", uses="iz_clean", sql="""
  SELECT count(patient_age_in_months) AS n, round(avg(patient_age_in_months), 6) AS mean, round(stddev_samp(patient_age_in_months), 6) AS std, min(patient_age_in_months) AS min,
    quantile_cont(patient_age_in_months, 0.25) AS q1, quantile_cont(patient_age_in_months, 0.5) AS median, quantile_cont(patient_age_in_months, 0.75) AS q3, max(patient_age_in_months) AS max FROM iz_clean""")
def _(t):
    return rounded(P.describe(clean_visits(t.iz), "patient_age_in_months"))


@query("d23_county_coverage", uses="iz_target", sql="""
  SELECT county, count(DISTINCT patient_id) AS patients, count(DISTINCT contact_parent_id) AS chw_areas, round(100.0 * avg(is_defaulter), 6) AS defaulter_rate
  FROM iz_target WHERE county IS NOT NULL GROUP BY 1""")
def _(t):
    return rounded(P.county_coverage(target_rows(t), "county", "patient_id", "contact_parent_id", "is_defaulter"))


@query("d24_monthly_coverage", uses="iz_target", sql="""
  SELECT month_clean, count(*) AS n, sum(is_defaulter)::BIGINT AS positives, round(avg(is_defaulter), 6) AS positive_rate FROM iz_target WHERE month_clean IS NOT NULL GROUP BY 1""")
def _(t):
    return rounded(A.monthly_coverage(target_rows(t), "month_clean", "is_defaulter"))


def context_rows(t):
    df = left_join(visits(t), supervision_area(t), "chw_area_key")
    df = left_join(df, A.workload_by_area(clean_population(t.population)), "chw_area_key")
    return left_join(df, A.visit_rate_by_area(clean_home_visits(t.homevisit)), "chw_area_key")


@query("d25_linkage_quality", uses="iz_latest sup_area pop_area hv_area", sql="""
  WITH x AS (SELECT s.chw_supervision_frequency, p.chw_workload_u2, h.monthly_homevisit_rate FROM iz_latest v LEFT JOIN sup_area s ON v.contact_parent_id = s.chw_area_key
    LEFT JOIN pop_area p ON v.contact_parent_id = p.chw_area_key LEFT JOIN hv_area h ON v.contact_parent_id = h.chw_area_key)
  SELECT f AS feature, round((1 - CASE f WHEN 'chw_supervision_frequency' THEN count(chw_supervision_frequency) WHEN 'chw_workload_u2' THEN count(chw_workload_u2)
      WHEN 'monthly_homevisit_rate' THEN count(monthly_homevisit_rate) ELSE 0 END / count(*)) * 100, 6) AS null_pct,
    CASE f WHEN 'chw_supervision_frequency' THEN count(chw_supervision_frequency) WHEN 'chw_workload_u2' THEN count(chw_workload_u2)
      WHEN 'monthly_homevisit_rate' THEN count(monthly_homevisit_rate) ELSE 0 END AS linked_n,
    round(CASE f WHEN 'chw_supervision_frequency' THEN avg(chw_supervision_frequency) WHEN 'chw_workload_u2' THEN avg(chw_workload_u2)
      WHEN 'monthly_homevisit_rate' THEN avg(monthly_homevisit_rate) END, 6) AS mean_value
  FROM x, (SELECT unnest(['chw_supervision_frequency', 'chw_workload_u2', 'monthly_homevisit_rate', 'not_joined']) AS f) GROUP BY f""")
def _(t):
    return rounded(P.linkage_quality(context_rows(t), ["chw_supervision_frequency", "chw_workload_u2", "monthly_homevisit_rate", "not_joined"]))


SUB_FLAGS = ["_target_needs_fu", "_target_due_pos", "_target_missed_flag"]


@query("d26_flag_prevalence", uses="iz_target", sql=" UNION ALL ".join(
    f"SELECT '{f}' AS sub_flag, sum({f})::BIGINT AS positive_n, round(100.0 * avg({f}), 6) AS positive_pct FROM iz_target" for f in SUB_FLAGS))
def _(t):
    return rounded(P.flag_prevalence(target_rows(t), SUB_FLAGS))


@query("d27_cross_tab", uses="iz_target", sql="""
  SELECT coalesce(CAST(_target_needs_fu AS VARCHAR), 'All') AS _target_needs_fu, sum(CASE WHEN _target_due_pos = 0 THEN 1 ELSE 0 END)::BIGINT AS _target_due_pos_0,
    sum(CASE WHEN _target_due_pos = 1 THEN 1 ELSE 0 END)::BIGINT AS _target_due_pos_1, count(*) AS _target_due_pos_all
  FROM iz_target GROUP BY ROLLUP (_target_needs_fu)""")
def _(t):
    return P.cross_tab(target_rows(t), "_target_needs_fu", "_target_due_pos", [0, 1])


@query("d28_flags_set", uses="iz_target", sql="""
  SELECT _target_needs_fu + _target_due_pos + _target_missed_flag AS flags_set, count(*) AS n FROM iz_target GROUP BY 1 HAVING flags_set > 0""")
def _(t):
    return P.flags_set(target_rows(t), SUB_FLAGS)


_BANDS = "CASE " + " ".join(f"WHEN patient_age_in_months > {a} AND patient_age_in_months <= {b} THEN '{n}'" for a, b, n in zip(
    AGE_BANDS_MONTHS[0][:-1], AGE_BANDS_MONTHS[0][1:], AGE_BANDS_MONTHS[1])) + " END"


@query("d29_prevalence_by_age", uses="iz_target", sql=f"""
  SELECT {_BANDS} AS age_band, count(*) AS n, sum(is_defaulter)::BIGINT AS positives, round(avg(is_defaulter), 6) AS rate FROM iz_target GROUP BY 1 HAVING age_band IS NOT NULL""")
def _(t):
    x = target_rows(t).withColumn("age_band", bands(F.col("patient_age_in_months"), *AGE_BANDS_MONTHS))
    return rounded(A.group_prevalence(x, "age_band", "is_defaulter"))


@query("d30_prevalence_by_county", uses="iz_target", sql="""
  SELECT contact_parent_id, count(*) AS n, sum(is_defaulter)::BIGINT AS positives, round(avg(is_defaulter), 6) AS rate FROM iz_target
  WHERE contact_parent_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 140""")
def _(t):
    return rounded(A.group_prevalence(target_rows(t), "contact_parent_id", "is_defaulter", 140))


@query("d30_county_headline", uses="iz_target", sql="""
  WITH g AS (SELECT contact_parent_id, avg(is_defaulter) AS rate FROM iz_target GROUP BY 1 HAVING count(*) >= 20)
  SELECT count(*) AS n_counties, count(*) FILTER (rate > 0.8) AS above, count(*) FILTER (rate < 0.75) AS below FROM g""")
def _(t):
    g = A.group_prevalence(target_rows(t), "contact_parent_id", "is_defaulter", 20)
    return g.agg(F.count("*").alias("n_counties"), F.count_if(F.col("rate") > 0.8).alias("above"), F.count_if(F.col("rate") < 0.75).alias("below"))


@query("d31_class_means", uses="iz_target", sql="""
  SELECT is_defaulter, round(avg(due_count_clean), 6) AS mean_due_count_clean, round(avg(patient_age_in_months), 6) AS mean_patient_age_in_months FROM iz_target GROUP BY 1""")
def _(t):
    return rounded(P.class_means(target_rows(t), "is_defaulter", ["due_count_clean", "patient_age_in_months"]))


@query("d31_class_median", uses="iz_target", sql="SELECT is_defaulter, quantile_cont(due_count_clean, 0.5) AS median FROM iz_target WHERE due_count_clean IS NOT NULL GROUP BY 1")
def _(t):
    return rounded(exact_median(target_rows(t), "due_count_clean", ["is_defaulter"]))


@query("d32_programme_kpis", uses="scored", sql="""
  SELECT count(*) AS n, round(100.0 * avg(y), 6) AS positive_pct, count(*) FILTER (p >= 0.6) AS n_high, round(100.0 * count(*) FILTER (p >= 0.6) / count(*), 6) AS high_pct FROM scored""")
def _(t):
    high = F.count_if(score_tier(F.col("p")) == "HIGH")
    return rounded(t.scored.agg(F.count("*").alias("n"), (F.avg("y") * 100).alias("positive_pct"), high.alias("n_high"),
                                (high * 100.0 / F.count("*")).alias("high_pct")))


@query("d33_tier_counts", uses="scored", sql="""
  SELECT k AS risk_tier, count(*) FILTER (CASE WHEN p < 0.33 THEN 'LOW' WHEN p < 0.6 THEN 'MEDIUM' ELSE 'HIGH' END = k) AS n
  FROM scored, (SELECT unnest(['HIGH', 'MEDIUM', 'LOW']) AS k) GROUP BY k""")
def _(t):
    return R.tier_counts(t.scored, "p")


@query("d33_tier_counts_zero_fill", uses="scored", sql="""
  SELECT k AS risk_tier, CASE WHEN k = 'LOW' THEN (SELECT count(*) FROM scored) ELSE 0 END AS n FROM (SELECT unnest(['HIGH', 'MEDIUM', 'LOW']) AS k)""")
def _(t):
    """All rows at under a third of their score, so that two tiers are empty."""
    return R.tier_counts(t.scored.withColumn("low", F.col("p") * 0.3), "low")


@query("d34_histogram", uses="scored", sql="""
  WITH e AS (SELECT min(p_many) AS lo, max(p_many) AS hi FROM scored)
  SELECT CAST(least(floor((p_many - lo) / ((hi - lo) / 40)), 39) AS INT) AS bin, round(lo + least(floor((p_many - lo) / ((hi - lo) / 40)), 39) * ((hi - lo) / 40), 6) AS bin_start, count(*) AS n
  FROM scored, e GROUP BY 1, 2""")
def _(t):
    return rounded(P.histogram(t.scored, "p_many", 40))


@query("d34_class_histogram", uses="features", sql="""
  WITH e AS (SELECT y, min(price) AS lo, max(price) AS hi, count(price) AS t FROM features GROUP BY 1)
  SELECT f.y, CAST(least(floor((price - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin, round(lo + least(floor((price - lo) / ((hi - lo) / 20)), 19) * ((hi - lo) / 20), 6) AS bin_start, count(*) AS n,
    round(count(*) / (t * ((hi - lo) / 20)), 9) AS density FROM features f JOIN e ON f.y = e.y WHERE price IS NOT NULL GROUP BY 1, 2, 3, t, hi, lo""")
def _(t):
    h = P.histogram(t.features, "price", 20, ["y"], density=True)
    return h.select("y", "bin", F.round("bin_start", 6).alias("bin_start"), "n", F.round("density", 9).alias("density"))


@query("d35_age_by_tier", uses="scored", sql="""
  SELECT CASE WHEN p < 0.33 THEN 'LOW' WHEN p < 0.6 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_tier, count(*) AS n, round(avg(age), 6) AS mean, round(stddev_samp(age), 6) AS std, min(age) AS min,
    quantile_cont(age, 0.25) AS q1, quantile_cont(age, 0.5) AS median, quantile_cont(age, 0.75) AS q3, max(age) AS max FROM scored GROUP BY 1""")
def _(t):
    return rounded(P.describe(t.scored.withColumn("risk_tier", score_tier(F.col("p"))), "age", ["risk_tier"]))


@query("d36_high_risk_by_county", uses="scored", sql="""
  SELECT concat('County ', county_code) AS county, count(*) AS high_risk_count FROM scored WHERE p >= 0.6 GROUP BY county_code ORDER BY 2 DESC, county_code LIMIT 10""")
def _(t):
    """Most high-risk rows first; the report shows the leading counties."""
    g = t.scored.filter(score_tier(F.col("p")) == "HIGH").groupBy("county_code").agg(F.count("*").alias("high_risk_count"))
    top = g.orderBy(F.col("high_risk_count").desc(), "county_code").limit(10)
    return top.select(F.concat(F.lit("County "), F.col("county_code")).alias("county"), "high_risk_count")


@query("d38_batch_tier_counts", uses="scored", sql="""
  SELECT county_code, count(*) FILTER (p >= 0.6) AS n_high, count(*) FILTER (p >= 0.33 AND p < 0.6) AS n_medium, count(*) FILTER (p < 0.33) AS n_low FROM scored GROUP BY 1""")
def _(t):
    return R.batch_counts(t.scored, "p", ["county_code"])


@query("d39_prevalence_and_missing", uses="features", sql=f"""
  SELECT round(avg(y), 6) AS prevalence, round(avg(({" + ".join(f"({c} IS NULL)::INT" for c in FEATURES)}) / {len(FEATURES)}.0), 6) AS missing_share FROM features""")
def _(t):
    return rounded(t.features.agg(F.avg("y").alias("prevalence"), F.avg(missing_share(*map(F.col, FEATURES))).alias("missing_share")))


@query("d40_group_availability", uses="features", sql="""
  SELECT 'amounts' AS feature_group, 3 AS defined, (SELECT (count(price) > 0)::INT + (count(absent) > 0)::INT FROM features) AS with_data
  UNION ALL SELECT 'flags', 1, (SELECT (count(even) > 0)::INT FROM features)""")
def _(t):
    return K.group_availability(t.features, {"amounts": ("price", "absent", "never_joined"), "flags": ("even",)})


@query("flagship_monthly_prevalence", uses="iz_target hv_area", sql="""
  SELECT month_clean, count(*) AS n, sum(is_defaulter)::BIGINT AS positives, round(avg(is_defaulter), 6) AS positive_rate,
    round(avg(h.monthly_homevisit_rate), 6) AS mean_homevisit_rate
  FROM iz_target v LEFT JOIN hv_area h ON v.contact_parent_id = h.chw_area_key WHERE month_clean IS NOT NULL GROUP BY 1""")
def _(t):
    """Latest visit per person and month, visit rate per area, left join, label, monthly prevalence."""
    rate = A.visit_rate_by_area(clean_home_visits(t.homevisit)).select("chw_area_key", "monthly_homevisit_rate")
    rows = left_join(target_rows(t).withColumn("chw_area_key", F.col("contact_parent_id")), rate, "chw_area_key")
    out = rows.filter(F.col("month_clean").isNotNull()).groupBy("month_clean").agg(
        F.count("*").alias("n"), F.sum("is_defaulter").alias("positives"), F.avg("is_defaulter").alias("positive_rate"),
        F.avg("monthly_homevisit_rate").alias("mean_homevisit_rate"))
    return rounded(out)
