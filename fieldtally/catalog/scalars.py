"""Scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import (
    AGE_BANDS_DAYS, AGE_BANDS_MONTHS, CORE_DOSES, CORE_SCHEDULE_MONTHS, DAY_DOSES, DOSE_SERIES, HIGH_EXTRAS_SHORT, MALARIA_DOSES,
    MALARIA_SCHEDULE_MONTHS, SCHEDULE_DAYS, VITAMIN_A_SCHEDULE_MONTHS,
)
from ..functions import dates as D
from ..functions import numbers as N
from ..functions import risk as R
from ..functions import schedule as S
from ..functions import text as X
from ..operators.ranking import top_reasons
from ..plans import cleaners as C
from ..plans.person_months import silver_population, silver_registry, silver_supervision, silver_visits
from ..plans.person_table import add_dose_scores, add_target
from .registry import query
from .shape import as_of, rounded, ts_text

BOOL = "CASE WHEN lower(trim({0})) IN ('yes','true','1','1.0','y','t') THEN 1 WHEN lower(trim({0})) IN ('no','false','0','0.0','n','f') THEN 0 END"


def _expected(age, schedule):
    return "(" + " + ".join(f"CASE WHEN {age} >= {low} THEN 1 ELSE 0 END" for _, low in schedule) + ")"


def _flags(names):
    return "(" + " + ".join(f"coalesce({n}, 0)" for n in names) + ")"


@query("h01_month_token", uses="iz_clean", sql="SELECT visit_no, month_clean FROM iz_clean")
def _(t):
    return t.iz.select("visit_no", D.month_token(F.col("month")).alias("month_clean"))


@query("h02_json_map", sql="""
  SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS k,
    CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 0 ELSE 1 END AS n_keys FROM events""")
def _(t):
    text = F.when(F.col("event_id") % 5 == 0, None).when(F.col("event_id") % 7 == 0, "bad").otherwise(F.col("props"))
    parsed = t.events.select("event_id", X.json_map(text).alias("m"))
    return parsed.select("event_id", F.try_element_at("m", F.lit("k")).alias("k"), F.size("m").alias("n_keys"))


@query("h03_yes_no", uses="iz", sql="""
  SELECT visit_no, CASE lower(trim(needs_follow_up)) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS needs_follow_up_binary,
    CASE is_in_malaria_endemic_region WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS is_in_malaria_endemic_region_binary FROM iz""")
def _(t):
    return C.clean_visits(t.iz).select("visit_no", "needs_follow_up_binary", "is_in_malaria_endemic_region_binary")


@query("h04_loose_boolean", uses="supervision", sql=f"SELECT event_id, {BOOL.format('has_all_tools')} AS has_all_tools FROM supervision")
def _(t):
    return t.supervision.select("event_id", X.loose_boolean(F.col("has_all_tools")).alias("has_all_tools"))


@query("h05_loose_boolean_columns", uses="iz", sql=f"""
  SELECT visit_no, {BOOL.format('needs_follow_up')} AS needs_follow_up, {BOOL.format('is_in_malaria_endemic_region')} AS is_in_malaria_endemic_region,
    has_bcg, has_measles_9_months, has_malaria_6_vaccine FROM iz""")
def _(t):
    return silver_visits(t.iz).select("visit_no", "needs_follow_up", "is_in_malaria_endemic_region", "has_bcg", "has_measles_9_months", "has_malaria_6_vaccine")


@query("h06_mixed_flag", uses="supervision preg", sql="""
  SELECT 's' || event_id AS k, CASE lower(has_all_tools) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 WHEN 'false' THEN 0 END AS flag FROM supervision
  UNION ALL SELECT 'p' || record_no, CASE lower(is_anc_defaulter) WHEN 'true' THEN 1 WHEN '1' THEN 1 WHEN 'no' THEN 0 END FROM preg""")
def _(t):
    s = C.clean_supervision(t.supervision).select(F.concat(F.lit("s"), "event_id").alias("k"), F.col("has_all_tools_binary").alias("flag"))
    p = C.clean_pregnancies(t.preg).select(F.concat(F.lit("p"), "record_no").alias("k"), F.col("is_anc_defaulter_binary").alias("flag"))
    return s.unionByName(p)


@query("h07_sex_recode", uses="iz", sql="""
  SELECT visit_no, CASE WHEN lower(patient_sex) IN ('male','m') THEN 1 WHEN lower(patient_sex) IN ('female','f') THEN 0 END AS patient_sex_binary,
    CASE lower(trim(patient_sex)) WHEN 'm' THEN 'male' WHEN 'f' THEN 'female' ELSE lower(trim(patient_sex)) END AS sex FROM iz""")
def _(t):
    return t.iz.select("visit_no", X.sex_flag(F.col("patient_sex")).alias("patient_sex_binary"), X.sex_text(F.col("patient_sex")).alias("sex"))


@query("h08_numeric_coercion", uses="iz", sql="SELECT visit_no, try_cast(patient_age_in_days AS DOUBLE) AS age, try_cast(accuracy AS DOUBLE) AS accuracy FROM iz")
def _(t):
    return t.iz.select("visit_no", N.to_number(F.col("patient_age_in_days")).alias("age"), N.to_number(F.col("accuracy")).alias("accuracy"))


@query("h09_negative_sentinel", uses="pnc population", sql="""
  SELECT 'p' || record_no AS k, CASE WHEN days_since_delivery >= 0 THEN CAST(days_since_delivery AS DOUBLE) END AS v FROM pnc
  UNION ALL SELECT 'c' || c_custkey, CASE WHEN u2_pop >= 0 THEN u2_pop END FROM population""")
def _(t):
    a = C.clean_postnatal(t.pnc).select(F.concat(F.lit("p"), "record_no").alias("k"), F.col("days_since_delivery_clean").alias("v"))
    return a.unionByName(t.population.select(F.concat(F.lit("c"), "c_custkey").alias("k"), N.non_negative(F.col("u2_pop")).alias("v")))


@query("h10_infinity_and_clip", uses="supervision", sql="""
  SELECT event_id, round(CASE WHEN NOT isinf(perce_campaign_service_score) THEN least(greatest(perce_campaign_service_score, 0), 1) END, 6) AS score FROM supervision""")
def _(t):
    return rounded(C.clean_supervision(t.supervision).select("event_id", F.col("perce_campaign_service_score").alias("score")))


@query("h11_guarded_ratio", uses="supervision", sql="""
  SELECT event_id, round(CASE WHEN calc_immunization_denominator > 0 THEN least(greatest(calc_immunization_score / calc_immunization_denominator, 0), 1) END, 9) AS pct_immunization_pct,
    round(CASE WHEN calc_assessment_denominator > 0 THEN least(greatest(calc_assessment_score / calc_assessment_denominator, 0), 1) END, 9) AS pct_assessment_pct FROM supervision""")
def _(t):
    return rounded(C.clean_supervision(t.supervision).select("event_id", "pct_immunization_pct", "pct_assessment_pct"), 9)


@query("h12_denominator_flags", uses="supervision", sql="""
  SELECT event_id, CASE WHEN calc_immunization_denominator > 0 THEN 1 ELSE 0 END AS immunization_score_valid_flag,
    CASE WHEN calc_assessment_denominator > 0 THEN 1 ELSE 0 END AS assessment_score_valid_flag FROM supervision""")
def _(t):
    return silver_supervision(t.supervision).select("event_id", "immunization_score_valid_flag", "assessment_score_valid_flag")


@query("h13_county_check", uses="slv_iz", sql="SELECT visit_no, county_clean, county_valid_flag FROM slv_iz")
def _(t):
    return t.iz.select("visit_no", X.known_name(F.col("county")).alias("county_clean"), X.known_name_flag(F.col("county")).alias("county_valid_flag"))


@query("h14_text_standardise", uses="slv_registry", sql="SELECT l_orderkey, l_linenumber, l_partkey, chw_key, chw_area_clean, community_unit_clean, sub_county_clean FROM slv_registry")
def _(t):
    return t.registry.select(
        "l_orderkey", "l_linenumber", "l_partkey", X.clean_text(F.col("chw_uuid")).alias("chw_key"),
        *[X.clean_text(F.col(a), lower=True).alias(b) for a, b in (
            ("chw_area_name", "chw_area_clean"), ("community_unit", "community_unit_clean"), ("sub_county_name", "sub_county_clean"))])


@query("h15_timestamp_month_date", uses="slv_iz", sql="""
  SELECT visit_no, strftime(event_datetime, '%Y-%m-%d %H:%M:%S') AS event_datetime, year_month, CAST(event_datetime AS DATE) AS event_date FROM slv_iz""")
def _(t):
    ts = D.parse_timestamp(F.col("reported"))
    return t.iz.select("visit_no", ts_text(ts).alias("event_datetime"), D.month_key(ts).alias("year_month"), F.to_date(ts).alias("event_date"))


def _bands_sql(col, edges, labels):
    return "CASE " + " ".join(f"WHEN {col} > {a} AND {col} <= {b} THEN '{n}'" for a, b, n in zip(edges[:-1], edges[1:], labels)) + " END"


@query("h16_age_bands", uses="iz_clean", sql=f"""
  SELECT visit_no, {_bands_sql('patient_age_in_days', *AGE_BANDS_DAYS)} AS band_days, {_bands_sql('patient_age_in_months', *AGE_BANDS_MONTHS)} AS band_months FROM iz_clean""")
def _(t):
    x = t.iz.select("visit_no", N.to_number(F.col("patient_age_in_days")).alias("d"), N.to_number(F.col("patient_age_in_months")).alias("m"))
    return x.select("visit_no", N.bands(F.col("d"), *AGE_BANDS_DAYS).alias("band_days"), N.bands(F.col("m"), *AGE_BANDS_MONTHS).alias("band_months"))


@query("h17_age_rebuilt", uses="iz_clean", sql="""
  SELECT visit_no, round_even(CASE WHEN patient_age_in_days >= 0 THEN patient_age_in_days END / 30.4375, 1) AS age_months_rebuilt,
    CASE WHEN patient_age_in_days >= 0 AND abs(patient_age_in_months - round_even(patient_age_in_days / 30.4375, 1)) <= 1 THEN 1 ELSE 0 END AS age_consistency_flag FROM iz_clean""")
def _(t):
    return silver_visits(t.iz).select("visit_no", "age_months_rebuilt", "age_consistency_flag")


@query("h18_gps_flag", uses="iz", sql="SELECT visit_no, CASE WHEN try_cast(accuracy AS DOUBLE) <= 100 THEN 1 ELSE 0 END AS gps_reliable_flag FROM iz")
def _(t):
    return t.iz.select("visit_no", N.at_most_flag(F.col("accuracy"), 100).alias("gps_reliable_flag"))


@query("h19_calendar", sql="""
  SELECT o_orderkey, CAST(month(o_orderdate) AS INT) AS index_month_num, CAST(quarter(o_orderdate) AS INT) AS index_quarter, CAST(year(o_orderdate) AS INT) AS index_year FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", *D.calendar_columns(F.col("o_orderdate")))


@query("h20_months_since", uses="supervision", sql="""
  SELECT event_id, CASE WHEN reported IS NOT NULL THEN round(least(greatest(floor((epoch_us(TIMESTAMP '2024-03-01') - epoch_us(reported)) / 86400000000.0) / 30.44, 0), 24), 6) END AS months_since FROM supervision""")
def _(t):
    from .shape import as_of_events
    return rounded(t.supervision.select("event_id", D.months_since(F.col("reported"), as_of_events()).alias("months_since")))


@query("h21_expected_doses", uses="iz_clean", sql=f"""
  SELECT visit_no, CAST({_expected('patient_age_in_months', CORE_SCHEDULE_MONTHS)} AS INT) AS core,
    CAST({_expected('patient_age_in_months', CORE_SCHEDULE_MONTHS)} + CASE WHEN is_in_malaria_endemic_region = 'yes'
      THEN {_expected('patient_age_in_months', MALARIA_SCHEDULE_MONTHS)} ELSE 0 END AS INT) AS with_region FROM iz_clean""")
def _(t):
    age = N.to_number(F.col("patient_age_in_months"))
    return t.iz.select("visit_no", S.expected_doses(age).alias("core"),
                       S.expected_doses_with_region(age, F.coalesce(F.col("is_in_malaria_endemic_region") == "yes", F.lit(False))).alias("with_region"))


@query("h22_expected_vitamin_a", uses="iz_clean", sql=f"SELECT visit_no, CAST({_expected('patient_age_in_months', VITAMIN_A_SCHEDULE_MONTHS)} AS INT) AS expected FROM iz_clean")
def _(t):
    return t.iz.select("visit_no", S.expected_doses(N.to_number(F.col("patient_age_in_months")), VITAMIN_A_SCHEDULE_MONTHS).alias("expected"))


_NAMES = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {{0}} >= {low} {{1}} THEN '{n}' END" for n, low in SCHEDULE_DAYS) + "], lambda x: x IS NOT NULL), ';')"


@query("h23_expected_names", uses="slv_iz", sql=f"SELECT visit_no, {_NAMES.format('age_days', '')} AS expected FROM slv_iz")
def _(t):
    return t.iz.select("visit_no", F.array_join(S.expected_names(N.non_negative(F.col("patient_age_in_days"))), ";").alias("expected"))


_AGE = "patient_age_in_months"
_CORE, _ALL = _flags(CORE_DOSES), _flags(CORE_DOSES + MALARIA_DOSES)
_EXP = _expected(_AGE, CORE_SCHEDULE_MONTHS)
_EXPALL = f"({_EXP} + CASE WHEN is_in_malaria_endemic_region = 'yes' THEN {_expected(_AGE, MALARIA_SCHEDULE_MONTHS)} ELSE 0 END)"


@query("h24_dose_completeness", uses="iz_clean", sql=f"""
  SELECT visit_no, CAST({_CORE} AS DOUBLE) AS vax_received_core, CAST({_ALL} AS DOUBLE) AS vax_received_total,
    round(CASE WHEN {_EXP} > 0 THEN least({_CORE} / {_EXP}, 1.0) END, 6) AS vax_completeness_score,
    round(CASE WHEN {_EXPALL} > 0 THEN least({_ALL} / {_EXPALL}, 1.0) END, 6) AS vax_completeness_all FROM iz_clean""")
def _(t):
    x = add_dose_scores(C.clean_visits(t.iz), as_of())
    return rounded(x.select("visit_no", "vax_received_core", "vax_received_total", "vax_completeness_score", "vax_completeness_all"))


_VITR = "(" + " + ".join(f"CASE WHEN {_AGE} >= {low} THEN coalesce({n}, 0) ELSE 0 END" for n, low in VITAMIN_A_SCHEDULE_MONTHS) + ")"
_VITE = _expected(_AGE, VITAMIN_A_SCHEDULE_MONTHS)


@query("h25_vitamin_a_completeness", uses="iz_clean", sql=f"SELECT visit_no, round(CASE WHEN {_VITE} > 0 THEN {_VITR} / {_VITE} END, 6) AS vitamin_a_completeness FROM iz_clean")
def _(t):
    x = C.clean_visits(t.iz)
    return rounded(x.select("visit_no", S.vitamin_a_completeness(x, F.col("patient_age_in_months")).alias("vitamin_a_completeness")))


@query("h26_series_complete", uses="iz", sql="SELECT visit_no, " + ", ".join(
    f"CASE WHEN {_flags(names)} = 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {flag}" for flag, names in DOSE_SERIES.items()) + " FROM iz")
def _(t):
    x = S.clean_doses(t.iz, CORE_DOSES)
    return x.select("visit_no", *[S.series_complete(x, names).alias(flag) for flag, names in DOSE_SERIES.items()])


@query("h27_booster_gap", uses="iz_clean", sql="""
  SELECT visit_no, CASE WHEN has_measles_9_months = 1 AND has_measles_18_months = 0 AND patient_age_in_months >= 20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS measles_booster_gap FROM iz_clean""")
def _(t):
    return t.iz.select("visit_no", S.booster_gap(F.col("has_measles_9_months"), F.col("has_measles_18_months"),
                                                 N.to_number(F.col("patient_age_in_months"))).alias("measles_booster_gap"))


@query("h28_conditional_null", uses="iz", sql="SELECT visit_no, " + ", ".join(
    f"CAST(CASE WHEN {n} IS NULL AND (is_in_malaria_endemic_region IS NULL OR is_in_malaria_endemic_region = 'no') THEN 0 ELSE {n} END AS DOUBLE) AS {n}"
    for n in MALARIA_DOSES) + " FROM iz")
def _(t):
    return C.clean_visits(t.iz).select("visit_no", *MALARIA_DOSES)


@query("h29_maternal_flags", uses="preg", sql="""
  SELECT record_no, CASE WHEN muac_color IS NULL THEN NULL WHEN lower(muac_color) = 'green' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS muac_risk,
    CASE lower(trim(takes_iron_or_folate_supplements)) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS iron_folate_binary,
    CASE lower(is_anc_defaulter) WHEN 'true' THEN 1 WHEN '1' THEN 1 WHEN 'no' THEN 0 END AS is_anc_defaulter_binary FROM preg""")
def _(t):
    return C.clean_pregnancies(t.preg).select("record_no", "muac_risk", "iron_folate_binary", "is_anc_defaulter_binary")


@query("h30_composite_target", uses="iz_clean", sql="""
  SELECT visit_no, CASE WHEN needs_follow_up_binary = 1 THEN 1 ELSE 0 END AS _target_needs_fu, CASE WHEN due_count > 0 THEN 1 ELSE 0 END AS _target_due_pos,
    CASE WHEN vaccines_due_missed <> '' THEN 1 ELSE 0 END AS _target_missed_flag,
    CASE WHEN needs_follow_up_binary = 1 OR due_count > 0 OR coalesce(vaccines_due_missed, '') <> '' THEN 1 ELSE 0 END AS is_defaulter FROM iz_clean""")
def _(t):
    return add_target(C.clean_visits(t.iz)).select("visit_no", "_target_needs_fu", "_target_due_pos", "_target_missed_flag", "is_defaulter")


_DUE = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN age_days >= {low} AND {n} <> 1 THEN '{n}' END" for n, low in SCHEDULE_DAYS) + "], lambda x: x IS NOT NULL), ';')"
_DUE_N = "(" + " + ".join(f"CASE WHEN age_days >= {low} AND {n} <> 1 THEN 1 ELSE 0 END" for n, low in SCHEDULE_DAYS) + ")"
_EXP_D = _expected("age_days", SCHEDULE_DAYS)


@query("h31_due_doses", uses="slv_iz", sql=f"""
  SELECT visit_no, {_DUE} AS due_vaccines_rebuilt, CAST({_EXP_D} - {_DUE_N} AS INT) AS num_received_vaccines,
    CAST({_DUE_N} AS INT) AS num_due_vaccines_rebuilt, CAST({_DUE_N} AS INT) AS num_overdue_vaccines FROM slv_iz""")
def _(t):
    return S.schedule_labels(silver_visits(t.iz).select("visit_no", "age_days", *DAY_DOSES)).select(
        "visit_no", "due_vaccines_rebuilt", "num_received_vaccines", "num_due_vaccines_rebuilt", "num_overdue_vaccines")


@query("h32_schedule_labels", uses="slv_iz", sql=f"""
  SELECT visit_no, CASE WHEN {_DUE_N} > 0 THEN 1 ELSE 0 END AS default_30d, CASE WHEN {_DUE_N} = 0 THEN 1 ELSE 0 END AS fully_immunized_for_age_gap,
    CASE WHEN has_penta_1 = 1 AND has_penta_3 = 0 THEN 1 ELSE 0 END AS dropout_risk FROM slv_iz""")
def _(t):
    return S.schedule_labels(silver_visits(t.iz).select("visit_no", "age_days", *DAY_DOSES)).select(
        "visit_no", "default_30d", "fully_immunized_for_age_gap", "dropout_risk")


_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
_K = ", ".join(_KEY)


@query("h33_risk_tiers", uses="scored", sql=f"""
  SELECT {_K}, CASE WHEN p < 0.33 THEN 'LOW' WHEN p < 0.6 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_tier,
    CASE WHEN p <= 0.5 THEN 'medium' WHEN p <= 0.75 THEN 'high' ELSE 'critical' END AS list_tier FROM scored""")
def _(t):
    return t.scored.select(*_KEY, R.score_tier(F.col("p")).alias("risk_tier"), R.list_tier(F.col("p")).alias("list_tier"))


@query("h34_geo_fallback", uses="slv_registry", sql="SELECT l_orderkey, l_linenumber, l_partkey, county_clean FROM slv_registry")
def _(t):
    return silver_registry(t.registry, ["l_orderkey", "l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "county_clean")


@query("h35_reason_codes", sql="""
  SELECT event_id, array_to_string(list_filter([
      CASE WHEN event_id % 3 > 0 THEN 'child currently has due vaccines outstanding' END,
      CASE WHEN event_id % 4 > 0 AND value > 60 THEN 'long gap since recent CHW supervision' END,
      CASE WHEN event_id % 2 = 0 THEN 'no recent home visit activity captured' END,
      CASE WHEN event_id % 5 = 0 THEN 'source data contains administrative field inconsistency' END], lambda x: x IS NOT NULL)[1:3], ';') AS reason_codes FROM events""")
def _(t):
    x = t.events.select("event_id", (F.col("event_id") % 3).alias("num_due_vaccines_rebuilt"),
                        F.when(F.col("event_id") % 4 > 0, F.col("value")).alias("days_since_last_supervision"),
                        (F.col("event_id") % 2).alias("homevisit_count_30d"),
                        F.when(F.col("event_id") % 5 == 0, 0).otherwise(1).alias("county_valid_flag"))
    return x.select("event_id", F.array_join(R.reason_codes(x), ";").alias("reason_codes"))


_FEATURE_NAMES = ("vax_completeness_score", "patient_age_in_months", "due_count_clean", "months_since_reported", "chw_supervision_frequency",
                  "maternal_anc_visits", "measles_booster_gap", "chw_workload_u2", "has_opv_2")


def _driver_rows(t):
    names = F.array(*[F.lit(n) for n in _FEATURE_NAMES])
    k = F.col("event_id") % len(_FEATURE_NAMES)
    value = F.when(F.col("event_id") % 4 == 0, 1.0).otherwise(F.floor(F.col("value")) + 0.25)
    return t.events.select("event_id", F.element_at(names, (k + 1).cast("int")).alias("feature"), value.alias("v"),
                           F.when(F.col("event_id") % 3 == 0, -0.5).otherwise(0.5).alias("effect"))


_DRIVERS = "d AS (SELECT event_id, [" + ", ".join(f"'{n}'" for n in _FEATURE_NAMES) + """][1 + event_id % 9] AS feature,
    CASE WHEN event_id % 4 = 0 THEN 1.0 ELSE floor(value) + 0.25 END::DOUBLE AS v, CASE WHEN event_id % 3 = 0 THEN 'reduces' ELSE 'increases' END AS verb FROM events)"""


@query("h36_driver_sentence", sql=f"""WITH {_DRIVERS}
  SELECT event_id, CASE feature
    WHEN 'vax_completeness_score' THEN printf('Child has received %.0f%% of expected vaccines — this %s defaulter risk', v * 100, verb)
    WHEN 'patient_age_in_months' THEN printf('Child is %.0f months old — age context %s defaulter risk', v, verb)
    WHEN 'due_count_clean' THEN printf('Child has %d outstanding vaccine dose(s) — this %s defaulter risk', CAST(trunc(v) AS BIGINT), verb)
    WHEN 'months_since_reported' THEN 'Last CHW contact was ' || CASE WHEN v = 1 THEN '1.0' ELSE printf('%d.3', CAST(trunc(v) AS BIGINT)) END || ' month(s) ago — this ' || verb || ' defaulter risk'
    WHEN 'chw_supervision_frequency' THEN printf('This CHW area had %d supervision visit(s) — this %s defaulter risk', CAST(trunc(v) AS BIGINT), verb)
    WHEN 'maternal_anc_visits' THEN printf('Mother attended %d ANC visit(s) — this %s defaulter risk', CAST(trunc(v) AS BIGINT), verb)
    WHEN 'measles_booster_gap' THEN CASE WHEN v = 1 THEN 'Child received MR1 but is missing the 18-month MR2 booster — this ' || verb || ' defaulter risk' ELSE 'Measles booster gap not detected' END
    WHEN 'chw_workload_u2' THEN printf('Under-2 children per CHW area value=%.2f %s defaulter risk', v, verb)
    ELSE printf('has_opv_2 value=%.2f %s defaulter risk', v, verb) END AS plain_english FROM d""")
def _(t):
    return _driver_rows(t).select("event_id", R.plain_english(F.col("feature"), F.col("v"), F.col("effect")).alias("plain_english"))


@query("h37_recommended_action", sql=f"""WITH {_DRIVERS},
  x AS (SELECT event_id, feature, CASE event_id % 3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS tier FROM d),
  b AS (SELECT *, CASE tier WHEN 'LOW' THEN 'Routine follow-up at next scheduled visit.'
      WHEN 'MEDIUM' THEN 'Prioritise within-month home visit. Review vaccine card.' ELSE 'Immediate home visit required. Bring vaccine referral form.' END AS base FROM x)
  SELECT event_id, base || CASE WHEN tier <> 'HIGH' THEN '' WHEN feature = 'measles_booster_gap' THEN ' Specifically: schedule MR2 booster referral.'
      WHEN feature = 'due_count_clean' THEN ' Check outstanding doses and arrange facility referral.'
      WHEN feature = 'months_since_reported' THEN ' Child has not been seen recently — locate household.' ELSE '' END AS full_text,
    base || CASE WHEN tier <> 'HIGH' THEN '' WHEN feature = 'measles_booster_gap' THEN ' Schedule MR2 booster referral.'
      WHEN feature = 'due_count_clean' THEN ' Arrange facility referral for outstanding doses.' ELSE '' END AS short_text FROM b""")
def _(t):
    tier = F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), (F.col("event_id") % 3 + 1).cast("int"))
    x = _driver_rows(t).withColumn("tier", tier)
    return x.select("event_id", R.recommended_action(F.col("tier"), F.col("feature")).alias("full_text"),
                    R.recommended_action(F.col("tier"), F.col("feature"), HIGH_EXTRAS_SHORT).alias("short_text"))


@query("h38_names_and_reasons", sql=f"""WITH {_DRIVERS}
  SELECT event_id, CASE feature WHEN 'vax_completeness_score' THEN 'Overall vaccine completeness' WHEN 'patient_age_in_months' THEN 'Child''s age (months)'
      WHEN 'due_count_clean' THEN 'Doses currently outstanding' WHEN 'months_since_reported' THEN 'Months since last CHW contact'
      WHEN 'chw_supervision_frequency' THEN 'CHW supervision visits (count)' WHEN 'maternal_anc_visits' THEN 'Mother''s ANC visits attended'
      WHEN 'measles_booster_gap' THEN 'Missed measles booster (18-month)' WHEN 'chw_workload_u2' THEN 'Under-2 children per CHW area' ELSE feature END AS friendly_name,
    CASE feature WHEN 'vax_completeness_score' THEN 'Vaccine series completion below age expectation'
      WHEN 'patient_age_in_months' THEN 'Child''s age places them in a high-risk vaccine window' WHEN 'due_count_clean' THEN 'Multiple vaccine doses currently outstanding'
      WHEN 'months_since_reported' THEN 'Extended gap since last CHW contact' WHEN 'chw_supervision_frequency' THEN 'CHW has had limited supervision support recently'
      WHEN 'maternal_anc_visits' THEN 'Mother attended fewer ANC visits during pregnancy' WHEN 'chw_workload_u2' THEN 'CHW carries a high under-2 caseload in this area'
      ELSE 'Feature: ' || feature END AS reason,
    CASE WHEN verb = 'increases' THEN 'INCREASES' ELSE 'DECREASES' END AS direction FROM d""")
def _(t):
    x = _driver_rows(t)
    return x.select("event_id", R.friendly_name(F.col("feature")).alias("friendly_name"), R.driver_reason(F.col("feature")).alias("reason"),
                    F.when(F.col("effect") > 0, "INCREASES").otherwise("DECREASES").alias("direction"))


_EFFECTS = [f"((event_id * {k + 3}) % 101 - 50) / 128.0e0" for k in range(len(_FEATURE_NAMES))]


@query("h38_top_reasons", sql=f"""
  WITH e AS (SELECT event_id, unnest([{', '.join(_EFFECTS)}]) AS v, unnest([{', '.join(f"'{n}'" for n in _FEATURE_NAMES)}]) AS feature,
      unnest(range({len(_FEATURE_NAMES)})) AS i FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(v) DESC, i) AS k FROM e)
  SELECT event_id, CAST(k AS INT) AS rank, feature, round(v, 4) AS shap, CASE WHEN v > 0 THEN 'INCREASES' ELSE 'DECREASES' END AS direction,
    CASE feature WHEN 'vax_completeness_score' THEN 'Vaccine series completion below age expectation'
      WHEN 'patient_age_in_months' THEN 'Child''s age places them in a high-risk vaccine window' WHEN 'due_count_clean' THEN 'Multiple vaccine doses currently outstanding'
      WHEN 'months_since_reported' THEN 'Extended gap since last CHW contact' WHEN 'chw_supervision_frequency' THEN 'CHW has had limited supervision support recently'
      WHEN 'maternal_anc_visits' THEN 'Mother attended fewer ANC visits during pregnancy' WHEN 'chw_workload_u2' THEN 'CHW carries a high under-2 caseload in this area'
      ELSE 'Feature: ' || feature END AS reason
  FROM r WHERE k <= 5""")
def _(t):
    """The five leading effects of every row, with direction and reason."""
    x = t.events.select("event_id", F.expr(f"array({', '.join(_EFFECTS)})").alias("effects"))
    return top_reasons(x, ["event_id"], "effects", _FEATURE_NAMES)


@query("h39_population_present", uses="population", sql="""
  SELECT c_custkey, CASE WHEN u2_pop >= 0 OR u5_pop >= 0 OR wra_pop >= 0 THEN 1 ELSE 0 END AS population_context_valid_flag FROM population""")
def _(t):
    return silver_population(t.population).select("c_custkey", "population_context_valid_flag")
