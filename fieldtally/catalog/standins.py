"""Programme-shaped tables made from the driver's tables.

Each stand-in is a projection over a driver table, spelled once with the few words
in which Spark SQL and the checking SQL differ left open.
"""

from __future__ import annotations

from ..constants import CORE_DOSES, MALARIA_DOSES, VITAMIN_A_SCHEDULE_MONTHS

_WORDS = {
    "spark": {
        "mon": "date_format(o_orderdate, 'MMMyy')", "day": "date_format(o_orderdate, 'yyyy-MM-dd')",
        "repm": "date_format(o_orderdate, 'MMMyy')",
        "age": "datediff(DATE '2002-01-01', CAST(o_orderdate AS DATE)) % 1826",
        "inf": "double('Infinity')",
    },
    "check": {
        "mon": "strftime(o_orderdate, '%b%y')", "day": "strftime(o_orderdate, '%Y-%m-%d')",
        "repm": "strftime(o_orderdate, '%b%y')",
        "age": "date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') % 1826",
        "inf": "CAST('Infinity' AS DOUBLE)",
    },
}

_S = "CAST({} AS STRING)".format
AREA = "CAST(o_custkey % 100 + 1 AS STRING)"


def _dose(i: int, name: str) -> str:
    return f"CASE WHEN (o_orderkey * 7 + {i * 13}) % 11 < 7 THEN 1 ELSE 0 END AS {name}"


def _sparse_dose(i: int, name: str) -> str:
    return f"CASE WHEN (o_orderkey + {i}) % 5 = 0 THEN NULL WHEN (o_orderkey * 3 + {i * 7}) % 5 < 3 THEN 1 ELSE 0 END AS {name}"


_COUNTY = ("CASE {0} % 6 WHEN 0 THEN 'Nairobi ' WHEN 1 THEN 'kisumu' WHEN 2 THEN 'Atlantis' "
           "WHEN 3 THEN NULL WHEN 4 THEN ' MERU' ELSE 'Homa Bay' END")

STANDINS: dict[str, tuple[str, list[str]]] = {
    # child visits
    "iz": ("orders JOIN customer ON o_custkey = c_custkey", [
        "o_orderkey AS visit_no", _S("o_orderkey") + " AS uuid", _S("o_custkey") + " AS patient_id",
        f"{AREA} AS contact_parent_id", _S("o_orderkey % 500") + " AS contact_parent_parent_id",
        _COUNTY.format("c_nationkey") + " AS county",
        "CASE WHEN o_orderkey % 211 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN concat({mon}, '_2') ELSE {mon} END AS month",
        "{repm} AS reportedm",
        "CASE WHEN o_orderkey % 97 = 0 THEN 'unknown' ELSE {day} END AS reported",
        "CASE o_custkey % 5 WHEN 0 THEN 'male' WHEN 1 THEN 'Female' WHEN 2 THEN 'm' WHEN 3 THEN 'F' ELSE NULL END AS patient_sex",
        "CASE WHEN o_orderkey % 89 = 0 THEN 'n/a' WHEN o_orderkey % 83 = 0 THEN '-5' ELSE CAST({age} AS STRING) END AS patient_age_in_days",
        "CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE CAST(CAST(floor(({age}) / 30.4375) AS INT) AS STRING) END AS patient_age_in_months",
        "CAST(substr(o_orderpriority, 1, 1) AS INT) - 2 AS due_count",
        "CASE o_orderstatus WHEN 'O' THEN 'Yes ' WHEN 'F' THEN 'no' ELSE NULL END AS needs_follow_up",
        "CASE WHEN o_orderkey % 5 = 0 THEN 'penta_3' WHEN o_orderkey % 5 = 1 THEN '' ELSE NULL END AS vaccines_due_missed",
        "CASE o_custkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE NULL END AS is_in_malaria_endemic_region",
        "CASE WHEN o_orderkey % 7 = 0 THEN 'poor' ELSE CAST(o_orderkey % 160 AS STRING) END AS accuracy",
        *[_dose(i, n) for i, n in enumerate(CORE_DOSES)],
        *[_sparse_dose(i, n) for i, n in enumerate(MALARIA_DOSES)],
        *[_sparse_dose(i + 10, n) for i, (n, _) in enumerate(VITAMIN_A_SCHEDULE_MONTHS)],
    ]),
    # worker registry snapshots
    "registry": ("lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey "
                 "JOIN region ON n_regionkey = r_regionkey", [
        "l_orderkey", "l_linenumber", "l_partkey", _S("l_suppkey") + " AS chw_uuid", _S("l_suppkey") + " AS chw_area_uuid",
        "s_name AS chw_name", "concat('Area ', " + _S("l_suppkey") + ") AS chw_area_name",
        "concat(s_name, '-', l_linestatus) AS community_unit", _COUNTY.format("n_nationkey") + " AS county_name",
        "r_name AS sub_county_name", "CASE WHEN l_orderkey % 53 = 0 THEN NULL ELSE CAST(l_shipdate AS TIMESTAMP) END AS reported",
        "l_partkey AS chw_phone", _S("l_orderkey") + " AS record_hash",
    ]),
    # supervision events
    "supervision": ("events", [
        "event_id", _S("event_id") + " AS uuid", _S("user_id") + " AS chw_area", _S("user_id") + " AS chw_uuid",
        "CASE WHEN event_id % 61 = 0 THEN NULL ELSE CAST(ts AS TIMESTAMP) END AS reported",
        "value AS calc_immunization_score", "CAST(event_id % 40 AS DOUBLE) AS calc_immunization_denominator",
        "value / 2 AS calc_assessment_score", "CAST(event_id % 50 - 5 AS DOUBLE) AS calc_assessment_denominator",
        "CASE event_type WHEN 'click' THEN 'yes' WHEN 'view' THEN 'no' WHEN 'error' THEN 'False' ELSE NULL END AS has_all_tools",
        "CASE event_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE NULL END AS has_proper_protective_equipment",
        "CASE WHEN event_id % 50 = 0 THEN {inf} WHEN event_id % 51 = 0 THEN -{inf} ELSE value / 100 - 0.02 END AS perce_campaign_service_score",
        "0 AS calc_cancer_denominator", "props AS screening", "CAST(ts AS TIMESTAMP) AS last_visit_date",
        _S("event_id") + " AS record_hash",
    ]),
    # home visits
    "homevisit": ("lineitem", [
        "l_orderkey", "l_linenumber", "l_partkey", _S("l_suppkey") + " AS chw_area", _S("l_suppkey") + " AS chw_uuid",
        "CASE WHEN l_orderkey % 41 = 0 THEN NULL ELSE CAST(l_orderkey AS STRING) END AS family_id",
        "CASE WHEN l_orderkey % 43 = 0 THEN NULL ELSE CAST(l_shipdate AS TIMESTAMP) END AS reported",
        _S("l_orderkey") + " AS record_hash",
    ]),
    # population per worker
    "population": ("customer", [
        "c_custkey", _S("c_nationkey") + " AS chw_area", _S("c_nationkey") + " AS chw_uuid",
        "CASE WHEN c_custkey % 37 = 0 THEN NULL ELSE c_acctbal END AS u2_pop", "c_acctbal * 2 AS u5_pop",
        "c_acctbal - 500 AS wra_pop", "c_mktsegment AS unused", _S("c_custkey") + " AS record_hash",
    ]),
    # postnatal records
    "pnc": ("orders", [
        "o_orderkey AS record_no", _S("o_custkey") + " AS patient_id", "o_orderstatus",
        "CASE o_orderkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' ELSE NULL END AS is_immunization_defaulter",
        "o_orderkey % 40 - 1 AS days_since_delivery", "CAST(o_orderdate AS TIMESTAMP) AS reported",
    ]),
    # pregnancy registrations
    "preg": ("orders", [
        "o_orderkey AS record_no", "CAST(o_orderdate AS TIMESTAMP) AS reported",
        f"CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE {AREA} END AS contact_parent_parent_id",
        "CASE WHEN o_orderkey % 31 = 0 THEN 'none' ELSE CAST(o_orderkey % 6 AS STRING) END AS number_of_anc_attended",
        "CASE o_orderkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'No' WHEN 2 THEN '1' ELSE NULL END AS is_anc_defaulter",
        "CASE o_orderkey % 7 WHEN 0 THEN 'Green' WHEN 1 THEN NULL WHEN 2 THEN 'red' ELSE 'yellow' END AS muac_color",
        "CASE o_orderkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'No' ELSE NULL END AS takes_iron_or_folate_supplements",
    ]),
    # family planning and refills
    "planning": ("orders", [
        "o_orderkey AS record_no", "o_orderstatus",
        f"CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE {AREA} END AS contact_parent_id",
        "CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderpriority LIKE '1%' THEN ' Yes' ELSE 'no' END AS on_fp",
        "CAST(o_orderdate AS TIMESTAMP) AS reported",
    ]),
    # scored rows: heavy ties, both ends of [0, 1] reached
    "scored": ("lineitem", [
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y", "CAST(round(l_discount * 100) AS INT) / 10.0E0 AS p",
        "l_quantity / 50 AS p_fine", "(l_extendedprice - floor(l_extendedprice / 1000) * 1000) / 1000 AS p_many",
        "l_linestatus AS sex", "CAST(l_suppkey % 10 AS INT) AS county_code", "l_quantity AS age",
        "CAST(l_shipdate AS TIMESTAMP) AS event_datetime",
    ]),
    # numeric features with missing values
    "features": ("lineitem", [
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y",
        "CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_extendedprice END AS price",
        "l_quantity AS quantity", "CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_discount END AS discount",
        "CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE 0 END AS even", "7 AS constant", "CAST(NULL AS DOUBLE) AS absent",
        "l_extendedprice / l_quantity AS unit_price", "CAST(l_shipdate AS TIMESTAMP) AS event_datetime",
    ]),
}

_SOURCES = {"orders", "lineitem", "customer", "supplier", "nation", "region", "events"}


def _exprs(name: str, dialect: str) -> list[str]:
    return [e.format(**_WORDS[dialect]) for e in STANDINS[name][1]]


def spark_table(tables, name: str):
    source = STANDINS[name][0].split()
    df = tables.raw(source[0])
    for i, word in enumerate(source):
        if word == "JOIN":
            left, _, right = source[i + 3: i + 6]
            other = tables.raw(source[i + 1])
            df = df.join(other, df[left] == other[right])
    return df.selectExpr(*_exprs(name, "spark"))


# Cleaned forms, built step by step in SQL for the checks.
_CLEAN = {
    "iz_clean": ("iz", """
        SELECT * REPLACE (
            try_cast(reported AS TIMESTAMP) AS reported,
            try_cast(patient_age_in_months AS DOUBLE) AS patient_age_in_months,
            try_cast(patient_age_in_days AS DOUBLE) AS patient_age_in_days),
          CASE WHEN regexp_matches(month, '^[A-Za-z]{3}[0-9]{2}') THEN
            '20' || substr(month, 4, 2) || '-' || CASE lower(substr(month, 1, 3))
              WHEN 'jan' THEN '01' WHEN 'feb' THEN '02' WHEN 'mar' THEN '03' WHEN 'apr' THEN '04'
              WHEN 'may' THEN '05' WHEN 'jun' THEN '06' WHEN 'jul' THEN '07' WHEN 'aug' THEN '08'
              WHEN 'sep' THEN '09' WHEN 'oct' THEN '10' WHEN 'nov' THEN '11' WHEN 'dec' THEN '12' ELSE '00' END
            ELSE month END AS month_clean,
          CASE WHEN due_count >= 0 THEN CAST(due_count AS DOUBLE) END AS due_count_clean,
          CASE lower(trim(needs_follow_up)) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS needs_follow_up_binary,
          CASE WHEN lower(patient_sex) IN ('male', 'm') THEN 1 WHEN lower(patient_sex) IN ('female', 'f') THEN 0 END AS patient_sex_binary
        FROM iz"""),
    "iz_latest": ("iz_clean", """
        SELECT * FROM iz_clean
        QUALIFY row_number() OVER (PARTITION BY patient_id, month_clean ORDER BY reported DESC NULLS LAST, visit_no DESC) = 1"""),
    "iz_target": ("iz_latest", """
        SELECT *, CASE WHEN needs_follow_up_binary = 1 THEN 1 ELSE 0 END AS _target_needs_fu,
          CASE WHEN due_count_clean > 0 THEN 1 ELSE 0 END AS _target_due_pos,
          CASE WHEN vaccines_due_missed IS NOT NULL AND vaccines_due_missed <> '' THEN 1 ELSE 0 END AS _target_missed_flag,
          CASE WHEN needs_follow_up_binary = 1 OR due_count_clean > 0 OR (vaccines_due_missed IS NOT NULL AND vaccines_due_missed <> '')
            THEN 1 ELSE 0 END AS is_defaulter
        FROM iz_latest"""),
    "slv_iz": ("iz", """
        SELECT visit_no, trim(patient_id) AS child_key, try_cast(reported AS TIMESTAMP) AS event_datetime,
          strftime(try_cast(reported AS TIMESTAMP), '%Y-%m') AS year_month,
          CASE lower(trim(patient_sex)) WHEN 'm' THEN 'male' WHEN 'f' THEN 'female' ELSE lower(trim(patient_sex)) END AS sex,
          patient_sex, contact_parent_id AS chw_key,
          CASE WHEN try_cast(patient_age_in_days AS DOUBLE) >= 0 THEN try_cast(patient_age_in_days AS DOUBLE) END AS age_days,
          CASE WHEN lower(trim(county)) IN ('nairobi', 'kisumu', 'meru', 'homa bay') THEN lower(trim(county)) END AS county_clean,
          CASE WHEN lower(trim(county)) IN ('nairobi', 'kisumu', 'meru', 'homa bay') THEN 1 ELSE 0 END AS county_valid_flag,
          CAST((month IS NULL)::INT + (county IS NULL)::INT + (patient_sex IS NULL)::INT AS DOUBLE) / 3 AS row_missingness_pct,
          has_bcg, has_opv_0, has_opv_1, has_penta_1, has_pcv_1, has_rota_1, has_opv_2, has_penta_2, has_pcv_2, has_rota_2,
          has_opv_3, has_penta_3, has_pcv_3, has_ipv, has_measles_9_months
        FROM iz"""),
    "cohort": ("slv_iz", """
        SELECT child_key, year_month AS index_month, max(event_datetime) AS index_date,
          arg_max(sex, (event_datetime, visit_no)) FILTER (sex IS NOT NULL) AS sex, max(age_days) AS age_days,
          arg_max(county_clean, (event_datetime, visit_no)) FILTER (county_clean IS NOT NULL) AS county_clean,
          max(county_valid_flag) AS county_valid_flag, avg(row_missingness_pct) AS row_missingness_pct
        FROM slv_iz WHERE child_key IS NOT NULL AND year_month IS NOT NULL GROUP BY 1, 2"""),
    "slv_registry": ("registry", """
        SELECT *, trim(chw_uuid) AS chw_key, reported AS registry_snapshot_datetime,
          strftime(reported, '%Y-%m') AS registry_snapshot_month,
          lower(trim(chw_area_name)) AS chw_area_clean, lower(trim(community_unit)) AS community_unit_clean,
          lower(trim(sub_county_name)) AS sub_county_clean,
          CASE WHEN lower(trim(county_name)) IN ('nairobi', 'kisumu', 'meru', 'homa bay') THEN lower(trim(county_name)) END AS county_clean
        FROM registry"""),
    "registry_latest": ("slv_registry", """
        SELECT * FROM slv_registry QUALIFY row_number() OVER (PARTITION BY chw_key
          ORDER BY registry_snapshot_datetime DESC NULLS LAST, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) = 1"""),
    "sup_area": ("supervision", """
        SELECT chw_area AS chw_area_key, count(reported) AS chw_supervision_frequency, max(reported) AS chw_last_supervision_date,
          avg(CASE WHEN calc_immunization_denominator > 0
            THEN least(greatest(calc_immunization_score / calc_immunization_denominator, 0), 1) END) AS chw_immunization_competency,
          avg(CASE WHEN calc_assessment_denominator > 0
            THEN least(greatest(calc_assessment_score / calc_assessment_denominator, 0), 1) END) AS chw_overall_assessment_pct,
          max(CASE WHEN lower(has_all_tools) IN ('yes', 'true', '1') THEN 1 WHEN lower(has_all_tools) IN ('no', 'false', '0') THEN 0 END) AS chw_has_all_tools,
          max(CASE has_proper_protective_equipment WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END) AS chw_has_ppe
        FROM supervision WHERE chw_area IS NOT NULL GROUP BY 1"""),
    "pop_area": ("population", """
        SELECT chw_area AS chw_area_key, quantile_cont(u2_pop, 0.5) AS chw_workload_u2
        FROM population WHERE chw_area IS NOT NULL AND u2_pop IS NOT NULL GROUP BY 1"""),
    "hv_area": ("homevisit", """
        SELECT chw_area AS chw_area_key, count(family_id) AS total_homevisits,
          count(DISTINCT date_trunc('month', reported)) AS hv_distinct_months,
          CAST(count(family_id) AS DOUBLE) / nullif(count(DISTINCT date_trunc('month', reported)), 0) AS monthly_homevisit_rate
        FROM homevisit WHERE chw_area IS NOT NULL GROUP BY 1"""),
    "preg_area": ("preg", """
        SELECT contact_parent_parent_id AS chw_area_key, avg(try_cast(number_of_anc_attended AS DOUBLE)) AS maternal_anc_visits,
          avg(CASE WHEN lower(is_anc_defaulter) IN ('true', 'yes', '1') THEN 1.0 WHEN lower(is_anc_defaulter) IN ('false', 'no', '0') THEN 0.0 END) AS maternal_anc_defaulter,
          avg(CASE WHEN lower(muac_color) <> 'green' THEN 1.0 WHEN muac_color IS NOT NULL THEN 0.0 END) AS maternal_muac_risk,
          avg(CASE lower(trim(takes_iron_or_folate_supplements)) WHEN 'yes' THEN 1.0 WHEN 'no' THEN 0.0 END) AS maternal_iron_folate
        FROM preg WHERE contact_parent_parent_id IS NOT NULL GROUP BY 1"""),
    "sup_months": ("supervision", """
        SELECT trim(chw_uuid) AS chw_key, strftime(reported, '%Y-%m') AS year_month, count(uuid) AS supervision_events_last_90d,
          avg(calc_immunization_score) AS mean_immunization_score_90d,
          avg(CASE WHEN lower(trim(has_all_tools)) IN ('yes', 'true') THEN 1.0 WHEN lower(trim(has_all_tools)) IN ('no', 'false') THEN 0.0 END) AS pct_tools_available_90d,
          max(CASE WHEN reported IS NOT NULL THEN 0 END) AS days_since_last_supervision
        FROM supervision WHERE reported IS NOT NULL GROUP BY 1, 2"""),
    "hv_months": ("homevisit", """
        SELECT trim(chw_uuid) AS chw_key, strftime(reported, '%Y-%m') AS year_month,
          count(*) AS homevisit_count_30d, count(*) AS homevisit_count_90d
        FROM homevisit WHERE reported IS NOT NULL GROUP BY 1, 2"""),
}


def _needs(name: str, out: list[str]) -> None:
    if name in _CLEAN:
        _needs(_CLEAN[name][0], out)
    if name not in out:
        out.append(name)


def with_ctes(names: list[str], body: str) -> str:
    """The SELECT in ``body`` after the CTEs it needs, in order."""
    order: list[str] = []
    for n in names:
        _needs(n, order)
    parts = []
    for n in order:
        text = _CLEAN[n][1] if n in _CLEAN else "SELECT " + ", ".join(_exprs(n, "check")) + " FROM " + STANDINS[n][0]
        parts.append(f"{n} AS ({text.strip()})")
    head = "WITH " + ",\n".join(parts) if parts else ""
    body = body.strip()
    if head and body.upper().startswith("WITH "):
        return head + ",\n" + body[5:]
    return f"{head}\n{body}" if head else body
