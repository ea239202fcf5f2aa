"""Latest rows, codes, history, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking as R
from ..operators.aggregates import trailing_activity
from ..operators.codes import encode_categories, mask_names
from ..operators.history import prior_events
from ..operators.latest import latest_rows, record_rank, removed_report, rows_at_positions
from ..plans.cleaners import clean_visits
from ..plans.person_table import latest_visit_per_month
from ..sources.tables import latest_per_month, latest_registry
from .joins import REG_KEYS, narrow_silver, registry_silver
from .registry import query
from .shape import ts_text

_REG_DESC = "l_orderkey DESC, l_linenumber DESC, l_partkey DESC"
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_K = ", ".join(KEY)


@query("e01_latest_visit_per_month", uses="iz_latest", sql="""
  SELECT visit_no, patient_id, month_clean, strftime(reported, '%Y-%m-%d %H:%M:%S') AS reported FROM iz_latest""")
def _(t):
    return latest_visit_per_month(clean_visits(t.iz), ["visit_no"]).select("visit_no", "patient_id", "month_clean", ts_text("reported").alias("reported"))


@query("e02_distinct_on_month", uses="iz", sql="""
  SELECT visit_no, patient_id, reportedm FROM iz QUALIFY row_number() OVER (PARTITION BY patient_id, reportedm
    ORDER BY try_cast(reported AS TIMESTAMP) DESC NULLS FIRST, visit_no DESC) = 1""")
def _(t):
    """Source-side form: other month key, a null date wins."""
    x = t.iz.select("visit_no", "patient_id", "reportedm", F.col("reported").try_cast("timestamp").alias("reported"))
    return latest_per_month(x, ["visit_no"]).select("visit_no", "patient_id", "reportedm")


@query("e03_latest_registry_per_area", uses="registry", sql=f"""
  SELECT chw_area_uuid, community_unit, county_name, sub_county_name, strftime(reported, '%Y-%m-%d %H:%M:%S') AS reported, chw_phone FROM registry
  QUALIFY row_number() OVER (PARTITION BY chw_area_uuid ORDER BY reported DESC NULLS FIRST, {_REG_DESC}) = 1""")
def _(t):
    return latest_registry(t.registry, REG_KEYS).withColumn("reported", ts_text("reported"))


@query("e04_latest_registry_per_worker", uses="registry_latest", sql="SELECT chw_key, l_orderkey, l_linenumber, l_partkey, county_clean FROM registry_latest")
def _(t):
    return latest_rows(registry_silver(t), ["chw_key"], "registry_snapshot_datetime", REG_KEYS).select(
        "chw_key", "l_orderkey", "l_linenumber", "l_partkey", "county_clean")


@query("e05_latest_status", uses="slv_iz", sql="""
  SELECT child_key, year_month, visit_no, has_penta_1, has_penta_3 FROM slv_iz
  QUALIFY row_number() OVER (PARTITION BY child_key, year_month ORDER BY event_datetime DESC NULLS LAST, visit_no DESC) = 1""")
def _(t):
    return latest_rows(narrow_silver(t), ["child_key", "year_month"], "event_datetime", ["visit_no"]).select(
        "child_key", "year_month", "visit_no", "has_penta_1", "has_penta_3")


@query("e06_collapse_to_person", uses="iz_latest", sql="""
  SELECT patient_id, visit_no, month_clean FROM iz_latest QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY reported DESC NULLS LAST, visit_no DESC) = 1""")
def _(t):
    return latest_rows(latest_visit_per_month(clean_visits(t.iz), ["visit_no"]), ["patient_id"], "reported", ["visit_no"]).select(
        "patient_id", "visit_no", "month_clean")


@query("e06_collapse_report", uses="iz_latest", sql="""
  SELECT count(*) AS rows_before, count(DISTINCT patient_id) AS keys_before, count(DISTINCT patient_id) AS rows_after, count(*) - count(DISTINCT patient_id) AS rows_removed FROM iz_latest""")
def _(t):
    before = latest_visit_per_month(clean_visits(t.iz), ["visit_no"])
    return removed_report(before, latest_rows(before, ["patient_id"], "reported", ["visit_no"]), "patient_id")


@query("e07_registry_record_rank", uses="registry", sql="""
  SELECT l_orderkey, l_linenumber, l_partkey, chw_uuid, row_number() OVER (PARTITION BY chw_uuid ORDER BY reported NULLS LAST, l_orderkey, l_linenumber, l_partkey) AS record_rank FROM registry""")
def _(t):
    x = t.registry.select(*REG_KEYS, "chw_uuid", "reported")
    return record_rank(x, "chw_uuid", "reported", REG_KEYS, "record_rank").drop("reported")


@query("e08_category_codes", uses="iz registry", sql="""
  SELECT l_orderkey, l_linenumber, l_partkey, CAST(coalesce(a.c, -1) AS INT) AS county_code, CAST(b.c AS INT) AS unit_code FROM registry r
  LEFT JOIN (SELECT county_name AS v, dense_rank() OVER (ORDER BY county_name) - 1 AS c FROM (SELECT DISTINCT county_name FROM registry WHERE county_name IS NOT NULL)) a ON r.county_name = a.v
  LEFT JOIN (SELECT community_unit AS v, dense_rank() OVER (ORDER BY community_unit) - 1 AS c FROM (SELECT DISTINCT community_unit FROM registry)) b ON r.community_unit = b.v""")
def _(t):
    x = t.registry.select(*REG_KEYS, "county_name", "community_unit")
    return encode_categories(x, {"county_name": "county_code", "community_unit": "unit_code"}).drop("county_name", "community_unit")


@query("e09_mask_names", uses="iz", sql="""
  SELECT i.visit_no, 'County ' || chr(65 + d.c::INT) AS county FROM iz i LEFT JOIN (
    SELECT county, dense_rank() OVER (ORDER BY county) - 1 AS c FROM (SELECT DISTINCT county FROM iz WHERE county IS NOT NULL)) d ON i.county = d.county""")
def _(t):
    return mask_names(t.iz.select("visit_no", "county"), "county")


@query("e10_prior_events", uses="iz_target", sql="""
  SELECT visit_no, CAST(coalesce(sum(_target_needs_fu) OVER w, 0) AS BIGINT) AS prior_follow_up_flag_count, CAST(coalesce(sum(is_defaulter) OVER w, 0) AS BIGINT) AS prior_default_flag_count,
    CAST(floor((epoch_us(reported) - epoch_us(lag(reported) OVER (PARTITION BY patient_id ORDER BY reported NULLS LAST, visit_no))) / 86400000000.0) AS BIGINT) AS days_since_last_iz_event
  FROM iz_target WINDOW w AS (PARTITION BY patient_id ORDER BY reported NULLS LAST, visit_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(t):
    from .checks import target_rows
    x = target_rows(t).select("visit_no", "patient_id", "reported", "_target_needs_fu", "is_defaulter")
    return prior_events(x, "patient_id", "reported", ["visit_no"], "_target_needs_fu", "is_defaulter").select(
        "visit_no", "prior_follow_up_flag_count", "prior_default_flag_count", "days_since_last_iz_event")


@query("e11_trailing_activity", uses="homevisit", sql="""
  WITH d AS (SELECT chw_area, CAST(reported AS DATE) AS activity_date, count(*) AS events_on_day FROM homevisit WHERE reported IS NOT NULL GROUP BY 1, 2)
  SELECT chw_area, activity_date, events_on_day,
    CAST(sum(events_on_day) OVER (PARTITION BY chw_area ORDER BY activity_date RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW) AS BIGINT) AS trailing_30d,
    CAST(sum(events_on_day) OVER (PARTITION BY chw_area ORDER BY activity_date RANGE BETWEEN INTERVAL 89 DAYS PRECEDING AND CURRENT ROW) AS BIGINT) AS trailing_90d FROM d""")
def _(t):
    return trailing_activity(t.homevisit, "chw_area", "reported", {"trailing_30d": 30, "trailing_90d": 90})


@query("f01_action_list", uses="scored", sql=f"SELECT {_K}, p_many FROM scored ORDER BY p_many DESC, {_K} LIMIT 20")
def _(t):
    return R.action_list(t.scored.select(*KEY, "p_many"), "p_many", KEY, 20)


@query("f04_ranked_risk_list", uses="scored", sql=f"""
  SELECT {_K}, p AS predicted_risk, CASE WHEN p <= 0.5 THEN 'medium' WHEN p <= 0.75 THEN 'high' ELSE 'critical' END AS risk_tier,
    concat_ws(';', CASE WHEN y > 0 THEN 'child currently has due vaccines outstanding' END, CASE WHEN l_suppkey % 3 = 0 THEN 'no recent home visit activity captured' END) AS reason_codes
  FROM scored WHERE p >= 0.5""")
def _(t):
    x = t.scored.select(*KEY, F.col("p").alias("predicted_risk"), F.col("y").alias("num_due_vaccines_rebuilt"),
                        (F.col("l_suppkey") % 3).alias("homevisit_count_30d"))
    return R.risk_list(x, 0.5, tiebreak=KEY).select(*KEY, "predicted_risk", "risk_tier", F.array_join("reason_codes", ";").alias("reason_codes"))


@query("f05_example_per_tier", uses="scored", sql=f"""
  SELECT {_K}, p_many, CASE WHEN p_many < 0.33 THEN 'LOW' WHEN p_many < 0.6 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_tier FROM scored
  QUALIFY row_number() OVER (PARTITION BY risk_tier ORDER BY p_many DESC, {_K}) = 1""")
def _(t):
    return R.example_per_tier(t.scored.select(*KEY, "p_many"), "p_many", KEY)


@query("f06_rows_at_positions", uses="scored", sql=f"""
  WITH r AS (SELECT {_K}, p_many, row_number() OVER (ORDER BY p_many, {_K}) - 1 AS pos, count(*) OVER () AS n FROM scored)
  SELECT {_K}, p_many, CASE WHEN pos = n // 10 THEN 'Low risk' WHEN pos = n // 2 THEN 'Medium risk' ELSE 'High risk' END AS example
  FROM r WHERE pos IN (n // 10, n // 2, n - CAST(ceil(n / 10.0) AS BIGINT))""")
def _(t):
    return rows_at_positions(t.scored.select(*KEY, "p_many"), "p_many", KEY, {
        "Low risk": (0.1, False), "Medium risk": (0.5, False), "High risk": (0.1, True)})
