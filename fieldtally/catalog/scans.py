"""Scans, sources and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import SOURCE_TABLES
from ..functions.text import trim_strings
from ..operators import profiles as P
from ..operators.metrics import curve_areas, point_metrics
from ..operators.ranking import risk_list
from ..plans.cleaners import clean_all, clean_visits
from ..plans.person_table import build_person_table
from ..session import fresh_path
from ..sources import tables as S
from .registry import query
from .shape import as_of, rounded, ts_text
from .standins import STANDINS


@query("a01_csv_scan", uses="iz", sql="""
  SELECT uuid, patient_id, trim(needs_follow_up) AS needs_follow_up,
    strftime(try_cast(reported AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS reported, 'iz' AS _source_table FROM iz""")
def _(t):
    path = fresh_path(t.spark, "csv") + ".csv"
    S.write_table(t.iz.select("uuid", "patient_id", "needs_follow_up", "reported"), path)
    df = S.csv_scan(t.spark, path, "iz", "uuid string, patient_id string, needs_follow_up string, reported string")
    return df.withColumn("reported", ts_text("reported"))


# The twelve source tables: a stand-in each, and the rows of it where two tables share one.
SOURCES = {
    "iz": ("iz", None), "active_chps": ("registry", None), "supervision": ("supervision", None), "homevisit": ("homevisit", None),
    "population": ("population", None), "pnc": ("pnc", None), "preg_reg": ("preg", "reported < '1998-01-01'"), "preg_reg2": ("preg", "reported >= '1998-01-01'"),
    "preg_visit": ("preg", "record_no % 2 = 0"), "preg_visit2": ("preg", "record_no % 2 = 1"), "fp": ("planning", "o_orderstatus = 'F'"),
    "refill": ("planning", "o_orderstatus != 'F'")}
ALL_SOURCES = "iz registry supervision homevisit population pnc preg planning"


def source_tables(t) -> dict:
    return {n: getattr(t, s) if rows is None else getattr(t, s).filter(rows) for n, (s, rows) in SOURCES.items()}


def columns_of(standin: str) -> list[str]:
    return [e.rsplit(" AS ", 1)[-1] for e in STANDINS[standin][1]]


def _per_source(select) -> str:
    """One SQL row per source table."""
    return " UNION ALL ".join(f"{select(n, columns_of(s))} FROM {s}" + (f" WHERE {rows}" if rows else "") for n, (s, rows) in SOURCES.items())


@query("a02_load_all", uses=ALL_SOURCES, sql="SELECT 'not_there' AS table_name, 0 AS loaded, NULL::BIGINT AS n_rows, NULL::INT AS n_columns UNION ALL "
       + _per_source(lambda n, columns: f"SELECT '{n}', 1, count(*), {len(columns) + 1}"))
def _(t):
    """All columns of all twelve tables as CSV, loaded with one more name that is not there."""
    folder = fresh_path(t.spark, "raw")
    for name, df in source_tables(t).items():
        S.write_table(df, f"{folder}/{name}.csv")
    found, missing = S.load_all(t.spark, folder, [*SOURCE_TABLES, "not_there"])
    names = t.spark.createDataFrame([(n, int(n not in missing)) for n in [*SOURCE_TABLES, "not_there"]], "table_name string, loaded int")
    counts = P.table_inventory(found).select(F.col("table_name").alias("_t"), F.col("raw_rows").alias("n_rows"), "n_columns")
    return names.join(counts, F.col("table_name") == F.col("_t"), "left").drop("_t")


@query("a03_trim_strings", uses="iz", sql="SELECT visit_no, trim(county) AS county, trim(needs_follow_up) AS needs_follow_up FROM iz")
def _(t):
    return trim_strings(t.iz.select("visit_no", "county", "needs_follow_up"))


@query("a04_parse_dates", uses="iz", sql="""
  SELECT visit_no, strftime(try_cast(reported AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS reported FROM iz""")
def _(t):
    return S.parse_dates(t.iz.select("visit_no", "reported"), "iz").withColumn("reported", ts_text("reported"))


@query("a05_load_summary", uses=ALL_SOURCES, sql=_per_source(
    lambda n, columns: f"SELECT '{n}' AS table_name, count(*) AS n_rows, {len(columns)} AS n_cols, "
    f"round(100.0 * sum({' + '.join(f'({c} IS NULL)::INT' for c in columns)}) / ({len(columns)} * count(*)), 6) AS null_pct"))
def _(t):
    return rounded(P.load_summary(source_tables(t)))


@query("a06_read_write_by_extension", uses="population", sql="""
  SELECT k AS kind, (SELECT count(*) FROM population) AS n, (SELECT round(sum(u2_pop), 2) FROM population) AS total
  FROM (SELECT unnest(['csv', 'parquet']) AS k)""")
def _(t):
    parts = []
    for kind in ("csv", "parquet"):
        path = fresh_path(t.spark, "io") + f".{kind}"
        S.write_table(t.population.select("chw_area", "u2_pop"), path)
        back = S.read_table(t.spark, path, "chw_area string, u2_pop double")
        parts.append(back.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.round(F.sum("u2_pop"), 2).alias("total")))
    return reduce(DataFrame.unionByName, parts)


@query("a07_table_inventory", sql="""
  SELECT 'orders' AS table_name, count(*) AS raw_rows, 6 AS n_columns FROM orders
  UNION ALL SELECT 'lineitem', count(*), 11 FROM lineitem UNION ALL SELECT 'events', count(*), 6 FROM events
  UNION ALL SELECT 'customer', count(*), 5 FROM customer""")
def _(t):
    return P.table_inventory({n: t.raw(n) for n in ("orders", "lineitem", "events", "customer")})


@query("a08_raw_layer_copy", uses="supervision homevisit", sql="""
  SELECT 'supervision' AS table_name, count(*) AS n FROM supervision UNION ALL SELECT 'homevisit', count(*) FROM homevisit""")
def _(t):
    folder = fresh_path(t.spark, "raw")
    names = ["supervision", "homevisit"]
    source = {n: getattr(t, n) for n in names}
    S.extract(source, names, folder)
    paths = S.extract(source, names, folder)  # a rerun overwrites
    return reduce(DataFrame.unionByName, [
        S.read_table(t.spark, p).agg(F.lit(n).alias("table_name"), F.count("*").alias("n")) for n, p in zip(names, paths)])


@query("a09_snapshot_count", uses="homevisit", sql="SELECT count(*) AS written, count(*) AS read_back FROM homevisit")
def _(t):
    path = fresh_path(t.spark, "snapshot") + ".parquet"
    n = S.snapshot(t.homevisit, path)
    return S.read_table(t.spark, path).agg(F.lit(n).cast("bigint").alias("written"), F.count("*").alias("read_back"))


def person_tables(t) -> dict:
    """Cleaned stand-ins by source name, and the unique columns of each."""
    raw = source_tables(t)
    raw["active_chps"] = t.registry.select("chw_area_uuid", "community_unit", "county_name", "sub_county_name", "reported",
                                           "chw_phone", "l_orderkey", "l_linenumber", "l_partkey")
    return clean_all({n: raw[n] for n in raw if not n.startswith("preg_visit")})


TIEBREAKS = {"iz": ["visit_no"], "active_chps": ["l_orderkey", "l_linenumber", "l_partkey"], "pnc": ["record_no"]}


def person_table(t) -> DataFrame:
    return build_person_table(person_tables(t), as_of(), TIEBREAKS)


PERSON_SQL = """
  WITH reg AS (SELECT chw_area_uuid, community_unit, county_name, sub_county_name FROM registry
      QUALIFY row_number() OVER (PARTITION BY chw_area_uuid ORDER BY reported DESC NULLS LAST, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) = 1),
    fp AS (SELECT contact_parent_id AS k, max(CASE lower(trim(on_fp)) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END) AS household_on_fp
      FROM planning WHERE contact_parent_id IS NOT NULL GROUP BY 1),
    audit AS (SELECT patient_id, CASE lower(trim(is_immunization_defaulter)) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS lab FROM pnc
      WHERE is_immunization_defaulter IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY record_no) = 1),
    cty AS (SELECT county, dense_rank() OVER (ORDER BY county) - 1 AS code FROM (SELECT DISTINCT county FROM iz WHERE county IS NOT NULL)),
    sub AS (SELECT sub_county_name AS s, dense_rank() OVER (ORDER BY sub_county_name) - 1 AS code
      FROM (SELECT DISTINCT reg.sub_county_name FROM iz JOIN reg ON iz.contact_parent_id = reg.chw_area_uuid)),
    full_rows AS (SELECT b.*, reg.*, s.* EXCLUDE (chw_area_key), p.chw_workload_u2, h.monthly_homevisit_rate, m.* EXCLUDE (chw_area_key),
        fp.household_on_fp, audit.lab, coalesce(cty.code, -1) AS county_encoded, coalesce(sub.code, -1) AS sub_county_encoded
      FROM iz_target b LEFT JOIN reg ON b.contact_parent_id = reg.chw_area_uuid LEFT JOIN sup_area s ON b.contact_parent_id = s.chw_area_key
      LEFT JOIN pop_area p ON b.contact_parent_id = p.chw_area_key LEFT JOIN hv_area h ON b.contact_parent_id = h.chw_area_key
      LEFT JOIN preg_area m ON b.contact_parent_id = m.chw_area_key LEFT JOIN fp ON b.contact_parent_id = fp.k
      LEFT JOIN audit ON b.patient_id = audit.patient_id LEFT JOIN cty ON b.county = cty.county LEFT JOIN sub ON reg.sub_county_name = sub.s),
    person AS (SELECT * FROM full_rows
      QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY reported DESC NULLS LAST, visit_no DESC) = 1)
"""
PERSON_USES = "iz_target registry sup_area pop_area hv_area preg_area planning pnc"
PERSON_COLUMNS = ("patient_id", "visit_no", "month_clean", "is_defaulter", "community_unit", "chw_supervision_frequency",
                  "chw_workload_u2", "monthly_homevisit_rate", "maternal_anc_visits", "maternal_muac_risk",
                  "household_on_fp", "_pnc_iz_defaulter", "county_encoded", "sub_county_encoded")


@query("a10_person_table_sink", uses=PERSON_USES, sql=PERSON_SQL + """
  SELECT patient_id, visit_no, month_clean, is_defaulter, community_unit, chw_supervision_frequency,
    round(chw_workload_u2, 6) AS chw_workload_u2, round(monthly_homevisit_rate, 6) AS monthly_homevisit_rate,
    round(maternal_anc_visits, 6) AS maternal_anc_visits, round(maternal_muac_risk, 6) AS maternal_muac_risk, household_on_fp,
    lab AS _pnc_iz_defaulter, CAST(county_encoded AS INT) AS county_encoded, CAST(sub_county_encoded AS INT) AS sub_county_encoded FROM person""")
def _(t):
    """The whole person table: clean, dedup, score, label, eight joins, codes, collapse; written and read back."""
    path = fresh_path(t.spark, "person") + ".parquet"
    S.write_table(person_table(t).drop("screening_parsed"), path)
    return rounded(S.read_table(t.spark, path).select(*PERSON_COLUMNS))


@query("a11_list_csv_export", uses="scored", sql="""
  SELECT l_orderkey, l_linenumber, l_partkey, p AS predicted_risk,
    CASE WHEN p <= 0.5 THEN 'medium' WHEN p <= 0.75 THEN 'high' ELSE 'critical' END AS risk_tier,
    'no recent home visit activity captured' AS reason_codes FROM scored WHERE p >= 0.5""")
def _(t):
    path = fresh_path(t.spark, "list") + ".csv"
    rows = t.scored.select("l_orderkey", "l_linenumber", "l_partkey", F.col("p").alias("predicted_risk"))
    S.export_csv(risk_list(rows), path)
    return S.read_table(t.spark, path, "l_orderkey bigint, l_linenumber int, l_partkey bigint, predicted_risk double, risk_tier string, reason_codes string")


@query("a12_metrics_json", uses="scored", sql="""
  SELECT count(*) AS n, sum(y)::BIGINT AS positives, round(avg((p - y) * (p - y)), 6) AS brier_score FROM scored""")
def _(t):
    path = fresh_path(t.spark, "metrics")
    out = curve_areas(t.scored, "y", "p").select("n", "positives").withColumn(
        "brier_score", point_metrics(t.scored, "y", "p").select("brier_score").scalar())
    S.write_json(out, path)
    return rounded(t.spark.read.schema("n bigint, positives bigint, brier_score double").json(path))


EXTRACTS = {"iz": [], "supervision": ["reported", "last_visit_date"], "active_chps": ["reported"], "homevisit": ["reported"], "population": []}


def _extract_sql(name):
    times = [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in EXTRACTS[name]]
    return "SELECT *" + (f" REPLACE ({', '.join(times)})" if times else "") + f" FROM {SOURCES[name][0]}"


for _name in EXTRACTS:
    @query(f"b03_extract_{_name}", uses=SOURCES[_name][0], sql=_extract_sql(_name))
    def _(t, n=_name):
        """Full-table select through a named view; times as text."""
        getattr(t, SOURCES[n][0]).createOrReplaceTempView(f"src_{n}")
        return t.spark.sql(f"SELECT * FROM src_{n}").withColumns({c: ts_text(c) for c in EXTRACTS[n]})


STAGING = {
    "iz": ("iz", {"uuid": "iz_event_key", "patient_id": "child_key", "patient_sex": "patient_sex", "patient_age_in_days": "patient_age_in_days",
                  "patient_age_in_months": "patient_age_in_months", "county": "county", "month": "month"}),
    "supervision": ("supervision", {"uuid": "supervision_event_key", "chw_uuid": "chw_key", "calc_assessment_score": "calc_assessment_score",
                                    "calc_immunization_score": "calc_immunization_score", "has_all_tools": "has_all_tools",
                                    "has_proper_protective_equipment": "has_proper_protective_equipment", "record_hash": "record_hash"}),
    "active_chps": ("registry", {"chw_uuid": "chw_key", "chw_name": "chw_name", "chw_area_uuid": "chw_area_key", "chw_area_name": "chw_area_name",
                                 "community_unit": "community_unit", "county_name": "county_name", "sub_county_name": "sub_county_name",
                                 "record_hash": "record_hash"}),
    "homevisit": ("homevisit", {"family_id": "family_key", "chw_uuid": "chw_key", "chw_area": "chw_area", "record_hash": "record_hash"}),
    "population": ("population", {"chw_uuid": "chw_key", "u2_pop": "u2_pop", "u5_pop": "u5_pop", "wra_pop": "wra_pop", "record_hash": "record_hash"}),
}
EVENT_TIMES = {"iz": "event_datetime", "supervision": "supervision_datetime", "active_chps": "registry_snapshot_datetime", "homevisit": "homevisit_datetime"}


def _staging_sql(name):
    source, names = STAGING[name]
    cols = [f"{a} AS {b}" for a, b in names.items()]
    if name in EVENT_TIMES:
        cols.append(f"strftime(try_cast(reported AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS {EVENT_TIMES[name]}")
    return f"SELECT {', '.join(cols)} FROM {source}"


for _name in STAGING:
    @query(f"b04_stage_{_name}", uses=STAGING[_name][0], sql=_staging_sql(_name))
    def _(t, n=_name):
        """Rename and project a raw table to its staging form."""
        source, names = STAGING[n]
        time = [ts_text(F.col("reported").try_cast("timestamp")).alias(EVENT_TIMES[n])] if n in EVENT_TIMES else []
        return getattr(t, source).select(*[F.col(a).alias(b) for a, b in names.items()], *time)


@query("b05_model_base_view", uses="iz_target", sql="SELECT visit_no, is_defaulter FROM iz_target")
def _(t):
    from ..plans.person_table import add_target, latest_visit_per_month
    add_target(latest_visit_per_month(clean_visits(t.iz), ["visit_no"])).select("visit_no", "is_defaulter") \
        .createOrReplaceTempView("gld_model_features_child_month")
    return t.spark.sql("SELECT * FROM gld_model_features_child_month")
