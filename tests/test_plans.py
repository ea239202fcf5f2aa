import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fieldtally.constants import CORE_DOSES, MALARIA_DOSES
from fieldtally.ml import attribution as X
from fieldtally.ml import train as T
from fieldtally.plans import cleaners as C
from fieldtally.plans import person_table as PT
from fieldtally.plans.person_months import silver_population, silver_supervision
from fieldtally.plans.person_table import build_person_table
from fieldtally.session import fresh_path
from fieldtally.sources import tables as S

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def raw(spark):
    rng = random.Random(42)
    cols = ["patient_id", "contact_parent_id", "county", "month", "reported", "patient_sex", "patient_age_in_months", "needs_follow_up",
            "due_count", "vaccines_due_missed", "is_in_malaria_endemic_region", *CORE_DOSES, *MALARIA_DOSES, "row_no"]
    rows = []
    for i in range(60):
        rows.append([f"pid_{i % 50}", f"area_{i % 5}", ["County A", "County B"][i % 2], ["Feb25_2", "Mar25", "Dec24"][i % 3],
                     f"2025-01-{i % 28 + 1:02d}", ["male", "female"][i % 2], str(i), ["yes", "no"][i % 2], str(i % 5 - 1),
                     [None, "measles_9_months", "penta_3"][i % 3], ["yes", "no", None][i % 3], *[rng.randint(0, 1) for _ in CORE_DOSES],
                     *[rng.choice([0.0, 1.0, None]) for _ in MALARIA_DOSES], i])
    schema = ", ".join(f"{c} {'int' if c in CORE_DOSES + ('row_no',) else 'double' if c in MALARIA_DOSES else 'string'}" for c in cols)
    return spark.createDataFrame(rows, schema)


def test_clean_visits(raw):
    df = C.clean_visits(raw)
    rows = df.collect()
    assert all(r["due_count_clean"] is None or r["due_count_clean"] >= 0 for r in rows)
    assert {r["month_clean"] for r in rows} == {"2025-02", "2025-03", "2024-12"}
    assert all(r["has_malaria_6_vaccine"] is not None for r in rows if r["is_in_malaria_endemic_region"] != "yes")


def test_person_table(spark, raw):
    sup = spark.createDataFrame([("area_0", "2025-01-01", 3.0, 4.0, "yes"), ("area_0", "2025-01-10", 1.0, 0.0, "no")],
                                "chw_area string, reported string, calc_immunization_score double, calc_immunization_denominator double, has_all_tools string")
    sup = sup.withColumns({"calc_assessment_score": F.lit(1.0), "calc_assessment_denominator": F.lit(2.0), "has_proper_protective_equipment": F.lit("no")})
    pop = spark.createDataFrame([("area_0", 20), ("area_0", 25), ("area_1", 30)], "chw_area string, u2_pop int")
    hv = spark.createDataFrame([("area_0", "f1", "2025-01-01"), ("area_0", "f2", "2025-02-01"), ("area_0", "f2", None)], "chw_area string, family_id string, reported string")
    tables = C.clean_all({"iz": raw, "supervision": sup, "population": pop, "homevisit": hv})
    df = build_person_table(tables, F.to_timestamp(F.lit("2025-06-01")), {"iz": ["row_no"]}).cache()
    assert df.count() == 50 == df.select("patient_id").distinct().count()
    one = df.filter("contact_parent_id = 'area_0'").first()
    assert one["chw_workload_u2"] == 22.5 and one["monthly_homevisit_rate"] == 1.5
    assert one["chw_immunization_competency_pct"] == 0.75 and one["chw_has_all_tools"] == 1
    assert set(r[0] for r in df.select("is_defaulter").distinct().collect()) <= {0, 1}
    assert {(r[0], r[1]) for r in df.select("county", "county_encoded").distinct().collect()} == {("County A", 0), ("County B", 1)}
    assert df.filter("vax_completeness_score < 0 or vax_completeness_score > 1").count() == 0


def test_only_kept_visits_are_scored(spark, raw, monkeypatch):
    """The person table scores a visit per person, as if all had been scored and then collapsed."""
    registry = spark.createDataFrame([(f"area_{i % 5}", f"unit {i}", "Meru", f"sub {i}", f"2025-01-{i + 1:02d}", "1", i) for i in range(10)],
                                     "chw_area_uuid string, community_unit string, county_name string, sub_county_name string, reported string, chw_phone string, no int")
    tables = C.clean_all({"iz": raw, "active_chps": registry})
    scored, read, score, latest, as_of = [], [], PT.add_dose_scores, PT.latest_rows, F.to_timestamp(F.lit("2025-06-01"))
    monkeypatch.setattr(PT, "add_dose_scores", lambda df, at: scored.append(df.count()) or score(df, at))
    monkeypatch.setattr(PT, "latest_rows", lambda df, keys, *a: read.append((*keys, df.count())) or latest(df, keys, *a))
    df = build_person_table(tables, as_of, {"iz": ["row_no"], "active_chps": ["no"]})
    assert scored == [50]
    # The registry itself is ranked once; the joins see a row per area.
    assert sorted(n for key, *_, n in read if key == "chw_area_uuid") == [5, 5, 10]
    visits = PT.latest_visit_per_month(tables["iz"], ["row_no"])
    assert visits.count() == 60
    late = PT.join_registry(PT.add_target(score(visits, as_of)), tables["active_chps"], ["no"])
    late = latest(late, ["patient_id"], "reported", ["row_no"])
    shared = [c for c in late.columns if c in df.columns]
    assert set(late.columns) <= set(df.columns) and sorted(map(repr, df.select(shared).collect())) == sorted(map(repr, late.select(shared).collect()))
    assert {r[0]: r[1] for r in df.select("sub_county_name", "sub_county_encoded").distinct().collect()} == {f"sub {i + 5}": i for i in range(5)}


def test_silver(spark):
    sup = spark.createDataFrame([("1", "w ", "bad", "yes", 1.0, 0.0)], "UUID string, `Chw Uuid` string, reported string, has_all_tools string, calc_immunization_score double, calc_immunization_denominator double")
    r = silver_supervision(sup).first()
    assert (r["chw_key"], r["year_month"], r["has_all_tools"], r["immunization_score_valid_flag"]) == ("w", None, 1, 0)
    pop = spark.createDataFrame([("w", -1.0), ("v", None), ("u", 0.0)], "chw_uuid string, u2_pop double")
    assert [r["population_context_valid_flag"] for r in silver_population(pop).collect()] == [0, 0, 1]


def test_sources(spark):
    folder = fresh_path(spark, "t")
    df = spark.createDataFrame([("a ", "2025-01-01"), ("b", "junk")], "chw_area string, reported string")
    S.write_table(df, f"{folder}/homevisit.csv")
    found, missing = S.load_all(spark, folder)
    assert list(found) == ["homevisit"] and len(missing) == 11
    rows = {r["chw_area"]: r for r in found["homevisit"].collect()}
    assert rows["b"]["reported"] is None and rows["a"]["_source_table"] == "homevisit"
    assert S.snapshot(df, f"{folder}/snap.parquet") == 2
    with pytest.raises(ValueError):
        S.extract({"x": df}, ["x"], folder)


def test_model_round_trip_and_attributions(spark):
    rows = [(i, float(i % 10), float(i % 3) if i % 7 else None, i % 2, ["n", "s", None][i % 3], int(i % 10 > 5) if i % 11 else 1) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, a double, b double, f int, c string, y int")
    model = T.train(df, "y", ["id"], ["a", "b"], ["f"], ["c"], T.TrainSettings(trees=3, depth=2, step=0.3, folds=2))
    folder = fresh_path(spark, "m")
    model.save(spark, folder)
    again = T.RiskModel.load(spark, folder)
    assert again.names == ["a", "b", "f", "c"]
    scored = again.score(df).select("id", "risk_score", "risk_tier", "features")
    before = {r["id"]: r["risk_score"] for r in model.score(df).select("id", "risk_score").collect()}
    after = {r["id"]: r["risk_score"] for r in scored.collect()}
    assert before == after and all(0 <= p <= 1 for p in after.values())
    out = X.payload(X.attributions(scored, X.read_leaves(spark, f"{folder}/trees")), again.names, ["id"], "v").collect()
    assert len(out) == 400 and all(len(r["top_drivers"]) == 3 and r["recommended_action"] for r in out)


def test_registry_is_consistent():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 170


@pytest.mark.parametrize("name", ["flagship_monthly_prevalence", "d03_homevisit_rate", "e07_registry_record_rank", "i12_roc_auc_many", "i26_psi_drift"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "customer", "supplier", "nation", "region", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    res = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(repr, res.fetchall()))
