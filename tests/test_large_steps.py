"""Steps that may not put one feature into one task, nor shuffle what a row gives by itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.ml import attribution as X
from fieldtally.operators import drift as D
from fieldtally.operators import profiles as P
from fieldtally.operators import quantiles as Q
from fieldtally.plans.person_months import silver_registry


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def large(spark):
    """No side is small enough to be broadcast by its size."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def values(spark):
    return spark.range(2000).select((F.col("id") * 0.5).alias("a"), F.when(F.col("id") % 4 > 0, F.col("id") % 50).alias("b"), F.lit("x").alias("c"))


def test_feature_report_joins_no_feature_by_shuffle(spark, large):
    x = values(spark)
    out = P.feature_report(x, ["a", "b"])
    assert "hashpartitioning(position" in plan(out)  # the short totals
    assert plan(out).count("BroadcastHashJoin [position") >= 1
    got = {r["feature"]: r for r in out.collect()}
    want = x.agg(F.stddev_samp("a"), F.stddev_samp("b"), F.avg("b")).first()
    assert abs(got["a"]["std"] - want[0]) < 1e-9 and abs(got["b"]["std"] - want[1]) < 1e-9 and abs(got["b"]["mean"] - want[2]) < 1e-9
    assert got["b"]["null_pct"] == 25.0 and got["b"]["n_unique"] == len({i % 50 for i in range(2000) if i % 4})


def test_drift_bins_are_counted_without_a_shuffle_by_feature(spark, large):
    long = D.long_form(values(spark), ["a", "b"])
    edges = long.groupBy("feature").agg(F.array(F.min("value"), F.avg("value"), F.max("value")).alias("bins"))
    out = D._bin_counts(long, edges, F.lit(1))
    assert "SortMergeJoin" not in plan(out) and "BroadcastHashJoin" in plan(out)
    assert {(r["feature"], r["bin"]): r["n"] for r in out.filter("feature = 'a'").collect()} == {("a", 1): 1000, ("a", 2): 1000}


def test_registry_is_ranked_before_it_is_cleaned(spark, monkeypatch):
    from fieldtally.plans import person_months as M
    raw = spark.range(40).select(F.col("id").alias("no"), (F.col("id") % 3).cast("string").alias("chw_uuid"), F.concat(F.lit("2001-01-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0")).alias("reported"),
                                 F.lit(" Meru").alias("county_name"), F.lit("S ").alias("sub_county_name"))
    seen = []
    rank = M.record_rank
    monkeypatch.setattr(M, "record_rank", lambda df, *a: seen.append(df.columns) or rank(df, *a))
    with_rank, without = silver_registry(raw, ["no"]), silver_registry(raw)
    assert set(seen[0]) == {*raw.columns, "chw_key", "registry_snapshot_datetime"}
    place = with_rank.columns.index("chw_registry_record_rank")
    assert with_rank.columns[:place] == without.columns[:place] and with_rank.columns[place + 1:] == without.columns[place:]
    shared = [c for c in without.columns if c != "row_missingness_pct"]
    assert sorted(map(str, with_rank.select(shared).collect())) == sorted(map(str, without.select(shared).collect()))
    assert sorted(r[0] for r in with_rank.filter("chw_key = '1'").select("chw_registry_record_rank").collect()) == list(range(1, 14))


def test_drivers_and_records_are_listed_without_lambdas(spark):
    """Lambdas are worked through node by node for every row; a row has as many drivers as any other."""
    names = ["patient_age_in_months", "has_bcg", "county"]
    rows = [(0, 0.7, "HIGH", [5.0, 1.0, 2.0], [0.1, -0.3, 0.1]), (1, 0.2, "LOW", [7.0, 0.0, 1.0], [0.0, 0.0, -0.5]), (2, 0.4, "MEDIUM", None, None)]
    df = spark.createDataFrame(rows, "id int, risk_score double, risk_tier string, feature_values array<double>, shap_values array<double>")
    out = X.payload(df, names, ["id"], "v", 2)
    assert "lambda" not in plan(out)
    got = {r["id"]: r["top_drivers"] for r in out.collect()}
    assert [d["feature"] for d in got[0]] == ["has_bcg", "patient_age_in_months"] and [d["feature"] for d in got[1]] == ["county", "patient_age_in_months"]
    assert [(d["feature_value"], d["shap_value"], d["direction"]) for d in got[0]] == [(1.0, -0.3, "decreases_risk"), (5.0, 0.1, "increases_risk")]
    assert got[2] is None and all(len(r["top_drivers"]) == 3 for r in X.payload(df, names, ["id"], "v", 5).filter("id < 2").collect())


def test_ranks_are_searched_in_cells_of_bounded_size(spark, monkeypatch):
    """A piece is the table's rows by the number of partitions; one of them may not be sorted whole for a rank."""
    counts = spark.range(400_000).select(F.col("id").alias("v"), F.lit(1).cast("bigint").alias("n"))
    assert Q.ranked_cells(counts, "v").groupBy("_cell").count().agg(F.max("count")).first()[0] <= 1 << Q.CELL_BITS
    monkeypatch.setattr(Q, "CELL_BITS", 2)
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 101 * 0.5).alias("v"))
    got = {r["g"]: r["q"] for r in Q.exact_quantiles(df, "v", [0.0, 0.1, 0.5, 0.93, 1.0], ["g"], "q").collect()}
    for g in range(3):
        want = np.quantile([i * 7919 % 101 * 0.5 for i in range(1000) if i % 3 == g], [0.0, 0.1, 0.5, 0.93, 1.0])
        assert np.allclose(got[g], want, atol=1e-12)
