import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.ml.attribution import Leaf, attribute, expected_margin
from fieldtally.operators import checks as K
from fieldtally.operators import drift as D
from fieldtally.operators import joins as J
from fieldtally.operators import metrics as M
from fieldtally.operators import profiles as P
from fieldtally.operators import splits as S
from fieldtally.ml.prepare import OneHot
from fieldtally.ml.train import fit_isotonic
from fieldtally.operators.codes import encode_categories, mask_names
from fieldtally.operators.history import prior_events
from fieldtally.operators.latest import latest_rows, record_rank, rows_at_positions
from fieldtally.operators.quantiles import exact_quantiles, most_frequent
from fieldtally.operators.scan import range_pieces, segmented_totals
from fieldtally.operators.stats import correlation_matrix, label_correlation, safe_corr, t_test_p


def test_latest_rows_ties_and_null_times(spark):
    rows = [("a", "2025-01-02", 1), ("a", "2025-01-02", 2), ("a", None, 9), ("b", None, 3), (None, "2025-01-01", 4)]
    df = spark.createDataFrame(rows, "k string, ts string, id int").withColumn("ts", F.col("ts").cast("timestamp"))
    last = {r["k"]: r["id"] for r in latest_rows(df, ["k"], "ts", ["id"]).collect()}
    assert last == {"a": 2, "b": 3, None: 4}
    first = {r["k"]: r["id"] for r in latest_rows(df, ["k"], "ts", ["id"], nulls_first=True).collect()}
    assert first["a"] == 9


def test_latest_rows_prunes_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "timestamp_seconds(id) AS ts", "id")
    plan = latest_rows(df, ["k"], "ts", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit") and "Partial" in plan


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_exact_quantiles_match_numpy(spark, seed):
    rng = random.Random(seed)
    rows = []
    for g, n in (("hot", 900), ("b", 40), ("one", 1), ("two", 2)):
        for _ in range(n):
            rows.append((g, rng.choice([0.0, -3.5, 1e-12, rng.gauss(0, 100), rng.gauss(1e6, 1e-3), round(rng.random(), 1), 1e300])))
    rows += [("b", None), ("empty", None)]
    shares = [0, 0.1, 0.25, 0.5, 0.77, 1]
    got = {r["g"]: r["quantiles"] for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "v", shares, ["g"]).collect()}
    assert set(got) == {"hot", "b", "one", "two"}
    for g in got:
        want = np.quantile([v for k, v in rows if k == g and v is not None], shares)
        assert np.allclose(got[g], want, rtol=1e-12), g


def test_most_frequent_smallest_on_ties(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 1.0), ("a", 2.0), ("a", 1.0), ("b", None), ("b", 5.0)], "g string, v double")
    assert {r["g"]: r["mode"] for r in most_frequent(df, "v", ["g"]).collect()} == {"a": 1.0, "b": 5.0}


def test_record_rank_on_a_hot_key(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 3 else f"k{i % 9}", None if i % 17 == 0 else f"2025-0{rng.randint(1, 6)}-0{rng.randint(1, 9)}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, ts string, id int").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r["id"]: r["rank"] for r in record_rank(df, "k", "ts", ["id"], "rank").collect()}
    by_key = {}
    for r in rows:
        by_key.setdefault(r[0], []).append(r)
    want = {}
    for items in by_key.values():
        for n, r in enumerate(sorted(items, key=lambda r: (r[1] is None, r[1] or "", r[2])), 1):
            want[r[2]] = n
    assert got == want


def test_prior_events_across_months(spark):
    rows = [("a", "2025-01-30", 1, 1, 1), ("a", "2025-01-31", 2, 0, 1), ("a", "2025-03-02", 3, 1, 0), ("a", None, 4, 1, 1), ("b", "2025-01-01", 5, 1, 1)]
    df = spark.createDataFrame(rows, "k string, ts string, id int, f int, d int").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r["id"]: tuple(r)[-3:] for r in prior_events(df, "k", "ts", ["id"], "f", "d").collect()}
    assert got == {1: (0, 0, None), 2: (1, 1, 1), 3: (1, 2, 30), 4: (2, 2, None), 5: (0, 0, None)}


def test_rows_at_positions(spark):
    df = spark.createDataFrame([(i, (i * 37 % 100) / 100) for i in range(100)], "id int, p double")
    got = {r["example"]: r["p"] for r in rows_at_positions(df, "p", ["id"], {"low": (0.1, False), "high": (0.1, True)}).collect()}
    assert got == {"low": 0.1, "high": 0.9}


def test_category_codes_and_unseen(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "y"), (None, "x"), ("c", None), ("b", "y")], "c string, d string")
    got = [tuple(r) for r in encode_categories(df, {"c": "cc", "d": "dd"}).collect()]
    assert {(r[0], r[2]) for r in got} == {("a", 0), ("b", 1), ("c", 2), (None, -1)}
    assert {(r[1], r[3]) for r in got} == {("x", 0), ("y", 1), (None, -1)}
    assert {r["c"] for r in mask_names(df, "c").collect()} == {"County A", "County B", "County C", None}


def test_left_join_drops_null_matches(spark):
    a = spark.createDataFrame([("x",), (None,)], "k string")
    b = spark.createDataFrame([("x", 1), (None, 2)], "r string, v int")
    assert {(r["k"], r["v"]) for r in J.left_join(a, b, "k", "r").collect()} == {("x", 1), (None, None)}
    assert {(r["k"], r["v"]) for r in J.left_join(a, b, "k", "r", null_safe=True).collect()} == {("x", 1), (None, 2)}


def brute(y, p):
    pos = [a for a, b in zip(p, y) if b]
    neg = [a for a, b in zip(p, y) if not b]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    ap = trap = prev_r = 0.0
    prev_p = 1.0
    for t in sorted(set(p), reverse=True):
        tp = sum(b for a, b in zip(p, y) if a >= t)
        n = sum(a >= t for a in p)
        r, q = tp / len(pos), tp / n
        ap += (r - prev_r) * q
        trap += (r - prev_r) * (q + prev_p) / 2
        prev_r, prev_p = r, q
    return auc, ap, trap


@pytest.mark.parametrize("levels", [3, 11, 100000])
def test_curve_areas_match_brute_force(spark, levels):
    rng = random.Random(levels)
    rows = [(rng.randint(0, levels) / levels, int(rng.random() < 0.3)) for _ in range(300)]
    df = spark.createDataFrame(rows, "p double, y int")
    r = M.curve_areas(df, "y", "p").first()
    want = brute([y for _, y in rows], [p for p, _ in rows])
    assert np.allclose([r["roc_auc"], r["average_precision"], r["pr_auc_trapezoid"]], want)


def test_metrics_edges(spark):
    one = spark.createDataFrame([(0.5, 1), (0.5, 1)], "p double, y int")
    assert M.curve_areas(one, "y", "p").first()["roc_auc"] is None
    empty = one.filter("p > 1")
    assert M.top_k_threshold(empty, "p").first()[0] == 0.5
    df = spark.createDataFrame([(0.1, 0, 1), (0.2, 0, 2), (0.9, 1, 3), (0.8, 1, 4)], "p double, y int, k int")
    assert M.top_k_threshold(df, "p", 0.5).first()[0] == 0.8
    assert M.precision_at_share(df, "y", "p", ["k"], 0.5).first()["precision_at_share"] == 1.0
    edge = spark.createDataFrame([(1.0, 1), (0.0, 0), (0.95, 0)], "p double, y int")
    assert abs(M.expected_calibration_error(edge, "y", "p").first()[0] - 0.95 / 3) < 1e-12
    table = {round(r["threshold"], 2): r["flagged"] for r in M.threshold_table(df, "y", "p").collect()}
    assert len(table) == 16 and table[0.1] == 4 and table[0.8] == 2 and table[0.85] == 1


def test_psi(spark):
    rng = random.Random(5)
    ref = spark.createDataFrame([(rng.gauss(0, 1), 1.0, i % 3 * 1.0) for i in range(400)], "a double, const double, few double")
    fitted = D.fit_reference(ref, ["a", "const", "few"], 10).cache()
    assert [r["feature"] for r in fitted.collect()] == ["a"]
    row = fitted.first()
    counts, _ = np.histogram([r["a"] for r in ref.collect()], bins=row["bins"])
    assert list(counts) == row["ref_counts"]
    assert D.detect(ref, fitted, ["a"]).first()["psi"] < 1e-12
    moved = ref.select((F.col("a") + 5).alias("a"))
    r = D.detect(moved, fitted, ["a"]).first()
    assert r["status"] == "RED" and r["alert"] == 1


def test_correlation_p_values():
    # Two-sided p of a t statistic: r=0.5, n=12 -> t=1.8257 with 10 degrees of freedom.
    assert abs(t_test_p(0.5, 12) - 0.0978546) < 1e-6
    assert abs(t_test_p(0.0, 50) - 1.0) < 1e-12
    assert t_test_p(0.9, 100) < 1e-30


def test_correlations(spark):
    rows = [(float(i), None if i % 5 == 0 else float(i * i), 7.0, i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y int")
    got = {(r["feature_a"], r["feature_b"]): r["r"] for r in correlation_matrix(df, ["a", "b", "c"]).collect()}
    x = np.array([(r[0], r[1]) for r in rows if r[1] is not None])
    assert abs(got["a", "b"] - np.corrcoef(x.T)[0, 1]) < 1e-12 and got["a", "c"] is None
    assert {r["feature"] for r in label_correlation(df, "y", ["a", "b", "c"]).collect()} == {"a", "b"}


def test_temporal_split(spark):
    df = spark.createDataFrame([("2025-01",), ("2025-02",), ("2025-03",), (None,)], "m string")
    assert {r["m"]: r["split"] for r in S.temporal_split(df, "m").collect()} == {"2025-01": "train", "2025-02": "valid", "2025-03": "test"}
    with pytest.raises(Exception, match="at least 3 distinct months"):
        S.temporal_split(df.filter("m < '2025-03'"), "m").collect()


def test_checks(spark):
    df = spark.createDataFrame([(1, 1, 70.0), (1, 0, 5.0), (2, 2, None)], "k int, y int, patient_age_in_months double")
    r = K.dataset_checks(df, "k", "y").first()
    assert (r["key_unique"], r["target_valid"], r["n_rows"]) == (0, 0, 3)
    assert [tuple(x) for x in K.rule_violations(df).collect()] == [("patient_age_in_months", 1)]
    with pytest.raises(ValueError, match="missing"):
        K.require_columns(df, ["k", "missing"])
    assert K.select_features(df).columns[0] == "patient_age_in_months" and len(K.select_features(df).columns) == 50


def test_cross_tab_margins(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "a int, b int")
    got = {r["a"]: tuple(r)[1:] for r in P.cross_tab(df, "a", "b", [0, 1]).collect()}
    assert got == {"0": (1, 1, 2), "1": (0, 1, 1), "All": (1, 2, 3)}


def test_attribution_equals_brute_force_shapley():
    rng = np.random.default_rng(3)
    leaves = [Leaf(rng.normal(), np.array(f), np.array([-np.inf] * len(f)), rng.normal(size=len(f)), rng.random(len(f))) for f in ([0, 1], [1, 2, 3], [2], [0, 1, 2, 3])]
    x = rng.normal(size=(5, 4))
    got = attribute(x, leaves)

    def worth(row, known):
        total = 0.0
        for leaf in leaves:
            w = leaf.value
            for f, lo, hi, share in zip(leaf.features, leaf.low, leaf.high, leaf.share):
                w *= float(lo < row[f] <= hi) if f in known else share
            total += w
        return total

    for r in range(5):
        for i in range(4):
            rest = [j for j in range(4) if j != i]
            phi = 0.0
            for size in range(4):
                for s in itertools.combinations(rest, size):
                    w = math.factorial(size) * math.factorial(3 - size) / math.factorial(4)
                    phi += w * (worth(x[r], set(s) | {i}) - worth(x[r], set(s)))
            assert abs(phi - got[r, i]) < 1e-12
        assert abs(got[r].sum() + expected_margin(leaves) - worth(x[r], {0, 1, 2, 3})) < 1e-12


def test_masking_many_names_gives_as_many_labels(spark):
    df = spark.range(900).selectExpr("concat('unit ', lpad(cast(id % 300 as string), 3, '0')) AS name", "id")
    labels = [r[0] for r in mask_names(df, "name").select("name").distinct().collect()]
    assert len(labels) == 300 and {"County A", "County Z", "County AA", "County AZ", "County BA"} <= set(labels)


def test_calibration_keeps_scores_apart(spark):
    rows = [(0.5 + i * 1e-8, float(i >= 5)) for i in range(10)]
    model = fit_isotonic(spark.createDataFrame(rows, "s double, y double"), "y", "s")
    assert model.boundaries.toArray().tolist() == [rows[0][0], rows[4][0], rows[5][0], rows[9][0]]
    assert len(fit_isotonic(spark.createDataFrame(rows * 50, "s double, y double"), "y", "s", rows=100).boundaries) > 0


def pieces_per_key(df, order, groups=()):
    laid = range_pieces(df, order, groups)
    rows = laid.groupBy(*groups, "_piece").agg(F.count("*").alias("n")).collect()
    out = {}
    for r in rows:
        out.setdefault(tuple(r[g] for g in groups), []).append(r["n"])
    return out


def test_scans_cut_hot_keys_null_times_and_ties(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.range(4000).selectExpr("if(id % 4 > 0, 'hot', concat('k', id % 40)) AS k", "if(id % 4 = 1, null, timestamp_seconds(id * 50)) AS ts", "id", "0.5D AS s")
        hot = pieces_per_key(df, [F.col("ts").asc_nulls_last(), F.col("id").asc()], ["k"])["hot",]
        assert len(hot) >= 8 and max(hot) <= 1000
        timeless = pieces_per_key(df.filter("ts is null"), [F.col("ts").asc_nulls_last(), F.col("id").asc()], ["k"])["hot",]
        assert len(timeless) >= 8 and max(timeless) <= 250
        tied = pieces_per_key(df, [F.col("s").desc(), F.col("id").asc()])[()]
        assert len(tied) >= 8 and max(tied) <= 1000
        # Fifty features, each far from the others and narrow: all are cut by their own values.
        long = spark.range(50 * 400).selectExpr("id % 50 AS f", "pow(10, id % 50 - 20) * (1 + (id div 50) * 1e-9) AS v")
        by_feature = pieces_per_key(long.withColumn("f", F.when(F.col("f") < 5, 0).otherwise(F.col("f"))), [F.col("v").asc()], ["f"])
        assert len(by_feature) == 46 and len(by_feature[0,]) > 1 and sum(map(sum, by_feature.values())) == 20_000
        one = pieces_per_key(long.filter("f = 7"), [F.col("v").asc()], ["f"])[7,]
        assert len(one) >= 8 and max(one) <= 100
        got = {r["f"]: r["quantiles"] for r in exact_quantiles(long, "v", [0.25, 0.5], ["f"]).collect()}
        for f in range(50):
            assert got[f] == pytest.approx(list(np.quantile([10.0 ** (f - 20) * (1 + i * 1e-9) for i in range(400)], [0.25, 0.5])), rel=1e-12)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_scans_read_their_source_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(2000).selectExpr("id % 3 AS k", "timestamp_seconds(id * 5000) AS ts", "id", "cast(id % 2 as int) AS f", "cast(id % 5 as int) AS d")
    df = df.repartition(4, "id").mapInArrow(count, df.schema).repartition(5, "id")
    for run in (lambda: record_rank(df, "k", "ts", ["id"], "rank"), lambda: prior_events(df, "k", "ts", ["id"], "f", "d"),
                lambda: exact_quantiles(df, "id", [0.5], ["k"])):
        before = seen.value
        assert run().count() in (2000, 3)
        assert seen.value - before == 2000


def test_segmented_totals_restart_at_each_key(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), rng.choice([None, *range(20)]), i, rng.randint(-3, 9)) for i in range(700)]
    got = segmented_totals(spark.createDataFrame(rows, "k string, t int, id int, v int"), ["v"], [F.col("t").desc_nulls_last(), F.col("id").asc()], ["k"])
    assert got.columns == ["k", "t", "id", "v", "cum_v"]
    have, total = {r["id"]: r["cum_v"] for r in got.collect()}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2])):
        total[k] = total.get(k, 0) + v
        assert have[i] == total[k]
    assert segmented_totals(spark.createDataFrame([], "k string, t int, v int"), ["v"], [F.col("t").asc()], ["k"]).count() == 0


def test_record_rank_without_times(spark):
    df = spark.createDataFrame([(None, None, i) for i in range(500)] + [("a", None, i) for i in range(500)], "k string, ts timestamp, id int")
    got = {(r["k"], r["id"]): r["rank"] for r in record_rank(df, "k", "ts", ["id"], "rank").collect()}
    assert all(got[k, i] == i + 1 for k in (None, "a") for i in range(500))


def test_rows_at_positions_with_one_score(spark):
    df = spark.range(1001).selectExpr("0.5D AS s", "1000 - id AS id")
    got = {r["example"]: r["id"] for r in rows_at_positions(df, "s", ["id"], {"low": (0.0, False), "mid": (0.5, False), "high": (0.001, True)}).collect()}
    assert got == {"low": 0, "mid": 500, "high": 999}


def test_quantiles_of_a_narrow_range_far_from_zero(spark):
    values = [1_000_000 + random.Random(3).randint(-100, 100) + i % 7 for i in range(500)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert exact_quantiles(df, "v", [0.1, 0.5, 0.9]).first()[0] == pytest.approx(list(np.quantile(values, [0.1, 0.5, 0.9])))


def test_stratified_split_is_exact(spark):
    df = spark.range(1003).selectExpr("id", "if(id % 10 = 0, 1, 0) AS y")
    n = {(r["part"], r["y"]): r["n"] for r in S.stratified_split(df, ["id"], "y", 0.2, 42).groupBy("part", "y").agg(F.count("*").alias("n")).collect()}
    assert n["test", 1] == 20 and n["test", 0] == 180


def test_profiles_count_in_one_pass(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1.5, -0.0, 0.0, float("nan")]), rng.choice([None, 2**53, 2**53 + 1, 7]), rng.choice([None, "a", "b", ""]),
             rng.choice([None, True, False]), rng.choice([None, [1], [1, 2], []]), "0.10" if i % 2 else None, bytes([i % 3])) for i in range(300)]
    df = spark.createDataFrame(rows, "d double, l long, s string, b boolean, a array<int>, t string, x binary").selectExpr(
        "*", "cast(t as decimal(10,2)) AS c", "date_add('2024-01-01', cast(l % 3 as int)) AS day", "timestamp_seconds(l % 5) AS ts", *[f"l % {i + 2} AS wide{i}" for i in range(40)])
    for some in (df, df.filter("false")):
        got = {r["column"]: (r["missing_share"], r["n_unique"]) for r in P.column_profile(some).collect()}
        want = some.agg(*[x for c in df.columns for x in (F.avg(F.col(c).isNull().cast("double")), F.count_distinct(c))]).first()
        assert list(got) and got == {c: (want[2 * i], want[2 * i + 1]) for i, c in enumerate(df.columns)}
    plan = P.column_profile(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1
    numbers = ["l", "b", "c", *[f"wide{i}" for i in range(40)]]
    wide = df.select(*[F.col(c).cast("int").alias(c) if c == "b" else F.col(c) for c in numbers])
    got = {r["feature"]: r for r in P.feature_report(wide, numbers, {"g": ["l"]}).collect()}
    want = wide.agg(*[x for c in numbers for x in (F.avg(F.col(c).isNull().cast("double")) * 100, F.count_distinct(c), F.avg(c), F.stddev_samp(c))]).first()
    for i, c in enumerate(numbers):
        r = got[c]
        assert r["n_unique"] == want[4 * i + 1] and r["feature_group"] == ("g" if c == "l" else None)
        assert (r["null_pct"], r["mean"], r["std"]) == pytest.approx((want[4 * i], float(want[4 * i + 2]), want[4 * i + 3]), rel=1e-12)


def test_block_products_equal_pairwise_correlations(spark):
    rng = np.random.default_rng(5)
    names = [f"f{i}" for i in range(50)]
    data = rng.normal(size=(400, 50)) * np.logspace(-3, 3, 50) + np.linspace(-1e4, 1e4, 50)
    data[:, 7] = 3.3
    rows = [tuple(None if rng.random() < 0.1 + 0.8 * (j == 9) else float(v) for j, v in enumerate(r)) for r in data]
    rows = [tuple(float("nan") if j == 11 and i == 5 else None if j == 13 else v for j, v in enumerate(r)) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(5)
    got = {(r["feature_a"], r["feature_b"]): r["r"] for r in correlation_matrix(df, names).collect()}
    assert len(got) == 2500 and got["f3", "f3"] == pytest.approx(1) and got["f7", "f7"] is None
    pairs = list(itertools.combinations(range(50), 2))
    for at in range(0, len(pairs), 245):
        some = pairs[at:at + 245]
        want = df.agg(*[safe_corr(F.col(names[i]), F.col(names[j])).alias(f"c{k}") for k, (i, j) in enumerate(some)]).first()
        for (i, j), w in zip(some, want):
            w = None if w is None or math.isnan(w) else w
            assert got[names[i], names[j]] == got[names[j], names[i]] == (w if w is None else pytest.approx(w, abs=1e-8)), (i, j)
    none = correlation_matrix(df.filter("false"), names[:3]).collect()
    assert len(none) == 9 and all(r["r"] is None for r in none)


def test_one_hot_from_the_code_table(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "y"), (None, "x"), ("c", None), ("b", "y")], "c string, d string")
    hot = OneHot.fit(df, ["c", "d"])
    assert hot.sizes == {"c": 3, "d": 2}
    new = spark.createDataFrame([("a", "x"), ("c", "new"), (None, "y"), ("zz", None)], "c string, d string")
    got = {r["c"]: (r["c_hot"].toArray().tolist(), r["d_hot"].toArray().tolist()) for r in hot.transform(new).collect()}
    assert got == {"a": ([1, 0, 0], [1, 0]), "c": ([0, 0, 1], [0, 0]), None: ([0, 0, 0], [0, 1]), "zz": ([0, 0, 0], [0, 0])}
    assert hot.transform(new).columns == ["c", "d", "c_hot", "d_hot"]


def test_one_hot_of_many_labels(spark):
    many = spark.range(1_000_000).selectExpr("concat('label', id) AS c")
    hot = OneHot.fit(many, ["c"])
    row = hot.transform(many.limit(3)).select("c_hot").collect()
    assert hot.sizes == {"c": 1_000_000} and all(r[0].size == 1_000_000 and r[0].numNonzeros() == 1 for r in row)
