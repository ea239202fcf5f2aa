"""Preparation, models, scoring and explanations."""

from __future__ import annotations

import hashlib

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.risk import driver_direction
from ..ml import attribution as X
from ..ml import prepare as P
from ..ml import train as T
from ..operators.metrics import curve_areas, point_metrics, top_k_threshold
from ..operators.ranking import risk_list, top_drivers
from ..operators.splits import hash_bucket, month_roles, split_flag
from ..plans.person_table import add_dose_scores
from ..session import fresh_path
from ..sources.layers import code_version, versioned
from ..sources.tables import layer, read_table
from .checks import target_rows
from .registry import query
from .shape import as_of, rounded

NUMERIC = ["patient_age_in_months", "vax_completeness_score", "vax_received_core"]
BINARY = ["patient_sex_binary", "has_bcg", "penta_series_complete", "measles_booster_gap"]
CATEGORICAL = ["county"]
LABEL = "is_defaulter"
KEYS = ["visit_no"]
SETTINGS = T.TrainSettings(trees=10, depth=4, step=0.2, folds=2)


_KNOWN: dict = {}


def versioned_path(t, name: str, made_from: str, write) -> str:
    """The layer of the present source files; looked up once per session and version."""
    version = " ".join([t.version("orders", "customer"), code_version(), made_from])
    key = (t.spark.sparkContext.applicationId, name, t.folder, version)
    if key not in _KNOWN:
        place = hashlib.sha1(t.folder.encode()).hexdigest()[:16]
        _KNOWN[key] = versioned(t.spark, f"{name}-{place}", version, write)
    return _KNOWN[key]


def split_rows(t):
    """The feature layer the model stages read, with ``_test`` for the test rows, written once per version of its sources."""
    def write(path):
        rows = add_dose_scores(target_rows(t), as_of()).select(
            *KEYS, "month_clean", LABEL, *NUMERIC, *BINARY, *CATEGORICAL, split_flag(KEYS, 0.2, 42).alias("_test"))
        layer(rows, path)

    return read_table(t.spark, versioned_path(t, "model_rows", "", write))


def visit_rows(t):
    return split_rows(t).drop("_test")


def parts(t):
    rows = split_rows(t)
    return rows.filter("not _test").drop("_test"), rows.filter("_test").drop("_test")


_LOADED: dict = {}


def fitted(t) -> tuple[T.RiskModel, str]:
    """One trained and saved model per version of the sources and settings."""
    def write(path):
        T.train(parts(t)[0], LABEL, KEYS, NUMERIC, BINARY, CATEGORICAL, SETTINGS).save(t.spark, path)

    folder = versioned_path(t, "model", repr(SETTINGS), write)
    key = (t.spark.sparkContext.applicationId, folder)
    if key not in _LOADED:
        _LOADED[key] = T.RiskModel.load(t.spark, folder)
    return _LOADED[key], folder


@query("i03_imputation_values", uses="features", sql="""
  SELECT 'price' AS feature, round(quantile_cont(price, 0.5), 6) AS value FROM features
  UNION ALL SELECT 'discount', round(quantile_cont(discount, 0.5), 6) FROM features
  UNION ALL SELECT 'unit_price', round(quantile_cont(unit_price, 0.5), 6) FROM features
  UNION ALL SELECT 'even', CAST((SELECT even FROM features GROUP BY even ORDER BY count(*) DESC, even LIMIT 1) AS DOUBLE)
  UNION ALL SELECT 'quantity', (SELECT quantity FROM features GROUP BY quantity ORDER BY count(*) DESC, quantity LIMIT 1)""")
def _(t):
    """Medians for numbers, most frequent values for flags."""
    return rounded(P.median_values(t.features, ["price", "discount", "unit_price"]).unionByName(P.frequent_values(t.features, ["even", "quantity"])))


@query("i03_imputed_rows", uses="features", sql="""
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM features)), 6) AS price,
    round(coalesce(discount, (SELECT quantile_cont(discount, 0.5) FROM features)), 6) AS discount, CAST(even AS DOUBLE) AS even FROM features""")
def _(t):
    prep = P.Preparation.fit(t.features, ["price", "discount", "absent"], ["even"])
    return rounded(prep.fill(t.features).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price", "discount", "even"))


@query("i04_ordinal_encode", uses="iz", sql="""
  WITH f AS (SELECT county FROM iz WHERE visit_no % 2 = 0 AND county <> 'kisumu' GROUP BY county),
    c AS (SELECT county, dense_rank() OVER (ORDER BY county) - 1 AS code FROM f),
    m AS (SELECT county FROM iz WHERE visit_no % 2 = 0 AND county <> 'kisumu' GROUP BY 1 ORDER BY count(*) DESC, county LIMIT 1)
  SELECT i.visit_no, CAST(coalesce(c.code, -1) AS DOUBLE) AS county FROM iz i LEFT JOIN c ON coalesce(i.county, (SELECT county FROM m)) = c.county""")
def _(t):
    """Codes fitted on one half without one county; that county is unseen in the whole table."""
    half = t.iz.filter("visit_no % 2 = 0 AND county <> 'kisumu'")
    prep = P.Preparation.fit(half.select("county"), [], [], ["county"])
    return prep.fill(t.iz.select("visit_no", "county"))


@query("i04_one_hot", uses="registry", sql="""
  SELECT l_orderkey, l_linenumber, l_partkey, concat_ws(',', CASE WHEN sub_county_name = 'AFRICA' THEN 1 ELSE 0 END, CASE WHEN sub_county_name = 'AMERICA' THEN 1 ELSE 0 END,
    CASE WHEN sub_county_name = 'ASIA' THEN 1 ELSE 0 END) AS hot FROM registry""")
def _(t):
    """Fitted on three names; the others are unseen and give zeros."""
    x = t.registry.select("l_orderkey", "l_linenumber", "l_partkey", "sub_county_name")
    model = P.OneHot.fit(x.filter(F.col("sub_county_name").isin("AFRICA", "AMERICA", "ASIA")), ["sub_county_name"])
    hot = F.transform(vector_to_array("sub_county_name_hot"), lambda v: v.cast("int").cast("string"))
    return model.transform(x).select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(hot, ",").alias("hot"))


@query("i05_feature_names", sql="SELECT CAST(i AS INT) AS position, f AS feature FROM (SELECT unnest(range(8)) AS i, unnest(["
       + ", ".join(f"'{f}'" for f in [*NUMERIC, *BINARY, *CATEGORICAL]) + "]) AS f)")
def _(t):
    """Names in vector order, from the fitted state."""
    prep = P.Preparation.fit(visit_rows(t), NUMERIC, BINARY, CATEGORICAL)
    return t.spark.createDataFrame(list(enumerate(prep.names)), "position int, feature string")


def _metric_row(scored, name):
    """Metrics of a scored table. The scores are written first: the model runs once, the metrics read its output."""
    scored = layer(scored.select(LABEL, "risk_score"), fresh_path(scored.sparkSession, "scored") + ".parquet")
    areas = curve_areas(scored, LABEL, "risk_score").select(F.lit(name).alias("model"), "n", "roc_auc", "average_precision")
    return areas.withColumn("brier_score", point_metrics(scored, LABEL, "risk_score").select("brier_score").scalar())


@query("i06_logistic_baseline")
def _(t):
    train_rows, test_rows = parts(t)
    prep = P.Preparation.fit(train_rows, NUMERIC, BINARY, CATEGORICAL)
    model = T.fit_logistic(prep.transform(train_rows), LABEL)
    return _metric_row(model.transform(prep.transform(test_rows)).withColumn("risk_score", T.probability()), "logistic")


@query("i07_boosted_trees")
def _(t):
    model, _ = fitted(t)
    return _metric_row(T.raw_score(model.preparation.transform(parts(t)[1]), model.model, "risk_score"), "trees")


@query("i08_isotonic_folds")
def _(t):
    return _metric_row(fitted(t)[0].score(parts(t)[1]), "calibrated trees")


@query("i09_sigmoid_calibration")
def _(t):
    """Sigmoid fitted on the validation month, applied to the test month."""
    model, _ = fitted(t)
    rows = visit_rows(t).filter("month_clean is not null")
    roles = month_roles(rows, "month_clean", 6, 6).withColumnRenamed("month_clean", "_m")
    split = rows.join(roles, F.col("month_clean") == F.col("_m"))
    raw = T.raw_score(model.preparation.transform(split), model.model, "raw")
    curve = T.fit_sigmoid(raw.filter("split = 'valid'"), LABEL, "raw")
    return _metric_row(T.apply_sigmoid(raw.filter("split = 'test'"), curve, "raw", "risk_score"), "sigmoid")


@query("i10_search")
def _(t):
    """Cross-validated random search over a small space, best mean average precision first."""
    train_rows, _ = parts(t)
    prep = P.Preparation.fit(train_rows, NUMERIC, BINARY, CATEGORICAL)
    vectors = prep.transform(train_rows).select(*KEYS, LABEL, "features").persist()
    space = {"maxIter": (3, 6), "maxDepth": (2, 4), "stepSize": (0.05, 0.3)}
    _, table = T.search(vectors, LABEL, 2, 2, SETTINGS, hash_bucket(KEYS, 7) % 2, space)
    vectors.unpersist()
    return table.orderBy(F.col("average_precision").desc())


def score_difference(rows, one: T.RiskModel, other: T.RiskModel):
    """(n, largest_difference) of two models' scores, on every row as it is; scoring replaces columns, so the row is kept beside."""
    first = one.score(rows.withColumn("_row", F.struct(*rows.columns))).select("_row", F.col("risk_score").alias("_first"))
    both = other.score(first.select("_row.*", "_first"))
    return both.agg(F.count("*").alias("n"), F.max(F.abs(F.col("_first") - F.col("risk_score"))).alias("largest_difference"))


@query("i11_save_load", uses="iz_latest", sql="SELECT count(*) AS n, 0.0::DOUBLE AS largest_difference FROM iz_latest")
def _(t):
    """Scores before saving and after loading, compared row by row: a row keeps its first score while the second is formed."""
    model, folder = fitted(t)
    return score_difference(visit_rows(t), model, T.RiskModel.load(t.spark, folder))


@query("i22_feature_importance")
def _(t):
    model, _ = fitted(t)
    return X.feature_importance(model.model, model.names)


@query("i28_batch_scoring")
def _(t):
    """Score, percentage and tier for the whole table."""
    return fitted(t)[0].score(visit_rows(t)).select("visit_no", "risk_score", "risk_pct", "risk_tier")


@query("i28_scored_risk_list")
def _(t):
    """Batch scoring to the ranked list, cut at the model's own top-share threshold."""
    scored = layer(fitted(t)[0].score(visit_rows(t)).select("visit_no", F.col("risk_score").alias("predicted_risk")),
                   fresh_path(t.spark, "scored") + ".parquet")
    cut = top_k_threshold(scored, "predicted_risk", 0.2)
    kept = scored.filter(F.col("predicted_risk") >= cut.scalar())
    return risk_list(kept, 0.0, tiebreak=KEYS).select("visit_no", "predicted_risk", "risk_tier")


def explained(t):
    """Every visit scored and attributed, written once per model."""
    model, folder = fitted(t)

    def write(path):
        scored = model.score(visit_rows(t)).select(*KEYS, "risk_score", "risk_tier", "features")
        layer(X.attributions(scored, X.read_leaves(t.spark, f"{folder}/trees")), path)

    return read_table(t.spark, versioned_path(t, "explained", repr(SETTINGS), write)), model


@query("i29_attributions_add_up", uses="iz_latest", sql="SELECT count(*) AS n, count(*) AS n_adding_up FROM iz_latest")
def _(t):
    """Every row's attributions sum to its margin less the base value."""
    model, folder = fitted(t)
    rows = model.preparation.transform(visit_rows(t))
    with_margin = model.model.transform(rows).select(*KEYS, "features", vector_to_array("rawPrediction")[1].alias("margin"))
    out = X.attributions(with_margin, X.read_leaves(t.spark, f"{folder}/trees"))
    total = F.aggregate("shap_values", F.lit(0.0), lambda a, x: a + x)
    # The classifier's raw prediction is the margin itself.
    return out.agg(F.count("*").alias("n"), F.count_if(F.abs(total + F.col("base_value") - F.col("margin")) < 1e-9).alias("n_adding_up"))


@query("i29_attributions")
def _(t):
    df, _ = explained(t)
    return df.select("visit_no", "base_value", "shap_values")


@query("i30_mean_attribution")
def _(t):
    df, model = explained(t)
    return X.mean_absolute(df, model.names).orderBy(F.col("mean_shap").desc())


@query("i34_top_positive_importance")
def _(t):
    df, model = explained(t)
    return X.top_positive(X.mean_absolute(df, model.names))


@query("i31_explanations")
def _(t):
    df, model = explained(t)
    return X.payload(df, model.names, KEYS, "gbt_v1")


@query("i32_dependence")
def _(t):
    """Value, attribution and score of the three leading features."""
    df, model = explained(t)
    top = [r["feature"] for r in X.top_positive(X.mean_absolute(df, model.names), 3).collect()]
    return X.dependence(df, model.names, top, KEYS)


@query("i06_i09_metric_bounds", uses="iz_latest", sql="""
  SELECT unnest(['logistic', 'trees', 'calibrated trees']) AS model,
    (SELECT count(*) FROM iz_latest WHERE CAST('0x' || substr(md5(visit_no || '|42'), 1, 8) AS BIGINT) % 10000 < 2000) AS n, true AS better_than_chance, true AS in_bounds""")
def _(t):
    """Three models on the test rows: their number, and metrics within what is possible."""
    model, _ = fitted(t)
    train_rows, test_rows = parts(t)
    ready = model.preparation.transform(test_rows)
    logistic = T.fit_logistic(model.preparation.transform(train_rows), LABEL)
    rows = _metric_row(logistic.transform(ready).withColumn("risk_score", T.probability()), "logistic")
    rows = rows.unionByName(_metric_row(T.raw_score(ready, model.model, "risk_score"), "trees"))
    rows = rows.unionByName(_metric_row(model.score(test_rows), "calibrated trees"))
    inside = [F.col(c).between(0.0, 1.0) for c in ("roc_auc", "average_precision", "brier_score")]
    return rows.select("model", "n", (F.col("roc_auc") > 0.5).alias("better_than_chance"), (inside[0] & inside[1] & inside[2]).alias("in_bounds"))


@query("i22_importance_sums", sql="SELECT 8::BIGINT AS n_features, 1.0::DOUBLE AS total, true AS none_negative")
def _(t):
    model, _ = fitted(t)
    table = X.feature_importance(model.model, model.names)
    return rounded(table.agg(F.count("*").alias("n_features"), F.sum("importance").alias("total"), (F.min("importance") >= 0).alias("none_negative")))


@query("i28_scores_hold", uses="iz_latest", sql="""
  SELECT count(*) AS n, count(DISTINCT visit_no) AS n_keys, count(*) AS n_in_bounds, count(*) AS n_tier_agrees, count(*) AS n_pct_agrees FROM iz_latest""")
def _(t):
    """Every visit once, scores in bounds, tier and percentage those of the score."""
    scored = fitted(t)[0].score(visit_rows(t))
    tier = F.when(F.col("risk_score") < 0.33, "LOW").when(F.col("risk_score") < 0.6, "MEDIUM").otherwise("HIGH")
    return scored.agg(
        F.count("*").alias("n"), F.count_distinct("visit_no").alias("n_keys"), F.count_if(F.col("risk_score").between(0, 1)).alias("n_in_bounds"),
        F.count_if(F.col("risk_tier") == tier).alias("n_tier_agrees"), F.count_if(F.abs(F.col("risk_pct") - F.col("risk_score") * 100) <= 0.0500001).alias("n_pct_agrees"))


@query("i31_explanations_hold", uses="iz_latest", sql="SELECT count(*) AS n, count(*) AS n_with_three, count(*) AS n_with_action FROM iz_latest")
def _(t):
    df, model = explained(t)
    out = X.payload(df, model.names, KEYS, "gbt_v1")
    return out.agg(F.count("*").alias("n"), F.count_if(F.size("top_drivers") == 3).alias("n_with_three"), F.count("recommended_action").alias("n_with_action"))


@query("i32_dependence_holds", uses="iz_latest", sql="SELECT 3 * count(*) AS n, count(DISTINCT visit_no) AS n_keys, 3::BIGINT AS n_features FROM iz_latest")
def _(t):
    df, model = explained(t)
    out = X.dependence(df, model.names, model.names[:3], KEYS)
    return out.agg(F.count("*").alias("n"), F.count_distinct("visit_no").alias("n_keys"), F.count_distinct("feature").alias("n_features"))


@query("i34_importance_positive", sql="SELECT true AS all_positive, true AS at_most_twenty, true AS falling")
def _(t):
    df, model = explained(t)
    top = X.top_positive(X.mean_absolute(df, model.names))
    values = F.array_agg("mean_shap")
    return top.agg((F.min("mean_shap") > 0).alias("all_positive"), (F.count("*") <= 20).alias("at_most_twenty"),
                   (F.reverse(F.array_sort(values)) == F.sort_array(values, asc=False)).alias("falling"))


_EFFECTS = ["discount", "tax", "quantity", "price"]
_EFFECT_SQL = "[l_discount - 0.05, 0.04 - l_tax, l_quantity / 500 - 0.05, l_extendedprice / 1000000 - 0.05]"


def effect_rows(t):
    x = t.lineitem
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr(f"array({_EFFECT_SQL[1:-1]})").alias("shap_values"),
                    F.array("l_discount", "l_tax", "l_quantity", "l_extendedprice").alias("feature_values"))


@query("f07_top_drivers", sql=f"""
  WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest({_EFFECT_SQL}) AS v, unnest(['discount', 'tax', 'quantity', 'price']) AS f,
      unnest([1, 2, 3, 4]) AS i, unnest([l_discount, l_tax, l_quantity, l_extendedprice]) AS x FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY abs(v) DESC, i) AS k FROM e)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(k AS INT) AS rank, f AS feature, x AS feature_value, round(v, 9) AS shap_value,
    CASE WHEN v > 0 THEN 'increases_risk' ELSE 'decreases_risk' END AS direction FROM r WHERE k <= 3""")
def _(t):
    top = effect_rows(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                F.posexplode(top_drivers("shap_values", "feature_values", _EFFECTS, 3)).alias("i", "d"))
    return rounded(top.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("i") + 1).alias("rank"), F.col("d.feature").alias("feature"),
                              F.col("d.feature_value").alias("feature_value"), F.col("d.shap_value").alias("shap_value"),
                              driver_direction(F.col("d.shap_value")).alias("direction")), 9)


@query("i30_mean_absolute_effect", sql="""
  SELECT 'discount' AS feature, 'discount' AS friendly_name, round(avg(abs(l_discount - 0.05)), 6) AS mean_shap FROM lineitem
  UNION ALL SELECT 'tax', 'tax', round(avg(abs(0.04 - l_tax)), 6) FROM lineitem
  UNION ALL SELECT 'quantity', 'quantity', round(avg(abs(l_quantity / 500 - 0.05)), 6) FROM lineitem
  UNION ALL SELECT 'price', 'price', round(avg(abs(l_extendedprice / 1000000 - 0.05)), 6) FROM lineitem""")
def _(t):
    return rounded(X.mean_absolute(effect_rows(t), _EFFECTS))
