"""Models in sessions that do other work too, and on larger tables."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from fieldtally.ml import attribution as X
from fieldtally.ml import train as T
from fieldtally.sources.tables import snapshot

SF = "/root/testdata/sf0.001"


def test_logistic_scores_after_an_observed_write(spark, tmp_path):
    """An observed write leaves the session unable to be sent to tasks; the model must not hold it."""
    assert snapshot(spark.range(3), str(tmp_path / "seen.parquet")) == 3
    rows = spark.createDataFrame([(Vectors.dense([float(i % 7), float(i % 3)]), i % 2) for i in range(60)], ["features", "y"])
    model = T.fit_logistic(rows, "y")
    assert model.transform(rows).withColumn("p", T.probability()).filter(F.col("p").between(0, 1)).count() == 60


def leaf(rng, m, width):
    low = rng.normal(size=m) - 1
    return X.Leaf(rng.normal(), np.sort(rng.choice(width, m, replace=False)), low, low + 2, rng.uniform(0.1, 0.9, m))


def test_effects_are_formed_once_for_all_rows(spark, monkeypatch):
    """Looked-up effects are those formed row by row; forming them does not grow with the rows."""
    rng, width = np.random.default_rng(5), 6
    leaves = [leaf(rng, m, width) for m in (1, 1, 2, 3, 4, 4, 6)]
    x = rng.normal(size=(700, width))
    plain = sum(X._block(x, *group) for group in X.leaves_by_length(leaves))
    formed, effect = [], X._effect
    monkeypatch.setattr(X, "_effect", lambda inside, *a: formed.append(inside.shape[0]) or effect(inside, *a))
    assert np.allclose(X.attribute(x, leaves), plain, atol=1e-12) and max(formed) == 2 ** 6
    monkeypatch.setattr(X, "TABLE_VALUES", 100)  # longer leaves stay as they are
    assert np.allclose(X.attribute(x, leaves), plain, atol=1e-12)
    monkeypatch.setattr(X, "_effect", effect)
    df = spark.createDataFrame([(i, Vectors.dense(r)) for i, r in enumerate(x.tolist())], ["i", "features"])
    got = {r["i"]: r["shap_values"] for r in X.attributions(df, leaves).collect()}
    assert np.allclose([got[i] for i in range(len(x))], plain, atol=1e-12)


def test_hashes_of_folds_are_formed_once(spark, monkeypatch):
    """Training hashes a row's key for the held rows and the folds once, not in every fit."""
    calls, bucket = [], T.hash_bucket
    flag = T.split_flag
    monkeypatch.setattr(T, "hash_bucket", lambda *a: calls.append("fold") or bucket(*a))
    monkeypatch.setattr(T, "split_flag", lambda *a: calls.append("held") or flag(*a))
    df = spark.range(300).select("id", (F.col("id") % 10).cast("double").alias("a"), F.when(F.col("id") % 10 > 5, 1).otherwise(0).alias("y"))
    model = T.train(df, "y", ["id"], ["a"], [], settings=T.TrainSettings(trees=2, depth=2, folds=2))
    assert len(model.fold_models) == 2 and sorted(calls) == ["fold", "held"]


def test_attributions_are_looked_up_by_cell(spark, monkeypatch):
    """All leaves that share cuts take one look-up; values on a cut, beyond all cuts and without end are as in the leaves."""
    cuts = {0: [1.0, 2.0, 3.0], 2: [0.5], 3: [-1.0, 4.0]}
    rng, leaves = np.random.default_rng(9), []
    for f, low, high in [(0, -np.inf, 1.0), (0, 1.0, 3.0), (0, 2.0, np.inf)]:
        for g, left, right in [(2, -np.inf, 0.5), (3, -1.0, 4.0), (3, 4.0, np.inf)]:
            leaves.append(X.Leaf(rng.normal(), np.array([f, g]), np.array([low, left]), np.array([high, right]), rng.uniform(0.1, 0.9, 2)))
    leaves.append(X.Leaf(0.3, np.array([], dtype=int), *[np.array([])] * 3))
    values = sorted({v + d for vs in cuts.values() for v in vs for d in (-0.1, 0.0, 0.1)} | {-1e300, 1e300, np.inf})
    x = rng.choice(values, size=(900, 5))
    plain = sum(X._block(x, *group) for group in X.leaves_by_length(leaves))
    found = X.celled_leaves(leaves)
    assert len(found) == 1 and [len(t) for t in found[0].tables] == [4 * 2 * 3]
    assert np.allclose(X.attribute(x, found), plain, atol=1e-12)
    monkeypatch.setattr(X, "CELLS", 12)  # several groups
    found = X.celled_leaves(leaves)
    assert len(found[0].tables) > 1 and np.allclose(X.attribute(x, found), plain, atol=1e-12)
    monkeypatch.setattr(X, "TABLE_VALUES", 10)
    assert X.celled_leaves(leaves) == [] and X.celled_leaves([]) == []
    df = spark.createDataFrame([(i, Vectors.dense(r)) for i, r in enumerate(x[:50].tolist())], ["i", "features"])
    for most in (10, 1000):  # tables too large, and tables sent
        monkeypatch.setattr(X, "TABLE_VALUES", most)
        got = {r["i"]: r["shap_values"] for r in X.attributions(df, leaves).collect()}
        assert np.allclose([got[i] for i in range(50)], plain[:50], atol=1e-12)


def test_two_models_are_compared_without_a_join(spark):
    """Both score the row as it came: the first model's fills and codes must not reach the second."""
    from fieldtally.catalog.models import score_difference

    rows = spark.range(400).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 10).cast("double").alias("a"),
                                   F.element_at(F.array(*map(F.lit, "xyz")), (F.col("id") % 3 + 1).cast("int")).alias("c"),
                                   (F.col("id") % 10 + 3 * (F.col("id") % 3) > 8).cast("int").alias("y"))
    settings = T.TrainSettings(trees=3, depth=2, folds=2, min_rows=1)
    model = T.train(rows, "y", ["id"], ["a"], [], ["c"], settings)
    other = T.train(rows.filter("id % 4 > 0"), "y", ["id"], ["a"], [], ["c"], settings)
    same, differ = score_difference(rows, model, model), score_difference(rows, model, other)
    assert tuple(same.first()) == (400, 0.0)
    a, b = (m.score(rows).select("id", F.col("risk_score").alias(n)) for m, n in ((model, "p"), (other, "q")))
    want = a.join(b, "id").agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0]
    assert want > 0 and tuple(differ.first()) == (400, want)
    assert sum("Range" in line for line in plan_text(same).split("\n")) == 1


def pooled(rows):
    """{score: pooled mean} of (score, label) rows, plainly: each score in turn, merged with those before while they are not lower."""
    blocks = []
    for s in sorted({s for s, _ in rows}):
        labels = [y for t, y in rows if t == s]
        blocks.append([sum(labels), len(labels), [s]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, n, scores = blocks.pop()
            blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + n, blocks[-1][2] + scores]
    return {s: total / n for total, n, scores in blocks for s in scores}


@pytest.mark.parametrize("kind", ["noisy", "falling", "waves", "ties"])
def test_calibration_uses_every_labelled_row(spark, kind):
    """The curve is that of all rows, whatever number of them a task pools at a time."""
    rng = random.Random(kind)
    chance = {"noisy": lambda s: s, "falling": lambda s: 1 - s, "waves": lambda s: 0.5 + 0.5 * np.sin(40 * s), "ties": lambda s: s}[kind]
    scores = [round(rng.random(), 1 if kind == "ties" else 9) for _ in range(700)]
    rows = [(s, float(rng.random() < chance(s))) for s in scores]
    df, want = spark.createDataFrame(rows, "s double, y double"), pooled(rows)
    for most in (40, 699, 700, 1_000_000):
        curve = T.fit_isotonic(df, "y", "s", rows=most)
        got = np.interp(sorted(want), curve.boundaries.toArray(), curve.predictions.toArray())
        assert np.allclose(got, [want[s] for s in sorted(want)], rtol=0, atol=1e-12), most


def test_folds_are_calibrated_on_all_their_rows(spark, monkeypatch):
    """The model that the queries share: each fold's curve is that of all labelled rows held out for it."""
    from fieldtally.catalog import models as M
    from fieldtally.catalog.registry import Tables

    monkeypatch.setattr(M, "SETTINGS", replace(M.SETTINGS, trees=2, depth=3, calibration_rows=50))
    t = Tables(spark, SF)
    model, _ = M.fitted(t)
    vectors = model.preparation.transform(M.parts(t)[0]).withColumn("_fold", T.hash_bucket(M.KEYS, M.SETTINGS.seed + 2) % M.SETTINGS.folds)
    assert len(model.calibrators) == 2
    for i, (trees, curve) in enumerate(zip(model.fold_models, model.calibrators)):
        rows = [tuple(r) for r in T.raw_score(vectors.filter(F.col("_fold") == i), trees, "s").select("s", M.LABEL).collect()]
        want = pooled(rows)
        assert len(rows) > 400 and len(want) > 3
        got = np.interp(sorted(want), curve.boundaries.toArray(), curve.predictions.toArray())
        assert np.allclose(got, [want[s] for s in sorted(want)], rtol=0, atol=1e-12)


def test_explained_scores_do_not_depend_on_the_rows_a_task_pools(spark, monkeypatch):
    from fieldtally.catalog import QUERIES
    from fieldtally.catalog import models as M

    settings, found = replace(M.SETTINGS, trees=2, depth=3), []
    for most in (50, 1_000_000):
        monkeypatch.setattr(M, "SETTINGS", replace(settings, calibration_rows=most))
        records = QUERIES["i31_explanations"](spark, SF).select(*M.KEYS, "risk_score").orderBy(*M.KEYS).collect()
        points = QUERIES["i32_dependence"](spark, SF).select(*M.KEYS, "feature", "risk_score").orderBy(*M.KEYS, "feature").collect()
        found.append((records, points))
    for part, whole in zip(*found):
        assert len(part) > 1000 and [r[:-1] for r in part] == [r[:-1] for r in whole]
        assert np.allclose([r[-1] for r in part], [r[-1] for r in whole], rtol=0, atol=1e-9)


def plan_text(df):
    """The physical plan as text."""
    return df._jdf.queryExecution().simpleString()
