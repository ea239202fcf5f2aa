"""Training, calibration, search, artifacts and scoring."""

from __future__ import annotations

import json
import random
from dataclasses import asdict, dataclass, field

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.risk import score_tier
from ..operators.metrics import curve_areas
from ..operators.splits import hash_bucket, split_flag
from ..session import fresh_path, shared_folder
from .prepare import Preparation


@dataclass
class TrainSettings:
    """Boosting and calibration settings."""

    trees: int = 500
    depth: int = 6
    step: float = 0.05
    row_share: float = 0.8
    feature_share: str = "0.8"
    min_rows: int = 5
    min_gain: float = 0.0
    validation_share: float = 0.1
    folds: int = 5
    seed: int = 42
    # Labelled rows per range of scores that one task pools; a calibration curve is fitted on all of them.
    calibration_rows: int = 1_000_000


def with_weight(df: DataFrame, label: str) -> DataFrame:
    """Weight negatives/positives on the positive class, so both count alike."""
    counts = df.agg(F.sum(label).alias("p"), F.count(label).alias("n")).first()
    ratio = (counts["n"] - counts["p"]) / max(counts["p"], 1)
    return df.withColumn("_weight", F.when(F.col(label) == 1, float(ratio)).otherwise(1.0))


def boosted_trees(s: TrainSettings, label: str) -> GBTClassifier:
    return GBTClassifier(
        featuresCol="features", labelCol=label, weightCol="_weight", maxIter=s.trees, maxDepth=s.depth, stepSize=s.step,
        subsamplingRate=s.row_share, featureSubsetStrategy=s.feature_share, minInstancesPerNode=s.min_rows,
        minInfoGain=s.min_gain, seed=s.seed, checkpointInterval=10)


def held_flag(keys, s: TrainSettings) -> Column:
    """True for the training rows that early stopping looks at."""
    return split_flag(keys, s.validation_share, s.seed + 1)


def fit_trees(vectors: DataFrame, label: str, keys, s: TrainSettings) -> GBTClassificationModel:
    """Boosted trees with early stopping on a part of the training rows.

    Boosting reads the rows many times: a ``_held`` column that is there spares their hashes.
    """
    shared_folder(vectors.sparkSession)  # sets the folder in which boosting cuts its lineage
    held = with_weight(vectors, label)
    if "_held" not in held.columns:
        held = held.withColumn("_held", held_flag(keys, s))
    return boosted_trees(s, label).setValidationIndicatorCol("_held").fit(held)


def fit_logistic(vectors: DataFrame, label: str, iterations: int = 100) -> LogisticRegressionModel:
    """Balanced logistic baseline.

    It is saved and read back: a fresh fit carries its training summary, and with it the
    session, which cannot be sent to tasks once the session has observed a table.
    """
    model = LogisticRegression(featuresCol="features", labelCol=label, weightCol="_weight", maxIter=iterations).fit(with_weight(vectors, label))
    path = fresh_path(vectors.sparkSession, "logistic")
    model.write().save(path)
    return LogisticRegressionModel.load(path)


def probability(c: str = "probability") -> Column:
    return vector_to_array(F.col(c))[1]


def raw_score(df: DataFrame, model: GBTClassificationModel, out: str) -> DataFrame:
    """The model's uncalibrated probability as one column."""
    return model.transform(df).withColumn(out, probability()).drop("rawPrediction", "probability", "prediction")


def fit_isotonic(scored: DataFrame, label: str, score: str, rows: int = TrainSettings.calibration_rows) -> IsotonicRegressionModel:
    """Isotonic fit on exact scores, one weighted row per score, of all labelled rows.

    Rows with one score enter by their mean and number, so pooling them changes nothing.
    Spark pools violators inside ranges of scores and then the blocks of all ranges, which
    gives the fit on all scores at once. More than ``rows`` rows are parted into so many
    ranges that one holds about ``rows`` scores at most. The driver gets the blocks only,
    two scores each; with labels of 0 and 1 a range's blocks have unequal fractions as
    means, so m rows make about m ** (2 / 3) of them at most.
    """
    per_score = scored.groupBy(F.col(score).alias("_s")).agg(F.avg(label).alias("_y"), F.count("*").cast("double").alias("_w"))
    ranges = -(-scored.count() // rows)
    if ranges > 1:
        # Spark makes as many ranges as there are partitions.
        per_score = per_score.repartition(max(ranges, int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "_s")
    return IsotonicRegression(featuresCol="_s", labelCol="_y", weightCol="_w").fit(per_score)


def fit_sigmoid(scored: DataFrame, label: str, score: str) -> LogisticRegressionModel:
    """Sigmoid on the log-odds of the raw score."""
    p = F.least(F.greatest(F.col(score), F.lit(1e-9)), F.lit(1 - 1e-9))
    odds = scored.select(F.col(label).cast("double").alias("_y"), F.log(p / (1 - p)).alias("_m"))
    rows = VectorAssembler(inputCols=["_m"], outputCol="_v").transform(odds)
    return LogisticRegression(featuresCol="_v", labelCol="_y").fit(rows)


def apply_sigmoid(df: DataFrame, model: LogisticRegressionModel, score: str, out: str) -> DataFrame:
    p = F.least(F.greatest(F.col(score), F.lit(1e-9)), F.lit(1 - 1e-9))
    margin = F.log(p / (1 - p)) * float(model.coefficients[0]) + float(model.intercept)
    return df.withColumn(out, 1 / (1 + F.exp(-margin)))


def apply_isotonic(df: DataFrame, model: IsotonicRegressionModel, score: str, out: str) -> DataFrame:
    return model.setFeaturesCol(score).setPredictionCol(out).transform(df)


@dataclass
class RiskModel:
    """Preparation, one explained model, and k calibrated fold models whose scores are averaged."""

    preparation: Preparation
    model: GBTClassificationModel
    fold_models: list[GBTClassificationModel] = field(default_factory=list)
    calibrators: list[IsotonicRegressionModel] = field(default_factory=list)

    @property
    def names(self) -> list[str]:
        return self.preparation.names

    def score_vectors(self, df: DataFrame) -> DataFrame:
        out = df
        if not self.calibrators:
            return raw_score(out, self.model, "risk_score")
        for i, (m, c) in enumerate(zip(self.fold_models, self.calibrators)):
            out = apply_isotonic(raw_score(out, m, f"_raw{i}"), c, f"_raw{i}", f"_cal{i}")
        mean = sum((F.col(f"_cal{i}") for i in range(len(self.calibrators))), F.lit(0.0)) / len(self.calibrators)
        return out.withColumn("risk_score", mean).drop(*[f"{p}{i}" for i in range(len(self.calibrators)) for p in ("_raw", "_cal")])

    def score(self, df: DataFrame) -> DataFrame:
        """Score, percentage and tier for a whole table; always calibrated."""
        out = self.score_vectors(self.preparation.transform(df))
        return out.withColumns({"risk_pct": F.round(F.col("risk_score") * 100, 1), "risk_tier": score_tier(F.col("risk_score"))})

    def save(self, spark: SparkSession, folder: str) -> None:
        p = self.preparation
        self.model.write().overwrite().save(f"{folder}/trees")
        for i, (m, c) in enumerate(zip(self.fold_models, self.calibrators)):
            m.write().overwrite().save(f"{folder}/fold_trees_{i}")
            c.write().overwrite().save(f"{folder}/fold_curve_{i}")
        if p.codes is not None:
            p.codes.write.mode("overwrite").parquet(f"{folder}/codes")
        state = {k: v for k, v in asdict(_state(p)).items()} | {"folds": len(self.calibrators)}
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").json(f"{folder}/state")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> "RiskModel":
        state = json.loads(spark.read.schema("state string").json(f"{folder}/state").first()["state"])
        folds = state.pop("folds")
        p = Preparation(**state)
        if p.categorical:
            p.codes = spark.read.parquet(f"{folder}/codes")
        return RiskModel(p, GBTClassificationModel.load(f"{folder}/trees"),
                         [GBTClassificationModel.load(f"{folder}/fold_trees_{i}") for i in range(folds)],
                         [IsotonicRegressionModel.load(f"{folder}/fold_curve_{i}") for i in range(folds)])


def _state(p: Preparation) -> Preparation:
    return Preparation(p.numeric, p.binary, p.categorical, p.fills, p.text_fills, None)


def train(df: DataFrame, label: str, keys, numeric, binary, categorical=(), settings: TrainSettings = TrainSettings(),
          calibrate: bool = True) -> RiskModel:
    """Fit on training rows: preparation, explained model, then k models each calibrated on its held-out fold.

    Folds come from the key's hash, so they are the same on every run. The hashes are kept
    with the vectors, as every tree's passes would form them again.
    """
    preparation = Preparation.fit(df, list(numeric), list(binary), list(categorical))
    vectors = preparation.transform(df).select(
        *keys, label, "features", held_flag(keys, settings).alias("_held"),
        (hash_bucket(keys, settings.seed + 2) % settings.folds).alias("_fold")).persist()
    try:
        out = RiskModel(preparation, fit_trees(vectors, label, keys, settings))
        if calibrate:
            fold = F.col("_fold")
            for i in range(settings.folds):
                m = fit_trees(vectors.filter(fold != i), label, keys, settings)
                out.fold_models.append(m)
                out.calibrators.append(fit_isotonic(raw_score(vectors.filter(fold == i), m, "_s0"), label, "_s0", settings.calibration_rows))
        return out
    finally:
        vectors.unpersist()


class AveragePrecision(Evaluator):
    """Step-wise average precision by the exact metric operator."""

    def __init__(self, label: str):
        super().__init__()
        self.label = label

    def _evaluate(self, dataset: DataFrame) -> float:
        # The model runs once; the metric's branches read the checkpointed scores.
        shared_folder(dataset.sparkSession)
        scored = dataset.select(F.col(self.label).alias("y"), probability().alias("s")).checkpoint()
        return curve_areas(scored, "y", "s").first()["average_precision"] or 0.0

    def isLargerBetter(self) -> bool:
        return True


# fixed values: search ranges of the published configuration
SEARCH_SPACE = {"maxIter": (100, 600), "maxDepth": (3, 8), "stepSize": (0.01, 0.3), "subsamplingRate": (0.6, 1.0),
                "featureSubsetStrategy": (0.5, 1.0), "minInstancesPerNode": (1, 10), "minInfoGain": (0.0, 1.0)}


def sampled_params(trials: int, seed: int = 42, space=SEARCH_SPACE) -> list[dict]:
    """Random draws from the search space; the step size on a log scale."""
    rng = random.Random(seed)
    draws = []
    for _ in range(trials):
        one = {}
        for name, (low, high) in space.items():
            if name in ("maxIter", "maxDepth", "minInstancesPerNode"):
                one[name] = rng.randint(int(low), int(high))
            elif name == "stepSize":
                one[name] = round(low * (high / low) ** rng.random(), 4)
            else:
                value = round(rng.uniform(low, high), 3)
                one[name] = str(max(value, 0.01)) if name == "featureSubsetStrategy" else value
        draws.append(one)
    return draws


def search(vectors: DataFrame, label: str, trials: int, folds: int, settings: TrainSettings, fold: Column, space=SEARCH_SPACE,
           parallelism: int = 2) -> tuple[dict, DataFrame]:
    """Cross-validated random search; returns the best draw and a table of all draws with their mean score."""
    base = boosted_trees(settings, label)
    draws = sampled_params(trials, settings.seed, space)
    grid = [ParamGridBuilder().baseOn({base.getParam(k): v for k, v in d.items()}).build()[0] for d in draws]
    cv = CrossValidator(estimator=base, estimatorParamMaps=grid, evaluator=AveragePrecision(label), numFolds=folds,
                        foldCol="_fold", parallelism=parallelism)
    fitted = cv.fit(with_weight(vectors, label).withColumn("_fold", fold.cast("int")))
    rows = [(i, json.dumps(d, sort_keys=True), float(m)) for i, (d, m) in enumerate(zip(draws, fitted.avgMetrics))]
    table = vectors.sparkSession.createDataFrame(rows, "trial int, params string, average_precision double")
    best = max(range(len(draws)), key=lambda i: fitted.avgMetrics[i])
    return draws[best], table
