"""Exact, tie-safe model metrics.

Scored rows are first reduced to one row per distinct score. Everything that needs
the score order works on that table in range-sorted pieces (see ``scan``); no window runs
over raw rows and none is unpartitioned except over one row per piece.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DEPLOYMENT_LIMITS
from ..functions.numbers import step
from .scan import segmented_rank, segmented_totals


def by_score(df: DataFrame, label: str, score: str, groups=()) -> DataFrame:
    """(groups, score, pos, neg): rows of each class per distinct score."""
    known = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    y = F.col(label).cast("bigint")
    return known.groupBy(*groups, F.col(score).alias("score")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


def cumulative(df: DataFrame, label: str, score: str, groups=()) -> DataFrame:
    """Distinct scores with tp and fp counted from the highest score down."""
    run = segmented_totals(by_score(df, label, score, groups), ["pos", "neg"], [F.col("score").desc()], groups)
    return run.withColumnsRenamed({"cum_pos": "tp", "cum_neg": "fp"})


def _areas(groups, cum: DataFrame) -> DataFrame:
    """Sums from which the three areas follow."""
    prev_tp, prev_fp = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    before = F.when(prev_tp + prev_fp > 0, prev_tp / (prev_tp + prev_fp)).otherwise(1.0)
    return cum.groupBy(*groups).agg(
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"),
        F.sum(F.col("neg") * (F.col("tp") + prev_tp) / 2).alias("_roc"),
        F.sum(F.col("pos") * precision).alias("_ap"),
        F.sum(F.col("pos") * (precision + before) / 2).alias("_pr"))


def curve_areas(df: DataFrame, label: str, score: str, groups=()) -> DataFrame:
    """ROC-AUC, step-wise average precision and trapezoid PR-AUC (S10); null with one class only."""
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    return _areas(groups, cumulative(df, label, score, groups)).select(
        *groups, (F.col("_p") + F.col("_n")).alias("n"), F.col("_p").alias("positives"),
        F.when(both, F.col("_roc") / (F.col("_p").cast("double") * F.col("_n"))).alias("roc_auc"),
        F.when(F.col("_p") > 0, F.col("_ap") / F.col("_p")).alias("average_precision"),
        F.when(both, F.col("_pr") / F.col("_p")).alias("pr_auc_trapezoid"))


def curve_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """ROC and PR curve points, one per distinct score."""
    cum = cumulative(df, label, score)
    totals = by_score(df, label, score).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    p, n = totals.select("p").scalar(), totals.select("n").scalar()
    return cum.select(
        F.col("score").alias("threshold"), "tp", "fp", F.try_divide(F.col("fp").cast("double"), n).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), p).alias("tpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def _ratio(a, b):
    """a/b with 0 for an empty denominator."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def point_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Precision, recall and F1 at a threshold, and the Brier score; one pass."""
    y, p = F.col(label), F.col(score)
    hit = p >= threshold
    row = df.filter(y.isNotNull() & p.isNotNull()).agg(
        F.count("*").alias("n"), F.count_if(hit & (y == 1)).alias("tp"), F.count_if(hit & (y == 0)).alias("fp"),
        F.count_if(~hit & (y == 1)).alias("fn"), F.avg((p - y) * (p - y)).alias("brier_score"))
    return row.select(
        "n", _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), "brier_score")


def calibration_bins(df: DataFrame, label: str, score: str, bins: int = 10, right_closed: bool = False) -> DataFrame:
    """Equal-width bins: size, mean score, share of positives.

    Left-closed bins leave out a score of exactly 1 (S7); right-closed ones keep every score.
    """
    p, y = F.col(score), F.col(label)
    inner = [i / bins for i in range(1, bins)]
    if right_closed:
        at = sum(((p > e).cast("int") for e in inner), F.lit(0))
    else:
        at = F.when((p >= 0) & (p < 1), step(p, inner))
    known = df.filter(p.isNotNull() & y.isNotNull())
    return known.groupBy(at.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(p).alias("mean_score"), F.avg(y.cast("double")).alias("positive_share"))


def expected_calibration_error(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Weighted mean gap between score and outcome; rows outside all bins count in the total only."""
    gap = F.abs(F.col("positive_share") - F.col("mean_score")) * F.col("n")
    return calibration_bins(df, label, score, bins).agg(
        (F.coalesce(F.sum(F.when(F.col("bin").isNotNull(), gap)), F.lit(0.0)) / F.sum("n")).alias("expected_calibration_error"))


def confusion(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Actual × predicted counts, all four cells."""
    y, hit = F.col(label), (F.col(score) >= threshold).cast("int")
    row = df.agg(*[F.count_if((y == a) & (hit == b)).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)])
    return row.select(F.inline(F.array(*[F.struct(
        F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(f"c{a}{b}").alias("n")) for a in (0, 1) for b in (0, 1)])))


def class_report(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted averages."""
    c = confusion(df, label, score, threshold)
    cell = lambda a, b: F.max(F.when((F.col("actual") == a) & (F.col("predicted") == b), F.col("n")))
    row = c.agg(*[cell(a, b).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)])
    per = []
    for k in (0, 1):
        tp, fp, fn = F.col(f"c{k}{k}"), F.col(f"c{1 - k}{k}"), F.col(f"c{k}{1 - k}")
        per.append((_ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2 * tp, 2 * tp + fp + fn), tp + fn))
    total = per[0][3] + per[1][3]
    names = ("precision", "recall", "f1", "support")
    line = lambda name, vals: F.struct(F.lit(name).alias("class"), *[v.alias(n) for v, n in zip(vals, names)])
    macro = [(per[0][i] + per[1][i]) / 2 for i in range(3)]
    weighted = [_ratio(per[0][i] * per[0][3] + per[1][i] * per[1][3], total) for i in range(3)]
    accuracy = _ratio(F.col("c00") + F.col("c11"), total)
    return row.select(F.inline(F.array(
        line("0", per[0]), line("1", per[1]), line("accuracy", [accuracy] * 3 + [total]),
        line("macro avg", [*macro, total]), line("weighted avg", [*weighted, total]))))


def threshold_table(df: DataFrame, label: str, score: str, thresholds=tuple(i / 20 for i in range(2, 18))) -> DataFrame:
    """Flagged, precision, recall and F1 per threshold.

    Each row falls into one step between thresholds; the table is added up from at
    most len(thresholds)+1 steps, not from a copy of the rows per threshold.
    """
    y, p = F.col(label), F.col(score)
    steps = df.filter(y.isNotNull() & p.isNotNull()).groupBy(step(p, thresholds).alias("_s")).agg(
        F.count("*").alias("_n"), F.sum(y.cast("bigint")).alias("_p"))
    row = steps.agg(F.sum("_n").alias("n"), F.sum("_p").alias("p"), *[
        F.coalesce(F.sum(F.when(F.col("_s") > i, F.col(c))), F.lit(0)).alias(f"{c}{i}")
        for i in range(len(thresholds)) for c in ("_n", "_p")])
    items = []
    for i, t in enumerate(thresholds):
        flagged, tp = F.col(f"_n{i}"), F.col(f"_p{i}")
        items.append(F.struct(
            F.lit(float(t)).alias("threshold"), flagged.alias("flagged"),
            F.try_divide(flagged.cast("double") * 100, F.col("n")).alias("flagged_pct"),
            _ratio(tp, flagged).alias("precision"), _ratio(tp, F.col("p")).alias("recall"),
            _ratio(2 * tp, flagged + F.col("p")).alias("f1")))
    return row.select(F.inline(F.array(*items)))


def top_k_threshold(df: DataFrame, score: str, share: float = 0.2) -> DataFrame:
    """The k-th largest score, k = max(1, floor(n*share)); 0.5 for an empty table."""
    counts = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count("*").alias("c"))
    run = segmented_totals(counts, ["c"], [F.col("score").desc()])
    total = run.agg(F.sum("c")).scalar()
    k = F.greatest(F.lit(1), F.floor(total * F.lit(share)))
    cut = F.max(F.when(F.col("cum_c") >= k, F.col("score")))
    return run.agg(F.coalesce(cut, F.lit(0.5)).alias("threshold"))


def precision_at_share(df: DataFrame, label: str, score: str, keys, share: float = 0.2) -> DataFrame:
    """Share of positives among the top rows; ties at the cut go to the smaller keys.

    Counts per score give the cut and all that lies above it; a second read takes the rows
    that tie at the cut, which are put in order in pieces by ranges of the keys.
    """
    known = df.filter(F.col(score).isNotNull()).select(*keys, F.coalesce(F.col(label), F.lit(0)).alias("_y"), F.col(score).alias("_s"))
    counts = known.groupBy("_s").agg(F.count("*").alias("_n"), F.sum("_y").alias("_p"))
    run = segmented_totals(counts, ["_n", "_p"], [F.col("_s").desc()])
    k = F.greatest(F.lit(1), F.floor(run.agg(F.sum("_n")).scalar() * F.lit(share)))
    cut = run.withColumn("_k", k).filter("cum__n >= _k AND cum__n - _n < _k").select(
        F.col("_s").alias("_cut"), (F.col("cum__n") - F.col("_n")).alias("_above"), (F.col("cum__p") - F.col("_p")).alias("_hits"),
        (F.col("_k") - F.col("cum__n") + F.col("_n")).alias("_room"))
    tied = known.join(cut, F.col("_s") == F.col("_cut"))
    taken = segmented_rank(tied, [F.col(c).asc() for c in keys], out="_place", deal=keys).filter("_place <= _room").agg(
        F.count("*").alias("t"), F.coalesce(F.sum("_y"), F.lit(0)).alias("ty"), F.coalesce(F.max("_above"), F.lit(0)).alias("a"), F.coalesce(F.max("_hits"), F.lit(0)).alias("ay"))
    rows = F.col("t") + F.col("a")
    return taken.select(rows.alias("n_top"), F.try_divide(F.col("ty") + F.col("ay"), rows).alias("precision_at_share"))


def group_fairness(df: DataFrame, label: str, score: str, dimensions: dict[str, str], min_rows: int = 3) -> DataFrame:
    """Size, rate, ROC-AUC and average precision per group of each dimension, with both classes present."""
    parts = []
    for name, column in dimensions.items():
        one = curve_areas(df.filter(F.col(column).isNotNull()), label, score, [column]).filter(
            (F.col("n") >= min_rows) & F.col("roc_auc").isNotNull())
        parts.append(one.select(
            F.lit(name).alias("dimension"), F.col(column).cast("string").alias("group_value"), "n",
            (F.col("positives") / F.col("n")).alias("positive_rate"), "roc_auc", "average_precision"))
    return reduce(DataFrame.unionByName, parts)


def fairness_gap(table: DataFrame, limit: float = 0.10) -> DataFrame:
    """Largest AUC difference per dimension against a limit."""
    gap = F.max("roc_auc") - F.min("roc_auc")
    return table.groupBy("dimension").agg(gap.alias("auc_gap"), F.count("*").alias("n_groups")).withColumn(
        "within_limit", (F.col("auc_gap") <= limit).cast("int"))


def deployment_gates(metrics: DataFrame, limits=DEPLOYMENT_LIMITS) -> DataFrame:
    """A one-row metric table against its limits: one row per metric that is present."""
    items = []
    for name, kind, limit in limits:
        if name not in metrics.columns:
            continue
        v = F.col(name).cast("double")
        ok = v >= limit if kind == "min" else v <= limit
        items.append(F.struct(F.lit(name).alias("metric"), v.alias("value"), F.lit(limit).alias("limit_value"),
                              F.lit(kind).alias("kind"), F.coalesce(ok.cast("int"), F.lit(0)).alias("passed")))
    return metrics.select(F.inline(F.array(*items)))
