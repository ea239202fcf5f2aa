"""Correlations."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import fresh_path
from ..sources.tables import layer
from .profiles import unfold


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def t_test_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation r over n pairs."""
    df = n - 2
    if df <= 0 or abs(r) >= 1.0:
        return 0.0 if abs(r) >= 1.0 else float("nan")
    x = 1.0 - r * r  # = df / (df + t²)
    a, b = df / 2.0, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if x < 1 else 0.0
    if x >= 1.0:
        return 1.0
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([t_test_p(a, int(b)) for a, b in zip(r, n)])


def safe_corr(x, y):
    """Correlation over the pairs with both values; null without spread."""
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)


def label_correlation(df: DataFrame, label: str, features, min_rows: int = 30, with_p: bool = True) -> DataFrame:
    """Point-biserial r per feature with enough rows and at least two values, in one pass.

    The p-value is worked out on the result, one row per feature.
    """
    features = list(features)
    y = F.col(label).cast("double")
    row = df.agg(*[a for i, f in enumerate(features) for a in (
        safe_corr(F.col(f).cast("double"), y).alias(f"r{i}"),
        F.count(F.when(y.isNotNull(), F.col(f))).alias(f"n{i}"),
        F.min(F.when(y.isNotNull(), F.col(f).cast("double"))).alias(f"a{i}"),
        F.max(F.when(y.isNotNull(), F.col(f).cast("double"))).alias(f"b{i}"))])
    out = unfold(row, [F.struct(F.lit(f).alias("feature"), F.col(f"n{i}").alias("n"),
                                F.when(F.col(f"a{i}") < F.col(f"b{i}"), F.col(f"r{i}")).alias("r_pb"))
                       for i, f in enumerate(features)])
    out = out.filter((F.col("n") >= min_rows) & F.col("r_pb").isNotNull() & ~F.isnan("r_pb"))
    return out.withColumn("p_value", correlation_p("r_pb", F.col("n").cast("double"))) if with_p else out


def pair_sums(df: DataFrame, features) -> DataFrame:
    """(i, j, n, x, y, xx, yy, xy, bad) for i <= j and each task: over its rows with both
    values, their number, means, and sums of products of what differs from the means.

    Batches become blocks of values and of masks, and one product of two blocks gives a sum
    for all pairs at once. Values are taken off a median of
    the first batch, so that products stay small.
    """
    features = list(features)
    k = len(features)
    upper = np.triu_indices(k)

    def gram(batches):
        shift = np.full(k, np.nan)
        n, s, ss, xy, bad = (np.zeros((k, k)) for _ in range(5))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            there = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns])
            finite = np.isfinite(x)
            for i in np.flatnonzero(np.isnan(shift) & finite.any(axis=0)):
                shift[i] = np.median(x[finite[:, i], i])
            z = np.where(finite, x - np.where(np.isnan(shift), 0, shift), 0.0)
            m, off = there.astype(float), (there & ~finite).astype(float)
            n, s, ss, xy, bad = n + m.T @ m, s + z.T @ m, ss + (z * z).T @ m, xy + z.T @ z, bad + off.T @ m + m.T @ off
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = s / n
            # Without spread, sums leave rounding only.
            own = np.where(ss - s * mean > 1e-12 * ss, ss - s * mean, 0.0)
            cross = xy - s * mean.T
        at = np.nan_to_num(shift)
        columns = [n, mean + at[:, None], (mean + at[:, None]).T, own, own.T, cross, bad]
        kept = n[upper] > 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(a[kept].astype(np.int32)) for a in upper] + [pa.array(c[upper][kept]) for c in columns], ["i", "j", "n", "x", "y", "xx", "yy", "xy", "bad"])

    numbers = df.select(*[F.col(f).cast("double").alias(f"c{i}") for i, f in enumerate(features)])
    return numbers.mapInArrow(gram, "i int, j int, " + ", ".join(f"{c} double" for c in ("n", "x", "y", "xx", "yy", "xy", "bad")))


def correlation_matrix(df: DataFrame, features) -> DataFrame:
    """Pairwise-complete correlations in long form, both orders and the diagonal; one pass
    of block products. Null without spread and where a value of the pair is not finite."""
    features = list(features)
    # A row per pair and task: small, so it is written and read twice instead of the source.
    parts = layer(pair_sums(df, features), fresh_path(df.sparkSession, "pair_sums") + ".parquet")
    total = F.sum("n")
    means = parts.groupBy(F.col("i").alias("_i"), F.col("j").alias("_j")).agg(
        (F.sum(F.col("n") * F.col("x")) / total).alias("_x"), (F.sum(F.col("n") * F.col("y")) / total).alias("_y"))
    dx, dy = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    n = F.col("n")

    def spread(squares, mean):
        """Null where the values differ by no more than the rounding of their mean."""
        return F.when(F.sum(squares) > 1e-28 * F.sum(n) * F.max(mean * mean), F.sum(squares))

    sums = parts.join(means, (F.col("i") == F.col("_i")) & (F.col("j") == F.col("_j"))).groupBy("i", "j").agg(
        spread(F.col("xx") + n * dx * dx, F.col("_x")).alias("xx"), spread(F.col("yy") + n * dy * dy, F.col("_y")).alias("yy"),
        F.sum(F.col("xy") + n * dx * dy).alias("xy"), F.sum("bad").alias("bad"))
    r = F.when(F.col("bad") == 0, F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")))
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    all_pairs = df.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(j).alias("_j")) for i, j in pairs])))
    full = all_pairs.join(sums.select("i", "j", r.alias("r")), (F.col("i") == F.col("_i")) & (F.col("j") == F.col("_j")), "left")
    name = lambda c: F.element_at(F.array(*[F.lit(f) for f in features]), F.col(c) + 1)
    both = full.select(name("_i").alias("feature_a"), name("_j").alias("feature_b"), F.when(~F.isnan("r"), F.col("r")).alias("r"))
    return both.unionAll(both.filter("feature_a != feature_b").select(F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), "r"))
