"""Population-stability drift and label-rate shift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import PSI_AMBER_BELOW, PSI_GREEN_BELOW
from .quantiles import quantiles_from_counts, value_counts
from .profiles import unfold

FLOOR = 1e-6


def long_form(df: DataFrame, features) -> DataFrame:
    """(feature, value) rows, nulls dropped; partial aggregation follows at once."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(F.inline(pairs)).filter(F.col("value").isNotNull() & ~F.isnan("value"))


def _place(value, edges):
    """Bin number from 1, the last edge closing the last bin; 0 outside the reference range."""
    reached = F.size(F.filter(edges, lambda e: e <= value))
    last = F.element_at(edges, -1)
    return F.when(value < last, reached).when(value == last, F.size(edges) - 1).otherwise(0)


def _bin_counts(long: DataFrame, edges: DataFrame, rows) -> DataFrame:
    """Rows and value total per (feature, bin). ``edges`` has one short row per feature: its size is the table's width.
    So it goes to the values by broadcast; a shuffle by feature would put all values of one feature into one task."""
    e = F.broadcast(edges.select(F.col("feature").alias("_f"), "bins"))
    return long.join(e, F.col("feature") == F.col("_f")).groupBy(
        "feature", _place(F.col("value"), F.col("bins")).alias("bin")).agg(
        F.sum(rows).alias("n"), F.sum(F.col("value") * rows).alias("v"))


def _per_feature(counts: DataFrame) -> DataFrame:
    """One row per feature: counts by bin as a map (at most bins + 1 entries), rows and mean."""
    return counts.groupBy("feature").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_c"),
        F.sum("n").alias("_rows"), (F.sum("v") / F.sum("n")).alias("_mean"))


def _in_bins(counts, n_bins):
    return F.transform(F.sequence(F.lit(1), n_bins), lambda i: F.coalesce(F.try_element_at(counts, i), F.lit(0).cast("bigint")))


def fit_reference(df: DataFrame, features, n_bins: int = 10) -> DataFrame:
    """Percentile bins, their counts, mean and population deviation per feature.

    Features with under 10 values, no spread or fewer distinct values than bins are left
    out. Distinct counts, percentiles and bin counts all start from one table of value counts.
    """
    known = lambda f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
    row = df.agg(*[a for i, f in enumerate(features) for a in (
        F.avg(known(f)).alias(f"m{i}"), F.stddev_pop(known(f)).alias(f"s{i}"))])
    shape = unfold(row, [F.struct(F.lit(f).alias("feature"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"))
                         for i, f in enumerate(features)])
    counts = value_counts(long_form(df, features), "value", ["feature"])
    distinct = counts.groupBy(F.col("feature").alias("_f")).agg(F.count("*").alias("_u"), F.sum("n").alias("_t"))
    kept = shape.join(distinct, F.col("feature") == F.col("_f")).filter(
        (F.col("_t") >= 10) & (F.col("std") >= 1e-8) & (F.col("_u") >= n_bins)).select("feature", "mean", "std")
    q = quantiles_from_counts(counts, "value", [i / n_bins for i in range(n_bins + 1)], ["feature"], "bins")
    edges = kept.join(q.select(F.col("feature").alias("_f"), F.array_sort(F.array_distinct("bins")).alias("bins")),
                      F.col("feature") == F.col("_f")).drop("_f").filter(F.size("bins") >= 2)
    per = _per_feature(_bin_counts(counts, edges, F.col("n"))).select(F.col("feature").alias("_f"), "_c")
    return edges.join(per, F.col("feature") == F.col("_f")).select(
        "feature", "bins", _in_bins(F.col("_c"), F.size("bins") - 1).alias("ref_counts"), "mean", "std")


def detect(new: DataFrame, reference: DataFrame, features, alert_at: float = PSI_AMBER_BELOW, min_rows: int = 5) -> DataFrame:
    """PSI per feature with status and alert (S8): one pass over the new data.

    ``reference`` is a fitted, saved table with one row per feature.
    """
    per = _per_feature(_bin_counts(long_form(new, features), reference, F.lit(1))).filter(F.col("_rows") >= min_rows)
    both = reference.withColumnRenamed("feature", "_f").join(per, F.col("feature") == F.col("_f"))
    total = lambda c: F.greatest(F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(1))
    floored = lambda c, t: F.transform(c, lambda x: F.greatest(x / t, F.lit(FLOOR)))
    both = both.withColumn("_new", _in_bins(F.col("_c"), F.size("bins") - 1))
    both = both.withColumns({"_o": floored(F.col("ref_counts"), total(F.col("ref_counts"))), "_w": floored(F.col("_new"), total(F.col("_new")))})
    terms = F.zip_with("_o", "_w", lambda o, w: (w - o) * F.log(w / o))
    psi = F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
    return both.withColumn("psi", psi).select(
        "feature", "psi", psi_status(F.col("psi")).alias("status"), F.col("mean").alias("mean_train"), F.col("_mean").alias("mean_new"),
        (F.col("psi") >= alert_at).cast("int").alias("alert"))


def psi_status(psi):
    return F.when(psi < PSI_GREEN_BELOW, "GREEN").when(psi < PSI_AMBER_BELOW, "AMBER").otherwise("RED")


def label_shift(reference: DataFrame, current: DataFrame, label: str, warn_above: float = 0.10) -> DataFrame:
    ref = reference.agg(F.avg(label).alias("reference_rate"))
    return ref.withColumn("current_rate", current.agg(F.avg(label)).scalar()).withColumn(
        "shift", F.abs(F.col("current_rate") - F.col("reference_rate"))).withColumn(
        "shifted", (F.col("shift") > warn_above).cast("int"))


def top_drift(report: DataFrame, n: int = 20) -> DataFrame:
    """The n largest PSI values with their level."""
    return report.select("feature", "psi", psi_status(F.col("psi")).alias("level")).orderBy(
        F.col("psi").desc(), "feature").limit(n)


def flagged_drift(report: DataFrame) -> DataFrame:
    return report.filter("status = 'RED'").select("feature", "mean_train", "mean_new", "psi")


def drift_headline(report: DataFrame) -> DataFrame:
    """Checks, flagged, stable and the banner level."""
    red = F.col("n_flagged")
    return report.agg(F.count("*").alias("n_checks"), F.count_if(F.col("status") == "RED").alias("n_flagged")).select(
        "n_checks", "n_flagged", (F.col("n_checks") - red).alias("n_stable"),
        F.when(red == 0, "ok").when(red <= 3, "warning").otherwise("error").alias("banner"))
