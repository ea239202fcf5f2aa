"""Column profiles: one pass over many columns, then one row per column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .checks import numeric_columns
from .quantiles import exact_quantiles

def unfold(row: DataFrame, items) -> DataFrame:
    """A one-row table as one row per struct in ``items``."""
    return row.select(F.inline(F.array(*items)))


WHOLE_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED = (T.ArrayType, T.StructType, T.MapType)


def _slots(df: DataFrame, column: str) -> list[Column]:
    """The value as a double, a long or a text, whichever keeps values apart at least cost."""
    kind, c, no = df.schema[column].dataType, F.col(f"`{column}`"), lambda k: F.lit(None).cast(k)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return [c.cast("double"), no("bigint"), no("string")]
    if isinstance(kind, WHOLE_NUMBERS):
        number = {T.DateType: F.unix_date, T.TimestampType: F.unix_micros, T.TimestampNTZType: lambda x: F.unix_micros(x.cast("timestamp"))}.get(type(kind))
        return [no("double"), (number(c) if number else c).cast("bigint"), no("string")]
    text = F.hex(c) if isinstance(kind, T.BinaryType) else F.to_json(F.struct(c)) if isinstance(kind, NESTED) else c.cast("string")
    return [no("double"), no("bigint"), F.when(c.isNotNull(), text)]


def value_table(df: DataFrame, columns, groups=()) -> DataFrame:
    """(groups, position, d, l, s, n): how often each column, by its position in ``columns``,
    has each value, null included.

    One scan for any number of columns: a row becomes a narrow row per column, which is
    counted before the shuffle. So what is shuffled are the distinct values of each task.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("position"), *[v.alias(n) for n, v in zip("dls", _slots(df, c))]) for i, c in enumerate(columns)])
    return df.select(*groups, F.inline(pairs)).groupBy(*groups, "position", "d", "l", "s").agg(F.count("*").alias("n"))


def per_column(df: DataFrame, columns, counts: DataFrame, out: str) -> DataFrame:
    """One row per column, whether or not the table has rows: its name and what ``counts`` says of its position."""
    names = df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(c) for c in columns])).alias("_p", out))
    return names.join(counts, F.col("_p") == F.col("position"), "left").drop("_p", "position")


def _known() -> Column:
    return F.col("d").isNotNull() | F.col("l").isNotNull() | F.col("s").isNotNull()


def column_profile(df: DataFrame, columns=None) -> DataFrame:
    """Missing share and exact distinct count per column."""
    columns = list(df.columns if columns is None else columns)
    counts = value_table(df, columns).groupBy("position").agg(
        F.sum("n").alias("_n"), F.sum(F.when(~_known(), F.col("n"))).alias("_z"), F.count_if(_known()).alias("_u"))
    return per_column(df, columns, counts, "column").select(
        "column", (F.coalesce("_z", F.lit(0)) / F.col("_n")).alias("missing_share"), F.coalesce("_u", F.lit(0).cast("bigint")).alias("n_unique"))


def completeness_audit(df: DataFrame) -> DataFrame:
    """Column profile with the missing percentage and the type."""
    kinds = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    return column_profile(df).select(
        "column", (F.col("missing_share") * 100).alias("missing_pct"), "n_unique", kinds[F.col("column")].alias("dtype"))


def completeness_headline(audit: DataFrame) -> DataFrame:
    return audit.agg(
        F.count_if(F.col("missing_pct") > 80).alias("over_80_missing"),
        F.count_if(F.col("missing_pct") == 0).alias("fully_present"), F.count("*").alias("n_columns"))


def feature_report(df: DataFrame, features, groups: dict | None = None) -> DataFrame:
    """Null %, distinct, mean and sample deviation per numeric feature, with its group.

    All come from one table of counts per value; deviations are taken from the mean first.
    The means, a row per feature, go to the counts by broadcast: joined by a shuffle, all
    values of one feature would land in one task.
    """
    features = list(features)
    owner = {f: g for g, names in (groups or {}).items() for f in names}
    counts = value_table(df, features).withColumn("v", F.coalesce("d", F.col("l").cast("double"), F.col("s").cast("double")))
    known, n = F.col("v").isNotNull(), F.col("n")
    means = counts.groupBy("position").agg(
        F.sum(n).alias("_rows"), F.sum(F.when(known, n)).alias("_n"), F.count_if(known).alias("_u"), F.sum(F.col("v") * n).alias("_s"))
    means = means.withColumn("_mean", F.col("_s") / F.col("_n"))
    off = F.col("v") - F.col("_mean")
    spread = counts.join(F.broadcast(means.select(F.col("position").alias("_q"), "_mean")), F.col("position") == F.col("_q")).groupBy(
        F.col("position").alias("_q")).agg(F.sum(off * off * n).alias("_m2"))
    table = means.join(spread, F.col("position") == F.col("_q"), "left").drop("_q")
    std = F.when(F.col("_n") > 1, F.sqrt(F.col("_m2") / (F.col("_n") - 1)))
    group = F.element_at(F.array(*[F.lit(owner.get(f)).cast("string") for f in features]), F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature")).cast("int"))
    return per_column(df, features, table, "feature").select(
        "feature", group.alias("feature_group"), ((F.col("_rows") - F.coalesce("_n", F.lit(0))) / F.col("_rows") * 100).alias("null_pct"),
        F.coalesce("_u", F.lit(0).cast("bigint")).alias("n_unique"), F.col("_mean").alias("mean"), F.nanvl(std, F.lit(None).cast("double")).alias("std"))


def feature_headline(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count_if(F.col("null_pct") > 50).alias("over_50_null"), F.count_if(F.col("null_pct") == 0).alias("fully_present"),
        F.count_if(F.col("std") == 0).alias("zero_variance"))


def load_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns and overall null % per table; one aggregate per table, one union."""
    parts = []
    for name, df in tables.items():
        nulls = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in df.columns])
        parts.append(df.agg(F.count("*").alias("n_rows"), F.sum(nulls).alias("_nulls")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_cols"),
            (F.try_divide(F.col("_nulls").cast("double"), F.col("n_rows") * len(df.columns)) * 100).alias("null_pct")))
    return reduce(DataFrame.unionByName, parts)


def table_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Row and column counts."""
    parts = [df.agg(F.count("*").alias("raw_rows")).select(
        F.lit(name).alias("table_name"), "raw_rows", F.lit(len(df.columns)).alias("n_columns")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def flag_coverage(df: DataFrame, flags) -> DataFrame:
    """Sum, mean % and null % per flag column."""
    row = df.agg(*[a for i, f in enumerate(flags) for a in (
        F.sum(f).alias(f"n{i}"), F.avg(f).alias(f"a{i}"), F.avg(F.col(f).isNull().cast("double")).alias(f"z{i}"))])
    return unfold(row, [F.struct(
        F.lit(f).alias("vaccine"), F.col(f"n{i}").cast("bigint").alias("received_n"), (F.col(f"a{i}") * 100).alias("pct_received"),
        (F.col(f"z{i}") * 100).alias("pct_null")) for i, f in enumerate(flags)])


def linkage_quality(df: DataFrame, columns) -> DataFrame:
    """Null %, linked rows and mean per context column; absent columns count as fully null."""
    present = [c for c in columns if c in df.columns]
    row = df.agg(F.count("*").alias("n"), *[a for c in present for a in (F.count(c).alias(f"c_{c}"), F.avg(c).alias(f"a_{c}"))])
    items = []
    for c in columns:
        linked = F.col(f"c_{c}") if c in present else F.lit(0).cast("bigint")
        mean = F.col(f"a_{c}") if c in present else F.lit(None).cast("double")
        items.append(F.struct(F.lit(c).alias("feature"), ((1 - linked / F.col("n")) * 100).alias("null_pct"),
                              linked.alias("linked_n"), mean.alias("mean_value")))
    return unfold(row, items)


def flag_prevalence(df: DataFrame, flags) -> DataFrame:
    """Rows set and % per flag."""
    row = df.agg(*[a for f in flags for a in (F.sum(f).alias(f"n_{f}"), F.avg(f).alias(f"p_{f}"))])
    return unfold(row, [F.struct(F.lit(f).alias("sub_flag"), F.col(f"n_{f}").cast("bigint").alias("positive_n"),
                                 (F.col(f"p_{f}") * 100).alias("positive_pct")) for f in flags])


def value_counts_with_null(df: DataFrame, value: Column, out: str = "value") -> DataFrame:
    return df.groupBy(value.alias(out)).agg(F.count("*").alias("n"))


def describe(df: DataFrame, column: str, groups=()) -> DataFrame:
    """count, mean, sample deviation, min, quartiles and max, with exact quartiles."""
    groups = list(groups)
    base = df.filter(F.col(column).isNotNull()).groupBy(*groups).agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"))
    q = exact_quantiles(df, column, [0, 0.25, 0.5, 0.75, 1], groups, "_q")
    names = ("min", "q1", "median", "q3", "max")
    q = q.select(*[F.col(g).alias(f"_g_{g}") for g in groups], *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    test = F.lit(True)
    for g in groups:
        test = test & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    if not groups:
        # Two one-row tables side by side.
        return base.select("*", *[q.select(n).scalar().alias(n) for n in names])
    return base.join(q, test).drop(*[f"_g_{g}" for g in groups])


def headline(df: DataFrame, patient: str, area: str, county: str, month: str, target: str) -> DataFrame:
    """Rows, distinct entities, month range and class shares in one row."""
    return df.agg(
        F.count("*").alias("n_rows"), F.count_distinct(patient).alias("n_patients"), F.count_distinct(area).alias("n_areas"),
        F.count_distinct(county).alias("n_counties"), F.count_distinct(month).alias("n_months"),
        F.min(month).alias("first_month"), F.max(month).alias("last_month"),
        F.avg(target).alias("positive_share"), F.avg(1 - F.col(target)).alias("negative_share"))


def county_coverage(df: DataFrame, county: str, patient: str, area: str, target: str) -> DataFrame:
    return df.filter(F.col(county).isNotNull()).groupBy(county).agg(
        F.count_distinct(patient).alias("patients"), F.count_distinct(area).alias("chw_areas"),
        (F.avg(target) * 100).alias("defaulter_rate"))


def cross_tab(df: DataFrame, row: str, column: str, column_values) -> DataFrame:
    """Counts of row × column with margins, named ``All``."""
    label = lambda c: F.when(F.grouping(c) == 1, "All").otherwise(F.col(c).cast("string"))
    cubed = df.cube(row, column).agg(F.count("*").alias("n"), label(row).alias("_r"), label(column).alias("_c"))
    wide = cubed.groupBy("_r").pivot("_c", [str(v) for v in column_values] + ["All"]).agg(F.sum("n"))
    return wide.select(F.col("_r").alias(row), *[
        F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(f"{column}_{v}".lower()) for v in [*map(str, column_values), "All"]])


def flags_set(df: DataFrame, flags) -> DataFrame:
    """Rows by how many of the flags are set, rows with none left out."""
    return df.groupBy(reduce(lambda a, b: a + b, [F.col(f) for f in flags]).alias("flags_set")).agg(
        F.count("*").alias("n")).filter("flags_set > 0")


def class_means(df: DataFrame, label: str, columns) -> DataFrame:
    return df.groupBy(label).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def histogram(df: DataFrame, value: str, bins: int, groups=(), density: bool = False) -> DataFrame:
    """Equal-width bins between minimum and maximum, per group where groups are given.

    Rows are bucketed from per-group bounds; the last bin includes the maximum.
    """
    groups = list(groups)
    known = df.filter(F.col(value).isNotNull()).select(*groups, value)
    ends = known.groupBy(*groups).agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"),
                                      F.count("*").alias("_n"))
    if groups:
        ends = ends.select(*[F.col(g).alias(f"_g_{g}") for g in groups], "_lo", "_hi", "_n")
        test = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups])
        placed = known.join(ends, test)
    else:
        placed = known.select("*", *[ends.select(c).scalar().alias(c) for c in ("_lo", "_hi", "_n")])
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)
    out = placed.groupBy(*groups, at.cast("int").alias("bin"), "_lo", "_hi", "_n").agg(F.count("*").alias("n"))
    cols = [*groups, "bin", (F.col("_lo") + F.col("bin") * width).alias("bin_start"), "n"]
    if density:
        cols.append((F.col("n") / (F.col("_n") * width)).alias("density"))
    return out.select(*cols)


def mean_comparison(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Reference and current mean of every numeric column that both have."""
    names = [c for c in numeric_columns(current) if c in reference.columns]
    side = lambda df, out: unfold(df.agg(*[F.avg(c).alias(c) for c in names]), [
        F.struct(F.lit(c).alias("feature"), F.col(c).alias(out)) for c in names])
    return side(reference, "reference_mean").join(side(current, "current_mean"), "feature")
