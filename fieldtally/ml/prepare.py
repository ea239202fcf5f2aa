"""Imputation, encoding and assembly; feature names come from the fitted state only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.checks import null_only
from ..operators.codes import category_table, encode_categories
from ..operators.drift import long_form
from ..operators.quantiles import exact_quantiles, most_frequent


def median_values(df: DataFrame, columns) -> DataFrame:
    """(feature, value): exact medians of all columns in one pass."""
    q = exact_quantiles(long_form(df, columns), "value", [0.5], ["feature"], "_q")
    return q.select("feature", F.col("_q")[0].alias("value"))


def frequent_values(df: DataFrame, columns) -> DataFrame:
    """(feature, value): the most frequent value of each numeric column, the smallest on ties."""
    return most_frequent(long_form(df, columns), "value", ["feature"], "value")


def frequent_texts(df: DataFrame, columns) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])
    return most_frequent(df.select(F.inline(pairs)), "value", ["feature"], "value")


@dataclass
class Preparation:
    """Fitted state: one fill value per feature, and the category codes as a small table."""

    numeric: list[str]
    binary: list[str]
    categorical: list[str]
    fills: dict[str, float] = field(default_factory=dict)
    text_fills: dict[str, str] = field(default_factory=dict)
    codes: DataFrame | None = None

    @property
    def names(self) -> list[str]:
        """Feature names in vector order."""
        return [*self.numeric, *self.binary, *self.categorical]

    @staticmethod
    def fit(df: DataFrame, numeric, binary, categorical=()) -> "Preparation":
        """Columns without any value are left out. Only one value per feature comes to the driver."""
        empty = set(null_only(df, [*numeric, *binary, *categorical]))
        keep = lambda names: [n for n in names if n not in empty]
        out = Preparation(keep(numeric), keep(binary), keep(categorical))
        values = []
        if out.numeric:
            values += median_values(df, out.numeric).collect()
        if out.binary:
            values += frequent_values(df, out.binary).collect()
        out.fills = {r["feature"]: r["value"] for r in values}
        if out.categorical:
            out.text_fills = {r["feature"]: r["value"] for r in frequent_texts(df, out.categorical).collect()}
            filled = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(out.text_fills[c])).alias(c) for c in out.categorical])
            out.codes = category_table(filled, out.categorical)
        return out

    def fill(self, df: DataFrame) -> DataFrame:
        """Impute; the categories become codes, -1 for unseen ones."""
        numbers = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(self.fills[c]))) for c in [*self.numeric, *self.binary]}
        texts = {f"_t_{c}": F.coalesce(F.col(c).cast("string"), F.lit(self.text_fills[c])) for c in self.categorical}
        out = df.withColumns(numbers | texts)
        if self.categorical:
            renamed = self.codes.withColumn("column_name", F.concat(F.lit("_t_"), "column_name"))
            out = encode_categories(out, {f"_t_{c}": f"_c_{c}" for c in self.categorical}, renamed)
            out = out.withColumns({c: F.col(f"_c_{c}").cast("double") for c in self.categorical}).drop(
                *[f"{p}{c}" for p in ("_t_", "_c_") for c in self.categorical])
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        assembler = VectorAssembler(inputCols=self.names, outputCol="features")
        return assembler.transform(self.fill(df))


@dataclass
class OneHot:
    """Text columns as sparse vectors ``<column>_hot``; unseen values and nulls give all zeros.

    The labels stay a table of codes (``category_table``); the driver sees their number only.
    """

    columns: list[str]
    codes: DataFrame
    sizes: dict[str, int]

    @staticmethod
    def fit(df: DataFrame, columns) -> "OneHot":
        columns = list(columns)
        codes = category_table(df.select(*[F.col(c).cast("string").alias(c) for c in columns]), columns)
        sizes = {r[0]: r[1] for r in codes.groupBy("column_name").agg(F.count("*")).collect()}
        return OneHot(columns, codes, {c: sizes.get(c, 0) for c in columns})

    def transform(self, df: DataFrame) -> DataFrame:
        texts = df.withColumns({f"_t_{c}": F.col(c).cast("string") for c in self.columns})
        renamed = self.codes.withColumn("column_name", F.concat(F.lit("_t_"), "column_name"))
        coded = encode_categories(texts, {f"_t_{c}": f"_c_{c}" for c in self.columns}, renamed)
        for c in self.columns:
            # One place more than there are labels: the last is dropped, so it gives zeros.
            place = F.when(F.col(f"_c_{c}") < 0, self.sizes[c]).otherwise(F.col(f"_c_{c}")).cast("double")
            width = {"ml_attr": {"type": "nominal", "num_vals": self.sizes[c] + 1, "name": f"_c_{c}"}}
            coded = coded.withColumn(f"_c_{c}", place.alias(f"_c_{c}", metadata=width))
        hot = OneHotEncoder(inputCols=[f"_c_{c}" for c in self.columns], outputCols=[f"{c}_hot" for c in self.columns], dropLast=True)
        return hot.fit(coded).transform(coded).drop(*[f"{p}{c}" for c in self.columns for p in ("_t_", "_c_")])
