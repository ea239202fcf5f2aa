"""Table scans and sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import DATE_COLUMNS, SOURCE_TABLES
from ..functions.dates import parse_timestamp
from ..functions.text import trim_strings
from ..operators.latest import latest_rows


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet by extension or without one, CSV with a header for ``.csv``."""
    if path.rstrip("/").lower().endswith(".csv"):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema is not None else reader).csv(path)
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """Overwrite a Parquet or CSV folder, by extension."""
    writer = df.write.mode("overwrite")
    if path.rstrip("/").lower().endswith(".csv"):
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def parse_dates(df: DataFrame, table: str) -> DataFrame:
    """Known date columns as timestamps; bad values become null."""
    dates = set(DATE_COLUMNS.get(table, ()))
    return df.select(*[parse_timestamp(F.col(c)).alias(c) if c in dates else F.col(c) for c in df.columns])


def csv_scan(spark: SparkSession, path: str, table: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One source CSV: trimmed text, parsed dates, and the table's name on every row.

    Without a schema the header gives the names and every column is read as text, so
    the data is not scanned twice to guess types.
    """
    df = parse_dates(trim_strings(read_table(spark, path, schema)), table)
    return df.withColumn("_source_table", F.lit(table))


def load_all(spark: SparkSession, folder: str, tables=SOURCE_TABLES, schemas: dict | None = None) -> tuple[dict[str, DataFrame], list[str]]:
    """All source tables of a folder as lazy scans, and the names of those not there."""
    found: dict[str, DataFrame] = {}
    missing: list[str] = []
    for name in tables:
        try:
            found[name] = csv_scan(spark, f"{folder.rstrip('/')}/{name}.csv", name, (schemas or {}).get(name))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e.getCondition()):
                raise
            missing.append(name)
    return found, missing


def latest_per_month(df: DataFrame, tiebreak, keys=("patient_id", "reportedm")) -> DataFrame:
    """Source-side dedup of visit tables; a null date counts as the newest."""
    return latest_rows(df, list(keys), "reported", tiebreak, nulls_first=True)


def latest_registry(df: DataFrame, tiebreak) -> DataFrame:
    """Newest registry row per area with the columns in use; a null date counts as the newest."""
    columns = ["chw_area_uuid", "community_unit", "county_name", "sub_county_name", "reported", "chw_phone"]
    extra = [t for t in tiebreak if t not in columns]
    return latest_rows(df.select(*columns, *extra), ["chw_area_uuid"], "reported", tiebreak, nulls_first=True).select(*columns)


def extract(spark_tables: dict[str, DataFrame], names, folder: str, allowed=SOURCE_TABLES) -> list[str]:
    """Copy allow-listed tables to a raw layer; a rerun overwrites. Returns the paths."""
    unknown = [n for n in names if n not in allowed]
    if unknown:
        raise ValueError(f"Tables not on the allow list: {unknown}")
    paths = []
    for n in names:
        path = f"{folder.rstrip('/')}/{n}.parquet"
        write_table(spark_tables[n], path)
        paths.append(path)
    return paths


def snapshot(df: DataFrame, path: str) -> int:
    """Write a table and return its row count, observed while writing."""
    seen = Observation("rows")
    write_table(df.observe(seen, F.count(F.lit(1)).alias("n")), path)
    return seen.get["n"]


def flat_text(df: DataFrame) -> DataFrame:
    """Lists as ``;``-joined text, as CSV has no nested values."""
    def col(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.ArrayType):
            return F.array_join(F.transform(F.col(f.name), lambda x: x.cast("string")), ";").alias(f.name)
        return F.col(f.name)
    return df.select(*[col(f) for f in df.schema.fields])


def export_csv(df: DataFrame, path: str) -> None:
    """CSV export of a list; written in parts, order kept within and across them."""
    flat_text(df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Metrics or explanations as JSON lines."""
    df.write.mode("overwrite").json(path)


def layer(df: DataFrame, path: str) -> DataFrame:
    """Write a layer and go on from the written table: later plans read it instead of redoing it."""
    write_table(df, path)
    return read_table(df.sparkSession, path)
