"""What the operators here share: session limits, written intermediate tables, worker-side caches."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path, tune

# White space of the contracts' words, [\x20\x09-\x0D]: just what bytes.split() splits on.
# Lower-casing of A-Z only is what bytes.lower() does.

LIMITS = {
    # Whole texts go to Python in batches of bounded bytes, so that a run of very long ones
    # stays in memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def ready(spark: SparkSession) -> SparkSession:
    for key, value in LIMITS.items():
        spark.conf.set(key, value)
    return tune(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the cluster's shared folder and read back: lineage ends
    here, and a lost executor costs no earlier work."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def only(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, as ``doc_id`` and ``text``; a null text is empty.
    Other columns, whatever their names, are left out and cannot clash."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


class Remembered(dict):
    """key -> compute(key), kept per worker. Emptied when ``limit`` keys are in, and when
    another one fills; long keys are not kept. So its memory is bounded, whatever the texts
    hold and however many operators a worker has served."""

    filling: Remembered | None = None

    def __init__(self, compute: Callable, limit: int = 300_000, longest: int = 48):
        self.compute, self.limit, self.longest = compute, limit, longest

    def __missing__(self, key):
        value = self.compute(key)
        if Remembered.filling is not self:
            if Remembered.filling is not None:
                Remembered.filling.clear()
            Remembered.filling = self
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterable[bytes]:
    """UTF-8 bytes of the column's values, without a copy into str; null as empty."""
    column = batch.column(batch.schema.names.index(name))
    for value in column.cast(pa.large_binary() if column.type == pa.large_string() else pa.binary()):
        yield value.as_py() or b""
