"""Query registration and the table handle the queries work on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import tune
from ..sources.layers import source_version
from . import standins

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy handles: driver tables by name, stand-in tables by role."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._seen: dict[str, DataFrame] = {}
        self._versions: dict[tuple, str] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._seen:
            self._seen[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._seen[name]

    def version(self, *names: str) -> str:
        """The state of the files of some driver tables, listed once per handle."""
        if names not in self._versions:
            self._versions[names] = source_version(self.spark, [f"{self.folder}/{n}.parquet" for n in names])
        return self._versions[names]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in standins.STANDINS:
            return standins.spark_table(self, name)
        return self.raw(name)


def query(name: str, sql: str | None = None, uses: str = ""):
    """Register a query; ``uses`` names the stand-in CTEs its SQL needs."""

    def add(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(tune(spark), folder))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise KeyError(name)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = standins.with_ctes(uses.split(), sql)
        return fn

    return add
