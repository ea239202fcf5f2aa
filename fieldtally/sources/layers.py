"""Layers that belong to a version of what they are made from.

A version is drawn from the names, sizes and times of the source files. A layer is written
to a path of its own and then published by a line of the manifest, so a half-written one is
never read; a rewritten source has another version and gets a new layer. Data of versions
beyond the newest few is emptied, for each name by itself: name a layer by its source's
place too, so that layers of different places do not put each other out.
"""

from __future__ import annotations

import functools
import hashlib
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path, shared_folder

MANIFEST = "version string, path string, published double, gone boolean"


def source_version(spark: SparkSession, paths) -> str:
    """A text that changes when any file below ``paths`` is added, removed or rewritten.
    Spark lists the files; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    row = files.agg(F.count("*"), F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)"))).first()
    return f"{row[0]}-{int(row[1] or 0) % (1 << 64):016x}"


@functools.lru_cache(maxsize=1)
def code_version() -> str:
    """A text that changes with this package's code: layers of other code are not reused."""
    package = Path(__file__).resolve().parents[1]
    files = [p for part in ("catalog", "functions", "ml", "operators", "plans", "sources") for p in sorted((package / part).glob("*.py"))]
    return hashlib.sha1(b"".join(p.read_bytes() for p in files)).hexdigest()[:16]


def _manifest(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/fieldtally/manifests/{name}"


def published(spark: SparkSession, name: str) -> list:
    """(version, path) of the layers to be had, oldest first."""
    try:
        rows = spark.read.schema(MANIFEST).json(_manifest(spark, name)).collect()  # a line per publication
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return []
    gone = {r.path for r in rows if r.gone}
    return [(r.version, r.path) for r in sorted(rows, key=lambda r: r.published) if r.path not in gone]


def _add(spark: SparkSession, name: str, version: str, path: str, gone: bool) -> None:
    spark.createDataFrame([(version, path, time.time(), gone)], MANIFEST).coalesce(1).write.mode("append").json(_manifest(spark, name))


def versioned(spark: SparkSession, name: str, version: str, write: Callable[[str], None], keep: int = 2) -> str:
    """The path of the layer of this version; ``write`` makes it where there is none."""
    known = published(spark, name)
    found = [path for v, path in known if v == version]
    if found:
        return found[-1]
    path = fresh_path(spark, name)
    write(path)
    _add(spark, name, version, path, False)
    for v, old in known[:max(0, len(known) - keep + 1)]:
        _add(spark, name, v, old, True)
        spark.createDataFrame([], "gone int").write.mode("overwrite").parquet(old)
    return path
