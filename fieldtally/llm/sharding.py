"""Sharding by sampled splitters: near-equal bytes per shard.

Records are ordered by (hash of the text, hash of the id, tie). A size-weighted sample of
that key gives quantile boundaries; records are range-partitioned by them, and ranges that
come out overfull are cut again. The exact bytes before each range and each record then
decide the shard, so the law holds whatever the sample missed. Only keys, sizes and
checksums are shuffled, never texts.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import only, ready, table, written

KEY = ("k", "h", "tie")
SAMPLED = 48  # keys drawn for each range
ROUNDS = 4  # times that overfull ranges are cut again
# A group of equal texts stays whole if it has no more than this share of a shard.
WHOLE = 0.005


def _with_range(keyed: DataFrame, cuts: list[tuple]) -> DataFrame:
    """``range``: the number of cuts at or before the key. Cuts are as many as ranges."""

    def place(batches):
        for batch in batches:
            keys = zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in KEY))
            yield batch.append_column("range", pa.array([bisect_right(cuts, key) for key in keys], pa.int32()))

    return keyed.mapInArrow(place, T.StructType([*keyed.schema.fields, T.StructField("range", T.IntegerType())]))


def _sizes(ranged: DataFrame) -> dict[int, tuple[int, int]]:
    rows = ranged.groupBy("range").agg(F.sum("size"), F.count(F.lit(1))).collect()
    return {r[0]: (r[1], r[2]) for r in rows}


def _sample(rows: DataFrame, rate: float) -> list[tuple]:
    """Keys drawn with a chance of bytes times ``rate``; the number expected is the bytes
    asked for times the rate, set by the number of ranges and not by the data."""
    chance = F.pmod(F.xxhash64("k", "tie", "h"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = rows.where(chance < F.col("size") * F.lit(rate)).select(*KEY).collect()
    return sorted(tuple(r) for r in drawn)


def _split(keyed: DataFrame, total: int, wanted: int) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    target = total / wanted
    cuts = _sample(keyed, SAMPLED / target)[SAMPLED - 1::SAMPLED]
    for _ in range(ROUNDS):
        ranged = _with_range(keyed, cuts)
        sizes = _sizes(ranged)
        over = [r for r, (size, rows) in sizes.items() if size > 1.5 * target and rows > 1]
        if not over:
            break
        # Twice the rate, so that a range just over the limit falls in two or three parts.
        more = _sample(ranged.where(F.col("range").isin(over)), 2 * SAMPLED / target)[SAMPLED - 1::SAMPLED]
        if not set(more) - set(cuts):
            break
        cuts = sorted(set(cuts) | set(more))
    return _with_range(keyed, cuts), _sizes(_with_range(keyed, cuts))


def shard_by_bytes(docs: DataFrame, shards: int = 8, ranges: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1 (a null text has none, and the checksum of no
    bytes). Shards are cut at equal shares of all bytes; a cut inside a small group of
    equal texts moves to the group's nearer end, a large group is cut inside. Null ids,
    repeated rows and ties are placed like any other row; an empty table gives no row;
    with fewer rows than shards some shards stay empty. Other columns are ignored.
    """
    spark = ready(docs.sparkSession)
    src = only(docs, id_col, text_col)
    keyed = written(
        src.select(
            "doc_id", (F.octet_length("text").cast("long") + 1).alias("size"), F.crc32("text").alias("text_crc32"),
            F.xxhash64("text").alias("k"), F.xxhash64(F.col("doc_id").cast("string")).alias("h"), F.monotonically_increasing_id().alias("tie")),
        "shard-keys")
    total, n = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    wanted = ranges or max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged, sizes = _split(keyed, max(1, total), wanted)

    before, rows_before, bytes_so_far, rows_so_far = {}, {}, 0, 0
    for r in sorted(sizes):
        before[r], rows_before[r] = bytes_so_far, rows_so_far
        bytes_so_far, rows_so_far = bytes_so_far + sizes[r][0], rows_so_far + sizes[r][1]
    starts = spark.createDataFrame([(r, before[r], rows_before[r]) for r in before], "range int, bytes_before long, rows_before long")
    order = Window.partitionBy("range").orderBy(*KEY)
    placed = written(
        ranged.withColumn("run", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("at", F.row_number().over(order) - 1)
        # One row per range.
        .join(F.broadcast(starts), "range")
        .select("doc_id", "size", "text_crc32", "k", (F.col("bytes_before") + F.col("run") - F.col("size")).alias("pos"), (F.col("rows_before") + F.col("at")).alias("row")),
        "shard-places")

    cuts = _snapped(placed, [total * s // shards for s in range(1, shards)], WHOLE * total / shards)
    shard = sum((F.when(F.col("pos") >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    placed = placed.withColumn("shard", shard)
    first = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("row").alias("first")).collect()}
    offset = F.coalesce(*[F.when(F.col("shard") == s, F.lit(f)) for s, f in first.items()], F.lit(0)).cast("long")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - offset).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def _snapped(placed: DataFrame, cuts: list[int], whole: float) -> list[int]:
    """Each cut, moved to an end of the group of equal texts that it falls into if that
    group is small. One group per cut at most."""
    if not cuts:
        return []
    inside = F.array(*[F.lit(c) for c in cuts])
    hit = F.exists(inside, lambda c: (c > F.col("pos")) & (c < F.col("pos") + F.col("size")) | (c == F.col("pos")))
    keys = [r[0] for r in placed.where(hit).select("k").distinct().collect()]
    groups = placed.where(F.col("k").isin(keys)).groupBy("k").agg(F.min("pos"), F.max(F.col("pos") + F.col("size"))).collect() if keys else []
    out = []
    for cut in cuts:
        for _, start, end in groups:
            if start < cut < end and end - start <= whole:
                cut = start if cut - start <= end - cut else end
        out.append(cut)
    return out


def op5_sampled_splitters(spark: SparkSession, folder: str) -> DataFrame:
    return shard_by_bytes(table(spark, folder, "documents"))
