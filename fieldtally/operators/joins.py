"""Left joins of small per-key tables to event tables, and reports about them.

No side is broadcast by hint: the right sides grow with the number of areas or
workers, so Spark broadcasts them only while they are under its size limit and
splits skewed keys (AQE) beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join(left: DataFrame, right: DataFrame, left_keys, right_keys=None, null_safe: bool = False) -> DataFrame:
    """Left join that keeps the left key columns only. Null never meets null unless asked."""
    left_keys = [left_keys] if isinstance(left_keys, str) else list(left_keys)
    right_keys = left_keys if right_keys is None else ([right_keys] if isinstance(right_keys, str) else list(right_keys))
    renamed = right.select(
        *[F.col(r).alias(f"_k_{i}") for i, r in enumerate(right_keys)],
        *[c for c in right.columns if c not in right_keys],
    )
    test = None
    for i, name in enumerate(left_keys):
        pair = F.col(name).eqNullSafe(F.col(f"_k_{i}")) if null_safe else F.col(name) == F.col(f"_k_{i}")
        test = pair if test is None else test & pair
    return left.join(renamed, test, "left").drop(*[f"_k_{i}" for i in range(len(left_keys))])


def full_join(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Full outer join on shared key names."""
    return a.join(b, list(keys), "full_outer")


def add_absent(df: DataFrame, names, kind: str = "double") -> DataFrame:
    """Null columns for the names that the table does not have."""
    return df.select("*", *[F.lit(None).cast(kind).alias(n) for n in names if n not in df.columns])


def match_report(df: DataFrame, probes: dict[str, str]) -> DataFrame:
    """Matched rows and share for several joins in one pass; ``probes`` maps join to a right column."""
    row = df.agg(F.count("*").alias("n"), *[F.count(c).alias(f"m_{j}") for j, c in probes.items()])
    items = [F.struct(F.lit(j).alias("join_name"), F.col(f"m_{j}").alias("matched"), F.col("n").alias("total"),
                      F.try_divide(F.col(f"m_{j}").cast("double"), F.col("n")).alias("match_rate")) for j in probes]
    return row.select(F.inline(F.array(*items)))


def agreement(df: DataFrame, a: str, b: str, warn_below: float = 0.70) -> DataFrame:
    """How often two labels agree where the second is known."""
    return df.filter(F.col(b).isNotNull()).agg(
        F.count("*").alias("matched"),
        F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement"),
    ).withColumn("low_agreement", F.coalesce((F.col("agreement") < warn_below).cast("int"), F.lit(0)))


def union_common(*tables: DataFrame) -> DataFrame:
    """Union all of the columns that every table has, in the first table's order."""
    shared = [c for c in tables[0].columns if all(c in t.columns for t in tables)]
    out = tables[0].select(*shared)
    for t in tables[1:]:
        out = out.unionByName(t.select(*shared))
    return out
