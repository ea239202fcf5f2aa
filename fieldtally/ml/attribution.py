"""Per-row attributions of boosted trees, as a whole-table job.

A saved tree model is small (settings bound it, not the data); its leaves are sent to
the tasks once. Each task works through its own rows in Arrow batches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial, prod

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.risk import driver_direction, friendly_name, plain_english, recommended_action
from ..operators.ranking import top_drivers


@dataclass
class Leaf:
    """One leaf: its weighted value and, per feature on the way to it, the interval that leads there and the share of rows that take it."""

    value: float
    features: np.ndarray
    low: np.ndarray  # exclusive
    high: np.ndarray  # inclusive
    share: np.ndarray


def read_leaves(spark: SparkSession, folder: str) -> list[Leaf]:
    """All leaves of a saved boosted-tree model."""
    weighted = spark.read.parquet(f"{folder}/treesMetadata").toDF("treeID", "metadata", "weight")
    weights = {r["treeID"]: r["weight"] for r in weighted.select("treeID", "weight").collect()}
    nodes: dict[int, dict[int, object]] = {}
    for r in spark.read.parquet(f"{folder}/data").select("treeID", "nodeData").collect():
        nodes.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"]
    leaves: list[Leaf] = []
    for tree, by_id in nodes.items():
        todo = [(0, {})]
        while todo:
            at, path = todo.pop()
            node = by_id[at]
            if node["leftChild"] < 0:
                f = sorted(path)
                leaves.append(Leaf(weights[tree] * node["prediction"], np.array(f, dtype=int), *[
                    np.array([path[i][k] for i in f], dtype=float) for k in range(3)]))
                continue
            split = node["split"]
            feature, cut = split["featureIndex"], split["leftCategoriesOrThreshold"][0]
            low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
            for child, bounds in ((node["leftChild"], (low, min(high, cut))), (node["rightChild"], (max(low, cut), high))):
                part = by_id[child]["rawCount"] / max(node["rawCount"], 1)
                todo.append((child, path | {feature: (*bounds, share * part)}))
    return leaves


def expected_margin(leaves: list[Leaf]) -> float:
    """The margin when no feature is known."""
    return float(sum(leaf.value * np.prod(leaf.share) for leaf in leaves))


ROWS, LEAVES = 64, 4096  # worked on at a time, which bounds memory
TABLED_ROWS = 256  # the same, where effects are looked up
TABLE_VALUES = 8_000_000  # effects of leaves of one length that are tabled at most
CELLS = 4096  # cells of a row's values that leaves tabled together may part


@dataclass
class Tabled:
    """Leaves of one length with their effects for every way a row can meet their intervals.

    ``effects[i]`` has, for leaf l and pattern p (bit j: inside the j-th interval), the
    effect of the leaf's i-th feature at l * 2^m + p. ``to[i]`` carries it to the feature.
    """

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    effects: list[np.ndarray]
    to: list[np.ndarray]

    def add_to(self, out: np.ndarray, x: np.ndarray) -> None:
        n, m = self.features.shape
        place = np.broadcast_to(np.arange(n, dtype=np.int32) << m, (len(x), n)).copy()
        for j in range(m):
            v = x[:, self.features[:, j]]
            place += ((v > self.low[:, j]) & (v <= self.high[:, j])).astype(np.int32) << j
        for effect, to in zip(self.effects, self.to):
            out += np.take(effect, place) @ to


def leaves_by_length(leaves: list[Leaf]) -> list[tuple[np.ndarray, ...]]:
    """Leaves with as many features each as arrays: value (n), features, low, high, share (n x m)."""
    groups: dict[int, list[Leaf]] = {}
    for leaf in leaves:
        groups.setdefault(len(leaf.features), []).append(leaf)
    return [(np.array([x.value for x in g]), *(np.stack([getattr(x, k) for x in g]) for k in ("features", "low", "high", "share")))
            for m, g in sorted(groups.items()) if m]


def tabled_leaves(leaves: list[Leaf], width: int) -> list[Tabled | tuple[np.ndarray, ...]]:
    """``leaves_by_length``, with tables of effects where they are small. Leaves of very many
    features stay as they are. ``width`` is the number of features of a row."""
    out: list[Tabled | tuple[np.ndarray, ...]] = []
    for group in leaves_by_length(leaves):
        n, m = group[1].shape
        if (n * m) << m > TABLE_VALUES:
            out.append(group)
            continue
        bits = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)
        for b in range(0, n, LEAVES):
            value, features, low, high, share = (g[b:b + LEAVES] for g in group)
            inside = np.broadcast_to(bits[:, None, :], (1 << m, len(value), m))
            effects = [np.ascontiguousarray(_effect(inside, value, share, i).T).ravel() for i in range(m)]
            out.append(Tabled(features, low, high, effects, [np.eye(width)[features[:, i]] for i in range(m)]))
    return out


@dataclass
class Celled:
    """Attributions of a group of leaves for every cell that their cuts part the features' values into.

    A table has a row per cell, with the group's attribution to the features. A row's cell
    is the sum of the strides of the cuts that it lies beyond; ``features``, ``cuts`` and
    ``strides`` (cut by group) are those of all groups.
    """

    features: np.ndarray
    cuts: np.ndarray
    strides: np.ndarray
    tables: list[np.ndarray]

    def add_to(self, out: np.ndarray, x: np.ndarray) -> None:
        beyond = ~(x[:, self.features] <= self.cuts)  # as the trees decide, also for NaN
        place = (beyond.astype(np.float32) @ self.strides).astype(np.intp)  # whole numbers below CELLS
        for i, table in enumerate(self.tables):
            out[:, :table.shape[1]] += table[place[:, i]]


def leaf_cuts(leaf: Leaf) -> set[tuple[int, float]]:
    """(feature, cut) of the ends of a leaf's intervals."""
    return {(int(f), float(v)) for f, low, high in zip(leaf.features, leaf.low, leaf.high) for v in (low, high) if np.isfinite(v)}


def cell_groups(leaves: list[Leaf]) -> list[tuple[list[Leaf], dict[int, list[float]]]]:
    """Runs of leaves whose cuts part the values into at most ``CELLS`` cells, with the cuts by feature.
    Leaves come tree by tree, so neighbours share most of their cuts. One leaf alone may have more."""
    out: list[tuple[list[Leaf], set]] = []
    for leaf in leaves:
        cuts = leaf_cuts(leaf)
        if out and _cells(out[-1][1] | cuts) <= CELLS:
            out[-1][0].append(leaf)
            out[-1][1].update(cuts)
        else:
            out.append(([leaf], set(cuts)))
    return [(group, {f: sorted(v for g, v in cuts if g == f) for f in sorted({f for f, _ in cuts})}) for group, cuts in out]


def _cells(cuts: set[tuple[int, float]]) -> int:
    return prod(n + 1 for n in Counter(f for f, _ in cuts).values())


def celled_leaves(leaves: list[Leaf]) -> list[Celled]:
    """The leaves' attributions tabled by cells; none where the tables would be large."""
    leaves = [leaf for leaf in leaves if len(leaf.features)]
    width = 1 + max((int(leaf.features.max()) for leaf in leaves), default=0)
    groups = cell_groups(leaves)
    sizes = [prod(len(v) + 1 for v in cuts.values()) for _, cuts in groups]
    if not groups or max(sizes) > CELLS or sum(sizes) * width > TABLE_VALUES:
        return []
    known = sorted({(f, v) for _, cuts in groups for f, values in cuts.items() for v in values})
    at = {cut: i for i, cut in enumerate(known)}
    strides = np.zeros((len(known), len(groups)), dtype=np.float32)
    tables = []
    for i, ((group, cuts), size) in enumerate(zip(groups, sizes)):
        inside, stride = np.zeros((size, width)), 1
        for f, values in cuts.items():
            strides[[at[f, v] for v in values], i] = stride
            # A cell is right-closed: its cut stands for it, and the last one has no end.
            inside[:, f] = np.array([*values, np.inf])[np.arange(size) // stride % (len(values) + 1)]
            stride *= len(values) + 1
        tables.append(attribute(inside, tabled_leaves(group, width)))
    return [Celled(np.array([f for f, _ in known]), np.array([v for _, v in known]), strides, tables)]


def attribute(x: np.ndarray, leaves: list) -> np.ndarray:
    """Shapley values of the path-dependent game, row by feature; of leaves, ``tabled_leaves`` or ``celled_leaves``.

    For a leaf with m features, knowing a set S of them is worth value × Π_S inside × Π_rest share.
    The sum over all sets of one size is a coefficient of Π (share + inside·t), formed for
    all leaves of one length at once. A row meets a leaf in one of 2^m ways only, so the
    effects are formed once per leaf and way, and looked up for the rows.
    """
    groups = tabled_leaves(leaves, x.shape[1]) if leaves and isinstance(leaves[0], Leaf) else leaves
    out = np.zeros_like(x, dtype=float)
    for group in groups:
        if isinstance(group, (Tabled, Celled)):
            for a in range(0, len(x), TABLED_ROWS):
                group.add_to(out[a:a + TABLED_ROWS], x[a:a + TABLED_ROWS])
            continue
        for a in range(0, len(x), ROWS):
            for b in range(0, len(group[0]), LEAVES):
                out[a:a + ROWS] += _block(x[a:a + ROWS], *(g[b:b + LEAVES] for g in group))
    return out


def _effect(inside: np.ndarray, value: np.ndarray, share: np.ndarray, i: int) -> np.ndarray:
    """Effect of the i-th feature of every leaf, for rows or patterns x leaves."""
    m = share.shape[1]
    size_weight = np.array([factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)])
    poly = np.zeros((*inside.shape[:2], m))
    poly[..., 0] = 1.0
    for j in range(m):
        if j != i:
            moved = poly * share[:, j, None]
            moved[..., 1:] += poly[..., :-1] * inside[..., j, None]
            poly = moved
    return value * (inside[..., i] - share[:, i]) * (poly @ size_weight)


def _block(x: np.ndarray, value: np.ndarray, features: np.ndarray, low: np.ndarray, high: np.ndarray, share: np.ndarray) -> np.ndarray:
    m = features.shape[1]
    cols = x[:, features]  # rows x leaves x m
    inside = ((cols > low) & (cols <= high)).astype(float)
    out = np.zeros_like(x, dtype=float)
    for i in range(m):
        effect = _effect(inside, value, share, i)
        to = np.zeros((len(value), x.shape[1]))
        to[np.arange(len(value)), features[:, i]] = 1.0
        out += effect @ to
    return out


def attributions(df: DataFrame, leaves: list[Leaf], features: str = "features") -> DataFrame:
    """Add ``feature_values``, ``shap_values`` and ``base_value`` to every row with a feature vector."""
    sent = df.sparkSession.sparkContext.broadcast(celled_leaves(leaves) or leaves)
    base = expected_margin(leaves)
    plain = df.withColumn("feature_values", vector_to_array(F.col(features))).drop(features)
    schema = T.StructType(plain.schema.fields + [T.StructField("shap_values", T.ArrayType(T.DoubleType()))])
    at = plain.columns.index("feature_values")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = None
        for b in batches:
            flat = b.column(at).flatten().to_numpy(zero_copy_only=False)
            width = len(flat) // max(b.num_rows, 1)
            x = flat.reshape(b.num_rows, width)
            if groups is None and b.num_rows:
                groups = tabled_leaves(sent.value, width) if sent.value and isinstance(sent.value[0], Leaf) else sent.value
            found = attribute(x, groups or [])
            ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * width)
            lists = pa.ListArray.from_arrays(ends, pa.array(found.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=schema.names)

    return plain.mapInArrow(work, schema).withColumn("base_value", F.lit(base))


def mean_absolute(df: DataFrame, names, effects: str = "shap_values") -> DataFrame:
    """Mean absolute attribution per feature; one fixed-width aggregate, then one row per feature."""
    row = df.agg(*[F.avg(F.abs(F.col(effects)[i])).alias(f"a{i}") for i in range(len(names))])
    return row.select(F.inline(F.array(*[F.struct(
        F.lit(n).alias("feature"), friendly_name(F.lit(n)).alias("friendly_name"), F.col(f"a{i}").alias("mean_shap"))
        for i, n in enumerate(names)])))


def top_positive(importance: DataFrame, n: int = 20) -> DataFrame:
    return importance.filter("mean_shap > 0").orderBy(F.col("mean_shap").desc(), "feature").limit(n)


def driver_struct(d: Column) -> Column:
    """A top driver as the payload's record."""
    return F.struct(
        d["feature"].alias("feature"), friendly_name(d["feature"]).alias("friendly_name"),
        F.round(d["feature_value"], 4).alias("feature_value"), F.round(d["shap_value"], 4).alias("shap_value"),
        driver_direction(d["shap_value"]).alias("direction"),
        plain_english(d["feature"], d["feature_value"], d["shap_value"]).alias("plain_english"))


def payload(df: DataFrame, names, keys, version: str, n: int = 3) -> DataFrame:
    """One explanation record per scored and attributed row. Every row has as many drivers, so their records are listed."""
    top = df.withColumn("_top", top_drivers("shap_values", "feature_values", names, n))
    records = F.array(*[driver_struct(F.col("_top")[i]) for i in range(min(n, len(names)))])
    return top.select(
        *keys, F.round("risk_score", 4).alias("risk_score"), F.round(F.col("risk_score") * 100, 1).alias("risk_pct"), "risk_tier",
        F.when(F.col("_top").isNotNull(), records).alias("top_drivers"),
        recommended_action(F.col("risk_tier"), F.element_at("_top", 1)["feature"]).alias("recommended_action"),
        F.lit(version).alias("model_version"))


def dependence(df: DataFrame, names, wanted, keys) -> DataFrame:
    """(feature, value, attribution, score) rows of the wanted features."""
    items = [F.struct(F.lit(n).alias("feature"), F.col("feature_values")[names.index(n)].alias("feature_value"),
                      F.col("shap_values")[names.index(n)].alias("shap_value")) for n in wanted]
    return df.select(*keys, "risk_score", F.inline(F.array(*items)))


def feature_importance(model, names, n: int = 20) -> DataFrame:
    """Importance per feature, largest first; the fitted vector is one number per feature."""
    spark = SparkSession.active()
    rows = [(name, float(v)) for name, v in zip(names, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature").limit(n)
