"""Whitening of embeddings by mixed-precision refinement of the covariance's eigenvectors.

Exact integer sums and the centred covariance are added up over the tasks; only matrices of
the vectors' dimension reach the driver. There float32 eigenvectors are corrected by
Ogita-Aishima iterations, products of matrices in extended precision. Eigenvalues that an
iteration cannot tell apart are solved within their cluster first.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ready, table, written

SCALE, SHIFT = 1024, 100_000
LARGEST = 2.0 ** 43  # from here on an entry in fixed point is not exact
LOW_BITS = 26
FLUSH = 1 << 20  # sums held by a task before it passes them on
HIGH = np.longdouble


def fixed_point(batch: pa.RecordBatch, size: int | None = None):
    """(rows, x) for each length of vectors in the batch, or for the given one: the rows of
    vectors whose entries are all finite, and those in fixed point."""
    column = batch.column(batch.num_columns - 1)
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column)
    values = pc.fill_null(flat.cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(np.maximum(lengths, 0))))[:-1]
    for length in np.unique(lengths) if size is None else [size]:
        rows = np.flatnonzero(lengths == length)
        if length <= 0 or not len(rows):
            continue
        entries = values[starts[rows, None] + np.arange(length)]
        good = (np.abs(entries) < LARGEST).all(axis=1)
        yield rows[good], np.floor(entries[good] * SCALE).astype(np.int64) + SHIFT


def _sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Rows and exact sums per dimension, of the most frequent length of vectors (the
    longer of two). A sum travels as two halves, so that none overflows."""

    def add(batches):
        held: dict[int, list] = {}

        def out():
            for length, (n, high, low) in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(length, length), pa.int32()), pa.array(np.arange(length), pa.int32()), pa.array(np.full(length, n), pa.int64()),
                     pa.array(high), pa.array(low)], ["size", "j", "n", "high", "low"])
            held.clear()

        for batch in batches:
            for rows, x in fixed_point(batch):
                if len(rows):
                    n, high, low = held.get(x.shape[1], (0, 0, 0))
                    held[x.shape[1]] = [n + len(rows), high + (x >> LOW_BITS).sum(axis=0), low + (x & (1 << LOW_BITS) - 1).sum(axis=0)]
            if sum(held) > FLUSH:
                yield from out()
        yield from out()

    # The sums' halves are added as decimals: a long may not hold them over very many rows.
    parts = vectors.mapInArrow(add, "size int, j int, n long, high long, low long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    sums = written(parts.groupBy("size", "j").agg(F.sum("n").alias("n"), wide("high"), wide("low")), "whitening-sums")
    best = sums.where("j = 0").orderBy(F.col("n").desc(), F.col("size").desc()).select("size").first()
    if best is None:
        return 0, []
    rows = sorted(sums.where(F.col("size") == best[0]).collect(), key=lambda r: r.j)  # one row per dimension
    return rows[0].n, [(int(r.high) << LOW_BITS) + int(r.low) for r in rows]


def _centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The means as whole numbers and what they leave, so that differences are exact."""
    whole = [s // n for s in sums]
    return np.array(whole, np.int64), np.array([(s - n * w) / n for s, w in zip(sums, whole)])


def _covariance(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    size, (whole, rest) = len(sums), _centre(n, sums)
    upper = np.triu_indices(size)

    def multiply(batches):
        total = np.zeros((size, size))
        for batch in batches:
            for _, x in fixed_point(batch, size):
                y = (x - whole).astype(np.float64) - rest
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(total[upper])], ["i", "j", "v"])

    # size * (size + 1) / 2 numbers, whatever the rows.
    parts = vectors.mapInArrow(multiply, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((size, size))
    for r in parts:
        out[r.i, r.j] = out[r.j, r.i] = r.v / n
    return out


def _clusters(values: np.ndarray, width) -> list[np.ndarray]:
    """Groups of two or more eigenvalues, neighbours in a group no more than ``width`` apart."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > width) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def _frobenius(a: np.ndarray):
    return np.sqrt((a * a).sum())


def _orthonormal(turn: np.ndarray) -> np.ndarray:
    """A nearly orthonormal matrix made so: each step squares what is left."""
    for _ in range(3):
        turn = turn + turn @ (np.eye(len(turn), dtype=HIGH) - turn.T @ turn) / 2
    return turn


def eigenpairs(matrix: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix.

    Starts from float32 vectors. A round squares the error of what it can tell apart:
    E = (S + value_j R) / (value_j - value_i), R = I - X'X, S = X'AX. Pairs closer than
    the error bound are only made orthonormal, and their cluster is solved by itself: the
    small matrix of the cluster, less its mean, is of the size of the cluster's gaps, so
    float32 resolves it again.
    """
    size = len(matrix)
    scale = np.abs(matrix).max(initial=0)
    if not scale:
        return np.zeros(size), np.eye(size)
    a = matrix.astype(HIGH) / HIGH(scale)
    x = np.linalg.eigh((matrix / scale).astype(np.float32))[1].astype(HIGH)
    identity, norm = np.eye(size, dtype=HIGH), _frobenius(a)
    values = np.zeros(size, HIGH)
    for _ in range(rounds):
        r = identity - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        # Gaps below a double's precision are none in the matrix as given.
        width = max(2 * (_frobenius(s - np.diag(values)) + norm * _frobenius(r)), HIGH(np.finfo(np.float64).eps))
        apart = values[None, :] - values[:, None]
        told = np.abs(apart) > width
        e = np.where(told, (s + values[None, :] * r) / np.where(told, apart, 1), r / 2)
        x = x + x @ e
        turned = False
        for group in _clusters(values, width):
            part = x[:, group]
            inner = part.T @ (a @ part)
            inner = inner - identity[:len(group), :len(group)] * (np.trace(inner) / len(group))
            most = np.abs(inner).max()
            # Equal values: any basis is right.
            if most > np.finfo(np.float64).eps:
                x[:, group] = part @ _orthonormal(np.linalg.eigh((inner / most).astype(np.float32))[1].astype(HIGH))
                turned = True
        # What is left is beyond a double, or is the products' own rounding over the gap.
        floor = 16 * size * np.finfo(HIGH).eps * norm / np.where(told, np.abs(apart), 1)
        if not turned and (np.abs(e) < np.maximum(floor, np.finfo(np.float64).eps / 8)).all():
            break
    order = np.argsort(-values, kind="stable")
    return (values[order] * HIGH(scale)).astype(np.float64), _orthonormal(x[:, order]).astype(np.float64)


def _deviations(x: np.ndarray, n: int, whole: np.ndarray, rest: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; null where a long cannot hold it."""
    off = x - whole
    widest = max(n * int(np.abs(off).max(initial=0)), 1) + n
    if widest * widest * x.shape[1] < 2 ** 63:
        d = off * n - np.array(rest, np.int64)
        return (d * d).sum(axis=1).tolist()
    exact = [sum((n * v - r) ** 2 for v, r in zip(row, rest)) for row in off.tolist()]
    return [v if v < 2 ** 63 else None for v in exact]


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector that remains: vec_id, n, deviation, whitened, explained (arrays by
    component, at most ``components``), identity_error.

    Null vectors and those with a null or non-finite entry are dropped, as are entries of
    2^43 or more (not exact in fixed point) and vectors of another length than the most
    frequent one. Null ids, repeated rows and ties are whitened like other rows; other
    columns are ignored; an empty table gives no row. Components whose eigenvalue is zero
    to rounding have no direction and are left out, so fewer than ``components`` come from
    few or flat vectors, and arrays are empty if all vectors are equal. ``deviation`` is
    null where it is beyond a long.
    """
    spark = ready(vectors.sparkSession)
    kind = vectors.schema[vec_col].dataType
    vec = vectors[vec_col] if getattr(kind, "elementType", None) in (T.FloatType(), T.DoubleType()) else vectors[vec_col].cast("array<double>")
    src = vectors.select(vectors[id_col].alias("vec_id"), vec.alias("vec"))
    id_kind = src.schema["vec_id"].dataType.simpleString()
    n, sums = _sums(src.select("vec"))
    if not n:
        return spark.createDataFrame([], f"vec_id {id_kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    size, (whole, fraction) = len(sums), _centre(n, sums)
    rest = [s - n * int(w) for s, w in zip(sums, whole)]
    covariance = _covariance(src.select("vec"), n, sums)
    values, directions = eigenpairs(covariance)
    kept = [k for k in range(min(components, size)) if values[k] > size * np.finfo(np.float64).eps * max(values[0], 0)]
    project = directions[:, kept] / np.sqrt(values[kept])

    def white(batches):
        for batch in batches:
            for rows, x in fixed_point(batch, size):
                out = ((x - whole).astype(np.float64) - fraction) @ project
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(kept), pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(_deviations(x, n, whole, rest), pa.int64()), lists], ["vec_id", "deviation", "whitened"])

    done = written(src.mapInArrow(white, f"vec_id {id_kind}, deviation long, whitened array<double>"), "whitened")
    # covar_pop centres as it goes; one pass over the pairs of components.
    pairs = [(i, j) for i in range(len(kept)) for j in range(i, len(kept))]
    got = done.agg(F.lit(0), *[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]) for i, j in pairs]).first()[1:]
    error = max((abs(v - (i == j)) for v, (i, j) in zip(got, pairs)), default=0.0)
    explained = F.array(*[F.lit(float(values[k] / np.trace(covariance))) for k in kept]).cast("array<double>")
    return done.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(float(error)).alias("identity_error"))


def op12_refined_whitening(spark: SparkSession, folder: str) -> DataFrame:
    done = whiten(table(spark, folder, "embeddings"))
    each = done.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.col("explained")[F.col("at")].alias("explained"), "identity_error")
