"""Small dense matrices: eigenvalues, positive definiteness and repairs of K x K covariances.

A matrix is long rows (factor_i, factor_j, value). Each frame function solves one matrix per group in a
task; K is the number of factors, not of rows of any panel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fathom.errors import DimensionMismatch

FLOOR = 1e-10


def dense(rows: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    """Factor names, sorted, and the matrix."""
    wide = rows.pivot(index="factor_i", columns="factor_j", values="value").sort_index().sort_index(axis=1)
    if list(wide.index) != list(wide.columns) or wide.isna().any().any():
        raise DimensionMismatch("the matrix is not square or lacks entries")
    return list(wide.index), wide.to_numpy()


def long(names: list[str], m: np.ndarray) -> pd.DataFrame:
    k = len(names)
    return pd.DataFrame({"factor_i": np.repeat(names, k), "factor_j": np.tile(names, k), "value": m.ravel()})


def square(m: np.ndarray) -> np.ndarray:
    m = np.asarray(m, float)
    if m.ndim != 2 or m.shape[0] != m.shape[1]:
        raise DimensionMismatch(f"{m.shape} is not square")
    return m


def eigen(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and their vectors as columns."""
    value, vector = np.linalg.eigh((square(m) + np.transpose(m)) / 2)
    return value[::-1], vector[:, ::-1]


def rebuild(value: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return (vector * value) @ vector.T


def is_positive_definite(m: np.ndarray, tolerance: float = FLOOR) -> bool:
    m = square(m)
    return bool((np.diag(m) > 0).all() and (eigen(m)[0] > tolerance).all())


def enforce_positive_definite(m: np.ndarray, floor: float = FLOOR, keep_trace: bool = True) -> np.ndarray:
    """m with eigenvalues below the floor raised to it; keep_trace then scales to the trace m had."""
    value, vector = eigen(m)
    clipped = np.maximum(value, floor)
    if keep_trace and clipped.sum() > 0 and value.sum() > 0:
        clipped = clipped * value.sum() / clipped.sum()
    return rebuild(clipped, vector)


def condition_number(m: np.ndarray) -> float:
    """Largest over smallest eigenvalue, signed; infinite if the smallest is about 0."""
    value = eigen(m)[0]
    return float("inf") if abs(value[-1]) < 1e-15 else float(value[0] / value[-1])


def nearest_positive_definite(m: np.ndarray, iterations: int = 100, tolerance: float = 1e-8) -> np.ndarray:
    """The nearest matrix with eigenvalues of FLOOR at least, by alternating projections with Dykstra's correction (Higham 2002)."""
    y = (square(m) + np.transpose(m)) / 2
    correction = np.zeros_like(y)
    for _ in range(iterations):
        shifted = y - correction
        value, vector = eigen(shifted)
        cone = rebuild(np.maximum(value, FLOOR), vector)
        correction = cone - shifted
        before, y = y, (cone + cone.T) / 2
        np.fill_diagonal(y, np.maximum(np.diag(y), FLOOR))
        if np.linalg.norm(y - before) < tolerance:
            break
    return y


def _solved(cov: DataFrame, by: str | None, schema: str, solve) -> DataFrame:  # noqa: ANN001
    key = by or "_all"
    df = cov if by else cov.withColumn(key, F.lit(0))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = solve(*dense(rows))
        out.insert(0, key, rows[key].iloc[0])
        return out

    kind = dict(df.dtypes)[key]
    out = df.groupBy(key).applyInPandas(run, f"{key} {kind}, {schema}")
    return out if by else out.drop(key)


def eigen_frame(cov: DataFrame, by: str | None = None) -> DataFrame:
    """rank (from 1), eigenvalue, vector of each matrix."""

    def solve(names: list[str], m: np.ndarray) -> pd.DataFrame:
        value, vector = eigen(m)
        return pd.DataFrame({"rank": np.arange(1, len(value) + 1), "eigenvalue": value, "vector": list(vector.T)})

    return _solved(cov, by, "rank int, eigenvalue double, vector array<double>", solve)


def repair_frame(cov: DataFrame, by: str | None = None, method: str = "clip") -> DataFrame:
    """cov made positive definite: "clip" raises eigenvalues, "nearest" projects."""
    fix = enforce_positive_definite if method == "clip" else nearest_positive_definite
    return _solved(cov, by, "factor_i string, factor_j string, value double", lambda names, m: long(names, fix(m)))


def diagnose_frame(cov: DataFrame, by: str | None = None) -> DataFrame:
    """positive_definite, condition_number, trace of each matrix."""
    return _solved(cov, by, "positive_definite boolean, condition_number double, trace double", lambda names, m: pd.DataFrame({"positive_definite": [is_positive_definite(m)], "condition_number": [condition_number(m)], "trace": [float(np.trace(m))]}))


def eigen_2x2(cov: DataFrame) -> DataFrame:
    """factor_i, factor_j, high, low, condition_number, positive_definite of every pair of factors, in closed form."""
    d = cov.filter("factor_i = factor_j").select(F.col("factor_i").alias("f"), F.col("value").alias("v"))
    df = cov.filter("factor_i < factor_j").join(d.toDF("factor_i", "a"), "factor_i").join(d.toDF("factor_j", "c"), "factor_j")
    root = F.sqrt(((F.col("a") - F.col("c")) / 2) ** 2 + F.col("value") ** 2)
    df = df.withColumns({"high": (F.col("a") + F.col("c")) / 2 + root, "low": (F.col("a") + F.col("c")) / 2 - root})
    return df.select("factor_i", "factor_j", "high", "low", F.try_divide("high", "low").alias("condition_number"), ((F.col("a") > 0) & (F.col("c") > 0) & (F.col("low") > FLOOR)).alias("positive_definite"))
