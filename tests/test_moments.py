"""Blocked moments against NumPy."""

import datetime as dt

import numpy as np
import pytest

from fathom.operators import covariance as cv, moments as mo


def frame(spark, x, names, missing=0.0, seed=0):
    rng = np.random.default_rng(seed)
    day = dt.date(2020, 1, 1)
    rows = [(day + dt.timedelta(days=2 * t), names[k], None if rng.random() < missing else float(x[t, k])) for t in range(len(x)) for k in range(x.shape[1])]
    return spark.createDataFrame(rows, "date date, factor string, ret double").repartition(3), np.array([np.nan if r[2] is None else r[2] for r in rows]).reshape(x.shape)


def matrix(df, names, column="value"):
    at = {n: k for k, n in enumerate(names)}
    out = np.full((len(names), len(names)), np.nan)
    for r in df.collect():
        out[at[r["factor_i"]], at[r["factor_j"]]] = r[column]
    return out


@pytest.mark.parametrize("missing", [0.0, 0.2])
def test_blocks_of_any_size_give_the_same(spark, missing):
    rng = np.random.default_rng(4)
    names = [f"f{k:02d}" for k in range(7)]
    df, x = frame(spark, rng.normal(3.0, 1.0, (90, 7)), names, missing)
    base = mo.basis(df)
    assert base.names == names and base.n == 90 and np.allclose(base.means, np.nanmean(x, axis=0))
    y, m = np.nan_to_num(x - np.nanmean(x, axis=0)), (~np.isnan(x)).astype(float)
    want = {"n": m.T @ m, "xy": y.T @ y, "xxyy": (y**2).T @ y**2, "xxxy": (y**3).T @ y} | {f"g{k}": y[k:].T @ y[: 90 - k] for k in range(6)}
    kinds = mo.MOMENTS | {f"g{k}": mo.lagged(k) for k in range(6)}
    for size in (6, 13, 90, 1000):
        got = mo.gram(df, base, kinds, 5, block=size)
        for k, v in want.items():
            assert np.allclose(matrix(got, names, k), v, atol=1e-9), (size, k)


def test_pairs_that_share_no_date_have_no_row(spark):
    rows = [(dt.date(2020, 1, 1), "a", 1.0), (dt.date(2020, 1, 2), "a", 2.0), (dt.date(2020, 1, 3), "b", 5.0), (dt.date(2020, 1, 4), "b", None)]
    got = cv.sample(spark.createDataFrame(rows, "date date, factor string, ret double")).collect()
    assert {(r["factor_i"], r["factor_j"], r["value"]) for r in got} == {("a", "a", 0.25), ("b", "b", 0.0)}


def test_no_rows(spark):
    assert cv.sample(spark.createDataFrame([], "date date, factor string, ret double")).collect() == []


def test_many_factors(spark):
    """K = 500: sample, shrinkage and lags against dense algebra, with one exchange of the rows and one of the pairs."""
    rng = np.random.default_rng(9)
    names = [f"f{k:03d}" for k in range(500)]
    df, x = frame(spark, rng.normal(size=(120, 500)) @ np.diag(rng.uniform(0.5, 2, 500)), names)
    y = x - x.mean(axis=0)
    s = y.T @ y / 120
    plan = cv.sample(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in plan and "Cartesian" not in plan
    assert np.allclose(matrix(cv.sample(df), names), s)
    sd = np.sqrt(np.diag(s))
    corr = s / np.outer(sd, sd)
    rbar = corr[np.triu_indices(500, 1)].mean()
    f = np.where(np.eye(500, dtype=bool), s, rbar * np.outer(sd, sd))
    pi = (y**2).T @ y**2 / 120 - s**2
    theta = (y**3).T @ y / 120 - np.diag(s)[:, None] * s
    off = ~np.eye(500, dtype=bool)
    rho = np.trace(pi) + rbar * (np.outer(1 / sd, sd) * theta)[off].sum()
    delta = min(1.0, max(0.0, (pi.sum() - rho) / (((s - f) ** 2).sum() * 120)))
    assert np.allclose(matrix(cv.ledoit_wolf(df), names), delta * f + (1 - delta) * s)
    nw = s.copy()
    for k in (1, 2, 3):
        g = y[k:].T @ y[:-k] / 120
        nw += (1 - k / 4) * (g + g.T)
    assert np.allclose(matrix(cv.newey_west(df, 3), names), nw)
