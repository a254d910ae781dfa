"""Cross-sectional factor returns: a sector stage in closed form, then a style stage of weighted least squares.

Weights are the square roots of the caps and returns are winsorised per date. The sector stage has a
market and sector returns that sum to zero; it needs means only. The style stage sums the normal
equations per date in Spark and solves one small system per date.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from fathom.functions.columns import winsorize


def weighted(panel: DataFrame, winsor: float = 0.05) -> DataFrame:
    """panel with ret (winsorised per date) and w (root of the cap); rows without a return, cap or sector go."""
    df = panel.filter("asset_returns is not null and market_cap > 0 and sector is not null").withColumn("ret", F.col("asset_returns"))
    df = winsorize(df, "ret", "date", winsor) if winsor else df
    return df.withColumn("w", F.sqrt("market_cap"))


def sector_returns(panel: DataFrame, winsor: float = 0.05) -> DataFrame:
    """date, sector, sector_mean, market, ret: market is the mean of the sector means, ret the sector's less it."""
    means = weighted(panel, winsor).groupBy("date", "sector").agg((F.sum(F.col("w") * F.col("ret")) / F.sum("w")).alias("sector_mean"))
    market = F.avg("sector_mean").over(W.partitionBy("date"))
    return means.withColumn("market", market).withColumn("ret", F.col("sector_mean") - F.col("market"))


def residuals(panel: DataFrame, winsor: float = 0.05) -> DataFrame:
    """weighted(panel) with residual: the return less its sector's mean."""
    df = weighted(panel, winsor)
    w = W.partitionBy("date", "sector")
    return df.withColumn("residual", F.col("ret") - F.sum(F.col("w") * F.col("ret")).over(w) / F.sum("w").over(w))


def factor_returns(panel: DataFrame, winsor: float = 0.05) -> DataFrame:
    """The sector stage as long rows: date, factor (market or the sector), ret."""
    s = sector_returns(panel, winsor)
    market = s.groupBy("date").agg(F.max("market").alias("ret")).select("date", F.lit("market").alias("factor"), "ret")
    return s.select("date", F.col("sector").alias("factor"), "ret").union(market)


def style_returns(df: DataFrame, styles: list[str], target: str = "residual") -> DataFrame:
    """date, n, r2 and f_<style>: weighted least squares of target on the styles, without an intercept, for each date.

    df: date, w, target, the styles. Sums are combined map-side; one row a date reaches Python. A
    rank-deficient date has the solution of least norm, one with fewer rows than styles has nulls.
    """
    df = df.dropna(subset=[*styles, target, "w"])
    pairs = list(combinations_with_replacement(styles, 2))
    sums = [F.sum(F.col("w") * F.col(a) * F.col(b)) for a, b in [*pairs, *((s, target) for s in styles), (target, target)]]
    eq = df.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("s"))
    p = len(styles)

    @F.pandas_udf("f array<double>, r2 double")
    def solve(n: pd.Series, s: pd.Series) -> pd.DataFrame:
        out = []
        for rows, v in zip(n, s, strict=True):
            if rows < p:
                out.append((None, None))
                continue
            a = np.zeros((p, p))
            a[np.triu_indices(p)] = v[: len(pairs)]
            a = a + np.triu(a, 1).T
            b = np.asarray(v[len(pairs) : -1])
            f = np.linalg.lstsq(a, b, rcond=None)[0]
            out.append((f, 1 - (v[-1] - 2 * f @ b + f @ a @ f) / v[-1] if v[-1] > 0 else None))
        return pd.DataFrame(out, columns=["f", "r2"])

    solved = eq.withColumn("x", solve("n", "s"))
    return solved.select("date", "n", F.col("x.r2").alias("r2"), *(F.get("x.f", F.lit(k)).alias(f"f_{s}") for k, s in enumerate(styles)))


def style_returns_sql(df: DataFrame, styles: list[str], target: str = "residual") -> DataFrame:
    """style_returns for one or two styles by Cramer's rule, without Python; a singular date has nulls."""
    df = df.dropna(subset=[*styles, target, "w"])
    s = lambda a, b: F.sum(F.col("w") * F.col(a) * F.col(b))
    if len(styles) == 1:
        (x,) = styles
        return df.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.try_divide(s(x, target), s(x, x)).alias(f"f_{x}"))
    x, y = styles
    df = df.groupBy("date").agg(F.count(F.lit(1)).alias("n"), s(x, x).alias("xx"), s(x, y).alias("xy"), s(y, y).alias("yy"), s(x, target).alias("xt"), s(y, target).alias("yt"))
    det = F.nullif(F.expr("xx * yy - xy * xy"), F.lit(0.0))
    return df.select("date", "n", F.try_divide(F.expr("xt * yy - yt * xy"), det).alias(f"f_{x}"), F.try_divide(F.expr("yt * xx - xt * xy"), det).alias(f"f_{y}"))


def specific_returns(df: DataFrame, styles: list[str], target: str = "residual") -> DataFrame:
    """date, symbol, residual: what the style returns leave of target."""
    f = style_returns(df, styles, target)
    fit = sum((F.col(s) * F.col(f"f_{s}") for s in styles), F.lit(0.0))
    return df.dropna(subset=[*styles, target]).join(f, "date").select("date", "symbol", (F.col(target) - fit).alias("residual"))
