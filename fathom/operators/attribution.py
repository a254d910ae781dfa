"""Return attribution: factor, security and portfolio level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fathom.errors import InvalidParameter
from fathom.functions.columns import clamp, share

EPS = 1e-10


def factor_attribution(df: DataFrame) -> DataFrame:
    """df (exposure, factor_return, total_return) with contribution and its contribution_pct of the total."""
    c = F.col("exposure") * F.col("factor_return")
    return df.withColumn("contribution", c).withColumn("contribution_pct", share(F.col("contribution"), F.col("total_return"), EPS))


def r_squared(factor: Column, total: Column) -> Column:
    """(factor / total)^2 held within [0, 1]; 0 where total is about 0."""
    return F.when(F.abs(total) < EPS, 0.0).otherwise(clamp(F.try_divide(factor, F.nullif(total, F.lit(0.0))) ** 2, 0.0, 1.0))


def explained_ratio(factor: Column, total: Column) -> Column:
    """factor / total, not squared; 0 where total is about 0."""
    return F.when(F.abs(total) < EPS, 0.0).otherwise(F.try_divide(factor, F.nullif(total, F.lit(0.0))))


def _summed(df: DataFrame) -> DataFrame:
    df = df.withColumn("specific_return", F.col("total_return") - F.col("factor_return"))
    return df.withColumns({"r_squared": r_squared(F.col("factor_return"), F.col("total_return")), "explained_ratio": explained_ratio(F.col("factor_return"), F.col("total_return"))})


def security_attribution(contributions: DataFrame, *by: str) -> DataFrame:
    """Per symbol (and `by`): total_return, factor_return, specific_return, r_squared, explained_ratio.

    contributions: symbol, factor, contribution, total_return (the same in each of a symbol's rows).
    """
    return _summed(contributions.groupBy("symbol", *by).agg(F.max("total_return").alias("total_return"), F.sum("contribution").alias("factor_return")))


def check_weights(weights: DataFrame, symbols: DataFrame) -> None:
    """An error unless each symbol has one weight and they sum to 1 within 1e-6."""
    row = weights.agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).first()
    n = symbols.select("symbol").distinct().count()
    if row["n"] != n:
        raise InvalidParameter(f"{row['n']} weights for {n} securities")
    if n and abs(row["w"] - 1) > 1e-6:
        raise InvalidParameter(f"weights sum to {row['w']}")


def portfolio_attribution(contributions: DataFrame, weights: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary, factors): one row for the portfolio, and a row per factor, largest |contribution| first.

    Without weights all symbols weigh the same. A factor that a symbol lacks counts as 0 there.
    """
    symbols = contributions.select("symbol").distinct()
    if weights is None:
        weights = symbols.join(F.broadcast(symbols.agg((1 / F.count(F.lit(1))).alias("weight"))))  # one row
    else:
        check_weights(weights, symbols)
    own = security_attribution(contributions).join(weights, "symbol")
    summary = _summed(own.agg(*(F.coalesce(F.sum(F.col("weight") * F.col(c)), F.lit(0.0)).alias(c) for c in ("total_return", "factor_return"))))
    total = summary.select(F.col("total_return").alias("portfolio_return"))
    w = contributions.join(weights, "symbol")
    factors = w.groupBy("factor").agg(*(F.sum(F.col("weight") * F.col(c)).alias(c) for c in ("exposure", "factor_return", "contribution")))
    factors = factors.join(F.broadcast(total)).withColumn("contribution_pct", share(F.col("contribution"), F.col("portfolio_return"), EPS)).drop("portfolio_return")
    return summary, factors.orderBy(F.abs("contribution").desc(), "factor")


def attribution_over_time(exposures: DataFrame, factor_returns: DataFrame, residuals: DataFrame) -> DataFrame:
    """symbol, factor, exposure, factor_return, contribution summed over dates, and the symbol's total_return and specific_return.

    exposures: symbol, date, factor, exposure; factor_returns: date, factor, ret; residuals: date, symbol, residual.
    """
    c = exposures.join(factor_returns, ["date", "factor"]).withColumn("c", F.col("exposure") * F.col("ret"))
    per = c.groupBy("symbol", "factor").agg(F.avg("exposure").alias("exposure"), F.sum("ret").alias("factor_return"), F.sum("c").alias("contribution"))
    idio = residuals.groupBy("symbol").agg(F.sum("residual").alias("specific_return"))
    both = per.groupBy("symbol").agg(F.sum("contribution").alias("f")).join(idio, "symbol").withColumn("total_return", F.col("f") + F.col("specific_return")).drop("f")
    return per.join(both, "symbol")
