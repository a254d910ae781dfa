"""Risk contributions, value at risk and the risk summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fathom.functions.columns import share

#: One-sided normal quantiles.
Z95, Z99 = 1.645, 2.326
EPS = 1e-10


def factor_risk(exposures: DataFrame, volatilities: DataFrame) -> DataFrame:
    """factor, exposure, volatility, marginal (b s^2), contribution (b^2 s^2); factors without a volatility go."""
    df = exposures.join(volatilities, "factor").withColumn("marginal", F.col("exposure") * F.col("volatility") ** 2)
    return df.withColumn("contribution", F.col("exposure") * F.col("marginal"))


def with_percent(contributions: DataFrame, total_risk: float) -> DataFrame:
    """contributions with contribution_pct of the variance total_risk^2."""
    return contributions.withColumn("contribution_pct", share(F.col("contribution"), F.lit(float(total_risk)) ** 2, EPS))


def risk_summary(exposures: DataFrame, volatilities: DataFrame, specific_volatility: float, value: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary, factors) for independent factors.

    summary: total_risk, factor_risk, specific_risk, var_95, var_99, their monetary values and the ratios to
    the total, 0 where there is no risk. factors: factor_risk() with contribution_pct, largest first.
    """
    rows = factor_risk(exposures, volatilities)
    v = rows.agg(F.coalesce(F.sum("contribution"), F.lit(0.0)).alias("fv")).withColumn("tv", F.col("fv") + F.lit(specific_volatility**2))
    total = F.sqrt("tv")
    ratio = lambda x: F.when(total < EPS, 0.0).otherwise(F.try_divide(x, F.nullif(total, F.lit(0.0))))
    money = lambda z: F.lit(value).cast("double") * total * z
    summary = v.select(
        total.alias("total_risk"), F.sqrt("fv").alias("factor_risk"), F.lit(float(specific_volatility)).alias("specific_risk"), (total * Z95).alias("var_95"), (total * Z99).alias("var_99"),
        money(Z95).alias("var_95_value"), money(Z99).alias("var_99_value"), ratio(F.sqrt("fv")).alias("factor_ratio"), ratio(F.lit(specific_volatility)).alias("specific_ratio"),
    )
    factors = rows.join(F.broadcast(v)).withColumn("contribution_pct", share(F.col("contribution"), F.col("tv"), EPS)).drop("fv", "tv")
    return summary, factors.orderBy(F.desc("contribution"), "factor")
