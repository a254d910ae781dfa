"""The risk model: a factor covariance with specific variances, and what a portfolio makes of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from fathom.errors import RiskModelError
from fathom.operators.covariance import ewma
from fathom.operators.protocols import CovarianceEstimator, SpecificRiskEstimator
from fathom.operators.specific import specific_risk


def portfolio_exposures(weights: DataFrame, exposures: DataFrame) -> DataFrame:
    """factor, x: the weighted sum of exposures. weights: symbol, weight; exposures: symbol, factor, exposure."""
    return weights.join(exposures, "symbol").groupBy("factor").agg(F.sum(F.col("weight") * F.col("exposure")).alias("x"))


def risk_decomposition(weights: DataFrame, exposures: DataFrame, cov: DataFrame, specific: DataFrame) -> DataFrame:
    """One row: factor_variance, specific_variance, total_variance and their roots *_risk. specific: symbol, variance."""
    x = portfolio_exposures(weights, exposures)
    left, right = x.toDF("factor_i", "xi"), x.toDF("factor_j", "xj")
    f = cov.join(left, "factor_i").join(right, "factor_j").agg(F.coalesce(F.sum(F.col("xi") * F.col("value") * F.col("xj")), F.lit(0.0)).alias("factor_variance"))
    s = weights.join(specific, "symbol").agg(F.coalesce(F.sum(F.col("weight") ** 2 * F.col("variance")), F.lit(0.0)).alias("specific_variance"))
    both = f.join(F.broadcast(s)).withColumn("total_variance", F.col("factor_variance") + F.col("specific_variance"))  # one row each
    return both.select("*", *(F.sqrt(F.greatest(f"{k}_variance", F.lit(0.0))).alias(f"{k}_risk") for k in ("factor", "specific", "total")))


@dataclass
class RiskModel:
    """Fit on factor returns and residuals, then ask for portfolio risk.

    The specific variance is annual and the factor covariance per period, as in the model this follows;
    annualize_factor_cov puts both on a year.
    """

    covariance: CovarianceEstimator = ewma
    specific: SpecificRiskEstimator = specific_risk
    annualize_factor_cov: bool = False
    periods_per_year: int = 252
    cov: DataFrame | None = None
    variances: DataFrame | None = None

    def fit(self, factor_returns: DataFrame, residuals: DataFrame, **specific_options) -> RiskModel:  # noqa: ANN003
        cov = self.covariance(factor_returns)
        self.cov = cov.withColumn("value", F.col("value") * self.periods_per_year) if self.annualize_factor_cov else cov
        vols = self.specific(residuals, **{"strict": True, "periods_per_year": self.periods_per_year, **specific_options})
        self.variances = vols.select("symbol", (F.col("volatility") ** 2).alias("variance"))
        return self

    def decompose(self, weights: DataFrame, exposures: DataFrame) -> DataFrame:
        if self.cov is None:
            raise RiskModelError("fit the model first")
        unknown = exposures.select("factor").distinct().join(self.cov.select(F.col("factor_i").alias("factor")).distinct(), "factor", "left_anti")
        if (row := unknown.first()) is not None:
            raise RiskModelError(f"the model has no factor {row[0]}")
        return risk_decomposition(weights, exposures, self.cov, self.variances)
