"""Security-specific risk from residual returns (date, symbol, residual), one aggregate per symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from fathom.errors import InsufficientData, InvalidParameter
from fathom.operators.covariance import ewma_weight

METHODS = ("ewma", "historical")


def specific_risk(residuals: DataFrame, method: str = "ewma", decay: float = 0.95, min_observations: int = 60, periods_per_year: int = 252, strict: bool = False) -> DataFrame:
    """symbol, n, volatility (annualised), null for symbols with too few rows; with strict an error instead.

    historical: sample deviation. ewma: weighted squares, uncentred, starting from the first square.
    """
    if method not in METHODS or not 0 < decay < 1:
        raise InvalidParameter(f"method must be one of {', '.join(METHODS)} and decay between 0 and 1")
    if method == "historical":
        var, df = F.var_samp("residual"), residuals
    else:
        w = W.partitionBy("symbol")
        df = residuals.withColumn("w", ewma_weight(decay, F.row_number().over(w.orderBy("date")) - 1, F.count(F.lit(1)).over(w)))
        var = F.sum(F.col("w") * F.col("residual") ** 2)
    out = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sqrt(var * periods_per_year).alias("volatility"))
    out = out.withColumn("volatility", F.when(F.col("n") >= min_observations, F.col("volatility")))
    if strict and (short := out.filter("volatility is null").agg(F.min("n")).first()[0]) is not None:
        raise InsufficientData(min_observations, short)
    return out


def shrink_weight(n, kappa: float = 60.0):  # noqa: ANN001, ANN201
    """Weight of the estimate against the prior, n / (n + kappa)."""
    return n / (n + kappa)


def bayesian(vols: DataFrame, kappa: float = 60.0, group: str | None = None, default: float = 0.30) -> DataFrame:
    """vols (symbol, n, volatility and prior or a group column) with prior, weight, shrunk.

    With a group the prior is the mean volatility of its members, itself included, `default` where none has one.
    A missing estimate becomes the default with a group, the prior without.
    """
    if group:
        vols = vols.withColumn("volatility", F.coalesce("volatility", F.lit(default)))
        vols = vols.withColumn("prior", F.avg("volatility").over(W.partitionBy(group)))
    weight = shrink_weight(F.col("n"), kappa)
    shrunk = F.coalesce(weight * F.col("volatility") + (1 - weight) * F.col("prior"), F.col("prior"))
    return vols.withColumns({"weight": weight, "shrunk": shrunk})
