"""Factor covariance from long rows (date, factor, ret) to long rows (factor_i, factor_j, value).

Every estimator takes its sums of products from moments.gram(), one pass over the rows in blocks of dates.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fathom.errors import InsufficientData, InvalidParameter
from fathom.functions.columns import clamp
from fathom.operators.moments import MOMENTS, Basis, basis, gram, lagged, numbered
from fathom.operators.rolling import Rolling


def held(returns: DataFrame) -> DataFrame:
    """returns, cached: a row per date and factor, which an estimator reads twice. DataFrame.unpersist or Catalog.clearCache frees it."""
    return returns if returns.is_cached else returns.select("date", "factor", "ret").cache()


def _need(base: Basis, least: int) -> None:
    if base.n < least:
        raise InsufficientData(least, base.n)


def _centred(base: Basis, center: bool) -> Basis:
    return base if center else replace(base, means=np.zeros(len(base.names)))


def sample(returns: DataFrame, center: bool = True) -> DataFrame:
    """Covariance over T, centred or not."""
    returns = held(returns)
    found = gram(returns, _centred(basis(returns), center), {"xy": MOMENTS["xy"]})
    return found.select("factor_i", "factor_j", (F.col("xy") / F.col("n")).alias("value"))


@dataclass(frozen=True)
class EwmaConfig:
    decay: float = 0.95
    min_observations: int = 60
    bias_correction: bool = True

    def __post_init__(self) -> None:
        if not 0 < self.decay < 1:
            raise InvalidParameter("decay must be between 0 and 1")

    def half_life(self) -> float:
        return math.log(0.5) / math.log(self.decay)


def ewma_weight(decay: float, t: Column, n: Column) -> Column:
    """Weight of observation t of n (from 0): what the recursion from the first observation gives."""
    return F.when(t == 0, F.pow(F.lit(decay), n - 1)).otherwise((1 - decay) * F.pow(F.lit(decay), n - 1 - t))


def ewma(returns: DataFrame, config: EwmaConfig = EwmaConfig(), strict: bool = True) -> DataFrame:
    """Exponentially weighted covariance about the weighted means.

    The weights sum to one. bias_correction multiplies by n (1 - decay) / (1 - decay^n), which inflates; it is the
    default for parity.
    """
    returns = held(returns)
    base = basis(returns)
    if strict:
        _need(base, config.min_observations)
    n, t = base.n, np.arange(base.n)
    w = np.where(t == 0, config.decay ** (n - 1), (1 - config.decay) * config.decay ** (n - 1.0 - t)) if n else np.zeros(0)
    weight = ewma_weight(config.decay, F.col("t"), F.lit(n))
    means = {r[0]: r[1] for r in numbered(returns, base).groupBy("factor").agg(F.sum(weight * F.col("ret"))).collect()}  # a row a factor
    base = replace(base, means=np.array([means[f] for f in base.names]))
    scale = n * (1 - config.decay) / (1 - config.decay**n) if config.bias_correction and n else 1.0
    return gram(returns, base, {"xy": MOMENTS["xy"]}, weights=w).select("factor_i", "factor_j", (F.col("xy") * scale).alias("value"))


def ewma_update(cov: DataFrame, new: DataFrame, decay: float = 0.95) -> DataFrame:
    """cov after the periods of `new`, one by one: C <- decay C + (1 - decay) r r'; neither centred nor corrected."""
    base = _centred(basis(new), False)
    m = base.n
    add = gram(new, base, {"xy": MOMENTS["xy"]}, weights=(1 - decay) * decay ** (m - 1.0 - np.arange(m))).select("factor_i", "factor_j", F.col("xy").alias("add"))
    old = cov.select("factor_i", "factor_j", (F.col("value") * decay**m).alias("old"))
    return old.join(add, ["factor_i", "factor_j"], "full").select("factor_i", "factor_j", (F.coalesce("old", F.lit(0.0)) + F.coalesce("add", F.lit(0.0))).alias("value"))


TARGETS = ("identity", "diagonal", "constant_correlation")


def shrinkage_target(cov: DataFrame, target: str) -> DataFrame:
    """The matrix that shrinkage moves to."""
    if target not in TARGETS:
        raise InvalidParameter(f"target must be one of {', '.join(TARGETS)}")
    same = F.col("factor_i") == F.col("factor_j")
    if target == "identity":
        mean = F.avg(F.when(same, F.col("value"))).over(W.partitionBy())
        return cov.withColumn("value", F.when(same, mean).otherwise(0.0))
    if target == "diagonal":
        return cov.withColumn("value", F.when(same, F.col("value")).otherwise(0.0))
    sd = with_deviations(cov)
    corr = F.when((F.col("factor_i") < F.col("factor_j")) & (F.col("si") > 0) & (F.col("sj") > 0), F.col("value") / (F.col("si") * F.col("sj")))
    mean = F.coalesce(F.avg(corr).over(W.partitionBy()), F.lit(0.0))
    return sd.withColumn("value", F.when(same, F.col("value")).otherwise(mean * F.col("si") * F.col("sj"))).select("factor_i", "factor_j", "value")


def with_deviations(cov: DataFrame) -> DataFrame:
    """cov with si, sj: the square roots of the variances of its factors."""
    sd = cov.filter("factor_i = factor_j").select(F.col("factor_i").alias("f"), F.sqrt("value").alias("s"))
    return cov.join(sd.toDF("factor_i", "si"), "factor_i").join(sd.toDF("factor_j", "sj"), "factor_j").select("factor_i", "factor_j", "value", "si", "sj")


def _shrinkage(returns: DataFrame, target: str, mode: str, center: bool) -> tuple[DataFrame, DataFrame]:
    """The moments of each pair with s, si and sj, and one row: intensity, gamma, pi, rho, rbar and the mean variance.

    Distances to the target are polynomials in the mean correlation or variance, so one aggregate over the pairs gives them all.
    """
    if target not in TARGETS:
        raise InvalidParameter(f"target must be one of {', '.join(TARGETS)}")
    base = _centred(basis(returns), center)
    x = gram(returns, base, {k: MOMENTS[k] for k in ("xy", "xxyy", "xxxy")})
    x = x.select("factor_i", "factor_j", F.col("n").alias("t"), (F.col("xy") / F.col("n")).alias("s"), (F.col("xxyy") / F.col("n")).alias("m4"), (F.col("xxxy") / F.col("n")).alias("m31"))
    same = F.col("factor_i") == F.col("factor_j")
    sd = lambda by: F.sqrt(F.max(F.when(same, F.col("s"))).over(W.partitionBy(by)))
    x = x.withColumns({"si": sd("factor_i"), "sj": sd("factor_j")})
    both, live = F.col("si") * F.col("sj"), (F.col("si") > 0) & (F.col("sj") > 0)
    add = lambda on, value: F.coalesce(F.sum(F.when(on, value)), F.lit(0.0))
    pi = F.col("m4") - F.col("s") ** 2
    # theta_ii,ij = mean (y_i^2 - s_ii)(y_i y_j - s_ij) = mean y_i^3 y_j - s_ii s_ij; summing over i <> j both halves of the formula are the same.
    theta = F.when(F.col("si") > 0, F.col("sj") / F.col("si") * (F.col("m31") - F.col("si") ** 2 * F.col("s")))
    every = F.lit(True)
    one = x.agg(
        F.coalesce(F.avg(F.when((F.col("factor_i") < F.col("factor_j")) & live, F.col("s") / both)), F.lit(0.0)).alias("rbar"), F.avg(F.when(same, F.col("s"))).alias("mean"), F.max("t").alias("t"),
        add(every, pi).alias("pi"), add(same, pi).alias("pi_own"), add(~same, theta).alias("theta"), add(~same, F.col("s") ** 2).alias("ss"), add(~same, F.col("s") * both).alias("sb"), add(~same, both**2).alias("bb"),
        add(same, F.col("s") ** 2).alias("own2"), add(same, F.lit(1.0)).alias("k"), add(same, F.col("s")).alias("own"),
    )
    c = F.col
    if target == "identity":
        gamma, rho = c("ss") + c("own2") - 2 * c("mean") * c("own") + c("k") * c("mean") ** 2, F.lit(0.0)
    elif target == "diagonal":
        gamma, rho = c("ss"), c("pi_own")
    else:
        gamma, rho = c("ss") - 2 * c("rbar") * c("sb") + c("rbar") ** 2 * c("bb"), c("pi_own") + c("rbar") * c("theta")
    one = one.withColumn("gamma", F.greatest(gamma, F.lit(0.0)))
    if mode == "reference":
        # mean |yy' - F|^2 - mean |yy' - S|^2 is |S - F|^2 again.
        one = one.withColumn("rho", c("gamma")).withColumn("delta", c("rho") / c("gamma"))
    else:
        one = one.withColumn("rho", rho).withColumn("delta", (c("pi") - c("rho")) / (c("gamma") * c("t")))
    return x, one.withColumn("intensity", F.when(c("gamma") > 0, clamp(c("delta"), 0.0, 1.0)).otherwise(0.0))


def shrinkage_intensity(returns: DataFrame, target: str = "constant_correlation", mode: str = "published", center: bool = True) -> DataFrame:
    """One row: intensity in [0, 1], gamma, pi, rho.

    mode "reference" is (mean|yy' - F|^2 - mean|yy' - S|^2) / |S - F|^2, which is 1 whenever S differs from F.
    mode "published" is (pi - rho) / (gamma T) of Ledoit and Wolf (2004) for the target.
    """
    return _shrinkage(held(returns), target, mode, center)[1].select("intensity", "gamma", "pi", "rho")


def ledoit_wolf(returns: DataFrame, target: str = "constant_correlation", mode: str = "published", center: bool = True, intensity: float | None = None) -> DataFrame:
    """intensity * target + (1 - intensity) * sample covariance."""
    returns = held(returns)
    _need(basis(returns), 2)
    x, one = _shrinkage(returns, target, mode, center)
    df = x.join(F.broadcast(one.select("rbar", "mean", F.lit(intensity).alias("intensity") if intensity is not None else F.col("intensity"))))  # one row
    same = F.col("factor_i") == F.col("factor_j")
    off = F.col("rbar") * F.col("si") * F.col("sj") if target == "constant_correlation" else F.lit(0.0)
    f = F.when(same, F.col("mean") if target == "identity" else F.col("s")).otherwise(off)
    return df.select("factor_i", "factor_j", (F.col("intensity") * f + (1 - F.col("intensity")) * F.col("s")).alias("value"))


def bartlett(lag: int, lags: int) -> float:
    return max(0.0, 1 - lag / (lags + 1))


def auto_lags(n: int) -> int:
    return math.ceil(4 * (n / 100) ** (2 / 9))


def newey_west(returns: DataFrame, lags: int | None = None, min_observations: int = 60) -> DataFrame:
    """Autocorrelation-robust covariance: S0 + sum of Bartlett weights times (G_l + G_l'), all over T; lags is held below T."""
    returns = held(returns)
    base = basis(returns)
    n = base.n
    _need(base, min_observations)
    lags = min(auto_lags(n) if lags is None else lags, n - 1)
    g = gram(returns, base, {f"g{k}": lagged(k) for k in range(lags + 1)}, lags)
    half = g.select("factor_i", "factor_j", (F.col("g0") / n).alias("s0"), (sum((F.lit(bartlett(k, lags)) * F.col(f"g{k}") for k in range(1, lags + 1)), F.lit(0.0)) / n).alias("g"))
    turned = half.select(F.col("factor_i").alias("factor_j"), F.col("factor_j").alias("factor_i"), F.col("g").alias("gt"))
    return half.join(turned, ["factor_i", "factor_j"]).select("factor_i", "factor_j", (F.col("s0") + F.col("g") + F.col("gt")).alias("value"))


@dataclass(frozen=True)
class RegimeConfig:
    short_window: int = 21
    long_window: int = 252
    low_threshold: float = 0.75
    high_threshold: float = 1.5
    max_scale: float = 3.0

    def __post_init__(self) -> None:
        if self.short_window < 1 or self.long_window <= self.short_window or self.low_threshold >= self.high_threshold or self.max_scale <= 0:
            raise InvalidParameter("windows and thresholds must rise and max_scale be positive")


def regimes(series: DataFrame, config: RegimeConfig = RegimeConfig(), by: str | None = None) -> DataFrame:
    """series (date, ret) from the first date with a long window on, with short_vol, long_vol, ratio, regime, scale.

    scale is the squared ratio held within [1 / max_scale, max_scale], 1 where the long deviation is 0.
    """
    c, order = config, (W.partitionBy(by) if by else W.partitionBy()).orderBy("date")
    rolling = Rolling([by] if by else [], "date").add("ret", F.col("ret"))
    vol = lambda n: F.coalesce(rolling.std("ret", n), F.lit(0.0))
    df = rolling.frame(series).withColumns({"short_vol": vol(c.short_window), "long_vol": vol(c.long_window), "_n": F.row_number().over(order)})
    df = rolling.clean(df).filter(F.col("_n") >= c.long_window).drop("_n")
    quiet = F.col("long_vol") == 0
    ratio = F.when(quiet, 1.0).otherwise(F.try_divide("short_vol", "long_vol"))
    df = df.withColumn("ratio", ratio)
    regime = F.when(F.col("ratio") < c.low_threshold, "Low").when(F.col("ratio") > c.high_threshold, "High").otherwise("Normal")
    return df.withColumns({"regime": regime, "scale": F.when(quiet | (F.col("short_vol") == 0) & quiet, 1.0).otherwise(clamp(F.col("ratio") ** 2, 1 / c.max_scale, c.max_scale))})


def detect_regime(series: DataFrame, config: RegimeConfig = RegimeConfig()) -> DataFrame:
    """The last row of regimes(); an error if there are fewer dates than the long window."""
    n = series.select("date").distinct().count()
    if n < config.long_window:
        raise InsufficientData(config.long_window, n)
    return regimes(series, config).orderBy(F.desc("date")).limit(1)


def scale(cov: DataFrame, regime: DataFrame) -> DataFrame:
    """cov times the scale of a one-row regime."""
    return cov.join(F.broadcast(regime.select("scale"))).select("factor_i", "factor_j", (F.col("value") * F.col("scale")).alias("value"))


def correlation(cov: DataFrame, periods_per_year: int = 252) -> DataFrame:
    """cov with correlation and the annualised volatilities of both factors; 0 where a deviation is 0."""
    both = F.col("si") * F.col("sj")
    return with_deviations(cov).select("factor_i", "factor_j", "value", F.when(both > 0, F.col("value") / both).otherwise(0.0).alias("correlation"), (F.col("si") * periods_per_year**0.5).alias("vol_i"), (F.col("sj") * periods_per_year**0.5).alias("vol_j"))
