"""Style factors of every date and symbol, by running sums and lags over one ordering per symbol."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fathom.errors import InvalidParameter
from fathom.functions.columns import zscore
from fathom.operators.panel import by_symbol
from fathom.operators.rolling import Rolling
from fathom.sources.universe import SECTORS

FACTORS = ("momentum", "size", "beta", "volatility", "illiquidity")


@dataclass(frozen=True)
class FactorConfig:
    """Rows of each trailing window; the defaults are for daily rows."""

    momentum_lookback: int = 126
    momentum_skip: int = 21
    beta_lookback: int = 126
    beta_min: int = 40
    volatility_lookback: int = 63
    volatility_min: int = 20
    amihud_lookback: int = 21
    amihud_min: int = 10
    periods_per_year: int = 252

    def __post_init__(self) -> None:
        if min(vars(self).values()) < 1 or self.beta_min > self.beta_lookback or self.volatility_min > self.volatility_lookback or self.amihud_min > self.amihud_lookback:
            raise InvalidParameter("windows must be positive and hold their minimum of rows")


#: Windows for monthly rows.
MONTHLY = FactorConfig(12, 1, 36, 12, 12, 6, 6, 3, 12)


def available_factors() -> list[str]:
    return list(FACTORS)


def momentum(c: FactorConfig) -> Column:
    """Price `skip` rows ago over the price `skip + lookback` rows ago, less 1."""
    return F.try_divide(F.lag("adjusted_close", c.momentum_skip).over(by_symbol()), F.lag("adjusted_close", c.momentum_skip + c.momentum_lookback).over(by_symbol())) - 1


def _rolling() -> Rolling:
    """Trailing sums of the returns, the market and |return| over traded value (Amihud 2002), by symbol."""
    daily = F.try_divide(F.abs("asset_returns"), F.nullif(F.col("close") * F.col("volume"), F.lit(0.0)))
    return Rolling(["symbol"], "date").add("asset", F.col("asset_returns")).add("market", F.col("market_return")).add("amihud", daily).pair("asset", "market")


def _enough(rolling: Rolling, value: Column, n: int, least: int) -> Column:
    return F.when(rolling.count("asset", n) >= least, value)


def beta(c: FactorConfig, rolling: Rolling) -> Column:
    n = c.beta_lookback
    return _enough(rolling, F.try_divide(rolling.covar("asset", "market", n), F.nullif(rolling.var("market", n), F.lit(0.0))), n, c.beta_min)


def volatility(c: FactorConfig, rolling: Rolling) -> Column:
    return _enough(rolling, rolling.std("asset", c.volatility_lookback) * float(c.periods_per_year) ** 0.5, c.volatility_lookback, c.volatility_min)


def illiquidity(c: FactorConfig, rolling: Rolling) -> Column:
    return _enough(rolling, rolling.mean("amihud", c.amihud_lookback), c.amihud_lookback, c.amihud_min)


def raw_factors(panel: DataFrame, config: FactorConfig = FactorConfig()) -> DataFrame:
    """panel with momentum, size (log cap), beta, volatility and illiquidity of every row, null where a window is short."""
    size, rolling = F.when(F.col("market_cap") > 0, F.ln("market_cap")), _rolling()
    made = {"momentum": momentum(config), "size": size, "beta": beta(config, rolling), "volatility": volatility(config, rolling), "illiquidity": illiquidity(config, rolling)}
    return rolling.clean(rolling.frame(panel).withColumns(made))


def scores(panel: DataFrame, config: FactorConfig = FactorConfig(), date=None) -> DataFrame:  # noqa: ANN001
    """symbol, date and <factor>_score: factors standardised over the symbols of each date that have all five.

    date keeps one date; "last" the last there is. Standardising on complete rows equals joining the five factor frames.
    """
    raw = raw_factors(panel, config).dropna(subset=list(FACTORS))
    if date is not None:
        raw = raw.join(raw.agg(F.max("date").alias("date")), "date") if date == "last" else raw.filter(F.col("date") == F.lit(date))
    return raw.select("symbol", "date", *(zscore(F.col(f), "date").alias(f"{f}_score") for f in FACTORS))


def one_hot(df: DataFrame, sectors: tuple[str, ...] = SECTORS) -> DataFrame:
    """df with sector_<Name> as 0.0 or 1.0 for each sector; a null or unknown sector has zeros."""
    return df.withColumns({f"sector_{s.replace(' ', '_')}": F.when(F.col("sector") == s, 1.0).otherwise(0.0) for s in sectors})
