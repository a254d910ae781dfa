"""What a user may put in place of the built-in parts."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame


class CovarianceEstimator(Protocol):
    """Factor returns (date, factor, ret) to a covariance (factor_i, factor_j, value)."""

    def __call__(self, returns: DataFrame) -> DataFrame: ...


class SpecificRiskEstimator(Protocol):
    """Residuals (date, symbol, residual) to symbol, n, volatility."""

    def __call__(self, residuals: DataFrame, **options: object) -> DataFrame: ...


class Exporter(Protocol):
    """Rows to text in one of the formats of fathom.sinks.export."""

    def __call__(self, df: DataFrame, fmt: str = "csv") -> str: ...


class UniverseLike(Protocol):
    """A set of symbols with sectors."""

    def symbols(self) -> list[str]: ...

    def size(self) -> int: ...

    def contains(self, symbol: str) -> bool: ...

    def sector(self, symbol: str) -> str | None: ...
