"""Schemas of the frames that pass between layers, and a check of a frame against one."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fathom.errors import DataError



#: DDL of each frame. Money is double throughout; volume is a long.
DDL = {
    "quotes": "symbol string, date date, open double, high double, low double, close double, volume bigint, adjusted_close double",
    "universe": "symbol string, name string, sector string, industry string, added_at timestamp, active boolean",
    "market_caps": "symbol string, date date, market_cap double, cached_at timestamp",
    "fundamentals": "symbol string, date date, data string, cached_at timestamp",
    "company_ciks": "symbol string, cik string, company_name string, updated_at timestamp",
    "facts": "concept string, value double, unit string, period_end date, period_start date, form string, fiscal_year int, fiscal_period string",
    "factor_returns": "date date, factor string, ret double",
    "residuals": "date date, symbol string, residual double",
    "covariance": "factor_i string, factor_j string, value double",
}
#: The 18 metrics of a statement.
METRICS = (
    "total_assets", "total_liabilities", "stockholders_equity", "long_term_debt", "current_assets", "current_liabilities",
    "cash_and_equivalents", "revenue", "net_income", "operating_income", "gross_profit", "eps_basic", "eps_diluted",
    "operating_cash_flow", "capital_expenditures", "free_cash_flow", "shares_outstanding", "shares_outstanding_diluted",
)
DDL["financial_statements"] = "symbol string, cik string, period_end date, period_type string, fiscal_year int, fiscal_quarter int, " + ", ".join(f"{m} double" for m in METRICS) + ", cached_at timestamp"


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, if it has the columns; an error that names the missing ones if not."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise DataError(f"columns {', '.join(missing)} are missing; there are {', '.join(df.columns)}")
    return df


def conform(df: DataFrame, name: str) -> DataFrame:
    """df with the columns and types of the named schema; columns it lacks are null."""
    kinds = [x.split(" ") for x in DDL[name].split(", ")]
    have = set(df.columns)
    return df.selectExpr(*(f"cast({c if c in have else 'null'} as {t}) as {c}" for c, t in kinds))
