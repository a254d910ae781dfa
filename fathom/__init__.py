"""Fathom: equity factor and risk analysis on Spark DataFrames."""

from fathom.errors import FathomError
from fathom.operators.attribution import attribution_over_time, factor_attribution, portfolio_attribution, security_attribution
from fathom.operators.covariance import ewma, ledoit_wolf, newey_west
from fathom.operators.factors import scores
from fathom.operators.model import RiskModel, risk_decomposition
from fathom.operators.regression import factor_returns, residuals, specific_returns, style_returns
from fathom.operators.specific import bayesian, specific_risk
from fathom.operators.summary import risk_summary
from fathom.sinks.report import Report, attribution_table, factor_lines, portfolio_text, risk_table, risk_text, security_text
from fathom.sources.quotes import read_quotes, scan_available, scan_quotes
from fathom.sources.store import Store
from fathom.sources.universe import Universe

__all__ = [
    "FathomError", "Report", "RiskModel", "Store", "Universe", "attribution_over_time", "attribution_table", "bayesian", "ewma", "factor_attribution", "factor_lines",
    "factor_returns", "ledoit_wolf", "newey_west", "portfolio_attribution", "portfolio_text", "read_quotes", "residuals", "risk_decomposition", "risk_summary", "risk_table",
    "risk_text", "scan_available", "scan_quotes", "scores", "security_attribution", "security_text", "specific_returns", "specific_risk", "style_returns",
]
