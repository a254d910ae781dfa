"""Reports and tables of bounded results, formatted on the driver."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

WIDTH = 80


@dataclass
class Report:
    """A symbol's results with the time they were made."""

    symbol: str = ""
    period_years: int = 5
    contents: Any = None
    generated_at: dt.datetime = field(default_factory=lambda: dt.datetime.now(dt.timezone.utc))

    def to_json(self) -> str:
        return json.dumps({"symbol": self.symbol, "generated_at": self.generated_at.isoformat(), "period_years": self.period_years, "contents": self.contents}, indent=2, default=str)


def pct(x: float) -> str:
    return f"{x * 100:.2f}%"


def ascii_table(title: str, period: str, head: Sequence[str], rows: Sequence[Sequence[str]], foot: Sequence[tuple[str, str]]) -> str:
    """A fixed-width table: first column 20 wide to the left, the others 12 to the right."""
    line = lambda cells: f"{cells[0]:<20}" + "".join(f" {c:>12}" for c in cells[1:])
    blank = [""] * (len(head) - 2)
    body = [line([k, *blank, v]) for k, v in foot]
    return "\n".join(["", title, f"Period: {period}", "=" * WIDTH, line(head), "-" * WIDTH, *map(line, rows), "-" * WIDTH, *body, "=" * WIDTH, ""])


def markdown_table(title: str, period: str, head: Sequence[str], rows: Sequence[Sequence[str]], foot: Sequence[tuple[str, str]]) -> str:
    row = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([f"# {title}", "", f"**Period:** {period}", "", row(head), row(["---"] * len(head)), *map(row, rows), "", "## Summary", "", *(f"- **{k}:** {v}" for k, v in foot), ""])


#: Lines of the text form.
FACTOR_LINE = "{factor}: {contribution:.2%} (exposure: {exposure:.3f}, return: {factor_return:.2%})"
RISK_LINE = "{factor}: {contribution_pct:.2f}% of risk (exposure: {exposure:.3f}, volatility: {volatility:.2%})"
RETURN_LINES = ("Total Return: {total_return:.2%}", "Factor Return: {factor_return:.2%}", "Specific Return: {specific_return:.2%}", "R-squared: {r_squared:.4f}")
RISK_LINES = ("Total Risk: {total_risk:.2%}", "Factor Risk: {factor_risk:.2%}", "Specific Risk: {specific_risk:.2%}", "95% VaR: {var_95:.2%}", "99% VaR: {var_99:.2%}")


def factor_lines(factors: DataFrame) -> list[str]:
    """One line a factor, in the order of factors: of an attribution, or of a risk summary where there are volatilities."""
    form = RISK_LINE if "volatility" in factors.columns else FACTOR_LINE
    return [form.format(**r.asDict()) for r in factors.collect()]


def _text(head: str, lines: Sequence[str], summary: DataFrame, *more: str) -> str:
    values = summary.first().asDict()
    return "\n".join([head, *("  " + x.format(**values) for x in lines), *("  " + x for x in more), ""])


def security_text(symbol: str, period: str, summary: DataFrame, factors: DataFrame) -> str:
    """A security's attribution as text, a line for each total and each factor."""
    return _text(f"Attribution for {symbol} ({period}):", RETURN_LINES, summary, "Factors:", *("  " + x for x in factor_lines(factors)))


def portfolio_text(name: str, period: str, summary: DataFrame, securities: int) -> str:
    """A portfolio's attribution as text, a line for each total."""
    return _text(f"Portfolio Attribution: {name} ({period})", RETURN_LINES, summary, f"Securities: {securities}")


def risk_text(name: str, period: str, summary: DataFrame) -> str:
    """A risk summary as text."""
    return _text(f"Risk Summary: {name} ({period})", RISK_LINES, summary)


def attribution_table(name: str, period: str, summary: DataFrame, factors: DataFrame, markdown: bool = False) -> str:
    """The table of an attribution: one row a factor, then the totals."""
    s = summary.first()
    head = ("Factor", "Exposure", "Return", "Contribution", "% of Total")
    rows = [(r["factor"], f"{r['exposure']:.4f}", pct(r["factor_return"]), pct(r["contribution"]), f"{r['contribution_pct']:.2f}%") for r in factors.collect()]
    foot = [("Factor Return", pct(s["factor_return"])), ("Specific Return", pct(s["specific_return"])), ("Total Return", pct(s["total_return"])), ("R-squared", f"{s['r_squared']:.4f}")]
    return (markdown_table if markdown else ascii_table)(f"Factor Attribution: {name}", period, head, rows, foot)


def risk_table(name: str, period: str, summary: DataFrame, factors: DataFrame, markdown: bool = False) -> str:
    """The table of a risk summary."""
    s = summary.first()
    money = lambda k: f" (${s[k]:,.2f})" if s[k] is not None else ""
    head = ("Factor", "Exposure", "Volatility", "Risk Contr.", "% of Total")
    rows = [(r["factor"], f"{r['exposure']:.4f}", pct(r["volatility"]), f"{r['contribution']:.6f}", f"{r['contribution_pct']:.2f}%") for r in factors.collect()]
    foot = [
        ("Total Risk", pct(s["total_risk"])), ("Factor Risk", f"{pct(s['factor_risk'])} ({s['factor_ratio'] * 100:.1f}% of total)"),
        ("Specific Risk", f"{pct(s['specific_risk'])} ({s['specific_ratio'] * 100:.1f}% of total)"), ("95% VaR", pct(s["var_95"]) + money("var_95_value")), ("99% VaR", pct(s["var_99"]) + money("var_99_value")),
    ]
    return (markdown_table if markdown else ascii_table)(f"Risk Summary: {name}", period, head, rows, foot)
