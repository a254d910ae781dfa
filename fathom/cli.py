"""Command line: python -m fathom.cli analyze|universe|update|risk."""

from __future__ import annotations

import argparse
import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from fathom.errors import FathomError, PipelineError
from fathom.operators import attribution, covariance, factors, panel, regression
from fathom.sinks import report
from fathom.sources import quotes as q
from fathom.sources.store import Store, default_root
from fathom.sources.universe import SECTOR_CODES, SECTORS, Universe, parse_sector, with_sector


def analyze(quotes: DataFrame, universe: DataFrame | None, symbol: str, benchmark: str | None = "SPY", config: factors.FactorConfig = factors.FactorConfig(), winsor: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(summary, factors) of a symbol's return over the quotes: market, sector, the five styles and the rest.

    universe gives sectors where quotes have none; without a benchmark the market is the mean return.
    """
    if universe is not None and "sector" not in quotes.columns:
        quotes = with_sector(quotes, universe)
    own = panel.compute_returns(quotes)
    market = panel.benchmark_returns(quotes, benchmark) if benchmark else panel.average_market(own)
    rows = panel.factor_panel(quotes, market)
    sector = regression.factor_returns(rows, winsor)
    left = regression.residuals(rows, winsor)
    styles = [f"{f}_score" for f in factors.FACTORS]
    x = factors.scores(rows, config).join(left.select("symbol", "date", "sector", "residual", "w"), ["symbol", "date"])
    f = regression.style_returns(x, styles)
    style = f.select("date", F.explode(F.array(*(F.struct(F.lit(s).alias("factor"), F.col(f"f_{s}").alias("ret")) for s in styles))).alias("r")).select("date", "r.*").filter("ret is not null")
    mine = x.filter(F.col("symbol") == symbol)
    if mine.isEmpty():
        raise PipelineError(f"{symbol} has no date with all factors")
    exposure = mine.select("symbol", "date", F.explode(F.array(F.struct(F.lit("market").alias("factor"), F.lit(1.0).alias("exposure")), F.struct(F.col("sector").alias("factor"), F.lit(1.0).alias("exposure")), *(F.struct(F.lit(s).alias("factor"), F.col(s).alias("exposure")) for s in styles))).alias("e")).select("symbol", "date", "e.*")
    rest = regression.specific_returns(x, styles).filter(F.col("symbol") == symbol)
    parts = attribution.attribution_over_time(exposure, sector.union(style), rest)
    return attribution.portfolio_attribution(parts)


def universe_text(sector: str | None = None, list_sectors: bool = False) -> str:
    u = Universe()
    if list_sectors:
        return "\n".join(f"{c:2} - {s}" for s, c in SECTOR_CODES.items())
    if sector:
        s = parse_sector(sector)
        return "\n".join([f"Sector: {s}", f"Constituents: {len(u.symbols_in_sector(s))}", *(f"  {x}" for x in u.symbols_in_sector(s))])
    return "\n".join([f"Total constituents: {u.size()}", *(f"  {s:30} {len(u.symbols_in_sector(s)):3} stocks" for s in SECTORS)])


def risk_report(returns: DataFrame, symbol: str | None = None, show: tuple[str, ...] = ("covariance", "specific", "regime"), fmt: str = "text", specific_vol: float | None = None, mode: str = "reference") -> str:
    """Correlations and volatilities, specific risk and regime of factor returns (date, factor, ret); the first factor is the market's proxy."""
    out: dict = {}
    cov = covariance.correlation(covariance.ledoit_wolf(returns, "identity", mode))
    rows = cov.orderBy("factor_i", "factor_j").collect()  # K x K
    if "covariance" in show:
        out["covariance"] = {"volatilities": {r["factor_i"]: f"{r['vol_i']:.4f}" for r in rows if r["factor_i"] == r["factor_j"]}, "correlations": {f"{r['factor_i']}/{r['factor_j']}": f"{r['correlation']:.4f}" for r in rows if r["factor_i"] < r["factor_j"]}}
    if "specific" in show and symbol:
        out["specific"] = {"symbol": symbol, "volatility": f"{q.synthetic_specific_risk(symbol) if specific_vol is None else specific_vol:.4f}"}
    if "regime" in show:
        first = returns.agg(F.min("factor")).first()[0]
        r = covariance.detect_regime(returns.filter(F.col("factor") == first).select("date", "ret")).first()
        out["regime"] = {"regime": r["regime"], "scale": f"{r['scale']:.4f}", "short_vol": f"{r['short_vol']:.6f}", "long_vol": f"{r['long_vol']:.6f}"}
    if fmt == "json":
        return json.dumps(out, indent=2)
    lines = []
    for part, values in out.items():
        lines.append(part.upper())
        for k, v in values.items():
            lines += [f"  {k}:", *(f"    {a:<32} {b}" for a, b in v.items())] if isinstance(v, dict) else [f"  {k:<34} {v}"]
    return "\n".join(lines)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="fathom")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze", help="attribute a symbol's return to factors")
    a.add_argument("symbol")
    a.add_argument("--years", type=int, default=5)
    a.add_argument("--store", nargs="?", const=default_root(), help="folder that keeps quotes between runs (without a value: the usual one); none if left out")
    a.add_argument("--no-cache", action="store_true", help="neither read the store nor write to it")
    a.add_argument("--refresh", action="store_true", help="read all quotes anew and store them")
    a.add_argument("--quotes", required=True, help="folder of quotes in Parquet")
    a.add_argument("--until", type=dt.date.fromisoformat, default=dt.date.today())
    u = sub.add_parser("universe", help="list the universe")
    u.add_argument("--sector")
    u.add_argument("--list-sectors", action="store_true")
    d = sub.add_parser("update", help="refresh stored data")
    for flag in ("--quotes", "--fundamentals", "--full"):
        d.add_argument(flag, action="store_true")
    r = sub.add_parser("risk", help="risk of factor returns")
    for flag in ("--covariance", "--specific", "--regime"):
        r.add_argument(flag, action="store_true")
    r.add_argument("--symbol")
    r.add_argument("--format", choices=("text", "json"), default="text")
    r.add_argument("--returns", help="folder of factor returns (date, factor, ret); generated ones if left out")
    args = p.parse_args(argv)
    if args.command == "universe":
        print(universe_text(args.sector, args.list_sectors))
        return 0
    if args.command == "update":
        print("update: load quotes and filings into the store with fathom.sources.store.Store.put")
        return 0
    spark = SparkSession.builder.appName("fathom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if args.command == "risk":
            returns = spark.read.parquet(args.returns) if args.returns else q.synthetic_factor_returns(spark)
            show = tuple(k for k in ("covariance", "specific", "regime") if getattr(args, k)) or ("covariance", "specific", "regime")
            print(risk_report(returns, args.symbol, show, args.format))
        else:
            symbol = args.symbol.upper()
            start, end = q.history(args.years, args.until)
            rows = q.read_quotes(spark, args.quotes).filter(F.col("date").between(F.lit(start), F.lit(end)))
            if args.store:
                symbols = [r[0] for r in rows.select("symbol").distinct().collect()]  # of the market
                rows = Store(spark, args.store).scan_universe(symbols, start, end, lambda missing: rows.filter(F.col("symbol").isin(missing)), args.refresh, not args.no_cache)
            summary, parts = analyze(rows, Universe().frame(spark), symbol)
            print(report.attribution_table(symbol, f"{start} to {end}", summary, parts))
    except FathomError as e:
        print(f"error: {e}")
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
