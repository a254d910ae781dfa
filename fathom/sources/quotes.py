"""Quote scans from files, and the demonstration panel made of the bundled tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fathom.errors import DataError, InvalidDateRange, MissingData
from fathom.schema import conform

#: Calendar days that a year of history means, for parity with the model this follows.
DAYS_PER_YEAR = 252


def check_range(start: dt.date, end: dt.date) -> None:
    if start > end:
        raise InvalidDateRange(f"{start} is after {end}")


def history(years: int, until: dt.date, days_per_year: int = DAYS_PER_YEAR) -> tuple[dt.date, dt.date]:
    """First and last date of `years` of history."""
    return until - dt.timedelta(days=years * days_per_year), until


def read_quotes(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Quotes of any file source, with the columns and types of the quotes schema."""
    return conform(spark.read.format(fmt).options(**options).load(path), "quotes")


def scan_quotes(quotes: DataFrame, symbols: Iterable[str] | str, start: dt.date, end: dt.date, strict: bool = True) -> DataFrame:
    """Rows of the symbols within [start, end], a filter that reaches the files. strict: an error if there are none."""
    check_range(start, end)
    names = [symbols] if isinstance(symbols, str) else list(symbols)
    if not names or "" in names:
        raise DataError("no symbol is named")
    out = quotes.filter(F.col("symbol").isin(names) & F.col("date").between(F.lit(start), F.lit(end)))
    if strict and out.isEmpty():
        raise MissingData(f"no quotes of {', '.join(names[:5])} from {start} to {end}")
    return out


def scan_available(quotes: DataFrame, symbols: Iterable[str], start: dt.date, end: dt.date) -> tuple[DataFrame, DataFrame]:
    """(rows, missing): scan_quotes() of the symbols that have quotes in the range, and the others (symbol), which it skips."""
    names = list(dict.fromkeys(symbols))
    rows = scan_quotes(quotes, names, start, end, strict=False)
    asked = quotes.sparkSession.createDataFrame([(s,) for s in names], "symbol string")
    return rows, asked.join(rows.select("symbol").distinct(), "symbol", "left_anti")


def demo_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier-month panel as quotes: symbol, date (month), close (price over quantity), adjusted_close, volume, sector (region)."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    item = read("lineitem").select("l_suppkey", F.trunc(F.to_date("l_shipdate"), "month").alias("date"), "l_extendedprice", "l_quantity")
    month = item.groupBy("l_suppkey", "date").agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").cast("long").alias("volume"))
    place = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "r_name")
    # Aggregated first: the dimension meets one row per supplier and month.
    df = month.join(place, F.col("l_suppkey") == F.col("s_suppkey"))
    return df.select(F.col("l_suppkey").cast("string").alias("symbol"), "date", "close", F.col("close").alias("adjusted_close"), "volume", F.col("r_name").alias("sector"))


def demo_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, ret: the return of the price over quantity of all that ships on a day."""
    from fathom.operators.panel import compute_returns

    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    day = item.groupBy(F.to_date("l_shipdate").alias("date")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("adjusted_close"))
    return compute_returns(day.withColumn("symbol", F.lit("all"))).select("date", F.col("asset_returns").alias("ret"))


#: Fixed values: (factor, amplitude, frequency, second amplitude, second frequency, whether the second wave is a sine).
WAVES = (
    ("Value", 0.0008, 12.0, 0.0002, 3.0, False),
    ("Momentum", 0.001, 8.0, 0.0003, 20.0, True),
    ("Size", 0.0005, 6.0, 0.0001, 15.0, False),
    ("Volatility", -0.0012, 10.0, 0.0004, 25.0, True),
    ("Quality", 0.0006, 5.0, 0.0001, 12.0, False),
    ("Growth", 0.0015, 9.0, 0.0005, 18.0, True),
    ("Liquidity", 0.0007, 15.0, 0.0003, 30.0, False),
)


def synthetic_factor_returns(spark: SparkSession, periods: int = 252, start: dt.date = dt.date(2024, 1, 1)) -> DataFrame:
    """date, factor, ret: two waves per factor over `periods` days, the same each time."""
    waves = spark.createDataFrame([*WAVES], "factor string, a double, f double, b double, g double, sine boolean")
    x = F.col("t") / periods
    ret = F.col("a") * F.sin(x * F.col("f")) + F.col("b") * F.when(F.col("sine"), F.sin(x * F.col("g"))).otherwise(F.cos(x * F.col("g")))
    days = spark.range(periods).select(F.col("id").cast("int").alias("t"))
    rows = days.select("t", F.explode(F.array(*(F.lit(w[0]) for w in WAVES))).alias("factor")).join(F.broadcast(waves), "factor")  # seven rows
    return rows.select(F.date_add(F.lit(start), F.col("t")).alias("date"), "factor", ret.alias("ret"))


def synthetic_specific_risk(symbol: str) -> float:
    """15 to 25 % by the sum of the symbol's character codes."""
    return 0.15 + sum(map(ord, symbol)) % 100 / 1000
