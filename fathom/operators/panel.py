"""From quotes to the panel the factors are computed on.

Everything per symbol stands in one window specification, so the panel costs one shuffle by symbol.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

from fathom.schema import require


def by_symbol() -> WindowSpec:
    """A symbol's rows by date."""
    return W.partitionBy("symbol").orderBy("date")


def compute_returns(quotes: DataFrame, price: str = "adjusted_close") -> DataFrame:
    """quotes with asset_returns, price over the symbol's previous price less 1; each symbol's first row goes."""
    require(quotes, "symbol", "date", price)
    ret = F.try_divide(F.col(price), F.lag(price).over(by_symbol())) - 1
    return quotes.withColumn("asset_returns", ret).filter("asset_returns is not null")


def market_cap_proxy(quotes: DataFrame) -> DataFrame:
    """quotes with market_cap = volume * close: there are no shares outstanding."""
    return quotes.withColumn("market_cap", F.col("volume").cast("double") * F.col("close"))


def benchmark_returns(quotes: DataFrame, symbol: str = "SPY") -> DataFrame:
    """date, market_return of one symbol's quotes."""
    return compute_returns(quotes.filter(F.col("symbol") == symbol)).select("date", F.col("asset_returns").alias("market_return"))


def average_market(returns: DataFrame) -> DataFrame:
    """date, market_return: the plain mean of all symbols' returns, where no benchmark is quoted."""
    return returns.groupBy("date").agg(F.avg("asset_returns").alias("market_return"))


def factor_panel(quotes: DataFrame, market: DataFrame) -> DataFrame:
    """date, symbol, adjusted_close, close, volume, asset_returns, market_return, market_cap, on the dates the market has.

    Returns and cap are computed in place, without a self-join. The market is one row a calendar day, some 16 bytes, so it is
    broadcast at any size of the quotes, and the rows stay dealt out by symbol for the factors' windows.
    """
    own = market_cap_proxy(compute_returns(quotes))
    cols = ["date", "symbol", "adjusted_close", "close", "volume", "asset_returns", "market_return", "market_cap"]
    return own.join(F.broadcast(market), "date").select(*cols, *(c for c in ("sector",) if c in quotes.columns))


def by_month(at: Column) -> Column:
    return F.date_trunc("month", at)


def as_of(left: DataFrame, right: DataFrame, key: str, on: str, right_on: str, columns: list[str], bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """left with the columns of the last row of right of the same key whose right_on is at or before left's `on`.

    A union and windows, no range join. A key's history is cut into buckets, which must rise with time: months for dates
    and timestamps, none for other types unless given. What each bucket ends with is carried into later ones over
    one row a key and bucket, so only the rows of one key and bucket are sorted in one task. Ties of right_on are broken by the columns
    themselves in their order, the largest counts. A null key is a key like any other; a null time in right counts never, one in left finds nothing.
    """
    kind = f"struct<{','.join(f'`{c}`:{dict(right.dtypes)[c]}' for c in columns)}>"
    a = left.select(F.struct(*left.columns).alias("_row"), F.col(key).alias("_key"), F.col(on).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_v"))
    no_row = F.lit(None).cast(a.schema["_row"].dataType).alias("_row")
    b = right.filter(F.col(right_on).isNotNull()).select(no_row, F.col(key).alias("_key"), F.col(right_on).alias("_at"), F.lit(0).alias("_side"), F.struct(*columns).alias("_v"))
    rows = a.union(b)
    if bucket is None and dict(left.dtypes)[on].startswith(("date", "timestamp")):
        bucket = by_month
    group = ["_key"]
    if bucket is not None:
        group = ["_key", "_bucket"]
        rows = rows.withColumn("_bucket", bucket(F.col("_at")))
        ends = rows.groupBy(*group).agg(F.max(F.when(F.col("_side") == 0, F.struct("_at", "_v"))).alias("_end"))
        before = W.partitionBy("_key").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
        carried = ends.select("_key", "_bucket", F.last("_end", ignorenulls=True).over(before)["_v"].alias("_v")).filter("_v is not null")
        # Without a time it comes before all rows of its bucket.
        rows = rows.unionByName(carried.withColumn("_side", F.lit(-1)), allowMissingColumns=True)
    w = W.partitionBy(*group).orderBy("_at", "_side", "_v").rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    return out.select("_row.*", *(F.col("_last")[c].alias(c) for c in columns))
