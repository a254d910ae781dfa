"""Second and fourth moments of many series, added up in blocks of dates.

Long rows (date, factor, ret) are dealt out by blocks of dates, once. A task sets its block out as a matrix, dates by factors,
and adds products of matrices; the blocks' sums, a row a pair of factors, are added by Spark. Lags need the rows just
before a block, which come along as a halo. A block has at least as many dates as there are factors, so what it gives is no larger than what it
takes, and no join of the rows with themselves is needed.

The factors' names and means and the dates are read first. Both are small whatever the data behind the returns: a row a factor, and one a period.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Dates of a block, at least.
BLOCK = 256


@dataclass(frozen=True)
class Basis:
    """Names of the factors in order, their means, and the dates in order."""

    names: list[str]
    means: np.ndarray
    dates: list

    @property
    def n(self) -> int:
        return len(self.dates)


def basis(returns: DataFrame) -> Basis:
    """Names, means and dates in one pass over the rows; null returns count as absent, but their dates stay."""
    rows = returns.groupingSets([["factor"], ["date"]], "factor", "date").agg(F.grouping_id().alias("g"), F.avg("ret").alias("mean")).collect()
    # Of (factor, date) the bit of the one that is summed over is set: 1 for a factor's row, 2 for a date's.
    factors = sorted((r["factor"], r["mean"]) for r in rows if r["g"] == 1 and r["mean"] is not None)
    return Basis([f for f, _ in factors], np.array([m for _, m in factors]), sorted(r["date"] for r in rows if r["g"] == 2))


def numbered(returns: DataFrame, base: Basis) -> DataFrame:
    """returns with t, the number of the date from 0: a map of one entry a date."""
    kind = dict(returns.dtypes)["date"]
    days = returns.sparkSession.createDataFrame([(d, t) for t, d in enumerate(base.dates)], f"date {kind}, t int")
    return returns.join(F.broadcast(days), "date")  # one row a date


def _matrix(block: pa.Table, names: list[str], means: np.ndarray, first: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The block's returns less the means, 0 where there is none, and 1.0 where there is one."""
    coded = block["factor"].combine_chunks().dictionary_encode()
    place = {x: k for k, x in enumerate(names)}
    at = np.array([place[x] for x in coded.dictionary.to_pylist()], np.int64)
    col, t, x = at[coded.indices.to_numpy(zero_copy_only=False)], block["t"].to_numpy() - first, block["ret"].to_numpy()
    y, m = np.zeros((rows, len(names))), np.zeros((rows, len(names)))
    y[t, col], m[t, col] = x - means[col], 1.0
    return y, m


#: From the block's matrix (halo rows before it), its mask, the halo's length and the weights of its own rows to a K x K sum.
Moment = Callable[[np.ndarray, np.ndarray, int, np.ndarray], np.ndarray]

MOMENTS: dict[str, Moment] = {
    "n": lambda y, m, h, w: m[h:].T @ m[h:],
    "xy": lambda y, m, h, w: (y[h:] * w[:, None]).T @ y[h:],
    "xxyy": lambda y, m, h, w: (y[h:] ** 2).T @ (y[h:] ** 2),
    "xxxy": lambda y, m, h, w: (y[h:] ** 3).T @ y[h:],
}


def lagged(lag: int) -> Moment:
    """Sums of x of a date by y of `lag` dates before."""
    return lambda y, m, h, w: y[h:][max(0, lag - h) :].T @ y[max(0, h - lag) : len(y) - lag] if lag else y[h:].T @ y[h:]


def gram(returns: DataFrame, base: Basis, kinds: dict[str, Moment], lags: int = 0, weights: np.ndarray | None = None, block: int | None = None) -> DataFrame:
    """factor_i, factor_j and a sum for each of kinds, for every pair of factors that share a date (with lags, every pair)."""
    names, means, n = base.names, base.means, base.n
    size = block or max(BLOCK, len(names), lags)
    kinds = kinds if "n" in kinds else {"n": MOMENTS["n"], **kinds}
    all_weights = np.ones(n) if weights is None else weights
    own = F.expr(f"t div {size}").cast("int")
    blocks: Column = own if not lags else F.explode(F.when((F.col("t") % size >= size - lags) & (own < (n - 1) // size), F.array(own, own + 1)).otherwise(F.array(own)))
    rows = numbered(returns.filter(F.col("ret").isNotNull()).select("date", F.col("factor").cast("string").alias("factor"), F.col("ret").cast("double").alias("ret")), base)
    rows = rows.select(blocks.alias("b"), "t", "factor", "ret")

    def sums(key: tuple, table: pa.Table) -> pa.Table:
        b = key[0].as_py()
        start, end = b * size, min(n, (b + 1) * size)
        first = max(0, start - lags)
        y, m = _matrix(table, names, means, first, end - first)
        got = [f(y, m, start - first, all_weights[start:end]) for f in kinds.values()]
        return pa.table([pa.array(np.arange(len(names)), pa.int32()), *(pa.array(list(g), pa.list_(pa.float64())) for g in got)], names=["i", *kinds])

    parts = rows.groupBy("b").applyInArrow(sums, "i int, " + ", ".join(f"{k} array<double>" for k in kinds))
    zipped = parts.select("i", F.posexplode(F.arrays_zip(*kinds)).alias("j", "v")).select("i", "j", "v.*")
    total = zipped.groupBy("i", "j").agg(*(F.sum(k).alias(k) for k in kinds))
    name = lambda at: F.element_at(F.array(*map(F.lit, names)) if names else F.array(F.lit("")), at + 1)
    return total.filter("n > 0" if not lags else F.lit(True)).select(name(F.col("i")).alias("factor_i"), name(F.col("j")).alias("factor_j"), *kinds)
