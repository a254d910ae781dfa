"""Trailing windows of any length at a constant cost a row.

A bounded frame is computed anew for every row, n steps each. Here each value, centred on its group's
mean, is summed from the group's first row on, once, and a window of n rows is the difference of two such sums, n
rows apart. All windows of a table, of whatever lengths, share one sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: A window whose centred sum of squares is under this share of all that was summed so far has no variance but rounding.
NOISE = 1e-13


class Rolling:
    """Trailing moments of columns by group. add() all values first, then frame(df) gives df with the sums, over which the other methods are expressions.

    A null is no observation. NaN and infinite values make the windows that hold them NaN, and no others.
    """

    def __init__(self, by: list[str], order: str) -> None:
        self.by, self.order, self.values, self.pairs = by, order, {}, {}

    def add(self, name: str, x: Column) -> Rolling:
        self.values[name] = x
        return self

    def pair(self, a: str, b: str) -> Rolling:
        """Sums of products of two values, over the rows that have both."""
        self.pairs[f"{a}_{b}"] = (a, b)
        return self

    def frame(self, df: DataFrame) -> DataFrame:
        whole, so_far = W.partitionBy(*self.by), W.partitionBy(*self.by).orderBy(self.order).rowsBetween(W.unboundedPreceding, 0)
        finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)
        df = df.withColumns({f"_r_{k}": x.cast("double") for k, x in self.values.items()})
        df = df.withColumns({f"_c_{k}": F.when(finite(F.col(f"_r_{k}")), F.col(f"_r_{k}")) for k in self.values})
        df = df.withColumns({f"_m_{k}": F.coalesce(F.avg(f"_c_{k}").over(whole), F.lit(0.0)) for k in self.values})
        df = df.withColumns({f"_c_{k}": F.col(f"_c_{k}") - F.col(f"_m_{k}") for k in self.values})
        total = lambda x: F.coalesce(F.sum(x).over(so_far), F.lit(0.0))
        sums: dict[str, Column] = {}
        for k in self.values:
            x = F.col(f"_c_{k}")
            sums |= {f"_n_{k}": F.count(f"_r_{k}").over(so_far), f"_b_{k}": F.count(F.when(F.col(f"_r_{k}").isNotNull() & x.isNull(), 1)).over(so_far), f"_s_{k}": total(x), f"_q_{k}": total(x * x)}
        for k, (a, b) in self.pairs.items():
            x, y = F.col(f"_c_{a}"), F.col(f"_c_{b}")
            both = x.isNotNull() & y.isNotNull()
            sums |= {f"_pn_{k}": F.count(F.when(both, 1)).over(so_far), f"_px_{k}": total(F.when(both, x)), f"_py_{k}": total(F.when(both, y)), f"_pq_{k}": total(x * y)}
        return df.withColumns(sums)

    def clean(self, df: DataFrame) -> DataFrame:
        """df without the helper columns."""
        return df.drop(*(f"_{p}_{k}" for k in self.values for p in "rcmnbsq"), *(f"_{p}_{k}" for k in self.pairs for p in ("pn", "px", "py", "pq")))

    def _last(self, column: str, n: int) -> Column:
        return F.col(column) - F.coalesce(F.lag(column, n).over(W.partitionBy(*self.by).orderBy(self.order)), F.lit(0))

    def _checked(self, value: Column, n: int, *names: str) -> Column:
        bad = sum((self._last(f"_b_{k}", n) for k in names), F.lit(0))
        return F.when(bad > 0, F.lit(math.nan)).otherwise(value)

    def count(self, name: str, n: int) -> Column:
        return self._last(f"_n_{name}", n)

    def mean(self, name: str, n: int) -> Column:
        return self._checked(F.try_divide(self._last(f"_s_{name}", n), self.count(name, n)) + F.col(f"_m_{name}"), n, name)

    def var(self, name: str, n: int) -> Column:
        """Sample variance; null with fewer than two values, and exactly 0 where there is none but rounding."""
        k, s, q = self.count(name, n), self._last(f"_s_{name}", n), self._last(f"_q_{name}", n)
        around = q - F.try_divide(s * s, k)
        value = F.when(around <= NOISE * F.col(f"_q_{name}"), 0.0).otherwise(around)
        return self._checked(F.when(k > 1, value / (k - 1)), n, name)

    def std(self, name: str, n: int) -> Column:
        return F.sqrt(self.var(name, n))

    def covar(self, a: str, b: str, n: int) -> Column:
        """Sample covariance over the rows that have both."""
        k, x, y, q = (self._last(f"_{p}_{a}_{b}", n) for p in ("pn", "px", "py", "pq"))
        return self._checked(F.when(k > 1, (q - F.try_divide(x * y, k)) / (k - 1)), n, a, b)
