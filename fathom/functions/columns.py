"""Guarded arithmetic and cross-sectional expressions, all on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def ratio(num: Column, den: Column, nan: bool = False) -> Column:
    """num / den where den > 0; null where either is null; null, or NaN if asked for, where den <= 0."""
    return F.when(den > 0, num / den).when(den.isNotNull() & num.isNotNull(), F.lit(float("nan")) if nan else F.lit(None))


def share(part: Column, whole: Column, eps: float = 1e-10) -> Column:
    """100 * part / whole, and 0 where whole is within eps of 0."""
    return F.when(F.abs(whole) > eps, 100 * part / whole).otherwise(0.0)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def zscore(x: Column, *by: str) -> Column:
    """(x - mean) / sample deviation within `by`; null where the deviation is 0 or null."""
    w = W.partitionBy(*by)
    return F.try_divide(x - F.avg(x).over(w), F.nullif(F.stddev_samp(x).over(w), F.lit(0.0)))


#: Accuracy of the sketches that bracket a quantile, and the most rows of a group that are bracketed whole.
ACCURACY = 10_000
WHOLE = 20_000


def quantiles(df: DataFrame, column: str, by: str, ps: list[float], whole: int = WHOLE, accuracy: int = ACCURACY) -> DataFrame:
    """by, n and q0, q1, ..: exact interpolated quantiles of a column in each group, of bounded state at any size.

    A sketch of each group gives, for each p, two values that the ranks wanted surely lie between. Rows below are counted; of those between,
    a few ten-thousandths of the group, equal values are counted together and put in order. Nulls don't count; a group of nulls alone has nulls. NaN
    is the largest value.
    """
    e = 4 / accuracy
    ends = [min(max(p + d, 0.0), 1.0) for p in ps for d in (-e, e)]
    x = df.select(by, F.col(column).cast("double").alias("_x"))
    bounds = x.groupBy(by).agg(F.count("_x").alias("n"), F.percentile_approx("_x", ends, accuracy).alias("_ends"), F.min("_x").alias("_min"), F.max("_x").alias("_max"))
    whole_group = F.col("n") <= whole
    for k in range(len(ps)):
        bounds = bounds.withColumns({f"_a{k}": F.when(whole_group, F.col("_min")).otherwise(F.get("_ends", F.lit(2 * k))), f"_b{k}": F.when(whole_group, F.col("_max")).otherwise(F.get("_ends", F.lit(2 * k + 1)))})
    bounds = bounds.drop("_ends", "_min", "_max")
    # A row a value: below some brackets, or in some; what is above all of them is not looked at again.
    wide = x.filter("_x is not null").join(bounds, F.equal_null(x[by], bounds[by])).drop(bounds[by])
    inside = lambda k: F.col("_x").between(F.col(f"_a{k}"), F.col(f"_b{k}"))
    values = F.array(*(F.when(inside(k), F.struct(F.lit(k).alias("k"), F.col("_x").alias("v"))).when(F.col("_x") < F.col(f"_a{k}"), F.struct(F.lit(k).alias("k"), F.lit(None).cast("double").alias("v"))) for k in range(len(ps))))
    counted = wide.select(by, "n", F.explode(F.array_compact(values)).alias("_p")).groupBy(by, "n", F.col("_p.k").alias("k"), F.col("_p.v").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    place = W.partitionBy(by, "k").orderBy(F.col("v").asc_nulls_first())
    upto = F.sum("c").over(place)
    position = F.element_at(F.array(*map(F.lit, ps)), F.col("k") + 1) * (F.col("n") - 1)
    held = counted.withColumns({"_to": upto, "_from": upto - F.col("c"), "_pos": position}).filter("v is not null")
    at = lambda rank: F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_to")), F.col("v")))
    picked = held.groupBy(by, "n", "k").agg(at(F.floor("_pos")).alias("_lo"), at(F.ceil("_pos")).alias("_hi"), F.max(F.col("_pos") - F.floor("_pos")).alias("_w"))
    q = F.when(F.col("_w") > 0, F.col("_lo") + F.col("_w") * (F.col("_hi") - F.col("_lo"))).otherwise(F.col("_lo"))
    found = picked.groupBy(by).agg(*(F.max(F.when(F.col("k") == k, q)).alias(f"q{k}") for k in range(len(ps))))
    return bounds.select(by, "n").join(found.withColumnRenamed(by, "_by"), F.equal_null(F.col(by), F.col("_by")), "left").drop("_by")


def winsorize(df: DataFrame, column: str, by: str, p: float = 0.05, large: bool = False) -> DataFrame:
    """df with `column` held within its exact [p, 1 - p] percentiles in each group of `by`; nulls stay.

    Groups are sorted, which spills, and read at their ranks: one exchange, and df is computed once. large=True is for groups that one task should not
    sort: the bounds come from quantiles(), which deals every group out, and are joined.
    """
    if large:
        bounds = quantiles(df, column, by, [p, 1 - p]).select(by, F.col("q0").alias("_q0"), F.col("q1").alias("_q1"))
        return df.join(bounds, by).withColumn(column, F.greatest("_q0", F.least("_q1", column))).drop("_q0", "_q1")
    group = W.partitionBy(by)
    df = df.withColumns({"_rank": F.row_number().over(group.orderBy(F.col(column).asc_nulls_last())) - 1, "_n": F.count(column).over(group)})
    at = lambda rank: F.max(F.when(F.col("_rank") == rank, F.col(column))).over(group)
    names = []
    for k, q in enumerate((p, 1 - p)):
        place = q * (F.col("_n") - 1)
        df = df.withColumns({f"_lo{k}": at(F.floor(place)), f"_hi{k}": at(F.ceil(place)), f"_w{k}": place - F.floor(place)})
        names += [f"_lo{k}", f"_hi{k}", f"_w{k}"]
    bound = lambda k: F.when(F.col(f"_w{k}") > 0, F.col(f"_lo{k}") + F.col(f"_w{k}") * (F.col(f"_hi{k}") - F.col(f"_lo{k}"))).otherwise(F.col(f"_lo{k}"))
    held = F.when(F.col(column).isNotNull(), F.greatest(bound(0), F.least(bound(1), F.col(column))))
    return df.withColumn(column, held).drop("_rank", "_n", *names)


def char_sum(x: Column) -> Column:
    """Sum of the character codes of a string."""
    return F.aggregate(F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.ascii(c)), F.lit(0), lambda a, c: a + c)
