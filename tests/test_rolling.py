"""Trailing windows by running sums against bounded frames."""

import math
import random

from pyspark.sql import Window as W, functions as F

from fathom.operators import factors
from fathom.operators.rolling import Rolling


def rows(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for s in ("a", "b", "c"):
        for d in range(n):
            x = None if rng.random() < 0.05 else rng.gauss(100.0 if s == "b" else 0, 0.01)
            y = None if rng.random() < 0.05 else 5.0 if s == "c" and 100 <= d < 150 else rng.gauss(0, 2)
            out.append((s, d, x, y))
    return out


def test_moments_equal_bounded_frames(spark):
    df = spark.createDataFrame(rows(), "s string, d int, x double, y double")
    r = Rolling(["s"], "d").add("x", F.col("x")).add("y", F.col("y")).pair("x", "y")
    for n in (1, 2, 7, 63):
        w = W.partitionBy("s").orderBy("d").rowsBetween(1 - n, 0)
        mine = {"c": r.count("x", n), "m": r.mean("x", n), "v": r.var("x", n), "sd": r.std("y", n), "cov": r.covar("x", "y", n)}
        both = F.col("x").isNotNull() & F.col("y").isNotNull()
        frames = {"c": F.count("x").over(w), "m": F.avg("x").over(w), "v": F.var_samp("x").over(w), "sd": F.stddev_samp("y").over(w), "cov": F.covar_samp(F.when(both, F.col("x")), F.when(both, F.col("y"))).over(w)}
        got = {(q["s"], q["d"]): q for q in r.frame(df).select("s", "d", *(c.alias(k) for k, c in mine.items())).collect()}
        for q in df.select("s", "d", *(c.alias(k) for k, c in frames.items())).collect():
            for k in mine:
                a, b = got[q["s"], q["d"]][k], q[k]
                assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)), (n, k, q, a)


def test_a_window_without_variance_has_none(spark):
    df = spark.createDataFrame([("a", d, 1e6 + (d % 5 if d < 50 else 3)) for d in range(100)], "s string, d int, x double")
    r = Rolling(["s"], "d").add("x", F.col("x"))
    got = [q[0] for q in r.frame(df).orderBy("d").select(r.var("x", 10)).collect()]
    assert got[0] is None and all(v > 0 for v in got[9:50]) and all(v == 0.0 for v in got[60:])


def test_bad_values_stay_in_their_windows(spark):
    df = spark.createDataFrame([("a", d, math.nan if d == 20 else math.inf if d == 40 else float(d % 7)) for d in range(80)], "s string, d int, x double")
    r = Rolling(["s"], "d").add("x", F.col("x"))
    got = [q[0] for q in r.frame(df).orderBy("d").select(r.mean("x", 5)).collect()]
    assert all(math.isnan(v) == (20 <= d < 25 or 40 <= d < 45) for d, v in enumerate(got))


def test_no_bounded_frame_in_the_plan(spark):
    panel = spark.createDataFrame([("a", 1, 1.0, 1.0, 1, 0.1, 0.1, 1.0)], "symbol string, date int, adjusted_close double, close double, volume long, asset_returns double, market_return double, market_cap double")
    plan = factors.raw_factors(panel)._jdf.queryExecution().executedPlan().toString()
    # The only frames with a lower bound are single rows, of lag().
    frames = [f for f in plan.replace("$", "").split("specifiedwindowframe(RowFrame, ")[1:] if not f.startswith("unboundedpreceding")]
    assert all(f.split(",")[0].strip() == f.split(",")[1].split(")")[0].strip() for f in frames)
    assert plan.count("Exchange") == 1
