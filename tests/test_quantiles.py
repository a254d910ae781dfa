"""Exact quantiles by group against NumPy and Spark's own percentile."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.functions.columns import quantiles, winsorize


@pytest.mark.parametrize(("whole", "accuracy"), [(20_000, 10_000), (200, 100), (30, 1000)])
def test_quantiles(spark, whole, accuracy):
    rng = random.Random(7)
    groups = {"wide": [rng.gauss(0, 1) for _ in range(5000)], "ties": [float(rng.randint(0, 3)) for _ in range(4000)], "one": [3.0], "two": [1.0, 2.0], "far": [1e300, -1e300] + [rng.random() for _ in range(3000)], None: [rng.random() for _ in range(500)], "same": [2.0] * 2500}
    rows = [(g, x) for g, v in groups.items() for x in v] + [("nulls", None), ("one", None)]
    rng.shuffle(rows)
    df, ps = spark.createDataFrame(rows, "g string, x double").repartition(5), [0.0, 0.05, 0.31, 0.5, 0.95, 1.0]
    got = {r["g"]: r for r in quantiles(df, "x", "g", ps, whole, accuracy).collect()}
    assert set(got) == {*groups, "nulls"} and got["nulls"]["q2"] is None and got["nulls"]["n"] == 0
    for g, v in groups.items():
        assert got[g]["n"] == len(v) and np.allclose([got[g][f"q{k}"] for k in range(len(ps))], np.quantile(v, ps), rtol=1e-12), g


def test_winsorize_by_brackets(spark):
    df = spark.range(60_000).select(F.lit(1).alias("d"), F.expr("pmod(hash(id), 100003) / 7.0").cast("double").alias("x"))
    lo, hi = df.agg(F.percentile("x", 0.05), F.percentile("x", 0.95)).first()
    for large in (False, True):
        a, b = winsorize(df, "x", "d", large=large).agg(F.min("x"), F.max("x")).first()
        assert abs(a - lo) < 1e-9 and abs(b - hi) < 1e-9
        plan = winsorize(df, "x", "d", large=large)._jdf.queryExecution().optimizedPlan().toString()
        assert " percentile(" not in plan and "collect_list" not in plan
    few = spark.createDataFrame([(1, None), (1, 3.0), (2, None), (3, 1.0), (3, 2.0)], "d int, x double")
    assert sorted((r["d"], repr(r["x"])) for r in winsorize(few, "x", "d", 0.25).collect()) == [(1, "3.0"), (1, "None"), (2, "None"), (3, "1.25"), (3, "1.75")]
