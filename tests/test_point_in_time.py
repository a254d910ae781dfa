"""Rows as of a time, by buckets of a key's history, against plain Python; statements as they were known."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from fathom.operators import panel as pn
from fathom.sources import filings as fl

DAY = dt.date(2024, 1, 1)


def brute(left, right):
    out = []
    for k, t, x in left:
        seen = [(u, v, w) for kk, u, v, w in right if kk == k and u is not None and t is not None and u <= t]
        best = max(seen, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]), default=(None, None, None))
        out.append((k, t, x, best[1], best[2]))
    return sorted(out, key=repr)


def history(seed, n=400):
    g = random.Random(seed)
    day = lambda: None if g.random() < 0.05 else DAY + dt.timedelta(g.randrange(400))
    key = lambda: g.choice(["hot"] * 6 + ["a", "b", None])
    left = [(key(), day(), i % 7) for i in range(n)]
    return left + left[:20], [(key(), day(), None if g.random() < 0.1 else g.randrange(5), str(g.randrange(3))) for _ in range(n // 3)] + [("late", DAY + dt.timedelta(900), 1, "x")]


@pytest.mark.parametrize("seed", [1, 2])
def test_as_of_by_buckets(spark, seed):
    left, right = history(seed)
    a = spark.createDataFrame(left, "k string, t date, x int").repartition(3)
    b = spark.createDataFrame(right, "k string, u date, v int, w string").repartition(2)
    want = brute(left, right)
    for bucket in (None, pn.by_month, lambda c: F.year(c), lambda c: F.date_trunc("week", c), lambda c: F.lit(0)):
        got = pn.as_of(a, b, "k", "t", "u", ["v", "w"], bucket)
        assert got.columns == ["k", "t", "x", "v", "w"]
        assert sorted(map(tuple, got.collect()), key=repr) == want
    empty = b.filter("false")
    assert all(r["v"] is None for r in pn.as_of(a, empty, "k", "t", "u", ["v"]).collect()) and pn.as_of(a.filter("false"), b, "k", "t", "u", ["v"]).count() == 0


def test_a_hot_key_is_dealt_out_by_buckets(spark):
    left = spark.range(2000).select(F.lit("hot").alias("k"), F.date_add(F.lit(DAY), (F.col("id") % 700).cast("int")).alias("t"))
    right = left.select("k", F.col("t").alias("u"), F.dayofyear("t").alias("v")).filter("v % 9 = 0")
    got = pn.as_of(left, right, "k", "t", "u", ["v"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 1500
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_ratios_as_of(spark):
    fact = lambda val, end, filed, fy, form="10-K": {"end": end, "val": val, "fy": fy, "fp": "FY", "form": form, "filed": filed}
    tags = {
        "Assets": [fact(100.0, "2023-12-31", "2024-02-10", 2023), fact(200.0, "2024-12-31", "2025-02-10", 2024)],
        "NetIncomeLoss": [fact(10.0, "2023-12-31", "2024-02-12", 2023), fact(40.0, "2024-12-31", "2025-02-10", 2024)],
        "Liabilities": [fact(7.0, "2022-12-31", None, 2022)],
    }
    body = json.dumps({"cik": "0000000007", "facts": {"us-gaap": {k: {"units": {"USD": v}} for k, v in tags.items()}}})
    facts = fl.flatten_company_facts(spark.createDataFrame([(body,)], "value string"))
    own = fl.statements(facts, fl.tag_dim(spark))
    days = [dt.date(2024, 2, 11), dt.date(2024, 2, 12), dt.date(2025, 2, 9), dt.date(2025, 2, 10), dt.date(2026, 1, 1)]
    prices = spark.createDataFrame([(s, d, 5.0, "x") for s in ("A", "B", "other") for d in days], "symbol string, date date, price double, tag string")
    links = spark.createDataFrame([("A", "0000000007"), ("B", "0000000007"), ("A", "0000000007")], "symbol string, cik string")
    got = {(r["symbol"], r["date"]): (r["total_assets"], r["roa"]) for r in fl.ratios_as_of(prices, own, links, "A").collect()}
    # A statement is known once its last fact is.
    want = [(None, None), (100.0, 0.1), (100.0, 0.1), (200.0, 0.2), (200.0, 0.2)]
    assert len(got) == 15 and all([got[s, d] for d in days] == want for s in "AB") and all(got["other", d] == (None, None) for d in days)
    assert all(r["total_assets"] is None for r in fl.ratios_as_of(prices, own, links, "Q").collect())
