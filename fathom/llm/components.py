"""Connected components of a distributed edge list, by alternating large-star and small-star steps.

Each step sends a node's neighbours to the smallest node it has seen. Minima are combined before the
shuffle, and the rows of nodes with very many neighbours meet their minimum in a broadcast of at most
2 ** 16 rows (see join_counted), so no node is a single task's load. Nothing reaches the driver but two sums per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fathom.llm._common import join_counted, stage

#: A round's table is written by a task for each TASK_ROWS rows, a small one by TASKS tasks at most, whatever the shuffles are set to.
TASK_ROWS, TASKS = 1 << 16, 64


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component, for every node that has an edge. edges: a, b (long)."""
    now, before = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges"), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        if mark == before:
            leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return leaves.union(leaves.select(F.col("root").alias("node"), "root")).distinct()
        before, tasks = mark, max(TASKS, 2 * mark[0] // TASK_ROWS)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_counted(both.filter("v > u"), stage(low.coalesce(tasks), "least"), ["u"], "n", 2 * mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stage(large.coalesce(tasks), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_counted(large, stage(low.coalesce(tasks), "least"), ["u"], "n", 2 * mark[0]).select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        now = stage(small.select("e.u", F.col("e.m").alias("v")).filter("u <> v").distinct().coalesce(tasks), "small-star")


def joined(roots: DataFrame, more: DataFrame) -> DataFrame:
    """roots, as components() returns them, with further edges a, b: only the roots that these join are gone through again."""
    of = lambda n: roots.select(F.col("node").alias(n), F.col("root").alias(f"r{n}"))
    ends = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    over = components(ends)
    sizes = stage(roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root-sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tops = sizes.join(over.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("root", F.coalesce("top", "root").alias("top"), "n")
    moved = join_counted(roots, stage(tops, "tops"), ["root"], "n", total).select("node", F.col("top").alias("root"))
    return moved.union(over.select("node", "root")).distinct()
