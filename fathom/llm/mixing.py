"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the schedule has the golden-ratio point frac(i * 0.618...), which falls into one source's
interval of the cumulative targets. Slots are ranked within their source, and the ranks share the source's
target in blocks of tokens: rank r takes block r of the source's shuffled stream, and the blocks differ by a word at most.
In the stream each document stands as often as its source is read, up to MAX_EPOCHS times, and once more up to the place where the last reading
ends; its repeats follow each other. So each source gives its target to the word, however small it is.

The slots are the order of the mix: a document, with its repeats, stands where the first slot that reads it stands. As the points are spread evenly, every
beginning of that order holds the sources near their shares: within a few blocks, and the words of the long documents that reach past its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from fathom.llm._common import WORD, group_key, running, stage, table, with_key

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 9_001
#: Slots of the schedule, about; the tokens of a source's blocks follow from its target and its slots.
SLOTS = 1 << 20
GOLDEN = 0.6180339887498949
CELLS = 1024
BUCKET_BITS = 12


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Tokens to take from each source. sizes: _fx_g, source, source_size; adds _fx_w, target, _fx_total.

    Weights repeat along the sources by code point, null last. A target stops at max_epochs times its
    source, and what is over goes to the others by weight. With sources sorted by cap / weight, source k
    is capped if its ratio is below the level that is left once all before it are capped. One row a
    source stands in these windows, never a document.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    whole = W.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("_fx_i") % len(weights) + 1).cast("int")).cast("double")
    cap = F.col("source_size") * float(max_epochs)
    df = sizes.withColumn("_fx_i", F.row_number().over(by_name) - 1).withColumn("_fx_w", w).withColumn("_fx_cap", cap)
    df = df.withColumns({"_fx_ratio": F.col("_fx_cap") / F.col("_fx_w"), "_fx_total": F.sum("source_size").over(whole), "_fx_all_w": F.sum("_fx_w").over(whole)})
    before = W.orderBy("_fx_ratio", "_fx_i").rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumns({"_fx_bc": F.coalesce(F.sum("_fx_cap").over(before), F.lit(0.0)), "_fx_bw": F.coalesce(F.sum("_fx_w").over(before), F.lit(0.0))})
    df = df.withColumn("_fx_level", (F.col("_fx_total") - F.col("_fx_bc")) / (F.col("_fx_all_w") - F.col("_fx_bw")))
    df = df.withColumn("_fx_capped", F.col("_fx_ratio") < F.col("_fx_level"))
    level = F.max(F.when(~F.col("_fx_capped"), F.struct(-F.col("_fx_ratio"), -F.col("_fx_i"), F.col("_fx_level").alias("v")))).over(whole)["v"]
    return df.withColumn("target", F.when(F.col("_fx_capped"), F.col("_fx_cap")).otherwise(F.col("_fx_w") * level)).select("_fx_g", "source", "source_size", "target", "_fx_total")


def schedule(spark: SparkSession, goal: DataFrame, n: int) -> DataFrame:
    """slot, _fx_g, _fx_rank: whose each of n slots is, and its rank there. A source without a slot gets one after the others. goal: what targets() gives."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    total = F.greatest(F.sum("target").over(W.partitionBy()), F.lit(1e-300))
    goal = goal.filter("target > 0").withColumn("_fx_hi", F.sum("target").over(by_name) / total)
    last = F.row_number().over(W.orderBy(F.col("source").desc_nulls_first())) == 1
    goal = goal.withColumn("_fx_hi", F.when(last, F.lit(1.0)).otherwise(F.col("_fx_hi")))
    goal = goal.withColumn("_fx_lo", F.coalesce(F.lag("_fx_hi").over(by_name), F.lit(0.0))).withColumn("_fx_no", F.row_number().over(by_name))
    # A range join as an equi-join: each interval is listed in the cells it touches.
    cell = F.explode(F.sequence(F.floor(F.col("_fx_lo") * CELLS), F.least(F.floor(F.col("_fx_hi") * CELLS), F.lit(CELLS - 1))))
    cells = goal.select("_fx_g", "_fx_lo", "_fx_hi", cell.alias("_fx_cell"))
    slots = spark.range(n).select(F.col("id").alias("slot"), ((F.col("id") * GOLDEN) % 1.0).alias("_fx_u"))
    slots = slots.withColumn("_fx_cell", F.floor(F.col("_fx_u") * CELLS))
    slots = slots.join(cells, "_fx_cell").filter("_fx_u >= _fx_lo and _fx_u < _fx_hi").select("slot", "_fx_g")
    slots = stage(slots, "mix-slots")
    without = goal.join(slots.select("_fx_g").distinct(), "_fx_g", "left_anti").select((F.col("_fx_no") + n - 1).cast("long").alias("slot"), "_fx_g")
    slots = slots.union(without).withColumn("_fx_b", F.expr(f"slot div {max(1, n >> 8)}"))
    return running(slots, ["_fx_g"], "_fx_b", ["slot"], F.lit(1), "_fx_rank").select("slot", "_fx_g", "_fx_rank")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, slots: int = SLOTS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: `keep`, source, size, source_size, target, taken (words, repeats counted), first_slot (its place in the mix; null if nothing is taken).

    A null or empty text has size 0 and takes 0. Null sources are one source, named last. Repeated rows
    are each a part of the stream. An empty table, or one without words, gives targets of 0. The same
    input gives the same result: the shuffle is a seeded hash with ties broken by the kept columns.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        *keep, F.col("source"), group_key("source").alias("_fx_g"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), text).alias("_fx_h"),
    )
    rows = stage(rows.withColumn("_fx_b", F.shiftright("_fx_h", 64 - BUCKET_BITS)), "mix-rows")
    sizes = rows.groupBy("_fx_g").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    goal = stage(targets(sizes, weights, max_epochs), "mix-targets")
    total = (goal.agg(F.max("_fx_total")).first()[0]) or 0
    wide = rows.join(goal.select("_fx_g", "source_size", "target"), "_fx_g")
    if total == 0:
        return wide.select(*keep, "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    plan = stage(schedule(docs.sparkSession, goal, min(slots, total)), "mix-schedule")
    words_sql = f"least(floor(target + 0.5), source_size * {max_epochs})"
    # A source's words to take, and its slots: rank r takes its words from r * words div slots on, so the last slot ends with the last word.
    blocks = goal.join(plan.groupBy("_fx_g").agg(F.count(F.lit(1)).alias("_fx_slots")), "_fx_g").select("_fx_g", F.expr(words_sql).alias("_fx_t"), "_fx_slots")
    # monotonically_increasing_id is stable here: it numbers a staged table.
    at = running(stage(wide.withColumn("_fx_id", F.monotonically_increasing_id()), "mix-wide"), ["_fx_g"], "_fx_b", ["_fx_h", *keep, "_fx_id"], F.col("size"), "_fx_at")
    at = stage(at, "mix-offsets")
    read = at.filter("size > 0").select("_fx_id", "_fx_g", "_fx_at", "size", "source_size").join(stage(blocks.filter("_fx_t > 0"), "mix-blocks"), "_fx_g")
    # What of the first n words of a source is taken: n in each whole reading, and what the last reading has of them.
    upto = lambda n: F.expr(f"(_fx_t div source_size) * ({n}) + least({n}, _fx_t % source_size)")
    read = read.withColumns({"_fx_lo": upto("_fx_at"), "_fx_to": upto("_fx_at + size")}).filter("_fx_to > _fx_lo")
    # Word x of a source is in block ((x + 1) * slots - 1) div words; decimals, as the product may be past a long.
    block = lambda x: F.expr(f"(cast({x} + 1 as decimal(19)) * cast(_fx_slots as decimal(18)) - 1) div cast(_fx_t as decimal(19))")
    start = lambda r: F.expr(f"({r}) * (_fx_t div _fx_slots) + ({r}) * (_fx_t % _fx_slots) div _fx_slots")
    pieces = read.select("_fx_id", "_fx_g", "_fx_lo", "_fx_to", "_fx_t", "_fx_slots", F.explode(F.sequence(block("_fx_lo"), block("_fx_to - 1"))).alias("_fx_rank"))
    pieces = pieces.join(plan, ["_fx_g", "_fx_rank"])
    part = F.least(F.col("_fx_to"), start("_fx_rank + 1")) - F.greatest(F.col("_fx_lo"), start("_fx_rank"))
    taken = pieces.groupBy("_fx_id").agg(F.sum(part).alias("_fx_taken"), F.min("slot").alias("first_slot"))
    out = at.join(taken, "_fx_id", "left")
    return out.select(*keep, "source", "size", "source_size", "target", F.coalesce("_fx_taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def resample(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix as rows: each row of docs as often as the schedule takes its words, to the nearest whole number, with all its columns."""
    keyed = with_key(docs)
    copies = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5)
    plan = mix(keyed, weights, keep=("_fx_k", "_fx_th")).groupBy("_fx_k", "_fx_th").agg(F.sort_array(F.collect_list(copies), asc=False).alias("_fx_times"))
    plan = stage(plan.filter(F.get("_fx_times", F.lit(0)) > 0), "mix-plan")
    again = lambda df, n: df.select("_fx_row", F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("_fx_copy")).select("_fx_row.*")
    once = plan.filter(F.size("_fx_times") == 1)
    # The plan grows with docs, so it is never broadcast, at no size.
    out = again(keyed.join(once.hint("merge"), ["_fx_k", "_fx_th"]), F.get("_fx_times", F.lit(0)))
    # Rows that repeat wholly share a key: each takes one of the key's entries.
    if not (many := plan.filter(F.size("_fx_times") > 1)).isEmpty():
        nth = F.row_number().over(W.partitionBy("_fx_k", "_fx_th").orderBy(F.hash("_fx_row")))
        numbered = keyed.join(many.hint("merge"), ["_fx_k", "_fx_th"]).withColumn("_fx_n", F.get("_fx_times", nth - 1)).filter("_fx_n > 0")
        out = out.union(again(numbered, F.col("_fx_n")))
    return out


def op9_mix_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "first_slot")
