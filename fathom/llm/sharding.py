"""Proportional stratified interleaving: every shard has the mixture of the whole.

Rows are shuffled by a seeded hash within each source, ranked, and sorted by the fraction
(rank + 1/2) / rows of the source. Cutting that order into equal counts gives shards whose
sources are each within a few rows of their share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fathom.llm._common import group_key, running, stage, table

SHARDS = 40
SEED = 20_240
#: log2 of the buckets that a source, and the whole, are sorted in.
BUCKET_BITS = 12


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: the columns of `keep`, source, size, text_crc32, law, shard, slot, grown_shard.

    Law `rows`: counts differ by one at most. A null text counts as empty, null sources are a
    source of their own, repeated rows are placed one by one (their order among each other has no
    effect on the result as a set), an empty table gives no rows, and further columns are ignored.
    Only these narrow rows are shuffled, never the texts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        *keep,
        F.col("source"),
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        group_key("source").alias("_fx_g"),
        F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), text).alias("_fx_h"),
    )
    narrow = stage(narrow.withColumn("_fx_b", F.shiftright("_fx_h", 64 - BUCKET_BITS)), "shard-rows")
    tie = ["_fx_h", *keep, "text_crc32", "size"]
    of_source = narrow.groupBy("_fx_g").agg(F.count(F.lit(1)).alias("_fx_n"))
    ranked = running(narrow, ["_fx_g"], "_fx_b", tie, F.lit(1), "_fx_rank").join(of_source, "_fx_g")
    part = (F.col("_fx_rank") * 2 + 1) / (F.col("_fx_n") * 2)
    placed = stage(ranked.select(*narrow.columns, part.alias("_fx_part")).withColumn("_fx_b", F.floor(F.col("_fx_part") * (1 << BUCKET_BITS))), "shard-ranks")
    placed = running(placed, [], "_fx_b", ["_fx_part", "_fx_g", *tie], F.lit(1), "_fx_pos")
    n = F.lit(max(1, narrow.count()))
    shard_no = F.expr("_fx_pos * _fx_shards div _fx_total")
    first = F.expr("(_fx_shard * _fx_total + _fx_shards - 1) div _fx_shards")
    return (
        placed.withColumns({"_fx_total": n, "_fx_shards": F.lit(shards).cast("long")})
        .withColumn("_fx_shard", shard_no)
        .select(
            *keep, "source", "size", "text_crc32", F.lit("rows").alias("law"),
            F.col("_fx_shard").cast("int").alias("shard"), (F.col("_fx_pos") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op2_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "source")
