"""Helpers the operators share: staged tables, distributed ranks and running totals."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: ASCII whitespace that separates words, as a Java and RE2 character class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where the session names none (local tests) a temporary folder is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="fathom-stage-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to a table in the shared folder and read it back: lineage ends here, and a lost executor costs a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fathom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every table that stage() wrote in this application. Call it once their results are written."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/fathom-{spark.sparkContext.applicationId}")
    path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def group_key(name: str) -> Column:
    """A string that is never null: '' for null, else '=' and the value."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def running(df: DataFrame, group: list[str], bucket: str, order: list[str], value: Column, out: str) -> DataFrame:
    """Add `out`: the sum of `value` over the rows before this one in its group, by (bucket, order).

    `bucket` must rise with `order`. Only the small table of bucket sums is summed up along a whole
    group; rows are sorted within one (group, bucket), so a group of any size spreads over many tasks.
    """
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_fx_sum"))
    before = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    start = sums.select(*group, bucket, F.coalesce(F.sum("_fx_sum").over(before), F.lit(0)).alias("_fx_start"))
    inside = W.partitionBy(*group, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    part = df.withColumn("_fx_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return part.join(start, [*group, bucket]).withColumn(out, F.col("_fx_start") + F.col("_fx_in")).drop("_fx_start", "_fx_in")


def with_key(docs: DataFrame) -> DataFrame:
    """_fx_row (all columns), doc_id, text, source where there, and the row's key _fx_k, _fx_th: of doc_id and text."""
    named = [c for c in ("doc_id", "text", "source") if c in docs.columns]
    return docs.select(F.struct("*").alias("_fx_row"), *named, group_key("doc_id").alias("_fx_k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_fx_th"))


#: Words of 64 bits in a sieve, at most: what is broadcast of it is bounded, whatever the number of its keys.
SIEVE_WORDS = 1 << 18


def sieve(rows: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows that may have one of the keys, and those that surely have none; an exact join of the former is still to come, and the latter need not move.

    Each key sets a bit, by hash, of a broadcast table. With very many keys most bits are set and most rows are let through: more is moved then, but nothing is lost.
    """
    slot = F.pmod(F.xxhash64(F.lit(5), *on), F.lit(64 * SIEVE_WORDS))
    bit = F.expr("shiftleft(1L, cast(_fx_slot % 64 as int))")
    set_bits = keys.select(slot.alias("_fx_slot")).groupBy(F.shiftright("_fx_slot", 6).alias("_fx_word")).agg(F.bit_or(bit).alias("_fx_bits"))
    marked = rows.withColumn("_fx_slot", slot).withColumn("_fx_word", F.shiftright("_fx_slot", 6)).join(F.broadcast(set_bits), "_fx_word", "left")
    may = F.coalesce(F.col("_fx_bits").bitwiseAND(bit) != 0, F.lit(False))
    return marked.filter(may).select(*rows.columns), marked.filter(~may).select(*rows.columns)


def drop_keys(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of with_key() whose key is not in gone. What is to go is a written table, so Spark knows its size; only rows that a sieve of its keys lets through are joined with it."""
    keys = ["_fx_k", "_fx_th"]
    gone = stage(gone.select(*keys).distinct(), "gone")
    maybe, stay = sieve(keyed, gone, keys)
    return stay.union(maybe.join(gone, keys, "left_anti").select(*keyed.columns))


#: Keys with more rows than this may meet their side by broadcast instead of in one task.
HOT_ROWS = 256


def join_counted(rows: DataFrame, side: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Inner join of rows with side, which has one row a key and, as n, how many of at most `total` rows have that key.

    Keys with over max(HOT_ROWS, total / 2 ** 16) rows, of which there are at most 2 ** 16, are broadcast,
    so their rows stay where they are; all others are joined as Spark sees fit. n is dropped.
    """
    limit = max(HOT_ROWS, total >> 16)
    hot = F.broadcast(side.filter(F.col(n) > limit).drop(n))
    rest = rows.join(F.broadcast(side.filter(F.col(n) > limit).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(side.filter(F.col(n) <= limit).drop(n), keys))
