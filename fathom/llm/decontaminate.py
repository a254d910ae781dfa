"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of every WINDOW consecutive word k-grams of a document the one with the smallest hash is kept. A
benchmark window of SPAN = K + WINDOW - 1 words that occurs in a document thus has one of its
k-grams kept there, wherever it stands. Kept k-grams meet those of the benchmark in a join, each
hit is extended to both sides word by word, and a run of SPAN words or more is a hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fathom.llm._common import drop_keys, group_key, stage, table, with_key

SPAN = 10
K = 4
WINDOW = SPAN - K + 1
#: k-grams of the benchmark that are broadcast at a time (some 200 bytes each); a larger benchmark is joined part by part.
BROADCAST_ROWS = 200_000
#: Low bits of a kept value that hold its position; the rest is the k-gram's hash. Hits are compared word by word.
POS_BITS = 30
POS_MASK = (1 << POS_BITS) - 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z; lower() would also change other letters, and translate() is slow on plain text."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(low, SEPARATORS), "")


def _grams(hashes: str, n: Column, k: int) -> Column:
    """Hash of each k consecutive word hashes, its low bits cleared."""
    gram = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*(F.get(hashes, i + t) for t in range(k))).bitwiseAND(F.lit(~POS_MASK)))
    return F.when(n >= k, gram).otherwise(F.array().cast("array<bigint>"))


def _items(benchmark: DataFrame) -> DataFrame:
    """item (string), words, n for every item with a word. A null item_id counts as ''."""
    df = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("iw"))
    return df.withColumn("n", F.size("iw")).filter("n > 0")


def _docs(docs: DataFrame) -> DataFrame:
    """A row per document with its words and word hashes; rows are told apart by doc_id and a hash of the text."""
    df = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), words_of(F.col("text")).alias("words"))
    return df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w))).withColumn("n_words", F.size("words").cast("long"))


def _winnow(docs: DataFrame) -> DataFrame:
    """docs with kept: the values of the chosen k-grams, hash and position in one long."""
    packed = F.transform(_grams("h", F.size("h"), K), lambda g, i: g.bitwiseOR(i.cast("long")))
    df = docs.withColumn("v", packed)
    windows = F.transform(F.sequence(F.lit(0), F.size("v") - WINDOW), lambda j: F.least(*(F.get("v", j + t) for t in range(WINDOW))))
    kept = F.when(F.size("v") >= WINDOW, F.array_distinct(windows)).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn("kept", kept).drop("h", "v")


def _long_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, th, n_words, and lo, hi, item of each hit; also a row without a hit for each document."""
    grams = items.filter(F.col("n") >= SPAN).withColumn("h", F.transform("iw", lambda w: F.xxhash64(w)))
    grams = grams.select("item", "iw", F.posexplode(_grams("h", F.col("n"), K)).alias("q", "fp"))
    side = SPAN - K
    grams = grams.select("fp", "item", F.least("q", F.lit(side)).alias("iq"), F.slice("iw", F.greatest(F.col("q") - side, F.lit(0)) + 1, K + 2 * side).alias("ctx"))
    # The slice starts `side` words before the k-gram or at the item's start, so it holds all that a hit can reach.
    grams = stage(grams, "benchmark-grams")
    parts = max(1, -(-grams.count() // BROADCAST_ROWS))
    winnowed = _winnow(docs)
    out = None
    for part in range(parts):
        some = grams if parts == 1 else grams.filter(F.pmod(F.xxhash64("fp"), F.lit(parts)) == part)
        mark = F.array(F.lit(None).cast("long")) if part == 0 else F.array().cast("array<bigint>")
        rows = winnowed.select("doc_id", "th", "n_words", "words", F.explode(F.concat(mark, "kept")).alias("v")).withColumn("fp", F.col("v").bitwiseAND(F.lit(~POS_MASK)))
        rows = rows.join(F.broadcast(some), "fp", "left").filter("v is null or item is not null")
        pos = F.col("v").bitwiseAND(F.lit(POS_MASK)).cast("int")
        same = lambda t: F.coalesce(F.get("words", pos + t) == F.get("ctx", F.col("iq") + t), F.lit(False))
        left, right = F.lit(side), F.lit(side)
        for t in range(side, 0, -1):
            left = F.when(~same(-t), F.lit(t - 1)).otherwise(left)
            right = F.when(~same(K + t - 1), F.lit(t - 1)).otherwise(right)
        whole = same(0)
        for t in range(1, K):
            whole = whole & same(t)
        rows = rows.withColumns({"left": left, "right": right, "whole": whole, "pos": pos})
        hit = F.col("whole") & (F.col("left") + F.col("right") + K >= SPAN)
        rows = rows.filter(F.col("v").isNull() | hit).select("doc_id", "th", "n_words", (F.col("pos") - F.col("left")).alias("lo"), (F.col("pos") + K + F.col("right")).alias("hi"), "item")
        out = rows if out is None else out.union(rows)
    return out


def _joined_grams(n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda i: F.xxhash64(F.array_join(F.slice("words", i + 1, n), " ")))


def _short_hits(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """Hits of items with fewer than SPAN words, each a window as it stands: all n-grams of that length are compared."""
    short = stage(items.filter(F.col("n") < SPAN).select("item", "iw", "n", F.xxhash64(F.array_join("iw", " ")).alias("fp")), "short-items")
    out = None
    for n in sorted(r[0] for r in short.select("n").distinct().collect()):  # at most SPAN - 1 lengths
        some = short.filter(F.col("n") == n)
        if some.count() <= BROADCAST_ROWS:
            some = F.broadcast(some)
        gram = _joined_grams(n)
        rows = docs.filter(F.size("words") >= n).select("doc_id", "th", "n_words", "words", F.posexplode(gram).alias("lo", "fp"))
        rows = rows.join(some, "fp").filter(F.slice("words", F.col("lo") + 1, n) == F.col("iw"))
        rows = rows.select("doc_id", "th", "n_words", "lo", (F.col("lo") + n).alias("hi"), "item")
        out = rows if out is None else out.union(rows)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, th, n_words, n_hit, n_items, items_sha256, contaminated: a row for each row of docs.

    A null or empty text has no words. Items without words never occur; items of the same id are one
    item, a null id is ''. Repeated rows give repeated results; empty tables give no rows or no
    hits; further columns are ignored. th is a hash of the text, with doc_id the row's key.
    """
    items, rows = stage(_items(benchmark), "benchmark-items"), _docs(docs)
    hits = _long_hits(rows, items)
    short = _short_hits(rows, items)
    if short is not None:
        hits = hits.union(short)
    spans = F.collect_set(F.when(F.col("lo").isNotNull(), F.struct("lo", "hi")))
    df = hits.groupBy("doc_id", "th", "n_words").agg(spans.alias("spans"), F.collect_set("item").alias("ids"), F.sum(F.when(F.col("lo").isNull(), 1)).alias("m"))
    start = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))
    step = lambda a, s: F.struct(F.greatest(a["to"], s["hi"]).alias("to"), (a["n"] + F.greatest(s["hi"] - F.greatest(s["lo"], a["to"]), F.lit(0))).alias("n"))
    df = df.withColumn("n_hit", F.aggregate(F.array_sort("spans"), start, step)["n"])
    df = df.withColumn("_fx_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    return df.select(
        "doc_id", "th", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("ids"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_winnow_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a benchmark window, with all their columns."""
    hit = contamination(docs, benchmark).filter("contaminated").select(group_key("doc_id").alias("_fx_k"), F.col("th").alias("_fx_th"))
    return drop_keys(with_key(docs), hit).select("_fx_row.*")


OP3_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT item, least(len(w), {SPAN}) AS k, unnest(list_transform(range(greatest(len(w) - {SPAN} + 1, 1)), lambda i: array_to_string(w[i + 1 : i + {SPAN}], ' '))) AS gram FROM b WHERE len(w) > 0
), lens AS (SELECT DISTINCT k FROM win
), pos AS (
  SELECT rid, k, i, array_to_string(w[i + 1 : i + k], ' ') AS gram FROM (SELECT rid, w, k, unnest(range(len(w) - k + 1)) AS i FROM d, lens WHERE len(w) >= k)
), hit AS (SELECT rid, pos.k, i, item FROM pos JOIN win ON pos.k = win.k AND pos.gram = win.gram
), agg AS (
  SELECT rid, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items_sha256 FROM hit GROUP BY rid
), covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hit) GROUP BY rid)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN agg USING (rid) LEFT JOIN covered USING (rid)
"""
