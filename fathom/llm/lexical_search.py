"""Ranked lexical search: the k best documents of every item, by exact integer scores.

Postings are a table of (term, document, tf, length) of the terms that items ask for, dealt into buckets by
term and, within a term, by document, so the postings of a frequent term lie in many parts. Items' terms meet them
by joins on the term, each match gets its integer score, and scores are summed by item and document.

Matching every item with every document that shares a frequent word would make a row a pair. Two facts leave
most of them out without losing a result. The k-th best score among any documents is a floor for the item, and its rarest terms
give documents for one. And the terms of an item that cannot reach the floor together cannot bring a document into the
result alone: only documents with one of the other terms are candidates, and only those that the rest can
still lift to the floor are scored in full.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from fathom.llm._common import stage, table

K = 20
#: An item's rarest terms are probed for its floor until they have PROBE * k postings.
PROBE = 64
#: A term's postings lie in so many buckets at most.
SPREAD = 64
#: Bytes of text that become one Arrow batch of terms.
BATCH_BYTES = 8 << 20
#: A row in the table of postings that stands for the document itself; no term is empty.
DOCUMENT = ""


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns before the last, then n, terms and tfs: a text's number of terms, its distinct terms and how often each occurs."""
    # A-Z are lower-cased as bytes; of ASCII only digits and letters stand in terms, of the rest everything.
    find = re.compile(rb"[0-9a-z\x80-\xff]+").findall
    for batch in batches:
        texts, at = batch.column(batch.num_columns - 1), 0
        while at < len(texts):
            n, terms, tfs, ends, begin, seen = [], [], [], [0], at, 0
            while at < len(texts) and seen < BATCH_BYTES:
                text = texts[at].as_py() or b""
                count = Counter(find(text.lower()))
                n.append(count.total())
                terms.extend(count)
                tfs.extend(count.values())
                ends.append(len(terms))
                seen, at = seen + len(text), at + 1
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(terms, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))]
            kept = batch.slice(begin, at - begin).columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), *lists], names=[*batch.schema.names[:-1], "n", "terms", "tfs"])


def term_counts(df: DataFrame, id: str, row: str) -> DataFrame:
    """row (a number), id, n, term, tf for each distinct term of each text; a text without terms gives no row."""
    named = df.select(F.monotonically_increasing_id().alias(row), F.col(id), F.col("text").cast("binary").alias("text"))
    counted = named.mapInArrow(_count_terms, f"{row} long, `{id}` {dict(df.dtypes)[id]}, n long, terms array<string>, tfs array<long>").filter("n > 0")
    both = F.concat(F.array(F.struct(F.lit(DOCUMENT).alias("terms"), F.lit(1).cast("long").alias("tfs"))), F.arrays_zip("terms", "tfs"))
    return counted.select(row, id, "n", F.inline(both).alias("term", "tf"))


def postings(docs: DataFrame, terms: DataFrame, id: str = "doc_id") -> DataFrame:
    """The written table _doc, doc_id, n, term, tf: a row with the term DOCUMENT for each document that has a term, and one for each of `terms` in it."""
    rows = term_counts(docs.select(F.col(id).alias("doc_id"), "text"), "doc_id", "_doc")
    asked = terms.select("term").union(docs.sparkSession.range(1).select(F.lit(DOCUMENT))).distinct()
    found = rows.join(asked, "term", "left_semi").select("_doc", "doc_id", "n", "term", "tf")
    return stage(found.repartition("term", F.pmod("_doc", F.lit(SPREAD))).sortWithinPartitions("term"), "postings")


def search(docs: DataFrame, items: DataFrame, k: int = K, id: str = "doc_id", item: str = "item_id") -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score of the k best documents of each item that score above 0, equal scores by ascending doc_id.

    A null or empty text, on either side, has no terms: such a document is not counted, such an item has no result. Repeated documents, and
    repeated items, are rows of their own; equal scores of equal doc_ids follow each other. A null doc_id comes before others. Long texts are
    read whole. Empty tables give no rows. Further columns are ignored, whatever their names.
    """
    asked = stage(term_counts(items.select(F.col(item).alias("item_id"), "text"), "item_id", "_item").filter(F.col("term") != DOCUMENT).withColumnRenamed("tf", "q").drop("n"), "item-terms")
    posts = postings(docs, asked, id)
    size = posts.filter(F.col("term") == DOCUMENT).agg(F.count(F.lit(1)), F.sum("n")).first()
    n_docs, n_terms = size[0], size[1] or 1
    found = posts.filter(F.col("term") != DOCUMENT)
    # All that a match scores but the term's weight; 64-bit integers throughout.
    found = found.withColumn("part", F.expr(f"(1000000000L * tf) div (1000L * tf + 12L * (75L + (25L * n * {n_docs}L) div {n_terms}L))")).select("_doc", "doc_id", "term", "part")
    stats = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("part").alias("top"))
    weight = F.floor(1000 * F.ln((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1)))
    known = asked.join(stats, "term").withColumn("w", F.col("q") * weight).withColumn("most", F.col("w") * F.col("top")).filter("most > 0")
    known = stage(known.select("_item", "item_id", "term", "df", "w", "most"), "item-weights")

    of_item = W.partitionBy("_item")
    total = lambda x: F.sum(x).alias("score")
    points = F.col("w") * F.col("part")

    # A floor from the documents that the rarest terms find: k of them, scored by all terms.
    before = F.coalesce(F.sum("df").over(of_item.orderBy("df", "term").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    probe = known.withColumn("before", before).filter(F.col("before") < PROBE * k).select("_item", "term", "w")
    first = found.join(probe, "term").groupBy("_item", "_doc").agg(total(points))
    first = first.withColumn("k", F.row_number().over(of_item.orderBy(F.desc("score"), "_doc"))).filter(F.col("k") <= k).select("_item", "_doc")
    whole = found.join(stage(first, "first-found"), "_doc").join(known.select("_item", "term", "w"), ["_item", "term"]).groupBy("_item", "_doc").agg(total(points))
    floor = whole.groupBy("_item").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(0).alias("floor"))

    # Terms that fall short of the floor together are left for the second step.
    least_first = of_item.orderBy("most", "term")
    parted = known.join(floor, "_item", "left").withColumn("floor", F.coalesce("floor", F.lit(0).cast("long")))
    parted = parted.withColumn("weak", F.sum("most").over(least_first.rowsBetween(W.unboundedPreceding, 0)) < F.col("floor"))
    parted = stage(parted.withColumn("rest", F.coalesce(F.sum(F.when(F.col("weak"), F.col("most"))).over(of_item), F.lit(0).cast("long"))), "item-parts")
    strong = parted.filter("not weak").select("_item", "item_id", "term", "w", "floor", "rest")
    some = found.join(strong, "term").groupBy("_item", "_doc").agg(F.first("item_id").alias("item_id"), F.first("doc_id").alias("doc_id"), total(points), F.max(F.col("floor") - F.col("rest")).alias("needs"))
    some = stage(some.filter("score >= needs").drop("needs"), "candidates")
    more = found.drop("doc_id").join(some.drop("score"), "_doc").join(parted.filter("weak").select("_item", "term", "w"), ["_item", "term"]).select("_item", "_doc", "item_id", "doc_id", points.alias("score"))
    scored = some.unionByName(more).groupBy("_item", "_doc").agg(F.first("item_id").alias("item_id"), F.first("doc_id").alias("doc_id"), total("score"))
    rank = F.row_number().over(of_item.orderBy(F.desc("score"), "doc_id", "_doc"))
    return scored.filter("score > 0").withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents), b AS (SELECT row_number() OVER () AS iid, item_id, {_TERMS} AS w FROM benchmark),
post AS (SELECT rid, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d), tf AS (SELECT rid, doc_id, n, term, count(*)::BIGINT AS tf FROM post GROUP BY ALL),
size AS (SELECT count(*)::BIGINT AS big_n, sum(len(w))::BIGINT AS big_l FROM d WHERE len(w) > 0),
df AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM tf, size GROUP BY term, big_n),
q AS (SELECT iid, item_id, term, count(*)::BIGINT AS q FROM (SELECT iid, item_id, unnest(w) AS term FROM b) GROUP BY ALL),
s AS (SELECT iid, item_id, rid, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score FROM q JOIN tf USING (term) JOIN df USING (term), size GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS FIRST, rid) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= {K}
"""


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
