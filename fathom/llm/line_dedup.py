"""Line dedup by winnowing over line hashes, in DataFrame operations only.

Of every RUN consecutive lines that hold a word the one with the smallest hash (the leftmost of
equals) is chosen as a fingerprint, so any two equal runs of RUN lines share one. A text of fewer lines is a
run as it stands, and so is a single line of LONG_LINE words or more, wherever it stands. Positions
whose fingerprint was chosen more than once are joined on it; around each, the run is followed to
both sides over the neighbouring lines' hashes, and met with the first place of the same lines. Places that follow
each other in both texts are one run, so a match reaches as far to both sides as the lines agree. Of equal runs the first in the order (doc_id,
text hash, line) stays and all lines of later ones are deleted. Lines are compared by two independent 64-bit hashes of
each, so lines that differ are taken for equal once in some 1e38 pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from fathom.llm._common import SPACE, WORD, group_key, join_counted, stage, table

RUN = 3
LONG_LINE = 50


def _text_lines() -> Column:
    return F.split("_fx_text", "\n", -1)


def _content() -> Column:
    """Numbers of the lines with a word."""
    marked = F.transform(_text_lines(), lambda x, i: F.when(x.rlike(f"[^{SPACE}]"), i))
    return F.filter(marked, lambda i: i.isNotNull())


def _hashed(docs: DataFrame, long_line: int) -> DataFrame:
    """doc_id, th, h and g (two hashes of each line with a word), long (numbers of the long ones)."""
    lines = F.filter(_text_lines(), lambda x: x.rlike(f"[^{SPACE}]"))
    # A line of that many words has that many characters and a space between each two.
    is_long = lambda x: F.when(F.char_length(x) >= 2 * long_line - 1, F.regexp_count(x, F.lit(WORD)) >= long_line).otherwise(F.lit(False))
    df = docs.select("doc_id", F.col("_fx_th").alias("th"), lines.alias("lines")).filter(F.size("lines") > 0)
    numbers = F.filter(F.transform("lines", lambda x, i: F.when(is_long(x), i)), lambda i: i.isNotNull())
    return df.select("doc_id", "th", F.transform("lines", lambda x: F.xxhash64(x)).alias("h"), F.transform("lines", lambda x: F.xxhash64(F.lit("second"), x)).alias("g"), numbers.alias("long"))


def _places(rows: DataFrame, run: int) -> DataFrame:
    """rows with fps, the fingerprints chosen (a position once), and runs: (fp, at, n, k1, k2) of every run."""
    least = F.transform(F.sequence(F.lit(0), F.size("h") - run), lambda j: F.array_min(F.slice("h", j + 1, run)))
    rows = rows.withColumn("m", F.when(F.size("h") >= run, least).otherwise(F.array().cast("array<bigint>")))
    place = F.transform("m", lambda m, j: j + F.array_position(F.slice("h", j + 1, run), m).cast("int"))
    one = lambda fp, at, n, k1, k2: F.struct(fp.alias("fp"), at.cast("int").alias("at"), n.cast("int").alias("n"), k1.alias("k1"), k2.alias("k2"))
    tagged = lambda tag, x: F.xxhash64(F.lit(tag), x)
    runs = F.transform("m", lambda m, j: one(m, j, F.lit(run), F.xxhash64(F.slice("h", j + 1, run)), F.xxhash64(F.slice("g", j + 1, run))))
    whole = F.when(F.size("h") < run, F.array(one(tagged("whole", F.col("h")), F.lit(0), F.size("h"), tagged("whole", F.col("h")), tagged("whole", F.col("g"))))).otherwise(F.slice(runs, 1, 0))
    lines = F.transform("long", lambda i: one(tagged("line", F.get("h", i)), i, F.lit(1), tagged("line", F.get("h", i)), tagged("line", F.get("g", i))))
    chosen = F.transform(F.array_distinct(place), lambda p: F.get("h", p - 1))
    return rows.withColumn("fps", F.concat(chosen, F.transform(whole, lambda x: x["fp"]), F.transform(lines, lambda x: x["fp"]))).withColumn("runs", F.concat(runs, whole, lines)).drop("m", "h", "g", "long")


def later_runs(docs: DataFrame, run: int = RUN, long_line: int = LONG_LINE) -> DataFrame:
    """doc_id, th, at, lines, of_doc, of_th, of_at: the runs of a document's lines with a word that stand at of_at in of_doc before. docs: doc_id, _fx_th, _fx_text.

    Each is as long as both texts agree, where the first place of its parts is the same.
    """
    rows = stage(_hashed(docs, long_line), "line-hashes")
    placed = _places(rows, run)
    shared = stage(placed.select(F.explode("fps").alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "shared-lines")
    total = shared.agg(F.sum("c")).first()[0] or 0
    found = placed.select("doc_id", "th", F.explode("runs").alias("x")).select("x.fp", F.struct("doc_id", "th", "x.at").alias("me"), "x.n", "x.k1", "x.k2")
    found = stage(join_counted(found, shared, ["fp"], "c", total).drop("fp"), "line-runs")
    first = stage(found.groupBy("k1", "k2").agg(F.min("me").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1"), "first-runs")
    total = first.agg(F.sum("c")).first()[0] or 0
    later = join_counted(found, first, ["k1", "k2"], "c", total).filter("me > first")
    later = later.select("me.doc_id", "me.th", "me.at", "n", F.col("first.doc_id").alias("of_doc"), F.col("first.th").alias("of_th"), F.col("first.at").alias("of_at"))
    # Runs of one document whose places in an earlier one follow each other are one.
    same = W.partitionBy("doc_id", "th", "of_doc", "of_th", F.col("at") - F.col("of_at")).orderBy("at", "n")
    reach = F.max(F.col("at") + F.col("n")).over(same.rowsBetween(W.unboundedPreceding, -1))
    later = later.withColumn("new", F.when(F.col("at") <= reach, 0).otherwise(1))
    later = later.withColumn("part", F.sum("new").over(same.rowsBetween(W.unboundedPreceding, 0))).withColumn("shift", F.col("at") - F.col("of_at"))
    merged = later.groupBy("doc_id", "th", "of_doc", "of_th", "shift", "part").agg(F.min("at").alias("at"), F.max(F.col("at") + F.col("n")).alias("to"), F.min("of_at").alias("of_at"))
    return merged.select("doc_id", "th", "at", (F.col("to") - F.col("at")).alias("lines"), "of_doc", "of_th", "of_at")


def dedup_lines(docs: DataFrame, run: int = RUN, long_line: int = LONG_LINE) -> DataFrame:
    """The columns of docs, its text without repeated runs, and n_lines, n_removed (lines) for every row.

    A null text has no lines and stays; blank lines are in no run and stay. A run that
    repeats within one text is deleted there after its first place; a very long text is treated like any other. Rows that repeat wholly (doc_id and text)
    count as one and have one result. A null doc_id comes first in the order. Further columns stay as
    they are, but for ones named n_lines or n_removed, which are replaced; an empty table gives no rows.
    """
    keyed = docs.withColumn("_fx_text", F.coalesce("text", F.lit(""))).withColumn("_fx_th", F.xxhash64("_fx_text"))
    later = later_runs(keyed.select("doc_id", "_fx_th", "_fx_text"), run, long_line)
    # Keyed by a string that is never null, as a null doc_id is a key too.
    gone = later.select(group_key("doc_id").alias("_fx_id"), F.col("th").alias("_fx_th"), F.sequence("at", F.col("at") + F.col("lines") - 1).alias("at"))
    gone = gone.groupBy("_fx_id", "_fx_th").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("_fx_gone"))
    df = keyed.withColumn("_fx_id", group_key("doc_id")).join(gone, ["_fx_id", "_fx_th"], "left").withColumn("_fx_at", _content())
    df = df.withColumn("_fx_gone", F.coalesce(F.transform("_fx_gone", lambda p: F.get("_fx_at", p)), F.array().cast("array<int>")))
    df = df.withColumn("_fx_lines", _text_lines())
    kept = F.array_except(F.sequence(F.lit(0), F.size("_fx_lines") - 1), "_fx_gone")
    text = F.when(F.size("_fx_gone") == 0, F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("_fx_lines", i)), "\n"))
    df = df.withColumns({"text": text, "n_lines": F.size("_fx_at").cast("long"), "n_removed": F.size("_fx_gone").cast("long")})
    return df.drop("_fx_text", "_fx_th", "_fx_id", "_fx_at", "_fx_gone", "_fx_lines")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP7_SQL = rf"""
WITH l AS (
  SELECT doc_id, coalesce(text, '') AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
), c AS (SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, count(*) OVER (PARTITION BY doc_id) AS n FROM l WHERE regexp_matches(line, '[^{SPACE}]')
), w AS (
  SELECT doc_id, pos, {RUN} AS len, 'run' AS kind, line || chr(10) || lead(line, 1) OVER p || chr(10) || lead(line, 2) OVER p AS run FROM c WINDOW p AS (PARTITION BY doc_id ORDER BY pos)
  UNION ALL SELECT doc_id, 0, max(n), 'whole', string_agg(line, chr(10) ORDER BY pos) FROM c WHERE n < {RUN} GROUP BY doc_id
  UNION ALL SELECT doc_id, pos, 1, 'line', line FROM c WHERE len(regexp_extract_all(line, '{WORD}')) >= {LONG_LINE}
), r AS (SELECT doc_id, pos, len, row_number() OVER (PARTITION BY kind, run ORDER BY doc_id, pos) AS k FROM w WHERE run IS NOT NULL
), gone AS (SELECT DISTINCT c.doc_id, c.i FROM r, c WHERE k > 1 AND c.doc_id = r.doc_id AND c.pos BETWEEN r.pos AND r.pos + r.len - 1
), n AS (SELECT doc_id, count(*) AS n_lines FROM c GROUP BY doc_id), g AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id
), k AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS kept FROM l ANTI JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""
