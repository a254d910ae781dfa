"""Quality rules: a threshold table compiled into DataFrame projections, without user functions.

Each rule is a measure with a lowest and a highest value. Measures are expressions over the text
and its words; the rules become one boolean projection over them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fathom.llm._common import SPACE, WORD, table

NGRAM = 5
#: The stop-word ratio is smoothed, (stops + 2) / (words + 10), so that very short clean texts pass.
#: Common short words of English, French, German and Spanish, for words in lower case.
STOP_WORDS = (
    "a al an and are as at au auf be by con das de dem den der des die du ein el elle en es est et for from für il im in is ist it la las le les los "
    "mit of on or ou para par por pour qu que qui se sich su sur that the this to un una und une von was with y zu"
).split()


@dataclass(frozen=True)
class Threshold:
    """A document passes if low <= measure <= high; a bound of None is open."""

    measure: str
    low: float | None = None
    high: float | None = None


THRESHOLDS = (
    Threshold("n_words", low=10),
    Threshold("mean_word_chars", low=2, high=12),
    Threshold("symbol_ratio", high=0.10),
    Threshold("stop_ratio", low=0.05),
    Threshold("shout_ratio", high=0.50),
    Threshold("echo_ratio", high=0.40),
    Threshold("dup_line_ratio", high=0.50),
)


def _lookup(words: str) -> Column:
    return F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))


def measures(docs: DataFrame) -> DataFrame:
    """docs with word and line measures. Its own columns stay; ours replace those of the same name.

    Sharing the arrays between expressions needs projections of their own, which Catalyst keeps apart.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("_fx_words", F.array_remove(F.split(text, f"[{SPACE}]+"), ""))
    gram = F.transform(F.sequence(F.lit(0), F.size("_fx_words") - NGRAM), lambda i: F.xxhash64(*(F.col("_fx_words")[i + k] for k in range(NGRAM))))
    df = df.withColumns({
        "n_words": F.size("_fx_words").cast("long"),
        "_fx_grams": F.when(F.size("_fx_words") >= NGRAM, gram).otherwise(F.array().cast("array<bigint>")),
        "_fx_lines": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")),
    })
    # Only texts with a repeated window pay for sorting (hash, position) pairs.
    pairs = F.array_sort(F.transform("_fx_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    repeats = F.when(F.size(F.array_distinct("_fx_grams")) < F.size("_fx_grams"), pairs)
    df = df.withColumn("_fx_pairs", repeats)
    twin = lambda x, i: ((i > 0) & (F.get("_fx_pairs", i - 1)["g"] == x["g"])) | (F.coalesce(F.get("_fx_pairs", i + 1)["g"] == x["g"], F.lit(False)))
    df = df.withColumn("_fx_at", F.array_sort(F.transform(F.filter("_fx_pairs", twin), lambda x: x["i"])))
    covered = F.aggregate(F.transform("_fx_at", lambda p, i: F.least(F.lit(NGRAM), F.coalesce(F.get("_fx_at", i + 1) - p, F.lit(NGRAM))).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    n = F.greatest(F.col("n_words"), F.lit(1))
    kept_lines = F.greatest(F.size("_fx_lines"), F.lit(1))
    df = df.withColumns({
        "word_chars": F.char_length(F.regexp_replace(text, f"[{SPACE}]+", "")).cast("long"),
        "n_symbols": F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("_fx_lines") - F.size(F.array_distinct("_fx_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
        "_fx_stop": F.size(_lookup("_fx_words")),
        "_fx_echo": F.size(F.filter("_fx_words", lambda w, i: (i > 0) & (F.get("_fx_words", i - 1) == w))),
        "_fx_shout": F.char_length(F.regexp_replace(text, "[^!]+", "")),
    })
    return df.withColumns({
        "mean_word_chars": F.col("word_chars") / n, "symbol_ratio": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "stop_ratio": (F.col("_fx_stop") + 2) / (F.col("n_words") + 10), "shout_ratio": F.col("_fx_shout") / n, "echo_ratio": F.col("_fx_echo") / n, "dup_line_ratio": F.col("n_dup_lines") / kept_lines,
    }).drop("_fx_words", "_fx_grams", "_fx_lines", "_fx_pairs", "_fx_at", "_fx_stop", "_fx_echo", "_fx_shout")


def verdict(thresholds: tuple[Threshold, ...] = THRESHOLDS) -> Column:
    """All rules of the table as one boolean expression."""
    out = F.lit(True)
    for t in thresholds:
        if t.low is not None:
            out = out & (F.col(t.measure) >= F.lit(t.low))
        if t.high is not None:
            out = out & (F.col(t.measure) <= F.lit(t.high))
    return out


def barrier(df: DataFrame) -> DataFrame:
    """df, with a projection at its end that no filter passes.

    Catalyst would push a filter below the projections and repeat their nested expressions in it; a row id, which is not deterministic, keeps it above.
    """
    numbered = df.withColumn("_fx_id", F.monotonically_increasing_id())
    return numbered.select(*(F.when(F.col("_fx_id") >= 0, F.col(c)).alias(c) for c in df.columns))


def score_quality(docs: DataFrame, thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and the ratios, a row per row of docs.

    A null or empty text has no words and fails. Repeated rows are judged each; an empty table gives
    no rows; further columns are ignored. A text of any length is judged whole. No shuffle: each row is judged where it is read.
    A filter on the result stays above the measures, which are computed once (see barrier()).
    """
    df = measures(docs.select("doc_id", "text"))
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    df = df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(thresholds))
    return barrier(df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *(F.round(c, 6).alias(c) for c in ("mean_word_chars", "symbol_ratio", "stop_ratio", "shout_ratio", "echo_ratio", "dup_line_ratio"))))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"))


def quality_sql(source: str = "documents") -> str:
    """The same in DuckDB's SQL, over the table or subquery named."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    tests = " AND ".join(f"{t.measure}_x {op} {v}" for t in THRESHOLDS for op, v in ((">=", t.low), ("<=", t.high)) if v is not None)
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {source}),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '{WORD}') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS lines FROM docs),
g AS (SELECT rid, unnest(range(len(words) - {NGRAM - 1})) AS i, words FROM w WHERE len(words) >= {NGRAM}),
h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i + 1 : i + {NGRAM}]) AS c FROM g),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT rid, i FROM h WHERE c > 1), range({NGRAM}) AS t(k) GROUP BY rid),
m AS (
  SELECT w.rid, doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS stops, length(regexp_replace(text, '[^!]+', '', 'g')) AS shouts,
    len(list_filter(words, lambda x, i: i > 1 AND words[i - 1] = x)) AS echoes, len(lines) AS n_lines
  FROM w LEFT JOIN r ON w.rid = r.rid
), x AS (
  SELECT *, n_words AS n_words_x, word_chars / greatest(n_words, 1) AS mean_word_chars_x, n_symbols / greatest(word_chars, 1) AS symbol_ratio_x,
    (stops + 2) / (n_words + 10) AS stop_ratio_x, shouts / greatest(n_words, 1) AS shout_ratio_x, echoes / greatest(n_words, 1) AS echo_ratio_x, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio_x,
    (n_words < 10 OR n_repeat_words * 100 > n_words * 20) AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {tests}) AS kept,
  round(mean_word_chars_x, 6) AS mean_word_chars, round(symbol_ratio_x, 6) AS symbol_ratio, round(stop_ratio_x, 6) AS stop_ratio, round(shout_ratio_x, 6) AS shout_ratio, round(echo_ratio_x, 6) AS echo_ratio, round(dup_line_ratio_x, 6) AS dup_line_ratio
FROM x"""


def keep_good(docs: DataFrame, thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns.

    Null and empty texts fail and go; repeated rows stay or go each; an empty table gives none; texts of any length are judged whole.
    """
    df = measures(docs.select(F.struct("*").alias("_fx_row"), "text"))
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return barrier(df.select("_fx_row", (~failed & verdict(thresholds)).alias("_fx_ok"))).filter("_fx_ok").select("_fx_row.*")
