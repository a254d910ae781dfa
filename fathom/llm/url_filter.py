"""URL filter: pattern rules indexed by their rarest literal token.

Each rule's regular expression runs only on URLs that hold the token it is filed under, the one of
its literal tokens that the fewest URLs hold. A rule list is a parameter of the job; it reaches the
tasks in their closure, a part of bounded size at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fathom.llm._common import stage, table

#: Characters of rules that are shipped to the tasks at a time; a longer list is run part by part over a written table of the verdicts so far.
RULE_CHARS = 32_000_000
TOKEN = re.compile(r"[a-z0-9]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """verdict is allow or block; pattern is matched (re.search) against host + path; tokens are literal in every match."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    domain: bool = field(default=False)


def domain_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits host and its subdomains where the path starts with path."""
    # The last token of the path may go on in the URL, so it is literal only if a separator closes it.
    closed = TOKEN.findall((host + path).translate(ASCII_LOWER) if not path or not path[-1].isalnum() else (host + path[: path.rfind("/") + 1]).translate(ASCII_LOWER))
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(closed), True)


DOMAIN_RULES = (
    domain_rule("allow", "org", "/"),
    domain_rule("block", "example.org", "/es/"),
    domain_rule("block", "example.org", "/en/1"),
    domain_rule("allow", "com", "/fr/"),
    domain_rule("block", "com", "/de/"),
)
#: Where no domain rule fits: paths of trackers, logins and feeds are blocked, all else is allowed.
PATTERN_RULES = (
    *(Rule(t, "block", rf"(?:^|[./]){t}[./]", (t,)) for t in ("ad", "adserver", "doubleclick")),
    *(Rule(t, "block", rf"/{t}/", (t,)) for t in ("beacon", "pixel", "track")),
    Rule("feed", "block", r"/feed/?\Z", ("feed",)),
    Rule("login", "block", r"/(?:wp-)?login(?:[./]|\Z)", ("login",)),
)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lowered) and path; both empty for null or where there is no '://'."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    tail = rest[end:]
    stop = next((i for i, c in enumerate(tail) if c in "?#"), len(tail))
    return rest[:end].translate(ASCII_LOWER), tail[:stop]


def token_counts(pages: DataFrame, rules: Iterable[Rule]) -> dict[str, int]:
    """How many URLs hold each token of the rules, over all pages; at most one row a rule token comes back."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    found = F.array_distinct(F.regexp_extract_all(F.translate(F.col("url"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("[a-z0-9]+"), 0))
    side = pages.sparkSession.createDataFrame([(t,) for t in wanted], "t string")
    side = F.broadcast(side) if sum(map(len, wanted)) <= RULE_CHARS else side
    rows = pages.select(F.explode(found).alias("t")).join(side, "t", "left_semi").groupBy("t").count().collect()
    return {r["t"]: r["count"] for r in rows}


def index_rules(rules: Iterable[Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rule numbers by rarest literal token, and the rules without any literal token, which run on every URL."""
    by_token: dict[str, list[int]] = {}
    always = []
    for i, r in enumerate(rules):
        if r.tokens:
            by_token.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(i)
        else:
            always.append(i)
    return by_token, always


def rule_parts(rules: list[Rule], most: int) -> list[list[Rule]]:
    """rules in their order, cut into parts of at most `most` characters of patterns (a longer pattern is a part of its own)."""
    parts: list[list[Rule]] = [[]]
    held = 0
    for r in rules:
        if parts[-1] and held + len(r.pattern) > most:
            parts.append([])
            held = 0
        parts[-1].append(r)
        held += len(r.pattern)
    return parts


#: What the parts of the rules have found so far: the best domain rule, the first pattern rule, and their verdicts.
FOUND = ("rule", "rule_verdict", "pattern_rule", "pattern_verdict")


def _judge_part(found: DataFrame, rules: list[Rule], counts: dict[str, int]) -> DataFrame:
    by_token, always = index_rules(rules, counts)
    plain = [(r.name, r.verdict, r.pattern, r.domain) for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled: dict[int, re.Pattern] = {}
        for batch in batches:
            out: dict[str, list] = {k: [] for k in (*FOUND, "n_candidates")}
            for host, path, rule, rule_verdict, pattern_rule, pattern_verdict, n in zip(*(batch.column(k).to_pylist() for k in ("host", "path", *FOUND, "n_candidates")), strict=True):
                whole = host + path
                ids = sorted({i for t in set(TOKEN.findall(whole.translate(ASCII_LOWER))) for i in by_token.get(t, ())} | set(always))
                for i in ids:
                    name, verdict, pattern, domain = plain[i]
                    if i not in compiled:
                        compiled[i] = re.compile(pattern)
                    if not compiled[i].search(whole):
                        continue
                    if domain and (rule is None or (-len(name), name) < (-len(rule), rule)):
                        rule, rule_verdict = name, verdict
                    if not domain and pattern_rule is None:
                        pattern_rule, pattern_verdict = name, verdict
                for k, v in zip(out, (rule, rule_verdict, pattern_rule, pattern_verdict, n + len(ids)), strict=True):
                    out[k].append(v)
            columns = [*(batch.column(k) for k in ("page_id", "host", "path")), *(pa.array(out[k], pa.string()) for k in FOUND), pa.array(out["n_candidates"], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "host", "path", *out])

    return found.mapInArrow(run, found.schema)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [split_url(u) for u in batch.column("url").to_pylist()]
        none = pa.nulls(len(parts), pa.string())
        columns = [batch.column("page_id"), *(pa.array([p[k] for p in parts], pa.string()) for k in (0, 1)), *(none for _ in FOUND), pa.array([0] * len(parts), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "host", "path", *FOUND, "n_candidates"])


def judge(pages: DataFrame, domain_rules: tuple[Rule, ...] = DOMAIN_RULES, pattern_rules: tuple[Rule, ...] = PATTERN_RULES, rule_chars: int = RULE_CHARS) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern_rule, n_candidates for every row of pages; no shuffle of pages.

    The longest fitting domain rule wins, ties by name. Without one, the first fitting pattern rule
    decides and rule stays null; without any, allow. A null url, or one without '://', has an empty host and path and
    is allowed unless a pattern fits; a url of any length is judged whole. Repeated rows are judged each; an empty table
    gives no rows; further columns are ignored. Rules of more than rule_chars characters run part by part.
    """
    rules = [*domain_rules, *pattern_rules]
    counts = token_counts(pages, rules)
    kind = dict(pages.dtypes)["page_id"]
    columns = ", ".join(f"{k} string" for k in ("host", "path", *FOUND))
    found = pages.select("page_id", F.col("url").cast("string")).mapInArrow(_split, f"page_id {kind}, {columns}, n_candidates long")
    for i, part in enumerate(rule_parts(rules, rule_chars)):
        found = _judge_part(found if i == 0 else stage(found, "judged"), part, counts)
    verdict = F.coalesce(F.when(F.col("rule").isNotNull(), F.col("rule_verdict")), F.col("pattern_verdict"), F.lit("allow"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "pattern_rule", "n_candidates")


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).drop("n_candidates")


OP10_SQL = r"""
WITH cut AS (
  SELECT page_id, coalesce(url, '') AS u, strpos(coalesce(url, ''), '://') AS p FROM pages
), parts AS (
  SELECT page_id,
    CASE WHEN p = 0 THEN '' ELSE translate(regexp_extract(substr(u, p + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
    CASE WHEN p = 0 THEN '' ELSE regexp_extract(substr(u, p + 3), '^[^/?#]*([^?#]*)', 1) END AS path
  FROM cut
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts
), pat AS (
  SELECT *, CASE
    WHEN regexp_matches(host || path, '(^|[./])ad[./]') THEN 'ad'
    WHEN regexp_matches(host || path, '(^|[./])adserver[./]') THEN 'adserver'
    WHEN regexp_matches(host || path, '(^|[./])doubleclick[./]') THEN 'doubleclick'
    WHEN regexp_matches(host || path, '/beacon/') THEN 'beacon'
    WHEN regexp_matches(host || path, '/pixel/') THEN 'pixel'
    WHEN regexp_matches(host || path, '/track/') THEN 'track'
    WHEN regexp_matches(host || path, '/feed/?$') THEN 'feed'
    WHEN regexp_matches(host || path, '/(wp-)?login([./]|$)') THEN 'login' END AS pattern_rule
  FROM ruled
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN pattern_rule IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  pattern_rule
FROM pat
"""
