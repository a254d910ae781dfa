"""Every query of the engine by name, each with the SQL that checks it.

The queries run on the bundled tables: the supplier-month panel stands for quotes, its regions for
sectors, orders for filing facts. Values are rounded alike on both sides, as sums of doubles depend on their order.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fathom.functions.columns import char_sum, winsorize, zscore
from fathom.operators import attribution as at, covariance as cv, factors as fc, matrix as mx, model as md, panel as pn, regression as rg, specific as sp, summary as sm
from fathom.sinks import export as ex
from fathom.sources import filings as fl, quotes as qt, store as st, universe as un

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 8) -> DataFrame:
    """df with the columns rounded, and -0.0 as 0.0."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def r(x: str, name: str = "", digits: int = 8) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name or x}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The panel.

Q = """q AS (SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume FROM lineitem GROUP BY 1, 2),
quotes AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, date, close, volume, r_name AS sector FROM q JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
P = Q + """, r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret, CAST(volume AS DOUBLE) * close AS cap FROM quotes),
rr AS (SELECT * FROM r WHERE ret IS NOT NULL), mkt AS (SELECT date, avg(ret) AS m FROM rr GROUP BY date), p AS (SELECT rr.*, m FROM rr JOIN mkt USING (date))"""
RAW = P + """, raw AS (SELECT symbol, date, sector, ret, cap, lag(close, 1) OVER w / lag(close, 13) OVER w - 1 AS momentum, ln(cap) AS size,
  CASE WHEN count(ret) OVER w36 >= 12 THEN covar_samp(ret, m) OVER w36 / var_samp(m) OVER w36 END AS beta,
  CASE WHEN count(ret) OVER w12 >= 6 THEN stddev_samp(ret) OVER w12 * sqrt(12) END AS volatility,
  CASE WHEN count(ret) OVER w6 >= 3 THEN avg(abs(ret) / (close * volume)) OVER w6 END AS illiquidity
  FROM p WINDOW w AS (PARTITION BY symbol ORDER BY date), w36 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 35 PRECEDING AND CURRENT ROW),
  w12 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), w6 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))"""
FULL = " WHERE momentum IS NOT NULL AND size IS NOT NULL AND beta IS NOT NULL AND volatility IS NOT NULL AND illiquidity IS NOT NULL"
SCORES = RAW + ", scores AS (SELECT symbol, date, " + ", ".join(f"({f} - avg({f}) OVER d) / nullif(stddev_samp({f}) OVER d, 0) AS {f}_score" for f in fc.FACTORS) + f" FROM raw{FULL} WINDOW d AS (PARTITION BY date))"
WW = P + """, b AS (SELECT date, quantile_cont(ret, 0.05) AS lo, quantile_cont(ret, 0.95) AS hi FROM p GROUP BY date),
ww AS (SELECT p.*, greatest(lo, least(hi, ret)) AS wr, sqrt(cap) AS w FROM p JOIN b USING (date))"""
FR = WW + """, sm AS (SELECT date, sector, sum(w * wr) / sum(w) AS sector_mean FROM ww GROUP BY 1, 2),
sf AS (SELECT date, sector, sector_mean, avg(sector_mean) OVER (PARTITION BY date) AS market, sector_mean - avg(sector_mean) OVER (PARTITION BY date) AS ret FROM sm),
fr AS (SELECT date, sector AS factor, ret FROM sf)"""
RES = FR + ", res AS (SELECT ww.date, ww.symbol, ww.sector, w, wr, cap, wr - sector_mean AS residual FROM ww JOIN sf USING (date, sector))"


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qt.demo_quotes(spark, sf_dir)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes, returns and the market in one window pass and one aggregate over dates."""
    own = quotes(spark, sf_dir)
    return pn.factor_panel(own, pn.average_market(pn.compute_returns(own)))


def sector_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sectors' returns as date, factor, ret."""
    return rg.sector_returns(panel(spark, sf_dir)).select("date", F.col("sector").alias("factor"), "ret")


# Prices are sums over quantities, often exact ties when rounded; traded value is not.


@query(f"WITH {Q} SELECT symbol, date, {r('close * volume', 'turnover', 2)}, volume, sector FROM quotes")
def quotes_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes(spark, sf_dir).select("symbol", "date", F.round(F.col("close") * F.col("volume"), 2).alias("turnover"), "volume", "sector")


@query(f"WITH {Q} SELECT symbol, date, {r('close * volume', 'turnover', 2)} FROM quotes WHERE symbol IN ('1', '2', '3') AND date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'")
def quotes_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = qt.scan_quotes(quotes(spark, sf_dir), ["1", "2", "3"], dt.date(1997, 1, 1), dt.date(1998, 12, 31), strict=False)
    return found.select("symbol", "date", F.round(F.col("close") * F.col("volume"), 2).alias("turnover"))


@query(f"WITH {Q} SELECT symbol FROM (VALUES ('1'), ('2'), ('absent'), ('3'), ('gone')) AS t (symbol) WHERE symbol NOT IN (SELECT symbol FROM quotes WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31')")
def quotes_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols that a batch scan skips."""
    return qt.scan_available(quotes(spark, sf_dir), ["1", "2", "absent", "3", "gone"], dt.date(1997, 1, 1), dt.date(1998, 12, 31))[1]


@query(f"WITH {P} SELECT symbol, date, {r('ret', 'asset_returns')} FROM rr")
def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pn.compute_returns(quotes(spark, sf_dir)).select("symbol", "date", "asset_returns"), "asset_returns")


@query(f"WITH {P} SELECT date, {r('ret', 'market_return')} FROM rr WHERE symbol = '1'")
def benchmark_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pn.benchmark_returns(quotes(spark, sf_dir), "1"), "market_return")


@query(f"WITH {P} SELECT date, {r('m', 'market_return')} FROM mkt")
def market_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pn.average_market(pn.compute_returns(quotes(spark, sf_dir))), "market_return")


@query(f"WITH {P} SELECT symbol, date, {r('cap', 'market_cap', 4)} FROM r")
def market_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pn.market_cap_proxy(quotes(spark, sf_dir)).select("symbol", "date", "market_cap"), "market_cap", digits=4)


@query(f"WITH {P} SELECT symbol, date, volume, {r('ret', 'asset_returns')}, {r('m', 'market_return')}, {r('cap', 'market_cap', 4)} FROM p")
def factor_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rounded(panel(spark, sf_dir).drop("adjusted_close", "close", "sector"), "asset_returns", "market_return")
    return rounded(df, "market_cap", digits=4)


@query(
    f"""WITH {Q}, big AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS filed, max(l_extendedprice) AS price FROM lineitem WHERE l_quantity >= 49 GROUP BY 1, 2)
SELECT q.symbol, q.date, max_by(b.price, b.filed) AS price, max(b.filed) AS filed FROM quotes q LEFT JOIN big b ON q.symbol = b.symbol AND b.filed <= q.date GROUP BY 1, 2"""
)
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49")
    big = item.groupBy(F.col("l_suppkey").cast("string").alias("symbol"), F.to_date("l_shipdate").alias("filed")).agg(F.max("l_extendedprice").alias("price"))
    return pn.as_of(quotes(spark, sf_dir).select("symbol", "date"), big, "symbol", "date", "filed", ["price", "filed"])


# Sectors.


@query("WITH " + Q + " SELECT symbol, date, " + ", ".join(f"CASE WHEN sector = '{s}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"sector_{s.replace(' ', '_')}\"" for s in REGIONS) + " FROM quotes")
def sector_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.one_hot(quotes(spark, sf_dir).select("symbol", "date", "sector"), REGIONS).drop("sector")


@query(f"WITH {Q} SELECT sector, count(DISTINCT symbol) AS n FROM quotes GROUP BY 1")
def sector_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes(spark, sf_dir).select("sector", "symbol").distinct().groupBy("sector").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{s}', {len(x.split())}::BIGINT, {un.SECTOR_CODES[s]}::INTEGER)" for s, x in un.SYMBOLS.items()) + ") t(sector, n, code)")
def universe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return un.Universe().sector_counts(spark).join(un.sector_dim(spark), "sector")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{s}')" for s, x in un.ALIASES.items() for a in (s.lower().replace(" ", ""), *x)) + ") t(alias, sector)")
def sector_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return un.alias_dim(spark)


# Factors.


def _factor(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fc.raw_factors(panel(spark, sf_dir), fc.MONTHLY).select("symbol", "date", name)
        return rounded(df.filter(F.col(name).isNotNull()), name, digits=10)

    run.__name__ = f"factor_{name}"
    query(f"WITH {RAW} SELECT symbol, date, {r(name, digits=10)} FROM raw WHERE {name} IS NOT NULL")(run)


for _name in fc.FACTORS:
    _factor(_name)


@query(f"WITH {P} SELECT symbol, date, round((ln(cap) - avg(ln(cap)) OVER d) / stddev_samp(ln(cap)) OVER d, 8) + 0.0 AS size_z FROM p WINDOW d AS (PARTITION BY date)")
def size_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel(spark, sf_dir).withColumn("x", F.ln("market_cap")).select("symbol", "date", zscore(F.col("x"), "date").alias("size_z")), "size_z")


@query(f"WITH {WW} SELECT symbol, date, {r('wr', 'asset_returns')} FROM ww")
def winsorized_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(winsorize(panel(spark, sf_dir).select("symbol", "date", "asset_returns"), "asset_returns", "date"), "asset_returns")


SCORE_COLS = ", ".join(r(f"{f}_score", digits=6) for f in fc.FACTORS)


@query(f"WITH {SCORES} SELECT symbol, date, {SCORE_COLS} FROM scores")
def all_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fc.scores(panel(spark, sf_dir), fc.MONTHLY), *(f"{f}_score" for f in fc.FACTORS), digits=6)


@query(f"WITH {SCORES} SELECT symbol, date, {SCORE_COLS} FROM scores WHERE date = (SELECT max(date) FROM scores)")
def latest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fc.scores(panel(spark, sf_dir), fc.MONTHLY, "last"), *(f"{f}_score" for f in fc.FACTORS), digits=6)


# Factor returns.


@query(f"WITH {FR} SELECT date, sector, {r('sector_mean')}, {r('market')}, {r('ret')} FROM sf")
def sector_factor_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rg.sector_returns(panel(spark, sf_dir)), "sector_mean", "market", "ret")


@query(f"WITH {FR} SELECT date, factor, {r('ret')} FROM (SELECT * FROM fr UNION ALL SELECT DISTINCT date, 'market', market FROM sf)")
def factor_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rg.factor_returns(panel(spark, sf_dir)), "ret")


@query(f"WITH {RES} SELECT date, symbol, {r('residual')} FROM res")
def sector_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rg.residuals(panel(spark, sf_dir)).select("date", "symbol", "residual"), "residual")


def styled(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Residuals with the scores of all factors."""
    rows = panel(spark, sf_dir)
    left = rg.residuals(rows).select("symbol", "date", "residual", "w", "sector")
    return fc.scores(rows, fc.MONTHLY).join(left, ["symbol", "date"])


STYLED = SCORES + RES[len(P) :] + ", x AS (SELECT s.*, residual, w, sector FROM scores s JOIN res USING (symbol, date))"


@query(f"WITH {STYLED} SELECT date, count(*) AS n, round(sum(w * size_score * residual) / sum(w * size_score * size_score), 8) + 0.0 AS f_size_score FROM x GROUP BY date")
def style_returns_p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rg.style_returns_sql(styled(spark, sf_dir), ["size_score"]), "f_size_score")


CRAMER = f"""WITH {STYLED}, e AS (SELECT date, count(*) AS n, sum(w * size_score * size_score) AS xx, sum(w * size_score * beta_score) AS xy, sum(w * beta_score * beta_score) AS yy,
  sum(w * size_score * residual) AS xt, sum(w * beta_score * residual) AS yt FROM x GROUP BY date)
SELECT date, n, round((xt * yy - yt * xy) / (xx * yy - xy * xy), 7) + 0.0 AS f_size_score, round((yt * xx - xt * xy) / (xx * yy - xy * xy), 7) + 0.0 AS f_beta_score FROM e"""


@query(CRAMER)
def style_returns_p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rg.style_returns_sql(styled(spark, sf_dir), ["size_score", "beta_score"]), "f_size_score", "f_beta_score", digits=7)


@query(CRAMER)
def style_returns_solved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same two styles by the general solver."""
    return rounded(rg.style_returns(styled(spark, sf_dir), ["size_score", "beta_score"]).drop("r2"), "f_size_score", "f_beta_score", digits=7)


def _det(entry: Callable[[int, int], str], k: int) -> str:
    """A k x k determinant as SQL, summed over permutations."""
    terms = []
    for order in permutations(range(k)):
        odd = sum(order[i] > order[j] for i in range(k) for j in range(i + 1, k)) % 2
        terms.append(("-" if odd else "+") + " * ".join(entry(i, j) for i, j in enumerate(order)))
    return "(" + " ".join(terms) + ")"


STYLES = [f"{f}_score" for f in fc.FACTORS]
_A = lambda i, j: f"a{min(i, j)}{max(i, j)}"
# The normal equations of all five styles, solved by Cramer's rule.
FIVE = (
    STYLED + ", e AS (SELECT date, count(*) AS n, sum(w * residual * residual) AS tt, "
    + ", ".join(f"sum(w * {a} * {b}) AS a{i}{j}" for i, a in enumerate(STYLES) for j, b in enumerate(STYLES) if i <= j) + ", " + ", ".join(f"sum(w * {a} * residual) AS b{i}" for i, a in enumerate(STYLES))
    + " FROM x GROUP BY date), d AS (SELECT *, " + _det(_A, 5) + " AS det FROM e), five AS (SELECT *, "
    + ", ".join("CASE WHEN n >= 5 THEN " + _det(lambda i, j, k=k: f"b{i}" if j == k else _A(i, j), 5) + f" / det END AS f{k}" for k in range(5)) + " FROM d)"
)


@query(f"WITH {FIVE} SELECT date, n, round(({' + '.join(f'f{k} * b{k}' for k in range(5))}) / tt, 6) + 0.0 AS r2, " + ", ".join(r(f"f{k}", f"f_{s}", 6) for k, s in enumerate(STYLES)) + " FROM five")
def style_returns_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rg.style_returns(styled(spark, sf_dir), STYLES)
    return rounded(df, "r2", *(f"f_{s}" for s in STYLES), digits=6)


@query(f"WITH {FIVE} SELECT x.date, x.symbol, round(residual - ({' + '.join(f'f{k} * {s}' for k, s in enumerate(STYLES))}), 6) + 0.0 AS residual FROM x JOIN five USING (date)")
def specific_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rg.specific_returns(styled(spark, sf_dir), STYLES), "residual", digits=6)


# Covariance.

PAIR = "SELECT a.factor AS factor_i, b.factor AS factor_j"
DEMEANED = FR + ", y AS (SELECT date, factor, ret - avg(ret) OVER (PARTITION BY factor) AS r FROM fr)"
S = DEMEANED + f", s AS ({PAIR}, avg(a.r * b.r) AS v FROM y a JOIN y b USING (date) GROUP BY 1, 2)"
NUM = FR + ", t AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM fr))"
EW = NUM + ", w AS (SELECT fr.*, n, CASE WHEN t = 0 THEN pow(0.95, n - 1) ELSE 0.05 * pow(0.95, n - 1 - t) END AS w FROM fr JOIN t USING (date)), ew AS (SELECT *, ret - sum(w * ret) OVER (PARTITION BY factor) AS r FROM w)"
EWC = EW + f", c AS ({PAIR}, sum(a.w * a.r * b.r) AS v, max(a.n) AS n FROM ew a JOIN ew b USING (date) GROUP BY 1, 2)"
V = r("v", "value", 10)


def _cov(name: str, sql: str, f: Callable[[DataFrame], DataFrame], digits: int = 10) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(f(sector_factors(spark, sf_dir)), "value", digits=digits)

    run.__name__ = name
    query(sql)(run)


_cov("cov_sample", f"WITH {S} SELECT factor_i, factor_j, {V} FROM s", cv.sample)
_cov("cov_uncentered", f"WITH {FR} {PAIR}, round(avg(a.ret * b.ret), 10) + 0.0 AS value FROM fr a JOIN fr b USING (date) GROUP BY 1, 2", lambda x: cv.sample(x, center=False))
_cov("cov_ewma", f"WITH {EWC} SELECT factor_i, factor_j, round(v * n * 0.05 / (1 - pow(0.95, n)), 9) + 0.0 AS value FROM c", lambda x: cv.ewma(x, strict=False), 9)
_cov("cov_ewma_nobias", f"WITH {EWC} SELECT factor_i, factor_j, {V} FROM c", lambda x: cv.ewma(x, cv.EwmaConfig(bias_correction=False), strict=False))


def _split(x: DataFrame) -> DataFrame:
    return cv.ewma_update(cv.sample(x.filter("date < '2000-01-01'")), x.filter("date >= '2000-01-01'"))


_cov(
    "cov_ewma_update",
    f"""WITH {FR}, old AS (SELECT date, factor, ret - avg(ret) OVER (PARTITION BY factor) AS r FROM fr WHERE date < DATE '2000-01-01'),
c0 AS ({PAIR}, avg(a.r * b.r) AS v FROM old a JOIN old b USING (date) GROUP BY 1, 2),
t AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM fr WHERE date >= DATE '2000-01-01')),
n1 AS ({PAIR}, sum(0.05 * pow(0.95, n - 1 - t) * a.ret * b.ret) AS add FROM fr a JOIN fr b USING (date) JOIN t USING (date) GROUP BY 1, 2)
SELECT factor_i, factor_j, round(v * pow(0.95, (SELECT count(*) FROM t)) + add, 10) + 0.0 AS value FROM c0 JOIN n1 USING (factor_i, factor_j)""",
    _split,
)


@query(
    f"""WITH {EWC}, d AS (SELECT factor_i AS f, sqrt(v) AS s FROM c WHERE factor_i = factor_j)
SELECT factor_i, factor_j, round(v / (a.s * b.s), 7) + 0.0 AS correlation, round(a.s * sqrt(12), 8) + 0.0 AS vol_i, round(b.s * sqrt(12), 8) + 0.0 AS vol_j FROM c JOIN d a ON a.f = factor_i JOIN d b ON b.f = factor_j"""
)
def ewma_vol_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    cov = cv.ewma(sector_factors(spark, sf_dir), cv.EwmaConfig(bias_correction=False), strict=False)
    return rounded(rounded(cv.correlation(cov, 12).drop("value"), "correlation", digits=7), "vol_i", "vol_j")


TARGET_SQL = {
    "identity": "SELECT factor_i, factor_j, v, CASE WHEN factor_i = factor_j THEN avg(v) FILTER (factor_i = factor_j) OVER () ELSE 0 END AS f FROM s",
    "diagonal": "SELECT factor_i, factor_j, v, CASE WHEN factor_i = factor_j THEN v ELSE 0 END AS f FROM s",
    "constant_correlation": """SELECT s.factor_i, s.factor_j, s.v, CASE WHEN s.factor_i = s.factor_j THEN s.v ELSE rb * sqrt(a.v * b.v) END AS f FROM s JOIN s a ON a.factor_i = s.factor_i AND a.factor_j = s.factor_i
 JOIN s b ON b.factor_i = s.factor_j AND b.factor_j = s.factor_j, (SELECT avg(s.v / sqrt(a.v * b.v)) AS rb FROM s JOIN s a ON a.factor_i = s.factor_i AND a.factor_j = s.factor_i JOIN s b ON b.factor_i = s.factor_j AND b.factor_j = s.factor_j WHERE s.factor_i < s.factor_j)""",
}
RHO_SQL = {
    "identity": "0.0",
    "diagonal": "(SELECT sum(pi) FROM per WHERE factor_i = factor_j)",
    "constant_correlation": """(SELECT sum(CASE WHEN p.factor_i = p.factor_j THEN p.pi ELSE rb * sqrt(b.v / a.v) * p.theta END) FROM per p JOIN s a ON a.factor_i = p.factor_i AND a.factor_j = p.factor_i JOIN s b ON b.factor_i = p.factor_j AND b.factor_j = p.factor_j,
 (SELECT avg(s.v / sqrt(a.v * b.v)) AS rb FROM s JOIN s a ON a.factor_i = s.factor_i AND a.factor_j = s.factor_i JOIN s b ON b.factor_i = s.factor_j AND b.factor_j = s.factor_j WHERE s.factor_i < s.factor_j))""",
}


def _lw_sql(target: str) -> str:
    return f"""{S}, f AS ({TARGET_SQL[target]}),
prod AS (SELECT a.factor AS factor_i, b.factor AS factor_j, a.r AS ri, a.r * b.r AS p FROM y a JOIN y b USING (date)),
per AS (SELECT factor_i, factor_j, avg((p - v) * (p - v)) AS pi, avg((p - f) * (p - f)) AS pf, count(*) AS t, avg((ri * ri - vi) * (p - v)) AS theta
  FROM prod JOIN f USING (factor_i, factor_j) JOIN (SELECT factor_i, v AS vi FROM s WHERE factor_i = factor_j) USING (factor_i) GROUP BY 1, 2),
g AS (SELECT sum((v - f) * (v - f)) AS gamma FROM f),
d AS (SELECT greatest(0.0, least(1.0, ((SELECT sum(pi) FROM per) - {RHO_SQL[target]}) / (gamma * (SELECT max(t) FROM per)))) AS intensity, greatest(0.0, least(1.0, (SELECT sum(pf) - sum(pi) FROM per) / gamma)) AS ref FROM g)"""


def _lw(target: str) -> None:
    _cov(f"cov_lw_{target}", f"WITH {_lw_sql(target)} SELECT factor_i, factor_j, round(intensity * f + (1 - intensity) * v, 9) + 0.0 AS value FROM f, d", lambda x: cv.ledoit_wolf(x, target), 9)

    def published(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(cv.shrinkage_intensity(sector_factors(spark, sf_dir), target).select("intensity"), "intensity", digits=6)

    published.__name__ = f"lw_intensity_{target}"
    query(f"WITH {_lw_sql(target)} SELECT {r('intensity', digits=6)} FROM d")(published)

    def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(cv.shrinkage_intensity(sector_factors(spark, sf_dir), target, "reference").select("intensity"), "intensity", digits=6)

    reference.__name__ = f"lw_parity_{target}"
    query(f"WITH {_lw_sql(target)} SELECT {r('ref', 'intensity', 6)} FROM d")(reference)


for _name in cv.TARGETS:
    _lw(_name)

_cov(
    "cov_newey_west",
    f"""WITH {DEMEANED}, t AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM fr)), x AS (SELECT y.*, t, n FROM y JOIN t USING (date)),
g AS (SELECT a.factor AS factor_i, b.factor AS factor_j, a.t - b.t AS lag, sum(a.r * b.r) / max(a.n) AS v FROM x a JOIN x b ON a.t - b.t BETWEEN 0 AND 4 GROUP BY 1, 2, 3),
h AS (SELECT factor_i, factor_j, sum(CASE WHEN lag = 0 THEN v ELSE 0 END) AS s0, sum(CASE WHEN lag > 0 THEN (1 - lag / 5.0) * v ELSE 0 END) AS g FROM g GROUP BY 1, 2)
SELECT h.factor_i, h.factor_j, round(h.s0 + h.g + k.g, 10) + 0.0 AS value FROM h JOIN h k ON h.factor_i = k.factor_j AND h.factor_j = k.factor_i""",
    lambda x: cv.newey_west(x, 4, 2),
)


@query("SELECT k::INTEGER AS lag, greatest(0.0, 1 - k / 5.0)::DOUBLE AS weight FROM range(6) t(k)")
def nw_bartlett(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, cv.bartlett(k, 4)) for k in range(6)], "lag int, weight double")


# Regimes.

REG = """day AS (SELECT CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS p FROM lineitem GROUP BY 1), dr AS (SELECT * FROM (SELECT date, p / lag(p) OVER (ORDER BY date) - 1 AS ret FROM day) WHERE ret IS NOT NULL),
v AS (SELECT date, ret, coalesce(stddev_samp(ret) OVER (ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), 0) AS s, coalesce(stddev_samp(ret) OVER (ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW), 0) AS l, row_number() OVER (ORDER BY date) AS k FROM dr),
g AS (SELECT date, s, l, CASE WHEN l = 0 THEN 1 ELSE s / l END AS q FROM v WHERE k >= 252),
reg AS (SELECT date, round(q, 6) + 0.0 AS ratio, CASE WHEN q < 0.75 THEN 'Low' WHEN q > 1.5 THEN 'High' ELSE 'Normal' END AS regime, greatest(1 / 3.0, least(3.0, q * q)) AS sc FROM g)"""


@query(f"WITH {REG} SELECT date, ratio, regime, round(sc, 6) + 0.0 AS scale FROM reg")
def regime_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cv.regimes(qt.demo_daily(spark, sf_dir)).select("date", "ratio", "regime", "scale"), "ratio", "scale", digits=6)


@query(f"WITH {REG} SELECT date, ratio, regime, round(sc, 6) + 0.0 AS scale FROM reg ORDER BY date DESC LIMIT 1")
def regime_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cv.detect_regime(qt.demo_daily(spark, sf_dir)).select("date", "ratio", "regime", "scale"), "ratio", "scale", digits=6)


@query(f"WITH {S}, {REG} SELECT factor_i, factor_j, round(v * sc, 9) + 0.0 AS value FROM s, (SELECT sc FROM reg ORDER BY date DESC LIMIT 1)")
def cov_regime_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cv.scale(cv.sample(sector_factors(spark, sf_dir)), cv.detect_regime(qt.demo_daily(spark, sf_dir))), "value", digits=9)


# Matrices.


@query(
    f"""WITH {S}, e AS (SELECT s.factor_i, s.factor_j, (a.v + b.v) / 2 AS m, sqrt(pow((a.v - b.v) / 2, 2) + s.v * s.v) AS q, a.v AS av, b.v AS bv FROM s JOIN s a ON a.factor_i = s.factor_i AND a.factor_j = s.factor_i JOIN s b ON b.factor_i = s.factor_j AND b.factor_j = s.factor_j WHERE s.factor_i < s.factor_j)
SELECT factor_i, factor_j, round(m + q, 9) + 0.0 AS high, round(m - q, 9) + 0.0 AS low, round((m + q) / (m - q), 4) + 0.0 AS condition_number, av > 0 AND bv > 0 AND m - q > 1e-10 AS positive_definite FROM e"""
)
def eigen_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(mx.eigen_2x2(cv.sample(sector_factors(spark, sf_dir))), "high", "low", digits=9), "condition_number", digits=4)


def _parts(df: DataFrame) -> DataFrame:
    """rank, eigenvalue, and i, x: the entries of the vectors by position."""
    return df.select("rank", "eigenvalue", F.posexplode("vector").alias("i", "x"))


@query(f"WITH {S}, k AS (SELECT count(*) AS k FROM s WHERE factor_i = factor_j) SELECT count(*) AS n, max(k) AS ranks, round(sum(v) FILTER (factor_i = factor_j), 10) + 0.0 AS total, round(sum(v * v), 12) + 0.0 AS squares, max(k)::DOUBLE AS lengths, true AS falling FROM s, k")
def eigen_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the eigenvalues and vectors must give: the matrix's trace and squared norm, unit vectors, falling order."""
    df = mx.eigen_frame(cv.sample(sector_factors(spark, sf_dir)))
    value = df.agg(F.count(F.lit(1)).alias("ranks"), F.sum("eigenvalue").alias("total"), F.sum(F.col("eigenvalue") ** 2).alias("squares"), F.array_sort(F.collect_list(F.struct("rank", "eigenvalue"))).alias("v"))
    value = value.withColumn("falling", F.forall(F.transform("v", lambda x, i: (i == 0) | (F.get("v", i - 1)["eigenvalue"] >= x["eigenvalue"])), lambda x: x)).drop("v")
    lengths = _parts(df).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x") ** 2).alias("lengths"))
    df = value.join(F.broadcast(lengths))  # one row each
    return rounded(rounded(rounded(df, "total", digits=10), "squares", digits=12), "lengths", digits=8).select("n", "ranks", "total", "squares", "lengths", "falling")


@query(f"WITH {S}, f AS (SELECT factor_i AS f, row_number() OVER (ORDER BY factor_i) - 1 AS i FROM s GROUP BY 1) SELECT a.i::INTEGER AS i, b.i::INTEGER AS j, {r('v', 'value', 9)} FROM s JOIN f a ON a.f = factor_i JOIN f b ON b.f = factor_j")
def eigen_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The covariance put together again from its eigenvalues and vectors."""
    p = _parts(mx.eigen_frame(cv.sample(sector_factors(spark, sf_dir))))
    both = p.join(p.select("rank", F.col("i").alias("j"), F.col("x").alias("y")), "rank")
    return rounded(both.groupBy("i", "j").agg(F.sum(F.col("eigenvalue") * F.col("x") * F.col("y")).alias("value")), "value", digits=9)


# Sector returns add up to zero each date, so their covariance has one eigenvalue of zero, whose vector is
# the same for all factors; raising it to the floor adds floor / K to each entry.
LIFTED = S + f", tr AS (SELECT sum(v) AS t, count(*) AS k FROM s WHERE factor_i = factor_j), up AS (SELECT factor_i, factor_j, v, v + {mx.FLOOR} / k AS lifted, t, t / (t + {mx.FLOOR}) AS shrink FROM s, tr)"


@query(f"WITH {LIFTED} SELECT factor_i, factor_j, round(1e10 * (lifted * shrink - v), 2) + 0.0 AS change FROM up")
def pd_enforced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _change(spark, sf_dir, "clip")


@query(f"WITH {LIFTED} SELECT factor_i, factor_j, round(1e10 * (lifted - v), 2) + 0.0 AS change FROM up")
def pd_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _change(spark, sf_dir, "nearest")


def _change(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    """What the repair adds to each entry, in units of the floor."""
    cov = cv.sample(sector_factors(spark, sf_dir))
    both = mx.repair_frame(cov, method=method).join(cov.select("factor_i", "factor_j", F.col("value").alias("v")), ["factor_i", "factor_j"])
    return rounded(both.select("factor_i", "factor_j", ((F.col("value") - F.col("v")) * 1e10).alias("change")), "change", digits=2)


@query(f"WITH {S} SELECT bump > 0 AS positive_definite, round(sum(v + bump) FILTER (factor_i = factor_j), 9) + 0.0 AS trace FROM s, (VALUES (0.0), (1e-6)) t(bump) GROUP BY bump")
def matrix_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The singular covariance, and the same with a millionth more on its diagonal."""
    cov = cv.sample(sector_factors(spark, sf_dir))
    more = cov.withColumn("value", F.col("value") + F.when(F.col("factor_i") == F.col("factor_j"), 1e-6).otherwise(0.0))
    both = cov.withColumn("kind", F.lit("plain")).unionByName(more.withColumn("kind", F.lit("more")))
    return rounded(mx.diagnose_frame(both, "kind").select("positive_definite", "trace"), "trace", digits=9)


# Specific risk and the model.

SPEC = RES + """, n AS (SELECT symbol, date, sector, residual, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS t, count(*) OVER (PARTITION BY symbol) AS n FROM res),
sv AS (SELECT symbol, max(sector) AS sector, count(*) AS n, CASE WHEN count(*) >= 60 THEN sqrt(12 * sum((CASE WHEN t = 0 THEN pow(0.95, n - 1) ELSE 0.05 * pow(0.95, n - 1 - t) END) * residual * residual)) END AS ewma,
  CASE WHEN count(*) >= 60 THEN sqrt(12 * var_samp(residual)) END AS hist FROM n GROUP BY symbol)"""


def _specific(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    return sp.specific_risk(rg.residuals(panel(spark, sf_dir)).select("date", "symbol", "residual"), method, periods_per_year=12)


@query(f"WITH {SPEC} SELECT symbol, n, {r('hist', 'volatility')} FROM sv")
def specific_historical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_specific(spark, sf_dir, "historical"), "volatility")


@query(f"WITH {SPEC} SELECT symbol, n, {r('ewma', 'volatility')} FROM sv")
def specific_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_specific(spark, sf_dir, "ewma"), "volatility")


@query(f"WITH {SPEC}, k AS (SELECT *, coalesce(hist, 0.3) AS v, avg(coalesce(hist, 0.3)) OVER (PARTITION BY sector) AS prior FROM sv) SELECT symbol, {r('prior')}, {r('n / (n + 60.0)', 'weight')}, round(n / (n + 60.0) * v + (1 - n / (n + 60.0)) * prior, 8) + 0.0 AS shrunk FROM k")
def specific_bayes_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = quotes(spark, sf_dir).select("symbol", "sector").distinct()
    return rounded(sp.bayesian(_specific(spark, sf_dir, "historical").join(groups, "symbol"), group="sector").select("symbol", "prior", "weight", "shrunk"), "prior", "weight", "shrunk")


@query(f"WITH {SPEC} SELECT symbol, round(coalesce(n / (n + 60.0) * hist + (1 - n / (n + 60.0)) * 0.25, 0.25), 8) + 0.0 AS shrunk FROM sv")
def specific_bayes_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sp.bayesian(_specific(spark, sf_dir, "historical").withColumn("prior", F.lit(0.25))).select("symbol", "shrunk"), "shrunk")


RISK = SPEC + f""", s AS ({PAIR}, avg(a.r * b.r) AS v FROM (SELECT date, factor, ret - avg(ret) OVER (PARTITION BY factor) AS r FROM fr) a JOIN (SELECT date, factor, ret - avg(ret) OVER (PARTITION BY factor) AS r FROM fr) b USING (date) GROUP BY 1, 2),
wt AS (SELECT symbol, max(sector) AS sector, 1.0 / count(*) OVER () AS w FROM (SELECT DISTINCT symbol, sector FROM quotes) GROUP BY symbol), x AS (SELECT sector AS factor, sum(w) AS x FROM wt GROUP BY 1),
fv AS (SELECT sum(a.x * v * b.x) AS f FROM s JOIN x a ON a.factor = factor_i JOIN x b ON b.factor = factor_j), sp AS (SELECT coalesce(sum(w * w * hist * hist), 0) AS q FROM wt JOIN sv USING (symbol))"""


def _risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = quotes(spark, sf_dir).select("symbol", "sector").distinct()
    n = own.agg((1 / F.count(F.lit(1))).alias("weight"))
    weights = own.join(F.broadcast(n)).select("symbol", "weight")  # one row
    exposures = own.select("symbol", F.col("sector").alias("factor"), F.lit(1.0).alias("exposure"))
    specific = _specific(spark, sf_dir, "historical").select("symbol", (F.col("volatility") ** 2).alias("variance"))
    return md.risk_decomposition(weights, exposures, cv.sample(sector_factors(spark, sf_dir)), specific)


@query(f"WITH {RISK} SELECT {r('f', 'factor_variance', 9)}, {r('q', 'specific_variance', 9)}, {r('f + q', 'total_variance', 9)} FROM fv, sp")
def portfolio_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_risk(spark, sf_dir).select("factor_variance", "specific_variance", "total_variance"), "factor_variance", "specific_variance", "total_variance", digits=9)


@query(f"WITH {RISK} SELECT {r('sqrt(greatest(f, 0))', 'factor_risk', 7)}, {r('sqrt(q)', 'specific_risk', 7)}, {r('sqrt(f + q)', 'total_risk', 7)} FROM fv, sp")
def risk_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_risk(spark, sf_dir).select("factor_risk", "specific_risk", "total_risk"), "factor_risk", "specific_risk", "total_risk", digits=7)


@query(f"WITH {RISK} SELECT {r('12 * f', 'factor_variance', 9)}, {r('q', 'specific_variance', 9)}, {r('sqrt(12 * f + q)', 'total_risk', 7)} FROM fv, sp")
def risk_model_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RiskModel fitted on sector returns and residuals, both on a year, and asked for the equal portfolio."""
    own = quotes(spark, sf_dir).select("symbol", "sector").distinct()
    n = own.agg((1 / F.count(F.lit(1))).alias("weight"))
    model = md.RiskModel(cv.sample, annualize_factor_cov=True, periods_per_year=12).fit(sector_factors(spark, sf_dir), rg.residuals(panel(spark, sf_dir)).select("date", "symbol", "residual"), method="historical", strict=False)
    df = model.decompose(own.join(F.broadcast(n)).select("symbol", "weight"), own.select("symbol", F.col("sector").alias("factor"), F.lit(1.0).alias("exposure")))  # one row
    return rounded(rounded(df.select("factor_variance", "specific_variance", "total_risk"), "factor_variance", "specific_variance", digits=9), "total_risk", digits=7)


# Attribution: each symbol's market and sector terms over all dates.

ATT = FR + """, tr AS (SELECT symbol, sector, sum(wr) AS total FROM ww GROUP BY 1, 2),
c AS (SELECT ww.symbol, 'market' AS factor, 1.0 AS exposure, sum(market) AS factor_return FROM ww JOIN sf USING (date, sector) GROUP BY 1 UNION ALL SELECT ww.symbol, sector, 1.0, sum(sf.ret) FROM ww JOIN sf USING (date, sector) GROUP BY 1, 2),
k AS (SELECT c.symbol, factor, exposure, factor_return, exposure * factor_return AS contribution, total FROM c JOIN tr ON tr.symbol = c.symbol)"""


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel(spark, sf_dir)
    w = rg.weighted(rows).select("symbol", "date", "sector", "ret")
    s = rg.sector_returns(rows).select("date", "sector", "market", F.col("ret").alias("s"))
    per = w.join(s, ["date", "sector"]).groupBy("symbol", "sector").agg(F.sum("ret").alias("total_return"), F.sum("market").alias("m"), F.sum("s").alias("s"))
    parts = F.array(F.struct(F.lit("market").alias("factor"), F.col("m").alias("factor_return")), F.struct(F.col("sector").alias("factor"), F.col("s").alias("factor_return")))
    df = per.select("symbol", "total_return", F.explode(parts).alias("p")).select("symbol", "total_return", "p.*", F.lit(1.0).alias("exposure"))
    return at.factor_attribution(df)


@query(f"WITH {ATT} SELECT symbol, factor, {r('contribution', digits=7)}, round(CASE WHEN abs(total) > 1e-10 THEN 100 * contribution / total ELSE 0 END, 4) + 0.0 AS contribution_pct FROM k")
def factor_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(contributions(spark, sf_dir).select("symbol", "factor", "contribution", "contribution_pct"), "contribution", digits=7), "contribution_pct", digits=4)


@query(f"WITH {ATT}, g AS (SELECT symbol, max(total) AS t, sum(contribution) AS f FROM k GROUP BY 1) SELECT symbol, {r('t', 'total_return', 7)}, {r('f', 'factor_return', 7)}, {r('t - f', 'specific_return', 7)}, round(CASE WHEN abs(t) < 1e-10 THEN 0 ELSE greatest(0, least(1, pow(f / t, 2))) END, 6) + 0.0 AS r_squared FROM g")
def security_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(at.security_attribution(contributions(spark, sf_dir)).drop("explained_ratio"), "total_return", "factor_return", "specific_return", digits=7), "r_squared", digits=6)


OVER_TIME = RES + """, o AS (SELECT res.symbol, 'market' AS factor, market AS ret, residual FROM res JOIN sf USING (date, sector) UNION ALL SELECT res.symbol, sector, sf.ret, residual FROM res JOIN sf USING (date, sector)),
idio AS (SELECT symbol, sum(residual) AS rest FROM res GROUP BY 1), ot AS (SELECT symbol, factor, sum(ret) AS c FROM o GROUP BY 1, 2), al AS (SELECT symbol, sum(c) AS f FROM ot GROUP BY 1)"""


@query(f"WITH {OVER_TIME} SELECT symbol, factor, 1.0::DOUBLE AS exposure, {r('c', 'factor_return', 7)}, {r('c', 'contribution', 7)}, {r('rest', 'specific_return', 7)}, {r('f + rest', 'total_return', 7)} FROM ot JOIN idio USING (symbol) JOIN al USING (symbol)")
def attribution_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol's return over all dates: market, sector and what is left."""
    rows = panel(spark, sf_dir)
    left = rg.residuals(rows).select("date", "symbol", "sector", "residual")
    exposures = left.select("symbol", "date", F.explode(F.array(F.lit("market"), F.col("sector"))).alias("factor"), F.lit(1.0).alias("exposure"))
    df = at.attribution_over_time(exposures, rg.factor_returns(rows), left)
    return rounded(df.select("symbol", "factor", "exposure", "factor_return", "contribution", "specific_return", "total_return"), "factor_return", "contribution", "specific_return", "total_return", digits=7)


@query(f"WITH {ATT}, g AS (SELECT symbol, max(total) AS t, sum(contribution) AS f FROM k GROUP BY 1) SELECT {r('avg(t)', 'total_return', 7)}, {r('avg(f)', 'factor_return', 7)}, {r('avg(t) - avg(f)', 'specific_return', 7)} FROM g")
def portfolio_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(at.portfolio_attribution(contributions(spark, sf_dir))[0].select("total_return", "factor_return", "specific_return"), "total_return", "factor_return", "specific_return", digits=7)


@query(f"WITH {ATT}, n AS (SELECT count(DISTINCT symbol) AS n FROM k) SELECT factor, {r('sum(exposure) / max(n)', 'exposure', 7)}, {r('sum(contribution) / max(n)', 'contribution', 7)} FROM k, n GROUP BY factor")
def portfolio_equal_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(at.portfolio_attribution(contributions(spark, sf_dir))[1].select("factor", "exposure", "contribution"), "exposure", "contribution", digits=7)


@query(f"WITH {ATT}, g AS (SELECT symbol, max(total) AS t, sum(contribution) AS f FROM k GROUP BY 1), w AS (SELECT symbol, sum(cap) / (SELECT sum(cap) FROM p) AS w FROM p GROUP BY 1) SELECT {r('sum(w * t)', 'total_return', 7)}, {r('sum(w * f)', 'factor_return', 7)} FROM g JOIN w USING (symbol)")
def portfolio_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    caps = panel(spark, sf_dir).groupBy("symbol").agg(F.sum("market_cap").alias("c"))
    weights = caps.join(F.broadcast(caps.agg(F.sum("c").alias("all")))).select("symbol", (F.col("c") / F.col("all")).alias("weight"))  # one row
    return rounded(at.portfolio_attribution(contributions(spark, sf_dir), weights)[0].select("total_return", "factor_return"), "total_return", "factor_return", digits=7)


# Risk summary: exposures are sector weights, volatilities those of the sector returns.

SUMMARY = FR + """, e AS (SELECT sector AS factor, count(DISTINCT symbol) * 1.0 / (SELECT count(DISTINCT symbol) FROM quotes) AS b FROM quotes GROUP BY 1), v AS (SELECT factor, stddev_samp(ret) AS s FROM fr GROUP BY 1),
k AS (SELECT factor, b, s, b * s * s AS marginal, b * b * s * s AS c FROM e JOIN v USING (factor)), t AS (SELECT sum(c) AS fv, sum(c) + 0.0025 AS tv FROM k)"""


def _summary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = quotes(spark, sf_dir).select("symbol", "sector").distinct()
    n = own.agg(F.count(F.lit(1)).alias("n"))
    e = own.groupBy(F.col("sector").alias("factor")).agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(n)).select("factor", (F.col("k") / F.col("n")).alias("exposure"))  # one row
    v = sector_factors(spark, sf_dir).groupBy("factor").agg(F.stddev_samp("ret").alias("volatility"))
    return sm.risk_summary(e, v, 0.05, 1e6)


@query(f"WITH {SUMMARY} SELECT factor, {r('b', 'exposure', 7)}, {r('s', 'volatility', 7)}, {r('marginal', digits=9)}, {r('c', 'contribution', 10)}, {r('100 * c / tv', 'contribution_pct', 6)} FROM k, t")
def risk_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rounded(_summary(spark, sf_dir)[1], "exposure", "volatility", digits=7)
    return rounded(rounded(rounded(df, "marginal", digits=9), "contribution", digits=10), "contribution_pct", digits=6)


@query(f"WITH {SUMMARY} SELECT {r('sqrt(tv)', 'total_risk')}, {r('sqrt(fv)', 'factor_risk')}, {r('1.645 * sqrt(tv)', 'var_95')}, {r('2.326 * sqrt(tv)', 'var_99')}, {r('1645000 * sqrt(tv)', 'var_95_value', 3)}, {r('sqrt(fv) / sqrt(tv)', 'factor_ratio', 7)}, {r('0.05 / sqrt(tv)', 'specific_ratio', 7)} FROM t")
def risk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _summary(spark, sf_dir)[0].select("total_risk", "factor_risk", "var_95", "var_99", "var_95_value", "factor_ratio", "specific_ratio")
    return rounded(rounded(rounded(df, "total_risk", "factor_risk", "var_95", "var_99"), "var_95_value", digits=3), "factor_ratio", "specific_ratio", digits=7)


# Filings.

PRIORITY_TAGS = {"1-URGENT": "us-gaap:Revenues", "2-HIGH": "us-gaap:NetIncomeLoss", "3-MEDIUM": "us-gaap:Assets", "4-NOT SPECIFIED": "us-gaap:StockholdersEquity", "5-LOW": "us-gaap:SalesRevenueNet"}
TAG_CASE = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PRIORITY_TAGS.items()) + " END"
FACTS = f"""facts AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, {TAG_CASE} AS concept, o_totalprice AS value, 'USD' AS unit, CAST(o_orderdate AS DATE) AS period_end, NULL AS period_start,
  CASE WHEN quarter(o_orderdate) = 4 THEN '10-K' ELSE '10-Q' END AS form, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, 'Q' || quarter(o_orderdate) AS fiscal_period, CAST(o_orderkey AS INTEGER) AS pos FROM orders)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as fact rows: the customer is the company, the priority the concept."""
    o, d = table(spark, sf_dir, "orders"), F.to_date("o_orderdate")
    return o.select(
        F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"), F.expr(TAG_CASE).alias("concept"), F.col("o_totalprice").alias("value"), F.lit("USD").alias("unit"), d.alias("period_end"), F.lit(None).cast("date").alias("period_start"),
        F.when(F.quarter(d) == 4, "10-K").otherwise("10-Q").alias("form"), F.year(d).alias("fiscal_year"), F.concat(F.lit("Q"), F.quarter(d)).alias("fiscal_period"), F.col("o_orderkey").cast("int").alias("pos"),
    )


@query(f"WITH {FACTS}, k AS (SELECT *, row_number() OVER (PARTITION BY cik, concept ORDER BY period_end DESC, pos DESC) AS k FROM facts) SELECT cik, concept, period_end, value, unit, form, fiscal_year, fiscal_period FROM k WHERE k = 1")
def facts_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.latest_facts(facts(spark, sf_dir))


@query(f"WITH {FACTS} SELECT cik, pos, value FROM facts WHERE concept = 'us-gaap:Revenues' AND form = '10-K' AND fiscal_year = 1997")
def facts_by_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.facts_of(facts(spark, sf_dir), "us-gaap:Revenues", fiscal_year=1997, form="10-K").select("cik", "pos", "value")


@query(f"WITH {FACTS} SELECT DISTINCT concept FROM facts")
def facts_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.concepts(facts(spark, sf_dir))


NAMES = "CASE concept WHEN 'us-gaap:Revenues' THEN 'revenue' WHEN 'us-gaap:SalesRevenueNet' THEN 'revenue' WHEN 'us-gaap:NetIncomeLoss' THEN 'net_income' WHEN 'us-gaap:Assets' THEN 'total_assets' ELSE 'stockholders_equity' END"
PICKED = FACTS + f""", picked AS (SELECT cik, fiscal_year, fiscal_period, form, m, value FROM (SELECT *, {NAMES} AS m, row_number() OVER (PARTITION BY cik, fiscal_year, fiscal_period, form, {NAMES} ORDER BY concept = 'us-gaap:SalesRevenueNet', pos DESC) AS k FROM facts) WHERE k = 1),
stm AS (SELECT f.cik, max(f.period_end) AS period_end, CASE f.form WHEN '10-Q' THEN 'Q' ELSE 'A' END AS period_type, f.fiscal_year, CAST(substr(f.fiscal_period, 2, 1) AS INTEGER) AS fiscal_quarter,
  max(CASE WHEN m = 'revenue' THEN p.value END) AS revenue, max(CASE WHEN m = 'net_income' THEN p.value END) AS net_income, max(CASE WHEN m = 'total_assets' THEN p.value END) AS total_assets, max(CASE WHEN m = 'stockholders_equity' THEN p.value END) AS stockholders_equity
  FROM facts f JOIN picked p USING (cik, fiscal_year, fiscal_period, form) GROUP BY f.cik, f.form, f.fiscal_year, f.fiscal_period)"""
STM_COLS = ["cik", "period_end", "period_type", "fiscal_year", "fiscal_quarter", "revenue", "net_income", "total_assets", "stockholders_equity"]


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.statements(facts(spark, sf_dir), fl.tag_dim(spark))


@query(f"WITH {PICKED} SELECT cik, fiscal_year, fiscal_period, form, m AS name, value FROM picked")
def facts_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*(F.lit(x) for n, m in fl.METRIC_OF.items() for x in (n, m)))
    return fl.extract(facts(spark, sf_dir), fl.tag_dim(spark)).withColumn("name", F.element_at(names, F.col("name")))


@query(f"WITH {PICKED} SELECT {', '.join(STM_COLS)} FROM stm")
def statement_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statements(spark, sf_dir).select(*STM_COLS)


@query(f"WITH {PICKED}, k AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY period_end DESC, fiscal_year DESC, fiscal_quarter DESC) AS k FROM stm WHERE period_type = 'Q') SELECT {', '.join(STM_COLS)} FROM k WHERE k = 1")
def statements_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.latest_statements(_statements(spark, sf_dir), "Q").select(*STM_COLS)


# Of the eight ratios those on items that orders don't stand for take fixed shares of the ones that they do.
INPUTS = {"shares_outstanding": "total_assets / 50", "eps_diluted": "net_income / 2000", "eps_basic": "net_income / 1900", "long_term_debt": "total_assets * 0.3", "current_assets": "total_assets * 0.4", "current_liabilities": "revenue * 0.5"}
_ABOVE = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} END"
RATIOS = {
    "book_value_per_share": _ABOVE("stockholders_equity", "shares_outstanding"), "roe": _ABOVE("net_income", "stockholders_equity"), "roa": _ABOVE("net_income", "total_assets"), "debt_to_equity": _ABOVE("long_term_debt", "stockholders_equity"),
    "current_ratio": _ABOVE("current_assets", "current_liabilities"), "price_to_book": _ABOVE("100.0", f"({_ABOVE('stockholders_equity', 'shares_outstanding')})"), "earnings_per_share": "coalesce(eps_diluted, eps_basic)", "price_to_earnings": _ABOVE("100.0", "coalesce(eps_diluted, eps_basic)"),
}


@query(f"WITH {PICKED}, i AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in INPUTS.items())} FROM stm) SELECT cik, period_end, {', '.join(r(v, k, 6) for k, v in RATIOS.items())} FROM i")
def factor_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _statements(spark, sf_dir).withColumns({k: F.expr(v) for k, v in INPUTS.items()}).withColumn("price", F.lit(100.0))
    return rounded(fl.factor_inputs(df).select("cik", "period_end", *RATIOS), *RATIOS, digits=6)


@query(
    f"""WITH {Q}, {PICKED}, i AS (SELECT *, period_end + 45 AS filed, {', '.join(f'{v} AS {k}' for k, v in INPUTS.items())} FROM stm),
k AS (SELECT q.symbol, q.date, q.close AS price, i.*, row_number() OVER (PARTITION BY q.symbol, q.date ORDER BY i.filed DESC NULLS LAST) AS k FROM quotes q LEFT JOIN i ON i.cik = lpad(q.symbol, 10, '0') AND i.filed <= q.date)
SELECT symbol, date, period_end, filed, {', '.join(r(v.replace('100.0', 'price'), k, 6) for k, v in RATIOS.items())} FROM k WHERE k = 1"""
)
def statement_ratios_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each price with the ratios of the newest statement filed by then, 45 days after its last order; supplier and customer of one number are one company."""
    known = facts(spark, sf_dir).withColumn("filed", F.date_add("period_end", 45))
    own = fl.statements(known, fl.tag_dim(spark)).withColumns({k: F.expr(v) for k, v in INPUTS.items()})
    links = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"), F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("cik"))
    prices = quotes(spark, sf_dir).select("symbol", "date", F.col("close").alias("price"))
    return rounded(fl.ratios_as_of(prices, own, links).select("symbol", "date", "period_end", "filed", *RATIOS), *RATIOS, digits=6)


@query(f"WITH {PICKED} SELECT a.cik, a.period_end, round(CASE WHEN b.revenue > 0 THEN (a.revenue - b.revenue) / b.revenue END, 8) AS revenue_growth, round(CASE WHEN b.net_income > 0 THEN (a.net_income - b.net_income) / b.net_income END, 8) AS earnings_growth FROM stm a LEFT JOIN stm b ON a.cik = b.cik AND a.period_type = b.period_type AND a.fiscal_quarter = b.fiscal_quarter AND a.fiscal_year = b.fiscal_year + 1")
def factor_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fl.growth_inputs(_statements(spark, sf_dir)).select("cik", "period_end", "revenue_growth", "earnings_growth"), "revenue_growth", "earnings_growth")


@query("SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, 'us-gaap:Assets' AS concept, CAST(o_orderkey AS DOUBLE) AS value, 'USD' AS unit, CAST(o_orderdate AS DATE) AS period_end FROM orders")
def json_facts_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company payloads are built of orders, serialised, and flattened again."""
    fact = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("end"), F.col("o_orderkey").cast("double").alias("val"), F.lit("10-Q").alias("form"))
    own = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(fact).alias("list"))
    body = F.struct(F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"), F.create_map(F.lit("us-gaap"), F.create_map(F.lit("Assets"), F.struct(F.create_map(F.lit("USD"), F.col("list")).alias("units")))).alias("facts"))
    return fl.flatten_company_facts(own.select(F.to_json(body).alias("value"))).select("cik", "concept", "value", "unit", "period_end")


FILED = """SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, printf('%010d-%02d', o_orderkey, year(o_orderdate) % 100) AS accession, CASE WHEN quarter(o_orderdate) = 4 THEN '10-K' ELSE '10-Q' END AS form, CAST(o_orderdate AS DATE) AS filed, o_orderkey,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) - 1 AS pos FROM orders"""


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    row = F.struct((-F.unix_date(d)).alias("o"), F.col("o_orderkey").alias("k"), F.format_string("%010d-%02d", F.col("o_orderkey"), F.year(d) % 100).alias("a"), F.when(F.quarter(d) == 4, "10-K").otherwise("10-Q").alias("f"), d.cast("string").alias("d"), F.lit("main.htm").alias("p"))
    own = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(row)).alias("x"))
    recent = F.struct(F.col("x.a").alias("accessionNumber"), F.col("x.f").alias("form"), F.col("x.d").alias("filingDate"), F.col("x.p").alias("primaryDocument"), F.col("x.d").alias("reportDate"))
    body = F.struct(F.col("o_custkey").cast("string").alias("cik"), F.struct(recent.alias("recent")).alias("filings"))
    rows = fl.filings(own.select(F.to_json(body).alias("value")))
    return rows.withColumn("cik", fl.pad_cik(F.col("cik")))


@query(f"SELECT cik, pos::INTEGER AS pos, accession, filed FROM ({FILED}) WHERE form = '10-K'")
def filings_by_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.filings_by_form(_filings(spark, sf_dir), "10-K").select("cik", "pos", "accession", "filed")


@query(f"SELECT cik, accession, filed, 'https://www.sec.gov/Archives/edgar/data/' || ltrim(cik, '0') || '/' || replace(accession, '-', '') || '/main.htm' AS url FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY pos) AS k FROM ({FILED}) WHERE form = '10-Q') WHERE k = 1")
def filings_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fl.latest_filing(_filings(spark, sf_dir), "10-Q")
    return df.select("cik", "accession", "filed", fl.document_url(F.ltrim("cik", F.lit("0")), F.col("accession"), F.col("document")).alias("url"))


# The store.


@query("WITH " + Q + ", c AS (SELECT symbol, date, round(close * volume, 2) AS v FROM quotes), new AS (SELECT symbol, date, v * 2 AS v FROM c WHERE date >= DATE '2001-01-01' UNION ALL SELECT 'new', DATE '2001-01-01', 1.0) SELECT symbol, date, round(v, 2) + 0.0 AS turnover FROM (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.symbol = c.symbol AND n.date = c.date) UNION ALL SELECT * FROM new)")
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = quotes(spark, sf_dir).select("symbol", "date", F.round(F.col("close") * F.col("volume"), 2).alias("turnover"))
    extra = spark.range(1).select(F.lit("new").alias("symbol"), F.lit(dt.date(2001, 1, 1)).alias("date"), F.lit(1.0).alias("turnover"))
    new = old.filter("date >= '2001-01-01'").withColumn("turnover", F.col("turnover") * 2).union(extra)
    return rounded(st.upsert(old, new, ["symbol", "date"]), "turnover", digits=2)


@query(f"WITH {Q} SELECT count(*) AS quotes, count(DISTINCT symbol) AS symbols FROM quotes")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.stats(quotes(spark, sf_dir))


@query(f"WITH {Q}, w AS (SELECT DISTINCT symbol FROM quotes UNION ALL SELECT 'none'), h AS (SELECT symbol, count(*) AS n FROM quotes WHERE date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' GROUP BY 1) SELECT symbol, coalesce(n, 0) AS n, 10::BIGINT AS needed, coalesce(n, 0) >= 10 AS covered FROM w LEFT JOIN h USING (symbol)")
def cache_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = quotes(spark, sf_dir)
    wanted = own.select("symbol").distinct().union(spark.range(1).select(F.lit("none")))
    return st.coverage(own, wanted, dt.date(1999, 1, 1), dt.date(1999, 12, 31), 0.03)


@query(f"WITH {Q} SELECT symbol, date, {r('close * volume', 'turnover', 2)} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM quotes) WHERE k = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = st.latest_per_key(quotes(spark, sf_dir), ["symbol"], "date")
    return last.select("symbol", "date", F.round(F.col("close") * F.col("volume"), 2).alias("turnover"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS symbol FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-10-01')")
def miss_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"))
    return st.miss_set(wanted, table(spark, sf_dir, "lineitem").filter("l_shipdate >= '2001-10-01'").select(F.col("l_suppkey").cast("string").alias("symbol")))


# Exports and fixtures.


@query(f"WITH {SPEC} SELECT symbol, component, round(value, 7) + 0.0 AS value FROM (SELECT symbol, 'total' AS component, hist AS value FROM sv WHERE hist IS NOT NULL UNION ALL SELECT symbol, 'factor', hist * 0.5 FROM sv WHERE hist IS NOT NULL UNION ALL SELECT symbol, 'specific', hist * 0.25 FROM sv WHERE hist IS NOT NULL UNION ALL SELECT symbol, 'factor_size', hist * 0.125 FROM sv WHERE hist IS NOT NULL)")
def export_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("volatility")
    df = _specific(spark, sf_dir, "historical").filter("volatility is not null").select("symbol", v.alias("total_risk"), (v * 0.5).alias("factor_risk"), (v * 0.25).alias("specific_risk"), F.create_map(F.lit("size"), v * 0.125).alias("factor_contributions"))
    return rounded(ex.flatten_decomposition(df), "value", digits=7)


@query("WITH w(factor, a, f, b, g, s) AS (VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {f}::DOUBLE, {b}::DOUBLE, {g}::DOUBLE, {str(s).upper()})" for n, a, f, b, g, s in qt.WAVES) + ") SELECT CAST(DATE '2024-01-01' + t::INTEGER AS DATE) AS date, factor, round(a * sin(t / 252.0 * f) + b * CASE WHEN s THEN sin(t / 252.0 * g) ELSE cos(t / 252.0 * g) END, 10) + 0.0 AS ret FROM range(252) x(t), w")
def synthetic_factor_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(qt.synthetic_factor_returns(spark), "ret", digits=10)


@query("SELECT r_name AS name, list_sum(list_transform(string_split(r_name, ''), lambda c: unicode(c)))::INTEGER AS code_sum FROM region")
def char_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), char_sum(F.col("r_name")).alias("code_sum"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathom.streaming.ewma import event_counts

    return rounded(event_counts(table(spark, sf_dir, "events")), "total", digits=6).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(SQL["event_windows"])
def event_windows_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows by a stream over the events' files, run until all are read."""
    from fathom.streaming.ewma import event_counts, last_result

    path = f"{sf_dir}/events.parquet"
    # As a pattern, since a stream's base folder can't be a file.
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/[e]vents.parquet")
    return rounded(last_result(event_counts(rows)), "total", digits=6).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sector_factor_returns(spark, sf_dir)
