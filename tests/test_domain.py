"""Hand-computed values of the factor and risk operators."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom import errors
from fathom.cli import analyze, main, risk_report, universe_text
from fathom.functions.columns import char_sum, ratio, winsorize, zscore
from fathom.operators import attribution as at, covariance as cv, factors as fc, matrix as mx, model as md, panel as pn, regression as rg, specific as sp, summary as sm
from fathom.schema import DDL, METRICS, conform, require
from fathom.sinks import export as ex, report as rp
from fathom.sources import quotes as qt, universe as un

D0 = dt.date(2024, 1, 1)


def long_returns(spark, matrix, names="abcdefghij"):
    rows = [(D0 + dt.timedelta(t), names[k], float(x)) for t, r in enumerate(matrix) for k, x in enumerate(r)]
    return spark.createDataFrame(rows, DDL["factor_returns"])


def dense(cov):
    return mx.dense(cov.toPandas())[1]


@pytest.fixture(scope="module")
def random_returns():
    rng = np.random.default_rng(5)
    return rng.normal(size=(90, 4)) @ np.array([[1, 0.3, 0, 0], [0, 1, 0.2, 0], [0, 0, 1, 0.5], [0, 0, 0, 1]]) * 0.01


def test_panel(spark):
    q = spark.createDataFrame([("A", D0, 10.0, 100), ("A", D0 + dt.timedelta(1), 11.0, 50), ("B", D0, 5.0, 10), ("B", D0 + dt.timedelta(1), 4.0, 20)], "symbol string, date date, close double, volume bigint").withColumn("adjusted_close", F.col("close"))
    got = {(r["symbol"]): r["asset_returns"] for r in pn.compute_returns(q).collect()}
    assert got["A"] == pytest.approx(0.1) and got["B"] == pytest.approx(-0.2)
    rows = pn.factor_panel(q, pn.benchmark_returns(q, "A")).collect()
    assert len(rows) == 2 and all(r["market_return"] == pytest.approx(0.1) for r in rows) and {r["market_cap"] for r in rows} == {550.0, 80.0}
    with pytest.raises(errors.DataError):
        require(q, "nothing")
    assert conform(q, "quotes").columns[:3] == ["symbol", "date", "open"]


def test_as_of(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 6, "z")], "k string, u int, v string")
    assert sorted(map(tuple, pn.as_of(left, right, "k", "t", "u", ["v"]).collect()), key=repr) == [("a", 1, None), ("a", 5, "y"), ("b", 5, None)]


def test_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(ratio(F.col("a"), F.col("b"))).collect()] == [0.5, None, None]
    assert math.isnan(df.select(ratio(F.col("a"), F.col("b"), nan=True)).collect()[1][0])
    assert spark.sql("select 'AAPL' s").select(char_sum(F.col("s"))).first()[0] == 286
    w = winsorize(spark.range(1, 5).select(F.lit(1).alias("d"), F.col("id").cast("double").alias("x")), "x", "d")
    assert w.agg(F.min("x")).first()[0] == pytest.approx(1.15)
    z = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0), (3, 2.0), (3, 2.0)], "d int, x double").select("d", zscore(F.col("x"), "d").alias("z")).collect()
    assert sorted(abs(r["z"]) for r in z if r["d"] == 1) == pytest.approx([0.7071067811865475] * 2) and all(r["z"] is None for r in z if r["d"] != 1)


def test_factors(spark):
    rng = np.random.default_rng(0)
    days, names = 170, ["A", "B", "C"]
    price = 100 * np.cumprod(1 + rng.normal(0, 0.01, (days, 3)), axis=0)
    q = spark.createDataFrame([(names[k], D0 + dt.timedelta(t), float(price[t, k]), float(price[t, k]), 1000 + t) for t in range(days) for k in range(3)], "symbol string, date date, close double, adjusted_close double, volume bigint")
    rows = pn.factor_panel(q, pn.average_market(pn.compute_returns(q)))
    raw = fc.raw_factors(rows).filter(F.col("date") == F.lit(D0 + dt.timedelta(days - 1)) ).orderBy("symbol").toPandas()
    ret = price[1:] / price[:-1] - 1
    mkt = ret.mean(axis=1)
    assert raw["momentum"].to_numpy() == pytest.approx(price[-22] / price[-148] - 1)
    assert raw["beta"].to_numpy() == pytest.approx([np.cov(ret[-126:, k], mkt[-126:])[0, 1] / mkt[-126:].var(ddof=1) for k in range(3)])
    assert raw["volatility"].to_numpy() == pytest.approx(ret[-63:].std(axis=0, ddof=1) * 252**0.5)
    scores = fc.scores(rows, date="last").toPandas()
    assert len(scores) == 3 and scores["size_score"].sum() == pytest.approx(0, abs=1e-9)
    assert fc.available_factors() == ["momentum", "size", "beta", "volatility", "illiquidity"]
    with pytest.raises(errors.InvalidParameter):
        fc.FactorConfig(beta_min=999)
    hot = fc.one_hot(spark.createDataFrame([("Energy",), (None,), ("?",)], "sector string")).collect()
    assert hot[0]["sector_Energy"] == 1.0 and sum(hot[1][1:]) == sum(hot[2][1:]) == 0.0 and "sector_Health_Care" in hot[0].asDict()


def test_regression_is_the_constrained_fit(spark):
    rng = np.random.default_rng(1)
    n = 40
    rows = [(D0, f"s{i}", "XYZ"[i % 3], float(r), float(c)) for i, (r, c) in enumerate(zip(rng.normal(size=n), rng.uniform(1, 9, n), strict=True))]
    df = spark.createDataFrame(rows, "date date, symbol string, sector string, asset_returns double, market_cap double")
    got = rg.sector_returns(df, winsor=0).toPandas().set_index("sector")
    w = np.sqrt([r[4] for r in rows])
    x = np.array([[1, *(r[2] == s for s in "XY")] if r[2] != "Z" else [1, -1, -1] for r in rows], float)
    b = np.linalg.solve(x.T * w @ x, x.T @ (w * [r[3] for r in rows]))
    assert got["market"].iloc[0] == pytest.approx(b[0]) and got.loc["X", "ret"] == pytest.approx(b[1]) and got["ret"].sum() == pytest.approx(0, abs=1e-12)
    styles = rg.residuals(df, 0).withColumns({"p": F.rand(1), "q": F.rand(2), "z": F.rand(3)}).cache()
    f = rg.style_returns(styles, ["p", "q", "z"]).first()
    d = styles.toPandas()
    X, W, y = d[["p", "q", "z"]].to_numpy(), d["w"].to_numpy(), d["residual"].to_numpy()
    assert [f["f_p"], f["f_q"], f["f_z"]] == pytest.approx(np.linalg.solve(X.T * W @ X, X.T @ (W * y)))
    two = rg.style_returns(styles, ["p", "q"]).first()
    cramer = rg.style_returns_sql(styles, ["p", "q"]).first()
    assert (two["f_p"], two["f_q"]) == pytest.approx((cramer["f_p"], cramer["f_q"]))
    left = rg.specific_returns(styles, ["p", "q", "z"]).toPandas()
    assert len(left) == n
    few = rg.style_returns(styles.limit(2), ["p", "q", "z"]).first()
    assert few["f_p"] is None and few["n"] == 2


def test_sample_and_ewma(spark, random_returns):
    assert dense(cv.sample(long_returns(spark, [[1, 2], [2, 4], [3, 6]]), center=False)) == pytest.approx(np.array([[14 / 3, 28 / 3], [28 / 3, 56 / 3]]))
    df = long_returns(spark, random_returns)
    assert dense(cv.sample(df)) == pytest.approx(np.cov(random_returns.T, ddof=0))
    n, lam = len(random_returns), 0.95
    mean, c = random_returns[0].copy(), None
    for r in random_returns[1:]:
        mean = lam * mean + (1 - lam) * r
    y = random_returns - mean
    c = np.outer(y[0], y[0])
    for r in y[1:]:
        c = lam * c + (1 - lam) * np.outer(r, r)
    assert dense(cv.ewma(df, cv.EwmaConfig(bias_correction=False))) == pytest.approx(c)
    assert dense(cv.ewma(df)) == pytest.approx(c * n * (1 - lam) / (1 - lam**n))
    assert cv.EwmaConfig().half_life() == pytest.approx(13.51, abs=0.1)
    with pytest.raises(errors.InvalidParameter):
        cv.EwmaConfig(decay=1.5)
    with pytest.raises(errors.InsufficientData):
        cv.ewma(long_returns(spark, random_returns[:10]))
    new = random_returns[:7]
    u = np.eye(4)
    for r in new:
        u = lam * u + (1 - lam) * np.outer(r, r)
    eye = spark.createDataFrame([(a, b, float(a == b)) for a in "abcd" for b in "abcd"], DDL["covariance"])
    assert dense(cv.ewma_update(eye, long_returns(spark, new))) == pytest.approx(u)
    corr = cv.correlation(cv.sample(df)).toPandas()
    assert corr.loc[corr.factor_i == corr.factor_j, "correlation"].to_numpy() == pytest.approx(1)


def test_shrinkage(spark, random_returns):
    m = lambda rows: spark.createDataFrame([("abc"[i], "abc"[j], float(x)) for i, r in enumerate(rows) for j, x in enumerate(r)], DDL["covariance"])
    assert dense(cv.shrinkage_target(m([[4, 1, 2], [1, 9, 3], [2, 3, 16]]), "identity")) == pytest.approx(np.eye(3) * 29 / 3)
    assert dense(cv.shrinkage_target(m([[4, 2], [2, 9]]), "constant_correlation")) == pytest.approx(np.array([[4, 2], [2, 9]]))
    assert dense(cv.shrinkage_target(m([[4, 2], [2, 9]]), "diagonal")) == pytest.approx(np.diag([4, 9]))
    df = long_returns(spark, random_returns)
    y = random_returns - random_returns.mean(axis=0)
    t, k = y.shape
    s = y.T @ y / t
    for target in cv.TARGETS:
        assert cv.shrinkage_intensity(df, target, "reference").first()["intensity"] == pytest.approx(1)
        f = dense(cv.shrinkage_target(cv.sample(df), target))
        pi = ((y[:, :, None] * y[:, None, :] - s) ** 2).mean(axis=0)
        rho = {"identity": 0, "diagonal": np.trace(pi)}.get(target)
        if rho is None:
            sd = np.sqrt(np.diag(s))
            rbar = (s / np.outer(sd, sd))[np.triu_indices(k, 1)].mean()
            rho = np.trace(pi)
            for i in range(k):
                for j in range(k):
                    if i != j:
                        th = lambda a: ((y[:, a] ** 2 - s[a, a]) * (y[:, i] * y[:, j] - s[i, j])).mean()  # noqa: B023, E731
                        rho += rbar / 2 * (sd[j] / sd[i] * th(i) + sd[i] / sd[j] * th(j))
        delta = min(1, max(0, (pi.sum() - rho) / ((s - f) ** 2).sum() / t))
        assert cv.shrinkage_intensity(df, target).first()["intensity"] == pytest.approx(delta)
        assert dense(cv.ledoit_wolf(df, target)) == pytest.approx(delta * f + (1 - delta) * s)
    with pytest.raises(errors.InvalidParameter):
        cv.shrinkage_target(cv.sample(df), "none")


def test_newey_west(spark, random_returns):
    assert [cv.bartlett(k, 4) for k in range(6)] == pytest.approx([1, 0.8, 0.6, 0.4, 0.2, 0])
    assert [cv.auto_lags(n) for n in (100, 500, 1000)] == [4, 6, 7]
    y = random_returns - random_returns.mean(axis=0)
    n = len(y)
    want = y.T @ y / n
    for k in range(1, 4):
        g = y[k:].T @ y[:-k] / n
        want = want + (1 - k / 4) * (g + g.T)
    assert dense(cv.newey_west(long_returns(spark, random_returns), 3)) == pytest.approx(want)
    assert dense(cv.newey_west(long_returns(spark, np.zeros((10, 2))), 100, 2)) == pytest.approx(np.zeros((2, 2)))
    with pytest.raises(errors.InsufficientData):
        cv.newey_west(long_returns(spark, random_returns[:10]))


def test_regimes(spark):
    def detect(x, config=cv.RegimeConfig()):
        df = spark.createDataFrame([(D0 + dt.timedelta(i), float(v)) for i, v in enumerate(x)], "date date, ret double")
        return cv.detect_regime(df, config).first()

    rng = np.random.default_rng(0)
    calm = rng.normal(0, 0.01, 252)
    assert (detect(np.zeros(252))["regime"], detect(np.zeros(252))["scale"]) == ("Normal", 1.0)
    loud, still = calm.copy(), calm.copy()
    loud[-21:] *= 5
    still[-21:] *= 0.1
    assert detect(loud)["regime"] == "High" and detect(loud, cv.RegimeConfig(max_scale=2))["scale"] <= 2
    assert detect(still)["regime"] == "Low" and detect(still)["scale"] == pytest.approx(1 / 3)
    with pytest.raises(errors.InsufficientData):
        detect(calm[:10])
    for bad in ({"short_window": 0}, {"long_window": 5}, {"low_threshold": 2.0}, {"max_scale": -1.0}):
        with pytest.raises(errors.InvalidParameter):
            cv.RegimeConfig(**bad)
    value = qt.synthetic_factor_returns(spark).filter("factor = 'Value'").select("date", "ret")
    got = cv.detect_regime(value).first()
    assert got["regime"] == "Low" and got["ratio"] == pytest.approx(0.16686, abs=1e-4)


def test_matrices(spark):
    assert mx.eigen(np.diag([1.0, 4, 2]))[0] == pytest.approx([4, 2, 1])
    assert mx.eigen(np.array([[1.0, 2], [2, 1]]))[0] == pytest.approx([3, -1])
    assert mx.is_positive_definite(mx.enforce_positive_definite(np.array([[1.0, 2], [2, 1]]), 1e-6, keep_trace=False), 1e-9)
    assert np.trace(mx.enforce_positive_definite(np.diag([2.0, 1, -0.5]))) == pytest.approx(2.5, abs=0.01)
    assert mx.condition_number(np.eye(3)) == 1 and mx.condition_number(np.diag([1000.0, 1, 0.001])) > 100 and mx.condition_number(np.diag([1.0, 0])) == float("inf")
    assert mx.eigen(mx.nearest_positive_definite(np.array([[1, 0.5], [0.5, 0.25]])))[0].min() > 0
    assert mx.eigen(np.array([[3.0]]))[0] == [3.0] and not mx.is_positive_definite(np.diag([1.0, -1]))
    with pytest.raises(errors.DimensionMismatch):
        mx.square(np.ones((2, 3)))
    cov = spark.createDataFrame([(k, "ab"[i], "ab"[j], x) for k in (1, 2) for i, r in enumerate([[1.0, 2.0], [2.0, 1.0]]) for j, x in enumerate(r)], "k int, factor_i string, factor_j string, value double")
    assert [round(r["eigenvalue"], 9) for r in mx.eigen_frame(cov, "k").orderBy("k", "rank").collect()] == [3, -1, 3, -1]
    assert mx.diagnose_frame(cov, "k").filter("positive_definite").count() == 0
    assert mx.diagnose_frame(mx.repair_frame(cov, "k", "nearest"), "k").agg(F.min("condition_number")).first()[0] > 0


def test_specific_risk(spark):
    df = spark.createDataFrame([(D0 + dt.timedelta(i), "A", float(i + 1)) for i in range(5)] + [(D0, "B", 1.0)], DDL["residuals"])
    got = {r["symbol"]: r for r in sp.specific_risk(df, "historical", min_observations=5, periods_per_year=1).collect()}
    assert got["A"]["volatility"] == pytest.approx(math.sqrt(2.5)) and got["B"]["volatility"] is None
    v = 1.0
    for x in (2, 3, 4, 5):
        v = 0.95 * v + 0.05 * x * x
    assert sp.specific_risk(df, min_observations=5).filter("symbol = 'A'").first()["volatility"] == pytest.approx(math.sqrt(v * 252))
    with pytest.raises(errors.InsufficientData):
        sp.specific_risk(df, strict=True)
    assert [sp.shrink_weight(n) for n in (0, 60, 180, 240, 100)] == pytest.approx([0, 0.5, 0.75, 0.8, 0.625])
    vols = spark.createDataFrame([("A", 60, 0.2, "g"), ("B", 60, 0.4, "g"), ("C", 60, None, "h")], "symbol string, n long, volatility double, g string")
    assert {r["symbol"]: r["shrunk"] for r in sp.bayesian(vols, group="g").collect()} == pytest.approx({"A": 0.25, "B": 0.35, "C": 0.3})
    assert sp.bayesian(vols.withColumn("prior", F.lit(0.1))).filter("symbol = 'C'").first()["shrunk"] == pytest.approx(0.1)


def test_risk_model(spark, random_returns):
    f = long_returns(spark, random_returns)
    rng = np.random.default_rng(2)
    resid = spark.createDataFrame([(D0 + dt.timedelta(t), s, float(x)) for t in range(90) for s, x in zip("XY", rng.normal(size=2), strict=True)], DDL["residuals"])
    weights = spark.createDataFrame([("X", 0.6), ("Y", 0.4)], "symbol string, weight double")
    exposures = spark.createDataFrame([("X", "a", 1.0), ("X", "b", 0.5), ("Y", "a", 0.2)], "symbol string, factor string, exposure double")
    model = md.RiskModel()
    with pytest.raises(errors.RiskModelError):
        model.decompose(weights, exposures)
    got = model.fit(f, resid).decompose(weights, exposures).first()
    c = dense(model.cov)
    x = np.array([0.6 + 0.08, 0.3, 0, 0])
    var = {r["symbol"]: r["variance"] for r in model.variances.collect()}
    assert got["factor_variance"] == pytest.approx(x @ c @ x) and got["specific_variance"] == pytest.approx(0.36 * var["X"] + 0.16 * var["Y"])
    assert got["total_risk"] == pytest.approx(math.sqrt(got["total_variance"]))
    with pytest.raises(errors.RiskModelError):
        model.decompose(weights, exposures.withColumn("factor", F.lit("zz")))


def contributions(spark, rows):
    return at.factor_attribution(spark.createDataFrame(rows, "symbol string, factor string, exposure double, factor_return double, total_return double"))


def test_attribution(spark):
    one = contributions(spark, [("A", "Market", 1.2, 0.10, 0.15)]).first()
    assert (one["contribution"], one["contribution_pct"]) == pytest.approx((0.12, 80))
    df = contributions(spark, [("A", "Market", 1.2, 0.10, 0.15), ("A", "Size", 0.5, 0.05, 0.15)])
    got = at.security_attribution(df).first()
    assert (got["factor_return"], got["specific_return"], got["r_squared"]) == pytest.approx((0.145, 0.005, 0.9344), abs=1e-4)
    assert at.security_attribution(contributions(spark, [("A", "m", 1.0, 0.1, 0.0)])).first()["r_squared"] == 0
    two = contributions(spark, [("A", "m", 1.0, 0.1, 0.15), ("B", "m", 1.0, 0.1, 0.20), ("B", "s", 1.0, 0.02, 0.20)])
    summary, factors = at.portfolio_attribution(two)
    assert summary.first()["total_return"] == pytest.approx(0.175)
    assert [(r["factor"], round(r["contribution"], 9)) for r in factors.collect()] == [("m", 0.1), ("s", 0.01)]
    w = lambda *x: spark.createDataFrame(list(x), "symbol string, weight double")
    assert at.portfolio_attribution(two, w(("A", 0.6), ("B", 0.4)))[0].first()["total_return"] == pytest.approx(0.17)
    for bad in (w(("A", 0.5)), w(("A", 0.5), ("B", 0.4))):
        with pytest.raises(errors.InvalidParameter):
            at.portfolio_attribution(two, bad)
    assert rp.factor_lines(factors)[0] == "m: 10.00% (exposure: 1.000, return: 10.00%)"
    assert rp.security_text("A", "2023-01-01 to 2023-12-31", summary, factors).splitlines() == [
        "Attribution for A (2023-01-01 to 2023-12-31):", "  Total Return: 17.50%", "  Factor Return: 11.00%", "  Specific Return: 6.50%", f"  R-squared: {(0.11 / 0.175) ** 2:.4f}",
        "  Factors:", "    m: 10.00% (exposure: 1.000, return: 10.00%)", "    s: 1.00% (exposure: 0.500, return: 1.00%)",
    ]
    assert rp.portfolio_text("P", "2023", summary, 2).splitlines()[0::5] == ["Portfolio Attribution: P (2023)", "  Securities: 2"]
    text = rp.attribution_table("A", "2024", summary, factors)
    assert "R-squared" in text and "17.50%" in text and "| m |" in rp.attribution_table("A", "2024", summary, factors, markdown=True)


def test_risk_summary(spark):
    e = spark.createDataFrame([("Market", 1.0), ("Size", 0.5), ("None", 9.0)], "factor string, exposure double")
    v = spark.createDataFrame([("Market", 0.15), ("Size", 0.10)], "factor string, volatility double")
    summary, factors = sm.risk_summary(e, v, 0.05, 1e6)
    s = summary.first()
    assert s["factor_risk"] ** 2 == pytest.approx(0.025) and s["total_risk"] ** 2 == pytest.approx(0.0275) and s["var_95"] == pytest.approx(1.645 * s["total_risk"]) and s["var_99_value"] == pytest.approx(2.326e6 * s["total_risk"])
    rows = factors.collect()
    assert [r["factor"] for r in rows] == ["Market", "Size"] and rows[0]["contribution_pct"] == pytest.approx(100 * 0.0225 / 0.0275)
    rc = sm.with_percent(spark.createDataFrame([(0.0216,)], "contribution double"), 0.20).first()
    assert rc["contribution_pct"] == pytest.approx(54)
    none = sm.risk_summary(e.filter("exposure > 99"), v, 0.0)[0].first()
    assert none["factor_ratio"] == none["specific_ratio"] == 0 and none["var_95_value"] is None
    assert rp.risk_text("P", "2023", summary).splitlines()[:2] == ["Risk Summary: P (2023)", f"  Total Risk: {0.0275**0.5:.2%}"]
    assert rp.factor_lines(factors)[0] == f"Market: {100 * 0.0225 / 0.0275:.2f}% of risk (exposure: 1.000, volatility: 15.00%)"
    assert "95% VaR" in rp.risk_table("P", "2024", summary, factors) and "## Summary" in rp.risk_table("P", "2024", summary, factors, markdown=True)


def test_universe(spark):
    u = un.Universe()
    assert u.size() == 119 and len(un.SECTORS) == 11 and u.sector("AAPL") == "Information Technology" and u.sector("XOM") == "Energy" and not u.contains("ZZZ")
    assert un.sector_from_code(10) == "Energy" and un.sector_from_code(45) == "Information Technology" and un.sector_from_code(60) == "Real Estate" and un.sector_from_code(99) is None
    assert un.parse_sector("health Care") == un.parse_sector("HEALTH") == "Health Care"
    with pytest.raises(errors.InvalidParameter):
        un.parse_sector("none")
    assert u.sector_counts(spark).agg(F.sum("n")).first()[0] == 119
    assert "45 - Information Technology" in universe_text(list_sectors=True) and "XOM" in universe_text("energy") and "119" in universe_text()


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("A", 0.2, 0.15, 0.1, {"momentum": 0.1, "value": 0.05})], "symbol string, total_risk double, factor_risk double, specific_risk double, factor_contributions map<string,double>")
    assert sorted(r["component"] for r in ex.flatten_decomposition(df).collect()) == ["factor", "factor_momentum", "factor_value", "specific", "total"]
    h = spark.createDataFrame([("A", 0.6, 60.0), ("B", 0.4, None)], "symbol string, weight double, market_value double")
    text = ex.portfolio_text("P", D0, h)
    assert text.splitlines() == ["# Portfolio: P", "# Date: 2024-01-01", "# Total Weight: 1.0", "symbol,weight,market_value", "A,0.6,60.0", "B,0.4,"]
    assert json.loads(ex.to_text(h, "pretty_json"))[1]["market_value"] is None and json.loads(ex.portfolio_text("P", D0, h, "json"))["name"] == "P"
    ex.save(text, str(tmp_path / "x.csv"))
    assert (tmp_path / "x.csv").read_text() == text
    with pytest.raises(errors.ExportError):
        ex.save("x", str(tmp_path / "no" / "x.csv"))
    with pytest.raises(errors.ExportError):
        ex.extension("xml")
    ex.write(h, str(tmp_path / "out"), "csv")
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2
    r = json.loads(rp.Report("AAPL", contents={"x": 1}).to_json())
    assert (r["symbol"], r["period_years"], r["contents"]) == ("AAPL", 5, {"x": 1}) and rp.Report().symbol == ""


def test_analysis_and_cli(spark, tmp_path, capsys):
    rng = np.random.default_rng(4)
    names = un.Universe().symbols()[::9]
    rows = []
    for k, s in enumerate([*names, "SPY"]):
        price = 50 + k
        for t in range(160):
            price *= 1 + rng.normal(0.0005, 0.01)
            rows.append((s, D0 + dt.timedelta(t), price, price, 1000 + int(rng.integers(500))))
    q = spark.createDataFrame(rows, "symbol string, date date, close double, adjusted_close double, volume bigint")
    summary, factors = analyze(q, un.Universe().frame(spark), names[0])
    s = summary.first()
    assert s["total_return"] == pytest.approx(s["factor_return"] + s["specific_return"]) and {r["factor"] for r in factors.collect()} >= {"market", "size_score", "Information Technology"}
    q.write.parquet(str(tmp_path / "q"))
    assert main(["analyze", names[0].lower(), "--quotes", str(tmp_path / "q"), "--years", "2", "--until", "2024-12-31"]) == 0
    assert "Factor Attribution" in capsys.readouterr().out
    assert main(["analyze", "nope", "--quotes", str(tmp_path / "q"), "--until", "2024-12-31"]) == 1
    assert main(["universe", "--list-sectors"]) == 0 and main(["update", "--full"]) == 0
    doc = json.loads(risk_report(qt.synthetic_factor_returns(spark), "AAPL", fmt="json"))
    assert doc["regime"]["regime"] in ("Low", "Normal", "High") and doc["specific"]["volatility"] == "0.2360" and set(doc["covariance"]["correlations"].values()) == {"0.0000"}
    assert "COVARIANCE" in risk_report(qt.synthetic_factor_returns(spark))
