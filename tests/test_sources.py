"""Quotes, the store, filings and streams."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom import errors
from fathom.schema import DDL, METRICS
from fathom.sources import filings as fl, quotes as qt, store as st

D0 = dt.date(2024, 1, 1)
QUOTE = "symbol string, date date, close double, volume bigint"


def test_scan(spark, tmp_path):
    rows = spark.createDataFrame([("A", D0, 1.0, 1), ("A", D0 + dt.timedelta(5), 2.0, 1), ("B", D0, 3.0, 1)], QUOTE)
    rows.write.csv(str(tmp_path / "q"), header=True)
    q = qt.read_quotes(spark, str(tmp_path / "q"), "csv", header="true")
    assert q.schema["volume"].dataType.simpleString() == "bigint"
    rows, missing = qt.scan_available(q, ["A", "Z", "B", "Z"], D0, D0 + dt.timedelta(9))
    assert rows.count() == 3 and [r[0] for r in missing.collect()] == ["Z"]
    assert qt.scan_quotes(q, "A", D0, D0).count() == 1 and qt.scan_quotes(q, ["A", "B"], D0, D0 + dt.timedelta(9)).count() == 3
    with pytest.raises(errors.InvalidDateRange):
        qt.scan_quotes(q, "A", D0, D0 - dt.timedelta(1))
    with pytest.raises(errors.MissingData):
        qt.scan_quotes(q, "Z", D0, D0)
    with pytest.raises(errors.DataError):
        qt.scan_quotes(q, "", D0, D0)
    assert qt.history(5, dt.date(2024, 6, 1)) == (dt.date(2024, 6, 1) - dt.timedelta(1260), dt.date(2024, 6, 1))
    assert qt.synthetic_specific_risk("AAPL") == pytest.approx(0.236)


def test_store(spark, tmp_path):
    s = st.Store(spark, str(tmp_path / "store"))
    assert s.read("quotes").count() == 0 and not s.has_recent("A", 90)
    s.put("quotes", spark.createDataFrame([("A", D0, 1.0, 10), ("B", D0, 2.0, 10)], QUOTE))
    s.put("quotes", spark.createDataFrame([("A", D0, 5.0, 10), ("A", D0 + dt.timedelta(1), 6.0, 10)], QUOTE))
    assert [r["close"] for r in s.quotes("A", D0, D0 + dt.timedelta(9)).collect()] == [5.0, 6.0] and s.read("quotes").count() == 3
    with pytest.raises(errors.MissingData):
        s.quotes("Z", D0, D0)
    s.put("universe", spark.createDataFrame([("A", "a", "Energy"), ("B", "b", "Energy")], "symbol string, name string, sector string"))
    s.remove_from_universe("B")
    assert [r["symbol"] for r in s.universe().collect()] == ["A"]
    s.put("company_ciks", spark.createDataFrame([("A", "0000000001")], "symbol string, cik string"))
    assert s.lookup("company_ciks", symbol="A").first()["cik"] == "0000000001" and s.lookup("market_caps", symbol="A").count() == 0
    rows = [("A", "1", dt.date(2024, 6, 30), "Q", 2024), ("A", "1", dt.date(2024, 9, 30), "Q", 2024), ("A", "1", dt.date(2023, 9, 30), "A", 2023)]
    s.put("financial_statements", spark.createDataFrame(rows, "symbol string, cik string, period_end date, period_type string, fiscal_year int"))
    assert [r["period_end"] for r in s.statements("A").collect()] == [dt.date(2024, 9, 30), dt.date(2024, 6, 30), dt.date(2023, 9, 30)]
    assert s.latest_statement("A", "A").first()["period_end"] == dt.date(2023, 9, 30) and s.latest_statement("A", "Q").first()["period_end"] == dt.date(2024, 9, 30)
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    assert s.has_recent("A", 90) and not s.has_recent("A", 0, now + dt.timedelta(hours=1))
    assert s.has_quotes("A", D0, D0 + dt.timedelta(2)) and not s.has_quotes("A", D0, D0 + dt.timedelta(200))
    assert s.stats().first().asDict() == {"quotes": 3, "symbols": 2, "active_universe": 1, "statements": 3, "ciks": 1}
    asked = []

    def fetch(symbols):
        asked.append(sorted(symbols))
        return spark.createDataFrame([(x, D0, 9.0, 1) for x in symbols], QUOTE)

    got = s.scan_universe(["A", "C"], D0, D0 + dt.timedelta(1), fetch)
    assert asked == [["C"]] and {r["symbol"]: r["close"] for r in got.filter(F.col("date") == F.lit(D0)).collect()} == {"A": 5.0, "C": 9.0}
    s.scan_universe(["A"], D0, D0, fetch, refresh=True)
    assert asked[-1] == ["A"] and s.quotes("A", D0, D0).first()["close"] == 9.0
    s.scan_universe(["D"], D0, D0, fetch, use_cache=False)
    assert s.read("quotes").filter("symbol = 'D'").count() == 0
    late = dt.date(D0.year + 1, 3, 1)
    s.put("quotes", spark.createDataFrame([("E", late, 3.0, 7)], QUOTE))
    before = s._state("quotes")
    s.put("quotes", spark.createDataFrame([("E", late, 4.0, 7)], QUOTE))
    after = s._state("quotes")
    assert [k for k in after["parts"] if after["parts"][k] != before["parts"].get(k)] == [f"{late:%Y-%m}"]
    assert s.read("quotes", late, late).filter("close = 4").count() == s.read("quotes", late, late).count() == 1
    assert s._view("quotes", before, lambda k: True).filter("close = 3").count() == 1  # a reader of the version before still can
    s.clear("A")
    assert s.read("quotes").filter("symbol = 'A'").count() == 0 and s.read("quotes").count() > 0
    s.clear()
    assert s.read("quotes").count() == 0 and s.universe().count() == 1


def files(root):
    return {str(f) for f in root.rglob("*") if f.is_file() and not f.name.startswith(".") and "SUCCESS" not in f.name}


def test_store_is_a_log(spark, tmp_path):
    s, day = st.Store(spark, str(tmp_path)), lambda k: D0 + dt.timedelta(k)
    s.put("quotes", spark.createDataFrame([(x, day(31 * m), 1.0, 1) for x in "ABC" for m in range(3)], QUOTE))
    before, reader = files(tmp_path), s.read("quotes")
    s.put("quotes", spark.createDataFrame([("A", day(0), 2.0, 1)], QUOTE))
    new = files(tmp_path) - before
    assert len(new) == 2 and before <= files(tmp_path)  # a layer's file and the log's
    before = files(tmp_path)
    s.clear("B")
    assert [f.split("/")[-2] for f in files(tmp_path) - before] == ["_log"] and before <= files(tmp_path)
    rows = lambda: sorted((r["symbol"], r["date"], r["close"]) for r in s.read("quotes").collect())
    want = sorted([(x, day(31 * m), 1.0) for x in "AC" for m in range(3) if (x, m) != ("A", 0)] + [("A", day(0), 2.0)])
    assert rows() == want
    assert reader.count() == 9  # planned before both
    s.put("quotes", spark.createDataFrame([("B", day(0), 5.0, 1)], QUOTE))  # rows put after a deletion count
    want = sorted([*want, ("B", day(0), 5.0)])
    assert rows() == want
    s.compact("quotes")
    assert rows() == want and all(len(x) == 1 for x in s._state("quotes")["parts"].values())
    for k in range(10):  # merged on the way
        s.put("quotes", spark.createDataFrame([("A", day(0), float(k), 1)], QUOTE))
    assert max(len(x) for x in s._state("quotes")["parts"].values()) <= 8 and rows()[0] == ("A", day(0), 9.0) and len(rows()) == len(want)


def test_two_writers_and_a_reader(spark, tmp_path, monkeypatch):
    """A second writer commits between the first one's look at the log and its rename: both layers are there, and a reader sees one state or the next."""
    s, other = st.Store(spark, str(tmp_path)), st.Store(spark, str(tmp_path))
    s.put("quotes", spark.createDataFrame([("A", D0, 1.0, 1)], QUOTE))
    state, calls, seen = s._state, [], []

    def look(table, version=None):
        got = state(table, version)
        if not calls and version is None:
            calls.append(1)
            other.put("quotes", spark.createDataFrame([("B", D0, 2.0, 1)], QUOTE))
            seen.append(sorted(r["symbol"] for r in other.read("quotes").collect()))
        return got

    monkeypatch.setattr(s, "_state", look)
    s.put("quotes", spark.createDataFrame([("C", D0, 3.0, 1), ("B", D0, 4.0, 1)], QUOTE))
    assert seen == [["A", "B"]] and {r["symbol"]: r["close"] for r in other.read("quotes").collect()} == {"A": 1.0, "B": 4.0, "C": 3.0}
    assert other._versions("quotes") == [1, 2, 3]


PAYLOAD = {
    "cik": 771204, "entityName": "Example", "facts": {
        "us-gaap": {
            "Revenues": {"label": "R", "units": {"USD": [
                {"start": "2023-01-01", "end": "2023-12-31", "val": 740000, "fy": 2023, "fp": "FY", "form": "10-K"}, {"end": "2024-12-31", "val": 962000, "fy": 2024, "fp": "FY", "form": "10-K"}, {"end": "bad", "val": 1, "fy": 2020, "fp": "Q1", "form": "10-Q"}]}},
            "SalesRevenueNet": {"units": {"USD": [{"end": "2024-12-31", "val": 7, "fy": 2024, "fp": "FY", "form": "10-K"}]}},
            "NetIncomeLoss": {"units": {"USD": [{"end": "2023-12-31", "val": 81000, "fy": 2023, "fp": "FY", "form": "10-K"}, {"end": "2024-12-31", "val": 97200, "fy": 2024, "fp": "FY", "form": "10-K"}]}},
            "WeightedAverageNumberOfSharesOutstandingBasic": {"units": {"shares": [{"end": "2024-12-31", "val": 30500, "fy": 2024, "fp": "FY", "form": "10-K"}]}},
            "StockholdersEquity": {"units": {"USD": [{"end": "2024-12-31", "val": 415000, "fy": 2024, "fp": "FY", "form": "10-K"}, {"end": "2024-12-31", "val": 415001, "fy": 2024, "fp": "FY", "form": "8-K"}]}},
        }, "dei": {"Other": {"units": {"pure": [{"end": "2024-03-31", "val": 1, "fy": 2024, "fp": "Q2", "form": "10-Q"}]}}}}}


def payload(spark, doc):
    return spark.createDataFrame([(json.dumps(doc),)], "value string")


def test_facts(spark):
    facts = fl.flatten_company_facts(payload(spark, PAYLOAD)).cache()
    assert facts.count() == 9 and facts.first()["cik"] == "771204"
    with pytest.raises(Exception, match="(?i)date|parse"):
        fl.flatten_company_facts(payload(spark, PAYLOAD), strict=True).collect()
    r = fl.facts_of(facts, "us-gaap:Revenues").collect()
    assert [x["value"] for x in r] == [962000, 740000]
    d = facts.filter("period_start is not null").select(fl.duration_days().alias("d"), fl.is_instant().alias("i")).first()
    assert d["d"] == 364 and not d["i"]
    assert fl.facts_of(facts, "us-gaap:Revenues", fiscal_year=2023, form="10-K").count() == 1
    assert fl.latest_facts(facts).filter("concept = 'us-gaap:Revenues'").first()["value"] == 962000
    assert [x[0] for x in fl.concepts(facts).collect()][0] == "dei:Other"
    s = {x["fiscal_year"]: x for x in fl.statements(facts, fl.tag_dim(spark)).filter("period_type = 'A'").collect()}
    assert s[2024]["revenue"] == 962000 and s[2024]["shares_outstanding"] == 30500 and s[2024]["stockholders_equity"] == 415000 and s[2024]["free_cash_flow"] is None and s[2023]["period_end"] == dt.date(2023, 12, 31)
    assert len(fl.CONCEPT_TAGS) == 18 and len(fl.CONCEPTS) == 23 and len(METRICS) == 18
    g = fl.growth_inputs(fl.statements(facts, fl.tag_dim(spark))).filter("fiscal_year = 2024 and period_type = 'A'").first()
    assert (g["revenue_growth"], g["earnings_growth"]) == pytest.approx((0.3, 0.2))
    assert fl.latest_statements(fl.statements(facts, fl.tag_dim(spark)), "A").first()["fiscal_year"] == 2024
    one = {"cik": "1", "taxonomy": "us-gaap", "tag": "Assets", "units": {"USD": [{"end": "2024-03-31", "val": 2}]}}
    assert fl.flatten_company_concept(payload(spark, one)).first()["concept"] == "us-gaap:Assets"
    with pytest.raises(errors.ParseError):
        fl.parse_xml("<x/>")


def test_ratios(spark):
    v = {"stockholders_equity": 415e3, "shares_outstanding": 30500.0, "net_income": 97200.0, "total_assets": 2.2e6, "long_term_debt": 130e3, "current_assets": 510e3, "current_liabilities": 204e3, "eps_diluted": 3.1, "eps_basic": None, "price": 62.0}
    df = spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} double" for k in v))
    r = fl.factor_inputs(df).first()
    book = v["stockholders_equity"] / v["shares_outstanding"]
    want = (book, v["net_income"] / v["stockholders_equity"], v["net_income"] / v["total_assets"], v["long_term_debt"] / v["stockholders_equity"], v["current_assets"] / v["current_liabilities"], v["price"] / book, v["price"] / v["eps_diluted"])
    assert (r["book_value_per_share"], r["roe"], r["roa"], r["debt_to_equity"], r["current_ratio"], r["price_to_book"], r["price_to_earnings"]) == pytest.approx(want)
    loss = fl.factor_inputs(df.withColumn("eps_diluted", F.lit(-1.0)), nan=True).first()
    assert np.isnan(loss["price_to_earnings"]) and fl.factor_inputs(df.withColumn("eps_diluted", F.lit(-1.0))).first()["price_to_earnings"] is None
    forms = spark.createDataFrame([("10-Q",), ("10-K",), ("8-K",)], "f string").select(fl.period_type(F.col("f"))).collect()
    assert [x[0] for x in forms] == ["Q", "A", None]


def test_filings_and_ciks(spark):
    doc = {"cik": "771204", "name": "x", "filings": {"recent": {"accessionNumber": ["1-1", "1-2", "1-3"], "form": ["10-Q", "10-K", "10-Q"], "filingDate": ["bad", "2024-02-01", "2023-05-01"], "primaryDocument": ["a", "b", "c"], "reportDate": [None, "2023-12-31", None]}}}
    rows = fl.filings(payload(spark, doc)).cache()
    assert fl.latest_filing(rows, "10-Q").count() == 0 and fl.latest_filing(rows, "10-K").first()["document"] == "b" and [r["accession"] for r in fl.filings_by_form(rows, "10-Q").collect()] == ["1-3"]
    assert rows.filter("pos = 1").select(fl.document_url(F.col("cik"), F.col("accession"), F.col("document"))).first()[0].endswith("/771204/12/b")
    ciks = fl.ticker_ciks(spark, payload(spark, {"0": {"cik_str": 771204, "ticker": "aapl", "title": "Apple"}}))
    assert fl.lookup_cik(ciks, "AApl").first()["cik"] == "0000771204"
    assert fl.fundamentals_frame(spark, [{"symbol": "A", "market_cap": 1.0}]).first()["market_cap"] == 1.0
    with pytest.raises(errors.ParseError):
        fl.fundamentals_frame(spark, [])


def test_streams(spark, tmp_path):
    from fathom.streaming.ewma import dedup_quotes, event_counts, ewma_updates

    rng = np.random.default_rng(0)
    data = rng.normal(size=(6, 2))
    kind = "portfolio string, " + DDL["factor_returns"]
    for k, days in enumerate(([0, 1], [2, 3, 4], [1, 5])):  # the third file repeats a past period
        spark.createDataFrame([("p", D0 + dt.timedelta(t), "ab"[j], float(data[t, j])) for t in days for j in range(2)], kind).coalesce(1).write.parquet(f"{tmp_path}/r/{k}")
        out = ewma_updates(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/r/*"))
        q = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/o").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    got = spark.read.parquet(f"{tmp_path}/o").toPandas()
    c = np.zeros((2, 2))
    for r in data:
        c = 0.95 * c + 0.05 * np.outer(r, r)
    last = got[got["date"] == got["date"].max()].pivot(index="factor_i", columns="factor_j", values="value").to_numpy()
    assert last == pytest.approx(c) and got["date"].nunique() == 6
    spark.createDataFrame([("A", D0, 1.0, 1), ("A", D0, 2.0, 1), ("B", D0, 3.0, 1)], QUOTE).write.parquet(f"{tmp_path}/q")
    q = dedup_quotes(spark.readStream.schema(QUOTE).parquet(f"{tmp_path}/q")).writeStream.format("memory").queryName("deduped").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("deduped").count() == 2
    ev = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, m), "x", 1.0) for m in (1, 2, 59)] + [(dt.datetime(2024, 1, 1, 1, 0), "x", 2.0)], "ts timestamp, event_type string, value double")
    assert sorted(r["n"] for r in event_counts(ev).collect()) == [1, 3]
