"""Company filings: payloads to fact rows, fact queries, statements and ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from fathom.errors import ParseError
from fathom.functions.columns import ratio
from fathom.operators.panel import as_of
from fathom.schema import METRICS

FACT = "struct<start:string,end:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string>"
COMPANY_FACTS = f"cik string, entityName string, facts map<string, map<string, struct<label:string,description:string,units:map<string,array<{FACT}>>>>>"
COMPANY_CONCEPT = f"cik string, taxonomy string, tag string, label string, description string, entityName string, units map<string,array<{FACT}>>"
SUBMISSIONS = "cik string, name string, filings struct<recent:struct<accessionNumber:array<string>,form:array<string>,filingDate:array<string>,primaryDocument:array<string>,reportDate:array<string>>>"
TICKERS = "map<string, struct<cik_str:bigint,ticker:string,title:string>>"

#: The tags of each statement concept, the first found counts.
CONCEPT_TAGS = {
    "Assets": ("Assets",),
    "AssetsCurrent": ("AssetsCurrent",),
    "Liabilities": ("Liabilities", "LiabilitiesAndStockholdersEquity"),
    "LiabilitiesCurrent": ("LiabilitiesCurrent",),
    "LongTermDebt": ("LongTermDebt", "LongTermDebtNoncurrent", "LongTermDebtAndCapitalLeaseObligations"),
    "StockholdersEquity": ("StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"),
    "CashAndCashEquivalents": ("CashAndCashEquivalentsAtCarryingValue", "Cash", "CashCashEquivalentsAndShortTermInvestments"),
    "Revenue": ("Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet", "RevenueFromContractWithCustomerIncludingAssessedTax"),
    "NetIncome": ("NetIncomeLoss", "ProfitLoss", "NetIncomeLossAvailableToCommonStockholdersBasic"),
    "OperatingIncome": ("OperatingIncomeLoss", "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest"),
    "GrossProfit": ("GrossProfit",),
    "EarningsPerShareBasic": ("EarningsPerShareBasic",),
    "EarningsPerShareDiluted": ("EarningsPerShareDiluted",),
    "OperatingCashFlow": ("NetCashProvidedByUsedInOperatingActivities", "CashProvidedByUsedInOperatingActivities"),
    "CapitalExpenditures": ("PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsForCapitalImprovements"),
    "SharesOutstanding": ("CommonStockSharesOutstanding", "CommonStockSharesIssued"),
    "WeightedAverageNumberOfSharesOutstandingBasic": ("WeightedAverageNumberOfSharesOutstandingBasic",),
    "WeightedAverageNumberOfDilutedSharesOutstanding": ("WeightedAverageNumberOfDilutedSharesOutstanding",),
}
#: Named concepts of the fact rows.
CONCEPTS = {
    "assets": "us-gaap:Assets", "liabilities": "us-gaap:Liabilities", "stockholders_equity": "us-gaap:StockholdersEquity", "long_term_debt_noncurrent": "us-gaap:LongTermDebtNoncurrent",
    "long_term_debt": "us-gaap:LongTermDebt", "cash": "us-gaap:CashAndCashEquivalentsAtCarryingValue", "assets_current": "us-gaap:AssetsCurrent", "liabilities_current": "us-gaap:LiabilitiesCurrent",
    "revenues": "us-gaap:Revenues", "revenue_from_contracts": "us-gaap:RevenueFromContractWithCustomerExcludingAssessedTax", "net_income": "us-gaap:NetIncomeLoss", "cost_of_revenue": "us-gaap:CostOfRevenue",
    "operating_income": "us-gaap:OperatingIncomeLoss", "gross_profit": "us-gaap:GrossProfit", "operating_activities": "us-gaap:NetCashProvidedByUsedInOperatingActivities",
    "operating_cash_flows": "us-gaap:OperatingCashFlows", "investing_activities": "us-gaap:NetCashProvidedByUsedInInvestingActivities", "financing_activities": "us-gaap:NetCashProvidedByUsedInFinancingActivities",
    "eps_basic": "us-gaap:EarningsPerShareBasic", "eps_diluted": "us-gaap:EarningsPerShareDiluted", "shares_outstanding": "us-gaap:CommonStockSharesOutstanding",
    "shares_basic": "us-gaap:WeightedAverageNumberOfSharesOutstandingBasic", "shares_diluted": "us-gaap:WeightedAverageNumberOfDilutedSharesOutstanding",
}
TAXONOMIES = ("us-gaap", "dei")
UNITS = ("USD", "shares", "pure")
#: Metric of a statement by concept; free cash flow and the share fallback are derived.
METRIC_OF = dict(zip(
    ("Assets", "Liabilities", "StockholdersEquity", "LongTermDebt", "AssetsCurrent", "LiabilitiesCurrent", "CashAndCashEquivalents", "Revenue", "NetIncome", "OperatingIncome", "GrossProfit",
     "EarningsPerShareBasic", "EarningsPerShareDiluted", "OperatingCashFlow", "CapitalExpenditures", "SharesOutstanding", "WeightedAverageNumberOfSharesOutstandingBasic", "WeightedAverageNumberOfDilutedSharesOutstanding"),
    (*(m for m in METRICS if m not in ("free_cash_flow", "shares_outstanding", "shares_outstanding_diluted")), "shares_outstanding", "_shares_basic", "shares_outstanding_diluted"), strict=True,
))


def pad_cik(cik: Column) -> Column:
    return F.lpad(cik.cast("string"), 10, "0")


def ticker_ciks(spark: SparkSession, payload: DataFrame) -> DataFrame:
    """symbol (upper case), cik (padded), company_name of a ticker payload (a text column `value`)."""
    rows = payload.select(F.explode(F.from_json("value", TICKERS)).alias("k", "v"))
    return rows.select(F.upper("v.ticker").alias("symbol"), pad_cik(F.col("v.cik_str")).alias("cik"), F.col("v.title").alias("company_name"))


def lookup_cik(ciks: DataFrame, symbol: str) -> DataFrame:
    return ciks.filter(F.upper("symbol") == symbol.upper())


def parse_json(payload: DataFrame, schema: str, strict: bool = False) -> DataFrame:
    """payload (value) as the schema's columns. strict: an error at the first bad document; otherwise it is skipped."""
    doc = F.from_json("value", schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    return payload.select(doc.alias("d")).filter("d is not null").select("d.*")


def _facts(rows: DataFrame, strict: bool) -> DataFrame:
    """rows: cik, concept, unit, pos, f (a fact) to fact rows."""
    to_date = (lambda c: F.to_date(c)) if strict else (lambda c: F.try_to_date(c))
    out = rows.select(
        "cik", "concept", F.col("f.val").alias("value"), "unit", to_date(F.col("f.end")).alias("period_end"), to_date(F.col("f.start")).alias("period_start"), F.col("f.form").alias("form"),
        F.col("f.fy").alias("fiscal_year"), F.col("f.fp").alias("fiscal_period"), "pos", F.try_to_date(F.col("f.filed")).alias("filed"),
    )
    return out if strict else out.filter("period_end is not null")


def flatten_company_facts(payload: DataFrame, strict: bool = False) -> DataFrame:
    """cik, concept (taxonomy:tag), value, unit, period_end, period_start, form, fiscal_year, fiscal_period, pos, filed of every fact.

    strict fails on a bad date; otherwise such facts are left out.
    """
    docs = parse_json(payload, COMPANY_FACTS, strict)
    tags = docs.select("cik", F.explode("facts").alias("taxonomy", "tags")).select("cik", "taxonomy", F.explode("tags").alias("tag", "c"))
    units = tags.select("cik", F.concat_ws(":", "taxonomy", "tag").alias("concept"), F.explode("c.units").alias("unit", "list"))
    return _facts(units.select("cik", "concept", "unit", F.posexplode("list").alias("pos", "f")), strict)


def flatten_company_concept(payload: DataFrame, strict: bool = False) -> DataFrame:
    """As flatten_company_facts, of the payload of one concept."""
    docs = parse_json(payload, COMPANY_CONCEPT, strict)
    units = docs.select("cik", F.concat_ws(":", "taxonomy", "tag").alias("concept"), F.explode("units").alias("unit", "list"))
    return _facts(units.select("cik", "concept", "unit", F.posexplode("list").alias("pos", "f")), strict)


def parse_xml(_: str) -> DataFrame:
    """XML instance documents are not supported."""
    raise ParseError("XBRL in XML is not supported; use the JSON payload")


def filings(payload: DataFrame) -> DataFrame:
    """cik, pos, accession, form, filed, document, report_date of a submissions payload, one row a filing."""
    r = "filings.recent."
    docs = parse_json(payload, SUBMISSIONS)
    rows = docs.select("cik", F.posexplode(F.arrays_zip(*(F.col(r + c).alias(c) for c in ("accessionNumber", "form", "filingDate", "primaryDocument", "reportDate")))).alias("pos", "f"))
    return rows.select("cik", "pos", F.col("f.accessionNumber").alias("accession"), F.col("f.form").alias("form"), F.try_to_date("f.filingDate").alias("filed"), F.col("f.primaryDocument").alias("document"), F.try_to_date("f.reportDate").alias("report_date"))


def filings_by_form(rows: DataFrame, form: str) -> DataFrame:
    """All filings of a form with a readable date."""
    return rows.filter((F.col("form") == form) & F.col("filed").isNotNull())


def latest_filing(rows: DataFrame, form: str) -> DataFrame:
    """Each company's first filing of the form in the payload's order; none if its date can't be read."""
    first = rows.filter(F.col("form") == form).groupBy("cik").agg(F.min_by(F.struct(*rows.columns), "pos").alias("f"))
    return first.select("f.*").filter("filed is not null")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, value: the text of each filing document in a folder, or of each payload."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def document_url(cik: Column, accession: Column, document: Column) -> Column:
    return F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), cik, F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), document)


def is_instant() -> Column:
    return F.col("period_start").isNull()


def duration_days() -> Column:
    """Days from start to end, the end not counted; null for an instant."""
    return F.datediff("period_end", "period_start")


def period_type(form: Column) -> Column:
    return F.when(form == "10-Q", "Q").when(form == "10-K", "A")


def facts_of(facts: DataFrame, concept: str, period_end=None, fiscal_year: int | None = None, form: str | None = None) -> DataFrame:  # noqa: ANN001
    """Facts of a concept, by period end, fiscal year or form, newest first."""
    df = facts.filter(F.col("concept") == concept)
    for c, v in (("period_end", period_end), ("fiscal_year", fiscal_year), ("form", form)):
        df = df if v is None else df.filter(F.col(c) == F.lit(v))
    return df.orderBy(F.desc("period_end"), "cik", "pos")


def latest_facts(facts: DataFrame) -> DataFrame:
    """Per company and concept the fact of the latest period, the last listed of several."""
    return facts.groupBy("cik", "concept").agg(F.max(F.struct("period_end", "pos", "value", "unit", "form", "fiscal_year", "fiscal_period")).alias("f")).select("cik", "concept", "f.*").drop("pos")


def concepts(facts: DataFrame) -> DataFrame:
    return facts.select("concept").distinct().orderBy("concept")


def tag_dim(spark: SparkSession) -> DataFrame:
    """name, taxonomy, tag, unit and their ranks: what may stand for a statement concept, best first. A few hundred rows."""
    rows = [(n, f"{x}:{t}", u, i, j, k) for n, tags in CONCEPT_TAGS.items() for i, x in enumerate(TAXONOMIES) for j, t in enumerate(tags) for k, u in enumerate(UNITS)]
    return spark.createDataFrame(rows, "name string, concept string, unit string, taxonomy_rank int, tag_rank int, unit_rank int")


def extract(facts: DataFrame, dim: DataFrame) -> DataFrame:
    """cik, fiscal_year, fiscal_period, form, name, value: per period and statement concept the best-ranked fact, the last listed of several."""
    df = facts.join(F.broadcast(dim), ["concept", "unit"])  # the dimension has a fixed size
    best = F.min_by("value", F.struct("taxonomy_rank", "tag_rank", "unit_rank", -F.col("pos")))
    return df.groupBy("cik", "fiscal_year", "fiscal_period", "form", "name").agg(best.alias("value"))


def statements(facts: DataFrame, dim: DataFrame) -> DataFrame:
    """A row per company, fiscal year, fiscal period and form (10-Q, 10-K) with period_end (the latest), period_type and the 18 metrics; and filed, the day from which all its facts are known, where the facts have that."""
    own = facts.filter(period_type(F.col("form")).isNotNull())
    picked = extract(own, dim)
    wide = picked.groupBy("cik", "fiscal_year", "fiscal_period", "form").agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(m) for n, m in METRIC_OF.items()))
    known = ["filed"] if "filed" in facts.columns else []
    ends = own.groupBy("cik", "fiscal_year", "fiscal_period", "form").agg(*(F.max(c).alias(c) for c in ("period_end", *known)))
    keys = ["cik", "fiscal_year", "fiscal_period", "form"]
    key_match = [ends[k].eqNullSafe(wide[k]) for k in keys]
    df = ends.join(wide, key_match, "left").select(*(ends[k] for k in keys), "period_end", *known, *METRIC_OF.values())
    df = df.withColumn("free_cash_flow", F.col("operating_cash_flow") - F.col("capital_expenditures")).withColumn("shares_outstanding", F.coalesce("shares_outstanding", "_shares_basic"))
    quarter = F.when(F.col("fiscal_period").rlike("^Q[0-9]"), F.substring("fiscal_period", 2, 1).cast("int"))
    return df.select("cik", "period_end", period_type(F.col("form")).alias("period_type"), "fiscal_year", quarter.alias("fiscal_quarter"), *known, *METRICS)


def latest_statements(df: DataFrame, kind: str) -> DataFrame:
    """Each company's newest quarterly (Q) or annual (A) statement."""
    w = W.partitionBy("cik").orderBy(F.desc("period_end"), F.desc("fiscal_year"), F.desc_nulls_last("fiscal_quarter"))
    return df.filter(F.col("period_type") == kind).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def factor_inputs(df: DataFrame, nan: bool = False) -> DataFrame:
    """df (metrics and price) with book_value_per_share, earnings_per_share, roe, roa, debt_to_equity, current_ratio, price_to_book, price_to_earnings.

    Price ratios over a denominator at or below 0 are null, or NaN if asked for.
    """
    c = F.col
    df = df.withColumns({"book_value_per_share": ratio(c("stockholders_equity"), c("shares_outstanding")), "earnings_per_share": F.coalesce("eps_diluted", "eps_basic")})
    return df.withColumns({
        "roe": ratio(c("net_income"), c("stockholders_equity")), "roa": ratio(c("net_income"), c("total_assets")),
        "debt_to_equity": ratio(c("long_term_debt"), c("stockholders_equity")), "current_ratio": ratio(c("current_assets"), c("current_liabilities")),
        "price_to_book": ratio(c("price"), c("book_value_per_share"), nan), "price_to_earnings": ratio(c("price"), c("earnings_per_share"), nan),
    })


def ratios_as_of(prices: DataFrame, statements: DataFrame, links: DataFrame, kind: str | None = None) -> DataFrame:
    """prices (symbol, date, price) with the columns and ratios of the newest statement known on that day; further columns stay.

    statements are those of statements() with filed, of one kind (Q, A) or both; links (symbol, cik) says whose they are, several symbols of a company each get them.
    Of statements filed on one day the latest period counts. A statement without filed is never known; before the first all its columns are null.
    """
    own = statements if kind is None else statements.filter(F.col("period_type") == kind)
    own = own.join(links.select("symbol", "cik").distinct(), "cik")
    carried = ["period_end", *(c for c in own.columns if c not in ("symbol", "period_end", *prices.columns))]
    return factor_inputs(as_of(prices, own, "symbol", "date", "filed", carried))


def growth_inputs(df: DataFrame) -> DataFrame:
    """df with revenue_growth, earnings_growth over the same company and period a fiscal year before; null unless the prior is above 0."""
    keys = ["cik", "period_type", "fiscal_quarter"]
    prior = df.select(*(F.col(k).alias(f"p_{k}") for k in keys), (F.col("fiscal_year") + 1).alias("p_fy"), F.col("revenue").alias("p_rev"), F.col("net_income").alias("p_ni"))
    on = [df[k].eqNullSafe(prior[f"p_{k}"]) for k in keys] + [df["fiscal_year"] == prior["p_fy"]]
    out = df.join(prior, on, "left")
    return out.withColumns({"revenue_growth": ratio(F.col("revenue") - F.col("p_rev"), F.col("p_rev")), "earnings_growth": ratio(F.col("net_income") - F.col("p_ni"), F.col("p_ni"))}).drop(*prior.columns)


def fundamentals_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """symbol, market_cap, pe_ratio, pb_ratio, dividend_yield of fundamentals records."""
    if not rows:
        raise ParseError("there are no fundamentals")
    kinds = "symbol string, market_cap double, pe_ratio double, pb_ratio double, dividend_yield double"
    return spark.createDataFrame([tuple(r.get(c.split(" ")[0]) for c in kinds.split(", ")) for r in rows], kinds)
