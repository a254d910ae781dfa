"""Sectors and the built-in universe of large companies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fathom.errors import InvalidParameter

#: Sector codes and names, in the order they are listed.
SECTOR_CODES = {
    "Information Technology": 45, "Health Care": 35, "Financials": 40, "Consumer Discretionary": 25, "Communication Services": 50, "Industrials": 20,
    "Consumer Staples": 30, "Energy": 10, "Utilities": 55, "Real Estate": 60, "Materials": 15,
}
SECTORS = tuple(SECTOR_CODES)
#: Further names that a sector goes by, lower case without spaces.
ALIASES = {
    "Information Technology": ("it", "tech"), "Health Care": ("health",), "Financials": ("finance",), "Consumer Discretionary": ("discretionary",),
    "Communication Services": ("communication", "comms"), "Industrials": ("industrial",), "Consumer Staples": ("staples",), "Energy": (),
    "Utilities": ("utility",), "Real Estate": ("estate",), "Materials": (),
}
#: The symbols of each sector.
SYMBOLS = {
    "Information Technology": "AAPL MSFT NVDA AVGO ORCL CSCO ACN AMD IBM INTC TXN QCOM ADBE CRM NOW",
    "Health Care": "LLY UNH JNJ ABBV MRK TMO ABT DHR PFE BMY AMGN GILD",
    "Financials": "BRK.B JPM V MA BAC WFC MS GS BLK C AXP SCHW",
    "Consumer Discretionary": "AMZN TSLA HD MCD NKE SBUX LOW TJX BKNG CMG F GM",
    "Communication Services": "GOOGL GOOG META NFLX DIS CMCSA T VZ TMUS EA",
    "Industrials": "CAT UNP RTX HON UPS BA DE LMT GE MMM FDX NSC",
    "Consumer Staples": "WMT PG COST KO PEP PM MO CL MDLZ KHC",
    "Energy": "XOM CVX COP SLB EOG MPC PSX VLO OXY HAL",
    "Utilities": "NEE SO DUK CEG AEP EXC XEL D",
    "Real Estate": "PLD AMT EQIX CCI PSA SPG O WELL",
    "Materials": "LIN APD SHW FCX NEM ECL DD DOW PPG NUE",
}


def sector_from_code(code: int) -> str | None:
    return next((s for s, c in SECTOR_CODES.items() if c == code), None)


def parse_sector(name: str) -> str:
    """The sector that a name or alias means, whatever its case and spaces."""
    wanted = name.lower().replace(" ", "")
    for sector, others in ALIASES.items():
        if wanted in (sector.lower().replace(" ", ""), *others):
            return sector
    raise InvalidParameter(f"unknown sector: {name}")


def sector_dim(spark: SparkSession) -> DataFrame:
    """code, sector: 11 rows."""
    return spark.createDataFrame([(c, s) for s, c in SECTOR_CODES.items()], "code int, sector string")


def alias_dim(spark: SparkSession) -> DataFrame:
    """alias, sector: every name a sector goes by, lower case without spaces."""
    return spark.createDataFrame([(a, s) for s, x in ALIASES.items() for a in (s.lower().replace(" ", ""), *x)], "alias string, sector string")


class Universe:
    """Symbols with their sectors; by default the built-in list."""

    def __init__(self, members: dict[str, str] | None = None) -> None:
        self.members = members or {x: s for s, names in SYMBOLS.items() for x in names.split()}

    def symbols(self) -> list[str]:
        return list(self.members)

    def size(self) -> int:
        return len(self.members)

    def contains(self, symbol: str) -> bool:
        return symbol in self.members

    def sector(self, symbol: str) -> str | None:
        return self.members.get(symbol)

    def symbols_in_sector(self, sector: str) -> list[str]:
        return [x for x, s in self.members.items() if s == sector]

    def frame(self, spark: SparkSession) -> DataFrame:
        """symbol, sector."""
        return spark.createDataFrame(list(self.members.items()), "symbol string, sector string")

    def sector_counts(self, spark: SparkSession) -> DataFrame:
        return self.frame(spark).groupBy("sector").agg(F.count(F.lit(1)).alias("n"))


def with_sector(df: DataFrame, universe: DataFrame) -> DataFrame:
    """df with the sector of its symbols, null for unknown ones."""
    return df.join(universe.select("symbol", "sector"), "symbol", "left")
