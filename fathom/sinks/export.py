"""CSV and JSON exports.

Large results are written by Spark (write()); to_text() is for reports of bounded size and brings them
to the driver.
"""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame, functions as F

from fathom.errors import ExportError

FORMATS = {"csv": "csv", "json": "json", "pretty_json": "json"}
#: Rows that to_text() takes at most.
MAX_TEXT_ROWS = 1_000_000


def extension(fmt: str) -> str:
    if fmt not in FORMATS:
        raise ExportError(f"format must be one of {', '.join(FORMATS)}")
    return FORMATS[fmt]


def write(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """df as CSV with a header, or JSON lines, in a folder of part files."""
    if extension(fmt) == "csv":
        df.write.mode(mode).csv(path, header=True)
    else:
        df.write.mode(mode).json(path)


def flatten_decomposition(df: DataFrame) -> DataFrame:
    """Long rows symbol, component, value: total, factor, specific and factor_<name>. df: symbol, total_risk, factor_risk, specific_risk, factor_contributions (map)."""
    fixed = [F.struct(F.lit(n).alias("component"), F.col(f"{n}_risk").alias("value")) for n in ("total", "factor", "specific")]
    own = F.transform(F.map_entries("factor_contributions"), lambda e: F.struct(F.concat(F.lit("factor_"), e["key"]).alias("component"), e["value"].alias("value")))
    return df.select("symbol", F.explode(F.concat(F.array(*fixed), F.coalesce(own, F.array().cast("array<struct<component:string,value:double>>")))).alias("r")).select("symbol", "r.*")


def total_weight(holdings: DataFrame) -> DataFrame:
    return holdings.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total_weight"))


def _rows(df: DataFrame) -> list[dict]:
    rows = df.limit(MAX_TEXT_ROWS + 1).collect()
    if len(rows) > MAX_TEXT_ROWS:
        raise ExportError(f"more than {MAX_TEXT_ROWS} rows: use write()")
    return [r.asDict(recursive=True) for r in rows]


def to_text(df: DataFrame, fmt: str = "csv") -> str:
    """The rows as one string, in their order; null is empty in CSV."""
    rows = _rows(df)
    if extension(fmt) == "json":
        return json.dumps(rows, default=str, indent=2 if fmt == "pretty_json" else None)
    out = io.StringIO()
    table = csv.writer(out, lineterminator="\n")
    table.writerow(df.columns)
    table.writerows([["" if r[c] is None else r[c] for c in df.columns] for r in rows])
    return out.getvalue()


def portfolio_text(name: str, date, holdings: DataFrame, fmt: str = "csv") -> str:  # noqa: ANN001
    """Holdings under three comment lines (name, date, total weight), or as one JSON object."""
    if extension(fmt) == "json":
        return json.dumps({"name": name, "date": str(date), "holdings": _rows(holdings)}, default=str, indent=2 if fmt == "pretty_json" else None)
    weight = total_weight(holdings).first()[0]
    return f"# Portfolio: {name}\n# Date: {date}\n# Total Weight: {weight}\n" + to_text(holdings)


def save(text: str, path: str) -> None:
    try:
        with open(path, "w") as f:
            f.write(text)
    except OSError as e:
        raise ExportError(str(e)) from e
