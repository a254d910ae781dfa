"""A store of Parquet tables with upsert by key, in place of a row database.

Tables with a date are cut into months. A write adds a layer of files to the months it touches and reads nothing; a read takes the
last layer's row of each key. A deletion is a line in the table's log: the symbol and the number from which on its rows
count. Months with many layers are merged into one from time to time.

The log is a numbered file a write, put in place by a rename that never overwrites: a reader sees all of a write or nothing of it, and of two
writers at once the later one takes the next number, with the other's layer below its own. It needs a file system whose renames are atomic (HDFS
or a local one). What only older numbers name is deleted when layers are merged, all but the number before, for readers that began then.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from fathom.errors import MissingData
from fathom.schema import DDL, conform

KEYS = {
    "quotes": ("symbol", "date"), "universe": ("symbol",), "market_caps": ("symbol", "date"), "fundamentals": ("symbol", "date"),
    "company_ciks": ("symbol",), "financial_statements": ("symbol", "period_end", "period_type"),
}
#: Layers of a part that are merged when one more comes.
LAYERS = 8
STAMPS = {"universe": "added_at", "company_ciks": "updated_at", "market_caps": "cached_at", "fundamentals": "cached_at", "financial_statements": "cached_at"}


def default_root() -> str:
    """Where the store is kept if no place is named."""
    return str(Path.home() / ".cache" / "fathom")


def latest_per_key(df: DataFrame, keys: tuple[str, ...] | list[str], *order: str) -> DataFrame:
    """One row per key, the last by `order`; give enough columns to break ties."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*(F.desc_nulls_last(c) for c in order)))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] | list[str], *order: str) -> DataFrame:
    """old with the rows of new put in by key. Of several new rows of a key the last by `order` counts."""
    new = latest_per_key(new, keys, *(order or [c for c in new.columns if c not in keys]))
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def coverage(quotes: DataFrame, requested: DataFrame, start: dt.date, end: dt.date, ratio: float = 0.65) -> DataFrame:
    """symbol, n, needed, covered for each requested symbol: whether it has ratio * calendar days rows.

    Trading days are about 0.69 of calendar days; 0.7 is never reached over long ranges. A range of a day needs one row.
    """
    needed = max(1, int(ratio * (end - start).days))
    have = quotes.filter(F.col("date").between(F.lit(start), F.lit(end))).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    df = requested.select("symbol").join(have, "symbol", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return df.withColumn("needed", F.lit(needed).cast("long")).withColumn("covered", F.col("n") >= F.col("needed"))


def miss_set(requested: DataFrame, cached: DataFrame) -> DataFrame:
    """Requested symbols that the cache lacks."""
    return requested.select("symbol").distinct().join(cached.select("symbol").distinct(), "symbol", "left_anti")


def stats(quotes: DataFrame, universe: DataFrame | None = None, statements: DataFrame | None = None, ciks: DataFrame | None = None) -> DataFrame:
    """One row: quotes, symbols, and what is given of active_universe, statements, ciks."""
    out = quotes.agg(F.count(F.lit(1)).alias("quotes"), F.countDistinct("symbol").alias("symbols"))
    for df, name in ((universe.filter("active") if universe is not None else None, "active_universe"), (statements, "statements"), (ciks, "ciks")):
        if df is not None:
            out = out.join(F.broadcast(df.agg(F.count(F.lit(1)).alias(name))))  # one row each
    return out


@dataclass
class Store:
    """Tables under a root that all executors reach."""

    spark: SparkSession
    root: str

    def _fs(self, path: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _folder(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def _versions(self, table: str) -> list[int]:
        fs, p = self._fs(f"{self._folder(table)}/_log")
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(x.removesuffix(".json")) for x in names if x.endswith(".json"))

    def _state(self, table: str, version: int | None = None) -> dict:
        """parts: the layers of each part, oldest first, as path and number; cleared: the number from which on each symbol's rows count."""
        if version is None:
            version = max(self._versions(table), default=0)
        if not version:
            return {"version": 0, "parts": {}, "cleared": {}}
        fs, p = self._fs(f"{self._folder(table)}/_log/{version:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, table: str, change: Callable[[dict, int], dict]) -> int:
        """Log change(newest state, its new number); if another writer takes the number first, once more on what it left."""
        jvm, folder = self.spark._jvm, f"{self._folder(table)}/_log"
        fs, top = self._fs(folder)
        fs.mkdirs(top)
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(top).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        while True:
            old = self._state(table)
            n = old["version"] + 1
            new = change(old, n) | {"version": n}
            _, aside = self._fs(f"{folder}/.{uuid.uuid4().hex}")
            stream = fs.create(aside, False)
            stream.write(bytearray(json.dumps(new).encode()))
            stream.close()
            try:
                context.rename(fs.makeQualified(aside), fs.makeQualified(self._fs(f"{folder}/{n:012d}.json")[1]), none)
                return n
            except Py4JJavaError as e:
                fs.delete(aside, False)
                if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                    raise

    def _part(self, table: str) -> Column:
        """The part that a row is in: its month, or the only one."""
        return F.coalesce(F.date_format("date", "yyyy-MM"), F.lit("none")) if "date" in KEYS[table] else F.lit("all")

    def read(self, table: str, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
        """The table, empty if nothing was written yet; with start and end only the months between, of a table with a date."""
        return self._view(table, self._state(table), lambda k: not (start and end) or k in ("all", "none") or f"{start:%Y-%m}" <= k <= f"{end:%Y-%m}")

    def _view(self, table: str, state: dict, wanted: Callable[[str], bool]) -> DataFrame:
        """The rows of the parts wanted: those of parts of one layer as they are, of others each key's last."""
        once: dict[int, list[str]] = {}
        many: dict[int, list[str]] = {}
        for part, layers in state["parts"].items():
            if wanted(part):
                for path, n in layers:
                    (many if len(layers) > 1 else once).setdefault(n, []).append(path)
        plain = [self._layer(table, state, n, paths) for n, paths in sorted(once.items())]
        stacked = [self._layer(table, state, n, paths).withColumn("_n", F.lit(n)) for n, paths in sorted(many.items())]
        if stacked:
            plain.append(latest_per_key(reduce(DataFrame.unionByName, stacked), KEYS[table], "_n").drop("_n"))
        return reduce(DataFrame.unionByName, plain) if plain else conform(self.spark.range(0), table).filter(F.lit(False))

    def _layer(self, table: str, state: dict, n: int, paths: list[str]) -> DataFrame:
        """The rows of layer n, without those of symbols cleared since."""
        df = self.spark.read.schema(DDL[table]).parquet(*(f"{self._folder(table)}/{x}" for x in sorted(paths)))
        gone = [x for x, since in state["cleared"].items() if since > n]
        return df.filter(~F.col("symbol").isin(gone)) if gone else df

    def _write(self, table: str, df: DataFrame) -> dict[str, str]:
        """Write df as a layer: the folder of each part. Rows of a large part are dealt to several tasks, small parts to one."""
        version, folder = uuid.uuid4().hex, self._folder(table)
        df.withColumn("_part", self._part(table)).hint("rebalance", "_part").write.partitionBy("_part").parquet(f"{folder}/{version}")
        fs, p = self._fs(f"{folder}/{version}")
        made = [x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()]
        return {x.removeprefix("_part="): f"{version}/{x}" for x in made}

    def compact(self, table: str, most: int = 1) -> None:
        """Merge the layers of parts with more than `most`, and delete what only numbers before the last one name."""
        state = self._state(table)
        parts = {k: v for k, v in state["parts"].items() if len(v) > most}
        if parts:
            made = self._write(table, self._view(table, state, lambda k: k in parts))

            def replace(old: dict, n: int) -> dict:
                out = {}
                for k, layers in old["parts"].items():
                    # Merged layers that another writer has removed since stay removed.
                    if k in parts and all(x in layers for x in parts[k]):
                        layers = [*([[made[k], parts[k][-1][1]]] if k in made else []), *(x for x in layers if x not in parts[k])]
                    if layers:
                        out[k] = layers
                return old | {"parts": out}

            self._commit(table, replace)
        self._vacuum(table)

    def _vacuum(self, table: str) -> None:
        versions = self._versions(table)
        named = {path.split("/")[0] for v in versions[-2:] for layers in self._state(table, v)["parts"].values() for path, _ in layers}
        old = {path.split("/")[0] for v in versions[:-2] for layers in self._state(table, v)["parts"].values() for path, _ in layers}
        for x in old - named:
            fs, p = self._fs(f"{self._folder(table)}/{x}")
            fs.delete(p, True)
        for v in versions[:-2]:
            fs, p = self._fs(f"{self._folder(table)}/_log/{v:012d}.json")
            fs.delete(p, False)

    def put(self, table: str, rows: DataFrame) -> None:
        """Insert or replace rows by the table's key; a stamp column that rows lack is now."""
        stamp = STAMPS.get(table)
        if stamp and stamp not in rows.columns:
            rows = rows.withColumn(stamp, F.current_timestamp())
        if table == "universe" and "active" not in rows.columns:
            rows = rows.withColumn("active", F.lit(True))
        new, keys = conform(rows, table), KEYS[table]
        made = self._write(table, latest_per_key(new, keys, *([stamp] if stamp else []), *(c for c in new.columns if c not in (*keys, stamp))))
        if not made:
            return

        def add(old: dict, n: int) -> dict:
            return old | {"parts": old["parts"] | {k: [*old["parts"].get(k, []), [path, n]] for k, path in made.items()}}

        self._commit(table, add)
        if any(len(layers) > LAYERS for layers in self._state(table)["parts"].values()):
            self.compact(table, LAYERS)

    def remove_from_universe(self, symbol: str) -> None:
        """Mark a symbol inactive."""
        self.put("universe", self.read("universe").filter(F.col("symbol") == symbol).withColumn("active", F.lit(False)))

    def universe(self) -> DataFrame:
        return self.read("universe").filter("active").orderBy("symbol")

    def quotes(self, symbol: str, start: dt.date, end: dt.date) -> DataFrame:
        out = self.read("quotes", start, end).filter((F.col("symbol") == symbol) & F.col("date").between(F.lit(start), F.lit(end))).orderBy("date")
        if out.isEmpty():
            raise MissingData(f"no quotes of {symbol} from {start} to {end}")
        return out

    def statements(self, symbol: str) -> DataFrame:
        return self.read("financial_statements").filter(F.col("symbol") == symbol).orderBy(F.desc("period_end"))

    def latest_statement(self, symbol: str, period_type: str) -> DataFrame:
        return self.statements(symbol).filter(F.col("period_type") == period_type).limit(1)

    def lookup(self, table: str, **key) -> DataFrame:  # noqa: ANN003
        """Rows whose columns have the values given."""
        df = self.read(table)
        for k, v in key.items():
            df = df.filter(F.col(k) == F.lit(v))
        return df

    def has_recent(self, symbol: str, days: int, now: dt.datetime | None = None) -> bool:
        """Whether any of a symbol's statements was stored within `days`."""
        now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        return not self.statements(symbol).filter(F.col("cached_at") >= F.lit(now - dt.timedelta(days=days))).isEmpty()

    def has_quotes(self, symbol: str, start: dt.date, end: dt.date, ratio: float = 0.65) -> bool:
        one = self.spark.createDataFrame([(symbol,)], "symbol string")
        return bool(coverage(self.read("quotes", start, end), one, start, end, ratio).first()["covered"])

    def stats(self) -> DataFrame:
        return stats(self.read("quotes"), self.read("universe"), self.read("financial_statements"), self.read("company_ciks"))

    def clear(self, symbol: str | None = None) -> None:
        """Delete all rows, or a symbol's, of every table but the universe. No data file is read or written."""
        for t in KEYS:
            if t != "universe" and self._state(t)["parts"]:
                self._commit(t, lambda old, n: old | ({"parts": {}, "cleared": {}} if symbol is None else {"cleared": old["cleared"] | {symbol: n}}))

    def scan_universe(self, symbols: list[str], start: dt.date, end: dt.date, fetch, refresh: bool = False, use_cache: bool = True) -> DataFrame:  # noqa: ANN001
        """Quotes of the symbols: cached ones from here, the others from fetch(symbols) -> DataFrame, which are stored.

        refresh reads none but stores all; use_cache=False does neither.
        """
        wanted = self.spark.createDataFrame([(s,) for s in symbols], "symbol string")
        have = self.read("quotes", start, end)
        covered = coverage(have, wanted, start, end).filter("covered").select("symbol") if use_cache and not refresh else wanted.limit(0)
        missing = [r[0] for r in miss_set(wanted, covered).collect()]  # of the symbols named
        if missing:
            new = conform(fetch(missing), "quotes")
            if not use_cache:
                return new
            self.put("quotes", new)
        out = self.read("quotes", start, end).join(wanted, "symbol").filter(F.col("date").between(F.lit(start), F.lit(end)))
        if out.isEmpty():
            raise MissingData("no symbol has quotes")
        return out
