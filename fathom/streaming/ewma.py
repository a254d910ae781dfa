"""Streaming counterparts: deduplicated quotes and an exponentially weighted covariance that updates by period."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def last_result(counts: DataFrame) -> DataFrame:
    """Run an aggregated stream until all its input is read; its whole result, from a Parquet table.

    The table, and the stream's own state, are kept in the folder that spark.checkpoint.dir names, so
    nothing passes through the driver. Only a local session without that setting gets a temporary one.
    """
    spark = counts.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="fathom-stream-")
    folder, done = f"{root.rstrip('/')}/fathom-stream-{uuid.uuid4().hex}", []

    def write(batch: DataFrame, number: int) -> None:
        path = f"{folder}/result-{number}"
        batch.write.mode("overwrite").parquet(path)  # a batch that is run again replaces its own result
        done.append(path)

    sink = counts.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{folder}/state")
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(done[-1]) if done else spark.createDataFrame([], counts.schema)


def dedup_quotes(quotes: DataFrame, delay: str = "7 days") -> DataFrame:
    """One row per symbol and date within the delay; later ones are dropped. date becomes the event time."""
    timed = quotes.withColumn("event_time", F.to_timestamp(F.col("date").cast("timestamp")))
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["symbol", "date"])


def ewma_updates(returns: DataFrame, decay: float = 0.95) -> DataFrame:
    """Streamed factor returns (portfolio, date, factor, ret) to portfolio, date, factor_i, factor_j, value.

    The state of a portfolio is its last date, factors and covariance: K x K numbers, whatever has
    passed. C <- decay C + (1 - decay) r r' for each period in order; rows of a period at or before the last
    are refused, as the update depends on the order. A factor that a period lacks returns 0 in it.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        last, names, cov = state.get if state.exists else ("", [], [])
        names, c = list(names), np.array(cov, float).reshape(len(names), len(names))
        rows["date"] = rows["date"].astype(str)
        rows = rows[rows["date"] > last]
        new = sorted(set(rows["factor"]) - set(names))
        if new:
            names += new
            c = np.pad(c, (0, len(new)))
        out = []
        for date, period in rows.groupby("date", sort=True):
            r = period.groupby("factor")["ret"].last().reindex(names).fillna(0.0).to_numpy()
            c = decay * c + (1 - decay) * np.outer(r, r)
            last = date
            out.append(pd.DataFrame({"portfolio": key[0], "date": date, "factor_i": np.repeat(names, len(names)), "factor_j": np.tile(names, len(names)), "value": c.ravel()}))
        state.update((last, names, c.ravel().tolist()))
        yield pd.concat(out) if out else pd.DataFrame({k: pd.Series(dtype=t) for k, t in (("portfolio", str), ("date", str), ("factor_i", str), ("factor_j", str), ("value", float))})

    out = returns.groupBy("portfolio").applyInPandasWithState(
        update, "portfolio string, date string, factor_i string, factor_j string, value double", "last string, names array<string>, cov array<double>", "append", GroupStateTimeout.NoTimeout
    )
    return out.withColumn("date", F.to_date("date"))


def event_counts(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts and sums of values per window and event type, late rows beyond the delay left out. Works on streams and tables."""
    timed = events.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", delay)
    return timed.groupBy(F.window("event_time", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
