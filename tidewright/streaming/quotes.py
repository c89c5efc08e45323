"""Streams of quotes: bars behind a watermark, routing by state, order by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(quotes: DataFrame, step: str, lateness: str = "30 seconds") -> DataFrame:
    """Bars of a quote stream (symbol, ts timestamp, seq, price), each given out once its window is past the watermark."""
    at = F.struct("ts", "seq")
    out = quotes.withWatermark("ts", lateness).groupBy("symbol", F.window("ts", step).alias("w")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").alias("quote_count"))
    return out.select("symbol", F.col("w.start").alias("open_time"), "open", "high", "low", "close", "quote_count")


def classified(quotes: DataFrame, received: str = "received") -> DataFrame:
    """Quotes with state and flags from the row alone: crossed or bad prices and future or stale times are quarantined."""
    from tidewright.operators.quality import flags

    lag = F.col(received).cast("double") - F.col("ts").cast("double")
    broken = {"bad_price": (F.col("bid") <= 0) | (F.col("ask") <= 0), "crossed": F.col("bid") >= F.col("ask"), "future": lag < -2, "stale": lag > 30}
    return quotes.withColumn("flags", flags(broken)).withColumn("state", F.when(F.size("flags") > 0, "quarantined").otherwise("accepted"))


def in_order(quotes: DataFrame) -> DataFrame:
    """Quotes of a stream with accepted: not a repeat of (ts, seq) and not before the last accepted time of its symbol.

    State a symbol: the last accepted time and sequence number. Micro-batches of a symbol are sorted before use.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else (-1, -1)
        rows = pd.concat(list(batches)).sort_values("seq")
        verdicts = []
        for ts, seq in zip(rows["ts"].astype("int64"), rows["seq"], strict=True):
            ok = (ts, seq) > last and ts >= last[0]
            verdicts.append(bool(ok))
            if ok:
                last = (int(ts), int(seq))
        state.update(last)
        rows["accepted"] = verdicts
        yield rows[["symbol", "ts", "seq", "price", "accepted"]]

    return quotes.select("symbol", "ts", "seq", "price").groupBy("symbol").applyInPandasWithState(run, "symbol string, ts timestamp, seq long, price double, accepted boolean", "ts long, seq long", "append", "NoTimeout")


def routed(batch: DataFrame, accepted_path: str, quarantine_path: str) -> None:
    """For foreachBatch: one classified batch to two tables."""
    rows = batch.persist()
    rows.filter("state = 'accepted'").write.mode("append").parquet(accepted_path)
    rows.filter("state <> 'accepted'").write.mode("append").parquet(quarantine_path)
    rows.unpersist()
