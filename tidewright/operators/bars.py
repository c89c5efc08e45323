"""Bars: quotes aggregated to intervals, and audits of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.market import epoch


def bars(ticks: DataFrame, step: str) -> DataFrame:
    """symbol, open_time, close_time, open, high, low, close, mean, p95, quote_count of left-closed intervals.

    ticks: symbol, ts, seq, price. Open and close go by (ts, seq). One partial aggregation, one shuffle by
    (symbol, interval). Quotes without a price are left out.
    """
    at = F.struct("ts", "seq")
    out = ticks.filter("price is not null").groupBy("symbol", F.window("ts", step).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.round(F.avg("price"), 6).alias("mean"), F.round(F.expr("percentile(price, 0.95)"), 6).alias("p95"), F.count("*").alias("quote_count"),
    )
    return out.select("symbol", F.col("w.start").alias("open_time"), F.col("w.end").alias("close_time"), "open", "high", "low", "close", "mean", "p95", "quote_count")


def right_closed(ticks: DataFrame, step: str) -> DataFrame:
    """Bars of intervals closed and labelled on the right: symbol, close_time, open, high, low, close, quote_count."""
    shifted = ticks.withColumn("__t", F.expr("ts - interval 1 microsecond"))
    at = F.struct("ts", "seq")
    out = shifted.filter("price is not null").groupBy("symbol", F.window("__t", step).alias("w")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").alias("quote_count"))
    return out.select("symbol", F.col("w.end").alias("close_time"), "open", "high", "low", "close", "quote_count")


def many(ticks: DataFrame, steps: dict[str, str]) -> DataFrame:
    """Bars of several intervals, stacked with the interval's name: one scan, each quote in one window of each interval."""
    at = F.struct("ts", "seq")
    seconds = {n: _seconds(s) for n, s in steps.items()}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("interval"), F.lit(k).alias("step")) for n, k in seconds.items()]))
    rows = ticks.filter("price is not null").select("symbol", "ts", "seq", "price", each.alias("x")).select("symbol", "ts", "seq", "price", "x.*")
    start = F.floor(epoch("ts") / F.col("step")) * F.col("step")
    out = rows.groupBy("symbol", "interval", "step", start.alias("start")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.round(F.avg("price"), 6).alias("mean"), F.round(F.expr("percentile(price, 0.95)"), 6).alias("p95"), F.count("*").alias("quote_count"),
    )
    moment = lambda s: F.timestamp_add("SECOND", s, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return out.select("symbol", moment(F.col("start")).alias("open_time"), moment(F.col("start") + F.col("step")).alias("close_time"), "open", "high", "low", "close", "mean", "p95", "quote_count", "interval")


def _seconds(step: str) -> int:
    """Seconds of an interval of minutes, hours or days."""
    n, unit = step.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}[unit.rstrip("s")]


def bid_ask(quotes: DataFrame, step: str, seconds: int, expected: float) -> DataFrame:
    """Bars of bid, ask and mid with the spread's distribution, longest gap within the bar and coverage.

    quotes: symbol, ts, seq, bid, ask. coverage is the share of the expected quotes, one each `expected` seconds.
    """
    q = quotes.withColumn("mid", (F.col("bid") + F.col("ask")) / 2).withColumn("spread", F.col("ask") - F.col("bid")).withColumn("w", F.window("ts", step))
    w = Window.partitionBy("symbol", "w.start").orderBy("ts", "seq")
    q = q.withColumn("idle", epoch("ts") - F.lag(epoch("ts")).over(w))
    at = F.struct("ts", "seq")
    prices = [f(s) for s in ("bid", "ask", "mid") for f in (lambda s: F.min_by(s, at).alias(f"{s}_open"), lambda s: F.max(s).alias(f"{s}_high"), lambda s: F.min(s).alias(f"{s}_low"), lambda s: F.max_by(s, at).alias(f"{s}_close"))]
    out = q.groupBy("symbol", F.col("w.start").alias("open_time"), F.col("w.end").alias("close_time")).agg(
        *prices, F.min_by("spread", at).alias("spread_open"), F.round(F.avg("spread"), 6).alias("spread_mean"), F.round(F.expr("percentile(spread, 0.5)"), 6).alias("spread_median"),
        F.round(F.expr("percentile(spread, 0.95)"), 6).alias("spread_p95"), F.max("spread").alias("spread_max"), F.count("*").alias("quote_count"), F.round(F.coalesce(F.max("idle"), F.lit(0.0)), 6).alias("stale_seconds"),
    )
    return out.withColumn("source_coverage", F.round(F.least(F.lit(1.0), F.col("quote_count") * expected / seconds), 6))


def gaps(bars_: DataFrame, seconds: int) -> DataFrame:
    """symbol, bars, expected, missing, completeness, longest_gap (intervals) between a symbol's first and last bar."""
    w = Window.partitionBy("symbol").orderBy("open_time")
    step = (epoch("open_time") - F.lag(epoch("open_time")).over(w)) / seconds
    out = bars_.withColumn("step", step).groupBy("symbol").agg(F.count("*").alias("bars"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("steps"), F.coalesce(F.max("step"), F.lit(1.0)).alias("longest"))
    return out.select("symbol", "bars", (F.col("steps") + 1).cast("long").alias("expected"), (F.col("steps") + 1 - F.col("bars")).cast("long").alias("missing"), F.round(F.col("bars") / (F.col("steps") + 1), 6).alias("completeness"), (F.col("longest") - 1).cast("long").alias("longest_gap"))


def merged(bid: DataFrame, ask: DataFrame) -> DataFrame:
    """Bid and ask bars joined on (symbol, open_time), crossed ones left out, with mid prices and spread."""
    b = bid.select("symbol", "open_time", *[F.col(c).alias(f"bid_{c}") for c in ("open", "high", "low", "close")])
    a = ask.select("symbol", "open_time", *[F.col(c).alias(f"ask_{c}") for c in ("open", "high", "low", "close")])
    out = b.join(a, ["symbol", "open_time"]).filter("bid_close <= ask_close and bid_open <= ask_open")
    return out.select("*", *[F.round((F.col(f"bid_{c}") + F.col(f"ask_{c}")) / 2, 6).alias(f"mid_{c}") for c in ("open", "high", "low", "close")], F.round(F.col("ask_close") - F.col("bid_close"), 6).alias("spread"))
