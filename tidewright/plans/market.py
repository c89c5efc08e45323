"""Quotes, bars, joins in time and indicators over the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import market
from tidewright.operators import bars as b
from tidewright.operators import folds, indicators, joins, paths, quality
from tidewright.plans.catalog import query
from tidewright.sources.tables import table, ticks

TICKS = "SELECT event_type AS symbol, ts, event_id AS seq, value AS price, user_id AS writer, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS points FROM events"
_BARS = """
SELECT event_type AS symbol, time_bucket(INTERVAL '{step}', ts) AS open_time, time_bucket(INTERVAL '{step}', ts) + INTERVAL '{step}' AS close_time,
  arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close,
  round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95, count(*) AS quote_count
FROM events WHERE value IS NOT NULL GROUP BY ALL
"""
BARS = _BARS.format(step="1 hour")
STEPS = {"5m": "5 minutes", "15m": "15 minutes", "1h": "1 hour", "4h": "4 hours", "1d": "1 day"}


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.bars(ticks(spark, sf_dir), "1 hour")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).select("symbol", "ts", "seq", (F.col("price") - F.col("points") / 1000).alias("bid"), (F.col("price") + F.col("points") / 1000).alias("ask"))


@query("bars_1h", BARS)
def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir)


@query("bars_many", " UNION ALL ".join(f"SELECT *, '{n}' AS interval FROM ({_BARS.format(step=s)})" for n, s in STEPS.items()))
def bars_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.many(ticks(spark, sf_dir), STEPS)


@query("bars_right_closed", """
SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts - INTERVAL 1 MICROSECOND) + INTERVAL '1 hour' AS close_time,
  arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS quote_count
FROM events WHERE value IS NOT NULL GROUP BY ALL""")
def bars_right_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.right_closed(ticks(spark, sf_dir), "1 hour")


_OHLC = ", ".join(f"arg_min({s}, (ts, seq)) AS {s}_open, max({s}) AS {s}_high, min({s}) AS {s}_low, arg_max({s}, (ts, seq)) AS {s}_close" for s in ("bid", "ask", "mid"))


@query("bars_bid_ask", f"""
WITH t AS ({TICKS}), q AS (SELECT symbol, ts, seq, price - points / 1000 AS bid, price + points / 1000 AS ask, time_bucket(INTERVAL '1 hour', ts) AS w FROM t),
r AS (SELECT *, (bid + ask) / 2 AS mid, ask - bid AS spread, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol, w ORDER BY ts, seq))) / 1e6 AS idle FROM q)
SELECT symbol, w AS open_time, w + INTERVAL '1 hour' AS close_time, {_OHLC}, arg_min(spread, (ts, seq)) AS spread_open, round(avg(spread), 6) AS spread_mean,
  round(quantile_cont(spread, 0.5), 6) AS spread_median, round(quantile_cont(spread, 0.95), 6) AS spread_p95, max(spread) AS spread_max, count(*) AS quote_count,
  round(coalesce(max(idle), 0.0), 6) AS stale_seconds, round(least(1.0, count(*) * 600.0 / 3600), 6) AS source_coverage FROM r GROUP BY symbol, w""")
def bars_bid_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.bid_ask(quotes(spark, sf_dir), "1 hour", 3600, 600)


@query("bars_merged", f"""
WITH b AS ({BARS}) SELECT x.symbol, x.open_time, x.open AS bid_open, x.high AS bid_high, x.low AS bid_low, x.close AS bid_close, y.open AS ask_open, y.high AS ask_high, y.low AS ask_low, y.close AS ask_close,
  round((x.open + y.open) / 2, 6) AS mid_open, round((x.high + y.high) / 2, 6) AS mid_high, round((x.low + y.low) / 2, 6) AS mid_low, round((x.close + y.close) / 2, 6) AS mid_close, round(y.close - x.close, 6) AS spread
FROM (SELECT 'x' AS symbol, open_time, open, high, low, close FROM b WHERE symbol = 'view') x JOIN (SELECT 'x' AS symbol, open_time, open, high, low, close FROM b WHERE symbol = 'click') y USING (symbol, open_time)
WHERE x.close <= y.close AND x.open <= y.open""")
def bars_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hourly(spark, sf_dir)
    return b.merged(h.filter("symbol = 'view'").withColumn("symbol", F.lit("x")), h.filter("symbol = 'click'").withColumn("symbol", F.lit("x")))


@query("bar_gap_audit", f"""
WITH b AS ({BARS}), s AS (SELECT symbol, date_diff('second', lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time), open_time) / 3600 AS step FROM b)
SELECT symbol, count(*) AS bars, (coalesce(sum(step), 0) + 1)::BIGINT AS expected, (coalesce(sum(step), 0) + 1 - count(*))::BIGINT AS missing,
  round(count(*) / (coalesce(sum(step), 0) + 1), 6) AS completeness, (coalesce(max(step), 1) - 1)::BIGINT AS longest_gap FROM s GROUP BY symbol""")
def bar_gap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.gaps(hourly(spark, sf_dir), 3600)


@query("quote_slo", f"""
WITH t AS ({TICKS}), l AS (SELECT *, coalesce(ts < lag(ts) OVER (PARTITION BY symbol ORDER BY seq), false) AS late FROM t)
SELECT symbol, count(*) AS quotes, round((count(*) - count(DISTINCT (ts, writer))) / count(*), 6) AS duplicate_rate, round(count(*) FILTER (late) / count(*), 6) AS out_of_order_rate,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS span_seconds FROM l GROUP BY symbol""")
def quote_slo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.service_levels(ticks(spark, sf_dir), ["symbol"], "seq", "ts", ["symbol", "ts", "writer"])


@query("quote_states", f"""
WITH t AS ({TICKS}), s AS (SELECT symbol, CASE WHEN price IS NULL THEN 'unavailable' WHEN points < 5 THEN 'quarantined' WHEN writer IS NULL OR points > 90 THEN 'degraded' ELSE 'usable' END AS state FROM t)
SELECT symbol, state, count(*) AS quotes FROM s GROUP BY ALL""")
def quote_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = quality.state(F.col("points") < 5, F.col("writer").isNull(), F.col("points") > 90, F.col("price").isNotNull())
    return ticks(spark, sf_dir).groupBy("symbol", s.alias("state")).agg(F.count("*").alias("quotes"))


@query("quote_flags", f"""
WITH t AS ({TICKS}), f AS (SELECT unnest(list_filter([CASE WHEN price < 1 THEN 'tiny' END, CASE WHEN points > 95 THEN 'wide' END, CASE WHEN writer % 10 = 0 THEN 'tenth_writer' END], lambda x: x IS NOT NULL)) AS flag FROM t)
SELECT flag, count(*) AS quotes FROM f GROUP BY flag""")
def quote_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = quality.flags({"tiny": F.col("price") < 1, "wide": F.col("points") > 95, "tenth_writer": F.col("writer") % 10 == 0})
    return ticks(spark, sf_dir).select(F.explode(f).alias("flag")).groupBy("flag").agg(F.count("*").alias("quotes"))


@query("open_hours", """
WITH s AS (SELECT event_id, (epoch_us(ts) / 1e6 - 162000) AS s FROM events)
SELECT event_id, round(floor(s / 604800) * 428400 + greatest(0.0, s - floor(s / 604800) * 604800 - 176400), 6) AS open_seconds, s - floor(s / 604800) * 604800 >= 176400 AS market_open FROM s""")
def open_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(market.open_seconds("ts"), 6).alias("open_seconds"), market.market_open("ts").alias("market_open"))


def _local(zone: str) -> str:
    return f"timezone('{zone}', timezone('UTC', ts))"


def _in(zone: str, start: int, end: int) -> str:
    return f"isodow({_local(zone)}) < 6 AND hour({_local(zone)}) >= {start} AND hour({_local(zone)}) < {end}"


@query("sessions", f"""
WITH s AS (SELECT *, epoch_us(ts) / 1e6 - 162000 AS s FROM events),
n AS (SELECT s - floor(s / 604800) * 604800 >= 176400 AS is_open, concat_ws('+', CASE WHEN {_in('Asia/Tokyo', 9, 18)} THEN 'tokyo' END, CASE WHEN {_in('Europe/London', 8, 17)} THEN 'london' END, CASE WHEN {_in('America/New_York', 8, 17)} THEN 'new_york' END) AS names,
  CAST({_local('America/New_York')} + INTERVAL 7 HOURS AS DATE) AS market_day FROM s)
SELECT market_day, CASE WHEN NOT is_open THEN 'closed' WHEN names = '' THEN 'off_session' ELSE names END AS session, count(*) AS events FROM n GROUP BY ALL""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(market.market_day("ts").alias("market_day"), market.session("ts").alias("session")).agg(F.count("*").alias("events"))


def _of(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(F.col("event_type") == kind)


@query("asof_backward", """
SELECT l.event_id, l.user_id, l.ts, r.ts AS matched_ts, r.value AS matched_value FROM (SELECT * FROM events WHERE event_type = 'purchase') l
ASOF LEFT JOIN (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY user_id, ts) r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _of(spark, sf_dir, "purchase").select("event_id", "user_id", "ts")
    right = _of(spark, sf_dir, "view").select("user_id", F.col("ts").alias("ts_"), "value", F.col("event_id").alias("tie"))
    return joins.asof(left, right, ["user_id"], "ts", "ts_", ["value"], tie="tie").withColumnRenamed("matched_ts_", "matched_ts")


@query("asof_tolerance", """
WITH j AS (SELECT l.event_id, l.ts, r.ts AS t, r.value AS v FROM (SELECT * FROM events WHERE event_type = 'purchase') l
ASOF LEFT JOIN (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY user_id, ts) r ON l.user_id = r.user_id AND l.ts >= r.ts)
SELECT event_id, CASE WHEN t + INTERVAL 6 HOURS >= ts THEN t END AS matched_ts, CASE WHEN t + INTERVAL 6 HOURS >= ts THEN v END AS matched_value FROM j""")
def asof_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _of(spark, sf_dir, "purchase").select("event_id", "user_id", "ts")
    right = _of(spark, sf_dir, "view").select("user_id", F.col("ts").alias("ts_"), "value", F.col("event_id").alias("tie"))
    return joins.asof(left, right, ["user_id"], "ts", "ts_", ["value"], "6 hours", "tie").select("event_id", F.col("matched_ts_").alias("matched_ts"), "matched_value")


@query("latest_vintage", """
SELECT l_partkey, l_suppkey, arg_max(l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS l_quantity, max(l_shipdate) AS l_shipdate FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-01-01' GROUP BY ALL""")
def latest_vintage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity")
    return joins.latest(rows, ["l_partkey", "l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"], F.col("l_shipdate") <= F.lit("1998-01-01").cast("timestamp_ntz")).select("l_partkey", "l_suppkey", "l_quantity", "l_shipdate")


@query("nearest_join", """
WITH p AS (SELECT l.event_id, r.event_id AS other_id, abs(epoch_us(l.ts) - epoch_us(r.ts)) / 1e6 AS gap, r.ts AS t FROM events l JOIN events r ON l.user_id = r.user_id AND l.event_type = 'click' AND r.event_type = 'signup'
  AND r.ts BETWEEN l.ts - INTERVAL 2 HOURS AND l.ts + INTERVAL 2 HOURS),
n AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY gap, t) AS n FROM p) SELECT event_id, other_id, round(gap, 6) AS gap FROM n WHERE n = 1""")
def nearest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _of(spark, sf_dir, "click").select("event_id", "user_id", "ts")
    right = _of(spark, sf_dir, "signup").select("user_id", F.col("event_id").alias("other_id"), F.col("ts").alias("other_ts"))
    return joins.nearest(left, right, ["user_id"], "event_id", market.epoch("ts"), market.epoch("other_ts"), 7200).select("event_id", "other_id", F.round("gap", 6).alias("gap"))


@query("no_trade_mask", f"""
WITH b AS ({BARS}), e AS (SELECT ts FROM events WHERE event_type = 'error' AND value > 100)
SELECT symbol, open_time, EXISTS (SELECT 1 FROM e WHERE b.open_time BETWEEN e.ts - INTERVAL 30 MINUTES AND e.ts + INTERVAL 30 MINUTES) AS blocked FROM b""")
def no_trade_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.masked(hourly(spark, sf_dir).select("symbol", "open_time"), "open_time", _of(spark, sf_dir, "error").filter("value > 100"), "ts", 1800, 1800)


_OH = "(floor((epoch_us({0}) / 1e6 - 162000) / 604800) * 428400 + greatest(0.0, (epoch_us({0}) / 1e6 - 162000) - floor((epoch_us({0}) / 1e6 - 162000) / 604800) * 604800 - 176400))"


@query("forward_horizon", f"""
WITH d AS (SELECT event_id, user_id, ts, value, {_OH.format('ts')} AS oh FROM events WHERE event_type = 'purchase'), f AS (SELECT event_id AS later_id, user_id, ts, value AS later, {_OH.format('ts')} AS oh FROM events WHERE event_type = 'view'),
p AS (SELECT d.event_id, f.later_id, d.value, f.later, f.oh - d.oh AS age, row_number() OVER (PARTITION BY d.event_id ORDER BY abs(f.oh - d.oh - 86400), f.ts) AS n FROM d JOIN f ON d.user_id = f.user_id AND f.oh - d.oh BETWEEN 72000 AND 100800)
SELECT event_id, later_id, round(age / 3600, 6) AS open_hours, CASE WHEN later - value > 1 THEN 'hit' WHEN later - value < -1 THEN 'miss' ELSE 'flat' END AS outcome FROM p WHERE n = 1""")
def forward_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _of(spark, sf_dir, "purchase").select("event_id", "user_id", "ts", "value")
    right = _of(spark, sf_dir, "view").select("user_id", F.col("event_id").alias("later_id"), F.col("ts").alias("later_ts"), F.col("value").alias("later"))
    out = joins.forward(left, right, ["user_id"], "event_id", "ts", "later_ts", 24, 4)
    return out.select("event_id", "later_id", F.round(F.col("open_age") / 3600, 6).alias("open_hours"), market.outcome(F.col("later") - F.col("value"), F.lit(10.0)).alias("outcome"))


def _levels(h: DataFrame) -> DataFrame:
    """Bars with a direction as decisions at the close, with a stop and targets at fixed distances."""
    return h.select(F.concat_ws("|", "symbol", F.date_format("open_time", "yyyy-MM-dd HH")).alias("decision_id"), "symbol", F.col("close_time").alias("ts"), "direction", F.col("close").alias("entry"), F.lit(20.0).alias("risk"), F.lit(20.0).alias("reward1"), F.lit(40.0).alias("reward2"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar's close as a decision, long in even and short in odd hours, with a stop and targets at fixed distances."""
    return _levels(hourly(spark, sf_dir).withColumn("direction", F.when(F.hour("open_time") % 2 == 0, "long").otherwise("short")))


_PATH = f"""
WITH b AS ({BARS}), d AS (SELECT symbol || '|' || strftime(open_time, '%Y-%m-%d %H') AS decision_id, symbol, close_time AS ts, CASE WHEN hour(open_time) % 2 = 0 THEN 1.0 ELSE -1.0 END AS s, close AS entry FROM b),
p AS (SELECT d.*, b.close_time AS pt, b.high, b.low, b.close, {_OH.format('b.close_time')} - {_OH.format('d.ts')} AS age FROM d JOIN b ON d.symbol = b.symbol AND b.close_time > d.ts AND b.close_time <= d.ts + INTERVAL 73 HOURS),
q AS (SELECT *, CASE WHEN s > 0 THEN high ELSE low END AS best, CASE WHEN s > 0 THEN low ELSE high END AS worst FROM p WHERE age > 0 AND age <= 86400),
t AS (SELECT *, CASE WHEN s * (worst - entry) <= -20 AND s * (best - entry) >= 20 THEN 'ambiguous' WHEN s * (worst - entry) <= -20 THEN 'sl' WHEN s * (best - entry) >= 40 THEN 'tp2' WHEN s * (best - entry) >= 20 THEN 'tp1' END AS touch FROM q),
f AS (SELECT *, min(CASE WHEN touch IS NOT NULL THEN pt END) OVER (PARTITION BY decision_id) AS touched_at FROM t),
o AS (SELECT decision_id, any_value(symbol) AS symbol, any_value(s) AS s, count(*) AS points, coalesce(arg_max(touch, pt) FILTER (touch IS NOT NULL AND pt = touched_at), 'none') AS first_touch, any_value(touched_at) AS touched_at,
  round(max(s * (best - entry) / 20), 6) AS mfe_r, round(greatest(max(s * (entry - worst) / 20), 0.0), 6) AS mae_r, arg_max(s * (close - entry) / 20, pt) AS end_r
  FROM f WHERE touched_at IS NULL OR pt <= touched_at GROUP BY decision_id),
r AS (SELECT decision_id, symbol, s, points, first_touch, touched_at, mfe_r, mae_r, round(CASE first_touch WHEN 'sl' THEN -1.0 WHEN 'ambiguous' THEN -1.0 WHEN 'tp2' THEN 2.0 WHEN 'tp1' THEN 1.0 ELSE end_r END, 6) AS realized_r FROM o)
"""


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hourly(spark, sf_dir).select("symbol", F.col("close_time").alias("at"), "high", "low", "close")
    return paths.first_touch(paths.paths(decisions(spark, sf_dir), h, 24))


@query("first_touch", _PATH + "SELECT decision_id, points, first_touch, touched_at, mfe_r, mae_r, realized_r FROM r")
def first_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return touches(spark, sf_dir)


@query("expectancy_cells", _PATH + """SELECT symbol, CASE WHEN s > 0 THEN 'long' ELSE 'short' END AS direction, count(*) AS evaluated, round(avg(realized_r), 5) AS expectancy_r,
  round(avg((first_touch IN ('sl', 'ambiguous'))::INT), 6) AS sl_rate, round(avg((first_touch IN ('tp1', 'tp2'))::INT), 6) AS tp_rate, round(avg(mfe_r), 5) AS mfe_avg, round(avg(mae_r), 5) AS mae_avg,
  round(CASE WHEN sum(CASE WHEN realized_r < 0 THEN -realized_r ELSE 0 END) > 0 THEN sum(CASE WHEN realized_r > 0 THEN realized_r ELSE 0 END) / sum(CASE WHEN realized_r < 0 THEN -realized_r ELSE 0 END) END, 4) AS profit_factor, count(*) >= 20 AS sample_ok FROM r GROUP BY symbol, s""")
def expectancy_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decisions(spark, sf_dir).select("decision_id", "symbol", "direction")
    cells = paths.expectancy(touches(spark, sf_dir).join(d, "decision_id"), ["symbol", "direction"])
    return cells.withColumn("profit_factor", F.when(F.col("profit_factor") < float("inf"), F.col("profit_factor")))


_W = "PARTITION BY symbol ORDER BY open_time"


def _roll(f: str, n: int, shift: int = 0) -> str:
    frame = f"ROWS BETWEEN {n - 1 + shift} PRECEDING AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'}"
    return f"CASE WHEN count(*) OVER ({_W} {frame}) >= {n} THEN {f} OVER ({_W} {frame}) END"


@query("sma_cross", f"WITH b AS ({BARS}), s AS (SELECT symbol, open_time, {_roll('avg(close)', 5)} AS fast, {_roll('avg(close)', 20)} AS slow FROM b) SELECT symbol, open_time, round(fast, 6) AS fast, round(slow, 6) AS slow, CASE WHEN round(fast - slow, 9) > 0 THEN 1 WHEN round(fast - slow, 9) < 0 THEN -1 ELSE 0 END AS position FROM s")
def sma_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = hourly(spark, sf_dir).select("symbol", "open_time", indicators.sma("close", 5).alias("fast"), indicators.sma("close", 20).alias("slow"))
    d = F.round(F.col("fast") - F.col("slow"), 9)
    return s.select("symbol", "open_time", F.round("fast", 6).alias("fast"), F.round("slow", 6).alias("slow"), F.when(d > 0, 1).when(d < 0, -1).otherwise(0).alias("position"))


@query("donchian", f"WITH b AS ({BARS}) SELECT symbol, open_time, {_roll('max(high)', 20, 1)} AS upper, {_roll('min(low)', 20, 1)} AS lower FROM b")
def donchian(spark: SparkSession, sf_dir: str) -> DataFrame:
    up, low = indicators.channel(20)
    return hourly(spark, sf_dir).select("symbol", "open_time", up.alias("upper"), low.alias("lower"))


@query("rolling_vol", f"""WITH b AS ({BARS}), r AS (SELECT symbol, open_time, ln(close / lag(close) OVER ({_W})) AS ret FROM b)
SELECT symbol, open_time, round(CASE WHEN count(ret) OVER w >= 24 THEN stddev_samp(ret) OVER w END, 6) AS vol FROM r WINDOW w AS ({_W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""")
def rolling_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = hourly(spark, sf_dir).withColumn("ret", F.ln(F.col("close") / F.lag("close").over(indicators.by())))
    w = indicators.over(24)
    return r.select("symbol", "open_time", F.round(F.when(F.count("ret").over(w) >= 24, F.stddev_samp("ret").over(w)), 6).alias("vol"))


@query("rolling_median", f"""WITH b AS ({BARS}) SELECT symbol, open_time, round(quantile_cont(p95, 0.5) OVER w, 6) AS median_p95, p95 <= 1.5 * quantile_cont(p95, 0.5) OVER w AS allowed FROM b WINDOW w AS ({_W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.expr("percentile(p95, 0.5)").over(indicators.over(12))
    return hourly(spark, sf_dir).select("symbol", "open_time", F.round(m, 6).alias("median_p95"), (F.col("p95") <= 1.5 * m).alias("allowed"))


@query("percent_rank", f"""WITH b AS ({BARS}), l AS (SELECT symbol, open_time, close, list(close) OVER ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS l FROM b)
SELECT symbol, open_time, CASE WHEN len(l) = 20 THEN round((len(list_filter(l, lambda x: x < close)) + (len(list_filter(l, lambda x: x = close)) + 1) / 2) / 20, 6) END AS rank FROM l""")
def percent_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hourly(spark, sf_dir).withColumn("l", F.collect_list("close").over(indicators.over(20)))
    below, same = F.size(F.filter("l", lambda x: x < F.col("close"))), F.size(F.filter("l", lambda x: x == F.col("close")))
    return h.select("symbol", "open_time", F.when(F.size("l") == 20, F.round((below + (same + 1) / 2) / 20, 6)).alias("rank"))


@query("rsi_simple", f"""WITH b AS ({BARS}), m AS (SELECT symbol, open_time, close - lag(close) OVER ({_W}) AS d FROM b), a AS (SELECT *, avg(greatest(d, 0)) FILTER (d IS NOT NULL) OVER w AS g, avg(greatest(-d, 0)) FILTER (d IS NOT NULL) OVER w AS l, count(*) OVER (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS n FROM m WINDOW w AS ({_W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
SELECT symbol, open_time, round(CASE WHEN n >= 15 THEN CASE WHEN g + l = 0 THEN 50 ELSE 100 * g / (g + l) END END, 5) AS rsi FROM a""")
def rsi_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.with_moves(hourly(spark, sf_dir)).select("symbol", "open_time", F.round(indicators.rsi_simple(14), 5).alias("rsi"))


_TR = f"SELECT symbol, open_time, greatest(high - low, abs(high - lag(close) OVER ({_W})), abs(low - lag(close) OVER ({_W}))) AS tr FROM b"


@query("atr_wilder", f"""WITH b AS ({BARS}), t AS ({_TR}), l AS (SELECT symbol, open_time, list(tr) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM t)
SELECT symbol, open_time, CASE WHEN len(l) >= 14 THEN round(list_reduce(l, lambda a, x: a + (x - a) / 14), 5) END AS atr FROM l""")
def atr_wilder(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = hourly(spark, sf_dir).select("symbol", "open_time", indicators.true_range().alias("tr"))
    return indicators.ewm(t, {"tr": "atr"}, 1 / 14, 14).select("symbol", "open_time", F.round("atr", 5).alias("atr"))


@query("rsi_wilder", f"""WITH b AS ({BARS}), m AS (SELECT symbol, open_time, close - lag(close) OVER ({_W}) AS d FROM b), l AS (SELECT symbol, open_time, list(greatest(d, 0.0)) FILTER (d IS NOT NULL) OVER w AS g, list(greatest(-d, 0.0)) FILTER (d IS NOT NULL) OVER w AS s FROM m WINDOW w AS ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
a AS (SELECT symbol, open_time, CASE WHEN len(g) >= 14 THEN list_reduce(g, lambda a, x: a + (x - a) / 14) END AS g, CASE WHEN len(g) >= 14 THEN list_reduce(s, lambda a, x: a + (x - a) / 14) END AS l FROM l)
SELECT symbol, open_time, CASE WHEN l > 0 THEN round(100 - 100 / (1 + g / l), 4) END AS rsi FROM a""")
def rsi_wilder(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = indicators.with_moves(hourly(spark, sf_dir)).select("symbol", "open_time", F.when(F.col("move").isNotNull(), F.col("gain")).alias("gain"), F.when(F.col("move").isNotNull(), F.col("loss")).alias("loss"))
    e = indicators.ewm(m, {"gain": "g", "loss": "l"}, 1 / 14, 14)
    return e.select("symbol", "open_time", F.when(F.col("l") > 0, F.round(100 - 100 / (1 + F.col("g") / F.col("l")), 4)).alias("rsi"))


@query("donchian_states")
def donchian_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    up, low = indicators.channel(20)
    mid = F.avg("close").over(indicators.over(10))
    s = hourly(spark, sf_dir).select("symbol", "open_time", F.coalesce(F.col("close") > up, F.lit(False)).alias("long"), F.coalesce(F.col("close") < low, F.lit(False)).alias("short"), (F.abs(F.col("close") - mid) < 5).alias("leave"))
    return indicators.states(s, "long", "short", "leave").select("symbol", "open_time", "position")


@query("triple_barrier", f"""WITH b AS ({BARS}), l AS (SELECT symbol, open_time, list({{'o': open, 'h': high, 'l': low, 'c': close}}) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS ahead FROM b),
e AS (SELECT symbol, open_time, ahead, ahead[1].o AS entry FROM l WHERE len(ahead) > 0),
t AS (SELECT *, list_transform(ahead, lambda x: CASE WHEN x.o <= entry - 60 THEN 'sl_gap' WHEN x.o >= entry + 100 THEN 'tp_gap' WHEN x.l <= entry - 60 THEN 'sl' WHEN x.h >= entry + 100 THEN 'tp' END) AS touch FROM e),
n AS (SELECT *, list_position(list_transform(touch, lambda x: x IS NOT NULL), true) AS k FROM t),
x AS (SELECT *, coalesce(nullif(k, 0), len(ahead)) AS n, CASE WHEN coalesce(k, 0) > 0 THEN touch[k] ELSE 'timeout' END AS first_touch FROM n),
p AS (SELECT *, CASE first_touch WHEN 'sl_gap' THEN ahead[n].o WHEN 'sl' THEN entry - 60 WHEN 'timeout' THEN ahead[n].c ELSE entry + 100 END AS exit_price FROM x)
SELECT symbol, open_time, first_touch, CASE WHEN first_touch LIKE 'sl%' THEN -1 WHEN first_touch LIKE 'tp%' THEN 1 ELSE 0 END AS label, n::INT AS bars_to_exit, round(exit_price, 6) AS exit_price, round((exit_price - entry) / 60, 6) AS gross_r FROM p""")
def triple_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.triple_barrier(hourly(spark, sf_dir), F.lit(100.0), F.lit(60.0), 6).select("symbol", "open_time", "first_touch", "label", "bars_to_exit", "exit_price", "gross_r")


@query("thinned_6h", """
WITH RECURSIVE e AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'), k AS (
  SELECT user_id, min(ts) AS ts FROM e GROUP BY user_id UNION ALL
  SELECT k.user_id, (SELECT min(e.ts) FROM e WHERE e.user_id = k.user_id AND e.ts >= k.ts + INTERVAL 6 HOURS) AS ts FROM k WHERE k.ts IS NOT NULL)
SELECT user_id, ts FROM k WHERE ts IS NOT NULL""")
def thinned_6h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.thinned(_of(spark, sf_dir, "purchase").select("user_id", "ts", "event_id"), ["user_id"], "ts", "event_id", 6 * 3600).select("user_id", "ts")


@query("aligned_last_price", f"""
WITH b AS ({BARS}), g AS (SELECT DISTINCT b.open_time, s.symbol FROM b CROSS JOIN (SELECT DISTINCT symbol FROM b) s)
SELECT g.symbol, g.open_time, last_value(b.close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.open_time) AS last_close, b.close IS NULL AS filled FROM g LEFT JOIN b ON g.symbol = b.symbol AND g.open_time = b.open_time""")
def aligned_last_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hourly(spark, sf_dir).select("symbol", "open_time", "close")
    symbols = h.agg(F.array_sort(F.collect_set("symbol")).alias("s"))
    grid = h.select("open_time").distinct().join(F.broadcast(symbols)).select("open_time", F.explode("s").alias("symbol"))
    w = Window.partitionBy("symbol").orderBy("open_time")
    return grid.join(h, ["symbol", "open_time"], "left").select("symbol", "open_time", F.last("close", True).over(w).alias("last_close"), F.col("close").isNull().alias("filled"))


@query("journal_audit", """
WITH e AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS step, coalesce(ts < lag(ts) OVER (PARTITION BY user_id ORDER BY event_id), false) AS back FROM events)
SELECT user_id, count(*) AS rows, count(*) FILTER (back) AS reversals, count(*) FILTER (step < 1800) AS repeats, count(*) FILTER (step > 7200) AS gaps, round(coalesce(max(step), 0.0), 3) AS worst_gap FROM e GROUP BY user_id""")
def journal_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.journal_audit(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", 1)


@query("activity_spine", """
WITH h AS (SELECT unnest(generate_series(date_trunc('hour', (SELECT max(ts) FROM events)) - INTERVAL 47 HOURS, date_trunc('hour', (SELECT max(ts) FROM events)), INTERVAL 1 HOUR)) AS hour), s AS (SELECT DISTINCT event_type FROM events)
SELECT h.hour, s.event_type, count(e.event_id) AS events FROM h CROSS JOIN s LEFT JOIN events e ON date_trunc('hour', e.ts) = h.hour AND e.event_type = s.event_type GROUP BY ALL""")
def activity_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    last = e.agg(F.date_trunc("hour", F.max("ts")).cast("timestamp_ntz").alias("z"), F.collect_set("event_type").alias("t"))
    spine = last.select(F.explode(F.expr("sequence(z - interval 47 hours, z, interval 1 hour)")).alias("hour"), "t").select("hour", F.explode("t").alias("event_type"))
    per = e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"))
    return spine.join(per, ["hour", "event_type"], "left").select("hour", "event_type", F.coalesce("n", F.lit(0)).cast("long").alias("events"))


@query("learning_curve", """SELECT event_id, user_id, event_type, (sum((value > 50)::INT) OVER w)::BIGINT AS hits, round(sum((value > 50)::INT) OVER w / count(*) OVER w, 6) AS hit_rate FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    hits = F.sum((F.col("value") > 50).cast("int")).over(w)
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", hits.alias("hits"), F.round(hits / F.count("*").over(w), 6).alias("hit_rate"))
