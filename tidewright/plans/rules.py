"""Contracts, pairs, executable outcomes and learned rules over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import pairs
from tidewright.operators import bars, canonical, contracts
from tidewright.operators.quality import flags
from tidewright.plans.catalog import query
from tidewright.plans.market import _OH, TICKS, quotes
from tidewright.sources.tables import table

# The five event types as pairs.
NAMES = {"view": "eur/usd", "click": " GBPUSD", "purchase": "usdjpy ", "signup": "EUR/GBP", "error": "XAU"}
_NAME = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items()) + " END"
RATES = {"GBPUSD": 1.25, "USDJPY": 150.0}


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as orders in a pair: symbol, hour, units, price, sign."""
    name = F.element_at(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv]), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", pairs.normal(name).alias("symbol"), F.hour("ts").alias("hour"), (F.floor("value") * 100 + 1).cast("double").alias("units"), (F.col("value") / 100 + 1).alias("price"), F.when(F.col("event_id") % 2 == 0, 1.0).otherwise(-1.0).alias("sign"))


_PAIRED = f"""o AS (SELECT event_id, upper(replace(trim({_NAME}), '/', '')) AS s0, hour(ts) AS hour, floor(value) * 100 + 1 AS units, value / 100 + 1 AS price, CASE WHEN event_id % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign FROM events),
p AS (SELECT *, CASE WHEN length(s0) = 6 THEN s0 END AS symbol FROM o),
q AS (SELECT *, substr(symbol, 1, 3) AS base, substr(symbol, 4, 3) AS quote, CASE WHEN substr(symbol, 4, 3) = 'JPY' THEN 0.01::DOUBLE ELSE 0.0001::DOUBLE END AS pip,
  CASE symbol WHEN 'USDJPY' THEN 0.8::DOUBLE WHEN 'EURUSD' THEN 0.6::DOUBLE WHEN 'GBPUSD' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END * CASE hour WHEN 21 THEN 2.0::DOUBLE WHEN 22 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS spread,
  CASE symbol WHEN 'USDJPY' THEN 0.2::DOUBLE WHEN 'EURUSD' THEN 0.1::DOUBLE WHEN 'GBPUSD' THEN 0.15::DOUBLE ELSE 0.2::DOUBLE END * CASE hour WHEN 21 THEN 2.0::DOUBLE WHEN 22 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS slip FROM p),
u AS (SELECT *, CASE WHEN quote = 'USD' THEN 1.0::DOUBLE WHEN base = 'USD' THEN 1 / price WHEN quote = 'JPY' THEN 1 / 150.0::DOUBLE WHEN quote = 'GBP' THEN 1.25::DOUBLE END AS usd FROM q),
n AS (SELECT *, CASE WHEN base = 'USD' THEN units ELSE abs(units * price * usd) END AS notional, CASE WHEN base = 'USD' THEN 1.0::DOUBLE ELSE abs(price * usd) END AS one FROM u)"""


@query("pair_costs", f"""WITH {_PAIRED} SELECT symbol, hour, count(*) AS orders, round(avg(price + sign * pip * (spread / 2 + slip)), 6) AS fill, round(avg(notional), 4) AS notional, round(avg(notional / 1e6 * 30), 6) AS commission,
  round(avg(abs(pip * (spread + 2 * slip) * usd) + one / 1e6 * 60), 9) AS round_trip, round(avg(sign * units * 0.01 * usd), 6) AS pnl FROM n GROUP BY symbol, hour""")
def pair_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, conversion, fills, commissions and round trips of orders in pairs; what isn't a pair has no values."""
    s, price, hour = F.col("symbol"), F.col("price"), F.col("hour")
    rates = F.create_map(*[F.lit(x) for kv in RATES.items() for x in kv])
    o = _paired(spark, sf_dir)
    mean = lambda c, n: F.round(F.avg(c), n)
    usd = pairs.in_account(s, F.col("sign") * F.col("units") * 0.01, price, rates)
    return o.groupBy("symbol", "hour").agg(
        F.count("*").alias("orders"), mean(F.when(s.isNotNull(), pairs.fill(s, price, F.col("sign"), hour)).otherwise(pairs.fill(F.lit("XXXXXX"), price, F.col("sign"), hour)), 6).alias("fill"), mean(pairs.notional(s, F.col("units"), price, rates), 4).alias("notional"),
        mean(pairs.commission(s, F.col("units"), price, rates), 6).alias("commission"), mean(pairs.round_trip(s, price, hour, rates), 9).alias("round_trip"), mean(usd, 6).alias("pnl"),
    )


@query("pair_sizes", f"""WITH {_PAIRED}, e AS (SELECT *, abs(greatest(price / 50, pip * 5) * usd) + abs(pip * (spread + 2 * slip) * usd) + one / 1e6 * 60 AS each FROM n)
SELECT event_id, symbol, CASE WHEN each > 0 THEN greatest(0.0::DOUBLE, floor(least(1000.0::DOUBLE / each, 900000.0::DOUBLE / one))) ELSE 0.0::DOUBLE END AS units FROM e""")
def pair_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, price = F.col("symbol"), F.col("price")
    rates = F.create_map(*[F.lit(x) for kv in RATES.items() for x in kv])
    cost = pairs.round_trip(s, price, F.col("hour"), rates)
    u = pairs.units(s, F.lit(100_000.0), price, price / 50, cost, F.lit(100_000.0), rates)
    return _paired(spark, sf_dir).select("event_id", "symbol", u.cast("double").alias("units"))


@query("date_range", "SELECT event_type, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' - INTERVAL 30 MINUTES AND ts < TIMESTAMP '2024-01-20' + INTERVAL 1 DAY + INTERVAL 30 MINUTES GROUP BY event_type")
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = contracts.in_range(table(spark, sf_dir, "events"), "ts", "2024-01-05", "2024-01-20", 30, 30, required=False)
    return e.groupBy("event_type").agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


_IMPACT = "CASE WHEN value > 100 THEN 'High ' WHEN value > 30 THEN ' medium' WHEN value > 5 THEN 'LOW' ELSE 'holiday' END"


def _calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    impact = F.when(v > 100, "High ").when(v > 30, " medium").when(v > 5, "LOW").otherwise("holiday")
    return table(spark, sf_dir, "events").select("event_id", "ts", F.upper(F.substring("event_type", 1, 3)).alias("currency"), impact.alias("impact"))


@query("upcoming_events", f"WITH e AS (SELECT event_id, ts, upper(substr(event_type, 1, 3)) AS currency, lower(trim({_IMPACT})) AS impact FROM events), n AS (SELECT min(ts) + INTERVAL 5 DAYS AS now FROM events) SELECT event_id, ts, currency, impact FROM e, n WHERE ts >= now AND ts <= now + INTERVAL 48 HOURS AND impact IN ('medium', 'high')")
def upcoming_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _calendar(spark, sf_dir)
    now = e.agg((F.min("ts") + F.expr("interval 5 days")).alias("now"))
    rows = e.join(F.broadcast(now), F.lit(True))
    return contracts.upcoming(rows, F.col("now"), 48, "medium").select("event_id", "ts", "currency", F.lower(F.trim("impact")).alias("impact"))


@query("entry_times", "SELECT event_type, isodow(ts)::INT - 1 AS weekday, count(*) FILTER (isodow(ts) NOT IN (6, 7) AND (strftime(ts, '%H:%M:%S.%f') >= '20:30:00.000000' OR strftime(ts, '%H:%M:%S.%f') <= '06:00:00.000000')) AS allowed, count(*) AS events FROM events GROUP BY ALL")
def entry_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = contracts.allowed_time(F.col("ts"), "20:30", "06:00", (5, 6))
    return table(spark, sf_dir, "events").groupBy("event_type", F.weekday("ts").alias("weekday")).agg(F.count_if(ok).alias("allowed"), F.count("*").alias("events"))


@query("eligible_rows", "SELECT l_returnflag, count(*) AS rows, count(*) FILTER (l_shipdate <= l_receiptdate AND l_receiptdate <= l_commitdate AND l_linenumber <= 5 AND length(trim(l_shipmode)) > 0) AS eligible FROM (SELECT *, l_shipdate + INTERVAL 3 DAYS AS l_receiptdate, l_shipdate + to_days(floor(l_quantity / 8)::INT) AS l_commitdate, CASE WHEN l_tax > 0.02 THEN l_returnflag ELSE ' ' END AS l_shipmode FROM lineitem) GROUP BY l_returnflag")
def eligible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    l = l.withColumns({"available": F.col("l_shipdate") + F.expr("interval 3 days"), "prediction": F.col("l_shipdate") + F.make_dt_interval(F.floor(F.col("l_quantity") / 8).cast("int")), "mode": F.when(F.col("l_tax") > 0.02, F.col("l_returnflag")).otherwise(" ")})  # noqa: E741
    ok = contracts.point_in_time("prediction", "l_shipdate", "available", ["mode"], F.col("l_linenumber") <= 5, "sources")
    return l.withColumn("sources", F.array("l_returnflag")).groupBy("l_returnflag").agg(F.count("*").alias("rows"), F.count_if(ok).alias("eligible"))


@query("collected_quotes", f"""WITH t AS ({TICKS}), q AS (SELECT symbol, price - points / 1000 AS bid, CASE WHEN points < 3 THEN price - 1 ELSE price + points / 1000 END AS ask, CASE WHEN writer % 50 = 0 THEN 'nohash' ELSE sha256(seq::VARCHAR) END AS h, CASE WHEN seq % 97 = 0 THEN NULL ELSE ts END AS e, ts + to_microseconds(CASE WHEN points > 95 THEN -3000000 ELSE 500000 END) AS r, CASE WHEN writer % 7 = 0 THEN NULL ELSE points END AS size FROM t),
f AS (SELECT symbol, unnest(list_filter([CASE WHEN NOT coalesce(bid > 0, false) THEN 'invalid_bid' END, CASE WHEN NOT coalesce(ask > 0, false) THEN 'invalid_ask' END, CASE WHEN bid > 0 AND ask > 0 AND bid >= ask THEN 'crossed' END, CASE WHEN coalesce(epoch_us(e) - epoch_us(r) > 2000000, false) THEN 'future_event_time' END, CASE WHEN h = 'nohash' THEN 'bad_hash' END, CASE WHEN e IS NULL THEN 'missing_event_time' END, CASE WHEN size IS NULL THEN 'missing_size' END], lambda x: x IS NOT NULL)) AS flag FROM q)
SELECT symbol, flag, count(*) AS quotes FROM f GROUP BY ALL""")
def collected_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.sources.tables import ticks

    t = ticks(spark, sf_dir)
    size = F.when(F.col("writer") % 7 == 0, None).otherwise(F.col("points"))
    q = t.select(
        "symbol", (F.col("price") - F.col("points") / 1000).alias("bid"), F.when(F.col("points") < 3, F.col("price") - 1).otherwise(F.col("price") + F.col("points") / 1000).alias("ask"), F.when(F.col("writer") % 50 == 0, "nohash").otherwise(F.sha2(F.col("seq").cast("string"), 256)).alias("raw_sha256"),
        F.when(F.col("seq") % 97 == 0, None).otherwise(F.col("ts")).cast("timestamp").alias("event_time"), (F.col("ts") + F.when(F.col("points") > 95, F.expr("interval -3 seconds")).otherwise(F.expr("interval 500 milliseconds"))).cast("timestamp").alias("received"), F.col("seq").alias("sequence"), size.alias("bid_size"), size.alias("ask_size"),
    )
    return q.select("symbol", F.explode(flags(contracts.quote_faults())).alias("flag")).groupBy("symbol", "flag").agg(F.count("*").alias("quotes"))


@query("surprises", "SELECT l_returnflag, l_linestatus, count(s) AS releases, round(avg(s), 6) AS mean_z, round(max(s), 6) AS top_z FROM (SELECT *, CASE WHEN l_discount > 0 THEN (l_extendedprice - 45000) / (l_discount * 10000) END AS s FROM lineitem) GROUP BY ALL")
def surprises(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = contracts.surprise(F.col("l_extendedprice"), F.lit(45000), F.col("l_discount") * 10000)
    return table(spark, sf_dir, "lineitem").withColumn("s", z).groupBy("l_returnflag", "l_linestatus").agg(F.count("s").alias("releases"), F.round(F.avg("s"), 6).alias("mean_z"), F.round(F.max("s"), 6).alias("top_z"))


@query("signal_contract", "WITH s AS (SELECT l_returnflag, l_linenumber - 4 AS target, l_discount - 0.01 AS stop, CASE WHEN l_tax > 0.04 THEN l_tax - 0.06 END AS take FROM lineitem) SELECT l_returnflag, count(*) FILTER (target NOT IN (-1, 0, 1)) AS bad_target, count(*) FILTER (NOT stop > 0) AS bad_stop, count(*) FILTER (take IS NOT NULL AND NOT take > 0) AS bad_take FROM s GROUP BY l_returnflag")
def signal_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_linenumber") - 4).alias("target"), (F.col("l_discount") - 0.01).alias("stop_distance"), F.when(F.col("l_tax") > 0.04, F.col("l_tax") - 0.06).alias("take_distance"))
    bad = contracts.signal_faults()
    return s.groupBy("l_returnflag").agg(*[F.count_if(c).alias(f"bad_{n}") for n, c in bad.items()])


_BOOK = f"""t AS ({TICKS}), k AS (SELECT symbol, ts, seq, price - points / 1000 AS bid, price + points / 1000 AS ask, time_bucket(INTERVAL '1 hour', ts) AS w FROM t),
b AS (SELECT symbol, w AS bar_start, w + INTERVAL 1 HOUR AS fin, arg_min(bid, (ts, seq)) AS bid_open, max(bid) AS bid_high, min(bid) AS bid_low, arg_max(bid, (ts, seq)) AS bid_close, arg_min(ask, (ts, seq)) AS ask_open, max(ask) AS ask_high, min(ask) AS ask_low, arg_max(ask, (ts, seq)) AS ask_close FROM k GROUP BY symbol, w),
d AS (SELECT symbol || '|' || strftime(bar_start, '%Y-%m-%d %H') AS decision_id, symbol, fin AS ts, hour(bar_start) % 2 = 0 AS long, bid_close AS entry_bid, ask_close AS entry_ask FROM b),
l AS (SELECT *, CASE WHEN long THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s, CASE WHEN long THEN entry_ask ELSE entry_bid END AS entry FROM d),
j AS (SELECT l.*, b.fin, CASE WHEN long THEN bid_open ELSE ask_open END AS o, CASE WHEN long THEN bid_high ELSE ask_low END AS best, CASE WHEN long THEN bid_low ELSE ask_high END AS worst, CASE WHEN long THEN bid_close ELSE ask_close END AS c, (ask_open - bid_open) / 2 AS half, (bid_open + ask_open) / 2 AS mo, (bid_close + ask_close) / 2 AS mc
  FROM l JOIN b ON l.symbol = b.symbol AND b.bar_start >= l.ts AND b.fin <= l.ts + INTERVAL 73 HOURS WHERE {_OH.format('b.fin')} - {_OH.format('l.ts')} > 0 AND {_OH.format('b.fin')} - {_OH.format('l.ts')} <= 86400),
h AS (SELECT *, CASE WHEN s * (o - (entry - s * 20)) <= 0 THEN 'sl_gap' WHEN s * (o - (entry + s * 40)) >= 0 THEN 'tp2_gap' WHEN s * (o - (entry + s * 20)) >= 0 THEN 'tp1_gap' WHEN s * (worst - (entry - s * 20)) <= 0 AND s * (best - (entry + s * 20)) >= 0 THEN 'ambiguous_sl_tp' WHEN s * (worst - (entry - s * 20)) <= 0 THEN 'sl' WHEN s * (best - (entry + s * 40)) >= 0 THEN 'tp2' WHEN s * (best - (entry + s * 20)) >= 0 THEN 'tp1' END AS touch FROM j),
x AS (SELECT *, CASE WHEN touch LIKE 'tp2%' THEN entry + s * 40 WHEN touch LIKE 'tp1%' THEN entry + s * 20 ELSE entry - s * 20 END AS level FROM h),
z AS (SELECT *, CASE WHEN touch = 'sl_gap' THEN o WHEN touch IS NULL THEN c ELSE level END AS exit, CASE WHEN touch = 'sl_gap' THEN mo WHEN touch IS NULL THEN mc ELSE level + s * half END AS mid FROM x),
g AS (SELECT decision_id, any_value(symbol) AS symbol, any_value(long) AS long, any_value(s) AS s, any_value(entry) AS entry, any_value(entry_bid) AS entry_bid, any_value(entry_ask) AS entry_ask, count(*) AS bars, coalesce(arg_min({{'touch': touch, 'fin': fin, 'exit': exit, 'mid': mid}}, fin) FILTER (touch IS NOT NULL), arg_max({{'touch': touch, 'fin': fin, 'exit': exit, 'mid': mid}}, fin)) AS e FROM z GROUP BY decision_id),
r AS (SELECT *, regexp_replace(coalesce(e.touch, 'terminal'), '^(tp[12])_gap$', '\\1') AS first_touch, s * (e.exit - entry) / 20 AS quote_r, s * (e.mid - (entry_bid + entry_ask) / 2) / 20 AS gross_r FROM g)"""


def canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars.bid_ask(quotes(spark, sf_dir), "1 hour", 3600, 600).withColumnsRenamed({"open_time": "bar_start", "close_time": "at"}).select("symbol", "bar_start", "at", *canonical.SIDES)
    long = F.hour("bar_start") % 2 == 0
    d = b.select(F.concat_ws("|", "symbol", F.date_format("bar_start", "yyyy-MM-dd HH")).alias("decision_id"), "symbol", F.col("at").alias("ts"), F.when(long, "long").otherwise("short").alias("direction"), F.col("bid_close").alias("entry_bid"), F.col("ask_close").alias("entry_ask"))
    s = F.when(F.col("direction") == "long", 1.0).otherwise(-1.0)
    entry = F.when(F.col("direction") == "long", F.col("entry_ask")).otherwise(F.col("entry_bid"))
    d = d.withColumns({"stop": entry - s * 20, "target1": entry + s * 20, "target2": entry + s * 40, "risk": F.lit(20.0), "slippage_r": F.lit(0.01), "commission_r": F.lit(0.02), "financing_r": F.lit(0.0)})
    return canonical.canonical(canonical.executable_paths(d, b, 24))


@query("canonical_outcomes", f"""WITH {_BOOK} SELECT decision_id, symbol, CASE WHEN long THEN 'long' ELSE 'short' END AS direction, bars, first_touch, e.fin AS holding_end_time, round(e.exit, 8) AS exit_executable, round(e.mid, 8) AS exit_mid, round(quote_r, 8) AS quote_realized_r, round(gross_r, 8) AS gross_realized_r,
  round(CASE WHEN first_touch IN ('sl', 'sl_gap', 'ambiguous_sl_tp') THEN -1.0::DOUBLE WHEN first_touch = 'tp1' THEN 1.0::DOUBLE WHEN first_touch = 'tp2' THEN 2.0::DOUBLE END, 8) AS planned_payoff_r, round((entry_ask - entry_bid) / 20, 8) AS entry_spread_r, 0.03::DOUBLE AS additional_cost_r, round(quote_r - 0.03::DOUBLE, 8) AS realized_net_r, round(gross_r - (quote_r - 0.03::DOUBLE), 8) AS execution_cost_r FROM r""")
def canonical_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_rows(spark, sf_dir)


@query("canonical_expectancy", f"""WITH {_BOOK}, v AS (SELECT symbol, CASE WHEN long THEN 'long' ELSE 'short' END AS direction, round(gross_r, 8) AS g, round(quote_r - 0.03::DOUBLE, 8) AS n FROM r)
SELECT symbol, direction, count(*) AS raw_samples, count(g) AS gross_samples, count(n) AS net_label_samples, round(count(n) / count(g), 6) AS net_label_coverage, round(avg(g), 6) AS gross_expectancy_r, round(avg(n), 6) AS net_expectancy_r,
  round(sum(CASE WHEN g > 0 THEN g ELSE 0 END) / sum(CASE WHEN g < 0 THEN -g ELSE 0 END), 4) AS gross_profit_factor, round(sum(CASE WHEN n > 0 THEN n ELSE 0 END) / sum(CASE WHEN n < 0 THEN -n ELSE 0 END), 4) AS net_profit_factor FROM v GROUP BY ALL""")
def canonical_expectancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.canonical_cells(canonical_rows(spark, sf_dir), ["symbol", "direction"])


_LABEL = """SELECT l_orderkey || ':' || l_linenumber AS decision_id, CASE WHEN l_linenumber = 7 THEN 'old' ELSE 'net-r-v2' END AS label_version, l_linenumber <> 6 AS eligible, l_extendedprice AS bid, l_extendedprice * (1 + l_tax / 100) AS ask, CASE WHEN l_quantity > 48 THEN 0 ELSE l_quantity END AS risk, CASE WHEN l_discount > 0.08 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS slip, l_linestatus = 'O' AS off, CASE WHEN l_returnflag = 'R' THEN 'mail' ELSE 'fixture' END AS source FROM lineitem"""


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as persisted labels, some broken in one way or another."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    c = F.col
    l = l.select(  # noqa: E741
        F.concat_ws(":", c("l_orderkey").cast("string"), c("l_linenumber").cast("string")).alias("decision_id"), F.when(c("l_linenumber") == 7, "old").otherwise("net-r-v2").alias("label_version"), (c("l_linenumber") != 6).alias("net_label_eligible"), c("l_extendedprice").alias("entry_bid"),
        (c("l_extendedprice") * (1 + c("l_tax") / 100)).alias("entry_ask"), F.when(c("l_quantity") > 48, 0.0).otherwise(c("l_quantity").cast("double")).alias("planned_risk_distance"), F.when(c("l_discount") > 0.08, 0.1).otherwise(0.0).alias("slippage_r"), (c("l_linestatus") == "O").alias("off"),
        F.when(c("l_returnflag") == "R", "mail").otherwise("fixture").alias("entry_quote_source"), c("l_shipdate").alias("prediction_time"),
    )
    fixed = {"label_provenance": "paper_quote_model", "symbol": "EUR/USD", "direction": "long", "timeframe": "1h", "cost_model_id": "fixture-executable-quotes-zero-slippage-v1", "cost_model_version": "1", "cost_status": contracts.COST_STATUS, "spread_source": "fixture", "slippage_model_id": contracts.SLIPPAGE_MODEL, "commission_model_id": contracts.COMMISSION_MODEL}
    spread = F.when(c("planned_risk_distance") > 0, (c("entry_ask") - c("entry_bid")) / F.when(c("planned_risk_distance") > 0, c("planned_risk_distance"))).otherwise(0.0)
    return l.withColumns({k: F.lit(v) for k, v in fixed.items()} | {"horizon_hours": F.lit(24.0), "holding_end_time": c("prediction_time") + F.expr("interval 1 day"), "commission_r": F.lit(0.0), "financing_r": F.lit(0.0), "path_quality": F.lit(1.0), "quote_realized_r": F.lit(0.5), "gross_realized_r": F.lit(0.6), "entry_spread_r": spread, "cost_quality_flags": F.array().cast("array<string>")}).withColumns({"additional_cost_r": c("slippage_r"), "realized_net_r": 0.5 - c("slippage_r") + F.when(c("off"), 0.01).otherwise(0.0)}).withColumn("execution_cost_r", 0.6 - c("realized_net_r"))


@query("label_contract", f"""WITH l AS ({_LABEL}), w AS (SELECT *, eligible AND label_version = 'net-r-v2' AS whole FROM l),
f AS (SELECT unnest(list_filter([CASE WHEN NOT eligible THEN 'net_label_not_eligible' END, CASE WHEN label_version = 'old' THEN 'unknown_label_version' END, CASE WHEN whole AND source = 'mail' THEN 'cost_model_entry_source_mismatch' END, CASE WHEN whole AND slip > 0 THEN 'slippage_model_value_mismatch' END,
  CASE WHEN whole AND NOT (bid > 0 AND bid <= ask) THEN 'invalid_entry_quote' END, CASE WHEN whole AND risk <= 0 THEN 'invalid_planned_risk_distance' END, CASE WHEN whole AND off THEN 'net_r_identity_mismatch' END], lambda x: x IS NOT NULL)) AS flag FROM w)
SELECT flag, count(*) AS labels FROM f GROUP BY flag""")
def label_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.with_label_flags(_labels(spark, sf_dir)).select(F.explode("label_flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("labels"))
