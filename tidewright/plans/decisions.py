"""Decisions, learned profiles, price checks and model fits over the event stream and the trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import market
from tidewright.operators import decisions as d
from tidewright.operators import reports, simulate, stats
from tidewright.plans.catalog import query
from tidewright.plans.market import BARS, hourly
from tidewright.plans.text import signals
from tidewright.plans.trades import NET, dims, scored, trades
from tidewright.sources.tables import table

# An event as a decision: scores from value and number, a hit if the value is over 50.
ROWS = "SELECT event_id, event_type AS symbol, CASE WHEN event_id % 2 = 0 THEN 'long' ELSE 'short' END AS direction, least(value, 200) / 100 - 1 AS tech, (event_id % 21) / 10.0::DOUBLE - 1 AS news, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, value > 50 AS hit, ts FROM events"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("event_type").alias("symbol"), F.when(F.col("event_id") % 2 == 0, "long").otherwise("short").alias("direction"), (F.least("value", F.lit(200.0)) / 100 - 1).alias("tech"), ((F.col("event_id") % 21) / 10.0 - 1).alias("news"), F.get_json_object("props", "$.k").cast("double").alias("k"), (F.col("value") > 50).alias("hit"), "ts")


_C = "CASE WHEN tech * news < 0 AND abs(tech) >= 0.35 AND abs(news) >= 0.35 THEN (0.55::DOUBLE * tech + 0.45::DOUBLE * news) * 0.75::DOUBLE ELSE 0.55::DOUBLE * tech + 0.45::DOUBLE * news END"


@query("decision_gates", f"""WITH r AS ({ROWS}), c AS (SELECT *, {_C} AS c FROM r), g AS (SELECT symbol, CASE WHEN k < 10 THEN 'quality' WHEN abs(c) < 0.15 THEN 'threshold' ELSE CASE WHEN c > 0 THEN 'long' ELSE 'short' END END AS gate, c FROM c)
SELECT symbol, gate, count(*) AS decisions, round(avg(c), 6) AS mean_score FROM g GROUP BY ALL""")
def decision_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, _ = d.composite(F.col("tech"), F.col("news"), F.lit(1.0))
    r = rows(spark, sf_dir).withColumn("c", c)
    side = F.when(F.col("c") > 0, "long").otherwise("short")
    g = d.gate([("quality", F.col("k") < 10), ("threshold", F.abs("c") < 0.15)], "open")
    return r.withColumn("gate", F.when(g == "open", side).otherwise(g)).groupBy("symbol", "gate").agg(F.count("*").alias("decisions"), F.round(F.avg("c"), 6).alias("mean_score"))


@query("symbol_factors", f"WITH r AS ({ROWS}), c AS (SELECT symbol, direction, count(*) AS n, count(*) FILTER (hit) AS hits FROM r GROUP BY ALL) SELECT *, round(hits / n, 6) AS rate, CASE WHEN n >= 8 AND hits / n < 0.45 THEN greatest(0.6::DOUBLE, round(hits / n / 0.5, 2)) ELSE 1.0::DOUBLE END AS factor FROM c")
def symbol_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.factors(rows(spark, sf_dir), ["symbol", "direction"], 8, 0.6)


_BUCKET = "CASE WHEN k < {0} THEN 'low' WHEN k < {1} THEN 'mid' WHEN k >= {1} THEN 'high' END"


@query("condition_factors", f"""WITH r AS ({ROWS}), l AS (SELECT event_id, direction, hit, 'rsi' AS feature, {_BUCKET.format(35, 65)} AS bucket FROM r UNION ALL SELECT event_id, direction, hit, 'adx', {_BUCKET.format(20, 30)} FROM r),
c AS (SELECT feature, bucket, direction, CASE WHEN count(*) >= 12 AND count(*) FILTER (hit) / count(*) < 0.45 THEN greatest(0.7::DOUBLE, round(count(*) FILTER (hit) / count(*) / 0.5, 2)) ELSE 1.0::DOUBLE END AS factor FROM l GROUP BY ALL),
w AS (SELECT event_id, min(factor) AS factor FROM l JOIN c USING (feature, bucket, direction) GROUP BY event_id) SELECT round(factor, 2) AS factor, count(*) AS decisions FROM w GROUP BY ALL""")
def condition_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir)
    features = {"rsi": F.col("k"), "adx": F.col("k")}
    long = r.select("direction", "hit", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), d.bucket(f, c).alias("bucket")) for f, c in features.items()])).alias("p")).select("direction", "hit", "p.feature", "p.bucket")
    cells = d.factors(long, ["feature", "bucket", "direction"], 12, 0.7)
    return d.worst_factor(r, "event_id", features, cells).groupBy(F.round("factor", 2).alias("factor")).agg(F.count("*").alias("decisions"))


@query("learned_weights", f"""WITH r AS ({ROWS}), s AS (SELECT symbol, count(*) FILTER (abs(tech) > 0.1) AS tn, count(*) FILTER (abs(tech) > 0.1 AND (tech > 0) = hit) AS th, count(*) FILTER (abs(news) > 0.15) AS nn, count(*) FILTER (abs(news) > 0.15 AND (news > 0) = hit) AS nh FROM r GROUP BY symbol),
x AS (SELECT *, least(tn, nn) AS n, greatest(th / tn - 0.5, 0) AS t, greatest(nh / nn - 0.5, 0) AS w FROM s) SELECT symbol, tn, nn, CASE WHEN n >= 20 AND t + w > 0 THEN round(least(0.70::DOUBLE, greatest(0.35::DOUBLE, 0.55::DOUBLE + n / (n + 40) * (t / (t + w) - 0.55::DOUBLE))), 3) ELSE 0.55::DOUBLE END AS tech_weight FROM x""")
def learned_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, n = F.abs("tech") > 0.1, F.abs("news") > 0.15
    s = rows(spark, sf_dir).groupBy("symbol").agg(F.count_if(t).alias("tn"), F.count_if(t & ((F.col("tech") > 0) == F.col("hit"))).alias("th"), F.count_if(n).alias("nn"), F.count_if(n & ((F.col("news") > 0) == F.col("hit"))).alias("nh"))
    return s.select("symbol", "tn", "nn", d.learned_weight(F.col("th"), F.col("tn"), F.col("nh"), F.col("nn")).alias("tech_weight"))


@query("top_candidates", f"""WITH r AS ({ROWS}), n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY abs(tech) DESC, abs(news) DESC, event_id) AS n FROM r) SELECT symbol, event_id, round(tech, 6) AS tech FROM n WHERE n = 1 ORDER BY abs(tech) DESC, abs(news) DESC, event_id LIMIT 3""")
def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.top(rows(spark, sf_dir), "symbol", [F.abs("tech").desc(), F.abs("news").desc(), F.col("event_id").asc()], 3).select("symbol", "event_id", F.round("tech", 6).alias("tech"))


@query("liquidity_status", f"""WITH r AS ({ROWS}), p AS (SELECT symbol, k, count(k) OVER (PARTITION BY symbol ORDER BY k) / count(k) OVER (PARTITION BY symbol) AS p FROM r), s AS (SELECT symbol, CASE WHEN k IS NULL THEN 'unknown' WHEN p >= 0.95 THEN 'stressed' WHEN p >= 0.8 THEN 'thin' ELSE 'normal' END AS status FROM p) SELECT symbol, status, count(*) AS quotes FROM s GROUP BY ALL""")
def liquidity_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.liquidity(rows(spark, sf_dir), ["symbol"], "k").groupBy("symbol", "status").agg(F.count("*").alias("quotes"))


@query("price_checks", f"""WITH b AS ({BARS}), c AS (SELECT *, close = lag(close) OVER (PARTITION BY symbol ORDER BY open_time) AS same FROM b), i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time) - row_number() OVER (PARTITION BY symbol, same ORDER BY open_time) AS g FROM c),
u AS (SELECT symbol, coalesce(max(n), 0) AS n FROM (SELECT symbol, g, count(*) AS n FROM i WHERE same GROUP BY ALL) GROUP BY symbol)
SELECT c.symbol, count(*) AS bars, count(*) FILTER (high < greatest(open, close) OR low > least(open, close)) AS violations, count(*) FILTER (close IS NULL) AS missing, coalesce(any_value(u.n), 0) AS longest_unchanged, count(*) FILTER (high - low > 100) AS wide FROM c LEFT JOIN u USING (symbol) GROUP BY c.symbol""")
def price_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hourly(spark, sf_dir)
    same = F.coalesce(F.col("close") == F.lag("close").over(Window.partitionBy("symbol").orderBy("open_time")), F.lit(False))
    runs = reports.runs(h.withColumn("same", same), ["symbol"], ["open_time"], "same").select("symbol", "longest_run")
    per = h.groupBy("symbol").agg(F.count("*").alias("bars"), F.count_if((F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))).alias("violations"), F.count_if(F.col("close").isNull()).alias("missing"), F.count_if(F.col("high") - F.col("low") > 100).alias("wide"))
    return per.join(runs, "symbol", "left").select("symbol", "bars", "violations", "missing", F.coalesce("longest_run", F.lit(0)).cast("long").alias("longest_unchanged"), "wide")


@query("capture_slots", "WITH s AS (SELECT event_type AS symbol, time_bucket(INTERVAL '5 minutes', ts) AS slot, count(*) AS n FROM events GROUP BY ALL) SELECT symbol, count(*) AS slots, count(*) FILTER (n > 1) AS repeated, sum(n)::BIGINT AS rows FROM s GROUP BY symbol")
def capture_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("symbol"), F.window("ts", "5 minutes").alias("slot")).agg(F.count("*").alias("n"))
    return s.groupBy("symbol").agg(F.count("*").alias("slots"), F.count_if(F.col("n") > 1).alias("repeated"), F.sum("n").alias("rows"))


@query("session_cells", """WITH e AS (SELECT event_type AS symbol, hour(ts) // 8 AS third, value FROM events) SELECT symbol, third::INT AS third, count(*) AS n, count(*) FILTER (value > 50) AS hits, round(stddev_samp(value), 5) AS sd, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90 FROM e GROUP BY ALL""")
def session_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("third", F.floor(F.hour("ts") / 8).cast("int"))
    return e.groupBy(F.col("event_type").alias("symbol"), "third").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("hits"), F.round(F.stddev_samp("value"), 5).alias("sd"), F.round(F.percentile("value", 0.1), 6).alias("p10"), F.round(F.percentile("value", 0.9), 6).alias("p90"))


@query("risk_windows", """WITH e AS (SELECT event_type AS currency, ts - INTERVAL 5 MINUTES AS s, ts + INTERVAL 5 MINUTES AS t FROM events), o AS (SELECT *, max(t) OVER (PARTITION BY currency ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e), g AS (SELECT *, sum((before IS NULL OR s > before)::INT) OVER (PARTITION BY currency ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM o) SELECT currency, min(s) AS start, max(t) AS "end", count(*) AS events FROM g GROUP BY currency, g""")
def risk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    e = e.select(F.col("event_type").alias("currency"), (F.col("ts") - F.expr("interval 5 minutes")).alias("s"), (F.col("ts") + F.expr("interval 5 minutes")).alias("t"))
    w = Window.partitionBy("currency").orderBy("s", "t")
    o = e.withColumn("before", F.max("t").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    g = o.withColumn("g", F.sum((F.col("before").isNull() | (F.col("s") > F.col("before"))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("currency", "g").agg(F.min("s").alias("start"), F.max("t").alias("end"), F.count("*").alias("events")).drop("g")


@query("cost_breakdown", f"WITH t AS ({NET}) SELECT symbol, round(sum(spread_cost) / sum(abs(gross)), 6) AS spread_share, round(sum(slip_cost) / sum(abs(gross)), 6) AS slip_share, round(sum(other_cost) / sum(abs(gross)), 6) AS other_share, round(sum(net) / sum(abs(gross)), 6) AS kept_share FROM t GROUP BY symbol")
def cost_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.sum(F.abs("gross"))
    return trades(spark, sf_dir).groupBy("symbol").agg(*[F.round(F.sum(c) / whole, 6).alias(n) for c, n in (("spread_cost", "spread_share"), ("slip_cost", "slip_share"), ("other_cost", "other_share"), ("net", "kept_share"))])


@query("sized_units", "SELECT o_orderkey, greatest(0, floor(least(o_totalprice * 0.01 / (5 + o_orderkey % 7 + 0.5), (o_totalprice * 20 - 1000) / 150)))::BIGINT AS units FROM orders")
def sized_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = d.units(F.col("o_totalprice"), F.lit(0.01), F.lit(5) + F.col("o_orderkey") % 7, F.lit(0.5), F.lit(20), F.lit(1000), F.lit(150))
    return table(spark, sf_dir, "orders").select("o_orderkey", u.cast("long").alias("units"))


@query("drift_wasserstein", "WITH d AS (SELECT unnest(generate_series(1, len(embedding)))::INT AS dim, unnest(embedding)::DOUBLE AS x, vec_id % 2 AS part FROM embeddings), g AS (SELECT list(k / 20 ORDER BY k) AS g FROM range(21) t(k)), q AS (SELECT dim, quantile_cont(x, [0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1]) FILTER (part = 0) AS a, quantile_cont(x, [0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1]) FILTER (part = 1) AS z FROM d GROUP BY dim) SELECT dim, round(list_avg(list_transform(list_zip(a, z), lambda p: abs(p[1] - p[2]))), 6) AS w1 FROM q")
def drift_wasserstein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.wasserstein(dims(spark, sf_dir), ["dim"], "x", "part")


@query("symbol_entropy", "WITH c AS (SELECT event_type AS symbol, user_id, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT symbol, n / sum(n) OVER (PARTITION BY symbol) AS p FROM c) SELECT symbol, count(*) AS \"values\", round(-sum(p * ln(p)) / ln(count(*)), 6) AS entropy FROM p GROUP BY symbol")
def symbol_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.entropy(table(spark, sf_dir, "events").withColumnRenamed("event_type", "symbol"), ["symbol"], "user_id")


@query("rank_stability", "WITH r AS (SELECT o_orderstatus, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderstatus, o_totalprice) - 1) / 2 AS x, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate) + (count(*) OVER (PARTITION BY o_orderstatus, o_orderdate) - 1) / 2 AS y FROM orders) SELECT o_orderstatus, count(*) AS n, round(corr(x, y), 6) AS spearman FROM r GROUP BY o_orderstatus")
def rank_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.rank_correlation(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_totalprice", "o_orderdate")


@query("log_loss", "WITH s AS (SELECT l.quality AS y, least(greatest(d.n_chars / 20000.0::DOUBLE, 1e-7), 1 - 1e-7) AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id) SELECT 'all' AS model, round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS log_loss, round(sqrt(avg((p - y) ** 2)), 6) AS rmse, round(avg(greatest(0.9 * (y - p), -0.1 * (y - p))), 6) AS pinball_90 FROM s")
def log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, p = F.col("y"), F.least(F.greatest(F.col("p"), F.lit(1e-7)), F.lit(1 - 1e-7))
    return scored(spark, sf_dir).groupBy(F.lit("all").alias("model")).agg(F.round(-F.avg(y * F.ln(p) + (1 - y) * F.ln(1 - p)), 6).alias("log_loss"), F.round(F.sqrt(F.avg((p - y) ** 2)), 6).alias("rmse"), F.round(F.avg(F.greatest(0.9 * (y - p), -0.1 * (y - p))), 6).alias("pinball_90"))


@query("feedback_policy", f"""WITH t AS ({NET}), c AS (SELECT symbol, direction, count(*) AS n, count(*) FILTER (other_cost < 20000000) AS good, avg(net / 1e9::DOUBLE) AS e, avg((net < 0)::INT) AS sl FROM t GROUP BY ALL)
SELECT symbol, direction, n, CASE WHEN n < 8 THEN 'collect' WHEN (n - good) / n >= 0.5 OR good < 8 THEN 'quality_guard' WHEN good >= 20 AND e <= -0.20 AND sl >= 0.45 THEN 'avoid' WHEN e <= 0 OR sl >= 0.45 THEN 'dampen' ELSE 'hold' END AS action FROM c""")
def feedback_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = trades(spark, sf_dir).groupBy("symbol", "direction").agg(F.count("*").alias("n"), F.count_if(F.col("other_cost") < 20000000).alias("good"), F.avg(F.col("net") / 1e9).alias("e"), F.avg((F.col("net") < 0).cast("int")).alias("sl"))
    p = d.policy(F.col("e"), F.col("n"), F.col("good"), F.col("n") - F.col("good"), F.col("sl"), F.lit(0.0), F.lit(1.0))
    return c.select("symbol", "direction", "n", p.alias("action"))


@query("boosted_model")
def boosted_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a boosted classifier, fitted on half of the labelled rows, calibrated on a fifth, on the rest."""
    f = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("chars"), F.coalesce(F.regexp_count("text", F.lit("[0-9]")), F.lit(0)).cast("double").alias("digits"), F.coalesce(F.regexp_count("text", F.lit("\\n")), F.lit(0)).cast("double").alias("lines"))
    df = table(spark, sf_dir, "labels").select("doc_id", "quality").join(f, "doc_id")
    u = F.pmod(F.xxhash64("doc_id"), F.lit(10))
    df = df.withColumn("part", F.when(u < 5, "train").when(u < 7, "calibration").otherwise("test"))
    _, out = d.boosted(df, ["chars", "digits", "lines"], "quality", "part")
    out = d.platt(out, "p", "quality", "part").filter("part = 'test'").withColumn("model", F.lit("boosted"))
    return reports.scores(out, ["model"], "calibrated", "quality").join(stats.auc(out, ["model"], "p", "quality"), "model")


@query("walk_forward_grid")
def walk_forward_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated runs of each stop in each week, the best of a week and how it does in the next: all runs in parallel."""
    s = signals(spark, sf_dir).withColumn("week", F.date_trunc("week", "at").cast("date"))
    runs = s.withColumn("run", F.concat_ws("|", F.col("week").cast("string"), "run")).drop("week")
    t = simulate.simulate(runs).withColumn("week", F.split("run", "\\|")[0].cast("date")).withColumn("variant", F.split("run", "\\|")[1])
    per = t.groupBy("week", "variant").agg(F.round(F.avg("r_multiple"), 6).alias("score"), F.count("*").alias("trades"))
    best = per.withColumn("n", F.row_number().over(Window.partitionBy("week").orderBy(F.col("score").desc(), "variant"))).filter("n = 1")
    after = per.select(F.date_sub("week", 7).alias("week"), "variant", F.col("score").alias("next_score"))
    return best.join(after, ["week", "variant"], "left").select("week", "variant", "score", "trades", "next_score")


@query("cost_stress")
def cost_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The simulation under 1, 2 and 3 times the costs."""
    out = None
    for m in (1.0, 2.0, 3.0):
        t = simulate.simulate(signals(spark, sf_dir), simulate.Settings(cost_factor=m)).groupBy("run").agg(F.count("*").alias("trades"), F.round(F.sum("net_pnl"), 4).alias("pnl")).withColumn("multiple", F.lit(m))
        out = t if out is None else out.unionByName(t)
    return out


@query("market_days", "WITH d AS (SELECT event_type, CAST(timezone('America/New_York', timezone('UTC', ts)) + INTERVAL 7 HOURS AS DATE) AS day, value FROM events) SELECT event_type, count(DISTINCT day) AS days, round(sum(value), 2) AS total FROM d GROUP BY event_type")
def market_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", market.market_day("ts"))
    return e.groupBy("event_type").agg(F.countDistinct("day").alias("days"), F.round(F.sum("value"), 2).alias("total"))
