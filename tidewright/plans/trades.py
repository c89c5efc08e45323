"""Trades, costs, equity and model scores over orders, line items, labels and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.operators import quality, reports, stats, validation
from tidewright.plans.catalog import query
from tidewright.sources.tables import table

# A line item as a trade: the flag's sign, costs from discount and tax, entered with the order and left with the shipment.
# Money is in whole units of 1e-7, so that sums are exact in any order.
TRADES = """
SELECT l_orderkey AS id, l_linenumber AS line, l_returnflag || l_linestatus AS symbol, CASE WHEN l_returnflag = 'R' THEN 'short' ELSE 'long' END AS direction, o_orderdate AS entry_time, l_shipdate AS exit_time,
  l_quantity AS units, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * (round(l_extendedprice * 100)::BIGINT - 4500000) * 1000 AS gross, round(l_extendedprice * 100)::BIGINT * round(l_discount * 100)::BIGINT AS spread_cost,
  round(l_extendedprice * 100)::BIGINT * round(l_tax * 100)::BIGINT AS slip_cost, round(l_quantity)::BIGINT * 1000000 AS other_cost
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""
NET = f"SELECT *, gross - spread_cost - slip_cost - other_cost AS net FROM ({TRADES})"


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    short = F.col("l_returnflag") == "R"
    price, share, tax = (F.round(F.col(c) * 100).cast("long") for c in ("l_extendedprice", "l_discount", "l_tax"))
    money = {"gross": F.when(short, -1).otherwise(1) * (price - 4500000) * 1000, "spread_cost": price * share, "slip_cost": price * tax, "other_cost": F.round("l_quantity").cast("long") * 1000000}
    t = t.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.when(short, "short").otherwise("long").alias("direction"), F.col("o_orderdate").alias("entry_time"), F.col("l_shipdate").alias("exit_time"), F.col("l_quantity").alias("units"), *[c.alias(k) for k, c in money.items()])
    return t.withColumn("net", F.col("gross") - F.col("spread_cost") - F.col("slip_cost") - F.col("other_cost"))


_SUMS = """count(*) AS trades, count(*) FILTER (net > 0) AS wins, sum(net)::{0} AS net, sum(CASE WHEN net > 0 THEN net ELSE 0 END)::DOUBLE AS gross_win, sum(CASE WHEN net < 0 THEN -net ELSE 0 END)::DOUBLE AS gross_loss,
  round(avg((net > 0)::INT), 6) AS win_rate, round(avg(net), 4) AS expectancy, max(net)::{0} AS largest_win, (-min(net))::{0} AS largest_loss"""
_EXACT = _SUMS.format("BIGINT")
_PF = "round(CASE WHEN gross_loss > 0 THEN gross_win / gross_loss WHEN gross_win > 0 THEN 'inf'::DOUBLE ELSE 0 END, 4) AS profit_factor"


@query("pair_performance", f"WITH t AS ({NET}), p AS (SELECT symbol, direction, {_EXACT} FROM t GROUP BY ALL) SELECT *, {_PF} FROM p")
def pair_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.performance(trades(spark, sf_dir), ["symbol", "direction"])


@query("period_performance", f"""WITH t AS ({NET}), g AS (SELECT 'year' AS grain, date_trunc('year', exit_time)::DATE AS period, net FROM t UNION ALL SELECT 'quarter', date_trunc('quarter', exit_time)::DATE, net FROM t UNION ALL SELECT 'month', date_trunc('month', exit_time)::DATE, net FROM t),
p AS (SELECT grain, period, {_EXACT} FROM g GROUP BY ALL) SELECT *, {_PF} FROM p""")
def period_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.periods(trades(spark, sf_dir), "exit_time")


@query("pnl_grouping_sets", f"""WITH t AS ({NET}) SELECT symbol, direction, hour(exit_time)::INT AS hour, grouping(symbol, direction, hour(exit_time))::BIGINT AS level, count(*) AS trades, sum(gross)::BIGINT AS gross, sum(spread_cost)::BIGINT AS spread_cost, sum(slip_cost)::BIGINT AS slip_cost, sum(other_cost)::BIGINT AS other_cost, sum(net)::BIGINT AS net
FROM t GROUP BY GROUPING SETS ((), (symbol), (direction), (hour(exit_time)), (symbol, direction))""")
def pnl_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).withColumn("hour", F.hour("exit_time"))
    s, d, h = F.col("symbol"), F.col("direction"), F.col("hour")
    money = [F.sum(c).alias(c) for c in ("gross", "spread_cost", "slip_cost", "other_cost", "net")]
    return t.groupingSets([[], [s], [d], [h], [s, d]], s, d, h).agg(F.grouping_id().alias("level"), F.count("*").alias("trades"), *money).select("symbol", "direction", "hour", "level", "trades", "gross", "spread_cost", "slip_cost", "other_cost", "net")


@query("usable_segments", f"WITH t AS ({NET}) SELECT 'symbol' AS kind, symbol AS segment, count(*) AS trades, sum(net)::BIGINT AS net, sum(net) > 0 AND count(*) >= 2 AS keep FROM t GROUP BY symbol UNION ALL SELECT 'direction', direction, count(*), sum(net)::BIGINT, sum(net) > 0 AND count(*) >= 2 FROM t GROUP BY direction")
def usable_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("segment")) for k in ("symbol", "direction")]))
    g = trades(spark, sf_dir).select("net", each.alias("g")).groupBy("g.kind", "g.segment")
    return g.agg(F.count("*").alias("trades"), F.sum("net").alias("net"), ((F.sum("net") > 0) & (F.count("*") >= 2)).alias("keep"))


@query("cost_sensitivity", f"""WITH t AS ({TRADES}), g AS (SELECT a.a AS spread_multiple, b.b AS slip_multiple, gross - spread_cost * a.a - slip_cost * b.b - other_cost AS net FROM t, (VALUES (1.0::DOUBLE), (2.0), (3.0)) a(a), (VALUES (1.0::DOUBLE), (2.0), (3.0)) b(b)),
p AS (SELECT spread_multiple, slip_multiple, {_SUMS.format('DOUBLE')} FROM g GROUP BY ALL) SELECT spread_multiple, slip_multiple, trades, net, win_rate, {_PF} FROM p""")
def cost_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.costs_grid(trades(spark, sf_dir), [1.0, 2.0, 3.0], [1.0, 2.0, 3.0])


@query("monthly_targets", f"WITH t AS ({NET}), m AS (SELECT date_trunc('month', exit_time)::DATE AS month, sum(net)::BIGINT AS net FROM t GROUP BY 1) SELECT month, net, net >= 500000000000 AS met, greatest(500000000000 - net, 0) AS shortfall, greatest(net - 500000000000, 0) AS surplus FROM m")
def monthly_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    goal = 500_000_000_000
    m = trades(spark, sf_dir).groupBy(F.date_trunc("month", "exit_time").cast("date").alias("month")).agg(F.sum("net").alias("net"))
    return m.select("month", "net", (F.col("net") >= goal).alias("met"), F.greatest(goal - F.col("net"), F.lit(0)).alias("shortfall"), F.greatest(F.col("net") - goal, F.lit(0)).alias("surplus"))


_EQUITY = f"WITH t AS ({NET}), d AS (SELECT symbol, exit_time::DATE AS day, sum(net)::BIGINT AS net FROM t GROUP BY ALL), e AS (SELECT symbol, day, (10000000000000 + sum(net) OVER (PARTITION BY symbol ORDER BY day))::BIGINT AS equity FROM d)"


def equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = trades(spark, sf_dir).groupBy("symbol", F.to_date("exit_time").alias("day")).agg(F.sum("net").alias("net"))
    return d.select("symbol", "day", (10_000_000_000_000 + F.sum("net").over(Window.partitionBy("symbol").orderBy("day"))).alias("equity"))


@query("drawdown_periods", _EQUITY + """, p AS (SELECT *, max(equity) OVER w AS peak, lead(day) OVER w AS next_day FROM e WINDOW w AS (PARTITION BY symbol ORDER BY day)),
q AS (SELECT *, equity < peak AS under, sum((equity >= peak)::INT) OVER (PARTITION BY symbol ORDER BY day) AS episode FROM p)
SELECT symbol, max(peak) AS peak, min(day) AS start, arg_min(day, ((equity - peak) / peak, day)) AS valley, max(day) AS last, arg_max_null(next_day, day) AS recovery, count(*) AS points, round(-min((equity - peak) / peak), 8) AS depth FROM q WHERE under GROUP BY symbol, episode""")
def drawdown_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.drawdowns(equity(spark, sf_dir), ["symbol"], "day", "equity")


@query("loss_streaks", f"""WITH t AS ({NET}), n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY exit_time, id, line) AS n FROM t), i AS (SELECT symbol, n - row_number() OVER (PARTITION BY symbol ORDER BY exit_time, id, line) AS i FROM n WHERE net < 0),
r AS (SELECT symbol, i, count(*) AS length FROM i GROUP BY ALL) SELECT symbol, max(length) AS longest_run, count(*) AS runs FROM r GROUP BY symbol""")
def loss_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.runs(trades(spark, sf_dir).withColumn("lost", F.col("net") < 0), ["symbol"], ["exit_time", "id", "line"], "lost")


@query("lot_control", f"WITH t AS ({NET}) SELECT symbol, round(avg(units), 6) AS mean_units, max(units) AS most_units, min(units) AS least_units, round(stddev_pop(units), 6) AS sd_units, count(DISTINCT units) AS distinct_units FROM t GROUP BY symbol")
def lot_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = "units"
    return trades(spark, sf_dir).groupBy("symbol").agg(F.round(F.avg(u), 6).alias("mean_units"), F.max(u).alias("most_units"), F.min(u).alias("least_units"), F.round(F.stddev_pop(u), 6).alias("sd_units"), F.countDistinct(u).alias("distinct_units"))


@query("out_of_sample", f"""WITH t AS ({NET}), n AS (SELECT *, row_number() OVER (ORDER BY exit_time, id, line) - 1 AS pos, count(*) OVER () AS total FROM t), p AS (SELECT CASE WHEN pos < floor(total * 0.7) THEN 'in_sample' ELSE 'out_of_sample' END AS part, net FROM n),
q AS (SELECT part, {_EXACT} FROM p GROUP BY part) SELECT *, {_PF} FROM q""")
def out_of_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    t = validation.numbered(t, ["exit_time", "id", "line"]).withColumn("total", F.lit(t.count()))
    return reports.performance(t.withColumn("part", F.when(F.col("pos") < F.floor(F.col("total") * 0.7), "in_sample").otherwise("out_of_sample")), ["part"])


_SCORE = "SELECT l.doc_id, d.source, l.quality AS y, least(greatest(d.n_chars / 20000.0::DOUBLE, 0.0), 1.0) AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")).join(d, "doc_id").withColumn("p", F.least(F.greatest(F.col("n_chars") / 20000.0, F.lit(0.0)), F.lit(1.0))).drop("n_chars")


@query("calibration_bins", f"WITH s AS ({_SCORE}) SELECT y % 1 AS k, least(floor(p * 10), 9)::INT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate, round(abs(avg(p) - avg(y)), 6) AS gap FROM s GROUP BY ALL")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.calibration(scored(spark, sf_dir).withColumn("k", F.col("y") % 1), ["k"], "p", "y", 10)


@query("model_scores", f"""WITH s AS ({_SCORE}), b AS (SELECT 'all' AS model, least(floor(p * 10), 9)::INT AS bin, count(*) AS n, sum(p) AS sp, sum(y) AS sy, sum((p - y) ** 2) AS sq FROM s GROUP BY ALL)
SELECT model, sum(n)::BIGINT AS n, round(sum(sq) / sum(n), 6) AS brier, round(sum(sy) / sum(n) * (1 - sum(sy) / sum(n)), 6) AS brier_base, round(sum(abs(sp - sy)) / sum(n), 6) AS ece, round(max(abs(sp - sy) / n), 6) AS mce FROM b GROUP BY model""")
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scores(scored(spark, sf_dir).withColumn("model", F.lit("all")), ["model"], "p", "y")


@query("auc", f"WITH s AS ({_SCORE}), a AS (SELECT p FROM s WHERE y = 1), b AS (SELECT p FROM s WHERE y = 0) SELECT 'all' AS model, (SELECT count(*) FROM a) AS positives, (SELECT count(*) FROM b) AS negatives, round(avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END), 6) AS auc FROM a, b")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.auc(scored(spark, sf_dir).withColumn("model", F.lit("all")), ["model"], "p", "y")


_DIM = "SELECT unnest(generate_series(1, len(embedding)))::INT AS dim, unnest(embedding)::DOUBLE AS x, (vec_id % 2)::INT AS part FROM embeddings"


def dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 2).cast("int").alias("part"), F.posexplode("embedding").alias("dim", "x")).select((F.col("dim") + 1).alias("dim"), F.col("x").cast("double").alias("x"), "part")


@query("drift_ks", f"""WITH d AS ({_DIM}), c AS (SELECT dim, x, sum((part = 0)::INT) OVER w / sum((part = 0)::INT) OVER a AS f, sum((part = 1)::INT) OVER w / sum((part = 1)::INT) OVER a AS g FROM d WINDOW w AS (PARTITION BY dim ORDER BY x), a AS (PARTITION BY dim)) SELECT dim, round(max(abs(f - g)), 6) AS ks FROM c GROUP BY dim""")
def drift_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ks(dims(spark, sf_dir), ["dim"], "x", "part")


@query("drift_psi", f"""WITH d AS ({_DIM}), c AS (SELECT dim, list_distinct(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS cuts FROM d WHERE part = 0 GROUP BY dim), b AS (SELECT dim, part, len(list_filter(cuts, lambda c: c <= x)) AS bin FROM d JOIN c USING (dim)),
s AS (SELECT dim, bin, count(*) FILTER (part = 0) AS a, count(*) FILTER (part = 1) AS z FROM b GROUP BY ALL), p AS (SELECT dim, greatest(a / sum(a) OVER w, 1e-6) AS a, greatest(z / sum(z) OVER w, 1e-6) AS z FROM s WINDOW w AS (PARTITION BY dim)) SELECT dim, round(sum((z - a) * ln(z / a)), 6) AS psi, count(*) AS bins FROM p GROUP BY dim""")
def drift_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.psi(dims(spark, sf_dir), ["dim"], "x", "part")


_WIN = f"WITH t AS ({NET}), w AS (SELECT symbol, count(*) AS n, count(*) FILTER (net > 0) AS k FROM t GROUP BY symbol)"


@query("wilson", _WIN + ", z AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM w) SELECT symbol, n, k, round(greatest(((p + z * z / (2 * n)) / (1 + z * z / n)) - z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 0), 6) AS low, round(least(((p + z * z / (2 * n)) / (1 + z * z / n)) + z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1), 6) AS high FROM z")
def wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = trades(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("net") > 0).alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n").cast("double"))
    return w.select("symbol", "n", "k", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("holm", _WIN + ", p AS (SELECT symbol, k / n AS p FROM w), a AS (SELECT symbol, p, (count(*) OVER () - row_number() OVER (ORDER BY p, symbol) + 1) * p AS a FROM p) SELECT symbol, round(p, 6) AS p, round(least(1.0, max(a) OVER (ORDER BY p, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS holm FROM a")
def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = trades(spark, sf_dir).groupBy("symbol").agg((F.count_if(F.col("net") > 0) / F.count("*")).alias("p"))
    return stats.holm(w, "p", "symbol").select("symbol", F.round("p", 6).alias("p"), F.round("holm", 6).alias("holm"))


@query("sharpe", f"""WITH t AS ({NET}), m AS (SELECT symbol, count(*)::DOUBLE AS n, avg(net) / stddev_samp(net) AS sr, skewness(net) AS g, kurtosis(net) + 3 AS k FROM t GROUP BY symbol)
SELECT symbol, n::BIGINT AS n, round(sr, 6) AS sharpe, round(g, 5) AS skew, round(k, 4) AS kurtosis, round(sr * sqrt(n - 1) / sqrt(1 - g * sr + (k - 1) / 4 * sr * sr), 5) AS psr_z FROM m""")
def sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.sharpe(trades(spark, sf_dir), ["symbol"], "net")


@query("deflated_sharpe")
def deflated_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.deflated(trades(spark, sf_dir), ["symbol"], "net")


@query("backtest_overfitting")
def backtest_overfitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").withColumn("ts", F.date_trunc("month", "l_shipdate")).groupBy("ts", F.col("l_linenumber").alias("trial_id")).agg(F.avg(F.col("l_extendedprice") - 45000).alias("ret"))
    return stats.overfitting(e, 8)


@query("bootstrap_mean")
def bootstrap_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).groupBy("symbol", F.date_trunc("month", "exit_time").alias("pos")).agg(F.sum("net").alias("net"))
    return stats.bootstrap(t, ["symbol"], "net")


@query("monte_carlo")
def monte_carlo(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = trades(spark, sf_dir).groupBy(F.to_date("exit_time").alias("day")).agg(F.sum("net").alias("net"))
    return stats.monte_carlo(d, "net", ["day"], 100)


_POS = "WITH o AS (SELECT o_orderkey AS id, o_orderdate AS prediction_time, o_orderdate + INTERVAL 5 DAYS AS label_end_time, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, count(*) OVER () AS total FROM orders)"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("prediction_time"), (F.col("o_orderdate") + F.expr("interval 5 days")).alias("label_end_time"))
    return validation.positions(o, "prediction_time", "id")


@query("walk_forward_folds", _POS + """, n AS (SELECT max(total) AS n FROM o), f AS (SELECT unnest(generate_series(0, (SELECT (n - 3000) // 1000 FROM n)))::INT AS fold), b AS (SELECT fold, fold * 1000 AS a, fold * 1000 + 2000 AS b, fold * 1000 + 3000 AS c FROM f WHERE fold * 1000 + 3000 <= (SELECT n FROM n)),
s AS (SELECT b.*, o.prediction_time AS test_start FROM b JOIN o ON o.pos = b.b), r AS (SELECT s.fold, CASE WHEN o.pos >= s.b THEN 'test' ELSE 'train' END AS part, o.* FROM o JOIN s ON o.pos >= s.a AND o.pos < s.c WHERE o.pos >= s.b OR (o.label_end_time < s.test_start - INTERVAL 1 DAYS AND o.prediction_time < s.test_start - INTERVAL 3 DAYS))
SELECT fold, part, count(*) AS rows, min(prediction_time) AS first_time, max(label_end_time) AS last_label FROM r GROUP BY ALL""")
def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = validation.walk_forward(labelled(spark, sf_dir), 2000, 1000, 1000, "1 days", "3 days")
    return f.groupBy("fold", "part").agg(F.count("*").alias("rows"), F.min("prediction_time").alias("first_time"), F.max("label_end_time").alias("last_label"))


@query("combinatorial_folds")
def combinatorial_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = validation.combinatorial(labelled(spark, sf_dir), 6, 2, "10 days")
    return f.groupBy("split", "part").agg(F.count("*").alias("rows"), F.min("prediction_time").alias("first_time"))


@query("chronological_parts", _POS + """, p AS (SELECT *, CASE WHEN pos >= floor(total * 0.9) THEN 5 WHEN pos >= floor(total * 0.75) THEN 4 WHEN pos >= floor(total * 0.65) THEN 3 WHEN pos >= floor(total * 0.5) THEN 2 ELSE 1 END AS k FROM o),
f AS (SELECT k - 1 AS k, min(prediction_time) AS next_start FROM p GROUP BY k) SELECT ['train', 'tune', 'calibration', 'test', 'lockbox'][p.k] AS part, count(*) AS rows, max(label_end_time) AS last_label FROM p LEFT JOIN f USING (k) WHERE next_start IS NULL OR label_end_time < next_start GROUP BY p.k""")
def chronological_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = validation.chronological(labelled(spark, sf_dir), {"train": 0.5, "tune": 0.15, "calibration": 0.1, "test": 0.15, "lockbox": 0.1})
    return p.groupBy("part").agg(F.count("*").alias("rows"), F.max("label_end_time").alias("last_label"))


@query("key_conflicts", """WITH k AS (SELECT l_partkey, l_suppkey, count(*) AS rows, count(DISTINCT (l_quantity, l_tax)) AS payloads FROM lineitem GROUP BY ALL HAVING count(*) > 1) SELECT *, CASE WHEN payloads > 1 THEN 'conflict' ELSE 'replay' END AS kind FROM k""")
def key_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.conflicts(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], ["l_quantity", "l_tax"])


@query("repair_verdicts", """WITH v AS (SELECT l_quantity, row_number() OVER w AS n, first_value(l_quantity) OVER w AS q FROM lineitem WINDOW w AS (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber))
SELECT CASE WHEN n = 1 THEN 'kept' WHEN l_quantity = q THEN 'exact_duplicate' ELSE 'conflicting_duplicate' END AS verdict, count(*) AS rows FROM v GROUP BY 1""")
def repair_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity")  # noqa: E741
    return quality.repaired(l, ["l_partkey", "l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"]).groupBy("verdict").agg(F.count("*").alias("rows"))


@query("parity", """WITH a AS (SELECT o_custkey, o_orderstatus FROM orders), b AS (SELECT o_custkey, CASE WHEN o_totalprice > 400000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders), u AS (SELECT *, 'left_only' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right_only' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
SELECT *, count(*) AS times FROM u GROUP BY ALL""")
def parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    changed = F.when(F.col("o_totalprice") > 400000, "X").otherwise(F.col("o_orderstatus"))
    return quality.parity(o.select("o_custkey", "o_orderstatus"), o.select("o_custkey", changed.alias("o_orderstatus")))
