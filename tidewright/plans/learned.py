"""Learned cells, policies, plans, votes, costs and gaps over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions.market import rounded
from tidewright.operators import learned, validation
from tidewright.plans.catalog import query
from tidewright.plans.market import _PATH, decisions, touches
from tidewright.plans.trades import NET, trades
from tidewright.sources.tables import table


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with a result in units of risk and a conviction."""
    return trades(spark, sf_dir).select("symbol", "direction", "exit_time", "id", "line", (F.col("net") / 1e9).alias("r"), ((F.col("id") * 7 + F.col("line") * 13) % 101).alias("conviction"))


_R = f"s AS (SELECT symbol, direction, exit_time, id, line, net / 1e9::DOUBLE AS r, (id * 7 + line * 13) % 101 AS conviction FROM ({NET}))"
_CELLS = f"""{_R}, q AS (SELECT *, conviction / 100 AS p, CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, count(*) OVER k AS n, row_number() OVER o AS k, sum(r) OVER o AS cum, row_number() OVER (PARTITION BY symbol, direction ORDER BY r, exit_time, id, line) AS low FROM s WINDOW k AS (PARTITION BY symbol, direction), o AS (PARTITION BY symbol, direction ORDER BY exit_time, id, line)),
t AS (SELECT *, greatest(max(cum) OVER (PARTITION BY symbol, direction ORDER BY exit_time, id, line ROWS UNBOUNDED PRECEDING), 0) - cum AS fall FROM q),
c AS (SELECT symbol, direction, count(*) AS n, avg(r) AS e, sum(r) AS total, avg(r) FILTER (r > 0) AS win, avg(r) FILTER (r < 0) AS loss, sum(greatest(r, 0)) AS gain, sum(greatest(-r, 0)) AS cost, avg((r > 0)::INT) AS wr, max(fall) AS dd, sqrt(avg(least(r, 0) ** 2)) AS down, abs(avg(r) FILTER (low <= greatest(ceil(n * 0.1), 1))) AS tail,
  avg(r) FILTER (k <= floor(n / 2)) AS f, avg(r) FILTER (k > floor(n / 2)) AS g, avg((p - y) ** 2) AS brier, avg(y) AS base, (abs(coalesce(sum(p - y) FILTER (p < 0.2), 0)) + abs(coalesce(sum(p - y) FILTER (p >= 0.2 AND p < 0.4), 0)) + abs(coalesce(sum(p - y) FILTER (p >= 0.4 AND p < 0.6), 0)) + abs(coalesce(sum(p - y) FILTER (p >= 0.6 AND p < 0.8), 0)) + abs(coalesce(sum(p - y) FILTER (p >= 0.8), 0))) / count(*) AS ece FROM t GROUP BY ALL),
m AS (SELECT symbol, direction, n, round(e, 4) AS expectancy_r, round(CASE WHEN cost > 0 THEN gain / cost WHEN gain > 0 THEN 'inf'::DOUBLE END, 4) AS profit_factor, round(wr, 4) AS win_rate, round(CASE WHEN loss < 0 THEN abs(win / loss) WHEN win > 0 THEN 'inf'::DOUBLE END, 4) AS payoff_ratio, round(dd, 4) AS max_drawdown_r, round(CASE WHEN dd > 0 THEN total / dd WHEN total > 0 THEN 'inf'::DOUBLE ELSE 0 END, 4) AS recovery_factor,
  round(down, 4) AS downside_deviation_r, round(CASE WHEN down > 0 THEN e / down WHEN e > 0 THEN 'inf'::DOUBLE ELSE 0 END, 4) AS sortino_r, round(tail, 4) AS tail_loss_r, round(CASE WHEN n >= 30 THEN greatest(0, least(1, 1 - abs(f - g) / greatest(abs(e), 0.25) - CASE WHEN f * g < 0 THEN 0.25 ELSE 0 END)) END, 4) AS stability,
  round(brier, 4) AS brier, round(base * (1 - base), 4) AS brier_base, round(ece, 4) AS calibration_error, round(CASE WHEN base * (1 - base) = 0 THEN CASE WHEN brier = 0 THEN 1 ELSE -1 END ELSE 1 - brier / (base * (1 - base)) END, 4) AS brier_skill, round(least(1, sqrt(n / 100)), 4) AS confidence FROM c)"""


@query("cell_metrics", f"WITH {_CELLS} SELECT * FROM m")
def cell_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned.cell_metrics(scored(spark, sf_dir), ["symbol", "direction"], ["exit_time", "id", "line"], "r", "conviction")


@query("cell_policies", f"""WITH {_CELLS}, p AS (SELECT *, round(greatest(-2, least(2, expectancy_r)) + CASE WHEN profit_factor IS NULL THEN 0 WHEN profit_factor >= 1 THEN least(0.30, (profit_factor - 1) * 0.20) ELSE -least(0.30, (1 - profit_factor) * 0.35) END + (win_rate - 0.5) * 0.30 + greatest(-0.25, least(0.25, sortino_r * 0.08)) + greatest(-0.20, least(0.20, (recovery_factor - 1) * 0.08)) + coalesce((stability - 0.5) * 0.20, -0.05) + greatest(-0.20, least(0.20, brier_skill * 0.20))
  - (greatest(0, brier - brier_base) * 0.5 + greatest(0, calibration_error - 0.10) * 0.40 + least(0.50, greatest(0, max_drawdown_r - 3) * 0.05) + least(0.35, greatest(0, tail_loss_r - 1) * 0.10) + (1 - confidence) * 0.20 + CASE WHEN n >= 30 THEN 0 ELSE 0.15 END), 4) AS score FROM m),
a AS (SELECT *, CASE WHEN n < 30 THEN 'collect_samples' WHEN expectancy_r <= 0 THEN 'avoid' WHEN coalesce(profit_factor < 1.05, false) OR coalesce(stability < 0.55, false) OR calibration_error > 0.25 OR sortino_r < 0.10 OR (max_drawdown_r > 0 AND recovery_factor < 0.5) THEN 'dampen' WHEN n >= 100 AND expectancy_r >= 0.10 AND coalesce(profit_factor >= 1.20, true) AND brier <= brier_base AND score >= 0.25 THEN 'boost' ELSE 'hold' END AS action FROM p)
SELECT symbol, direction, round(score, 3) AS score, action, CASE action WHEN 'avoid' THEN 0.45::DOUBLE WHEN 'dampen' THEN 0.75::DOUBLE WHEN 'boost' THEN least(1.10::DOUBLE, round(1 + least(0.10, score * 0.08), 2)) ELSE 1.0::DOUBLE END AS factor FROM a""")
def cell_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = cell_metrics(spark, sf_dir).withColumn("score", learned.cell_score())
    action, factor = learned.cell_policy(F.col("score"))
    return m.select("symbol", "direction", F.round("score", 3).alias("score"), action.alias("action"), factor.alias("factor"))


@query("touch_factors", f"WITH {_R}, c AS (SELECT symbol, direction, count(*) AS n, count(*) FILTER (r > 0) AS hits FROM s GROUP BY ALL) SELECT *, CASE WHEN n < 30 OR (hits / n >= 0.45 AND hits / n < 0.60) THEN 1.0::DOUBLE ELSE round(1 + least(1, n / 100) * (CASE WHEN hits / n < 0.45 THEN greatest(0.70, hits / n / 0.5) ELSE least(1.10, 1 + (hits / n - 0.5) * 0.5) END - 1), 2) END AS factor FROM c")
def touch_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = scored(spark, sf_dir).groupBy("symbol", "direction").agg(F.count("*").alias("n"), F.count_if(F.col("r") > 0).alias("hits"))
    return c.withColumn("factor", learned.confidence_factor(F.col("n"), F.col("hits")))


@query("member_significance")
def member_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each symbol and the chance of as many by luck."""
    c = scored(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("r") > 0).alias("hits"))
    return c.withColumn("p_value", F.round(learned.binomial_p(F.col("hits"), F.col("n")), 9))


@query("thresholds", """WITH o AS (SELECT o_orderkey, o_orderdate AS ts, (o_totalprice / 250000 - 1) AS score, (o_custkey % 21 - 10) / 10.0::DOUBLE AS r, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, count(*) OVER () AS total FROM orders),
p AS (SELECT *, CASE WHEN pos >= greatest(floor(total * 0.8), floor(total * 0.6) + 1) THEN 'test' WHEN pos >= greatest(floor(total * 0.6), 1) THEN 'tune' END AS part FROM o), c AS (SELECT ts AS test_start FROM o WHERE pos = greatest(floor(total * 0.8), floor(total * 0.6) + 1)),
e AS (SELECT p.*, t AS threshold FROM p, c, (VALUES (0.15::DOUBLE), (0.20), (0.25), (0.30)) v(t) WHERE part IS NOT NULL AND (part = 'test' OR ts < test_start - INTERVAL 72 HOURS) AND abs(score) >= t)
SELECT threshold, part, count(*) AS n, round(avg(r), 6) AS mean, round(CASE WHEN count(*) >= 2 THEN avg(r) - 1.645 * sqrt(var_samp(r) / count(*)) END, 6) AS lcb FROM e GROUP BY ALL""")
def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"), (F.col("o_totalprice") / 250000 - 1).alias("score"), ((F.col("o_custkey") % 21 - 10) / 10.0).alias("r"))
    return learned.threshold_table(validation.positions(o, "ts", "o_orderkey"), [0.15, 0.20, 0.25, 0.30], 72)


_POLICIES = [("a", "overall", "", 5), ("b", "by_symbol", "AF", 3), ("c", "by_symbol_direction", "RF:short", 2), ("d", "by_direction", "long", 1), ("e", "by_symbol_direction", "RF:short", 1), ("f", "by_confidence", "75-100", 1)]
_CONF = "CASE WHEN conviction < 25 THEN '0-25' WHEN conviction < 50 THEN '25-50' WHEN conviction < 75 THEN '50-75' ELSE '75-100' END"


@query("policy_matches", f"""WITH {_R}, d AS (SELECT symbol, direction, {_CONF} AS confidence, count(*) AS decisions FROM s GROUP BY ALL), p(policy_id, scope, key, approved_at) AS (VALUES {', '.join(map(str, _POLICIES))}),
m AS (SELECT d.*, policy_id, row_number() OVER (PARTITION BY symbol, direction, confidence ORDER BY CASE scope WHEN 'by_symbol_direction' THEN 1 WHEN 'by_symbol' THEN 2 WHEN 'by_direction' THEN 3 WHEN 'by_confidence' THEN 4 ELSE 5 END, approved_at, policy_id) AS k FROM d JOIN p ON key = CASE scope WHEN 'by_symbol_direction' THEN symbol || ':' || direction WHEN 'by_symbol' THEN symbol WHEN 'by_direction' THEN direction WHEN 'by_confidence' THEN confidence ELSE '' END)
SELECT symbol, direction, confidence, decisions, policy_id FROM m WHERE k = 1""")
def policy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conviction")
    conf = F.when(c < 25, "0-25").when(c < 50, "25-50").when(c < 75, "50-75").otherwise("75-100")
    d = scored(spark, sf_dir).groupBy("symbol", "direction", conf.alias("confidence")).agg(F.count("*").alias("decisions"))
    d = d.withColumn("decision_id", F.concat_ws("|", "symbol", "direction", "confidence"))
    p = spark.createDataFrame(_POLICIES, "policy_id string, scope string, key string, approved_at int")
    return learned.matching_policy(d, p).drop("decision_id")


_VIEWS = "v AS (SELECT l_orderkey, CASE l_linenumber WHEN 1 THEN '15m' WHEN 2 THEN '1h' WHEN 3 THEN '4h' WHEN 4 THEN '1d' ELSE '1w' || l_linenumber END AS interval, CASE WHEN l_quantity > 42 THEN 1.0::DOUBLE WHEN l_quantity > 30 THEN 0.5::DOUBLE WHEN l_quantity > 20 THEN 0.0::DOUBLE WHEN l_quantity > 8 THEN -0.5::DOUBLE ELSE -1.0::DOUBLE END AS rating FROM lineitem), w AS (SELECT *, CASE interval WHEN '15m' THEN 0.15::DOUBLE WHEN '1h' THEN 0.30::DOUBLE WHEN '4h' THEN 0.30::DOUBLE WHEN '1d' THEN 0.25::DOUBLE ELSE 0.1::DOUBLE END AS w FROM v), a AS (SELECT l_orderkey, round(sum(rating * w) / sum(w), 3) AS alignment, round(sum(CASE WHEN interval NOT LIKE '1w%' THEN w ELSE 0 END) / 1.0, 3) AS coverage, count(*) FILTER (rating > 0) AS up, count(*) FILTER (rating < 0) AS down, count(*) AS frames FROM w GROUP BY l_orderkey)"


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as views of its frames, in the order of the file, in which SQL adds them with one thread."""
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    frame = F.when(n == 1, "15m").when(n == 2, "1h").when(n == 3, "4h").when(n == 4, "1d").otherwise(F.concat(F.lit("1w"), n.cast("string")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", frame.alias("interval"), F.when(q > 42, 1.0).when(q > 30, 0.5).when(q > 20, 0.0).when(q > 8, -0.5).otherwise(-1.0).alias("rating"), F.col("_metadata.row_index").alias("at"))


@query("alignment", f"WITH {_VIEWS} SELECT l_orderkey, alignment, coverage, frames, round(CASE WHEN alignment > 0 THEN up / frames WHEN alignment < 0 THEN down / frames END, 3) AS agreement FROM a")
def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned.alignment(views(spark, sf_dir), ["l_orderkey"], "at")


_INPUTS = f"""{_VIEWS}, i AS (SELECT o_orderkey, alignment, coverage, (o_custkey % 3 - 1) AS ma, (o_orderkey % 41 - 20) / 20.0::DOUBLE AS news, o_orderkey % 8 AS cnt, o_custkey % 11 <> 0 AS cal, o_custkey % 17 <> 0 AS ok, isodow(o_orderdate) < 6 AS open, o_orderkey % 13 = 0 AS event FROM orders JOIN a ON o_orderkey = l_orderkey),
t AS (SELECT *, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, alignment + 0.15::DOUBLE * ma)) AS tech FROM i), u AS (SELECT *, round(0.55::DOUBLE * tech + 0.45::DOUBLE * news, 3) AS composite, round(0.5::DOUBLE * coverage + 0.3::DOUBLE * least(1.0::DOUBLE, cnt / 5) + 0.2::DOUBLE * cal::INT, 3) AS quality FROM t)"""


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    o = table(spark, sf_dir, "orders").join(alignment(spark, sf_dir).select(c("l_orderkey").alias("o_orderkey"), "alignment", "coverage"), "o_orderkey")
    return o.select("o_orderkey", "alignment", "coverage", (c("o_custkey") % 3 - 1).alias("ma_side"), ((c("o_orderkey") % 41 - 20) / 20.0).alias("news_score"), (c("o_orderkey") % 8).alias("news_count"), (c("o_custkey") % 11 != 0).alias("calendar_ok"), (c("o_custkey") % 17 != 0).alias("data_ok"), (F.weekday("o_orderdate") < 5).alias("market_open"), (c("o_orderkey") % 13 == 0).alias("in_event"))


@query("trade_plans", f"""WITH {_INPUTS}, g AS (SELECT *, CASE WHEN NOT ok THEN 'operational_data_stale' WHEN NOT open THEN 'market_closed' WHEN event THEN 'event_window' WHEN coverage <= 0 THEN 'missing_technical' WHEN quality < 0.4 THEN 'low_data_quality' WHEN abs(composite) < 0.15 THEN 'below_threshold' ELSE 'open' END AS gate FROM u)
SELECT gate, CASE gate WHEN 'market_closed' THEN 'closed' WHEN 'event_window' THEN 'standby' WHEN 'open' THEN CASE WHEN composite > 0 THEN 'long' ELSE 'short' END ELSE 'neutral' END AS direction, count(*) AS plans, round(avg(composite), 4) AS composite, round(avg(quality), 4) AS quality, round(avg(tech), 4) AS tech_score FROM g GROUP BY ALL""")
def trade_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = learned.plan(inputs(spark, sf_dir))
    return p.groupBy("gate", "direction").agg(F.count("*").alias("plans"), rounded(F.avg("composite"), 4).alias("composite"), rounded(F.avg("quality"), 4).alias("quality"), rounded(F.avg("tech_score"), 4).alias("tech_score"))


@query("class_probabilities", f"WITH {_INPUTS}, x AS (SELECT o_orderkey, greatest(0.05::DOUBLE, least(0.90::DOUBLE, 0.375::DOUBLE + 0.25::DOUBLE * composite)) AS up, greatest(0.05::DOUBLE, least(0.90::DOUBLE, 0.375::DOUBLE - 0.25::DOUBLE * composite)) AS down FROM u), y AS (SELECT *, greatest(0.05::DOUBLE, 1 - up - down) AS flat FROM x) SELECT o_orderkey, round(up / (up + down + flat), 6) AS p_up, round(down / (up + down + flat), 6) AS p_down, round(flat / (up + down + flat), 6) AS p_flat FROM y")
def class_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    up, down, flat = learned.class_probabilities(F.col("composite"))
    return learned.plan(inputs(spark, sf_dir)).select("o_orderkey", up.alias("p_up"), down.alias("p_down"), flat.alias("p_flat"))


_DAYS = "d AS (SELECT ts::DATE AS day, avg(value) FILTER (event_type = 'view') AS vix, avg(value) FILTER (event_type = 'click') / 40 AS us10y, avg(value) FILTER (event_type = 'signup') AS usd FROM events GROUP BY 1), l AS (SELECT *, lag(vix, 5) OVER o AS vix0, lag(us10y, 5) OVER o AS us10y0, lag(usd, 5) OVER o AS usd0 FROM d WINDOW o AS (ORDER BY day)), v AS (SELECT *, coalesce(vix >= 25, false)::INT + coalesce((vix - vix0) / abs(vix0) * 100 >= 20, false)::INT + coalesce(us10y - us10y0 <= -0.15, false)::INT + coalesce((usd - usd0) / abs(usd0) * 100 >= 1.5, false)::INT AS off, coalesce(vix <= 15 AND coalesce((vix - vix0) / abs(vix0) * 100, 0) < 20, false)::INT AS \"on\" FROM l), r AS (SELECT day, CASE WHEN off > \"on\" THEN 'risk_off' WHEN \"on\" > off THEN 'risk_on' ELSE 'neutral' END AS regime FROM v)"


@query("macro_regimes", f"WITH {_DAYS} SELECT day, regime FROM r")
def macro_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    mean = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    d = e.groupBy(F.to_date("ts").alias("day")).agg(mean("view").alias("vix"), (mean("click") / 40).alias("us10y"), mean("signup").alias("usd"))
    w = Window.orderBy("day")  # one row a day
    before = [F.lag(c, 5).over(w).alias(f"{c}0") for c in ("vix", "us10y", "usd")]
    d = d.select("*", *before)
    return d.select("day", learned.regime(*[F.col(c) for c in ("vix", "vix0", "us10y", "us10y0", "usd", "usd0")]).alias("regime"))


_SENS = "(VALUES ('JPY', -1.0::DOUBLE), ('CHF', -0.8), ('USD', -0.5), ('EUR', 0.0), ('GBP', 0.3), ('CAD', 0.5), ('AUD', 0.8), ('NZD', 0.8))"


@query("pair_views", f"""WITH {_DAYS}, p(base, quote) AS (VALUES ('EUR', 'USD'), ('USD', 'JPY'), ('AUD', 'CHF'), ('XXX', 'USD')), x AS (SELECT day, regime, p.base, p.quote, CASE WHEN p.base <> 'AUD' THEN ((day - DATE '2024-01-01') % 13) / 20.0::DOUBLE END AS br, ((day - DATE '2024-01-01') % 7) / 20.0::DOUBLE AS qr, (sq.s - sb.s) / 2 AS raw FROM r CROSS JOIN p LEFT JOIN {_SENS} sb(c, s) ON sb.c = p.base LEFT JOIN {_SENS} sq(c, s) ON sq.c = p.quote),
y AS (SELECT *, round(greatest(-1, least(1, (br - qr) * 3)), 3) AS cot, CASE regime WHEN 'risk_off' THEN raw WHEN 'risk_on' THEN -raw END AS f FROM x), z AS (SELECT *, CASE WHEN abs(f) >= 0.05 THEN round(greatest(-1, least(1, f)), 3) END AS fit FROM y), w AS (SELECT *, CASE WHEN cot IS NOT NULL THEN 0.6::DOUBLE ELSE 0 END + CASE WHEN fit IS NOT NULL THEN 0.4::DOUBLE ELSE 0 END AS weight FROM z)
SELECT day, base, quote, round(round(CASE WHEN weight > 0 THEN (coalesce(cot * 0.6::DOUBLE, 0) + coalesce(fit * 0.4::DOUBLE, 0)) / weight ELSE 0 END, 3), 3) AS score, round(weight, 3) AS confidence FROM w""")
def pair_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.explode(F.array(*[F.struct(F.lit(b).alias("base"), F.lit(q).alias("quote")) for b, q in (("EUR", "USD"), ("USD", "JPY"), ("AUD", "CHF"), ("XXX", "USD"))]))
    r = macro_regimes(spark, sf_dir).withColumn("p", p).select("day", "regime", "p.*").withColumn("k", F.datediff("day", F.lit("2024-01-01").cast("date")))
    base = F.when(F.col("base") != "AUD", (F.col("k") % 13) / 20.0)
    score, confidence = learned.macro_view(F.col("base"), F.col("quote"), base, (F.col("k") % 7) / 20.0, F.col("regime"))
    return r.select("day", "base", "quote", score.alias("score"), confidence.alias("confidence"))


@query("failure_reasons", _PATH + """, w2 AS (SELECT *, (hash_k * 7) % 101 AS conviction FROM (SELECT *, points * 13 AS hash_k FROM r)), f2 AS (SELECT symbol, CASE WHEN realized_r > 0 THEN [] ELSE list_filter([CASE WHEN first_touch = 'ambiguous' THEN 'ambiguous_intrabar_touch' END, CASE WHEN first_touch = 'sl' THEN 'sl_first' END, CASE WHEN mae_r >= mfe_r THEN 'adverse_excursion_dominant' END, CASE WHEN mfe_r < 0.5 THEN 'weak_favorable_excursion' END, CASE WHEN realized_r <= 0 AND first_touch NOT IN ('tp1', 'tp2') AND mfe_r >= 0.75 THEN 'tp_too_far' END, CASE WHEN mae_r >= 0.8 THEN 'large_adverse_excursion' END, CASE WHEN conviction >= 75 THEN 'confidence_overreach' END], lambda x: x IS NOT NULL) END AS reasons, realized_r FROM w2),
g2 AS (SELECT symbol, unnest(CASE WHEN realized_r > 0 THEN [] WHEN len(reasons) = 0 THEN ['weak_favorable_excursion'] ELSE reasons END) AS reason FROM f2) SELECT symbol, reason, count(*) AS decisions FROM g2 GROUP BY ALL""")
def failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = touches(spark, sf_dir).join(decisions(spark, sf_dir).select("decision_id", "symbol"), "decision_id").withColumn("conviction", (F.col("points") * 13 * 7) % 101)
    return t.select("symbol", F.explode(learned.failure_reasons()).alias("reason")).groupBy("symbol", "reason").agg(F.count("*").alias("decisions"))


@query("abstentions", """WITH s AS (SELECT event_type, least(value / 120, 1.2) AS p, (event_id % 9 - 3) / 10.0::DOUBLE AS r, user_id % 5 AS k, event_id % 31 = 0 AS dv, event_id % 37 = 0 AS rv, event_id % 19 <> 0 AS cal FROM events), b AS (SELECT *, CASE WHEN k = 0 THEN NULL ELSE p - 0.02 * k END AS lo, p + 0.045 * k AS hi, CASE WHEN k = 4 THEN NULL ELSE k * 0.07 END AS dis FROM s),
a AS (SELECT event_type, CASE WHEN p IS NULL OR NOT p BETWEEN 0 AND 1 THEN 'invalid_probability' WHEN dv THEN 'data_quality_veto' WHEN rv THEN 'risk_veto' WHEN NOT cal THEN 'uncalibrated_probability' WHEN lo IS NULL OR hi IS NULL THEN 'uncertainty_unavailable' WHEN lo < 0 OR lo > hi OR hi > 1 THEN 'invalid_uncertainty_interval' WHEN p < lo OR p > hi THEN 'probability_outside_uncertainty_interval' WHEN hi - lo > 0.30 THEN 'uncertainty_too_wide' WHEN dis < 0 THEN 'invalid_model_disagreement' WHEN dis > 0.20 THEN 'model_disagreement' WHEN r IS NULL THEN 'net_expectancy_unavailable' WHEN r <= 0 THEN 'non_positive_net_expectancy' WHEN p >= 0.60 THEN 'long' WHEN p <= 0.40 THEN 'short' ELSE 'probability_in_no_trade_band' END AS verdict FROM b)
SELECT event_type, verdict, count(*) AS decisions FROM a GROUP BY ALL""")
def abstentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = F.col, F.col("user_id") % 5
    p = F.least(c("value") / 120, F.lit(1.2))
    v = learned.abstention(p, (c("event_id") % 9 - 3) / 10.0, F.when(k != 0, p - 0.02 * k), p + 0.045 * k, F.when(k != 4, k * 0.07), c("event_id") % 19 != 0, c("event_id") % 31 == 0, c("event_id") % 37 == 0)
    return table(spark, sf_dir, "events").groupBy("event_type", v.alias("verdict")).agg(F.count("*").alias("decisions"))


@query("promotion_gates", f"WITH t AS ({NET}), e AS (SELECT symbol, count(*) AS samples, avg(net) AS e, CASE WHEN symbol <> 'NO' THEN count(DISTINCT direction) END AS regimes FROM t GROUP BY symbol), g AS (SELECT symbol, unnest([{{'gate': 'sample_size', 'passed': samples >= 200}}, {{'gate': 'net_expectancy', 'passed': e > 0}}, {{'gate': 'regimes', 'passed': coalesce(regimes >= 1, false)}}]) AS g FROM e) SELECT symbol, g.gate AS gate, g.passed AS passed FROM g")
def promotion_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = trades(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("samples"), F.avg("net").alias("e"), F.countDistinct("direction").alias("n")).withColumn("regimes", F.when(F.col("symbol") != "NO", F.col("n")))
    gates = learned.promotion_gates({"sample_size": (F.col("samples"), F.col("samples") >= 200), "net_expectancy": (F.col("e"), F.col("e") > 0), "regimes": (F.col("regimes"), F.col("regimes") >= 1)})
    return e.select("symbol", F.explode(gates).alias("g")).select("symbol", "g.gate", "g.passed")


@query("execution_costs", """WITH i AS (SELECT l_returnflag || l_linestatus AS symbol, CASE WHEN l_returnflag = 'R' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS s, l_discount AS alpha, l_extendedprice / 1000 AS mid, l_tax / 10 AS spread, CASE WHEN l_linenumber <> 7 THEN l_extendedprice / 1000 + l_discount / 100 END AS fill, l_quantity AS requested, floor(l_quantity * 0.9) AS filled FROM lineitem),
p AS (SELECT symbol, fill IS NULL OR filled <= 0 AS rejected, alpha, filled / requested AS ratio, spread / 2 AS half, s * 0.01 AS latency, s * (fill - (mid + 0.01 + s * spread / 2)) AS slip, CASE WHEN requested > 10 THEN s * (fill - (mid + 0.02)) ELSE 0 END AS adverse FROM i)
SELECT symbol, count(*) AS orders, count(*) FILTER (rejected) AS rejected, round(sum(CASE WHEN rejected THEN 0 ELSE half END), 4) AS spread_cost, round(sum(CASE WHEN rejected THEN 0 ELSE slip END), 4) AS slippage_cost, round(sum(CASE WHEN rejected THEN 0 ELSE latency END), 4) AS latency_cost, round(sum(CASE WHEN rejected THEN 0 ELSE adverse END), 4) AS adverse_selection, round(sum(CASE WHEN rejected THEN alpha ELSE alpha * (1 - ratio) END), 4) AS opportunity_cost,
  round(sum(CASE WHEN rejected THEN 0 ELSE alpha * ratio - half - slip - latency - 0.001 - 0.0005 - adverse END), 4) AS net_alpha FROM p GROUP BY symbol""")
def execution_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, mid = F.col, F.col("l_extendedprice") / 1000
    i = table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.when(c("l_returnflag") == "R", "short").otherwise("long").alias("side"), c("l_discount").alias("alpha"), mid.alias("decision_mid"), (mid + 0.01).alias("send_mid"), F.when(c("l_quantity") > 10, mid + 0.02).alias("post_mid"),
        (mid - c("l_tax") / 20).alias("bid"), (mid + c("l_tax") / 20).alias("ask"), F.when(c("l_linenumber") != 7, mid + c("l_discount") / 100).alias("fill"), c("l_quantity").cast("double").alias("requested"), F.floor(c("l_quantity") * 0.9).cast("double").alias("filled"), F.lit(0.001).alias("commission"), F.lit(0.0005).alias("financing"),
    )
    x = learned.execution_costs(i)
    sums = ("spread_cost", "slippage_cost", "latency_cost", "adverse_selection", "opportunity_cost", "net_alpha")
    return x.groupBy("symbol").agg(F.count("*").alias("orders"), F.count_if(c("fill").isNull() | (c("filled") <= 0)).alias("rejected"), *[F.round(F.sum(k), 4).alias(k) for k in sums])


@query("intent_checks", "SELECT event_type, CASE WHEN event_id % 11 = 0 THEN 'expired_intent' WHEN user_id % 13 = 0 THEN 'stale_quote' WHEN value > 80 THEN 'max_spread_exceeded' ELSE 'proceed' END AS verdict, count(*) AS intents FROM events GROUP BY ALL")
def intent_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    ts = c("ts").cast("timestamp")
    v = learned.intent_verdict(ts, F.when(c("event_id") % 11 == 0, ts - F.expr("interval 1 second")).otherwise(ts), F.when(c("user_id") % 13 == 0, ts - F.expr("interval 10 seconds")).otherwise(ts), c("value"), 5.0, 80.0)
    return table(spark, sf_dir, "events").groupBy("event_type", v.alias("verdict")).agg(F.count("*").alias("intents"))


@query("connection_gaps", "WITH g AS (SELECT event_type, lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS started_at, ts AS ended_at FROM events), l AS (SELECT * FROM g WHERE ended_at > started_at + INTERVAL 45 MINUTES), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ended_at)::INT AS reconnect FROM l) SELECT *, round(greatest(0, least(2.0::DOUBLE ** (reconnect % 8), 60) * 0.75 + 0.5 * 2 * least(2.0::DOUBLE ** (reconnect % 8), 60) * 0.25), 6) AS delay FROM r")
def connection_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = learned.gaps(table(spark, sf_dir, "events"), ["event_type"], "ts", "45 minutes")
    return g.withColumn("delay", F.round(learned.backoff(F.col("reconnect") % 8, F.lit(0.5)), 6))
