"""Headlines, feeds and account metrics over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.operators import news, reports
from tidewright.plans.catalog import query
from tidewright.plans.trades import NET, equity, trades
from tidewright.sources import parsers
from tidewright.sources.tables import table

# An event as a headline: what is said, with what doubt, of which pair.
_SAID = ["surprise rate hike sharply lifts the mood", "officials rule out nothing: rate cut may follow", "data beats expectations", "weak jobs growth and layoffs", "it is not hawkish after all", "safe haven flows in a crisis", "EUR/USD rises on relief", "USDJPY slides; risk appetite returns", "plain talk"]
_TEXT = "CASE event_id % 9 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(_SAID)) + " END"
_TAGS = "CASE user_id % 4 WHEN 0 THEN ['USD'] WHEN 1 THEN ['EUR', 'USD'] WHEN 2 THEN ['JPY'] ELSE []::VARCHAR[] END"
_SOURCE = "CASE user_id % 3 WHEN 0 THEN 'Reuters' WHEN 1 THEN ' FXStreet ' ELSE 'blog' END"


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    said = F.element_at(F.array(*map(F.lit, _SAID)), (e % 9 + 1).cast("int"))
    tags = F.when(u % 4 == 0, F.array(F.lit("USD"))).when(u % 4 == 1, F.array(F.lit("EUR"), F.lit("USD"))).when(u % 4 == 2, F.array(F.lit("JPY"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"), said.alias("text"), F.when(u % 3 == 0, "Reuters").when(u % 3 == 1, " FXStreet ").otherwise("blog").alias("source"), F.col("ts").alias("published"), tags.alias("currencies"))


def _like(terms: tuple[str, ...], text: str) -> str:
    return "(" + " OR ".join("contains(" + text + ", '" + t.replace("'", "''") + "')" for t in terms) + ")"


_PHRASES = ", ".join(f"('{p}', {s * w}::DOUBLE)" for s, t in ((1, news.FOR), (-1, news.AGAINST)) for w, ps in t.items() for p in ps)
_SENTIMENT = f"""WITH i AS (SELECT event_id, ts, {_TEXT} AS text, {_SOURCE} AS source, {_TAGS} AS tags FROM events), n AS (SELECT max(ts) AS now FROM events),
q AS (SELECT *, lower(text) AS low, CASE WHEN lower(trim(source)) IN ('fxstreet', 'reuters', 'bloomberg') THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END * 0.5::DOUBLE ** (greatest(0, (epoch_us(now) - epoch_us(ts)) / 3.6e9) / 12) AS w FROM i, n),
m AS (SELECT *, CASE WHEN {_like(news.HEDGES, 'low')} THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN {_like(news.INTENSIFIERS, 'low')} THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END AS m FROM q WHERE w > 0.01),
p(phrase, v) AS (VALUES {_PHRASES}), h AS (SELECT event_id, m * v * CASE WHEN {_like(news.NEGATIONS, 'substr(low, greatest(instr(low, phrase) - 32, 1), instr(low, phrase) - greatest(instr(low, phrase) - 32, 1))')} THEN -0.6::DOUBLE ELSE 1.0::DOUBLE END AS x FROM m JOIN p ON contains(low, phrase)),
s AS (SELECT event_id, sum(x) AS plus, sum(abs(x)) AS size FROM h GROUP BY event_id), t AS (SELECT m.*, coalesce(plus, 0) AS plus, coalesce(size, 0) AS size, CASE event_id % 9 WHEN 6 THEN ['EUR', 'USD'] WHEN 7 THEN ['USD', 'JPY'] ELSE []::VARCHAR[] END AS moved FROM m LEFT JOIN s USING (event_id)),
c AS (SELECT *, unnest(list_distinct(list_concat(tags, moved))) AS currency FROM t), d AS (SELECT *, CASE WHEN event_id % 9 = 6 THEN CASE currency WHEN 'EUR' THEN 0.7::DOUBLE WHEN 'USD' THEN -0.7::DOUBLE ELSE 0 END WHEN event_id % 9 = 7 THEN CASE currency WHEN 'USD' THEN -0.7::DOUBLE WHEN 'JPY' THEN 0.7::DOUBLE ELSE 0 END ELSE 0 END AS move, list_contains(tags, currency) AS tagged FROM c),
g AS (SELECT currency, count(*) AS headlines, sum(w) AS n, sum((CASE WHEN tagged THEN plus ELSE 0 END + move) * w) AS s, sum((CASE WHEN tagged THEN size ELSE 0 END + abs(move)) * w) AS a FROM d GROUP BY currency)
SELECT currency, headlines, CASE WHEN a > 0 THEN round(greatest(-1, least(1, s / 2.5)) * round(abs(s) / a * n / (n + 3), 3), 3) ELSE 0 END AS score, CASE WHEN a > 0 THEN round(abs(s) / a * n / (n + 3), 3) END AS confidence FROM g"""


@query("currency_sentiment", _SENTIMENT)
def currency_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = headlines(spark, sf_dir)
    now = i.agg(F.max("published").alias("now"))
    return news.currency_scores(i.join(F.broadcast(now), F.lit(True)), F.col("now"))


_OFF, _ON = ("(" + " + ".join(f"contains(lower({_TEXT}), '{t}')::INT" for t in terms) + ")" for terms in (news.RISK_OFF, news.RISK_ON))


@query("headline_mood", f"WITH g AS (SELECT ts::DATE AS day, sum({_OFF})::BIGINT AS off, sum({_ON})::BIGINT AS \"on\" FROM events GROUP BY 1) SELECT *, CASE WHEN off >= \"on\" + 2 THEN 'risk_off' WHEN \"on\" >= off + 2 THEN 'risk_on' ELSE 'neutral' END AS regime FROM g")
def headline_mood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.mood(headlines(spark, sf_dir), ["day"])


def _documents(df: DataFrame, by: list[str], body: str) -> DataFrame:
    """Rows as JSON arrays, one a group: what a source would have sent."""
    return df.groupBy(*by).agg(F.to_json(F.collect_list(body)).alias("json"))


@query("calendar_feed", "SELECT 'event ' || event_id AS title, upper(substr(event_type, 1, 3)) AS currency, date_trunc('second', ts) AS ts, CASE WHEN value > 100 THEN 'high' ELSE 'low' END AS impact, round(value, 2)::VARCHAR AS forecast, '' AS previous FROM events WHERE event_id % 10 <> 0")
def calendar_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events sent as JSON arrays by day, every tenth with a date that can't be read, and read again."""
    c = F.col
    date = F.when(c("event_id") % 10 == 0, "tomorrow").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.struct(F.concat(F.lit(" event "), c("event_id").cast("string")).alias("title"), F.lower(F.substring("event_type", 1, 3)).alias("country"), date.alias("date"), F.when(c("value") > 100, "HIGH").otherwise("Low").alias("impact"), F.round("value", 2).cast("string").alias("forecast")).alias("e"))
    return parsers.calendar(_documents(e, ["day"], "e")).withColumn("ts", c("ts").cast("timestamp_ntz"))


@query("position_reports", """WITH r AS (SELECT CASE o_custkey % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' WHEN 2 THEN 'JPY' END AS currency, o_orderdate::DATE AS report_date, max(o_orderkey) AS k FROM orders GROUP BY 1, 2), x AS (SELECT *, k % 1000 - k % 777 AS net, k % 5000 AS oi, row_number() OVER (PARTITION BY currency ORDER BY report_date DESC) AS n, lead(k % 1000 - k % 777) OVER (PARTITION BY currency ORDER BY report_date DESC) AS prev FROM r WHERE currency IS NOT NULL)
SELECT currency, report_date, net::BIGINT AS net_position, oi::BIGINT AS open_interest, prev::BIGINT AS prev_net_position FROM x WHERE n = 1""")
def position_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("o_custkey") % 4
    code = F.when(m == 0, "099741").when(m == 1, " 096742").when(m == 2, "097741").otherwise("000000")
    r = table(spark, sf_dir, "orders").groupBy(code.alias("code"), F.to_date("o_orderdate").alias("day")).agg(F.max("o_orderkey").alias("k"))
    k = F.col("k")
    rows = r.select(F.year("day").alias("y"), F.struct(F.col("code").alias("cftc_contract_market_code"), F.concat(F.col("day").cast("string"), F.lit("T00:00:00.000")).alias("report_date_as_yyyy_mm_dd"), (k % 1000).cast("string").alias("noncomm_positions_long_all"), (k % 777).cast("string").alias("noncomm_positions_short_all"), (k % 5000).cast("string").alias("open_interest_all")).alias("r"))
    return parsers.positions(_documents(rows, ["y"], "r"))


@query("price_lines", "SELECT CASE WHEN event_id % 6 = 2 THEN NULL ELSE 'EURUSD' END AS instrument, CASE WHEN event_id % 6 = 2 THEN 'malformed' WHEN event_id % 6 = 3 THEN 'unsupported_type' WHEN event_id % 6 = 4 THEN 'no_book' END AS fault, count(*) AS lines, count(bid) AS prices, round(avg(bid), 6) AS bid FROM (SELECT event_id, CASE WHEN event_id % 6 IN (1, 5) THEN round(value, 4) END AS bid FROM events WHERE event_id % 6 <> 0) GROUP BY 1, 2")
def price_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a quote stream: heartbeats, prices, broken lines, other kinds, empty books."""
    c, k = F.col, F.col("event_id") % 6
    level = lambda add: F.array(F.struct((F.round("value", 4) + add).cast("string").alias("price"), F.lit(1e6).alias("liquidity")))
    book = lambda add: F.when(k != 4, level(add))
    kind = F.when(k == 0, "HEARTBEAT").when(k == 3, "NEWS").otherwise("PRICE")
    body = F.to_json(F.struct(kind.alias("type"), F.lit("EUR_USD").alias("instrument"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), F.lit(True).alias("tradeable"), book(0).alias("bids"), book(0.5).alias("asks")))
    lines = table(spark, sf_dir, "events").select(F.when(k == 2, F.lit("{broken")).otherwise(body).alias("line"))
    return parsers.price_lines(lines).groupBy("instrument", "fault").agg(F.count("*").alias("lines"), F.count("bid").alias("prices"), F.round(F.avg("bid"), 6).alias("bid"))


@query("rss_items", "SELECT source, count(*) AS items, sum(length(title))::BIGINT AS chars, min(published) AS first_time FROM (SELECT CASE user_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS source, 'Rates & yields ' || event_id AS title, date_trunc('second', ts) AS published FROM events WHERE event_id % 8 <> 0) GROUP BY source")
def rss_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as items of three feeds by day, every eighth without a date."""
    c = F.col
    date = F.when(c("event_id") % 8 == 0, "").otherwise(F.concat(F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT")))
    item = F.concat(F.lit("<item><title>Rates &amp;amp; yields "), c("event_id").cast("string"), F.lit("</title><link> http://x </link><pubDate>"), date, F.lit("</pubDate><description>d</description></item>"))
    feeds = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), F.when(c("user_id") % 3 == 0, "a").when(c("user_id") % 3 == 1, "b").otherwise("c").alias("source")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("xml"))
    return parsers.rss(feeds).groupBy("source").agg(F.count("*").alias("items"), F.sum(F.length("title")).alias("chars"), F.min(c("published").cast("timestamp_ntz")).alias("first_time"))


_CURVE = f"""t AS ({NET}), d AS (SELECT symbol, exit_time::DATE AS day, sum(net)::BIGINT AS net FROM t GROUP BY ALL), e AS (SELECT symbol, day, (10000000000000 + sum(net) OVER (PARTITION BY symbol ORDER BY day))::DOUBLE AS equity FROM d),
f AS (SELECT *, max(equity) OVER o AS peak, equity / lag(equity) OVER o - 1 AS ret, date_diff('day', lag(day) OVER o, day) * 86400.0::DOUBLE AS dt FROM e WINDOW o AS (PARTITION BY symbol ORDER BY day)),
g AS (SELECT symbol, count(*) AS points, arg_max(equity, day) AS final, avg(ret) AS m, stddev_samp(ret) AS sd, sqrt(avg(CASE WHEN ret IS NOT NULL THEN least(ret, 0) ** 2 END)) AS down, max(1 - equity / peak) AS dd, sqrt(365.25 * 86400 / median(dt)) AS ann, date_diff('day', min(day), max(day)) / 365.25 AS years FROM f GROUP BY symbol)"""
_DEALS = """r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY net, id, line) AS k, count(*) OVER (PARTITION BY symbol) AS c FROM t), s AS (SELECT symbol, count(*) AS trades, avg((net > 0)::INT) AS win_rate, avg(net) AS expectancy, median(net) AS mid, avg(net) FILTER (k <= greatest(ceil(c * 0.05), 1)) AS es, sum(greatest(net, 0))::DOUBLE AS gp, sum(greatest(-net, 0))::DOUBLE AS gl, avg(net) FILTER (net > 0) AS aw, avg(-net) FILTER (net < 0) AS al, avg(epoch(exit_time) - epoch(entry_time)) / 3600 AS hold FROM r GROUP BY symbol)"""


@query("account_metrics", f"WITH {_CURVE}, {_DEALS} SELECT symbol, points, trades, round(final / 1e13 - 1, 6) AS total_return, round((final / 1e13) ** (1 / years) - 1, 6) AS annualized_return, round(dd, 6) AS max_drawdown, round(m / sd * ann, 4) AS sharpe, round(m / down * ann, 4) AS sortino, round(((final / 1e13) ** (1 / years) - 1) / dd, 4) AS calmar, round(win_rate, 6) AS win_rate, round(expectancy / 1e9, 6) AS expectancy_r, round(mid / 1e9, 6) AS median_r, round(es / 1e9, 6) AS expected_shortfall_r, round(gp / gl, 4) AS profit_factor, round(aw / al, 4) AS payoff_ratio, round(hold, 4) AS holding_hours FROM g JOIN s USING (symbol)")
def account_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).withColumn("r", F.col("net"))
    return reports.account_metrics(equity(spark, sf_dir), t, ["symbol"], "day", 1e13, ["id", "line"], 1e9)
