"""Parsers of documents that sources send: news feeds, calendars, positions, price lines, candles. Rows that can't be read
are left out, or raise where it says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Contract codes of currency futures.
CODES = {"099741": "EUR", "096742": "GBP", "097741": "JPY", "232741": "AUD", "112741": "NZD", "090741": "CAD", "092741": "CHF", "098662": "USD"}
_ITEM = "title string, link string, pubDate string, description string"


def clean(html: Column) -> Column:
    return F.trim(F.replace(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", " "), F.lit("&amp;"), F.lit("&")))


def moment(text: Column) -> Column:
    """A time of RFC 822 or ISO 8601 text, UTC without a zone; null if it is neither."""
    t = F.trim(F.regexp_replace(text, "^[A-Za-z]{3}, ", ""))
    zoned = F.regexp_replace(t, "(GMT|UTC|Z)$", "+0000")
    forms = ("d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ssZ", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(zoned, F.lit(f)) for f in forms])


def rss(feeds: DataFrame, xml: str = "xml", source: str = "source") -> DataFrame:
    """source, title, link, published, summary (300 characters) of the items of RSS 2.0 feeds; without title or date: left out."""
    items = F.regexp_extract_all(F.coalesce(F.col(xml), F.lit("")), F.lit("(?s)<item[^>]*>(.*?)</item>"), F.lit(1))
    rows = feeds.select(source, F.explode(items).alias("i"))

    def part(name: str) -> Column:
        body = F.regexp_extract("i", f"(?s)<{name}[^>]*>(.*?)</{name}>", 1)
        body = F.regexp_replace(body, "(?s)<!\\[CDATA\\[(.*?)\\]\\]>", "$1")
        for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            body = F.replace(body, F.lit(entity), F.lit(c))
        return body

    out = rows.select(F.col(source).alias("source"), clean(part("title")).alias("title"), F.trim(part("link")).alias("link"), moment(part("pubDate")).alias("published"), F.substring(clean(part("description")), 1, 300).alias("summary"))
    return out.filter("title <> '' and published is not null")


def calendar(documents: DataFrame, text: str = "json") -> DataFrame:
    """title, currency, ts, impact, forecast, previous of JSON arrays of events; without a date that can be read: left out."""
    kind = "array<struct<title:string,country:string,date:string,impact:string,forecast:string,previous:string>>"
    rows = documents.select(F.explode(F.from_json(text, kind)).alias("e"))
    said = lambda c: F.trim(F.coalesce(F.col(f"e.{c}"), F.lit("")))
    out = rows.select(said("title").alias("title"), F.upper(said("country")).alias("currency"), moment(F.col("e.date")).alias("ts"), F.lower(said("impact")).alias("impact"), said("forecast").alias("forecast"), said("previous").alias("previous"))
    return out.filter("ts is not null").dropDuplicates(["title", "currency", "ts"])


def positions(documents: DataFrame, text: str = "json", codes: dict[str, str] = CODES) -> DataFrame:
    """currency, report_date, net_position, open_interest, prev_net_position: the latest report of each currency.

    Numbers come as text; rows that have none, or another contract, are left out.
    """
    kind = "array<struct<cftc_contract_market_code:string,report_date_as_yyyy_mm_dd:string,noncomm_positions_long_all:string,noncomm_positions_short_all:string,open_interest_all:string>>"
    rows = documents.select(F.explode(F.from_json(text, kind)).alias("r")).select("r.*")
    whole = lambda c: F.expr(f"cast(try_cast({c} as double) as long)")
    rows = rows.select(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), F.trim("cftc_contract_market_code")).alias("currency"), F.expr("try_cast(substring(report_date_as_yyyy_mm_dd, 1, 10) as date)").alias("report_date"),
        (whole("noncomm_positions_long_all") - whole("noncomm_positions_short_all")).alias("net_position"), whole("open_interest_all").alias("open_interest"),
    ).dropna()
    w = Window.partitionBy("currency").orderBy(F.col("report_date").desc(), "net_position")
    ranked = rows.withColumn("prev_net_position", F.lead("net_position").over(w)).withColumn("n", F.row_number().over(w))
    return ranked.filter("n = 1").drop("n")


def price_lines(lines: DataFrame, line: str = "line", allowed: Column | None = None) -> DataFrame:
    """instrument, event_time, bid, ask, bid_size, ask_size, tradable, raw_sha256, fault of a quote stream's JSON lines.

    Heartbeats give no row. Other kinds and prices without a book have a fault and null prices: they go to quarantine.
    """
    level = "array<struct<price:string,liquidity:double>>"
    p = F.from_json(line, f"type string, instrument string, time string, tradeable boolean, bids {level}, asks {level}")
    rows = lines.select(F.col(line).alias("line"), p.alias("p")).filter("p.type is null or p.type <> 'HEARTBEAT'")
    bid, ask = F.try_element_at("p.bids", F.lit(1)), F.try_element_at("p.asks", F.lit(1))
    fault = F.when(F.col("p.type").isNull(), "malformed").when(F.col("p.type") != "PRICE", "unsupported_type").when(bid.isNull() | ask.isNull(), "no_book")
    ok = allowed if allowed is not None else F.lit(True)
    return rows.select(
        F.replace(F.col("p.instrument"), F.lit("_"), F.lit("")).alias("instrument"), moment(F.regexp_replace(F.col("p.time"), "\\.[0-9]+", "")).alias("event_time"), F.when(fault.isNull(), bid["price"].cast("double")).alias("bid"), F.when(fault.isNull(), ask["price"].cast("double")).alias("ask"),
        bid["liquidity"].alias("bid_size"), ask["liquidity"].alias("ask_size"), (F.coalesce("p.tradeable", F.lit(False)) & ok).alias("tradable"), F.sha2("line", 256).alias("raw_sha256"), fault.alias("fault"),
    )


def candles(documents: DataFrame, frames: list[str], text: str = "json") -> DataFrame:
    """symbol, timeframe, bar_start, bid and ask prices, record_hash of completed candles, one row for each of some frames."""
    side = "struct<o:string,h:string,l:string,c:string>"
    p = F.from_json(text, f"instrument string, candles array<struct<time:string,complete:boolean,bid:{side},ask:{side}>>")
    rows = documents.select(p.alias("p")).select(F.replace(F.col("p.instrument"), F.lit("_"), F.lit("")).alias("symbol"), F.explode("p.candles").alias("c")).filter("c.complete and c.bid is not null and c.ask is not null")
    prices = [F.col(f"c.{s}.{k}").cast("double").alias(f"{s}_{n}") for s in ("bid", "ask") for k, n in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"))]
    out = rows.select("symbol", F.explode(F.array(*map(F.lit, frames))).alias("timeframe"), moment(F.col("c.time")).alias("bar_start"), *prices)
    return out.withColumn("record_hash", F.sha2(F.to_json(F.struct(*out.columns)), 256))


def paired_bars(bid: DataFrame, ask: DataFrame) -> DataFrame:
    """The latest completed bar of each symbol that both feeds have: symbol, bar_start, bid and ask prices. Feeds: symbol,
    bar_start, open, high, low, close, complete."""
    names = ("open", "high", "low", "close")
    b, a = (x.filter("complete").select("symbol", "bar_start", *[F.col(n).alias(f"{s}_{n}") for n in names]) for s, x in (("bid", bid), ("ask", ask)))
    both = b.join(a, ["symbol", "bar_start"])
    rest = [c for c in both.columns if c != "symbol"]
    return both.groupBy("symbol").agg(F.max_by(F.struct(*rest), "bar_start").alias("x")).select("symbol", "x.*")
