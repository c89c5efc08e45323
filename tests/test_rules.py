"""Operators without SQL of their own, against plain versions and known cases."""

from __future__ import annotations

import math
from datetime import datetime as D

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import calibration, contracts, learned, news
from tidewright.sources import parsers


def test_normal_distribution(spark):
    xs = [-40.0, -8.5, -7.08, -7.06, -3.0, -1.0, -1e-9, 0.0, 0.3, 1.96, 5.0, 7.2, 40.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(learned.norm_cdf(F.col("x"))).collect()]
    assert all(abs(g - 0.5 * math.erfc(-x / math.sqrt(2))) < 1e-14 for g, x in zip(got, xs, strict=True))
    p = spark.range(1).select(learned.binomial_p(F.lit(60), F.lit(100)), learned.binomial_p(F.lit(0), F.lit(0))).first()
    assert abs(p[0] - 0.5 * math.erfc((59.5 - 50) / 5 / math.sqrt(2))) < 1e-12
    assert p[1] == 1.0


def test_calibrators(spark):
    rng = np.random.default_rng(1)
    true = rng.random(4000)
    raw = np.clip(true**2, 0.001, 0.999)
    y = (rng.random(4000) < true).astype(int)
    rows = [(float(p), int(v), int(k)) for k, (p, v) in enumerate(zip(raw, y, strict=True))]
    df = spark.createDataFrame([*rows, (None, 1, 0)], "p double, y int, t int")
    first, second = df.filter("t < 2500"), df.filter("t >= 2500")
    for fit in (calibration.platt(first, "p", "y"), calibration.beta(first, "p", "y"), calibration.isotonic(first, "p", "y")):
        out = second.withColumn("c", calibration.calibrated(F.col("p"), fit)).orderBy("p").collect()
        c = [r["c"] for r in out]
        assert all(b >= a - 1e-12 for a, b in zip(c, c[1:], strict=False))
        assert np.mean((np.array(c) - np.sqrt([r["p"] for r in out])) ** 2) < 0.004
    iso = calibration.isotonic(spark.createDataFrame([(0.1, 0), (0.2, 1), (0.3, 0), (0.3, 0), (0.9, 1)], "p double, y int"), "p", "y")
    assert iso["upper"] == [0.1, 0.3, 0.9]
    assert [round(v, 6) for v in iso["values"]] == [1e-6, round(1 / 3, 6), 1 - 1e-6]
    assert calibration.chosen(first, second, "p", "y", "t")["method"] in ("beta", "isotonic")
    with pytest.raises(ValueError, match="window"):
        calibration.chosen(second, first, "p", "y", "t")
    with pytest.raises(ValueError, match="classes"):
        calibration.platt(first.withColumn("y", F.lit(1)), "p", "y")


def test_moves_and_negations(spark):
    texts = ["USDJPY slides after EUR/USD rises", "XAUUSD gains", "eur / gbp: calm", "no rate hike", "the bank will not ever consider a rate hike at all", "x" * 40 + " hawkish", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("low", news.folded(F.col("text"))).select(news.moves("text").alias("m"), news.hits("low").alias("h")).collect()
    assert [tuple(x) for x in rows[0]["m"]] == [("USD", 1.0), ("JPY", -1.0), ("EUR", 1.0), ("USD", -1.0)] or [tuple(x) for x in rows[0]["m"]][2:] == [("EUR", 1.0), ("USD", -1.0)]
    assert rows[1]["m"] == rows[2]["m"] == rows[6]["m"] == []
    assert [round(x, 6) for x in rows[3]["h"]] == [-0.36]
    assert [round(x, 6) for x in rows[4]["h"]] == [-0.36]
    assert rows[5]["h"] == [0.6]


def test_date_bounds(spark):
    df = spark.createDataFrame([(D(2024, 1, 1, 23, 59, 59, 999999),), (D(2024, 1, 2),), (D(2024, 1, 3),)], "ts timestamp_ntz")
    assert contracts.in_range(df, "ts", "2024-01-01", "2024-01-01").count() == 1
    assert contracts.in_range(df, "ts", None, "2024-01-02 00:00:00").count() == 2
    assert contracts.in_range(df, "ts", "2024-01-02 00:30:00", None, before=30).count() == 2
    with pytest.raises(ValueError):
        contracts.in_range(df, "ts", "2025-01-01", None)


def test_decisions_that_only_one_guard_blocked(spark):
    row = "struct<name:string,status:string>"
    data = [("a", [("expectancy_guard", "blocked"), ("x", "ok")], "long", 40), ("b", [("expectancy_guard", "blocked"), ("event", "blocked")], "long", 40), ("c", [("expectancy_guard", "blocked")], "neutral", 40), ("d", [], "long", 40)]
    df = spark.createDataFrame([(i, t, d, c, "neutral", 0) for i, t, d, c in data], f"decision_id string, gate_trace array<{row}>, pre_guard_direction string, pre_guard_conviction int, direction string, conviction int")
    got = contracts.unguarded(df).collect()
    assert [(r["decision_id"], r["parent_decision_id"], r["direction"], r["conviction"]) for r in got] == [("a:pre-guard", "a", "long", 40)]


def test_feeds(spark):
    xml = "<rss><channel><item><title><![CDATA[A <b>bold</b> claim]]></title><link>http://x</link><pubDate>Tue, 2 Jan 2024 03:04:05 +0100</pubDate><description>d &lt;i&gt;e&lt;/i&gt;</description></item><item><title></title></item><item><title>no date</title></item></channel></rss>"
    got = parsers.rss(spark.createDataFrame([("s", xml), ("t", None), ("u", "<broken")], "source string, xml string")).collect()
    assert [(r["source"], r["title"].split(), r["published"].isoformat(), r["summary"].split()) for r in got] == [("s", ["A", "bold", "claim"], "2024-01-02T02:04:05", ["d", "e"])]
    body = '{"instrument":"EUR_USD","candles":[{"time":"2024-01-01T00:00:00Z","complete":true,"bid":{"o":"1","h":"2","l":"0.5","c":"1.5"},"ask":{"o":"1.1","h":"2.1","l":"0.6","c":"1.6"}},{"time":"2024-01-01T01:00:00Z","complete":false}]}'
    rows = parsers.candles(spark.createDataFrame([(body,)], "json string"), ["15m", "1h"]).collect()
    assert [(r["symbol"], r["timeframe"], r["bid_open"], r["ask_close"]) for r in rows] == [("EURUSD", "15m", 1.0, 1.6), ("EURUSD", "1h", 1.0, 1.6)]
    assert len({r["record_hash"] for r in rows}) == 2
    bar = "symbol string, bar_start int, open double, high double, low double, close double, complete boolean"
    bid = spark.createDataFrame([("s", 1, 1.0, 1.0, 1.0, 1.0, True), ("s", 2, 2.0, 2.0, 2.0, 2.0, True), ("s", 3, 3.0, 3.0, 3.0, 3.0, False)], bar)
    ask = spark.createDataFrame([("s", k, k + 0.5, 9.0, 0.0, 1.0, True) for k in (1, 2, 3)], bar)
    assert [(r["bar_start"], r["bid_open"], r["ask_open"]) for r in parsers.paired_bars(bid, ask).collect()] == [(2, 2.0, 2.5)]


def test_adjusters_and_thresholds(spark):
    f = lambda x: F.lit(x)
    r = spark.range(1).select(*learned.composed((f(0.75), f(False)), (f(0.45), f(True)), f(50)), learned.effective_threshold(f("active"), f(0.2), f(True), f(2), f(1)), learned.effective_threshold(f("active"), f(0.2), f(True), f(1), f(2)), learned.effective_threshold(f("shadow"), f(0.2), f(True), f(2), f(1))).first()
    assert [round(x, 6) if isinstance(x, float) else x for x in r] == [0.3375, 38, True, 0.2, 0.15, 0.15]
