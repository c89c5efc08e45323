from __future__ import annotations

import math
from datetime import datetime as D
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import market
from tidewright.operators import folds, indicators, joins, paths, quality, reports, stats
from tidewright.sources import files
from tidewright.streaming import quotes as streams

NTZ = "timestamp_ntz"


def test_open_seconds_skip_the_weekend(spark):
    df = spark.createDataFrame([(D(2024, 1, 5, 20), D(2024, 1, 7, 23)), (D(2024, 1, 3, 0), D(2024, 1, 4, 0)), (D(2024, 1, 6, 0), D(2024, 1, 7, 0))], f"a {NTZ}, b {NTZ}")
    got = [r[0] for r in df.select(market.open_seconds("b") - market.open_seconds("a")).collect()]
    assert got == [7200.0, 86400.0, 0.0]


def test_asof_takes_exact_times_and_no_future(spark):
    left = spark.createDataFrame([(1, "a", D(2024, 1, 1, 10)), (2, "a", D(2024, 1, 1, 9)), (3, "b", D(2024, 1, 1, 10)), (4, None, D(2024, 1, 1, 10))], f"id int, k string, ts {NTZ}")
    right = spark.createDataFrame([("a", D(2024, 1, 1, 10), 1.0), ("a", D(2024, 1, 1, 11), 2.0)], f"k string, at {NTZ}, v double")
    got = {r["id"]: r["matched_v"] for r in joins.asof(left, right, ["k"], "ts", "at", ["v"]).collect()}
    assert got == {1: 1.0, 2: None, 3: None, 4: None}


def test_nearest_prefers_the_earlier_at_a_tie(spark):
    left = spark.createDataFrame([(1, "a", 10.0)], "id int, k string, x double")
    right = spark.createDataFrame([("a", 12.0, "late"), ("a", 8.0, "early"), ("a", 99.0, "far")], "k string, y double, n string")
    assert [r["n"] for r in joins.nearest(left, right, ["k"], "id", F.col("x"), F.col("y"), 2.0).collect()] == ["early"]


def test_first_touch_is_ambiguous_within_one_bar(spark):
    path = spark.createDataFrame([("d", "long", 100.0, 90.0, 110.0, 120.0, D(2024, 1, 1, h), hi, lo, c) for h, hi, lo, c in ((1, 105.0, 95.0, 100.0), (2, 111.0, 89.0, 100.0), (3, 130.0, 100.0, 120.0))], f"decision_id string, direction string, entry double, stop double, target1 double, target2 double, at {NTZ}, high double, low double, close double")
    r = paths.first_touch(path).first()
    assert (r["points"], r["first_touch"], r["realized_r"], r["mfe_r"], r["mae_r"]) == (2, "ambiguous", -1.0, 1.1, 1.1)


def test_thinning_counts_from_the_last_kept(spark):
    t = D(2024, 1, 1)
    df = spark.createDataFrame([("a", t + timedelta(hours=h), h) for h in (0, 1, 3, 5, 6)], f"k string, ts {NTZ}, id int")
    assert sorted(r["id"] for r in folds.thinned(df, ["k"], "ts", "id", 3 * 3600).collect()) == [0, 3, 6]


def test_ewm_starts_with_the_first_value(spark):
    df = spark.createDataFrame([("a", D(2024, 1, 1, h), v) for h, v in enumerate((None, 2.0, 4.0))], f"symbol string, open_time {NTZ}, x double")
    got = [r["y"] for r in indicators.ewm(df, {"x": "y"}, 0.5, 1).orderBy("open_time").collect()]
    assert got[0] is None or math.isnan(got[0])
    assert got[1:] == [2.0, 3.0]


def test_profit_factor_without_losses_is_infinite(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 0.0)], "k string, net double")
    got = {r["k"]: r["profit_factor"] for r in reports.performance(df, ["k"]).collect()}
    assert got == {"a": math.inf, "b": 0.0}


def test_drawdown_that_never_recovers(spark):
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate((10.0, 8.0, 9.0, 11.0, 5.5))], "k string, t int, v double")
    got = sorted((r["start"], r["valley"], r["recovery"], r["depth"]) for r in reports.drawdowns(df, ["k"], "t", "v").collect())
    assert got == [(1, 1, 3, 0.2), (4, 4, None, 0.5)]


def test_overfitting_of_noise_and_skill(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    noise = rng.normal(0, 1, (160, 20))
    skill = noise.copy()
    skill[:, 3] += 1

    def pbo(m):
        rows = [(int(t), int(k), float(m[t, k])) for t in range(m.shape[0]) for k in range(m.shape[1])]
        return stats.overfitting(spark.createDataFrame(rows, "ts int, trial_id int, ret double"), 8).first()["pbo"]

    assert pbo(skill) == 0.0
    assert 0.1 < pbo(noise) < 0.9


def test_appending_twice_changes_nothing_and_conflicts_raise(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    assert quality.appended(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), old, ["k"], ["v"]).collect() == [(2, "b")]
    with pytest.raises(ValueError):
        quality.appended(spark.createDataFrame([(1, "z")], "k int, v string"), old, ["k"], ["v"])


def test_an_undecidable_rule_is_broken(spark):
    df = spark.createDataFrame([(None,), (1.0,)], "x double")
    assert [r[0] for r in df.select(quality.flags({"negative": F.col("x") < 0})).collect()] == [["negative"], []]


def test_price_files(spark, tmp_path):
    (tmp_path / "EURUSD-1h.csv").write_text(" Date ,BidOpen,High,Low,Close\n2024-01-01 00:00:00,1,2,0.5,1.5\n2024-01-01 01:00:00,1,2,0.5,1.5\n")
    df = files.unique_times(files.prices_csv(spark, f"file://{tmp_path}/EURUSD-1h.csv"))
    assert [r["symbol"] for r in df.collect()] == ["EURUSD", "EURUSD"]
    (tmp_path / "bad.csv").write_text("date,open\n2024-01-01,1\n")
    with pytest.raises(ValueError):
        files.prices_csv(spark, f"file://{tmp_path}/bad.csv")
    with pytest.raises(ValueError):
        files.unique_times(df.union(df))


def test_journals_and_series(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"a": 1}\nnot json\n\n{"a": 2}\n')
    rows = files.journal(spark, f"file://{tmp_path}/j.jsonl", "a int").collect()
    assert sorted((r["a"], r["malformed"]) for r in rows if r["a"]) == [(1, False), (2, False)]
    assert sum(r["malformed"] for r in rows) == 1
    (tmp_path / "s.csv").write_text("day,value\n2024-01-02,2.5\n2024-01-01,.\n2023-12-31,1\n")
    assert [r["value"] for r in files.series_csv(spark, f"file://{tmp_path}/s.csv").collect()] == [1.0, 2.5]


def test_binary_and_zipped_ticks(spark, tmp_path):
    import lzma
    import struct
    import zipfile

    (tmp_path / "h.bi5").write_bytes(lzma.compress(struct.pack(">iiiff", 5, 110002, 110000, 1.0, 2.0), lzma.FORMAT_ALONE))
    assert [(r["ms"], round(r["ask"], 5)) for r in files.ticks_binary(spark, f"file://{tmp_path}/h.bi5", 1e-5).collect()] == [(5, 1.10002)]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.csv", "1;2\n3;4\n")
    assert sorted(r["b"] for r in files.zipped_csv(spark, f"file://{tmp_path}/z.zip", ["a", "b"]).collect()) == ["2", "4"]


def test_streamed_quotes_are_classified(spark):
    rows = [(1.0, 1.1, 5), (1.2, 1.1, 5), (1.0, 1.1, 60), (1.0, None, 5)]
    t = D(2024, 1, 1)
    df = spark.createDataFrame([(b, a, t, t + timedelta(seconds=s)) for b, a, s in rows], "bid double, ask double, ts timestamp, received timestamp")
    assert [r["state"] for r in streams.classified(df).collect()] == ["accepted", "quarantined", "quarantined", "quarantined"]


def test_price_files_of_other_orders(spark, tmp_path):
    (tmp_path / "EURUSD.csv").write_text("date,open,high,low,close\n2024-01-01 00:00:00,1,2,0.5,1.5\n")
    (tmp_path / "GBPUSD.csv").write_text("date,close,open,high,low,volume\n2024-01-01 00:00:00,1.5,1,2,0.5,9\n")
    df = files.prices_csv(spark, [f"file://{tmp_path}/EURUSD.csv", f"file://{tmp_path}/GBPUSD.csv"])
    assert {(r["symbol"], r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in df.collect()} == {("EURUSD", 1.0, 2.0, 0.5, 1.5, None), ("GBPUSD", 1.0, 2.0, 0.5, 1.5, 9.0)}


def test_positions_are_global(spark):
    from tidewright.operators import validation

    rng = np.random.default_rng(3)
    rows = [(D(2024, 1, 1 + int(d), int(h)), k) for k, (d, h) in enumerate(zip(rng.integers(0, 20, 500), rng.integers(0, 24, 500), strict=True))] + [(None, 999)]
    df = spark.createDataFrame(rows, f"at {NTZ}, k int").repartition(7)
    got = {r["k"]: r["pos"] for r in validation.numbered(df, ["at", "k"]).collect()}
    assert got == {k: i for i, (_, k) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or D.min, r[1])))}
    assert validation.numbered(df.limit(0), ["at", "k"]).collect() == []


def test_quantiles_from_counts(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(0, 3, 400), 1)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 2.0)], "k string, x double")
    shares = [0.0, 0.1, 0.37, 0.5, 0.95, 1.0]
    got = {r["k"]: r["q"] for r in stats.quantiles(df.groupBy("k", "x").agg(F.count("*").alias("n")), ["k"], "x", "n", shares).collect()}
    assert np.allclose(got["a"], np.quantile(x, shares))
    assert got["b"] == [2.0] * 6


def test_resampling_keeps_blocks(spark):
    """Of a series of equal blocks, flips of whole blocks are far less sure than flips of values; bounds hold the mean."""
    rng = np.random.default_rng(5)
    base = np.repeat(rng.normal(0.3, 1, 24), 5)
    df = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(base)] + [("b", 0, 1.0), ("b", 1, None)], "k string, pos int, x double")
    got = {r["k"]: r for r in stats.bootstrap(df, ["k"], "x", 5).collect()}
    single = {r["k"]: r for r in stats.bootstrap(df, ["k"], "x", 1).collect()}
    assert got["a"]["low"] < base.mean() < got["a"]["high"]
    assert got["a"]["high"] - got["a"]["low"] > 1.6 * (single["a"]["high"] - single["a"]["low"])
    assert got["a"]["p_value"] > 2 * single["a"]["p_value"]
    assert (got["b"]["n"], got["b"]["mean"], got["b"]["low"]) == (1, 1.0, 1.0)
    assert [tuple(r) for r in stats.bootstrap(df, ["k"], "x", 5).orderBy("k").collect()] == [tuple(got["a"]), tuple(got["b"])]


def test_barriers(spark):
    from tidewright.operators import paths

    def label(rows, **more):
        bars = [("s", D(2024, 1, 1, h), *map(float, r)) for h, r in enumerate([(10, 10, 10, 10), *rows])]
        df = spark.createDataFrame(bars, f"symbol string, open_time {NTZ}, open double, high double, low double, close double")
        r = paths.triple_barrier(df, F.lit(2.0), F.lit(1.0), 3, **more).orderBy("open_time").first()
        return r["first_touch"], r["label"], r["bars_to_exit"], r["exit_price"], r["gross_r"]

    calm = (10, 10.5, 9.5, 10.2)
    assert label([calm, (8, 13, 7, 8)]) == ("sl_gap", -1, 2, 8.0, -2.0)
    assert label([calm, (13, 14, 7, 8)]) == ("tp_gap", 1, 2, 12.0, 2.0)
    assert label([calm, (10, 13, 8, 8)]) == ("sl", -1, 2, 9.0, -1.0)
    assert label([calm, (10, 13, 8, 8)], same_bar="profit_first") == ("tp", 1, 2, 12.0, 2.0)
    assert label([calm, (10, 13, 8, 8)], same_bar="unresolved") == ("ambiguous", 0, 2, None, None)
    assert label([calm, calm, calm, (20, 20, 20, 20)]) == ("timeout", 0, 3, 10.2, 0.2)
    assert label([calm, (10, 11.5, 7.9, 8)], direction=-1) == ("sl", -1, 2, 11.0, -1.0)
