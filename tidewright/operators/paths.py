"""What happens to a price after a decision: excursions, first touch of a stop or target, barriers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.market import open_seconds, rounded
from tidewright.operators.joins import banded


def paths(decisions: DataFrame, bars: DataFrame, hours: float, tolerance: float = 0.0) -> DataFrame:
    """Each decision with the bars of its symbol whose market-open age is over 0 and at most hours + tolerance.

    decisions: decision_id, symbol, ts, ...; bars: symbol, at, high, low, close. An equi-join on (symbol, bucket).
    """
    most = (hours + tolerance) * 3600
    return banded(decisions, bars, ["symbol"], open_seconds("ts"), open_seconds("at"), 0.0, most).withColumn("open_age", F.col("__r") - F.col("__l")).filter("open_age > 0").drop("__l", "__r")


def first_touch(path: DataFrame) -> DataFrame:
    """decision_id, points, first_touch, touched_at, mfe_r, mae_r, realized_r from the rows of paths().

    path also has direction (long, short), entry, and the levels stop, target1, target2 or, in their place, their distances
    from the entry: risk, reward1, reward2. A level made of entry and distance is off by a rounding; whoever has distances
    gives those. Within one point a stop beats nothing: with a target it is ambiguous, and counts as the stop. Excursions count up to the touch, in units of entry to stop;
    the adverse one is at least 0. Without a touch the last close decides. The first touch is a window over a decision's
    rows, which the aggregation after it finds in place: one shuffle by decision, no join of the path with itself.
    """
    long = F.col("direction") == "long"
    sign = F.when(long, 1.0).otherwise(-1.0)
    best, worst = F.when(long, F.col("high")).otherwise(F.col("low")), F.when(long, F.col("low")).otherwise(F.col("high"))
    up, down = sign * (best - F.col("entry")), sign * (worst - F.col("entry"))
    if "risk" in path.columns:
        risk, first, second = F.col("risk"), F.col("reward1"), F.col("reward2")
        stop, two, one = down <= -risk, up >= second, up >= first
    else:
        risk, first, second = (F.abs(F.col(c) - F.col("entry")) for c in ("stop", "target1", "target2"))
        stop, two, one = sign * (worst - F.col("stop")) <= 0, sign * (best - F.col("target2")) >= 0, sign * (best - F.col("target1")) >= 0
    touch = F.when(stop & (one | two), "ambiguous").when(stop, "sl").when(two, "tp2").when(one, "tp1")
    p = path.filter(risk > 0).withColumns({"touch": touch, "fav": up / risk, "adv": sign * (F.col("entry") - worst) / risk, "end_r": sign * (F.col("close") - F.col("entry")) / risk, "r1": first / risk, "r2": second / risk})
    from pyspark.sql import Window

    p = p.withColumn("touched_at", F.min(F.when(F.col("touch").isNotNull(), F.col("at"))).over(Window.partitionBy("decision_id"))).filter(F.col("touched_at").isNull() | (F.col("at") <= F.col("touched_at")))
    out = p.groupBy("decision_id").agg(F.count("*").alias("points"), F.min_by("touch", F.col("at")).alias("t0"), F.max_by("touch", F.col("at")).alias("first_touch"), F.first("touched_at").alias("touched_at"), F.max("fav").alias("mfe"), F.max("adv").alias("mae"), F.max_by("end_r", F.col("at")).alias("end_r"), F.first("r1").alias("r1"), F.first("r2").alias("r2"))
    t = F.coalesce("first_touch", F.lit("none"))
    realized = F.when(t.isin("sl", "ambiguous"), -1.0).when(t == "tp2", F.col("r2")).when(t == "tp1", F.col("r1")).otherwise(F.col("end_r"))
    return out.select("decision_id", "points", t.alias("first_touch"), "touched_at", rounded(F.col("mfe"), 6).alias("mfe_r"), rounded(F.greatest("mae", F.lit(0.0)), 6).alias("mae_r"), rounded(realized, 6).alias("realized_r"))


def expectancy(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Cells of scored outcomes: counts, expectancy, profit factor, touch rates, mean excursions, sample_ok (20 or more)."""
    r = F.col("realized_r")
    win, loss = F.sum(F.when(r > 0, r).otherwise(0.0)), F.sum(F.when(r < 0, -r).otherwise(0.0))
    rate = lambda *names: F.round(F.avg(F.col("first_touch").isin(*names).cast("double")), 6)
    out = outcomes.groupBy(*by).agg(F.count("*").alias("evaluated"), F.round(F.avg(r), 5).alias("expectancy_r"), win.alias("w"), loss.alias("l"), rate("sl", "ambiguous").alias("sl_rate"), rate("tp1", "tp2").alias("tp_rate"), F.round(F.avg("mfe_r"), 5).alias("mfe_avg"), F.round(F.avg("mae_r"), 5).alias("mae_avg"))
    return out.withColumn("profit_factor", F.round(F.when(F.col("l") > 0, F.col("w") / F.col("l")).when(F.col("w") > 0, float("inf")), 4)).withColumn("sample_ok", F.col("evaluated") >= 20).drop("w", "l")


def triple_barrier(bars: DataFrame, profit: Column, risk: Column, horizon: int, direction: int = 1, same_bar: str = "stop_first") -> DataFrame:
    """bars with first_touch, label (1, -1, 0), bars_to_exit, exit_price, gross_r: which barrier around the next open is
    met first within horizon bars.

    In each bar an open beyond a barrier comes before all else: beyond the stop it is the exit price (sl_gap), beyond
    the target the target is (tp_gap). Then touches: a bar that meets both counts as the stop, with same_bar
    "profit_first" as the target, with "unresolved" as ambiguous, without an exit. Without any, the last bar's close
    decides (timeout). The entry bar is bar 1; the last bars have fewer ahead, the very last none and no row. profit and
    risk are distances above 0; direction -1 turns all around. The bars ahead are an ordered frame of bounded length,
    folded in place: no join.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("open_time").rowsBetween(1, horizon)
    ahead = bars.withColumns({"__p": profit, "__r": risk, "__a": F.collect_list(F.struct("open", "high", "low", "close")).over(w)})
    entry = F.col("__a")[0]["open"]
    stop, target = entry - direction * F.col("__r"), entry + direction * F.col("__p")
    best, worst = ("high", "low") if direction > 0 else ("low", "high")
    both = {"stop_first": "sl", "profit_first": "tp", "unresolved": "ambiguous"}[same_bar]

    def touch(b: Column) -> Column:
        down, up = direction * (b[worst] - stop) <= 0, direction * (b[best] - target) >= 0
        return F.when(direction * (b["open"] - stop) <= 0, "sl_gap").when(direction * (b["open"] - target) >= 0, "tp_gap").when(down & up, both).when(down, "sl").when(up, "tp")

    met = ahead.filter(F.size("__a") > 0).withColumn("__t", F.transform("__a", touch))
    met = met.withColumn("__k", F.coalesce(F.array_min(F.filter(F.sequence(F.lit(1), F.size("__a")), lambda i: F.element_at("__t", i).isNotNull())), F.lit(0)))
    n = F.when(F.col("__k") > 0, F.col("__k")).otherwise(F.size("__a"))
    first = F.when(F.col("__k") > 0, F.element_at("__t", F.greatest(F.col("__k"), F.lit(1)))).otherwise("timeout")
    met = met.withColumn("first_touch", first).withColumn("__n", n).withColumn("__bar", F.element_at("__a", F.col("__n")))
    price = F.when(F.col("first_touch") == "sl_gap", F.col("__bar.open")).when(F.col("first_touch") == "sl", stop).when(F.col("first_touch").isin("tp", "tp_gap"), target).when(F.col("first_touch") == "timeout", F.col("__bar.close"))
    label = F.when(F.col("first_touch").startswith("sl"), -1).when(F.col("first_touch").startswith("tp"), 1).otherwise(0)
    return met.select(*bars.columns, "first_touch", label.alias("label"), F.col("__n").cast("int").alias("bars_to_exit"), F.round(price, 6).alias("exit_price"), F.round(direction * (price - entry) / F.col("__r"), 6).alias("gross_r"))
