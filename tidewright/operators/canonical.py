"""Outcomes at prices that could be traded: entry at the ask or bid, exit at the other side, one planned risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.market import open_seconds
from tidewright.operators.joins import banded

SIDES = [f"{s}_{p}" for s in ("bid", "ask") for p in ("open", "high", "low", "close")]


def executable_paths(decisions: DataFrame, bars: DataFrame, hours: float) -> DataFrame:
    """Each decision with the completed bid and ask bars of its symbol that begin at or after it and end within `hours` of
    open market time. decisions: decision_id, symbol, ts, ...; bars: symbol, bar_start, at, SIDES."""
    return banded(decisions, bars, ["symbol"], open_seconds("ts"), open_seconds("at"), 0.0, hours * 3600).filter((F.col("bar_start") >= F.col("ts")) & (F.col("__r") > F.col("__l"))).drop("__l", "__r")


def canonical(paths: DataFrame) -> DataFrame:
    """decision_id, points, first_touch, touched_at, exit_executable, exit_mid and the outcome in units of planned risk.

    paths: rows of executable_paths with direction, entry_bid, entry_ask, stop, target1, target2, risk, slippage_r,
    commission_r, financing_r. A long enters at the ask and leaves at the bid, a short the other way round. In each bar,
    in order: an open beyond the stop (sl_gap, at the open), beyond a target (tp2, tp1, at the target), a touch of stop
    and target (ambiguous_sl_tp, at the stop), of the stop, of a target; the first bar with one ends the path, else the
    last close does (terminal). The spread is part of quote_realized_r already: net = quote - other costs, execution
    cost = gross between mids - net. One aggregation by decision, no row lists.
    """
    long = F.col("direction") == "long"
    sign = F.when(long, 1.0).otherwise(-1.0)
    side = lambda p: F.when(long, F.col(f"bid_{p}")).otherwise(F.col(f"ask_{p}"))
    best, worst = F.when(long, F.col("bid_high")).otherwise(F.col("ask_low")), F.when(long, F.col("bid_low")).otherwise(F.col("ask_high"))
    beyond = lambda price, level: sign * (price - F.col(level)) >= 0
    under = lambda price: sign * (price - F.col("stop")) <= 0
    two, one = beyond(best, "target2"), beyond(best, "target1")
    touch = (
        F.when(under(side("open")), "sl_gap").when(beyond(side("open"), "target2"), "tp2_gap").when(beyond(side("open"), "target1"), "tp1_gap")
        .when(under(worst) & (one | two), "ambiguous_sl_tp").when(under(worst), "sl").when(two, "tp2").when(one, "tp1")
    )
    half = (F.col("ask_open") - F.col("bid_open")) / 2
    p = paths.withColumn("touch", touch)
    level = F.when(F.col("touch").startswith("tp2"), F.col("target2")).when(F.col("touch").startswith("tp1"), F.col("target1")).otherwise(F.col("stop"))
    exit_ = F.when(F.col("touch") == "sl_gap", side("open")).when(F.col("touch").isNull(), side("close")).otherwise(level)
    mid = F.when(F.col("touch") == "sl_gap", (F.col("bid_open") + F.col("ask_open")) / 2).when(F.col("touch").isNull(), (F.col("bid_close") + F.col("ask_close")) / 2).otherwise(level + sign * half)
    p = p.withColumn("end", F.struct("touch", F.col("at"), exit_.alias("exit"), mid.alias("mid")))
    fixed = ("symbol", "direction", "entry_bid", "entry_ask", "target1", "target2", "risk", "slippage_r", "commission_r", "financing_r")
    met = F.min_by("end", F.when(F.col("touch").isNotNull(), F.col("at")))
    out = p.groupBy("decision_id").agg(F.coalesce(met, F.max_by("end", "at")).alias("e"), F.count("*").alias("bars"), *[F.first(c).alias(c) for c in fixed])
    entry = F.when(long, F.col("entry_ask")).otherwise(F.col("entry_bid"))
    quote, gross = sign * (F.col("e.exit") - entry) / F.col("risk"), sign * (F.col("e.mid") - (F.col("entry_bid") + F.col("entry_ask")) / 2) / F.col("risk")
    more = F.col("slippage_r") + F.col("commission_r") + F.col("financing_r")
    name = F.regexp_replace(F.coalesce(F.col("e.touch"), F.lit("terminal")), "^(tp[12])_gap$", "$1")
    planned = F.when(name.isin("sl", "sl_gap", "ambiguous_sl_tp"), -1.0).when(name == "tp1", sign * (F.col("target1") - entry) / F.col("risk")).when(name == "tp2", sign * (F.col("target2") - entry) / F.col("risk"))
    r = lambda c: F.round(c, 8)
    return out.select(
        "decision_id", "symbol", "direction", "bars", name.alias("first_touch"), F.col("e.at").alias("holding_end_time"), r(F.col("e.exit")).alias("exit_executable"), r(F.col("e.mid")).alias("exit_mid"), r(quote).alias("quote_realized_r"),
        r(gross).alias("gross_realized_r"), r(planned).alias("planned_payoff_r"), r((F.col("entry_ask") - F.col("entry_bid")) / F.col("risk")).alias("entry_spread_r"), r(more).alias("additional_cost_r"), r(quote - more).alias("realized_net_r"), r(gross - (quote - more)).alias("execution_cost_r"),
    )


def _factor(r: Column) -> Column:
    """Gains over losses: infinite without losses, null without either."""
    win, loss = F.sum(F.when(r > 0, r).otherwise(0.0)), F.sum(F.when(r < 0, -r).otherwise(0.0))
    return F.round(F.when(loss > 0, win / loss).when(win > 0, float("inf")), 8)


def canonical_cells(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Gross and net expectancy and profit factor by cell, with the samples of each and the share that has a net label."""
    g, n = F.col("gross_realized_r"), F.col("realized_net_r")
    return outcomes.groupBy(*by).agg(
        F.count("*").alias("raw_samples"), F.count(g).alias("gross_samples"), F.count(n).alias("net_label_samples"), F.round(F.count(n) / F.count(g), 6).alias("net_label_coverage"),
        F.round(F.avg(g), 6).alias("gross_expectancy_r"), F.round(F.avg(n), 6).alias("net_expectancy_r"), F.round(_factor(g), 4).alias("gross_profit_factor"), F.round(_factor(n), 4).alias("net_profit_factor"),
    )
