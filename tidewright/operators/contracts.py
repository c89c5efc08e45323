"""Filters and contracts of rows: date ranges, what was known at a time, and what rules a record breaks."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.quality import flags

# Ranks of an event's impact.
IMPACT = {"low": 1, "medium": 2, "high": 3}
# Names and versions that a net label must carry.
LABEL_VERSIONS, LABEL_SOURCES = ("net-r-v2",), ("paper_quote_model",)
COST_SOURCES = {"fixture-executable-quotes-zero-slippage-v1": ("fixture", "fixture_quotes"), "ibkr-paper-executable-quotes-zero-slippage-v1": ("ibkr_paper_snapshot",)}
COST_STATUS, COST_VERSION, SLIPPAGE_MODEL, COMMISSION_MODEL = "quote_measured_modelled_execution", "1", "zero-slippage-v1", "zero-commission-v1"
#: How far an identity of a label's parts may be off.
CLOSE = 1e-8


def bound(value: str | None, is_end: bool) -> datetime | None:
    """A date or time as a bound; a date alone as an end is the first moment after that day."""
    if value is None:
        return None
    text = value.strip()
    if is_end and re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        return datetime.fromisoformat(text) + timedelta(days=1)
    return datetime.fromisoformat(text)


def in_range(df: DataFrame, ts: str, start: str | None, end: str | None, before: int = 0, after: int = 0, required: bool = True) -> DataFrame:
    """Rows from start to end, both inclusive, widened by minutes before and after; raises if none is left and required."""
    low, high = bound(start, False), bound(end, True)
    out = df
    if low is not None:
        out = out.filter(F.col(ts) >= F.lit((low - timedelta(minutes=before)).isoformat(" ")).cast("timestamp_ntz"))
    if high is not None:
        limit = F.lit((high + timedelta(minutes=after)).isoformat(" ")).cast("timestamp_ntz")
        whole_day = re.fullmatch(r"\s*\d{4}-\d{2}-\d{2}\s*", end or "") is not None
        out = out.filter(F.col(ts) < limit if whole_day else F.col(ts) <= limit)
    if required and (low or high) and not out.head(1):
        raise ValueError("the date range leaves no rows")
    return out


def known_at(df: DataFrame, t: Column, available: str = "available_at") -> DataFrame:
    """Rows that were available at a time; without a known time they weren't."""
    return df.filter(F.col(available) <= t)


def rank(impact: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in IMPACT.items() for x in kv]), F.lower(F.trim(impact))), F.lit(0))


def upcoming(events: DataFrame, now: Column, hours: float, least: str = "low", currencies: list[str] | None = None) -> DataFrame:
    """Events from now until `hours` later of at least an impact, of some currencies or all."""
    out = events.filter((F.col("ts") >= now) & (F.col("ts") <= now + F.make_dt_interval(F.lit(0), F.lit(int(hours)))) & (rank(F.col("impact")) >= IMPACT[least]))
    return out if currencies is None else out.filter(F.col("currency").isin(currencies))


def allowed_time(ts: Column, start: str | None = None, end: str | None = None, closed: tuple[int, ...] = ()) -> Column:
    """Whether entries are allowed at a time: not on closed weekdays (Monday 0), and within hours that may run past midnight."""
    day_ok = ~F.weekday(ts).isin(list(closed)) if closed else F.lit(True)
    if start is None and end is None:
        return day_ok
    a, z, now = start or "00:00:00", end or "23:59:59.999999", F.date_format(ts, "HH:mm:ss.SSSSSS")
    full = lambda s: (s + ":00" * (2 - s.count(":")) + ("" if "." in s else ".000000"))
    a, z = full(a), full(z)
    return day_ok & (((now >= a) & (now <= z)) if a <= z else ((now >= a) | (now <= z)))


def point_in_time(prediction: str, cutoff: str, available: str, ids: list[str], version: Column, sources: str) -> Column:
    """Whether a journal row can be scored: its version is known, cutoff <= latest feature <= prediction, ids and sources there."""
    told = [F.coalesce(F.length(F.trim(F.col(c))) > 0, F.lit(False)) for c in ids]
    out = F.coalesce(version, F.lit(False)) & F.coalesce((F.col(cutoff) <= F.col(available)) & (F.col(available) <= F.col(prediction)), F.lit(False))
    for t in told:
        out = out & t
    return out & F.coalesce(F.exists(sources, lambda s: F.length(F.trim(s)) > 0), F.lit(False))


def only_blocked_by(trace: str, gate: str) -> Column:
    """Whether a decision's gates (array of name, status) that blocked are one name only: the one given."""
    blocked = F.array_distinct(F.transform(F.filter(trace, lambda g: g["status"] == "blocked"), lambda g: g["name"]))
    return (F.size(blocked) == 1) & F.array_contains(blocked, F.lit(gate))


def unguarded(decisions: DataFrame, trace: str = "gate_trace", gate: str = "expectancy_guard") -> DataFrame:
    """Decisions that only one guard blocked, as they stood before it: own id with a suffix, direction and conviction of before."""
    rows = decisions.filter(only_blocked_by(trace, gate) & F.col("pre_guard_direction").isin("long", "short"))
    return rows.withColumns({"parent_decision_id": F.col("decision_id"), "decision_id": F.concat("decision_id", F.lit(":pre-guard")), "direction": F.col("pre_guard_direction"), "conviction": F.col("pre_guard_conviction")})


def quote_faults(received: str = "received", event: str = "event_time", skew: float = 2.0) -> dict[str, Column]:
    """Rules of a collected quote, for flags(): a finite positive book, not from the future, a hash, and what may be missing."""
    ahead = F.col(event).cast("double") - F.col(received).cast("double")
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0) & (F.col(c) < float("inf"))
    return {
        "invalid_bid": ~good("bid"), "invalid_ask": ~good("ask"), "crossed": good("bid") & good("ask") & (F.col("bid") >= F.col("ask")), "future_event_time": F.coalesce(ahead > skew, F.lit(False)),
        "bad_hash": ~F.coalesce(F.col("raw_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "missing_event_time": F.col(event).isNull(), "missing_sequence": F.col("sequence").isNull(),
        "missing_size": F.col("bid_size").isNull() | F.col("ask_size").isNull(),
    }


def signal_faults(target: str = "target", stop: str = "stop_distance", take: str = "take_distance") -> dict[str, Column]:
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    return {"target": ~(finite(target) & F.col(target).isin(-1, 0, 1)), "stop": ~(finite(stop) & (F.col(stop) > 0)), "take": F.col(take).isNotNull() & ~(finite(take) & (F.col(take) > 0))}


def surprise(actual: Column, forecast: Column, error: Column) -> Column:
    """A release's surprise in standard deviations of past forecast errors; null if it can't be told."""
    return F.when(error > 0, (actual - forecast) / error)


def cost_source(source: Column) -> Column:
    """The cost model of a quote source; null for a source without one."""
    out = F.lit(None).cast("string")
    for model, sources in COST_SOURCES.items():
        out = F.when(F.trim(source).isin(*sources), model).otherwise(out)
    return out


def cost_faults() -> dict[str, Column]:
    """Rules of a cost model's columns, for flags()."""
    model, known = F.col("cost_model_id"), F.coalesce(F.col("cost_model_id").isin(*COST_SOURCES), F.lit(False))
    source = lambda c: F.coalesce(cost_source(F.col(c)) == model, F.lit(False))
    zero = lambda c: F.coalesce(F.abs(F.col(c)) <= 1e-12, F.lit(False))
    same = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    return {
        "unknown_cost_model": ~known, "cost_model_entry_source_mismatch": known & ~source("entry_quote_source"), "cost_model_spread_source_mismatch": known & ~source("spread_source"),
        "cost_model_version_mismatch": known & ~same("cost_model_version", COST_VERSION), "cost_status_mismatch": known & ~same("cost_status", COST_STATUS),
        "slippage_model_mismatch": known & ~same("slippage_model_id", SLIPPAGE_MODEL), "commission_model_mismatch": known & ~same("commission_model_id", COMMISSION_MODEL),
        "slippage_model_value_mismatch": known & ~zero("slippage_r"), "commission_model_value_mismatch": known & ~zero("commission_r"), "financing_model_missing": known & ~zero("financing_r"),
        "declared_cost_quality_flag": known & (F.size("cost_quality_flags") > 0),
    }


def label_faults() -> dict[str, Column]:
    """Rules of a persisted net label: that all is there, then that its parts agree. The second kind is judged only where
    the first finds nothing."""
    number = ("entry_bid", "entry_ask", "planned_risk_distance", "quote_realized_r", "gross_realized_r", "entry_spread_r", "slippage_r", "commission_r", "financing_r", "additional_cost_r", "execution_cost_r", "realized_net_r", "path_quality")
    text = ("cost_model_id", "cost_model_version", "cost_status", "entry_quote_source", "spread_source", "slippage_model_id", "commission_model_id")
    empty = lambda c: F.coalesce(F.length(F.trim(F.col(c))) == 0, F.lit(True))
    no = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    other = lambda c, values: ~F.coalesce(F.col(c).isin(*values), F.lit(False))
    symbol = F.regexp_replace(F.upper(F.coalesce("symbol", F.lit(""))), "[/_-]", "")
    there = {
        "net_label_not_eligible": ~F.coalesce(F.col("net_label_eligible"), F.lit(False)), "missing_decision_id": empty("decision_id"), "unknown_label_version": other("label_version", LABEL_VERSIONS),
        "unknown_label_provenance": other("label_provenance", LABEL_SOURCES), "invalid_symbol": ~symbol.rlike("^[A-Z]{6}$"), "invalid_direction": other("direction", ("long", "short")), "missing_timeframe": empty("timeframe"),
        "invalid_horizon_hours": ~F.coalesce(F.col("horizon_hours") > 0, F.lit(False)), "invalid_prediction_time": F.col("prediction_time").isNull(), "invalid_holding_end_time": F.col("holding_end_time").isNull(),
        "invalid_holding_interval": F.coalesce(F.col("holding_end_time") <= F.col("prediction_time"), F.lit(False)),
    } | {f"missing_or_invalid_{c}": no(c) for c in number} | {f"missing_or_invalid_{c}": F.coalesce(F.col(c) == "", F.lit(True)) for c in text} | {"invalid_cost_quality_flags": F.col("cost_quality_flags").isNull()}
    whole = F.lit(True)
    for fault in there.values():
        whole = whole & ~fault
    off = lambda a, b: F.abs(a - b) > CLOSE
    c = F.col
    parts = cost_faults() | {
        "invalid_path_quality": ~((c("path_quality") > 0) & (c("path_quality") <= 1)), "invalid_entry_quote": ~((c("entry_bid") > 0) & (c("entry_bid") <= c("entry_ask"))), "invalid_planned_risk_distance": c("planned_risk_distance") <= 0,
        "entry_spread_r_mismatch": (c("planned_risk_distance") > 0) & off(c("entry_spread_r"), (c("entry_ask") - c("entry_bid")) / F.when(c("planned_risk_distance") > 0, c("planned_risk_distance"))),
        "additional_cost_identity_mismatch": off(c("additional_cost_r"), c("slippage_r") + c("commission_r") + c("financing_r")), "net_r_identity_mismatch": off(c("realized_net_r"), c("quote_realized_r") - c("additional_cost_r")),
        "execution_cost_identity_mismatch": off(c("execution_cost_r"), c("gross_realized_r") - c("realized_net_r")),
    }
    return there | {name: whole & F.coalesce(fault, F.lit(False)) for name, fault in parts.items()}


def with_label_flags(outcomes: DataFrame) -> DataFrame:
    """outcomes with label_flags: the rules of label_faults that each breaks; none: the label may be used."""
    return outcomes.withColumn("label_flags", flags(label_faults()))
