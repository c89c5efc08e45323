"""Market time and prices as column expressions: open seconds, sessions, market days, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weekend runs from Friday 21:00 to Sunday 22:00 UTC, 49 of a week's 168 hours.
WEEK, CLOSED, OPEN = 604_800, 176_400, 428_400
#: Seconds from 1970-01-01 to the first Friday 21:00 UTC.
FIRST_CLOSE = 162_000


def epoch(ts: str | Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, read as UTC, with its fraction."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts) if isinstance(ts, str) else ts) / 1e6


def open_seconds(ts: str) -> Column:
    """Market-open seconds up to a time, from a fixed start: differences are open durations. Closed form, no calendar."""
    s = epoch(ts) - FIRST_CLOSE
    return F.floor(s / WEEK) * OPEN + F.greatest(F.lit(0.0), s - F.floor(s / WEEK) * WEEK - CLOSED)


def market_open(ts: str) -> Column:
    s = epoch(ts) - FIRST_CLOSE
    return s - F.floor(s / WEEK) * WEEK >= CLOSED


def local(ts: str, zone: str) -> Column:
    """Local time, zone-less, of a zone-less UTC timestamp."""
    return F.expr(f"convert_timezone('UTC', '{zone}', {ts})")


def session(ts: str) -> Column:
    """Names of the sessions open at a time, by local working hours; closed where the market is."""
    parts = []
    # Local opening hours, end exclusive.
    for name, zone, start, end in (("tokyo", "Asia/Tokyo", 9, 18), ("london", "Europe/London", 8, 17), ("new_york", "America/New_York", 8, 17)):
        t = local(ts, zone)
        parts.append(F.when((F.weekday(t) < 5) & (F.hour(t) >= start) & (F.hour(t) < end), name))
    names = F.concat_ws("+", *parts)
    return F.when(~market_open(ts), "closed").when(names == "", "off_session").otherwise(names)


def market_day(ts: str) -> Column:
    """The trading day, which rolls at 17:00 in New York."""
    return F.to_date(local(ts, "America/New_York") + F.expr("interval 7 hours"))


def rounded(x: Column, digits: int) -> Column:
    """x rounded as SQL does: scaled, to the nearest whole, scaled back. round(x, digits) goes by x's decimals, where 0.40549999999999997 is under the half."""
    return F.round(x * 10.0**digits) / 10.0**digits


def signed(direction: Column, move: Column) -> Column:
    return F.when(direction == "long", move).when(direction == "short", -move)


def outcome(move: Column, atr: Column, fraction: float = 0.1) -> Column:
    """hit, miss or flat of a signed move against a share of the average range (none: 0)."""
    limit = F.coalesce(F.when(atr > 0, fraction * atr), F.lit(0.0))
    return F.when(move > limit, "hit").when(move < -limit, "miss").otherwise("flat")
