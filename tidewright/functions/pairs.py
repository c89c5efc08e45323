"""Currency pairs as column expressions: names, pips, conversion to the account's currency, costs and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCOUNT = "USD"
# Usual spread and slippage of a pair in pips, of others, and the hours in which they are wider.
SPREADS, OTHER_SPREAD = {"USDJPY": 0.8, "EURUSD": 0.6, "GBPUSD": 0.9}, 1.0
SLIPPAGE, OTHER_SLIPPAGE = {"USDJPY": 0.2, "EURUSD": 0.1, "GBPUSD": 0.15}, 0.2
WIDE_HOURS = {21: 2.0, 22: 1.5}
PER_MILLION = 30.0


def _looked_up(table: dict, key: Column, other: float) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(other))


def normal(symbol: Column) -> Column:
    """A pair's six letters; null for what isn't a pair."""
    s = F.upper(F.replace(F.trim(symbol), F.lit("/"), F.lit("")))
    return F.when(F.length(s) == 6, s)


def base(symbol: Column) -> Column:
    return F.substring(symbol, 1, 3)


def quote(symbol: Column) -> Column:
    return F.substring(symbol, 4, 3)


def pip(symbol: Column) -> Column:
    return F.when(quote(symbol) == "JPY", 0.01).otherwise(0.0001)


def in_account(symbol: Column, amount: Column, price: Column, rates: Column) -> Column:
    """An amount of the quote currency in the account's currency; rates: map of pair to price; null without a rate."""
    q = quote(symbol)
    there, back = F.try_element_at(rates, F.concat(F.lit(ACCOUNT), q)), F.try_element_at(rates, F.concat(q, F.lit(ACCOUNT)))
    return F.when(q == ACCOUNT, amount).when(base(symbol) == ACCOUNT, amount / price).otherwise(F.coalesce(amount / there, amount * back))


def notional(symbol: Column, units: Column, price: Column, rates: Column) -> Column:
    return F.when(base(symbol) == ACCOUNT, F.abs(units)).otherwise(F.abs(in_account(symbol, F.abs(units) * price, price, rates)))


def pnl(symbol: Column, sign: Column, units: Column, entry: Column, exit_: Column, rates: Column) -> Column:
    return in_account(symbol, sign * units * (exit_ - entry), exit_, rates)


def spread(symbol: Column, hour: Column, own: Column | None = None) -> Column:
    """A bar's spread in pips: its own, else the usual one of the pair at that hour."""
    usual = _looked_up(SPREADS, symbol, OTHER_SPREAD) * _looked_up(WIDE_HOURS, hour, 1.0)
    return usual if own is None else F.coalesce(F.when(own > 0, own), usual)


def slippage(symbol: Column, hour: Column) -> Column:
    return _looked_up(SLIPPAGE, symbol, OTHER_SLIPPAGE) * _looked_up(WIDE_HOURS, hour, 1.0)


def fill(symbol: Column, mid: Column, sign: Column, hour: Column) -> Column:
    """The price of a market order: half the spread and the slippage beyond the mid."""
    return mid + sign * pip(symbol) * (spread(symbol, hour) / 2 + slippage(symbol, hour))


def commission(symbol: Column, units: Column, price: Column, rates: Column, fixed: float = 0.0, least: float = 0.0) -> Column:
    value = notional(symbol, units, price, rates)
    return F.when(units == 0, 0.0).when(value.isNotNull(), F.greatest(value / 1e6 * PER_MILLION + fixed, F.lit(least)))


def round_trip(symbol: Column, price: Column, hour: Column, rates: Column) -> Column:
    """Cost of one unit's entry and exit: spread, twice the slippage, two commissions."""
    market = F.abs(in_account(symbol, pip(symbol) * (spread(symbol, hour) + 2 * slippage(symbol, hour)), price, rates))
    return market + notional(symbol, F.lit(1.0), price, rates) / 1e6 * PER_MILLION * 2


def units(symbol: Column, equity: Column, price: Column, stop: Column, cost: Column, gross: Column, rates: Column, risk: float = 0.01, cap: float = 0.01, leverage: float = 10.0, least_pips: float = 5.0) -> Column:
    """Whole units that risk a share of equity at a stop of at least some pips, within the leverage that is left."""
    each = F.abs(in_account(symbol, F.greatest(stop, pip(symbol) * least_pips), price, rates)) + F.greatest(cost, F.lit(0.0))
    room = F.greatest(F.lit(0.0), equity * leverage - F.greatest(gross, F.lit(0.0))) / notional(symbol, F.lit(1.0), price, rates)
    return F.when(each > 0, F.greatest(F.lit(0.0), F.floor(F.least(equity * min(risk, cap) / each, room)))).otherwise(0.0)
