"""An event-driven portfolio simulation, many runs at a time: one run a key, rows streamed in order of time."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, time, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.folds import fold

TRADES = (
    "run string, symbol string, direction string, signal_time timestamp_ntz, entry_time timestamp_ntz, exit_time timestamp_ntz, units double, entry_mid double, entry double, exit_mid double, exit double, "
    "spread_pips double, slippage_pips double, stop double, take double, gross_pnl double, fees double, net_pnl double, initial_risk double, r_multiple double, exit_reason string, cash double"
)
EQUITY = "run string, at timestamp_ntz, cash double, equity double, open_positions int, locked boolean"
ACCOUNT = "USD"


@dataclass(frozen=True)
class Settings:
    """Costs, limits and rules. None: no such rule. Shares are of equity; pips are 0.01 of a yen quote, else 0.0001."""

    cash: float = 100_000.0
    # Usual spreads, slippage and commission, and the hours in which they are wider.
    spread_pips: dict = field(default_factory=lambda: {"USDJPY": 0.8, "EURUSD": 0.6, "GBPUSD": 0.9})
    slippage_pips: dict = field(default_factory=lambda: {"USDJPY": 0.2, "EURUSD": 0.1, "GBPUSD": 0.15})
    other_spread: float = 1.0
    other_slippage: float = 0.2
    hour_factors: dict = field(default_factory=lambda: {21: 2.0, 22: 1.5})
    cost_factor: float = 1.0
    per_million: float = 30.0
    fixed_fee: float = 0.0
    least_fee: float = 0.0
    risk: float = 0.01
    risk_cap: float = 0.01
    daily_loss: float = 0.02
    weekly_loss: float | None = None
    monthly_drawdown: float | None = None
    monthly_target: float | None = None
    hard_drawdown: float | None = None
    least_stop_pips: float = 5.0
    leverage: float = 10.0
    currency_share: float | None = None
    most_units: float | None = None
    fractional: bool = False
    most_positions: int | None = None
    cooldown_bars: int = 0
    trading_start: time | None = None
    trading_end: time | None = None
    closed_weekdays: tuple[int, ...] = ()
    rates: dict = field(default_factory=dict)
    order_hours: float | None = 24.0
    close_on_daily_loss: bool = True
    close_on_stop: bool = True
    close_at_end: bool = True


def pip(symbol: str) -> float:
    return 0.01 if symbol[3:6] == "JPY" else 0.0001


def in_account(symbol: str, amount: float, price: float, rates: dict) -> float:
    """An amount of a pair's quote currency in the account's; an error where no rate leads there."""
    base, quote = symbol[:3], symbol[3:6]
    if quote == ACCOUNT:
        return amount
    if base == ACCOUNT:
        return amount / price
    if rate := rates.get(ACCOUNT + quote):
        return amount / rate
    if rate := rates.get(quote + ACCOUNT):
        return amount * rate
    raise ValueError(f"no rate for {quote}")


def notional(symbol: str, units: float, price: float, rates: dict) -> float:
    return abs(units) if symbol[:3] == ACCOUNT else abs(in_account(symbol, abs(units) * price, price, rates))


class Locks:
    """What forbids new positions: losses since a day, week or month began, a month's target, and breaches for good."""

    def __init__(self, s: Settings):
        self.s, self.start, self.peak, self.high = s, {}, 0.0, 0.0
        self.on: set[str] = set()

    def see(self, at: datetime, equity: float) -> None:
        for name, period in (("day", at.date()), ("week", tuple(at.isocalendar()[:2])), ("month", (at.year, at.month))):
            if self.start.get(name, (None,))[0] != period:
                self.start[name] = (period, equity)
                self.on -= {"day": {"daily"}, "week": {"weekly"}, "month": {"monthly", "target"}}[name]
                if name == "month":
                    self.peak = equity
        self.peak, self.high = max(self.peak, equity), max(self.high, equity)

    def daily(self, at: datetime, equity: float) -> bool:
        self.see(at, equity)
        if equity <= self.start["day"][1] * (1 - self.s.daily_loss):
            self.on.add("daily")
        return "daily" in self.on

    def stops(self, at: datetime, equity: float, gross: float) -> str | None:
        """The last rule that is broken now, if any."""
        self.see(at, equity)
        s, found = self.s, []
        rules = (
            ("weekly", "weekly_loss_stop", s.weekly_loss, lambda x: equity <= self.start["week"][1] * (1 - x)),
            ("monthly", "monthly_drawdown_stop", s.monthly_drawdown, lambda x: equity <= self.peak * (1 - x)),
            ("target", "monthly_profit_target", s.monthly_target, lambda x: equity >= self.start["month"][1] * (1 + x)),
            ("hard", "hard_drawdown_stop", s.hard_drawdown, lambda x: equity <= self.high * (1 - x)),
        )
        for lock, reason, limit, broken in rules:
            if limit is not None and broken(limit):
                self.on.add(lock)
                found.append(reason)
        if equity <= 0 or gross > equity * s.leverage:
            self.on.add("leverage")
        if "leverage" in self.on:
            found.append("gross_leverage_breach")
        return found[-1] if found else None

    def may_open(self, at: datetime, equity: float) -> bool:
        self.see(at, equity)
        return not self.on and equity > 0


class Book:
    """One run's account. bars() takes all symbols' bars of one time and gives back the trades that ended."""

    def __init__(self, s: Settings):
        self.s, self.cash, self.locks = s, s.cash, Locks(s)
        self.open: dict[str, dict] = {}
        self.orders: list[dict] = []
        self.last: dict[str, float] = {}
        self.cooling: dict[str, int] = {}

    # money

    def pips(self, row) -> tuple[float, float]:
        """(spread, slippage) of a bar: its own spread if it has one, else the usual one, both wider at some hours."""
        s = self.s
        wide = s.hour_factors.get(row.at.hour, 1.0)
        own = getattr(row, "spread_pips", None)
        spread = own if own is not None and own == own else s.spread_pips.get(row.symbol, s.other_spread) * wide
        return spread * s.cost_factor, s.slippage_pips.get(row.symbol, s.other_slippage) * wide * s.cost_factor

    def cost(self, row) -> float:
        spread, slippage = self.pips(row)
        return pip(row.symbol) * (spread / 2 + slippage)

    def fee(self, symbol: str, units: float, price: float, rates: dict) -> float:
        s = self.s
        return max(notional(symbol, units, price, rates) / 1e6 * s.per_million * s.cost_factor + s.fixed_fee, s.least_fee) if units else 0.0

    def rates(self, rows: dict, column: str) -> dict:
        return self.s.rates | self.last | {k: getattr(r, column) for k, r in rows.items()}

    def equity(self) -> float:
        rates = self.s.rates | self.last
        gain = lambda k, p: in_account(k, p["sign"] * p["units"] * (self.last[k] - p["entry"]), self.last[k], rates)
        return self.cash + sum(gain(k, p) for k, p in self.open.items() if k in self.last)

    def gross(self, rates: dict) -> float:
        return sum(notional(k, p["units"], self.last.get(k, p["entry"]), rates) for k, p in self.open.items())

    def exposed(self, symbol: str, sign: int, units: float, price: float, rates: dict) -> float:
        """The largest exposure to a currency, were this position opened."""
        held: dict[str, float] = {}
        rows = [(k, p["sign"], p["units"], self.last.get(k, p["entry"])) for k, p in self.open.items()] + [(symbol, sign, units, price)]
        for k, way, n, at in rows:
            value = way * notional(k, n, at, rates)
            held[k[:3]] = held.get(k[:3], 0.0) + value
            held[k[3:6]] = held.get(k[3:6], 0.0) - value
        return max(map(abs, held.values()))

    # orders

    def ask_close(self, symbol: str, at: datetime, reason: str) -> None:
        if not any(o["symbol"] == symbol and not o["sign"] for o in self.orders):
            self.orders.append({"symbol": symbol, "sign": 0, "at": at, "reason": reason})

    def close(self, row, mid: float, reason: str, rates: dict) -> tuple:
        p = self.open.pop(row.symbol)
        price = mid - p["sign"] * self.cost(row)
        fee = self.fee(row.symbol, p["units"], price, rates)
        gross = in_account(row.symbol, p["sign"] * p["units"] * (price - p["entry"]), price, rates)
        net = gross - p["fee"] - fee
        self.cash += gross - fee
        spread, slippage = p["pips"]
        return (
            row.run, row.symbol, "long" if p["sign"] > 0 else "short", p["signal"], p["since"], row.at, p["units"], p["mid"], round(p["entry"], 8), mid, round(price, 8),
            spread, slippage, round(p["stop"], 8), None if p["take"] is None else round(p["take"], 8), round(gross, 6), round(p["fee"] + fee, 6), round(net, 6), round(p["risk"], 6), round(net / p["risk"], 6) if p["risk"] else 0.0, reason, round(self.cash, 6),
        )

    def size(self, row, sign: int, stop: float, equity: float, rates: dict) -> tuple[float, float, float]:
        """(units, distance of the stop, risk in money) of an entry at a bar's open."""
        s, k = self.s, row.symbol
        price = row.open + sign * self.cost(row)
        spread, slippage = self.pips(row)
        stop = max(stop, pip(k) * s.least_stop_pips)
        trip = abs(in_account(k, pip(k) * (spread + 2 * slippage), row.open, rates)) + notional(k, 1.0, row.open, rates) / 1e6 * s.per_million * s.cost_factor * 2
        each = abs(in_account(k, stop, price, rates)) + trip
        fixed = 2 * max(s.fixed_fee, s.least_fee, 0.0)
        budget = equity * min(s.risk, s.risk_cap)
        if each <= 0 or budget <= fixed:
            return 0.0, stop, 0.0
        room = max(0.0, equity * s.leverage - self.gross(rates)) / notional(k, 1.0, price, rates)
        units = min((budget - fixed) / each, room, s.most_units if s.most_units is not None else float("inf"))
        units = units if s.fractional else float(int(units))
        return (units, stop, units * each + fixed) if units > 0 else (0.0, stop, 0.0)

    def fill(self, at: datetime, rows: dict) -> list[tuple]:
        """Orders of earlier bars at this one's open, in their order; those without a bar wait, entries not for ever."""
        s, rates, waiting, out = self.s, self.rates(rows, "open"), [], []
        for o in self.orders:
            k = o["symbol"]
            if o["sign"] and s.order_hours is not None and at - o["at"] > timedelta(hours=s.order_hours):
                continue
            if k not in rows:
                waiting.append(o)
                continue
            row = rows[k]
            if not o["sign"]:
                if k in self.open:
                    out.append(self.close(row, row.open, o["reason"], rates))
                continue
            if k in self.open:
                continue
            equity = self.equity()
            if getattr(row, "no_trade", False) or not self.locks.may_open(at, equity) or (s.most_positions is not None and len(self.open) >= s.most_positions):
                continue
            units, stop, risk = self.size(row, o["sign"], o["stop"], equity, rates)
            price = row.open + o["sign"] * self.cost(row)
            if units <= 0 or risk <= 0 or (s.currency_share is not None and self.exposed(k, o["sign"], units, price, rates) > equity * s.currency_share):
                continue
            fee = self.fee(k, units, price, rates)
            self.cash -= fee
            take = price + o["sign"] * o["take"] if o["take"] else None
            self.open[k] = {"sign": o["sign"], "units": units, "entry": price, "mid": row.open, "fee": fee, "stop": price - o["sign"] * stop, "take": take, "risk": risk, "signal": o["at"], "since": at, "pips": self.pips(row)}
        self.orders = waiting
        return out

    def price_exits(self, rows: dict) -> list[tuple]:
        """Stops, at the open if it is beyond, and targets that the bar passes by more than the costs; a stop wins."""
        rates, out = self.rates(rows, "open"), []
        for k, row in rows.items():
            p = self.open.get(k)
            if p is None:
                continue
            up = p["sign"] > 0
            if (row.low <= p["stop"]) if up else (row.high >= p["stop"]):
                beyond = row.open <= p["stop"] if up else row.open >= p["stop"]
                out.append(self.close(row, row.open if beyond else p["stop"], "stop_loss", rates))
            elif p["take"] is not None and ((row.high >= p["take"] + self.cost(row)) if up else (row.low <= p["take"] - self.cost(row))):
                out.append(self.close(row, p["take"], "take_profit", rates))
        return out

    def check(self, at: datetime) -> None:
        s, equity = self.s, self.equity()
        if self.locks.daily(at, equity) and s.close_on_daily_loss:
            for k in list(self.open):
                self.ask_close(k, at, "daily_loss_stop")
        reason = self.locks.stops(at, self.equity(), self.gross(s.rates | self.last))
        if reason and s.close_on_stop:
            for k in list(self.open):
                self.ask_close(k, at, reason)

    def in_hours(self, at: datetime) -> bool:
        s = self.s
        if at.weekday() in s.closed_weekdays:
            return False
        start, end, now = s.trading_start or time.min, s.trading_end or time.max, at.time()
        return start <= now <= end if start <= end else now >= start or now <= end

    def signals(self, at: datetime, rows: dict, stopped: set[str]) -> None:
        wanted = {}
        for k, row in rows.items():
            p = self.open.get(k)
            if p and row.target in (0, -p["sign"]):
                self.ask_close(k, at, "signal_exit")
            if row.target and (p is None or row.target == -p["sign"]):
                wanted[k] = row
        self.check(at)
        for k, row in wanted.items():
            closing = any(o["symbol"] == k and not o["sign"] for o in self.orders)
            opening = any(o["symbol"] == k and o["sign"] for o in self.orders)
            full = self.s.most_positions is not None and len(self.open) >= self.s.most_positions
            if (k in self.open and not closing) or k in stopped or opening or k in self.cooling or full or not self.in_hours(at):
                continue
            if getattr(row, "no_trade", False) or not getattr(row, "entry_allowed", True) or not self.locks.may_open(at, self.equity()):
                continue
            take = row.take_distance
            self.orders.append({"symbol": k, "sign": int(row.target), "at": at, "reason": "signal_entry", "stop": float(row.stop_distance), "take": float(take) if take is not None and take == take and take > 0 else None})

    def bars(self, at: datetime, rows: dict, last: bool) -> list[tuple]:
        self.cooling = {k: n - 1 for k, n in self.cooling.items() if n > 1}
        out = self.fill(at, rows)
        self.last |= {k: r.close for k, r in rows.items()}
        self.locks.see(at, self.equity())
        exits = self.price_exits(rows)
        stopped = {x[1] for x in exits if x[20] == "stop_loss"}
        if self.s.cooldown_bars:
            self.cooling |= {k: max(self.cooling.get(k, 0), self.s.cooldown_bars + 1) for k in stopped}
        self.check(at)
        self.signals(at, rows, stopped)
        if self.s.close_at_end:
            rates = self.rates(rows, "close")
            for k, row in rows.items():
                if row.is_last and k in self.open:
                    exits.append(self.close(row, row.close, "end_of_backtest" if last else "end_of_symbol_data", rates))
                    self.orders = [o for o in self.orders if o["symbol"] != k]
        return out + exits


def simulate(bars: DataFrame, settings: Settings | None = None, equity: bool = False) -> DataFrame:
    """Trades of each run (TRADES), or with equity the account after each time (EQUITY).

    bars: run, at, symbol (six letters), open, high, low, close, target (-1, 0, 1), stop_distance, take_distance, and if
    there spread_pips, no_trade, entry_allowed. All symbols' bars of one time are one step: orders of earlier steps fill
    at the open, stops and targets within the bar follow (a stop first), then losses are checked, signals become orders
    for the next bar, and each symbol's position ends with its last bar. Equity marks open positions to the last close.
    A signal without a stop distance above 0 is an error. Runs are independent and run in parallel; one run is
    sequential by nature and holds its open positions and one time's bars only.
    """
    s = settings or Settings()
    last = F.lead("at").over(Window.partitionBy("run", "symbol").orderBy("at")).isNull()

    def start() -> dict:
        return {"book": Book(s), "at": None, "rows": {}}

    def done(state: dict, final: bool) -> list[tuple]:
        if not state["rows"]:
            return []
        book, rows = state["book"], state["rows"]
        trades = book.bars(state["at"], rows, final)
        state["rows"] = {}
        if not equity:
            return trades
        run = next(iter(rows.values())).run
        return [(run, state["at"], round(book.cash, 6), round(book.equity(), 6), len(book.open), bool(book.locks.on))]

    def step(state: dict, row: tuple) -> list[tuple]:
        if row.target and not row.stop_distance > 0:
            raise ValueError(f"{row.symbol}: a signal needs a stop distance")
        out = done(state, False) if row.at != state["at"] else []
        state["at"] = row.at
        state["rows"][row.symbol] = row
        return out

    return fold(bars.withColumn("is_last", last), ["run"], ["at", "symbol"], start, step, EQUITY if equity else TRADES, lambda state: done(state, True))


def effective(intervals: DataFrame, by: list[str], gap_seconds: float = 300.0) -> DataFrame:
    """Greedy choice of intervals that don't depend on one another: rows that share a currency with a chosen one must
    start the gap after its end. intervals: id, start, end, currencies (list); state is the last end by currency."""

    def step(state: dict, row: tuple) -> list[tuple]:
        free = all(c not in state or (row.start - state[c]).total_seconds() >= gap_seconds for c in row.currencies)
        if not free:
            return []
        for c in row.currencies:
            state[c] = max(state[c], row.end) if c in state else row.end
        return [(*[getattr(row, k) for k in by], row.id)]

    kinds = ", ".join(f"{k} {intervals.schema[k].dataType.simpleString()}" for k in by)
    return fold(intervals, by, ["start", "end", "id"], dict, step, f"{kinds}, id long")
