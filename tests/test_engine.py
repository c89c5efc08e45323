"""The simulation against a plain account that goes through all times and symbols in turn."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest

from tidewright.operators import simulate

SCHEMA = "run string, at timestamp_ntz, symbol string, open double, high double, low double, close double, target int, stop_distance double, take_distance double, no_trade boolean"
SPREAD, SLIP = {"EURUSD": 0.6, "USDJPY": 0.8, "GBPUSD": 0.9}, {"EURUSD": 0.1, "USDJPY": 0.2, "GBPUSD": 0.15}


def to_usd(symbol, amount, price, prices):
    if symbol.endswith("USD"):
        return amount
    if symbol.startswith("USD"):
        return amount / price
    return amount * prices[symbol[3:] + "USD"]


def value(symbol, units, price, prices):
    return units if symbol.startswith("USD") else abs(to_usd(symbol, units * price, price, prices))


def plain(rows, daily=0.02, cooldown=0):
    """Trades as (symbol, entry_time, exit_time, units, net, reason)."""
    times = sorted({r[1] for r in rows})
    last_of = {s: max(r[1] for r in rows if r[2] == s) for s in {r[2] for r in rows}}
    cash, held, orders, price, out = 100_000.0, {}, [], {}, []
    day = day_equity = None
    locked = broke = False
    cool = {}

    def half(s, at):
        wide = {21: 2.0, 22: 1.5}.get(at.hour, 1.0)
        pip = 0.01 if s.endswith("JPY") else 0.0001
        return pip, SPREAD.get(s, 1.0) * wide, SLIP.get(s, 0.2) * wide

    def worth():
        return cash + sum(to_usd(s, p[0] * p[1] * (price[s] - p[2]), price[s], price) for s, p in held.items() if s in price)

    def leave(s, at, mid, reason, prices):
        nonlocal cash
        sign, units, entry, _, _, fee, since, _ = held.pop(s)
        pip, sp, sl = half(s, at)
        fill = mid - sign * pip * (sp / 2 + sl)
        own = value(s, units, fill, prices) / 1e6 * 30
        gross = to_usd(s, sign * units * (fill - entry), fill, prices)
        cash += gross - own
        out.append((s, since, at, units, round(gross - fee - own, 4), reason))

    def locks(at):
        nonlocal locked, broke
        e = worth()
        if e <= day_equity * (1 - daily):
            locked = True
        if locked:
            for s in held:
                if not any(o[0] == s and o[1] == 0 for o in orders):
                    orders.append((s, 0, at, "daily_loss_stop", 0, 0))
        if e <= 0 or sum(value(s, p[1], price[s], price) for s, p in held.items()) > 10 * e:
            broke = True
        if broke:
            for s in held:
                if not any(o[0] == s and o[1] == 0 for o in orders):
                    orders.append((s, 0, at, "gross_leverage_breach", 0, 0))

    for at in times:
        now = {r[2]: r for r in sorted(rows, key=lambda r: r[2]) if r[1] == at}
        cool = {s: n - 1 for s, n in cool.items() if n - 1 > 0}
        at_open = price | {s: r[3] for s, r in now.items()}
        wait = []
        for o in orders:
            s, sign, asked, reason, stop, take = o
            if sign and at - asked > timedelta(hours=24):
                continue
            if s not in now:
                wait.append(o)
            elif not sign:
                if s in held:
                    leave(s, at, now[s][3], reason, at_open)
            elif s not in held:
                e = worth()
                if now[s][10] or (locked and at.date() == day) or broke or e <= 0:
                    # a lock of an earlier day has ended with it
                    if now[s][10] or broke or e <= 0 or at.date() == day:
                        continue
                if at.date() != day:
                    day, day_equity, locked = at.date(), e, False
                pip, sp, sl = half(s, at)
                mid = now[s][3]
                fill = mid + sign * pip * (sp / 2 + sl)
                stop = max(stop, 5 * pip)
                each = abs(to_usd(s, stop, fill, at_open)) + abs(to_usd(s, pip * (sp + 2 * sl), mid, at_open)) + value(s, 1.0, mid, at_open) / 1e6 * 60
                room = max(0.0, 10 * e - sum(value(x, p[1], price.get(x, p[2]), at_open) for x, p in held.items())) / value(s, 1.0, fill, at_open)
                units = float(int(min(e * 0.01 / each, room)))
                if units > 0:
                    fee = value(s, units, fill, at_open) / 1e6 * 30
                    cash -= fee
                    held[s] = (sign, units, fill, fill - sign * stop, fill + sign * take if take else None, fee, at, asked)
        orders = wait
        for s, r in now.items():
            price[s] = r[6]
        e = worth()
        if at.date() != day:
            day, day_equity, locked = at.date(), e, False
        stopped = set()
        in_bar = price | {s: r[3] for s, r in now.items()}
        for s, r in now.items():
            if s in held:
                sign, _, _, stop, take = held[s][:5]
                pip, sp, sl = half(s, at)
                extra = pip * (sp / 2 + sl)
                if sign > 0 and r[5] <= stop or sign < 0 and r[4] >= stop:
                    leave(s, at, (min if sign > 0 else max)(stop, r[3]), "stop_loss", in_bar)
                    stopped.add(s)
                elif take and (sign > 0 and r[4] >= take + extra or sign < 0 and r[5] <= take - extra):
                    leave(s, at, take, "take_profit", in_bar)
        for s in stopped:
            if cooldown:
                cool[s] = max(cool.get(s, 0), cooldown + 1)
        locks(at)
        want = []
        for s, r in now.items():
            if s in held and (r[7] == 0 or r[7] == -held[s][0]) and not any(o[0] == s and o[1] == 0 for o in orders):
                orders.append((s, 0, at, "signal_exit", 0, 0))
            if r[7] and (s not in held or r[7] == -held[s][0]):
                want.append(s)
        locks(at)
        for s in want:
            r = now[s]
            if s in held and not any(o[0] == s and o[1] == 0 for o in orders):
                continue
            if s in stopped or s in cool or any(o[0] == s and o[1] for o in orders) or r[10] or locked or broke or worth() <= 0:
                continue
            orders.append((s, r[7], at, "", r[8], r[9]))
        at_close = price | {s: r[6] for s, r in now.items()}
        for s, r in now.items():
            if at == last_of[s] and s in held:
                leave(s, at, r[6], "end_of_backtest" if at == times[-1] else "end_of_symbol_data", at_close)
                orders = [o for o in orders if o[0] != s]
    return sorted(out)


def random_bars(seed, hours=400):
    rng = np.random.default_rng(seed)
    rows = []
    for symbol, base, move in (("EURUSD", 1.1, 0.004), ("USDJPY", 150.0, 0.5), ("EURGBP", 0.85, 0.003), ("GBPUSD", 1.3, 0.005)):
        p = base
        n = hours - int(rng.integers(0, 60))
        target = 0
        for h in range(n):
            at = datetime(2024, 1, 1) + timedelta(hours=h)
            o = p + rng.normal(0, move / 4)
            c = o + rng.normal(0, move)
            hi, lo = max(o, c) + abs(rng.normal(0, move / 2)), min(o, c) - abs(rng.normal(0, move / 2))
            p = c
            if rng.random() < 0.15:
                target = int(rng.integers(-1, 2))
            if rng.random() < 0.1:
                continue
            take = float(3 * move) if rng.random() < 0.7 else None
            rows.append(("r", at, symbol, o, hi, lo, c, target, 2 * move, take, bool(rng.random() < 0.05)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trades_equal_a_plain_account(spark, seed):
    rows = random_bars(seed)
    df = spark.createDataFrame([*rows, *[("other", *r[1:]) for r in rows]], SCHEMA).repartition(3)
    for s, more in ((simulate.Settings(), {}), (simulate.Settings(daily_loss=0.004, cooldown_bars=3), {"daily": 0.004, "cooldown": 3})):
        got = simulate.simulate(df, s).collect()
        want = plain(rows, **more)
        for run in ("r", "other"):
            mine = sorted((r["symbol"], r["entry_time"], r["exit_time"], r["units"], round(r["net_pnl"], 4), r["exit_reason"]) for r in got if r["run"] == run)
            assert len(mine) > 30
            assert [x[:4] + x[5:] for x in mine] == [x[:4] + x[5:] for x in want]
            assert all(abs(x[4] - y[4]) < 2e-3 for x, y in zip(mine, want, strict=True))
    reasons = {r["exit_reason"] for r in got}
    assert {"stop_loss", "signal_exit", "daily_loss_stop"} <= reasons


def test_a_reversal_leaves_at_the_open(spark):
    bars = [(10.0, 10.0, 10.0, 10.0, 1), (10.0, 10.3, 9.9, 10.1, -1), (10.2, 10.3, 8.0, 8.1, 0), (8.1, 8.2, 8.0, 8.1, 0)]
    rows = [("r", datetime(2024, 1, 1, h), "EURUSD", o, hi, lo, c, t, 1.0, 2.0, False) for h, (o, hi, lo, c, t) in enumerate(bars)]
    first = simulate.simulate(spark.createDataFrame(rows, SCHEMA)).orderBy("exit_time").first()
    assert (first["exit_reason"], first["exit_mid"], first["exit_time"].hour) == ("signal_exit", 10.2, 2)


def test_limits(spark):
    rows = random_bars(3, 300)
    df = spark.createDataFrame(rows, SCHEMA)
    curve = simulate.simulate(df, simulate.Settings(weekly_loss=0.01), equity=True).orderBy("at").collect()
    assert len(curve) == len({r[1] for r in rows})
    assert any(r["locked"] for r in curve)
    assert max(r["open_positions"] for r in simulate.simulate(df, simulate.Settings(most_positions=1), equity=True).collect()) == 1
    trades = simulate.simulate(df, simulate.Settings(closed_weekdays=(0,), most_units=1000)).collect()
    assert all(t["signal_time"].weekday() != 0 and t["units"] <= 1000 for t in trades)
    free = simulate.simulate(df).collect()
    dear = simulate.simulate(df, simulate.Settings(cost_factor=3)).collect()
    assert sum(t["net_pnl"] for t in dear) < sum(t["net_pnl"] for t in free)
    with pytest.raises(Exception, match="stop distance"):
        simulate.simulate(spark.createDataFrame([(*r[:8], 0.0, None, False) for r in rows], SCHEMA)).collect()
