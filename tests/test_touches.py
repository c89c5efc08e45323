from __future__ import annotations

from collections import defaultdict
from datetime import UTC

from tidewright.plans import all_queries


def open_seconds(ts) -> float:
    """Market-open seconds as in the SQL of first_touch."""
    s = ts.replace(tzinfo=UTC).timestamp() - 162000
    weeks = s // 604800
    return weeks * 428400 + max(0.0, s - weeks * 604800 - 176400)


def scored(bars: list, b) -> tuple | None:
    """points, first_touch, touched_at, mfe_r, mae_r, realized_r of the decision at bar b's close."""
    s, entry = (1 if b["open_time"].hour % 2 == 0 else -1), b["close"]
    path = [x for x in sorted(bars, key=lambda x: x["close_time"]) if 0 < open_seconds(x["close_time"]) - open_seconds(b["close_time"]) <= 86400]
    if not path:
        return None
    touch, seen, fav, adv = None, 0, [], []
    for x in path:
        best, worst = (x["high"], x["low"]) if s > 0 else (x["low"], x["high"])
        seen += 1
        fav.append(s * (best - entry) / 20)
        adv.append(s * (entry - worst) / 20)
        stop, one, two = s * (worst - entry) <= -20, s * (best - entry) >= 20, s * (best - entry) >= 40
        touch = "ambiguous" if stop and one else "sl" if stop else "tp2" if two else "tp1" if one else None
        if touch:
            break
    end = {"sl": -1.0, "ambiguous": -1.0, "tp2": 2.0, "tp1": 1.0, None: s * (path[-1]["close"] - entry) / 20}[touch]
    return seen, touch or "none", x["close_time"] if touch else None, max(fav), max(0.0, *adv), end


def test_every_bar_is_a_decision(spark, sf_dir):
    bars = all_queries()["bars_1h"](spark, sf_dir).collect()
    by = defaultdict(list)
    for b in bars:
        by[b["symbol"]].append(b)
    want = {f"{b['symbol']}|{b['open_time']:%Y-%m-%d %H}": x for b in bars if (x := scored(by[b["symbol"]], b))}
    got = {r["decision_id"]: tuple(r)[1:] for r in all_queries()["first_touch"](spark, sf_dir).collect()}
    assert len(want) > 0.9 * len(bars)
    assert got.keys() == want.keys()
    for d, (points, touch, at, *shares) in want.items():
        assert got[d][:3] == (points, touch, at)
        assert all(abs(x - y) < 2e-6 for x, y in zip(got[d][3:], shares, strict=True))
    cells = defaultdict(list)
    for d, x in want.items():
        cells[d.split("|")[0], "long" if int(d[-2:]) % 2 == 0 else "short"].append(x)
    rows = all_queries()["expectancy_cells"](spark, sf_dir).collect()
    assert {(r["symbol"], r["direction"]): r["evaluated"] for r in rows} == {k: len(v) for k, v in cells.items()}
    for r in rows:
        assert abs(r["expectancy_r"] - sum(x[5] for x in cells[r["symbol"], r["direction"]]) / r["evaluated"]) < 2e-5
