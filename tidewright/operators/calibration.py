"""Calibrators of probabilities, fitted on a window of their own and chosen on a later one.

Fits gather what they need by distinct score: label sums and counts. That is bounded by the scores' resolution, which is
rounded to SCORES steps, not by the rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps that scores are rounded to for a fit; least probability.
SCORES, EPS = 10_000, 1e-6


def _gathered(df: DataFrame, p: str, y: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy((F.round(F.col(p) * SCORES) / SCORES).alias("p")).agg(F.sum(y).alias("s"), F.count("*").alias("n")).orderBy("p").collect()
    if not rows or not 0 < sum(r["s"] for r in rows) < sum(r["n"] for r in rows):
        raise ValueError("both classes are needed")
    return tuple(np.array([float(r[c]) for r in rows]) for c in ("p", "s", "n"))


def _logistic(x: np.ndarray, s: np.ndarray, n: np.ndarray, start: np.ndarray, positive: int, ridge: float = 1e-6, rounds: int = 100) -> np.ndarray:
    """Newton steps for grouped labels, halved where the fit gets worse; the first `positive` coefficients stay at 0 or above."""

    def loss(b: np.ndarray) -> float:
        m = x @ b
        return float((n * np.logaddexp(0, m) - s * m).sum() + ridge * (b @ b))

    b = start.astype(float)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -35, 35)))
        free = np.ones(len(b), bool)
        g = x.T @ (n * q - s) + 2 * ridge * b
        free[:positive] = (b[:positive] > 0) | (g[:positive] < 0)
        h = (x * (n * q * (1 - q))[:, None]).T @ x + 2 * ridge * np.eye(len(b))
        step = np.zeros(len(b))
        step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
        scale, best = 1.0, loss(b)
        while scale > 1e-6:
            new = b - scale * step
            new[:positive] = np.maximum(new[:positive], 0)
            if loss(new) <= best:
                break
            scale /= 2
        if np.abs(new - b).max() < 1e-10:
            break
        b = new
    return b


def platt(df: DataFrame, p: str, y: str) -> dict:
    x, s, n = _gathered(df, p, y)
    x = np.clip(x, EPS, 1 - EPS)
    a, b = _logistic(np.column_stack([np.log(x / (1 - x)), np.ones(len(x))]), s, n, np.array([1.0, 0.0]), 1)
    return {"method": "platt", "scale": float(a), "offset": float(b)}


def beta(df: DataFrame, p: str, y: str) -> dict:
    x, s, n = _gathered(df, p, y)
    x = np.clip(x, EPS, 1 - EPS)
    a, b, c = _logistic(np.column_stack([np.log(x), -np.log1p(-x), np.ones(len(x))]), s, n, np.array([1.0, 1.0, 0.0]), 2)
    return {"method": "beta", "a": float(a), "b": float(b), "offset": float(c)}


def isotonic(df: DataFrame, p: str, y: str) -> dict:
    """Pooled neighbours: steps (upper bound, value) that never fall."""
    pools: list[list[float]] = []
    for x, s, n in zip(*_gathered(df, p, y), strict=True):
        pools.append([x, s, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] > pools[-1][1] * pools[-2][2]:
            x, s, n = pools.pop()
            pools[-1] = [x, pools[-1][1] + s, pools[-1][2] + n]
    return {"method": "isotonic", "upper": [float(k[0]) for k in pools], "values": [float(np.clip(k[1] / k[2], EPS, 1 - EPS)) for k in pools]}


def calibrated(p: Column, fit: dict) -> Column:
    """A fit applied to a column of probabilities, within the engine."""
    x = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))
    if fit["method"] == "isotonic":
        upper, values = (F.array(*map(F.lit, fit[k])) for k in ("upper", "values"))
        at = F.size(F.filter(upper, lambda u: u < p)) + 1
        return F.when(p.isNotNull(), F.element_at(values, F.least(at, F.size(values))))
    margin = fit["scale"] * F.ln(x / (1 - x)) + fit["offset"] if fit["method"] == "platt" else fit["a"] * F.ln(x) - fit["b"] * F.log1p(-x) + fit["offset"]
    return 1 / (1 + F.exp(-margin))


def chosen(fit_on: DataFrame, choose_on: DataFrame, p: str, y: str, ts: str, methods: tuple[str, ...] = ("beta", "isotonic", "platt")) -> dict:
    """The fit of least log-loss, then Brier score, then name on choose_on, all of which must be later than fit_on."""
    last, first = fit_on.agg(F.max(ts)).first()[0], choose_on.agg(F.min(ts)).first()[0]
    if last is None or first is None or not last < first:
        raise ValueError("the fit's window must end before the choice's")
    fits = [{"platt": platt, "beta": beta, "isotonic": isotonic}[m](fit_on, p, y) for m in methods]
    label = F.col(y)
    scores = []
    for f in fits:
        c = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), calibrated(F.col(p), f)))
        scores += [F.avg(-(label * F.ln(c) + (1 - label) * F.ln(1 - c))), F.avg((c - label) ** 2)]
    row = choose_on.agg(*scores).first()
    return min(zip(zip(row[::2], row[1::2], methods, strict=True), fits, strict=True), key=lambda x: x[0])[1]
