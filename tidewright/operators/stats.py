"""Statistics by group: drift, ranking, intervals, multiple tests, Sharpe ratios, overfitting, resampling."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Euler's constant.
GAMMA = 0.5772156649015329


def auc(df: DataFrame, by: list[str], p: str, y: str) -> DataFrame:
    """Area under the curve by key from mid-ranks of distinct scores: counts by score first, then one window over them."""
    per = df.groupBy(*by, p).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    w = Window.partitionBy(*by).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    n, m = F.sum("pos"), F.sum("neg")
    return per.groupBy(*by).agg(n.alias("positives"), m.alias("negatives"), F.round(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / (n * m), 6).alias("auc"))


def ks(df: DataFrame, by: list[str], value: str, group: str) -> DataFrame:
    """Largest difference of the two distribution functions (group 0 and 1) by key."""
    per = df.groupBy(*by, value).agg(F.count_if(F.col(group) == 0).alias("a"), F.count_if(F.col(group) == 1).alias("b"))
    w, all_ = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by)
    d = F.abs(F.sum("a").over(w) / F.sum("a").over(all_) - F.sum("b").over(w) / F.sum("b").over(all_))
    return per.withColumn("d", d).groupBy(*by).agg(F.round(F.max("d"), 6).alias("ks"))


def quantiles(per: DataFrame, by: list[str], value: str, count: str, shares: list[float]) -> DataFrame:
    """by, q: linear quantiles at `shares` (ascending) by key, from one row a distinct value with its count.

    Ranks are read off a running count over the distinct values; no buffer holds a key's values. Rank r = share * (n - 1)
    lies between the values whose counts reach past its floor and its ceiling.
    """
    w, all_ = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    rows = per.filter(F.col(count) > 0).withColumn("__end", F.sum(count).over(w)).withColumn("__n", F.sum(count).over(all_))
    ranks = F.array(*[F.lit(float(s)) for s in shares])
    each = rows.withColumn("__s", F.explode(F.transform(ranks, lambda s, i: F.struct(i.alias("i"), (s * (F.col("__n") - 1)).alias("r")))))
    start, r = F.col("__end") - F.col(count), F.col("__s.r")
    holds = lambda x: (start <= x) & (x < F.col("__end"))
    low, high = holds(F.floor(r)), holds(F.ceil(r))
    part = each.filter(low | high).withColumn("__v", F.when(low, F.col(value) * (1 - (r - F.floor(r)))).otherwise(0.0) + F.when(high, F.col(value) * (r - F.floor(r))).otherwise(0.0))
    found = part.groupBy(*by, F.col("__s.i").alias("i")).agg(F.sum("__v").alias("v"))
    return found.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("q"))


def psi(df: DataFrame, by: list[str], value: str, group: str, bins: int = 10) -> DataFrame:
    """Population stability of group 1 against quantile bins of group 0, by key, from counts of distinct values."""
    per = df.groupBy(*by, value).agg(F.count_if(F.col(group) == 0).alias("a"), F.count_if(F.col(group) == 1).alias("b"))
    cuts = quantiles(per, by, value, "a", [i / bins for i in range(1, bins)]).select(*by, F.array_distinct("q").alias("cuts"))
    b = per.join(cuts, by).withColumn("bin", F.size(F.filter("cuts", lambda c: c <= F.col(value))))
    per = b.groupBy(*by, "bin").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    all_ = Window.partitionBy(*by)
    x, z = (F.greatest(F.col(c) / F.sum(c).over(all_), F.lit(1e-6)) for c in "ab")
    return per.withColumn("t", (z - x) * F.ln(z / x)).groupBy(*by).agg(F.round(F.sum("t"), 6).alias("psi"), F.count("*").alias("bins"))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the score interval of a share."""
    p, d = hits / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z / d * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.greatest(mid - half, F.lit(0.0)), F.least(mid + half, F.lit(1.0))


def holm(df: DataFrame, p: str, tie: str) -> DataFrame:
    """df with holm: step-down adjusted p values over all rows (one row a hypothesis)."""
    w = Window.orderBy(p, tie)
    m = F.count("*").over(Window.partitionBy())
    return df.withColumn("__a", (m - F.row_number().over(w) + 1) * F.col(p)).withColumn("holm", F.least(F.lit(1.0), F.max("__a").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("__a")


@F.pandas_udf(T.DoubleType())
def norm_cdf(x: pd.Series) -> pd.Series:
    return x.map(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)) if v == v else None)


def sharpe(df: DataFrame, by: list[str], r: str) -> DataFrame:
    """n, Sharpe ratio (ddof 1), skewness and kurtosis (bias-corrected, normal: 3), and z of the probabilistic ratio against 0."""
    x = F.col(r)
    m = df.groupBy(*by).agg(F.count(r).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.skewness(x).alias("g"), F.kurtosis(x).alias("k"))
    n = F.col("n").cast("double")
    m = m.filter("n > 3 and sd > 0").withColumn("sr", F.col("mean") / F.col("sd")).withColumn("skew", F.col("g") * F.sqrt(n * (n - 1)) / (n - 2)).withColumn("kurt", 3 + (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("k") + 6))
    z = F.col("sr") * F.sqrt(n - 1) / F.sqrt(1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") ** 2)
    return m.select(*by, "n", F.round("sr", 6).alias("sharpe"), F.round("skew", 5).alias("skew"), F.round("kurt", 4).alias("kurtosis"), F.round(z, 5).alias("psr_z"))


def expected_max_sharpe(variance: float, trials: int) -> float:
    """Of so many independent trials without skill."""
    q = NormalDist().inv_cdf
    return math.sqrt(variance) * ((1 - GAMMA) * q(1 - 1 / trials) + GAMMA * q(1 - 1 / (trials * math.e))) if trials > 1 else 0.0


def deflated(df: DataFrame, by: list[str], r: str) -> DataFrame:
    """sharpe with dsr: the probability that a trial's ratio beats the expected best of all trials (rows of df by key).

    Only the number of trials and the variance of their ratios come to the driver.
    """
    s = sharpe(df, by, r)
    trials, var = s.agg(F.count("*"), F.coalesce(F.var_samp("sharpe"), F.lit(0.0))).first()
    best, n = expected_max_sharpe(var, trials), F.col("n").cast("double")
    z = (F.col("sharpe") - best) * F.sqrt(n - 1) / F.sqrt(1 - F.col("skew") * F.col("sharpe") + (F.col("kurtosis") - 1) / 4 * F.col("sharpe") ** 2)
    return s.withColumn("psr", norm_cdf("psr_z")).withColumn("dsr", norm_cdf(z))


def overfitting(returns: DataFrame, blocks: int = 8) -> DataFrame:
    """pbo: how often the trial that was best in half of the blocks is below the median in the rest.

    returns: ts, trial_id, ret, none missing. Times are numbered and cut into blocks; sums and squares by (trial,
    block) are all that is gathered: trials x blocks rows, on which the combinations run in one task.
    """
    if blocks < 4 or blocks % 2:
        raise ValueError("blocks must be even and at least 4")
    at = returns.select("ts").distinct().withColumn("k", F.row_number().over(Window.orderBy("ts")) - 1).withColumn("total", F.count("*").over(Window.partitionBy()))
    long, size = F.col("total") % blocks, F.floor(F.col("total") / blocks)
    block = F.when(F.col("k") < long * (size + 1), F.floor(F.col("k") / (size + 1))).otherwise(long + F.floor((F.col("k") - long * (size + 1)) / size))
    per = returns.join(at.withColumn("block", block.cast("int")).select("ts", "block"), "ts").groupBy("trial_id", "block").agg(F.count("ret").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") ** 2).alias("q"))

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = pd.concat(list(batches))
        if not len(t):
            return
        n, s, q = (t.pivot(index="trial_id", columns="block", values=c).sort_index().to_numpy(float) for c in ("n", "s", "q"))

        def ratio(cols: list[int]) -> np.ndarray:
            m, a, b = n[:, cols].sum(1), s[:, cols].sum(1), q[:, cols].sum(1)
            var = (b - a * a / m) / (m - 1)
            return np.where(var > 1e-18, a / m / np.sqrt(np.maximum(var, 1e-300)), 0.0)

        logits = []
        for half in combinations(range(blocks), blocks // 2):
            rest = [k for k in range(blocks) if k not in half]
            best = int(np.argmax(ratio(list(half))))
            out = ratio(rest)
            rank = (out < out[best]).sum() + ((out == out[best]).sum() + 1) / 2
            w = rank / (len(out) + 1)
            logits.append(math.log(w / (1 - w)))
        logits = np.array(logits)
        yield pd.DataFrame({"trials": [len(n)], "combinations": [len(logits)], "pbo": [float((logits < 0).mean() + 0.5 * (logits == 0).mean())]})

    return per.repartition(1).mapInPandas(combine, "trials long, combinations long, pbo double")


def bootstrap(df: DataFrame, by: list[str], value: str, block: int = 5, resamples: int = 2000, flips: int = 5000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """Confidence bounds of a mean by circular blocks, and the p value of a mean above 0 by flipping the signs of blocks, by key.

    Blocks of `block` values in order of pos begin anywhere and run on at the start, so that serial dependence stays.
    A key's values travel as one array, so keys must be of bounded length (trials, cells); keys are dealt to tasks, and
    each has its own random numbers, which follow from the seed and its name. Nulls are left out; keys of fewer values
    than a block take blocks of all.
    """
    rows = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", value))), lambda x: x[value].cast("double")).alias("x"))
    arrays = rows.withColumn("own", F.xxhash64(*by))

    def resample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                x = np.asarray(row.x, float)
                n, size = len(x), min(block, len(x))
                rng = np.random.default_rng([seed, row.own & 0xFFFFFFFFFFFFFFFF])
                means = np.empty(resamples)
                for k in range(0, resamples, 100):  # some at a time: memory by the key's length alone
                    starts = rng.integers(0, n, (min(100, resamples - k), -(-n // size)))
                    means[k : k + 100] = x[((starts[:, :, None] + np.arange(size)) % n).reshape(len(starts), -1)[:, :n]].mean(1)
                parts = np.add.reduceat(x, np.arange(0, n, size))
                above = sum(int((rng.choice([-1.0, 1.0], (min(100, flips - k), len(parts))) @ parts / n >= x.mean()).sum()) for k in range(0, flips, 100))
                tail = (1 - confidence) / 2
                out.append((*[getattr(row, k) for k in by], n, float(x.mean()), float(np.quantile(means, tail)), float(np.quantile(means, 1 - tail)), (above + 1) / (flips + 1)))
            yield pd.DataFrame(out, columns=[*by, "n", "mean", "low", "high", "p_value"])

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in by)
    return arrays.mapInPandas(resample, f"{kinds}, n long, mean double, low double, high double, p_value double")


def monte_carlo(df: DataFrame, value: str, order: list[str], paths: int = 200, seed: int = 42) -> DataFrame:
    """Quantiles of final sum and worst drawdown over shuffled paths of all trades' results.

    Paths run in parallel; each shuffles by hash within Spark, so no task holds more than one path's window.
    """
    w = Window.partitionBy("path").orderBy(F.xxhash64("path", *order, F.lit(seed)), *order)
    rows = df.select(*order, F.col(value).alias("x")).withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(paths - 1))))
    rows = rows.withColumn("sum", F.sum("x").over(w)).withColumn("drop", F.greatest(F.max("sum").over(w), F.lit(0.0)) - F.col("sum"))
    each = rows.groupBy("path").agg(F.sum("x").alias("final"), F.max("drop").alias("drawdown"))
    q = [0.05, 0.25, 0.5, 0.75, 0.95]
    return each.agg(F.percentile("final", q).alias("f"), F.percentile("drawdown", q).alias("d")).select(F.posexplode(F.arrays_zip("f", "d")).alias("k", "v")).select(F.element_at(F.array(*map(F.lit, q)), F.col("k") + 1).alias("quantile"), F.round("v.f", 6).alias("final"), F.round("v.d", 6).alias("drawdown"))
