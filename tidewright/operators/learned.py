"""What is learned from outcomes and applied to new decisions: cells, scores, thresholds, policies, plans, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.market import rounded

# Samples and limits of a cell's policy.
CELL_SAMPLES, BOOST_SAMPLES, GOOD_R, WEAK_FACTOR, GOOD_FACTOR = 30, 100, 0.10, 1.05, 1.20
QUALITY_FLOOR, STABILITY_FLOOR, SORTINO_FLOOR, RECOVERY_FLOOR, CALIBRATION_CEILING = 0.55, 0.55, 0.10, 0.50, 0.25
# Weights of the time frames, of macro parts, and currencies' sensitivity to risk.
FRAMES = {"15m": 0.15, "1h": 0.30, "4h": 0.30, "1d": 0.25}
SENSITIVITY = {"JPY": -1.0, "CHF": -0.8, "USD": -0.5, "EUR": 0.0, "GBP": 0.3, "CAD": 0.5, "AUD": 0.8, "NZD": 0.8}


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def norm_cdf(x: Column) -> Column:
    """The normal distribution function to double precision: a rational approximation, a continued fraction far out."""
    # Hart's coefficients.
    up = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
    down = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
    a = F.abs(x)

    def poly(c: tuple[float, ...]) -> Column:
        out = F.lit(c[0])
        for k in c[1:]:
            out = out * a + k
        return out

    far = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        far = a + k / far
    e = F.exp(-a * a / 2)
    tail = F.when(a > 37, 0.0).when(a < 7.07106781186547, e * poly(up) / poly(down)).otherwise(e / far / 2.506628274631)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def binomial_p(hits: Column, n: Column, p0: float = 0.5) -> Column:
    """Chance of at least so many hits if each has the chance p0: normal, with continuity correction; 1 without trials."""
    return F.when(n <= 0, 1.0).otherwise(1 - norm_cdf((hits - 0.5 - n * p0) / F.sqrt(n * (p0 * (1 - p0)))))


def cell_metrics(rows: DataFrame, by: list[str], order: list[str], r: str, conviction: str) -> DataFrame:
    """By cell: n, expectancy, profit factor, payoff, drawdown, recovery, downside, Sortino, worst tenth, stability of the
    two halves, Brier score and calibration error. rows in `order`; conviction 0 to 100."""
    key, ordered = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(*order)
    x, p = F.col(r), F.col(conviction) / 100
    y = F.when(x > 0, 1.0).otherwise(0.0)
    q = rows.withColumn("__n", F.count("*").over(key)).withColumn("__k", F.row_number().over(ordered)).withColumn("__sum", F.sum(r).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    q = q.withColumn("__drop", F.greatest(F.max("__sum").over(ordered.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)) - F.col("__sum"))
    q = q.withColumn("__low", F.row_number().over(Window.partitionBy(*by).orderBy(r, *order))).withColumn("__p", p).withColumn("__y", y)
    worst, half = F.greatest(F.ceil(F.col("__n") * 0.1), F.lit(1)), F.floor(F.col("__n") / 2)
    bins = [F.when((p >= a) & (p < z), True).otherwise(False) for a, z in ((0.0, 0.2), (0.2, 0.4), (0.4, 0.6), (0.6, 0.8), (0.8, 1.01))]
    gap = sum((F.abs(F.sum(F.when(b, p - y).otherwise(0.0))) for b in bins), F.lit(0.0))
    mean = lambda c: F.avg(F.when(c, x))
    c = q.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(x).alias("e"), F.sum(x).alias("total"), mean(x > 0).alias("win"), mean(x < 0).alias("loss"), F.sum(F.when(x > 0, x).otherwise(0.0)).alias("gain"), F.sum(F.when(x < 0, -x).otherwise(0.0)).alias("cost"),
        F.avg((x > 0).cast("double")).alias("win_rate"), F.max("__drop").alias("dd"), F.sqrt(F.avg(F.least(x, F.lit(0.0)) ** 2)).alias("down"), F.abs(F.avg(F.when(F.col("__low") <= worst, x))).alias("tail"),
        mean(F.col("__k") <= half).alias("first"), mean(F.col("__k") > half).alias("second"), F.avg((p - y) ** 2).alias("brier"), F.avg(y).alias("base"), (gap / F.count("*")).alias("ece"),
    )
    col = F.col
    change = F.abs(col("first") - col("second")) / F.greatest(F.abs("e"), F.lit(0.25)) + F.when(col("first") * col("second") < 0, 0.25).otherwise(0.0)
    inf = F.lit(float("inf"))
    base = col("base") * (1 - col("base"))
    r4 = lambda c: F.round(c, 4)
    return c.select(
        *by, "n", r4(col("e")).alias("expectancy_r"), r4(F.when(col("cost") > 0, col("gain") / col("cost")).when(col("gain") > 0, inf)).alias("profit_factor"), r4(col("win_rate")).alias("win_rate"),
        r4(F.when(col("loss") < 0, F.abs(col("win") / col("loss"))).when(col("win") > 0, inf)).alias("payoff_ratio"), r4("dd").alias("max_drawdown_r"), r4(F.when(col("dd") > 0, col("total") / col("dd")).when(col("total") > 0, inf).otherwise(0.0)).alias("recovery_factor"),
        r4("down").alias("downside_deviation_r"), r4(F.when(col("down") > 0, col("e") / col("down")).when(col("e") > 0, inf).otherwise(0.0)).alias("sortino_r"), r4("tail").alias("tail_loss_r"), r4(F.when(col("n") >= CELL_SAMPLES, clip(1 - change, 0.0, 1.0))).alias("stability"),
        r4("brier").alias("brier"), r4(base).alias("brier_base"), r4("ece").alias("calibration_error"), r4(F.when(base == 0, F.when(col("brier") == 0, 1.0).otherwise(-1.0)).otherwise(1 - col("brier") / base)).alias("brier_skill"), r4(F.least(F.lit(1.0), F.sqrt(col("n") / BOOST_SAMPLES))).alias("confidence"),
    )


def cell_score() -> Column:
    """The score of a cell from the columns of cell_metrics: bounded bonuses less penalties."""
    c = F.col
    pf = c("profit_factor")
    bonus = F.when(pf.isNull(), 0.0).when(pf >= 1, F.least(F.lit(0.30), (pf - 1) * 0.20)).otherwise(-F.least(F.lit(0.30), (1 - pf) * 0.35))
    bonus = bonus + F.coalesce((c("win_rate") - 0.5) * 0.30, F.lit(0.0)) + clip(F.coalesce("sortino_r", F.lit(0.0)) * 0.08, -0.25, 0.25) + F.coalesce(clip((c("recovery_factor") - 1) * 0.08, -0.20, 0.20), F.lit(0.0))
    bonus = bonus + F.coalesce((c("stability") - 0.5) * 0.20, F.lit(-0.05)) + F.coalesce(clip(c("brier_skill") * 0.20, -0.20, 0.20), F.lit(0.0))
    over = lambda x, limit, share, most: F.least(F.lit(most), F.greatest(F.lit(0.0), x - limit) * share)
    less = over(c("brier") - c("brier_base"), 0.0, 0.5, 99.0) + over(c("calibration_error"), 0.10, 0.40, 99.0) + over(c("max_drawdown_r"), 3.0, 0.05, 0.50) + over(c("tail_loss_r"), 1.0, 0.10, 0.35)
    less = less + (1 - c("confidence")) * 0.20 + F.when(c("n") >= CELL_SAMPLES, 0.0).otherwise(0.15)
    return F.round(clip(c("expectancy_r"), -2.0, 2.0) + bonus - less, 4)


def cell_policy(score: Column, quality: Column | None = None) -> tuple[Column, Column]:
    """(action, factor): collect_samples, quality_guard, avoid, dampen, boost or hold; the first rule that applies."""
    c, quality = F.col, F.lit(1.0) if quality is None else quality
    thin = (c("profit_factor") < WEAK_FACTOR) | (c("stability") < STABILITY_FLOOR) | (c("calibration_error") > CALIBRATION_CEILING) | (c("sortino_r") < SORTINO_FLOOR) | ((c("max_drawdown_r") > 0) & (c("recovery_factor") < RECOVERY_FLOOR))
    thin = F.coalesce(thin, F.lit(False))
    good = (c("n") >= BOOST_SAMPLES) & (c("expectancy_r") >= GOOD_R) & F.coalesce(c("profit_factor") >= GOOD_FACTOR, F.lit(True)) & (c("brier") <= c("brier_base")) & (score >= 0.25)
    action = F.when(c("n") < CELL_SAMPLES, "collect_samples").when(quality < QUALITY_FLOOR, "quality_guard").when(c("expectancy_r") <= 0, "avoid").when(thin, "dampen").when(good, "boost").otherwise("hold")
    factor = F.when(action == "avoid", 0.45).when(action == "dampen", 0.75).when(action == "boost", F.least(F.lit(1.10), F.round(1 + F.least(F.lit(0.10), score * 0.08), 2))).otherwise(1.0)
    return action, factor


def confidence_factor(n: Column, hits: Column) -> Column:
    """How far evidence of first touches moves a confidence: none under 30 calls or near even, all of it from 100 on."""
    rate = hits / n
    raw = F.when(rate < 0.45, F.greatest(F.lit(0.70), rate / 0.5)).otherwise(F.least(F.lit(1.10), 1 + (rate - 0.5) * 0.5))
    return F.when((n < 30) | ((rate >= 0.45) & (rate < 0.60)), 1.0).otherwise(F.round(1 + F.least(F.lit(1.0), n / 100) * (raw - 1), 2))


def lower_bound(r: Column) -> Column:
    """A one-sided 95 % lower bound of a mean; null under two values."""
    return F.when(F.count(r) >= 2, F.avg(r) - 1.645 * F.sqrt(F.var_samp(r) / F.count(r)))


def threshold_table(rows: DataFrame, thresholds: list[float], embargo_hours: float) -> DataFrame:
    """threshold, part, n, mean, lcb: of rows (pos, total, ts, score, r) with a score at or over each threshold.

    The first 60 % are for training, the next 20 % tune, without what lies within the embargo before the last 20 %, the
    test. Thresholds are few: each row is copied for those that it reaches.
    """
    low, high = F.greatest(F.floor(F.col("total") * 0.6), F.lit(1)), F.greatest(F.floor(F.col("total") * 0.8), F.floor(F.col("total") * 0.6) + 1)
    part = F.when(F.col("pos") >= high, "test").when(F.col("pos") >= low, "tune")
    cut = rows.filter(F.col("pos") == high).select(F.col("ts").alias("test_start"))
    each = rows.withColumn("part", part).filter(F.col("part").isNotNull()).join(F.broadcast(cut), F.lit(True))
    each = each.filter((F.col("part") == "test") | (F.col("ts") < F.col("test_start") - F.expr(f"interval {int(embargo_hours)} hours")))
    reached = F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= F.abs("score"))
    return each.withColumn("threshold", F.explode(reached)).groupBy("threshold", "part").agg(F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("mean"), F.round(lower_bound(F.col("r")), 6).alias("lcb"))


def effective_threshold(stage: Column, threshold: Column, approved: Column, expires: Column, now: Column, default: float = 0.15) -> Column:
    """An active, approved, valid and unexpired policy's threshold, else the default."""
    ok = (stage == "active") & threshold.between(default, 1.0) & approved & (expires > now)
    return F.when(F.coalesce(ok, F.lit(False)), threshold).otherwise(default)


def matching_policy(decisions: DataFrame, policies: DataFrame) -> DataFrame:
    """decisions (decision_id, symbol, direction, confidence) with policy_id of the most specific policy that matches.

    policies: policy_id, scope (by_symbol_direction, by_symbol, by_direction, by_confidence, overall), key, approved_at. A
    decision has one key a scope, so that the match is an equi-join and not a join of all with all.
    """
    key = {"by_symbol_direction": F.concat_ws(":", "symbol", "direction"), "by_symbol": F.col("symbol"), "by_direction": F.col("direction"), "by_confidence": F.col("confidence"), "overall": F.lit("")}
    keys = F.explode(F.array(*[F.struct(F.lit(s).alias("scope"), c.alias("key"), F.lit(5 - k).alias("rank")) for k, (s, c) in enumerate(key.items())]))
    each = decisions.select("decision_id", keys.alias("k")).select("decision_id", "k.*")
    met = each.join(F.broadcast(policies), ["scope", "key"])
    best = met.groupBy("decision_id").agg(F.min_by("policy_id", F.struct(-F.col("rank"), "approved_at", "policy_id")).alias("policy_id"))
    return decisions.join(best, "decision_id", "left")


def alignment(views: DataFrame, by: list[str], order: str) -> DataFrame:
    """by, alignment (weighted mean rating), coverage (weight that is there), agreement (share of frames with its sign).

    views: by, interval, rating, order, one row a frame. Neutral frames don't agree; without a direction there is no
    agreement. Means at half a thousandth round by their sum's last bit, so a key's few frames are added in their order,
    however the rows are dealt to tasks.
    """
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in FRAMES.items() for x in kv]), F.col("interval")), F.lit(0.1))
    v = views.withColumn("w", weight)
    frames = F.array_sort(F.collect_list(F.struct(order, (F.col("rating") * F.col("w")).alias("x"), "w")))
    out = v.groupBy(*by).agg(frames.alias("f"), F.round(F.sum(F.when(F.col("interval").isin(*FRAMES), F.col("w")).otherwise(0.0)) / sum(FRAMES.values()), 3).alias("coverage"), F.count_if(F.col("rating") > 0).alias("up"), F.count_if(F.col("rating") < 0).alias("down"), F.count("*").alias("frames"))
    total = lambda name: F.aggregate("f", F.lit(0.0), lambda s, x: s + x[name])
    out = out.withColumn("alignment", F.round(total("x") / total("w"), 3))
    return out.select(*by, "alignment", "coverage", "frames", F.round(F.when(F.col("alignment") > 0, F.col("up") / F.col("frames")).when(F.col("alignment") < 0, F.col("down") / F.col("frames")), 3).alias("agreement"))


def regime(vix: Column, vix_before: Column, us10y: Column, us10y_before: Column, usd: Column, usd_before: Column) -> Column:
    """risk_off, risk_on or neutral by votes: volatility's level and jump, yields' fall, the dollar's rise over five observations."""
    spike = (vix - vix_before) / F.abs(F.when(vix_before != 0, vix_before)) * 100
    vote = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    off = vote(vix >= 25) + vote(spike >= 20) + vote(us10y - us10y_before <= -0.15) + vote((usd - usd_before) / F.abs(F.when(usd_before != 0, usd_before)) * 100 >= 1.5)
    on = vote((vix <= 15) & (F.coalesce(spike, F.lit(0.0)) < 20))
    return F.when(off > on, "risk_off").when(on > off, "risk_on").otherwise("neutral")


def macro_view(base: Column, quote: Column, base_ratio: Column, quote_ratio: Column, regime_: Column) -> tuple[Column, Column]:
    """(score, confidence) of a pair: positions 0.6, the regime 0.4, over what is there; 0 and 0 without either."""
    table = F.create_map(*[F.lit(x) for kv in SENSITIVITY.items() for x in kv])
    cot = F.round(clip((base_ratio - quote_ratio) * 3, -1.0, 1.0), 3)
    raw = (F.try_element_at(table, quote) - F.try_element_at(table, base)) / 2
    fit = clip(F.when(regime_ == "risk_off", raw).when(regime_ == "risk_on", -raw), -1.0, 1.0)
    fit = F.round(F.when(F.abs(F.when(regime_ == "risk_off", raw).when(regime_ == "risk_on", -raw)) >= 0.05, fit), 3)
    weight = F.when(cot.isNotNull(), 0.6).otherwise(0.0) + F.when(fit.isNotNull(), 0.4).otherwise(0.0)
    score = (F.coalesce(cot * 0.6, F.lit(0.0)) + F.coalesce(fit * 0.4, F.lit(0.0))) / F.when(weight > 0, weight)
    return F.round(F.coalesce(score, F.lit(0.0)), 3), F.round(weight, 3)


def plan(rows: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Decisions from their inputs: composite, quality, conviction, direction and the gate that decided.

    rows: alignment, ma_side (1, -1, 0), news_score, news_count, coverage, calendar_ok, data_ok, market_open, in_event.
    Weights 0.55 and 0.45; moving averages shift the technical score by 0.15; quality is half technical coverage, 0.3
    news (five items are enough), 0.2 the calendar. An unknown calendar caps conviction at 40, opposite strong scores
    take a quarter off, an event window caps at 25. Gates in order: stale data, closed market, event, quality, threshold.
    """
    c = F.col
    tech = clip(c("alignment") + 0.15 * c("ma_side"), -1.0, 1.0)
    out = rows.withColumn("tech_score", tech).withColumn("composite", rounded(0.55 * c("tech_score") + 0.45 * c("news_score"), 3))
    out = out.withColumn("quality", rounded(0.5 * c("coverage") + 0.3 * F.least(F.lit(1.0), c("news_count") / 5) + 0.2 * c("calendar_ok").cast("int"), 3))
    conviction = F.least(F.lit(100), F.bround(F.abs("composite") * 100 * c("quality")).cast("int"))
    conviction = F.when(c("calendar_ok"), conviction).otherwise(F.least(conviction, F.lit(40)))
    opposed = (c("tech_score") * c("news_score") < 0) & (F.least(F.abs("tech_score"), F.abs("news_score")) >= 0.35)
    conviction = F.when(opposed, F.bround(conviction * 0.75).cast("int")).otherwise(conviction)
    gate = (
        F.when(~c("data_ok"), "operational_data_stale").when(~c("market_open"), "market_closed").when(c("in_event"), "event_window").when(c("coverage") <= 0, "missing_technical").when(c("quality") < 0.4, "low_data_quality")
        .when(F.abs("composite") < threshold, "below_threshold").otherwise("open")
    )
    side = F.when(c("composite") > 0, "long").otherwise("short")
    direction = F.when(c("gate") == "market_closed", "closed").when(c("gate") == "event_window", "standby").when(c("gate") == "open", side).otherwise("neutral")
    final = F.when(c("gate").isin("operational_data_stale", "market_closed"), 0).when(c("gate") == "event_window", F.least(conviction, F.lit(25))).otherwise(conviction)
    return out.withColumn("gate", gate).withColumn("direction", direction).withColumn("conviction", final)


def composed(first: tuple[Column, Column], second: tuple[Column, Column], conviction: Column) -> tuple[Column, Column, Column]:
    """(factor, conviction that the second rules see, block) of two adjusters (factor, block) in turn."""
    seen = F.bround(conviction * clip(first[0], 0.0, 1.10)).cast("int")
    return first[0] * second[0], seen, first[1] | second[1]


def class_probabilities(composite: Column) -> tuple[Column, Column, Column]:
    """(up, down, flat) of a horizon without enough history: the prior, tilted by the composite and made to add up."""
    up, down = clip(0.375 + 0.25 * composite, 0.05, 0.90), clip(0.375 - 0.25 * composite, 0.05, 0.90)
    flat = F.greatest(F.lit(0.05), 1 - up - down)
    total = up + down + flat
    return tuple(F.round(x / total, 6) for x in (up, down, flat))


def failure_reasons(extra: dict[str, Column] | None = None) -> Column:
    """Why a scored decision failed, by name, in order: from realized_r, first_touch, mfe_r, mae_r, conviction; none for a win."""
    c = F.col
    lost = c("realized_r").isNull() | (c("realized_r") <= 0)
    rules = {
        "unscored_missing_data": c("realized_r").isNull(), "ambiguous_intrabar_touch": c("first_touch") == "ambiguous", "sl_first": c("first_touch") == "sl", "adverse_excursion_dominant": c("mae_r") >= c("mfe_r"), "weak_favorable_excursion": c("mfe_r") < 0.5,
        "tp_too_far": (c("realized_r") <= 0) & ~c("first_touch").isin("tp1", "tp2") & (c("mfe_r") >= 0.75), "large_adverse_excursion": c("mae_r") >= 0.8, "confidence_overreach": (c("conviction") >= 75) & lost,
    } | (extra or {})
    found = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return F.when(c("realized_r") > 0, F.array().cast("array<string>")).when(F.size(found) > 0, found).otherwise(F.array(F.lit("weak_favorable_excursion")))


def abstention(p: Column, r: Column, low: Column, high: Column, disagreement: Column, calibrated: Column, data_veto: Column, risk_veto: Column) -> Column:
    """long, short, or the first reason for no trade."""
    return (
        F.when(p.isNull() | ~p.between(0, 1), "invalid_probability").when(data_veto, "data_quality_veto").when(risk_veto, "risk_veto").when(~calibrated, "uncalibrated_probability").when(low.isNull() | high.isNull(), "uncertainty_unavailable")
        .when((low < 0) | (low > high) | (high > 1), "invalid_uncertainty_interval").when((p < low) | (p > high), "probability_outside_uncertainty_interval").when(high - low > 0.30, "uncertainty_too_wide")
        .when(disagreement < 0, "invalid_model_disagreement").when(disagreement > 0.20, "model_disagreement").when(r.isNull(), "net_expectancy_unavailable").when(r <= 0, "non_positive_net_expectancy").when(p >= 0.60, "long").when(p <= 0.40, "short").otherwise("probability_in_no_trade_band")
    )


def promotion_gates(evidence: dict[str, tuple[Column, Column]]) -> Column:
    """array of (gate, passed): a gate whose evidence is missing fails. evidence: observed value and the condition on it, by gate."""
    return F.array(*[F.struct(F.lit(g).alias("gate"), (v.isNotNull() & F.coalesce(ok, F.lit(False))).alias("passed")) for g, (v, ok) in evidence.items()])


def execution_costs(rows: DataFrame) -> DataFrame:
    """rows with the parts of what execution cost: half spread, slippage, latency, adverse selection, what wasn't filled, and net.

    rows: side, alpha, decision_mid, send_mid, post_mid (may be null), bid, ask, fill, requested, filled, commission,
    financing. What was rejected loses all its alpha as opportunity.
    """
    c, sign = F.col, F.when(F.col("side") == "long", 1.0).otherwise(-1.0)
    rejected = c("fill").isNull() | (c("filled") <= 0)
    part = lambda x: F.when(rejected, 0.0).otherwise(x)
    half, ratio = (c("ask") - c("bid")) / 2, c("filled") / c("requested")
    out = rows.withColumns({
        "spread_cost": part(half), "latency_cost": part(sign * (c("send_mid") - c("decision_mid"))), "slippage_cost": part(sign * (c("fill") - (c("send_mid") + sign * half))), "adverse_selection": part(F.coalesce(sign * (c("fill") - c("post_mid")), F.lit(0.0))),
        "opportunity_cost": F.when(rejected, c("alpha")).otherwise(c("alpha") * (1 - ratio)),
    })
    return out.withColumn("net_alpha", part(c("alpha") * ratio - c("spread_cost") - c("slippage_cost") - c("latency_cost") - c("commission") - c("financing") - c("adverse_selection")))


def intent_verdict(now: Column, valid_until: Column, received: Column, spread: Column, most_age: float, most_spread: float) -> Column:
    """proceed, or why an order isn't sent: expired_intent, stale_quote, max_spread_exceeded."""
    age = now.cast("double") - received.cast("double")
    return F.when(now > valid_until, "expired_intent").when(age > most_age, "stale_quote").when(spread > most_spread, "max_spread_exceeded").otherwise("proceed")


def gaps(events: DataFrame, by: list[str], ts: str, timeout: str) -> DataFrame:
    """Silences longer than a timeout in a source's heartbeats: by, started_at, ended_at, seconds, number of the reconnect."""
    w = Window.partitionBy(*by).orderBy(ts)
    q = events.select(*by, F.lag(ts).over(w).alias("started_at"), F.col(ts).alias("ended_at")).filter(F.col("ended_at") > F.col("started_at") + F.expr(f"interval {timeout}"))
    return q.withColumn("reconnect", F.row_number().over(Window.partitionBy(*by).orderBy("ended_at")))


def backoff(attempt: Column, share: Column, initial: float = 1.0, factor: float = 2.0, most: float = 60.0, jitter: float = 0.25) -> Column:
    """Seconds before a reconnect: growing, capped, and spread around by a share from 0 to 1."""
    base = F.least(F.lit(initial) * F.pow(F.lit(factor), attempt), F.lit(most))
    return F.greatest(F.lit(0.0), base - base * jitter + share * 2 * base * jitter)
