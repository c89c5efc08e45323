"""Headlines: phrases with negation, hedges and age, moves of pairs, agreement and volume, and the mood of the market."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the scores are made of.
HALF_LIFE_HOURS, SCALE, VOLUME, HEDGE, NEGATION, BOOST, NEGATION_CHARS, OTHER_SOURCE, MOVE = 12.0, 2.5, 3.0, 0.7, -0.6, 1.3, 32, 0.8, 0.7
SOURCES = {"fxstreet": 1.0, "reuters": 1.0, "bloomberg": 1.0}
CURRENCIES = ("AUD", "CAD", "CHF", "EUR", "GBP", "JPY", "NZD", "USD")
# Phrases that speak for a currency (policy, inflation, growth, employment, flow) or against it, by weight.
FOR = {
    0.9: ("surprise rate hike", "emergency rate hike"), 0.8: ("intervention",), 0.6: ("rate hike", "rate hikes", "raise rates", "raises rates", "hawkish"),
    0.5: ("higher rates", "tightening", "tighten", "hot inflation", "hotter than expected", "beats expectations", "beat expectations", "better than expected", "above expectations", "surge in hiring", "strong jobs"),
    0.4: ("sticky inflation", "jobs growth"), 0.3: ("upbeat", "resilient", "bullish", "strengthens", "strengthen"), 0.25: ("strong",),
}
AGAINST = {
    0.9: ("emergency rate cut", "surprise rate cut"), 0.6: ("rate cut", "rate cuts", "cut rates", "cuts rates", "dovish", "recession"),
    0.5: ("lower rates", "easing", "loosen", "misses expectations", "miss expectations", "worse than expected", "below expectations", "softer than expected", "job losses", "unemployment rises"),
    0.4: ("cooling inflation", "disinflation", "layoffs", "slowdown"), 0.3: ("cooling", "downbeat", "bearish", "weakens", "weaken"), 0.25: ("weak",),
}
NEGATIONS = ("not ", "no ", "won't", "will not", "unlikely", "denies", "denied", "pushes back", "pushed back", "rules out", "ruled out", "refrains from", "holds off", "delays", "delay ", "postpones")
HEDGES = ("may ", "might ", "could ", "expected to", "likely to", "speculation", "rumor", "rumour", "considers", "considering", "mulls", "debate")
INTENSIFIERS = ("sharply", "surges", "surge ", "soars", "plunges", "plunge ", "aggressive", "unexpectedly", "shock", "record ")
RISK_OFF = ("risk-off", "risk off", "safe haven", "safe-haven", "flight to quality", "sell-off", "selloff", "escalation", "war ", "conflict", "tariff", "sanctions", "crisis", "contagion")
RISK_ON = ("risk-on", "risk on", "risk appetite", "record high", "rally", "rallies", "relief", "optimism", "de-escalation", "trade deal")
UP = ("rises", "rise", "gains", "climbs", "jumps", "rallies", "advances", "extends gains", "hits high", "strengthens", "recovers")
DOWN = ("falls", "fall", "drops", "slides", "declines", "slips", "plunges", "tumbles", "extends losses", "hits low", "weakens", "retreats")
#: Code points after a pair's name in which a verb tells its move.
TAIL = 60


def folded(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "\\s+", " ")


def _any(text: Column, terms: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(text, F.lit(t))
    return out


def hits(text: str) -> Column:
    """array of signed weights of the phrases in a folded text: each at its first place, turned and weakened by a negation
    in the 32 characters before it."""
    found = []
    for sign, table in ((1.0, FOR), (-1.0, AGAINST)):
        for weight, phrases in table.items():
            for p in phrases:
                at = F.instr(F.col(text), p)
                start = F.greatest(at - NEGATION_CHARS, F.lit(1))
                negated = _any(F.substring(F.col(text), start, at - start), NEGATIONS)
                found.append(F.when(at > 0, F.when(negated, sign * weight * NEGATION).otherwise(sign * weight)))
    return F.array_compact(F.array(*found))


def modifier(text: Column) -> Column:
    return F.when(_any(text, HEDGES), HEDGE).otherwise(1.0) * F.when(_any(text, INTENSIFIERS), BOOST).otherwise(1.0)


def moves(text: str) -> Column:
    """array of (currency, move): of each pair in a text followed by a verb, base up and quote down, or the other way round."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    pair = r"\b[A-Z]{3}\s*/\s*[A-Z]{3}\b|\b[A-Z]{6}\b"
    names = F.regexp_extract_all(upper, F.lit(f"({pair})"), F.lit(1))
    between = F.slice(F.split(upper, pair, -1), 2, 100_000)
    # what follows each name up to and with the next one, which has six characters at least: ten of these reach far enough
    pieces = F.transform(between, lambda t, i: F.concat(t, F.coalesce(F.try_element_at(names, i + 2), F.lit(""))))

    def move(n: Column, i: Column) -> Column:
        name = F.regexp_replace(n, "[^A-Z]", "")
        tail = F.lower(F.left(F.array_join(F.slice(pieces, i + 1, F.lit(TAIL // 6 + 1)), ""), F.lit(TAIL)))
        way = F.when(_any(tail, UP), 1.0).when(_any(tail, DOWN), -1.0)
        b, q = F.substring(name, 1, 3), F.substring(name, 4, 3)
        ok = b.isin(*CURRENCIES) & q.isin(*CURRENCIES) & way.isNotNull()
        return F.when(ok, F.array(F.struct(b.alias("currency"), way.alias("move")), F.struct(q.alias("currency"), (-way).alias("move")))).otherwise(F.array().cast("array<struct<currency:string,move:double>>"))

    return F.flatten(F.transform(names, move))


def currency_scores(items: DataFrame, now: Column) -> DataFrame:
    """currency, headlines, score, confidence of tagged headlines (text, source, published, currencies).

    A headline weighs by its source and halves every 12 hours; its phrases count for every currency it is tagged with,
    its pairs' moves for theirs. Bias is the weighted sum over 2.5, within 1; confidence how much of the evidence agrees,
    times n / (n + 3) of the effective number of headlines; the score is bias times confidence.
    """
    age = F.greatest(F.lit(0.0), (now.cast("timestamp").cast("double") - F.col("published").cast("timestamp").cast("double")) / 3600)
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SOURCES.items() for x in kv]), F.lower(F.trim("source"))), F.lit(OTHER_SOURCE)) * F.pow(F.lit(0.5), age / HALF_LIFE_HOURS)
    q = items.withColumns({"w": weight, "low": folded(F.col("text")), "moves": moves("text")}).filter("w > 0.01")
    q = q.withColumn("m", modifier(F.col("low"))).withColumn("h", F.transform(hits("low"), lambda x: x * F.col("m")))
    q = q.withColumns({"plus": F.aggregate("h", F.lit(0.0), lambda a, x: a + x), "size": F.aggregate("h", F.lit(0.0), lambda a, x: a + F.abs(x))})
    touched = F.array_union("currencies", F.transform("moves", lambda x: x["currency"]))
    each = q.withColumn("currency", F.explode(F.filter(touched, lambda c: c.isin(*CURRENCIES))))
    net = F.aggregate(F.filter("moves", lambda x: x["currency"] == F.col("currency")), F.lit(0.0), lambda a, x: a + x["move"])
    move = F.when(net > 0, MOVE).when(net < 0, -MOVE).otherwise(0.0)
    tagged = F.array_contains("currencies", F.col("currency"))
    part = lambda c: F.when(tagged, F.col(c)).otherwise(0.0)
    g = each.groupBy("currency").agg(F.count("*").alias("headlines"), F.sum("w").alias("n"), F.sum((part("plus") + move) * F.col("w")).alias("s"), F.sum((part("size") + F.abs(move)) * F.col("w")).alias("a"))
    confidence = F.round(F.abs("s") / F.col("a") * F.col("n") / (F.col("n") + VOLUME), 3)
    bias = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("s") / SCALE))
    return g.select("currency", "headlines", F.when(F.col("a") > 0, F.round(bias * confidence, 3)).otherwise(0.0).alias("score"), F.when(F.col("a") > 0, confidence).alias("confidence"))


def mood(items: DataFrame, by: list[str]) -> DataFrame:
    """by, off, on, regime: terms of fear and of appetite in headlines; one side must lead by two."""
    low = folded(F.col("text"))
    count = lambda terms: sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))
    g = items.groupBy(*by).agg(F.sum(count(RISK_OFF)).alias("off"), F.sum(count(RISK_ON)).alias("on"))
    return g.withColumn("regime", F.when(F.col("off") >= F.col("on") + 2, "risk_off").when(F.col("on") >= F.col("off") + 2, "risk_on").otherwise("neutral"))
