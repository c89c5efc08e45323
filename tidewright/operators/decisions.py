"""Decisions: composites, gates, profiles learned from outcomes and applied to new rows, sizing and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights and limits of the composite.
TECH, NEWS, CONFLICT, STRONG = 0.55, 0.45, 0.75, 0.35
#: Feature buckets, lower bound inclusive.
BUCKETS = {"rsi": (35.0, 65.0), "atr_pct": (0.10, 0.25), "news_count": (2.0, 5.0), "adx": (20.0, 30.0)}


def composite(tech: Column, news: Column, quality: Column) -> tuple[Column, Column]:
    """(weighted score, conviction 0 to 100); strong opposite parts count three quarters."""
    c = TECH * tech + NEWS * news
    opposed = (tech * news < 0) & (F.abs(tech) >= STRONG) & (F.abs(news) >= STRONG)
    c = F.when(opposed, c * CONFLICT).otherwise(c)
    return c, F.least(F.lit(100), F.round(F.abs(c) * 100 * quality).cast("int"))


def gate(rules: list[tuple[str, Column]], passed: str = "open") -> Column:
    """The name of the first rule that blocks; a rule that can't be decided blocks."""
    out = None
    for name, blocks in rules:
        hit = F.coalesce(blocks, F.lit(True))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(passed)


def bucket(name: str, value: Column) -> Column:
    low, high = BUCKETS[name]
    return F.when(value < low, "low").when(value < high, "mid").when(value >= high, "high")


def factors(outcomes: DataFrame, by: list[str], least: int, floor: float) -> DataFrame:
    """Cells with n, hits, rate and factor: with enough rows and a rate under 0.45, rate / 0.5 but not below the floor; else 1."""
    cells = outcomes.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    rate = F.col("hits") / F.col("n")
    return cells.withColumn("rate", F.round(rate, 6)).withColumn("factor", F.when((F.col("n") >= least) & (rate < 0.45), F.greatest(F.lit(floor), F.round(rate / 0.5, 2))).otherwise(1.0))


def worst_factor(rows: DataFrame, row_id: str, features: dict[str, Column], cells: DataFrame) -> DataFrame:
    """rows with factor: the least factor of the cells (feature, bucket, direction) that a row falls in, 1 without any.

    The features are exploded into one equi-join with the cells and folded back by a minimum.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("feature"), bucket(k, c).alias("bucket")) for k, c in features.items()])
    long = rows.select(row_id, "direction", F.explode(pairs).alias("p")).select(row_id, "direction", "p.feature", "p.bucket")
    found = long.join(cells.select("feature", "bucket", "direction", "factor"), ["feature", "bucket", "direction"]).groupBy(row_id).agg(F.min("factor").alias("factor"))
    return rows.join(found, row_id, "left").withColumn("factor", F.coalesce("factor", F.lit(1.0)))


def learned_weight(tech_hits: Column, tech_n: Column, news_hits: Column, news_n: Column) -> Column:
    """The weight of the technical part, shrunk towards 0.55 by the smaller sample, between 0.35 and 0.70."""
    n = F.least(tech_n, news_n)
    t, w = F.greatest(tech_hits / tech_n - 0.5, F.lit(0.0)), F.greatest(news_hits / news_n - 0.5, F.lit(0.0))
    shrunk = TECH + n / (n + 40) * (t / (t + w) - TECH)
    return F.when((n >= 20) & (t + w > 0), F.round(F.least(F.lit(0.70), F.greatest(F.lit(0.35), shrunk)), 3)).otherwise(TECH)


def policy(e: Column, evaluated: Column, tradable: Column, poor: Column, sl_rate: Column, mae: Column, mfe: Column) -> Column:
    """What to do with a cell, by the first rule that holds."""
    return (
        F.when(evaluated < 8, "collect").when((poor / evaluated >= 0.5) | (tradable < 8), "quality_guard")
        .when((tradable >= 20) & (e <= -0.20) & (sl_rate >= 0.45), "avoid").when((e <= 0) | (sl_rate >= 0.45) | (mae >= mfe), "dampen").otherwise("hold")
    )


def top(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The best row of each key, then the best k of these; both rankings are cut within tasks."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n").orderBy(*order).limit(k)


def units(equity: Column, risk: Column, stop: Column, cost: Column, leverage: Column, held: Column, price: Column) -> Column:
    """Whole units at which a stop costs the risk, within the leverage that is left."""
    return F.greatest(F.lit(0), F.floor(F.least(equity * risk / (stop + cost), (equity * leverage - held) / price)))


def liquidity(df: DataFrame, by: list[str], spread: str, stressed: float = 0.95, thin: float = 0.8) -> DataFrame:
    """df with percentile (share of the key's spreads at or below) and status. Two counts by window over one sort."""
    w = Window.partitionBy(*by).orderBy(spread).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    p = F.count(spread).over(w) / F.count(spread).over(Window.partitionBy(*by))
    out = df.withColumn("percentile", F.when(F.col(spread).isNotNull(), p))
    return out.withColumn("status", F.when(F.col("percentile").isNull(), "unknown").when(F.col("percentile") >= stressed, "stressed").when(F.col("percentile") >= thin, "thin").otherwise("normal"))


def wasserstein(df: DataFrame, by: list[str], value: str, group: str, steps: int = 20) -> DataFrame:
    """Mean distance of the two groups' quantiles on an even grid, by key."""
    grid = [k / steps for k in range(steps + 1)]
    q = df.groupBy(*by).agg(*[F.percentile(F.when(F.col(group) == g, F.col(value)), grid).alias(f"q{g}") for g in (0, 1)])
    return q.select(*by, F.round(F.aggregate(F.zip_with("q0", "q1", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / (steps + 1), 6).alias("w1"))


def entropy(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Entropy of a value's shares over that of even ones, by key; 0 with a single value."""
    per = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    e = per.withColumn("t", -p * F.ln(p)).groupBy(*by).agg(F.sum("t").alias("h"), F.count("*").alias("k"))
    return e.select(*by, F.col("k").alias("values"), F.round(F.when(F.col("k") > 1, F.col("h") / F.ln(F.col("k").cast("double"))).otherwise(0.0), 6).alias("entropy"))


def rank_correlation(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Spearman's correlation with mid-ranks, by key."""
    def mid(c: str) -> Column:
        return F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2

    return df.withColumn("__x", mid(x)).withColumn("__y", mid(y)).groupBy(*by).agg(F.count("*").alias("n"), F.round(F.corr("__x", "__y"), 6).alias("spearman"))


def boosted(df: DataFrame, features: list[str], label: str, part: str, rounds: int = 10):
    """A gradient-boosted classifier fitted on part = train, and df with its probability p (distributed histograms of MLlib)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep").transform(df.withColumn("__y", F.col(label).cast("double")))
    fit = GBTClassifier(featuresCol="__x", labelCol="__y", maxIter=rounds, maxDepth=3, seed=42, predictionCol="__q")
    fit.set(fit.probabilityCol, "__p")
    fit.set(fit.rawPredictionCol, "__r")
    model = fit.fit(rows.filter(F.col(part) == "train"))
    return model, model.transform(rows).withColumn("p", vector_to_array("__p")[1]).drop("__x", "__y", "__p", "__q", "__r")


def platt(df: DataFrame, p: str, label: str, part: str) -> DataFrame:
    """df with calibrated: a logistic fit of the label on the logit of p over part = calibration."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    clipped = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    rows = VectorAssembler(inputCols=["__l"], outputCol="__x").transform(df.withColumn("__l", F.ln(clipped / (1 - clipped))).withColumn("__y", F.col(label).cast("double")))
    model = LogisticRegression(featuresCol="__x", labelCol="__y", probabilityCol="__p", predictionCol="__q", rawPredictionCol="__r").fit(rows.filter(F.col(part) == "calibration"))
    return model.transform(rows).withColumn("calibrated", vector_to_array("__p")[1]).drop("__x", "__y", "__l", "__p", "__q", "__r")
