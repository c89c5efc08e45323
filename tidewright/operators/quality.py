"""Quality of quotes and journals: duplicates, order, lateness, states; idempotent stores; hash chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.market import epoch


def service_levels(quotes: DataFrame, by: list[str], seq: str, ts: str, key: list[str]) -> DataFrame:
    """Per key: rows, share of duplicates (same key columns), share of time reversals in order of seq, span in seconds."""
    w = Window.partitionBy(*by).orderBy(seq)
    q = quotes.withColumn("late", F.coalesce(F.col(ts) < F.lag(ts).over(w), F.lit(False)))
    per = q.groupBy(*by, *[k for k in key if k not in by]).agg(F.count("*").alias("n"), F.count_if("late").alias("late"), F.min(ts).alias("a"), F.max(ts).alias("z"))
    n = F.sum("n")
    return per.groupBy(*by).agg(n.alias("quotes"), F.round((n - F.count("*")) / n, 6).alias("duplicate_rate"), F.round(F.sum("late") / n, 6).alias("out_of_order_rate"), F.round(epoch(F.max("z")) - epoch(F.min("a")), 3).alias("span_seconds"))


def flags(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks; a rule that can't be decided (null) is broken."""
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for name, broken in rules.items()]))


def state(hard: Column, missing: Column, slow: Column, there: Column) -> Column:
    """unavailable, quarantined, degraded or usable, in that order of precedence."""
    return F.when(~there, "unavailable").when(hard, "quarantined").when(missing | slow, "degraded").otherwise("usable")


def conflicts(df: DataFrame, key: list[str], payload: list[str]) -> DataFrame:
    """Keys that occur again: rows, distinct payloads, and whether they are exact replays or conflicts."""
    out = df.groupBy(*key).agg(F.count("*").alias("rows"), F.countDistinct(F.sha2(F.to_json(F.struct(*payload)), 256)).alias("payloads")).filter("rows > 1")
    return out.withColumn("kind", F.when(F.col("payloads") > 1, "conflict").otherwise("replay"))


def repaired(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """df with verdict: kept (first of its key by order), exact_duplicate or conflicting_duplicate, or bad_key."""
    w = Window.partitionBy(*key).orderBy(*order)
    rest = [c for c in df.columns if c not in key and c not in order]
    own = F.sha2(F.to_json(F.struct(*rest)), 256)
    bad = F.greatest(*[F.col(k).isNull().cast("int") for k in (*key, key[0])]) == 1
    out = df.withColumn("__own", own).withColumn("__n", F.row_number().over(w)).withColumn("__first", F.first("__own").over(w))
    return out.withColumn("verdict", F.when(bad, "bad_key").when(F.col("__n") == 1, "kept").when(F.col("__own") == F.col("__first"), "exact_duplicate").otherwise("conflicting_duplicate")).drop("__own", "__n", "__first")


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, as multisets, with the side and how often."""
    a, b = left.exceptAll(right).withColumn("side", F.lit("left_only")), right.exceptAll(left).withColumn("side", F.lit("right_only"))
    both = a.unionByName(b)
    return both.groupBy(*both.columns).agg(F.count("*").alias("times"))


def journal_audit(df: DataFrame, by: list[str], ts: str, seq: str, hours: float) -> DataFrame:
    """Per key: rows, time reversals by seq, close repeats (under 30 minutes per hour of interval), gaps over twice the interval."""
    w, s = Window.partitionBy(*by).orderBy(ts, seq), Window.partitionBy(*by).orderBy(seq)
    step = epoch(F.col(ts)) - epoch(F.lag(ts).over(w))
    d = df.withColumn("step", step).withColumn("back", F.coalesce(F.col(ts) < F.lag(ts).over(s), F.lit(False)))
    return d.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if("back").alias("reversals"), F.count_if(F.col("step") < 1800 * hours).alias("repeats"), F.count_if(F.col("step") > 7200 * hours).alias("gaps"), F.round(F.coalesce(F.max("step"), F.lit(0.0)), 3).alias("worst_gap"))


def appended(new: DataFrame, old: DataFrame, key: list[str], payload: list[str]) -> DataFrame:
    """The rows of new that an idempotent store lacks; raises if a key is there with another payload.

    One anti-join by key for the rows, one inner join that stops at the first conflict.
    """
    h = F.sha2(F.to_json(F.struct(*payload)), 256)
    stored = old.select(*key, h.alias("__old"))
    clash = new.withColumn("__new", h).join(stored, key).filter("__new <> __old")
    if clash.head(1):
        raise ValueError("a stored key comes with another payload")
    return new.dropDuplicates(key).join(stored.select(*key), key, "left_anti")
