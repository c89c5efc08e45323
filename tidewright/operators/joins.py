"""Joins in time: as-of, nearest, forward by market-open time, intervals, revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.market import open_seconds


def asof(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, values: list[str], tolerance: str | None = None, tie: str | None = None) -> DataFrame:
    """left with the values of right's last row at or before its time, by key; null where there is none within the tolerance.

    Both sides are tagged, united and passed by one window per key: one shuffle and one sort, no range join. At
    equal times right rows come first, so an exact match counts. Among right rows of one time the largest `tie` wins.
    """
    kept = left.columns
    known = F.struct(F.col(right_ts).alias("__ts"), *[F.col(v) for v in values])
    l = left.select(*kept, F.col(left_ts).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast("long").alias("__tie"))  # noqa: E741
    r = right.select(*by, F.col(right_ts).alias("__t"), F.lit(0).alias("__side"), (F.col(tie).cast("long") if tie else F.lit(0).cast("long")).alias("__tie"), known.alias("__r"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("__m", F.last("__r", ignorenulls=True).over(w)).filter("__side = 1")
    if tolerance:
        out = out.withColumn("__m", F.when(F.col("__m.__ts") + F.expr(f"interval {tolerance}") >= F.col("__t"), F.col("__m")))
    return out.select(*kept, F.col("__m.__ts").alias(f"matched_{right_ts}"), *[F.col(f"__m.{v}").alias(f"matched_{v}") for v in values])


def banded(left: DataFrame, right: DataFrame, by: list[str], left_at: Column, right_at: Column, low: float, high: float) -> DataFrame:
    """Pairs with low <= right_at - left_at <= high by key: an equi-join on buckets as wide as the band, then the range.

    left is dealt to the two or three buckets that its band can touch; right rows stay single. Every pair meets once.
    """
    width = float(max(high - low, 1e-9))
    l = left.withColumn("__l", left_at).withColumn("__b", F.explode(F.sequence(F.floor((F.col("__l") + low) / width), F.floor((F.col("__l") + high) / width))))  # noqa: E741
    r = right.withColumn("__r", right_at).withColumn("__b", F.floor(F.col("__r") / width))
    return l.join(r, [*by, "__b"]).filter((F.col("__r") - F.col("__l") >= low) & (F.col("__r") - F.col("__l") <= high)).drop("__b")


def nearest(left: DataFrame, right: DataFrame, by: list[str], left_id: str, left_at: Column, right_at: Column, tolerance: float) -> DataFrame:
    """For each left row the nearest right row in time within the tolerance; the earlier one at a tie. Columns must differ."""
    pairs = banded(left, right, by, left_at, right_at, -tolerance, tolerance).withColumn("__gap", F.abs(F.col("__r") - F.col("__l")))
    w = Window.partitionBy(left_id).orderBy("__gap", "__r")
    return pairs.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__l", "__r").withColumnRenamed("__gap", "gap")


def forward(left: DataFrame, right: DataFrame, by: list[str], left_id: str, left_ts: str, right_ts: str, hours: float, tolerance: float) -> DataFrame:
    """For each left row the right row whose market-open age is nearest to `hours`, within the tolerance; the earliest at a tie."""
    h, tol = hours * 3600, tolerance * 3600
    pairs = banded(left, right, by, open_seconds(left_ts), open_seconds(right_ts), h - tol, h + tol).withColumn("open_age", F.col("__r") - F.col("__l"))
    w = Window.partitionBy(left_id).orderBy(F.abs(F.col("open_age") - h), right_ts)
    return pairs.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__l", "__r")


def masked(points: DataFrame, ts: str, events: DataFrame, event_ts: str, before: float, after: float) -> DataFrame:
    """points with blocked: whether an event lies at most `after` seconds before or `before` seconds after. No cross join.

    Events are dealt to buckets of the band's width and each point meets those of its own and the two beside it.
    """
    from tidewright.functions.market import epoch

    width = float(before + after)
    e = events.select(F.col(event_ts).alias("__e")).withColumn("__es", epoch("__e")).withColumn("__b", F.explode(F.sequence(F.floor((F.col("__es") - before) / width), F.floor((F.col("__es") + after) / width)))).select("__b", "__es").distinct()
    p = points.withColumn("__p", epoch(ts)).withColumn("__b", F.floor(F.col("__p") / width))
    spans = e.groupBy("__b").agg(F.array_sort(F.collect_set("__es")).alias("__at"))
    hit = F.exists("__at", lambda x: (F.col("__p") >= x - before) & (F.col("__p") <= x + after))
    return p.join(spans, "__b", "left").withColumn("blocked", F.coalesce(hit, F.lit(False))).drop("__p", "__b", "__at")


def latest(df: DataFrame, keys: list[str], by: list[str], until: Column | None = None) -> DataFrame:
    """The last revision of each key, of those that `until` admits: one partial aggregation, no sort of all rows."""
    rows = df if until is None else df.filter(until)
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by(F.struct(*rest), F.struct(*by))
    return rows.groupBy(*keys).agg(pick.alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])
