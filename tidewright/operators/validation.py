"""Splits of labelled time intervals for model tests, without leakage. Few rows decide; the bulk is only filtered."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.market import epoch


#: Cells of even width that rows are dealt to by their first order column.
CELLS = 10_000


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with pos, from 0 in the order of unique columns, the first of which is a number or a time.

    No task sees all rows: they are dealt to CELLS cells by the first column, each cell's rows are counted and numbered
    by itself, and the rows of the cells before it are added. One row a cell is gathered, whatever the table.
    """
    kind = df.schema[order[0]].dataType.typeName()
    x = epoch(order[0]) if kind == "timestamp_ntz" else F.unix_micros(order[0]) / 1e6 if kind == "timestamp" else F.unix_date(order[0]).cast("double") if kind == "date" else F.col(order[0]).cast("double")
    low, high = df.select(F.min(x), F.max(x)).first()
    width = (high - low) / CELLS if low is not None and high > low else 1.0
    cell = F.when(x.isNull(), -1).otherwise(F.least(F.floor((x - F.lit(float(low or 0.0))) / width), F.lit(CELLS))).cast("int")
    rows = df.withColumn("__cell", cell)
    counts = rows.groupBy("__cell").agg(F.count("*").alias("__n"))
    before = counts.select("__cell", (F.sum("__n").over(Window.orderBy("__cell")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__cell").orderBy(*order)) - 1
    return rows.join(F.broadcast(before), "__cell").withColumn("pos", F.col("__before") + place).drop("__cell", "__before")


def positions(df: DataFrame, ts: str, tie: str) -> DataFrame:
    """df with pos, from 0 in order of time, and total."""
    return numbered(df, [ts, tie]).withColumn("total", F.lit(df.count()).cast("long"))


def walk_forward(df: DataFrame, train: int, test: int, step: int, purge: str, embargo: str) -> DataFrame:
    """fold, part (train or test), rows: rolling folds by position over pos, prediction_time, label_end_time.

    A training row is kept if its label ends before the test's start less the purge, and it was predicted before that
    start less the embargo. The folds that hold a position follow from it by arithmetic: no join with folds. The start
    of each fold's test is one row a fold, joined by its number.
    """
    last = F.floor((F.col("total") - train - test) / step)
    low, high = F.greatest(F.ceil((F.col("pos") - train - test + 1) / step), F.lit(0)), F.least(F.floor(F.col("pos") / step), last)
    each = df.filter((last >= 0) & (low <= high)).withColumn("fold", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    starts = df.filter((F.col("pos") >= train) & ((F.col("pos") - train) % step == 0)).select(((F.col("pos") - train) / step).cast("int").alias("fold"), F.col("prediction_time").alias("test_start"))
    rows = each.join(starts, "fold")
    test_row = F.col("pos") >= F.col("fold") * step + train
    kept = test_row | ((F.col("label_end_time") < F.col("test_start") - F.expr(f"interval {purge}")) & (F.col("prediction_time") < F.col("test_start") - F.expr(f"interval {embargo}")))
    return rows.filter(kept).withColumn("part", F.when(test_row, "test").otherwise("train"))


def combinatorial(df: DataFrame, groups: int, tests: int, embargo: str) -> DataFrame:
    """split, part, rows of all choices of test groups; training rows that overlap a test group or its embargo are left out."""
    size = F.ceil(F.col("total") / groups)
    g = df.withColumn("g", F.floor(F.col("pos") / size).cast("int"))
    spans = g.groupBy("g").agg(F.min("prediction_time").alias("s"), F.max("label_end_time").alias("e"))
    splits = [(k, list(c)) for k, c in enumerate(combinations(range(groups), tests))]
    table = df.sparkSession.createDataFrame(splits, "split int, chosen array<int>")
    each = table.withColumn("g", F.explode("chosen")).join(spans, "g").groupBy("split", "chosen").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    rows = g.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(len(splits) - 1)))).join(F.broadcast(each), "split")
    test = F.array_contains("chosen", F.col("g"))
    near = F.exists("spans", lambda x: ((F.col("prediction_time") <= x["e"]) & (F.col("label_end_time") >= x["s"])) | ((F.col("prediction_time") > x["e"]) & (F.col("prediction_time") <= x["e"] + F.expr(f"interval {embargo}"))))
    return rows.filter(test | ~near).withColumn("part", F.when(test, "test").otherwise("train"))


def chronological(df: DataFrame, shares: dict[str, float]) -> DataFrame:
    """df with part by cumulative shares of the positions; rows whose label reaches into the next part are left out."""
    part, at = F.lit(None).cast("string"), 0.0
    for name, share in shares.items():
        part = F.when(F.col("pos") >= F.floor(F.col("total") * round(at, 9)), F.lit(name)).otherwise(part)
        at += share
    named = df.withColumn("part", part)
    order = {name: k for k, name in enumerate(shares)}
    number = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("part"))
    firsts = named.withColumn("k", number).groupBy("k").agg(F.min("prediction_time").alias("next_start")).withColumn("k", F.col("k") - 1)
    return named.withColumn("k", number).join(F.broadcast(firsts), "k", "left").filter(F.col("next_start").isNull() | (F.col("label_end_time") < F.col("next_start"))).drop("k", "next_start")
