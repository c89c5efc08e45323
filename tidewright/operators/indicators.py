"""Indicators over bars as window expressions; recurrences as folds. All are null until enough bars are there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewright.operators.folds import fold


def by() -> WindowSpec:
    """A symbol's bars in order of time."""
    return Window.partitionBy("symbol").orderBy("open_time")


def over(n: int, shift: int = 0) -> WindowSpec:
    """The last n rows of a symbol, ending `shift` rows before the current one."""
    return by().rowsBetween(-(n - 1) - shift, -shift)


def full(value: Column, n: int, shift: int = 0) -> Column:
    """value where n rows are there, else null."""
    return F.when(F.count(F.lit(1)).over(over(n, shift)) >= n, value)


def sma(column: str, n: int) -> Column:
    return full(F.avg(column).over(over(n)), n)


def true_range() -> Column:
    prev = F.lag("close").over(by())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def channel(n: int) -> tuple[Column, Column]:
    """(highest high, lowest low) of the n bars before the current one."""
    return full(F.max("high").over(over(n, 1)), n, 1), full(F.min("low").over(over(n, 1)), n, 1)


def with_moves(df: DataFrame) -> DataFrame:
    """Adds move, gain and loss of the close against the bar before."""
    move = F.col("close") - F.lag("close").over(by())
    return df.withColumn("move", move).withColumn("gain", F.greatest("move", F.lit(0.0))).withColumn("loss", F.greatest(-F.col("move"), F.lit(0.0)))


def rsi_simple(n: int) -> Column:
    """The index of simple averages, from gain and loss: 50 where nothing moved."""
    g, l = F.avg("gain").over(over(n)), F.avg("loss").over(over(n))  # noqa: E741
    return full(F.when(g + l == 0, 50.0).otherwise(100 * g / (g + l)), n + 1)


def ewm(df: DataFrame, columns: dict[str, str], alpha: float, least: int) -> DataFrame:
    """df with exponentially weighted means, y += alpha * (x - y), begun at the first value that is there.

    columns: new name by source column; null until `least` values were there. Columns symbol and open_time are needed.
    """
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields] + [f"{n} double" for n in columns.values()]
    sources = list(columns)

    def step(state: dict, row: tuple) -> list[tuple]:
        out = []
        for s in sources:
            x = getattr(row, s)
            if x is not None and x == x:
                y, n = state.get(s, (x, 0))
                state[s] = (y + alpha * (x - y), n + 1)
            y, n = state.get(s, (None, 0))
            out.append(y if n >= least else None)
        return [(*row, *out)]

    return fold(df, ["symbol"], ["open_time"], dict, step, ", ".join(fields))


def states(df: DataFrame, enter_long: str, enter_short: str, leave: str) -> DataFrame:
    """df with position (1, 0, -1): a machine that leaves where `leave` holds and enters where the others do."""
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields] + ["position int"]

    def step(state: dict, row: tuple) -> list[tuple]:
        p = state.get("p", 0)
        if p and getattr(row, leave):
            p = 0
        if not p:
            p = 1 if getattr(row, enter_long) else -1 if getattr(row, enter_short) else 0
        state["p"] = p
        return [(*row, p)]

    return fold(df, ["symbol"], ["open_time"], dict, step, ", ".join(fields))
