"""Recurrences over sorted keys: state runs along the rows of a key, in bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], dict], step: Callable[[dict, tuple], list[tuple]], schema: str, end: Callable[[dict], list[tuple]] | None = None) -> DataFrame:
    """Runs step over the rows of each key in order; one shuffle by key, one sort that may spill, rows streamed.

    step(state, row) gives rows out, row being a named tuple; end(state) gives the last ones of a key. A key's rows
    are never held together, so a key of any size needs the memory of its state alone.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, {}
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False):
                now = tuple(getattr(row, k) for k in keys)
                if now != key:
                    if key is not None and end is not None:
                        out += end(state)
                    key, state = now, start()
                out += step(state, row)
            if out:
                yield pd.DataFrame(out, columns=names)
        if key is not None and end is not None and (last := end(state)):
            yield pd.DataFrame(last, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def thinned(df: DataFrame, keys: list[str], ts: str, tie: str, gap_seconds: float) -> DataFrame:
    """Rows of df that are at least the gap after the last kept row of their key (greedy), by (ts, tie)."""
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields]

    def step(state: dict, row: tuple) -> list[tuple]:
        now = getattr(row, ts)
        if state["last"] is not None and (now - state["last"]).total_seconds() < gap_seconds:
            return []
        state["last"] = now
        return [tuple(row)]

    return fold(df, keys, [ts, tie], lambda: {"last": None}, step, ", ".join(fields))
