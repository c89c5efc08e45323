"""Readers of price, calendar, journal and vintage files; every one is a lazy DataFrame with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Other names of a price file's columns.
ALIASES = {"datetime": "timestamp", "date": "timestamp", "time": "timestamp", "ts": "timestamp", "bidopen": "open", "bidhigh": "high", "bidlow": "low", "bidclose": "close"}
PRICES = ("open", "high", "low", "close")
OPTIONAL = ("volume", "spread_pips", "spread_price", "spread")


def prices_csv(spark: SparkSession, paths: str | list[str], symbol: str | None = None, zone: str | None = None) -> DataFrame:
    """symbol, ts, open, high, low, close and the optional columns of CSV files with a header.

    Every path has its own header: trimmed, lower-cased and renamed by itself, so that files may name and order their
    columns differently; files of one path (a folder, a pattern) share one. The symbol comes from its column, the
    argument or the file's name. A missing column raises at once. Times of a zone become UTC. unique_times() asserts
    what the reader cannot.
    """
    out = None
    for path in [paths] if isinstance(paths, str) else paths:
        part = _prices(spark, path, symbol, zone)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no price files")
    return out


def _prices(spark: SparkSession, path: str, symbol: str | None, zone: str | None) -> DataFrame:
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    names = [ALIASES.get(c.strip().lower(), c.strip().lower()) for c in raw.columns]
    df = raw.toDF(*names)
    if missing := [c for c in ("timestamp", *PRICES) if c not in names]:
        raise ValueError(f"{path}: missing columns: {', '.join(missing)}")
    name = F.upper("symbol") if "symbol" in names else F.lit(symbol) if symbol else F.upper(F.regexp_extract(F.input_file_name(), r"([^/._-]+)[^/]*$", 1))
    ts = F.col("timestamp").cast("timestamp_ntz")
    if zone:
        ts = F.convert_timezone(F.lit(zone), F.lit("UTC"), ts)
    return df.select(name.alias("symbol"), ts.alias("ts"), *[F.col(c).cast("double").alias(c) for c in (*PRICES, *[c for c in OPTIONAL if c in names])])


def unique_times(prices: DataFrame) -> DataFrame:
    """prices, after a check that no (symbol, ts) occurs twice."""
    if again := prices.groupBy("symbol", "ts").count().filter("count > 1").head(1):
        raise ValueError(f"duplicate time: {again[0]['symbol']} {again[0]['ts']}")
    return prices


def events_csv(spark: SparkSession, path: str | None) -> DataFrame:
    """Calendar events: ts, currency, symbol, impact (empty: high), name; an empty table without a path."""
    if path is None:
        return spark.createDataFrame([], "ts timestamp_ntz, currency string, symbol string, impact string, name string")
    raw = spark.read.option("header", True).csv(path)
    df = raw.toDF(*[ALIASES.get(c.strip().lower(), c.strip().lower()) for c in raw.columns])
    text = lambda c: F.trim(F.coalesce(F.col(c) if c in df.columns else F.lit(None), F.lit("")))
    impact = F.lower(text("impact"))
    return df.select(F.col("timestamp").cast("timestamp_ntz").alias("ts"), F.upper(text("currency")).alias("currency"), F.upper(text("symbol")).alias("symbol"), F.when(impact == "", "high").otherwise(impact).alias("impact"), text("name").alias("name"))


def journal(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; strict raises at a malformed one, else it stays as a row with malformed set and all else null."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    lines = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return lines.withColumn("malformed", F.col("_bad").isNotNull()).drop("_bad")


def series_csv(spark: SparkSession, path: str) -> DataFrame:
    """day, value of a two-column series file; a dot, a blank or a bad row is missing and left out."""
    df = spark.read.option("header", True).csv(path)
    day, value = df.columns[:2]
    return df.select(F.expr(f"try_cast(`{day}` as date)").alias("day"), F.expr(f"try_cast(`{value}` as double)").alias("value")).filter("day is not null and value is not null").orderBy("day")


def last_by_file(df: DataFrame, keys: list[str], file: str) -> DataFrame:
    """One row a key, of the last file that has it."""
    w = Window.partitionBy(*keys).orderBy(F.col(file).desc())
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def ticks_binary(spark: SparkSession, path: str, point: float) -> DataFrame:
    """Ticks of LZMA files of one hour each: 20-byte big-endian records of milliseconds, ask, bid and two volumes.

    Columns: path, ms, ask, bid, ask_volume, bid_volume. One file a task at a time.
    """
    import lzma

    import numpy as np
    import pandas as pd

    record = np.dtype([("ms", ">i4"), ("ask", ">i4"), ("bid", ">i4"), ("av", ">f4"), ("bv", ">f4")])

    def parse(batches):
        for b in batches:
            for path_, content in zip(b["path"], b["content"], strict=True):
                t = np.frombuffer(lzma.decompress(content) if len(content) else b"", record)
                yield pd.DataFrame({"path": path_, "ms": t["ms"].astype("int64"), "ask": t["ask"] * point, "bid": t["bid"] * point, "ask_volume": t["av"].astype("float64"), "bid_volume": t["bv"].astype("float64")})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, ms long, ask double, bid double, ask_volume double, bid_volume double")


def zipped_csv(spark: SparkSession, path: str, columns: list[str], sep: str = ";") -> DataFrame:
    """Rows of CSV members in ZIP files, all as strings, with the file's path."""
    import io
    import zipfile

    import pandas as pd

    def unzip(batches):
        for b in batches:
            for path_, content in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        for part in pd.read_csv(z.open(name), sep=sep, names=columns, dtype=str, chunksize=50_000):
                            part.insert(0, "path", path_)
                            yield part

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unzip, "path string, " + ", ".join(f"{c} string" for c in columns))
