"""What the operators of this subpackage share: folders, file systems, bounded broadcasts, skewed joins.

Null and edge cases of every operator are stated in its own docstring.
"""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an Arrow batch may hold on its way to Python; keeps a worker's memory small whatever the texts' lengths.
ARROW_ROWS = 512
#: Rows, and bytes as Spark would hold them, up to which a slim table may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def tune(spark: SparkSession) -> None:
    """Sets what the Arrow operators rely on for bounded memory, and lets workers import this package from where it lies."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local session gets a temporary folder; on a cluster, whose machines don't share one, it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tidewright-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_base(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame, at: str) -> DataFrame:
    """Writes df as Parquet to the folder at (of shared_dir) and reads it again: lineage ends there and survives lost executors."""
    df.write.mode("overwrite").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def filesystem(uri: str) -> tuple:
    """(pyarrow file system, path in it) of a folder named by a URI or a plain path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def drop(spark: SparkSession, *folders: str) -> None:
    """Deletes folders of shared_dir that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    for at in folders:
        p = path(at)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def blocks(batches: Iterable[pa.RecordBatch], column: int = 0, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Regroups batches so that the texts in a column come to about `most` bytes, whatever the batches hold; a single
    longer text stands alone or ends a block.

    At the end of a task, memory that Arrow and the C library keep for later goes back to the system: the worker may
    be idle for long, beside others.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    try:
        for batch in batches:
            for b in _cut(batch, column, most):
                held.append(b)
                size += b.column(column).nbytes
                if size >= most:
                    yield _joined(held)
                    held, size = [], 0
        if held:
            yield _joined(held)
    finally:
        held = []
        trim()


def _cut(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, each up to the row with which its texts come to `most` bytes."""
    import numpy as np

    array = batch.column(column)
    if not len(array) or array.nbytes < most:
        if len(array):
            yield batch
        return
    off = np.frombuffer(array.buffers()[1], np.int32, len(array) + 1, array.offset * 4).astype(np.int64)
    k = 0
    while k < len(array):
        end = min(len(array), int(np.searchsorted(off, off[k] + most, side="left")))
        end = max(end, k + 1)
        yield batch.slice(k, end - k)
        k = end


def trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def texts(array: pa.Array) -> pa.Array:
    """A string column without nulls: a null text counts as the empty one."""
    import pyarrow.compute as pc

    return pc.fill_null(array, "") if array.null_count else array


def text_bytes(array: pa.Array):
    """(all bytes as one uint8 vector, int64 offsets of the rows in it) of a string column without nulls."""
    import numpy as np

    off = np.frombuffer(array.buffers()[1], np.int32, len(array) + 1, array.offset * 4).astype(np.int64)
    data = array.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[off[0] : off[-1]], off - off[0]


def fits(small: DataFrame) -> bool:
    """Whether a table, which should be a written one, is within the bounds of a broadcast: rows, and 16 bytes a row and
    8 a column more than its texts and digests hold."""
    wide = [F.octet_length(F.col(f"`{f.name}`")) for f in small.schema.fields if f.dataType.typeName() in ("string", "binary")]
    held = sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(16 + 8 * len(small.columns)).cast("long"))
    n, size = small.agg(F.count("*"), F.coalesce(F.sum(held), F.lit(0))).first()
    return n <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def join_small(big: DataFrame, small: DataFrame, on, how: str) -> DataFrame:
    """Joins with small (a written table) broadcast if it fits, else by a shuffle that AQE may split."""
    return big.join(F.broadcast(small) if fits(small) else small.hint("shuffle_hash") if how == "left_semi" else small, on, how)


def join_skewed(big: DataFrame, keyed: DataFrame, key, size: str, total: int, how: str = "left", small: bool = True) -> DataFrame:
    """big joined with keyed (a written table, one row a key) where few keys may hold most rows of big.

    key: a column's name, or several. size names keyed's column with the rows of big per key. Keys with over
    total / 1000 rows, of which there are fewer than 1000 whatever the data, are broadcast; the rest, none of them
    large, are shuffled. If keyed fits a broadcast, all of it is sent, unless small is False.
    """
    if small and fits(keyed):
        return big.join(F.broadcast(keyed), key, how)
    keys = [key] if isinstance(key, str) else list(key)
    heavy = keyed.filter(F.col(size) > total / 1000)
    hot = [c for c in keyed.columns if c not in keys]
    near = big.join(F.broadcast(heavy.withColumn("__heavy", F.lit(True))), keys, "left")
    of_heavy = near.filter(F.col("__heavy")).drop("__heavy")
    others = near.filter(F.col("__heavy").isNull()).drop("__heavy", *hot)
    light = keyed.filter(F.col(size) <= total / 1000)
    return of_heavy.unionByName(others.join(light, keys, how))


def join_wide(big: DataFrame, keyed: DataFrame, counts: DataFrame, key: str, size: str, total: int, spread: str) -> DataFrame:
    """big inner joined with keyed (one wide row a key), none of which is broadcast, where few keys may hold most rows of big.

    counts (a written table): key (a long) and its rows of big, in the column `size`. Keys with over total / 1000 rows,
    fewer than 1000, which the driver is told, are dealt to as many tasks as they hold such shares, by the hash of big's
    column `spread`, and keyed's row is copied for each.
    """
    per = max(1.0, total / 1000)
    heavy = [(r[0], int(r[1] // per) + 1) for r in counts.filter(F.col(size) > per).select(key, size).collect()]
    if not heavy:
        return big.join(keyed, key)
    values = [",".join(str(x[k]) for x in heavy) for k in (0, 1)]
    found = F.map_from_arrays(*[F.split(F.lit(v), ",").cast(f"array<{t}>") for v, t in zip(values, ("bigint", "int"), strict=True)])
    parts = F.when(F.col(key).isin([k for k, _ in heavy]), F.element_at(found, F.col(key))).otherwise(1)
    left = big.withColumn("__salt", F.pmod(F.xxhash64(spread), parts).cast("int"))
    right = keyed.withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.join(right, [key, "__salt"]).drop("__salt")


#: Texts that share the 64-bit key with another; more than these at a time are no chance.
MOST_CLASHES = 100_000


def text_key(text: Column, clashes: list[int]) -> Column:
    """A text's 64-bit key; texts whose first key is among `clashes` have another one each."""
    first = F.xxhash64(text)
    return F.when(first.isin(clashes), F.xxhash64(F.lit("again"), text)).otherwise(first) if clashes else first


def check_key(sha256: Column) -> Column:
    """60 bits of a text's SHA-256 (hexadecimal), which tell texts of one key apart."""
    return F.conv(F.substring(sha256, 1, 15), 16, 10).cast("long")


def settled(make: Callable[[list[int]], DataFrame]) -> list[int]:
    """The clashes for text_key by which no two different texts share a key.

    make(clashes) writes what is keyed by them and returns its table of texts by v, with low and high, the least and
    greatest check_key of a key's texts. Where they differ, two texts share a key, which happens to about three pairs
    of 10**10 texts: these get other keys, and make is called again. That two texts share key and check_key, 124 bits,
    is left to chance.
    """
    clashes: list[int] = []
    for _ in range(3):
        more = [r["v"] for r in make(clashes).filter("low <> high").select("v").limit(MOST_CLASHES + 1).collect()]
        if not more:
            return clashes
        clashes = sorted({*clashes, *more})
    raise ValueError("texts share keys too often")
