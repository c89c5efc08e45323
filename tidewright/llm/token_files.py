"""Token ids in length-delimited binary files, with a separate index of offsets for shuffled reads."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.bpe import BLOCK, load, proof
from tidewright.llm.common import blocks, filesystem, shared_dir, texts, tune, written
from tidewright.llm.framing import frames, unframed

#: Bytes after which a task starts another shard.
SHARD_BYTES = 64 << 20
#: A payload's head: version, bytes of an id, whether doc_id is there, doc_id, number of ids.
HEAD = struct.Struct("<BBBxqI")
_MANIFEST = "part int, shard int, path string, index_path string, n_records long, n_ids long, n_bytes long"


def payload(doc_id: int | None, ids: np.ndarray) -> bytes:
    """A serialized sequence; ids take two bytes each where all of them fit."""
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return HEAD.pack(1, width, doc_id is not None, doc_id or 0, len(ids)) + ids.astype(f"<u{width}").tobytes()


def parsed(record: bytes) -> tuple[int | None, np.ndarray]:
    """(doc_id, ids as little-endian uint32) of a payload."""
    _, width, there, doc_id, n = HEAD.unpack_from(record)
    return doc_id if there else None, np.frombuffer(record, f"<u{width}", n, HEAD.size).astype("<u4")


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end: int | None = 1, partitions: int | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes every text and writes shards in ascending doc_id (part, then shard, then place in it). Returns the manifest.

    docs: doc_id (integer) and text; other columns are ignored. Range partitions of doc_id, and within an id of the
    text's hash, are one shuffle of the texts: many rows without an id, or of one, are no hot task; each task encodes its own and writes record files of about shard_bytes under folder, each with a Parquet
    index (doc_id, offset, n_bytes, n_ids) beside it. A file's name is new in each attempt of a task and only files
    of attempts that ended are in the manifest, which is written to folder, so that retries and lost executors do no
    harm. Null texts count as empty: the record then holds `end` alone, or nothing. Null ids come first. Repeated
    rows give a record each; rows of one doc_id follow each other by their
    texts' hash, then text. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    tune(spark)
    proven = proof(spark, tokenizer)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(partitions, "doc_id", "tie") if partitions else rows.repartitionByRange("doc_id", "tie")
    rows = rows.sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, (fs, root), part, shard = load(tokenizer, proven), filesystem(folder), TaskContext.get().partitionId(), 0
        out, done = None, []

        def close() -> None:
            nonlocal out
            out["stream"].close()
            index = f"{out['path']}.index.parquet"
            with fs.open_output_stream(index) as f:
                pq.write_table(pa.table({"doc_id": pa.array(out["doc"], pa.int64()), "offset": pa.array(out["offset"], pa.int64()), "n_bytes": pa.array(out["size"], pa.int64()), "n_ids": pa.array(out["n"], pa.int64())}), f)
            done.append((part, shard, out["path"], index, len(out["n"]), sum(out["n"]), out["at"]))
            out = None

        fs.create_dir(root, recursive=True)
        for b in pieces.over(blocks(batches, 1, BLOCK)):
            ids, off = pieces.encode(texts(b.column(1)), end)
            docs_, bounds = b.column(0).to_pylist(), off.tolist()
            records = frames([payload(d, ids[i:j]) for d, i, j in zip(docs_, bounds, bounds[1:], strict=False)])
            for d, r, i, j in zip(docs_, records, bounds, bounds[1:], strict=False):
                if out is None:
                    path = f"{root}/{part:06d}-{shard:04d}-{uuid.uuid4().hex}.records"
                    out = {"path": path, "stream": fs.open_output_stream(path), "at": 0, "doc": [], "offset": [], "size": [], "n": []}
                out["stream"].write(r)
                for k, v in (("doc", d), ("offset", out["at"]), ("size", len(r)), ("n", j - i)):
                    out[k].append(v)
                out["at"] += len(r)
                if out["at"] >= shard_bytes:
                    close()
                    shard += 1
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["part", "shard", "path", "index_path", "n_records", "n_ids", "n_bytes"])

    return written(rows.mapInArrow(write, _MANIFEST), f"{folder}/manifest")


def read_token_files(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Reads the shards of a manifest back: doc_id, start, n_tokens, ids_crc32, part, shard, place (and ids, if wanted).

    start counts the ids of all records before. One task a shard; only one small window over the manifest, of a row
    for each shard, is not parallel. Damaged records raise an error.
    """
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("part", "shard", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    n = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for b in batches:
            for part, shard, path, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                start, place = base, 0
                with fs.open_input_stream(path, buffer_size=1 << 20) as f:
                    for records in unframed(f):
                        got = [parsed(r) for r in records]
                        sizes = np.array([len(i) for _, i in got], np.int64)
                        starts = start + np.cumsum(sizes) - sizes
                        cols = [pa.array([d for d, _ in got], pa.int64()), pa.array(starts), pa.array(sizes), pa.array([zlib.crc32(i.tobytes()) for _, i in got], pa.int64()), pa.array([part] * len(got), pa.int32()), pa.array([shard] * len(got), pa.int32()), pa.array(np.arange(place, place + len(got)))]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32", "part", "shard", "place"]
                        if with_ids:
                            cols.append(pa.array([i.astype(np.int64) for _, i in got], pa.list_(pa.int64())))
                            names.append("ids")
                        yield pa.RecordBatch.from_arrays(cols, names)
                        start += int(sizes.sum())
                        place += len(got)

    return based.repartitionByRange(n, "part", "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, shard int, place long" + ", ids array<long>" * with_ids)


def read_records(folder: str, path: str, index_path: str, places: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """Some records of a shard in the wanted order, by the offsets in its index alone: the access of a shuffled read."""
    fs, _ = filesystem(folder)
    with fs.open_input_file(index_path) as f:
        index = pq.read_table(f, columns=["offset", "n_bytes"])
    found = []
    with fs.open_input_file(path) as f:
        for k in places:
            at, n = index["offset"][k].as_py(), index["n_bytes"][k].as_py()
            found += [parsed(r) for r in next(unframed(pa.BufferReader(f.read_at(n, at))))]
    return found


def token_files(docs: DataFrame, tokenizer: str, end: int = 1) -> DataFrame:
    """Writes docs to token files in a new shared folder and reads them back (see the two functions)."""
    folder = shared_dir(docs.sparkSession)
    return read_token_files(write_token_files(docs, tokenizer, f"{folder}/tokens", end), f"{folder}/tokens").select("doc_id", "start", "n_tokens", "ids_crc32")
