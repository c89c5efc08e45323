"""WARC archives written and read as a table of payload chunks."""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import filesystem, join_skewed, shared_dir, tune, written

#: Payload bytes in a row of the chunk table; bytes from which equal payloads are stored once; bytes of an archive file.
CHUNK, LEAST_SHARED, FILE_BYTES = 1 << 18, 1000, 256 << 20
# Fixed values of the format.
VERSION = "WARC/1.1"
DATE = "WARC-Date: 1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_FILES = "path string, n_records long"
_CHUNKS = "record_id string, page_id long, url string, record_type string, refers_to long, chunk_no int, is_last boolean, bytes_so_far long, digest_so_far string, payload_bytes long, payload_digest string"


def planned(pages: DataFrame) -> DataFrame:
    """Each page as a record: record_id, page_id, url, payload, payload_bytes, payload_digest (SHA-1), record_type,
    refers_to, refers_to_id, refers_to_url.

    Pages of equal payloads (length, SHA-1 and MD5; null html: empty) of at least LEAST_SHARED bytes: the largest
    page_id is the response, the others refer to it. Groups are counted before the shuffle and joined back as
    join_skewed says, so that a group of any size is no hot task. Repeated rows of the response's id are responses
    each; null ids are never the response of a group that has another, and refer to it. Every record has an id of its
    own; that of a response which others refer to follows from its page and payload. refers_to_id is null where several
    rows have the response's page_id.
    """
    slim = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary").alias("b"))
    slim = slim.select("page_id", "url", F.octet_length("b").cast("long").alias("n"), F.concat_ws(":", F.octet_length("b").cast("string"), F.sha1("b"), F.md5("b")).alias("key"))
    per_page = slim.filter(F.col("n") >= LEAST_SHARED).groupBy("key", "page_id").agg(F.count("*").alias("rows"), F.max("url").alias("url"))
    groups = per_page.groupBy("key").agg(F.max("page_id").alias("response"), F.max_by(F.struct("rows", "url"), "page_id").alias("of"), F.sum("rows").alias("n_pages")).filter("n_pages > 1")
    folder = shared_dir(pages.sparkSession)
    groups = written(groups.select("key", "response", (F.col("of.rows") == 1).alias("alone"), F.col("of.url").alias("refers_to_url"), "n_pages"), f"{folder}/groups")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    rows = rows.withColumn("key", F.concat_ws(":", F.col("payload_bytes").cast("string"), "payload_digest", F.md5("payload")))
    total = groups.agg(F.coalesce(F.sum("n_pages"), F.lit(0))).first()[0]
    rows = join_skewed(rows, groups, "key", "n_pages", total)
    again = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    known = _as_uuid(F.md5(F.concat_ws(":", F.col("response").cast("string"), "key").cast("binary")))
    own = F.when(F.col("response").isNotNull() & F.col("alone") & ~again, known).otherwise(F.uuid())
    return rows.select(
        own.alias("record_id"), "page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("response")).cast("long").alias("refers_to"), F.when(again & F.col("alone"), known).alias("refers_to_id"), F.when(again, F.col("refers_to_url")).alias("refers_to_url"),
    )


def _as_uuid(digest: Column) -> Column:
    """32 hexadecimal digits as a UUID of version 8."""
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-8"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12))


def chunk_rows(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The planned records as rows of (record_id, chunk_no, data), each record's chunks in turn; revisits have one, empty.

    The rows are generated and cut within one compiled stage: of a payload, which its page's row holds, a chunk is
    copied at a time, and only the chunk goes on.
    """
    stored = F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0)
    n = F.greatest(F.ceil(stored / chunk), F.lit(1)).cast("int")
    rows = records.withColumn("n_chunks", n).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    data = F.when(F.col("record_type") == "response", F.col("payload").substr(F.col("chunk_no") * chunk + 1, F.lit(chunk))).otherwise(F.lit(b""))
    return rows.select("record_id", "page_id", "url", "record_type", "refers_to", "refers_to_id", "refers_to_url", "payload_bytes", "payload_digest", "chunk_no", "n_chunks", data.alias("data"))


def _clean(text: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text or "")


def _block_digest(block: bytes) -> str:
    return f"WARC-Block-Digest: sha1:{hashlib.sha1(block, usedforsecurity=False).hexdigest()}"


def _record(lines: list[str]) -> bytes:
    return "\r\n".join([VERSION, *lines]).encode() + b"\r\n\r\n"


def about(name: str) -> bytes:
    """The warcinfo record that a file begins with."""
    block = b"software: tidewright\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Filename: {name}", DATE, _block_digest(block), "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return _record(lines) + block + b"\r\n\r\n"


def heads(r: dict) -> bytes:
    """A record's header lines and the HTTP header before its payload, from its first chunk's row.

    Content-Length of the HTTP header is the full payload's. The digest of the block, which stands before it, is given
    where the block is at hand: for revisits and for payloads of one chunk.
    """
    n, kind, digest = r["payload_bytes"], r["record_type"], r["payload_digest"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{r['record_id']}>", f"WARC-Target-URI: {_clean(r['url'])}", DATE, f"WARC-Payload-Digest: sha1:{digest}"]
    if r["n_chunks"] == 1:
        lines.append(_block_digest(http + r["data"]))
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (n if kind == 'response' else 0)}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To-Target-URI: {_clean(r['refers_to_url'])}", f"WARC-Refers-To-{DATE[5:]}", f"X-Refers-To-Page: {r['refers_to']}"]
        if r["refers_to_id"]:
            lines.append(f"WARC-Refers-To: <urn:uuid:{r['refers_to_id']}>")
    if r["page_id"] is not None:
        lines.append(f"X-Page-ID: {r['page_id']}")
    return _record(lines) + http


def write_warc(chunks: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes chunk rows as .warc.gz files and returns the manifest (path, n_records: without the warcinfo record).

    A file is what the standard asks for: a gzip member for each record, one after the other, so that any reader of
    WARC or of gzip can read all of it, or a record by itself from where it begins.

    A record's chunks must stand together in their partition, as chunk_rows leaves them; no record is ever whole in
    Python. Files have new names in each attempt of a task; the manifest, written to folder, has those of attempts
    that ended.
    """
    tune(chunks.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        part, path, out, member, done, n = TaskContext.get().partitionId(), "", None, None, [], 0
        for b in batches:
            names = b.schema.names
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                r = dict(zip(names, row, strict=True))
                if r["chunk_no"] == 0:
                    if out is None:
                        path, n = f"{root}/{part:06d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(path, compression=None)  # by its name it would be compressed again
                        member = zlib.compressobj(1, zlib.DEFLATED, 31)
                        out.write(member.compress(about(path.rsplit("/", 1)[1])) + member.flush())
                    member = zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(member.compress(heads(r)))
                out.write(member.compress(r["data"]))
                if r["chunk_no"] == r["n_chunks"] - 1:
                    out.write(member.compress(b"\r\n\r\n") + member.flush())
                    n += 1
                    if out.tell() >= file_bytes:
                        out.close()
                        out = None
                        done.append((path, n))
        if out is not None:
            out.close()
            done.append((path, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done]), pa.array([k for _, k in done], pa.int64())], ["path", "n_records"])

    return written(chunks.mapInArrow(write, _FILES), f"{folder}/manifest")


class _Members:
    """Reads a stream of gzip members as one stream of bytes."""

    def __init__(self, raw, piece: int = 1 << 18):
        self.raw, self.piece, self.z, self.held, self.rest = raw, piece, None, bytearray(), b""

    def _more(self) -> bool:
        while True:
            data = self.rest or self.raw.read(self.piece)
            if not data:
                return False
            self.z = self.z or zlib.decompressobj(31)
            got = self.z.decompress(data, self.piece)
            self.rest = self.z.unconsumed_tail
            if self.z.eof:
                self.rest, self.z = self.z.unused_data, None
            if got:
                self.held += got
                return True

    def until(self, mark: bytes) -> bytes:
        """Bytes up to mark, which is consumed; empty at the end of the stream."""
        while (at := self.held.find(mark)) < 0:
            if not self._more():
                if self.held.strip(b"\r\n"):
                    raise ValueError("archive ends within a header")
                return b""
        found = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return found

    def some(self, most: int) -> bytes:
        if not self.held and not self._more():
            raise ValueError("archive ends within a payload")
        found = bytes(self.held[:most])
        del self.held[: len(found)]
        return found


def records(raw, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], int, bool, bytes]]:
    """(headers, chunk_no, is_last, data) of every payload chunk of a .warc.gz stream, at most `chunk` bytes each; no warcinfo records."""
    stream = _Members(raw)
    while head := stream.until(b"\r\n\r\n"):
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        if fields["WARC-Type"] == "warcinfo":
            left = int(fields["Content-Length"]) + 4
            while left:
                left -= len(stream.some(left))
            continue
        http = stream.until(b"\r\n\r\n")
        fields |= {f"HTTP {k}": v for k, v in (x.split(": ", 1) for x in http.decode().split("\r\n")[1:])}
        left, no = int(fields["Content-Length"]) - len(http) - 4, 0
        while True:
            part = io.BytesIO()
            while left and part.tell() < chunk:
                left -= len(got := stream.some(min(left, chunk - part.tell())))
                part.write(got)
            yield fields, no, not left, part.getvalue()
            no += 1
            if not left:
                break
        if stream.until(b"\r\n\r\n"):
            raise ValueError("a record is longer than it says")


def read_warc(manifest: DataFrame, folder: str, with_data: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of the archives in a manifest: a row for each record and chunk, digests running along.

    record_id, page_id, url, record_type, refers_to, chunk_no, is_last, bytes_so_far, digest_so_far (SHA-1 of the chunks so
    far), payload_bytes and payload_digest of the full payload as the record states them, and data if wanted. A
    stored payload whose digest isn't as stated raises an error.
    """
    n = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in _CHUNKS.split(", ")] + ["data"] * with_data

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names)

        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None, buffer_size=1 << 20) as raw:
                    for f, no, last, data in records(raw, chunk):
                        if no == 0:
                            digest, so_far = hashlib.sha1(usedforsecurity=False), 0
                        digest.update(data)
                        so_far += len(data)
                        stated = f["WARC-Payload-Digest"].removeprefix("sha1:")
                        if last and f["WARC-Type"] == "response" and digest.hexdigest() != stated:
                            raise ValueError(f"payload of {f['WARC-Record-ID']} doesn't match its digest")
                        page, refers = f.get("X-Page-ID"), f.get("X-Refers-To-Page")
                        rows.append((f["WARC-Record-ID"][10:-1], None if page is None else int(page), f["WARC-Target-URI"], f["WARC-Type"], None if refers is None else int(refers), no, last, so_far, digest.hexdigest(), int(f["HTTP Content-Length"]), stated) + ((data,) if with_data else ()))
                        held += len(data) if with_data else 0
                        if len(rows) >= 2000 or held >= 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return manifest.select("path").repartitionByRange(n, "path").mapInArrow(read, _CHUNKS + ", data binary" * with_data)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, from archives written and read back.

    Null html is an empty payload; null ids and urls stay null and empty. An empty table gives no rows.
    """
    folder = shared_dir(pages.sparkSession)
    manifest = write_warc(chunk_rows(planned(pages)), f"{folder}/warc")
    return read_warc(manifest, f"{folder}/warc", with_data=False).filter("is_last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
g AS (SELECT html, max(page_id) AS response FROM p WHERE n >= 1000 GROUP BY html HAVING count(*) > 1),
j AS (SELECT p.*, g.response, coalesce(g.response <> p.page_id, false) AS again FROM p LEFT JOIN g ON p.html = g.html)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN response END AS refers_to FROM j
"""
