from __future__ import annotations

import os
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import documents, rows_of
from tidewright.llm import bpe, framing, packing, token_counts, token_files
from tidewright.llm.common import shared_dir
from tidewright.llm.queries import word_tokenizer


@pytest.fixture(scope="module")
def pieces():
    return bpe.load(word_tokenizer())


def ids_of(pieces, texts):
    return [e.ids for e in pieces.library.encode_batch(texts, add_special_tokens=False)]


def test_every_letter_encodes_as_in_the_library(pieces):
    texts = [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}'s" for c in range(1, 0x2100) if not 0xD800 <= c < 0xE000] + ["", " ", "x" * 300, "a<|endoftext|>b", "don't'll", "ΑΣ Σίσυφος"]
    ids, off = pieces.encode(pa.array(texts))
    assert [ids[i:j].tolist() for i, j in zip(off, off[1:], strict=False)] == ids_of(pieces, texts)
    assert pieces.counts(pa.array(texts)).tolist() == np.diff(off).tolist()


def test_whole_tokens_are_proven(pieces):
    some = list(pieces.whole)[::500]
    assert ids_of(pieces, some) == [[pieces.whole[t]] for t in some]


def test_counts(spark, sf_dir, pieces):
    df = documents(spark, sf_dir, 60)
    want = sorted(((d, len(t.encode()), len(i), len(i) > 2048) for (d, t), i in zip(rows_of(df), ids_of(pieces, [t for _, t in rows_of(df)]), strict=True)), key=str)
    assert sorted(map(tuple, token_counts.token_counts(df, word_tokenizer()).collect()), key=str) == want
    assert token_counts.token_counts(df.limit(0), word_tokenizer()).collect() == []


def test_checksums_of_the_format():
    def plain(b):
        c = 0xFFFFFFFF
        for x in b:
            c ^= x
            for _ in range(8):
                c = c >> 1 ^ (framing.POLYNOMIAL if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    records = [b"123456789", b"", b"a", b"\0" * 40, os.urandom(63), os.urandom(64), os.urandom(65), os.urandom(5000)]
    assert framing.crc32c(records).tolist() == [plain(r) for r in records]
    assert plain(b"123456789") == 0xE3069283
    data = b"".join(framing.frames(records))
    assert [p for part in framing.unframed(pa.BufferReader(data)) for p in part] == records
    with pytest.raises(framing.Damaged):
        list(framing.unframed(pa.BufferReader(data[:-7] + bytes([data[-7] ^ 1]) + data[-6:])))
    with pytest.raises(framing.Damaged):
        list(framing.unframed(pa.BufferReader(data[:-1])))


def test_files_round_trip(spark, sf_dir, pieces):
    df = documents(spark, sf_dir, 60)
    tie = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    rows = sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]], r[1] is not None, r[1] or ""))
    rows = [(d, t or "") for d, t in rows]
    at, want = 0, []
    for (d, _), i in zip(rows, ids_of(pieces, [t for _, t in rows]), strict=True):
        i = [*i, 1]
        want.append((d, at, len(i), zlib.crc32(struct.pack(f"<{len(i)}I", *i))))
        at += len(i)
    folder = shared_dir(spark)
    manifest = token_files.write_token_files(df, word_tokenizer(), folder, partitions=3, shard_bytes=20_000)
    assert manifest.count() > 3
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(manifest, folder).collect())
    assert sorted((s, n, c) for _, s, n, c in want) == [(s, n, c) for s, _, n, c in got]
    assert sorted(map(str, [(s, d) for d, s, _, _ in want])) == sorted(map(str, [(s, d) for s, d, _, _ in got]))
    assert token_files.write_token_files(df.select(F.lit(None).cast("long").alias("doc_id"), "text"), word_tokenizer(), shared_dir(spark), partitions=4).select("part").distinct().count() > 2
    m = manifest.orderBy("part", "shard").first()
    last, first = token_files.read_records(folder, m["path"], m["index_path"], [m["n_records"] - 1, 0])
    assert len(first[1]) == want[0][2]
    assert len(last[1]) == want[m["n_records"] - 1][2]
    assert token_files.token_files(df.limit(0), word_tokenizer()).collect() == []


def test_packing_places_every_id_once(spark, sf_dir, pieces):
    df = documents(spark, sf_dir, 100).repartition(2)
    want = defaultdict(int)
    ids = defaultdict(list)
    for (d, _), i in zip(rows_of(df), ids_of(pieces, [t for _, t in rows_of(df)]), strict=True):
        i = [*i, 1]
        want[d, len(i)] += len(i)
        ids[d, len(i)].append(np.array(i, "<u4"))
    got, sequences, at = defaultdict(int), defaultdict(list), defaultdict(list)
    for r in packing.packed(df, word_tokenizer()).collect():
        key = r["doc_id"], r["doc_tokens"]
        got[key] += r["length"]
        at[key].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["tier"]))
        assert r["ids_crc32"] in {zlib.crc32(i[r["start"] : r["start"] + r["length"]].tobytes()) for i in ids[key]}
    assert got == want
    for (_, n), parts in at.items():  # each id of each row lies in one piece
        hit = np.zeros(n, int)
        for start, length in parts:
            hit[start : start + length] += 1
        assert len(set(hit.tolist())) == 1
    short = 0
    for parts in sequences.values():
        end = 0
        for offset, length, tier in sorted(parts):
            assert offset == end
            assert tier in packing.TIERS
            end += length
        short += end < parts[0][2]
        assert end == parts[0][2] or (end < 2048 and parts[0][2] == 2048)
    assert short <= 2
    assert packing.packed(df.limit(0), word_tokenizer()).collect() == []


def packed_by_hand(docs, size=500):
    p = packing.Packer(0)
    pieces = []
    for k in range(0, len(docs), size):
        pieces += p.add(docs[k : k + size])
    return pieces + p.end()


def test_a_packer_cuts_little():
    rng = np.random.default_rng(0)
    docs = [(k, rng.integers(0, 9, int(n)).astype("<u4")) for k, n in enumerate(rng.integers(1, 3000, 2000))]
    pieces = packed_by_hand(docs)
    assert sum(x[2] for x in pieces) == sum(len(i) for _, i in docs)
    assert len(pieces) < 2.2 * len(docs)
    for doc, start, length, crc, *_ in pieces:
        assert zlib.crc32(docs[doc][1][start : start + length].tobytes()) == crc


def test_tails_stay_within_tiers():
    docs = [(k, np.arange(300, dtype="<u4")) for k in range(3)]
    pieces = packed_by_hand(docs)
    held = defaultdict(int)
    for x in pieces:
        assert x[7] in packing.TIERS
        held[x[5], x[7]] += x[2]
    assert sum(n < tier for (_, tier), n in held.items()) <= 1
    assert sum(held.values()) == 900


def test_step_groups_are_alike():
    rng = np.random.default_rng(1)
    docs = [(k, np.zeros(int(n), "<u4")) for k, n in enumerate(rng.integers(1, 3000, 1500))]
    groups, tiers = defaultdict(int), defaultdict(set)
    for x in packed_by_hand(docs):
        groups[x[8]] += x[2]
        tiers[x[8]].add(x[7])
    assert len(groups) > 2 * packing.OPEN_GROUPS
    assert max(groups.values()) <= packing.STEP_TOKENS + 2048
    assert min(groups.values()) > packing.STEP_TOKENS / 2
    assert sum(len(t) > 1 for t in tiers.values()) > len(tiers) / 2


def test_long_texts(spark, pieces):
    """Texts beyond a block's size, of words and without any white space, in every operator that encodes or measures."""
    rng = random.Random(3)
    words = " ".join(rng.choice(["alpha", "beta", "gamma", "x1"]) for _ in range(500_000))
    df = spark.createDataFrame([(1, words), (2, "y" * 2_500_000), (3, "short"), (None, words)], "doc_id long, text string")
    n = {1: len(pieces.library.encode(words, add_special_tokens=False).ids), 2: len(pieces.library.encode("y" * 2_500_000, add_special_tokens=False).ids)}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(df, word_tokenizer()).collect() if r["doc_id"] in n} == n
    assert {r["doc_id"]: r["n_tokens"] - 1 for r in token_files.token_files(df, word_tokenizer()).collect() if r["doc_id"] in n} == n
    assert {r["doc_id"]: r["doc_tokens"] - 1 for r in packing.packed(df, word_tokenizer()).collect() if r["doc_id"] in n} == n


def test_other_rules_are_refused(tmp_path):
    import json

    import public_tokenizers

    rules = json.load(open(word_tokenizer()))
    rules["normalizer"] = None
    path = tmp_path / "other.json"
    path.write_text(json.dumps(rules))
    for other in (str(path), public_tokenizers.path("byte_bpe_50k.json")):
        with pytest.raises(ValueError, match="rules"):
            bpe.WordPieces(other)


def test_the_proof_is_stored_once(spark, pieces):
    at = bpe.proof(spark, word_tokenizer())
    assert bpe._stored(at) == pieces.whole
    assert bpe.proof(spark, word_tokenizer()) == at


def test_blocks_are_cut_and_joined():
    from tidewright.llm.common import blocks

    texts = ["x" * n for n in (5, 0, 30, 200, 1, 1, 99, 100, 101, 7)] + [None, "y"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["n", "text"])
    for batches in ([batch], [batch.slice(k, 1) for k in range(len(texts))], [batch.slice(3, 6), batch.slice(0, 0), batch.slice(9)]):
        got = list(blocks(iter(batches), 1, 100))
        assert pa.Table.from_batches(got).to_pylist() == pa.Table.from_batches([b for b in batches if b.num_rows]).to_pylist()
        for b in got:
            sizes = [len(x or "") for x in b.column(1).to_pylist()]
            assert sum(sizes[:-1]) < 160
