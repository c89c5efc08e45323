from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np

import corpus_pipeline
from tests.llm.cases import SCHEMA, WORD, documents, grams
from tests.llm.test_dedup import alike, counted
from tests.llm.test_text import PLAIN, good, plain_mask, plain_repeats
from tidewright.llm import bpe, mixing, quality_rules
from tidewright.llm.queries import word_tokenizer


def test_stages_in_turn(spark, sf_dir, tmp_path):
    docs = documents(spark, sf_dir)
    columns = docs.columns
    sizes = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        sizes[name] = docs.count()
        if name != "pack":
            assert docs.columns == columns
        if name == "near_dedup":
            sets = [grams(r["text"]) for r in docs.collect()]
            assert not any(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
        if name == "pii":
            assert docs.filter("text rlike '[a-z]@[a-z]+[.][a-z]+'").count() == 0
    assert sizes["quality"] > sizes["near_dedup"] > 0
    assert sizes["pack"] > 0


def small_corpus(seed: int = 2):
    """Documents that each stage has something to do with; the clean ones outnumber the others."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu") for b in ("ran", "sol", "vet", "dim") for c in ("a", "en", "is", "o")]
    rows = []
    for k in range(70):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(12, 60))]
        kind = k % 7
        if kind == 1:
            words[3:3] = ["a.b@c.org", "and", "4111", "1111", "1111", "1111", "or", "+49", "30", "1234567"]
        if kind == 2:
            words = words[:8]
        if kind == 3:
            words = words[:6] * 4
        if kind == 4 and rows:
            words = rows[-1][1].split()
            if len(words) > 30:
                words[-1] = "other"
        rows.append((k, " ".join(words), "en", rng.choice(["s1", "s1", "s1", "s2", "s3", None]), len(" ".join(words)), "k", 1, "v", "l"))
    rows += [(200, None, "en", "s1", 0, "k", 1, "v", "l"), (201, "", "en", None, 0, "k", 1, "v", "l"), (None, rows[0][1], "en", "s2", 9, "k", 1, "v", "l"), rows[7]]
    return rows


def plain_quality(text):
    words = WORD.findall(text or "")
    covered, longest, _ = plain_repeats(words)
    chars, all_chars = sum(len(words[p]) for p in covered), sum(map(len, words))
    share = quality_rules.MAX_COVERED if chars > quality_rules.SHORT_CHARS else quality_rules.MAX_COVERED_SHORT
    return len(words) >= 10 and 100 * len(covered) <= 20 * len(words) and chars <= share * all_chars and longest <= quality_rules.MAX_LONGEST


def plain_unique(rows):
    sets = [counted(r[1]) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if rows[a][1] == rows[b][1] or alike(sets[a], sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    best = {}
    for r, g in zip(rows, group, strict=True):
        best.setdefault(g, []).append(r)
    return [min(rs, key=lambda r: (r[0] is None, r[0] or 0)) for rs in best.values()]


def plain_masked(row):
    text = row[1]
    spans = [(m.start(), m.end(), f"[{k.upper()}]") for k, p in PLAIN.items() for m in re.finditer(p, text) if good(k, m[0])]
    text = plain_mask(text, spans)
    return (row[0], text, row[2], row[3], len(text), *row[5:])


def plain_mixed(rows):
    """Each row as often as the SQL of the mix takes it."""
    c = duckdb.connect()
    c.sql("create table documents(doc_id bigint, text varchar, source varchar)")
    c.executemany("insert into documents values (?, ?, ?)", [(r[0], r[1], r[3]) for r in rows])
    times = Counter()
    result = c.sql(mixing.SQL)
    at = {n: k for k, n in enumerate(result.columns)}
    for x in result.fetchall():
        times[x[at["doc_id"]]] = x[at["copies"]] + int(x[at["extra_words"]] > 0 and 2 * x[at["extra_words"]] >= x[at["size"]])
    return [r for r in rows for _ in range(times[r[0]])]


def test_run_equals_a_plain_pipeline(spark, sf_dir, tmp_path):
    rows = small_corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"file://{tmp_path}/in/documents.parquet")
    kept = [r for r in rows if plain_quality(r[1])]
    unique = plain_unique(kept)
    masked = [plain_masked(r) for r in unique]
    mixed = plain_mixed(masked)
    assert len(rows) > len(kept) > len(unique) > 20
    assert sum(a[1] != b[1] for a, b in zip(unique, masked, strict=True)) > 3
    docs = spark.read.parquet(f"file://{tmp_path}/in/documents.parquet")
    for (_, stage), want in zip(corpus_pipeline.STAGES, (kept, unique, masked, mixed), strict=False):
        docs = stage(spark, docs, sf_dir)
        assert Counter(map(tuple, docs.collect())) == Counter(want)
    library = bpe.load(word_tokenizer()).library
    want = Counter()
    for r in mixed:
        ids = np.array([*library.encode(r[1], add_special_tokens=False).ids, 1], "<u4")
        want[r[0], len(ids), zlib.crc32(ids.tobytes())] += 1
    pieces, sequences = defaultdict(list), defaultdict(list)
    for p in corpus_pipeline.run(spark, f"file://{tmp_path}/in").collect():
        pieces[p["doc_id"], p["doc_tokens"]].append((p["start"], p["length"]))
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    copies = Counter((d, n) for d, n, _ in want.elements())
    assert pieces.keys() == copies.keys()
    for (d, n), parts in pieces.items():
        hit = np.zeros(n, int)
        for start, length in parts:
            hit[start : start + length] += 1
        assert (hit == copies[d, n]).all()
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048


def test_every_stage_takes_an_empty_table(spark, sf_dir):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.collect() == []
        if name != "pack":
            assert out.columns == docs.columns


def test_queries_are_registered():
    import __spark_entry__ as e

    names = {x.split("_")[0] for x in e.queries() if re.match(r"op\d", x)}
    assert names == {f"op{k}" for k in range(1, 11)}
    assert "pipeline" in e.queries()
    assert corpus_pipeline.ORACLE_SQL is None
