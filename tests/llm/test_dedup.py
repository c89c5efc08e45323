from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from tests.llm.cases import WORD, documents, rows_of
from tidewright.llm import dartminhash, near_dedup, suffix_dedup


def plain_removal(rows, length=suffix_dedup.LENGTH):
    count = Counter()
    for _, t in rows:
        b = t.encode()
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, t in rows:
        b = t.encode()
        runs = suffix_dedup.runs_of([(i, i + length) for i in range(len(b) - length + 1) if count[b[i : i + length]] > 1])
        kept, at = b"", 0
        for s, e in runs:
            kept, at = kept + b[at:s], e
        out.append((d, len(b), sum(e - s for s, e in runs), len(runs), hashlib.sha256(kept + b[at:]).hexdigest()))
    return sorted(out, key=str)


def passages(seed: int):
    rng = random.Random(seed)
    some = ["".join(rng.choice("abcdefghij \n") for _ in range(n)) for n in (150, 199, 200, 201, 260, 400, 900)]
    rows = []
    for i in range(40):
        t = ""
        for _ in range(rng.randint(0, 4)):
            q = rng.choice(some)
            x = rng.randrange(len(q))
            t += rng.choice([q, q[x:], q[:x] + "€" + q[x + 1 :]]) + "".join(rng.choice("klmnop") for _ in range(rng.choice([0, 3, 90])))
        rows.append((i, t))
    return [*rows, (100, "a" * 1000), (101, "ab" * 300), (102, None), (103, ""), (104, rows[0][1]), (104, rows[0][1]), (105, "a" * 199), (None, rows[3][1] + "x")]


def test_removal_equals_brute_force(spark):
    rows = passages(3)
    df = spark.createDataFrame([(*r, 1, "v") for r in rows], "doc_id long, text string, c long, v string")
    want = plain_removal([(d, t or "") for d, t in rows])
    assert sorted(map(tuple, suffix_dedup.without_repeats(df).collect()), key=str) == want
    assert sorted(map(tuple, suffix_dedup.without_repeats(df, most_contexts=2).collect()), key=str) == want
    assert suffix_dedup.without_repeats(df.limit(0)).collect() == []


def test_removal_around_a_hot_anchor(spark, monkeypatch):
    """Many contexts of the same bytes, alike for longer or shorter on either side, some of whole ranges."""
    rng = random.Random(9)
    gram = "".join(rng.choice("xyz") for _ in range(60))
    lefts = ["".join(rng.choice("ab") for _ in range(170)) for _ in range(6)]
    rights = ["".join(rng.choice("cd") for _ in range(170)) for _ in range(6)]
    rows = []
    for k in range(160):
        one, two = rng.choice(lefts), rng.choice(rights)
        cut, until = rng.choice([0, 20, 60, 100, 140, 170]), rng.choice([0, 3, 20, 60, 100, 140, 170])
        rows.append((k, f"{k:03d}" + "".join(rng.choice("ef") for _ in range(cut)) + one[cut:] + gram + two[:until] + "".join(rng.choice("gh") for _ in range(170 - until))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_removal(rows)
    assert 0 < sum(r[2] > 0 for r in want) < len(rows)
    for most in (3, 12):
        monkeypatch.setattr(suffix_dedup, "SORTED_ROWS", most)
        assert sorted(map(tuple, suffix_dedup.without_repeats(df, most_contexts=most).collect()), key=str) == want


def test_texts_that_share_a_key(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tidewright.llm import common

    def weak(text, clashes):
        first = F.pmod(F.xxhash64(text), F.lit(50))
        return F.when(first.isin(clashes), F.xxhash64(F.lit("again"), text)).otherwise(first) if clashes else first

    monkeypatch.setattr(suffix_dedup, "text_key", weak)
    monkeypatch.setattr(near_dedup, "text_key", weak)
    rows = passages(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, suffix_dedup.without_repeats(df).collect()), key=str) == plain_removal([(d, t or "") for d, t in rows])
    want, _ = classes([(d, t or "") for d, t in rows])
    assert sorted(((r["doc_id"], r["class_id"]) for r in near_dedup.near_classes(df).collect()), key=str) == want
    assert common.settled(lambda c: df.select(F.lit(1).cast("long").alias("v"), F.lit(1).alias("low"), F.lit(1).alias("high"))) == []


def test_removal_on_the_table(spark, sf_dir):
    df = documents(spark, sf_dir, 120)
    assert sorted(map(tuple, suffix_dedup.without_repeats(df).collect()), key=str) == plain_removal(rows_of(df))


def test_long_texts_have_the_same_anchors(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("abc") for _ in range(20_000))

    def rows():
        return sorted(x for b in suffix_dedup._anchor_rows(np.array([7]), pa.array([text])) for x in zip(*(c.to_pylist() for c in b.columns), strict=True))

    whole = rows()
    monkeypatch.setattr(suffix_dedup, "BLOCK", 3000)
    assert rows() == whole


def test_deep_shallow_sort():
    rng = random.Random(2)
    strings = list(dict.fromkeys("".join(rng.choice("ab\0") for _ in range(rng.randint(0, 90))).encode() * rng.choice([1, 1, 2]) for _ in range(400)))
    strings += strings[:20]
    order, lcp = suffix_dedup.deep_shallow(strings)
    assert [strings[k] for k in order] == sorted(strings)
    for (a, b), shared in zip(zip(order, order[1:], strict=False), lcp[1:], strict=True):
        x, y = strings[a], strings[b]
        n = next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))
        assert shared == n
    assert any(len(g) > 1 for g in suffix_dedup.shallow_sort([s.ljust(80, b"z") for s in strings]))


def test_signatures_estimate_weighted_resemblance():
    rng = np.random.default_rng(0)
    x = dartminhash.mix(np.arange(300))
    a = rng.random(300) * 5
    b = a * np.where(rng.random(300) < 0.3, 0.4, 1)
    s = dartminhash.signatures(np.concatenate([x, x]), np.concatenate([a, b]), np.array([0, 300, 600]), 2000)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04
    assert not (dartminhash.signatures(x[:0], a[:0], np.array([0, 0]), 10)).any()


def counted(text):
    w = WORD.findall(text)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (Counter([tuple(w)]) if w else Counter())


def alike(a, b, least=0.8):
    common = sum((a & b).values())
    return bool(common) and common >= least * (sum(a.values()) + sum(b.values()) - common)


def classes(rows):
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    sets = [counted(t) for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            if rows[a][1] == rows[b][1] or alike(sets[a], sets[b]):
                parent[find(a)] = find(b)
    ids: dict[int, list] = {}
    for k, (d, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(d)
    return sorted(((d, min((x for x in ids[find(k)] if x is not None), default=None)) for k, (d, _) in enumerate(rows)), key=str), ids


def edited(seed: int, first_id: int, schema_row=lambda d, t: (d, t, "en", "s", 1, "k", 1, "v", "l")):
    """Versions of a text, of a text with a line that repeats, and one text twice over."""
    rng = random.Random(seed)
    base = [f"t{k}" for k in range(70)]
    lines = [f"u{k}" for k in range(30)] + "again and again the same line".split() * 9
    out = []
    for i in range(60):
        w = list(base if i < 40 else lines)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(999)}"
        out.append(schema_row(first_id + i, " ".join(w)))
    return [*out, schema_row(first_id + 60, " ".join(base * 2)), schema_row(first_id + 61, " ".join(lines[:84]))]


def test_near_classes_equal_brute_force(spark, sf_dir):
    df = documents(spark, sf_dir)
    df = df.union(spark.createDataFrame(edited(4, 9100), df.schema))
    want, groups = classes(rows_of(df))
    got = near_dedup.near_classes(df).collect()
    assert sorted(((r["doc_id"], r["class_id"]) for r in got), key=str) == want
    kept = near_dedup.one_of_each(df)
    assert kept.columns == df.columns
    assert kept.count() == len(groups)
    assert near_dedup.near_classes(df.limit(0)).collect() == []
    assert near_dedup.one_of_each(df.limit(0)).collect() == []


def test_one_of_each_keeps_columns_of_any_name(spark):
    rows = [(2, "the same text of some words here", "a", "b"), (1, "the same text of some words here", "c", "d"), (None, "the same text of some words here", "e", "f"), (3, "another", "g", "h"), (None, None, "i", "j"), (4, "", "k", "l")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __v string, __label string")
    assert sorted(map(tuple, near_dedup.one_of_each(df).collect())) == [(1, rows[1][1], "c", "d"), (3, "another", "g", "h"), (4, "", "k", "l")]


def test_prefix_pairs_of_hot_groups(spark, monkeypatch):
    """Texts made of shared passages: every first element is common, and groups must be parted."""
    from tidewright.llm.common import shared_dir

    rng = random.Random(3)
    passages_ = [[f"p{k}.{i}" for i in range(20)] for k in range(8)]
    texts = []
    for _ in range(150):
        chosen = sorted(rng.sample(range(8), rng.choice([5, 6])))
        texts.append(" ".join(w for k in chosen for w in passages_[k]) + " " + " ".join(f"own{rng.randrange(9)}" for _ in range(rng.choice([0, 2, 4]))) + " again" * rng.choice([0, 0, 7, 12]))
    texts = list(dict.fromkeys(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "v long, text string")
    sets = near_dedup.shingle_sets(df)
    counts = [counted(t) for t in texts]
    assert all((r["n"], sorted(r["times"])) == (sum(counts[r["v"]].values()), sorted(counts[r["v"]].values())) for r in sets.collect())
    want = {(a, b) for b in range(len(texts)) for a in range(b) if alike(counts[a], counts[b])}
    assert len(want) > 20
    for most in (1, 3, 200):
        monkeypatch.setattr(near_dedup, "MOST_ACTIVE", most)
        folder = shared_dir(spark)
        sets_ = near_dedup.written(sets, f"{folder}/sets")
        pairs = near_dedup.written(near_dedup.prefix_pairs(sets_.selectExpr("v", "v as c"), sets_, folder), f"{folder}/pairs")
        got = {(min(r), max(r)) for r in map(tuple, near_dedup.linked(pairs, sets_, f"{folder}/linked").collect())}
        assert got == want


def test_components_of_a_chain(spark):
    from tidewright.llm.common import shared_dir

    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "v long, w long")
    got = {r["v"]: r["c"] for r in near_dedup.components(links, shared_dir(spark)).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}
