from __future__ import annotations

import hashlib
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import WORD, documents, grams, rows_of
from tests.oracle import same
from tidewright.llm import fingerprints, mixing, pii, quality_rules, warc
from tidewright.llm.queries import SQL

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits: str) -> bool:
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def good(kind: str, m: str) -> bool:
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def test_base_spans_equal_plain_patterns(spark, sf_dir):
    texts = ["a@b.c.d_e@f.g x@y.zz", "1.2.3.4.5 300.1.1.1 0001.2.3.255 0.0.0.0", "+1 (23) 456-7890 +12", "4111 1111 1111 1111 4111-1111-1111-1112", "😀 x@y.z é q@w.e +49 30 1234567", "1.1.1.1 " * 500, "9" * 5000, "+1" + "." * 3000]
    df = documents(spark, sf_dir).union(spark.createDataFrame([(8000 + k, t, "en", "s", 1, "k", 1, "v", "l") for k, t in enumerate(texts)], documents(spark, sf_dir, 1).schema))
    want = []
    for d, t in rows_of(df):
        found = {k: [m for m in re.finditer(p, t) if good(k, m[0])] for k, p in PLAIN.items()}
        spans = ",".join(f"{k}:{m.start()}:{m.end()}" for k in PLAIN for m in found[k])
        want.append((d, *map(len, found.values()), hashlib.sha256(spans.encode()).hexdigest()))
    got = pii.pii_report(df).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:6]) for r in got)


def test_cards_of_single_digits(spark):
    texts = [sep.join("4111111111111111") for sep in " -"] + ["pay 4 1-1 1-1 1-1 1-1 1-1 1-1 1-1 1 now", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 2"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_card"], r["spans"], r["base_sha256"]) for r in pii.pii_report(df).collect()}
    for d, t in enumerate(texts):
        spans = ",".join(f"card:{m.start()}:{m.end()}" for m in re.finditer(PLAIN["card"], t) if good("card", m[0]))
        assert got[d] == (int(d < 3), spans, hashlib.sha256(spans.encode()).hexdigest())
    assert {r["doc_id"]: r["text"] for r in pii.pii_masked(df).collect()} == {0: "[CARD]", 1: "[CARD]", 2: "pay [CARD] now", 3: texts[3]}


def test_context_by_position_and_lists(spark):
    cases = [
        ("SSN: 123-45-6789, 234-56-7890, 345-67-8901", 3), ("123-45-6789 (SSN)", 1), ("ssn 000-12-3456 or 123-45-6789", 1), ("SSN " + "\n".join(["123-45-6789"] * 3000), 3000),
        ("123-45-6789; 234-56-7890 and 345-67-8901 " * 2 + "are social security numbers", 6), ("123-45-6789, 234-56-7890", 0), ("ssn 123-45-6789 " + "x" * 40 + " 234-56-7890", 1), ("123-45-6789, 234-56-7890 " + "x" * 50 + " ssn 123-45-6789 / 234-56-7890 " + "x" * 50 + " 345-67-8901", 2),
        ("ssn" + "." * 37 + "123-45-6789", 1), ("ssn" + "." * 38 + "123-45-6789", 0), ("xssn" + "." * 37 + "123-45-6789", 0), ("123-45-6789" + "." * 37 + "ssn", 1), ("123-45-6789" + "." * 38 + "ssn", 0), ("123-45-6789 xssn", 0), ("", 0), ("no number", 0), ("😀 ssn 😀 123-45-6789", 1),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans_ssn"] for r in pii.pii_spans(df).collect()}
    for k, (t, n) in enumerate(cases):
        assert (k, len(got[k])) == (k, n)
        assert all(re.fullmatch(r"\d{3}-\d\d-\d{4}", t[x["start"] : x["end"]]) for x in got[k])
    masked = {r["doc_id"]: r["text"] for r in pii.pii_masked(df).collect()}
    assert masked[0] == "SSN: [SSN], [SSN], [SSN]"
    assert masked[2] == "ssn 000-12-3456 or [SSN]"
    assert masked[5] == cases[5][0]
    card = pii.pii_spans(spark.createDataFrame([("card 12 34 or 4111 1111 1111 1111, 22 and 4111111111111111 visa",), ("4111111111111111, " + "12 x " * 8 + "card",), ("4111111111111111, " + "12 x " * 6 + "card",)], "text string")).collect()
    assert [[round(x["score"], 2) for x in r["spans_card"]] for r in card] == [[1.25, 1.25], [0.9], [1.25]]


def test_scores_show_the_context(spark):
    df = spark.createDataFrame([(1, "card 4111 1111 1111 1111 a@b.cd"), (2, "4111 1111 1111 1111"), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["spans"], r["scores"]) for r in pii.pii_report(df).collect()}
    assert got == {1: ("email:25:31,card:5:24", "0.80,1.25"), 2: ("card:0:19", "0.90"), 3: ("", "")}


def plain_mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = "", 0
    for start, end, mark in sorted(spans, key=lambda x: (x[0], -x[1], x[2])):
        if start >= at:
            out += text[at:start] + mark
        at = max(at, end)
    return out + text[at:] if spans else text


def test_masks_equal_a_plain_version(spark):
    rng = random.Random(5)
    some = ["a@b.cd", "+49 4111 1111 1111 1111", "4111111111111111", "1.2.3.4", "ssn 123-45-6789", "DE89 3704 0044 0532 0130 00", "x" * 700, "é😀 ", "plain words ", "+1 (23) 456-7890.1.2.3"]
    texts = ["", *["".join(rng.choice(some) + rng.choice(["", " ", ", "]) for _ in range(rng.choice([1, 5, 60, 900]))) for _ in range(40)], "z" * 1024 + "a@b.cd", "z" * 1022 + " a@b.cd", "a@b.cd " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {}
    for r in pii.pii_spans(df).collect():
        spans = [(x["start"], x["end"], f"[{k.upper()}]") for k in pii.PATTERNS for x in r[f"spans_{k}"]]
        want[r["doc_id"]] = plain_mask(r["text"], spans)
    assert {r["doc_id"]: r["text"] for r in pii.pii_masked(df).collect()} == want
    assert pii.pii_masked(df.limit(0)).collect() == []


def test_separated_digits_equal_plain_patterns(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("4111 -1 +.()x") for _ in range(rng.randint(10, 60))) for _ in range(300)] + [rng.choice([" ", "-"]).join("4111111111111111"[: rng.randint(14, 16)]) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = []
    for d, t in enumerate(texts):
        found = {k: [m for m in re.finditer(p, t) if good(k, m[0])] for k, p in PLAIN.items()}
        spans = ",".join(f"{k}:{m.start()}:{m.end()}" for k in PLAIN for m in found[k])
        want.append((d, *map(len, found.values()), hashlib.sha256(spans.encode()).hexdigest()))
    assert sorted(tuple(r)[:6] for r in pii.pii_report(df).collect()) == want


def test_added_spans_and_masks(spark):
    df = spark.createDataFrame([(1, "iban DE89 3704 0044 0532 0130 00 or DE89370400440532013001", 5), (2, "my ssn 123-45-6789", 5), (3, "not 123-45-6789", 5), (4, None, 5), (5, "😀 mail a@b.cd now", 5)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r["spans"] for r in pii.pii_report(df).collect()}
    assert got == {1: "iban:5:32", 2: "ssn:7:18", 3: "", 4: "", 5: "email:7:13"}
    masked = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.pii_masked(df).collect()}
    assert masked[5] == ("😀 mail [EMAIL] now", 18)
    assert masked[3] == ("not 123-45-6789", 15)
    assert masked[4] == (None, None)
    clash = pii.pii_masked(df.withColumnRenamed("n_chars", "spans_email"))
    assert {r["spans_email"] for r in clash.collect()} == {5}
    assert pii.pii_report(df.limit(0)).collect() == []


def test_mix_equals_sorting(spark, sf_dir, tmp_path):
    same(mixing.mixed(spark.read.parquet(f"{sf_dir}/documents.parquet")), SQL["op2_mix_sources"], sf_dir)


def test_mix_of_awkward_rows(spark, sf_dir):
    df = documents(spark, sf_dir, 80)
    rows = mixing.mixed(df).collect()
    assert len(rows) == df.count()
    taken, target = {}, {}
    for r in rows:
        assert r["size"] * 2 >= r["taken"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 3 for s in taken)
    assert abs(sum(target.values()) - 1.5 * sum(r["size"] for r in rows)) < 1e-6
    assert {str(r) for r in rows} == {str(r) for r in mixing.mixed(df.repartition(3)).collect()}
    assert mixing.mixed(df.limit(0)).collect() == []
    out = mixing.mixed_documents(df.withColumnsRenamed({"lang": "copies", "label": "target"}))
    assert out.schema["key"].dataType.simpleString() == "string"
    assert {r["key"] for r in out.collect()} == {"k"}
    assert {r["copies"] for r in out.collect()} == {"en"}


def test_fingerprints(spark, sf_dir):
    df = documents(spark, sf_dir).filter("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted(rows_of(df), reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_report(df).collect()}
    assert len(got) == len(rows)
    off = []
    for k, (d, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert (got[d]["n_chars"], got[d]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b = grams(t), grams(edited)
        off.append(abs(got[d]["near_edited"] - (len(a & b) / len(a | b) if a | b else 1)))
    assert sum(off) / len(off) < 0.04
    assert max(off) < 0.2
    assert got[9004]["fingerprint"] == got[9005]["fingerprint"]
    assert fingerprints.fingerprint_report(documents(spark, sf_dir)).count() == documents(spark, sf_dir).count()
    assert fingerprints.fingerprint_report(df.limit(0)).collect() == []


def test_followers_across_ranges(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(fingerprints, "PER_RANGE", 7)
    df = spark.createDataFrame([(i * i, f"text {i}") for i in range(100)], "doc_id long, text string")
    rows = fingerprints.dealt_ranges(df, 7)
    assert rows.select("at").distinct().count() > 10
    whole = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.fingerprint_report(df).collect()}
    docs = sorted(((i * i, f"text {i}") for i in range(100)), reverse=True)
    for k, (d, t) in enumerate(docs):
        after = docs[(k + 1) % 100][1]
        assert whole[d] == hashlib.sha256((t[: len(t) - len(t) // 3] + after[: len(t) // 3]).encode()).hexdigest()


def near(a, b):
    """Plain estimate of two bottom-k sketches' resemblance."""
    union = sorted(set(a) | set(b))[: fingerprints.K]
    return sum(x in set(a) and x in set(b) for x in union) / len(union) if union else 1.0


def test_fingerprints_equal_plain_sketches(spark, sf_dir):
    df = documents(spark, sf_dir, 60)
    rows = fingerprints.fingerprint_report(df).collect()
    ids = {}
    for r in rows:
        own, other = ([int(x, 16) for x in r[c].split(".") if x] for c in ("fingerprint", "edited_fingerprint"))
        assert own == sorted(set(own))[: fingerprints.K]
        assert r["near_edited"] == near(own, other)
        assert r["n_shingles"] == len(own) or len(own) == fingerprints.K
        ids.setdefault(r["doc_id"], []).append(own)
    plain = sorted((r for r in rows if r["doc_id"] is not None and len(ids[r["doc_id"]]) == 1), key=lambda r: -r["doc_id"])
    for a, b in zip(plain, plain[1:], strict=False):
        if len([r for r in rows if r["doc_id"] is not None and b["doc_id"] < r["doc_id"] < a["doc_id"]]) == 0:
            assert a["near_next"] == near(ids[a["doc_id"]][0], ids[b["doc_id"]][0])


def test_ranges_of_skewed_and_repeated_ids(spark, monkeypatch):
    rows = [(k, f"text {k}") for k in range(3000)] + [(2**60, "far"), (-(2**63), "least"), (2**63 - 1, "most")] + [(7, f"seven {k}") for k in range(900)] + [(None, f"none {k}") for k in range(700)] + [(5, "the same")] * 600 + [(None, "no id")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    dealt = fingerprints.dealt_ranges(df, 200)
    sizes = [r["count"] for r in dealt.filter("copy = 0").groupBy("at").count().collect()]
    assert max(sizes) < 500
    assert len(sizes) > 15
    monkeypatch.setattr(fingerprints, "PER_RANGE", 200)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"], r["edited_sha256"]) for r in fingerprints.fingerprint_report(df).collect())
    tie = {r["text"]: r["tie"] for r in fingerprints._keyed(df).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1]], r[1]))
    want = []
    for (d, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        want.append((d is None, d or 0, len(t), hashlib.sha256((t[: len(t) - len(t) // 3] + after[: len(t) // 3]).encode()).hexdigest()))
    assert got == sorted(want)


def test_sketches_merge(spark):
    df = spark.createDataFrame([("a", " ".join(f"x{k}" for k in range(400))), ("a", " ".join(f"x{k}" for k in range(200, 600))), ("b", "")], "g string, text string")
    parts = fingerprints.with_sketch(df, "text", "s")
    m = {r["g"]: r["s"] for r in fingerprints.merged(parts, "g", "s").collect()}
    whole = fingerprints.with_sketch(spark.createDataFrame([(" ".join(f"x{k}" for k in range(600)),)], "text string"), "text", "s").first()["s"]
    assert m["a"] == whole
    assert m["b"] == []
    n = parts.select(fingerprints.distinct_count(F.col("s"))).first()[0]
    assert 280 < n < 540


def test_quality_measures(spark, sf_dir):
    df = documents(spark, sf_dir)
    want = []
    for d, t in rows_of(df):
        w = WORD.findall(t)
        seen: dict[tuple, int] = {}
        for i in range(len(w) - 4):
            seen[tuple(w[i : i + 5])] = seen.get(tuple(w[i : i + 5]), 0) + 1
        again = {i + j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)))
    got = quality_rules.quality_rules(df).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:7]) for r in got)
    assert all(not (r["kept"] and r["base_failed"]) for r in got)
    assert quality_rules.kept_documents(df).count() == sum(r["kept"] for r in got)
    assert quality_rules.quality_rules(df.limit(0)).collect() == []


def plain_repeats(words: list[str], least: int = quality_rules.LEAST):
    """(covered positions, longest, number) of maximal repeats, from all pairs of positions."""
    places: dict[tuple, list[int]] = {}
    n = len(words)
    for i in range(n):
        for j in range(i + 1, n):
            m = 0
            while j + m < n and words[i + m] == words[j + m]:
                m += 1
            if m >= least:
                places.setdefault(tuple(words[i : i + m]), set()).update((i, j))
    count, covered, longest = 0, set(), 0
    for phrase in places:
        at = [i for i in range(n - len(phrase) + 1) if tuple(words[i : i + len(phrase)]) == phrase]
        covered.update(i + k for i in at for k in range(len(phrase)))
        longest = max(longest, len(phrase))
        # right-maximal by construction; left-maximal if two occurrences follow different words, or one none
        if len({words[i - 1] if i else None for i in at}) > 1:
            count += 1
    return covered, longest, count


def test_repeats_equal_brute_force(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abc"[: rng.choice([1, 2, 3])]) for _ in range(rng.choice([0, 4, 5, 6, 30, 90]))) for _ in range(60)]
    base = [f"w{k}" for k in range(12)]
    texts += [" ".join(base + ["x"] + base + ["y"] + base[3:] + ["x"]), " ".join(base * 4), "a " * 40, " ".join(base[:5] * 2)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for r in quality_rules.quality_rules(df).collect():
        words = texts[r["doc_id"]].split()
        covered, longest, count = plain_repeats(words)
        chars = sum(len(words[p]) for p in covered)
        n_chars = sum(map(len, words))
        assert (r["n_repeat_words"], r["repeat_chars"], r["longest_repeat"], r["n_repeats"]) == (len(covered), chars, longest, count), texts[r["doc_id"]]
        share = quality_rules.MAX_COVERED if chars > quality_rules.SHORT_CHARS else quality_rules.MAX_COVERED_SHORT
        assert r["kept"] == (not r["base_failed"] and chars <= share * n_chars and longest <= quality_rules.MAX_LONGEST)


def test_quality_limits_bind_by_themselves(spark):
    def plain(n: int, tag: str) -> str:
        return " ".join(f"{tag}{k:05d}" for k in range(n))

    def twice(n: int, passage: str) -> str:
        return f"{plain(n // 2, 'a')} {passage} {plain(n // 2, 'b')} {passage} {plain(9, 'c')}"

    many = " ".join(f"{p} x{k} {p} y{k}" for k, p in enumerate(plain(8, f"p{k}") for k in range(20)))
    texts = {
        "long": twice(1700, plain(150, "p")), "longer": twice(16_000, plain(1900, "p")), "above": twice(1700, plain(51, "p")), "covered": f"{plain(1500, 'a')} {many}",
        "clean": plain(2000, "a"), "below": twice(1700, plain(50, "p")), "line": twice(120, plain(13, "p")), "some": f"{plain(2500, 'a')} {many}",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(df).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert got["covered"]["longest_repeat"] < 10
    assert {d for d, r in got.items() if r["kept"]} == {"clean", "below", "line", "some"}
    assert {r["doc_id"] for r in quality_rules.kept_documents(df).collect()} == {"clean", "below", "line", "some"}


@pytest.fixture
def pages(spark):
    big = "<p>" + "Wort é " * 400
    rows = [(1, "http://a/\r\nX: 1", big), (2, "u", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", big), (8, "u", "y" * 700_000), (9, "u", "y" * 700_000)]
    return spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id long, url string, html string, n_pages long, `key` string")


def test_archives_round_trip(spark, pages):
    got = sorted((tuple(r) for r in warc.warc_round_trip(pages).collect()), key=str)
    want = []
    html = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    for page, h in html.items():
        top = max(p for p, x in html.items() if p is not None and x == h)
        kind = "revisit" if len(h) >= 1000 and page != top else "response"
        want.append((page, len(h), hashlib.sha1(h).hexdigest(), kind, top if kind == "revisit" else None))
    assert got == sorted(want, key=str)
    assert warc.warc_round_trip(pages.limit(0)).collect() == []


def test_chunks_of_a_record_run_along(spark, pages):
    from tidewright.llm.common import shared_dir

    folder = shared_dir(spark)
    manifest = warc.write_warc(warc.chunk_rows(warc.planned(pages), 100_000), folder)
    rows = warc.read_warc(manifest, folder, chunk=100_000).filter("page_id = 9").orderBy("chunk_no").collect()
    assert [r["bytes_so_far"] for r in rows] == [100_000 * k for k in range(1, 8)]
    assert b"".join(r["data"] for r in rows) == b"y" * 700_000
    assert rows[-1]["digest_so_far"] == rows[-1]["payload_digest"]
    assert len({r["record_id"] for r in rows}) == 1


def test_archives_are_plain_warc(spark, pages):
    """Read by gzip and by members, without this module's reader."""
    import gzip
    import zlib

    from tidewright.llm.common import shared_dir

    folder = shared_dir(spark)
    again = pages.union(pages.filter("page_id = 4 or page_id is null"))
    manifest = warc.write_warc(warc.chunk_rows(warc.planned(again), 100_000), folder)
    ids, n = [], 0
    for path in [r["path"] for r in manifest.collect()]:
        data = open(path, "rb").read()
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        first = True
        while data:
            z = zlib.decompressobj(31)
            record = z.decompress(data)
            data = z.unused_data
            head, block = record.split(b"\r\n\r\n", 1)
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            assert head.startswith(b"WARC/1.1\r\n")
            assert block[int(fields["Content-Length"]) :] == b"\r\n\r\n"
            block = block[:-4]
            if "WARC-Block-Digest" in fields:
                assert fields["WARC-Block-Digest"] == f"sha1:{hashlib.sha1(block).hexdigest()}"
            if fields["WARC-Type"] == "response":
                payload = block.split(b"\r\n\r\n", 1)[1]
                assert fields["WARC-Payload-Digest"] == f"sha1:{hashlib.sha1(payload).hexdigest()}"
            assert (fields["WARC-Type"] == "warcinfo") == first
            first = False
            ids.append(fields["WARC-Record-ID"])
            n += 1
    assert n == again.count() + manifest.count()
    assert len(set(ids)) == n
    got = warc.read_warc(manifest, folder).filter("is_last").collect()
    response = {r["page_id"]: r["record_id"] for r in got if r["record_type"] == "response"}
    assert f"<urn:uuid:{response[3]}>" in ids


def test_a_chunk_is_cut_in_compiled_code(spark, pages):
    rows = warc.chunk_rows(warc.planned(pages))
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    line = next(x for x in plan.split("\n") if "Generate explode" in x)
    assert re.search(r"\*\(\d+\) Generate", line), plan


def test_damaged_archives_raise():
    import zlib

    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    data = z.compress(warc.heads({"record_id": "r", "page_id": 1, "url": "u", "record_type": "response", "refers_to": None, "payload_bytes": 50, "payload_digest": "0", "n_chunks": 2}) + b"too short") + z.flush()
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data)))


def test_web_tables_equal_sql(spark, sf_dir):
    same(warc.warc_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")), SQL["op7_warc"], sf_dir)
