"""Awkward documents and plain versions to compare with."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` string, c long, v string, label string"


def documents(spark, sf_dir: str, few: int | None = None):
    """The small table with awkward rows and columns whose names clash with those the operators use."""
    rng = random.Random(7)
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()][:few]
    base = " ".join(f"w{k}" for k in range(80))
    near = base.replace("w40", "other")
    rows += [(9001, None, "src0"), (9002, "", None), (9003, " \n\t ", "src0"), (9004, base, None), (9005, base, "src1"), (9006, near, "src1"), (9006, near, "src1"), (None, "no id at all", "src2"), (None, base + " tail", "src2"), (None, None, None)]
    rows += [(9010, "x" * 3000, "src0"), (9011, "é😀 " * 500, "zz"), (9012, "a b c", "zz"), (9013, "<|endoftext|> İſ ﬁ ½ it's!!'s", "zz"), (9014, " ".join(rng.choice("ab") for _ in range(4000)), "zz")]
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), "k", 1, "v", "l") for d, t, s in rows], SCHEMA)


def rows_of(df) -> list[tuple[int | None, str]]:
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def grams(text: str) -> frozenset:
    w = WORD.findall(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())
