"""Personal data in whole texts: patterns propose, checksums confirm, context words adjust the score. Native throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds in order, each with its pattern. Runs and groups are possessive and begin only where a run
# begins, which finds the same spans as the plain patterns, in linear time and without deep recursion.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: Words near a span that speak for its kind, and the score that each kind's pattern, check and context give.
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|host|server|address",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|fax|mobile|contact",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security|tax",
}
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.9, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT_SCORE, LEAST_SCORE, CONTEXT_CHARS = 0.35, 0.5, 40

#: What a text with a match of the kind's pattern has somewhere, and is found faster.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": "[0-9]{2}", "ssn": "[0-9]{2}"}

#: What may stand between the numbers of a list, whose cue counts for all of them: no letter or digit, or a joining word.
_JOIN = r"(?:[^\p{L}\p{N}]|(?<![\p{L}\p{N}])(?:and|or|und|oder|et|ou|y|o)(?![\p{L}\p{N}]))++"
LISTS = {"ssn": rf"{PATTERNS['ssn']}(?:{_JOIN}{PATTERNS['ssn']})*+"}
#: Matches that reach CONTEXT_CHARS code points: none has under two.
_REACH = CONTEXT_CHARS // 2 + 1

_IP_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})?"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mod97(m: Column) -> Column:
    """Whether an account number's characters, country and check digits moved to the end, are 1 modulo 97."""
    s = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    step = lambda r, c: F.when(F.ascii(c) >= 65, (r * 100 + F.ascii(c) - 55) % 97).otherwise((r * 10 + F.ascii(c) - 48) % 97)
    return F.length(s).between(15, 34) & (F.aggregate(chars, F.lit(0), step) == 1)


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"\A(?:{_IP_PART}\.){{3}}{_IP_PART}\z")
    if kind == "card":
        d = _digits(m)
        return F.length(d).between(16, 19) & F.call_function("luhn_check", d)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind == "iban":
        return _mod97(m)
    if kind == "ssn":
        return ~m.rlike(r"\A(?:000|666|9)|-00-|-0000\z")
    return F.lit(True)


def _with_starts(out: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Adds __s_<kind>: where each match starts, in code points from 0, given the texts between matches.

    Lengths are summed in blocks of about the root of their number, blocks before each block, then within a block:
    no sum runs over all matches for each. The columns on the way are each used twice, so that they are computed
    once and not within the functions that use them.
    """
    add = lambda a, x: a + x
    none = F.array().cast("array<int>")
    out = out.withColumns({f"__l_{k}": F.zip_with(F.slice(f"__g_{k}", F.lit(1), F.size(f"__m_{k}")), f"__m_{k}", lambda g, m: F.length(g) + F.length(m)) for k in kinds})
    out = out.withColumns({f"__w_{k}": F.ceil(F.sqrt(F.size(f"__l_{k}"))).cast("int") for k in kinds})

    def in_blocks(k: str) -> Column:
        lengths, width = F.col(f"__l_{k}"), F.col(f"__w_{k}")
        many = F.sequence(F.lit(0), F.ceil(F.size(lengths) / width).cast("int") - 1)
        return F.when(F.size(lengths) > 0, F.transform(many, lambda b: F.aggregate(F.slice(lengths, b * width + 1, width), F.lit(0), add))).otherwise(none)

    def before(k: str) -> Column:
        blocks = F.col(f"__b_{k}")
        return F.when(F.size(blocks) > 0, F.transform(blocks, lambda _, b: F.aggregate(F.slice(blocks, F.lit(1), b), F.lit(0), add))).otherwise(none)

    def starts(k: str) -> Column:
        lengths, width, block, gaps = (F.col(f"__{p}_{k}") for p in "lwpg")

        def start(_: Column, i: Column) -> Column:
            at = (i / width).cast("int")
            return F.element_at(block, at + 1) + F.aggregate(F.slice(lengths, at * width + 1, i % width), F.lit(0), add) + F.length(F.element_at(gaps, i + 1))

        return F.when((F.size(lengths) > 0) & (F.size(block) > 0), F.transform(lengths, start)).otherwise(none)

    out = out.withColumns({f"__b_{k}": in_blocks(k) for k in kinds})
    out = out.withColumns({f"__p_{k}": before(k) for k in kinds})
    return out.withColumns({f"__s_{k}": starts(k) for k in kinds}).drop(*[f"__{p}_{k}" for p in "lwbp" for k in kinds])


def _windows(out: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Adds __b_<kind> and __a_<kind>: of each match and the text between it and the one before (after) it, the end
    (beginning) that can be in the window of a later (earlier) match. Windows are then joined from few short pieces,
    so that no text is gone through again for each match."""
    none = F.array().cast("array<string>")

    def before(k: str) -> Column:
        pieces = F.zip_with(F.slice(f"__g_{k}", F.lit(1), F.size(f"__m_{k}")), f"__m_{k}", lambda g, m: F.right(F.concat(g, m), F.lit(CONTEXT_CHARS + 1)))
        return F.when(F.size(f"__m_{k}") > 0, pieces).otherwise(none)

    def after(k: str) -> Column:
        pieces = F.zip_with(f"__m_{k}", F.slice(f"__g_{k}", F.lit(2), F.size(f"__m_{k}")), lambda m, g: F.left(F.concat(m, g), F.lit(CONTEXT_CHARS)))
        return F.when(F.size(f"__m_{k}") > 0, pieces).otherwise(none)

    return out.withColumns({f"__b_{k}": before(k) for k in kinds} | {f"__a_{k}": after(k) for k in kinds})


def _near(kind: str, i: Column) -> Column:
    """Whether a context word stands near match i (from 0): begins in the CONTEXT_CHARS code points before it, or is within those after it."""
    g, b, a = (F.col(f"__{p}_{kind}") for p in "gba")
    first = F.greatest(i - _REACH, F.lit(0))
    # one code point more, or a blank at the text's start, shows whether a word begins
    ahead = F.right(F.concat(F.lit(" "), F.array_join(F.slice(b, first + 1, i - first), ""), F.right(F.element_at(g, i + 1), F.lit(CONTEXT_CHARS + 1))), F.lit(CONTEXT_CHARS + 1))
    behind = F.left(F.concat(F.left(F.element_at(g, i + 2), F.lit(CONTEXT_CHARS)), F.array_join(F.slice(a, i + 2, F.lit(_REACH)), "")), F.lit(CONTEXT_CHARS))
    return F.lower(ahead).rlike(f"(?s)[^a-z](?:{CONTEXT[kind]})") | F.lower(behind).rlike(f"(?<![a-z])(?:{CONTEXT[kind]})")


def _with_lists(out: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Adds __n_<kind>: for each match whether a context word is near it or, of the kinds of LISTS, near any of its list."""
    none, no_list = F.array().cast("array<boolean>"), F.array().cast("array<int>")

    def near(k: str) -> Column:
        # what fails its check has no span, but can bring a cue to its list
        counts = lambda i: F.lit(True) if k in LISTS else _confirmed(k, F.element_at(f"__m_{k}", i + 1))
        return F.when(F.size(f"__m_{k}") > 0, F.transform(F.sequence(F.lit(0), F.size(f"__m_{k}") - 1), lambda i: F.when(counts(i), _near(k, i)).otherwise(False))).otherwise(none)

    out = out.withColumns({f"__n_{k}": near(k) for k in kinds})
    for k in (k for k in kinds if k in LISTS):
        some, pattern = F.size(f"__m_{k}") > 1, F.lit(PATTERNS[k])
        # lists are made of whole matches, in order: matches by list, then the number of the list by match, then each list's first match
        sizes = F.transform(F.regexp_extract_all("__t", F.lit(LISTS[k]), F.lit(0)), lambda x: F.size(F.regexp_extract_all(x, pattern, F.lit(0))))  # noqa: B023
        out = out.withColumn("__sizes", F.when(some, sizes).otherwise(no_list))
        out = out.withColumn("__lists", F.when(some, F.flatten(F.transform("__sizes", lambda c, j: F.array_repeat(j, c)))).otherwise(no_list))
        begins = F.filter(F.sequence(F.lit(0), F.size("__lists") - 1), lambda i: (i == 0) | (F.element_at("__lists", i + 1) != F.element_at("__lists", F.greatest(i, F.lit(1)))))
        out = out.withColumn("__begins", F.when(some, begins).otherwise(no_list))
        cued = F.zip_with("__begins", "__sizes", lambda i, c: F.array_repeat(F.exists(F.slice(F.col(f"__n_{k}"), i + 1, c), lambda n: n), c))  # noqa: B023
        out = out.withColumn(f"__n_{k}", F.when(some, F.flatten(cued)).otherwise(F.col(f"__n_{k}"))).drop("__sizes", "__lists", "__begins")
    return out


def _spans(kind: str) -> Column:
    """The kind's (start, end, score), from the columns of its matches, starts and context."""
    s, m, n = (f"__{p}_{kind}" for p in "smn")

    def span(x: Column) -> Column:
        score = F.lit(SCORES[kind]) + F.when(x[n], CONTEXT_SCORE).otherwise(0.0)
        return F.struct(x[s].alias("start"), (x[s] + F.length(x[m])).alias("end"), score.alias("score"))

    spans = F.transform(F.filter(F.arrays_zip(s, m, n), lambda x: _confirmed(kind, x[m])), span)
    if kind not in BASE:
        spans = F.filter(spans, lambda x: x["score"] >= LEAST_SCORE)
    return F.when(F.size(m) > 0, spans).otherwise(F.array().cast("array<struct<start:int,end:int,score:double>>"))


def pii_spans(docs: DataFrame, extra: tuple[str, ...] = ("iban", "ssn")) -> DataFrame:
    """docs with one more column a kind, spans_<kind>: arrays of (start, end, score), code points, end exclusive.

    Leftmost non-overlapping matches of each kind's pattern, without those that fail its check (checks: address
    parts at most 255, Luhn and 16 to 19 digits, 8 to 15 digits, mod 97, never-issued number ranges). The score is
    the kind's own plus CONTEXT_SCORE where a context word stands in the CONTEXT_CHARS code points before or after the
    span, whatever other matches are there, or near any number of the same list (kinds of LISTS); spans of the base
    kinds stay whatever their score, others from LEAST_SCORE on. A null text has no spans. Columns of docs stay; a
    column text is needed.
    """
    out = docs.withColumn("__t", F.coalesce(docs["text"].cast("string"), F.lit("")))
    kinds = (*BASE, *extra)
    found = {k: F.when(F.col("__t").rlike(GATES[k]), F.regexp_extract_all("__t", F.lit(PATTERNS[k]), F.lit(0))).otherwise(F.array().cast("array<string>")) for k in kinds}
    out = out.withColumns({f"__m_{k}": c for k, c in found.items()})
    none = F.array().cast("array<string>")
    out = out.withColumns({f"__g_{k}": F.when(F.size(f"__m_{k}") > 0, F.split("__t", PATTERNS[k], -1)).otherwise(none) for k in kinds})
    out = _with_lists(_windows(_with_starts(out, kinds), kinds), kinds)
    out = out.withColumns({f"spans_{k}": _spans(k) for k in kinds})
    return out.drop("__t", *[f"__{p}_{k}" for p in "mgsban" for k in kinds])


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores: the digest of pii_spans for each row of docs.

    scores has the scores of all spans, in their order. A null or empty text has no spans; ids may be null or repeated;
    an empty table gives no rows; other columns are ignored.
    """
    kinds = (*BASE, "iban", "ssn")
    out = pii_spans(docs.select("doc_id", "text"))

    def listed(k: str) -> Column:
        return F.transform(f"spans_{k}", lambda x: F.concat_ws(":", F.lit(k), x["start"].cast("string"), x["end"].cast("string")))

    scores = F.concat(*[F.transform(f"spans_{k}", lambda x: F.format_string("%.2f", x["score"])) for k in kinds])
    return out.select(
        "doc_id", *[F.size(f"spans_{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(F.concat(*map(listed, BASE)), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*map(listed, kinds)), ",").alias("spans"), F.array_join(scores, ",").alias("scores"),
    )


#: Code points of the blocks that a text is cut into once, so that a piece is found without going through all before it.
BLOCK_CHARS = 1024


def _piece(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from start to end (exclusive) of a text that was cut into blocks."""
    a, b = (start / BLOCK_CHARS).cast("int"), (end / BLOCK_CHARS).cast("int")
    block = lambda i: F.coalesce(F.try_element_at(blocks, i + 1), F.lit(""))
    within = F.substring(block(a), start % BLOCK_CHARS + 1, end - start)
    across = F.concat(F.substring(block(a), start % BLOCK_CHARS + 1, F.lit(BLOCK_CHARS)), F.array_join(F.slice(blocks, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.left(block(b), end % BLOCK_CHARS))
    return F.when(end <= start, "").when(a == b, within).otherwise(across)


def pii_masked(docs: DataFrame, kinds: tuple[str, ...] = (*BASE, "iban", "ssn")) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; n_chars, if there, is the new length.

    Spans that overlap are replaced as one, by the name of the one that starts first (the longer one at a tie). Null
    texts stay null; ids, ties and repeated rows play no part; an empty table stays empty. The work grows with a text's
    length and with its spans times the root of their number.
    """
    # columns of docs may have the names that are used here
    out = pii_spans(docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns if c != "text"}))

    def marks(k: str) -> Column:
        return F.transform(f"spans_{k}", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), F.lit(f"[{k.upper()}]").alias("mark")))

    out = out.withColumn("__all", F.array_sort(F.concat(*map(marks, kinds))))
    # how far the spans before each one reach: by blocks, blocks before each block, then within a block
    none = F.array().cast("array<int>")
    highest = lambda x: F.coalesce(F.array_max(x), F.lit(0))
    out = out.withColumn("__ends", F.transform("__all", lambda x: -x["back"])).withColumn("__w", F.ceil(F.sqrt(F.size("__ends"))).cast("int"))
    many, w = F.sequence(F.lit(0), F.ceil(F.size("__ends") / F.col("__w")).cast("int") - 1), F.col("__w")
    out = out.withColumn("__tops", F.when(F.size("__ends") > 0, F.transform(many, lambda b: highest(F.slice("__ends", b * w + 1, w)))).otherwise(none))
    out = out.withColumn("__past", F.transform("__tops", lambda _, b: highest(F.slice("__tops", F.lit(1), b))))

    def reach(_: Column, i: Column) -> Column:
        at = (i / w).cast("int")
        return F.greatest(F.element_at("__past", at + 1), highest(F.slice("__ends", at * w + 1, i % w)))

    out = out.withColumn("__reach", F.when(F.size("__ends") > 0, F.transform("__ends", reach)).otherwise(none))
    # spans that begin before the reach of earlier ones are inside those
    own = F.filter(F.arrays_zip("__all", "__reach"), lambda x: x["__all"]["start"] >= x["__reach"])
    out = out.withColumn("__own", own).withColumn("__blocks", F.when(F.size("__all") > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0))).otherwise(F.array().cast("array<string>")))
    parts = F.transform("__own", lambda x: F.concat(_piece(F.col("__blocks"), x["__reach"], x["__all"]["start"]), x["__all"]["mark"]))
    rest = _piece(F.col("__blocks"), F.array_max("__ends"), F.length("text"))
    out = out.withColumn("text", F.when(F.size("__all") > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("__own_n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(c if c == "text" else f"__own_{c}").alias(c) for c in docs.columns])
