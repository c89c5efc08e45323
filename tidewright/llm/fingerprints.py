"""Document fingerprints: bottom-k sketches of word-shingle hashes. Native throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import shared_dir, written

#: Hashes that a sketch keeps at most, words of a shingle, bits of a hash.
K, WORDS, BITS = 128, 5, 48
#: Rows of a range, and ranges at most (without those of ids that hold more rows than a range).
PER_RANGE, MOST_RANGES = 2000, 100_000


def with_sketch(df: DataFrame, text: str, to: str, k: int = K, words: int = WORDS) -> DataFrame:
    """Adds the column `to`: the k least distinct hashes of the text's shingles, ascending (array of long).

    A shingle is `words` words in a row (words: runs of characters other than the space and U+0009 to U+000D); a
    shorter text has one of all its words; a text without words, or null, has the empty sketch.
    """
    w, h, all_ = f"__w_{to}", f"__h_{to}", f"__s_{to}"
    df = df.withColumn(w, F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "[ \\t-\\r]+"), lambda x: x != ""))
    # a word's hash once, then shingles by combining the hashes of neighbours
    df = df.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    n = F.size(h)
    parts = lambda i: F.xxhash64(*[F.element_at(F.col(h), i + j) for j in range(1, words + 1)])
    many = F.when(n >= words, F.transform(F.sequence(F.lit(0), n - words), parts)).when(n > 0, F.array(F.xxhash64(F.col(h)))).otherwise(F.array().cast("array<long>"))
    df = df.withColumn(all_, many)
    cut = F.transform(F.col(all_), lambda x: F.shiftrightunsigned(x, 64 - BITS))
    return df.withColumn(to, F.slice(F.array_sort(F.array_distinct(cut)), 1, k)).drop(w, h, all_)


def encoded(sketch: Column) -> Column:
    """A sketch as text: its hashes in hexadecimal, ascending, joined by dots."""
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.lpad(F.hex(x), BITS // 4, "0"))), ".")


def decoded(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, "\\."), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("long"))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all of two documents; 1 for two empty sketches."""
    return _shared(_union(a, b, k), a, b)


def _union(a, b, k: int) -> Column:
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def _shared(union, a, b) -> Column:
    return F.when(F.size(union) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(union, a), b)) / F.size(union))


def distinct_count(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact while the sketch isn't full."""
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) * float(1 << BITS) / F.element_at(sketch, k))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too: resemblance scaled by the union's size over a's."""
    union = _union(a, b, k)
    whole = distinct_count(union, k) / distinct_count(a, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * whole))


def merged(parts: DataFrame, key: str, sketch: str, k: int = K) -> DataFrame:
    """key, sketch of the union of the parts with that key. Hashes are ranked and cut to k in every task before the shuffle."""
    hashes = parts.select(key, F.explode(sketch).alias("h"))
    ranked = hashes.distinct().withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("h"))).filter(F.col("r") <= k)
    return parts.select(key).distinct().join(ranked.groupBy(key).agg(F.array_sort(F.collect_list("h")).alias(sketch)), key, "left").withColumn(sketch, F.coalesce(sketch, F.array().cast("array<long>")))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), x, tie (the text's hash). x ascends as doc_id descends and never overflows: its
    complement; null, the last, for no id."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("x", F.bitwise_not("doc_id")).withColumn("tie", F.xxhash64("text"))


def _array(values: list, kind: str) -> Column:
    """Some values as one constant, however many they are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _place(x: Column, lows: list[int]) -> Column:
    """How many of the ascending values are at most x: first among every w-th, then among the w that follow."""
    w = max(1, int(len(lows) ** 0.5))
    firsts = _array(lows[::w], "bigint")
    groups = F.transform(F.split(F.lit(";".join(",".join(map(str, lows[k : k + w])) for k in range(0, len(lows), w))), ";"), lambda s: F.split(s, ",").cast("array<bigint>"))
    n = F.size(F.filter(firsts, lambda v: v <= x))
    return F.when(n == 0, 0).otherwise((n - 1) * w + F.size(F.filter(F.element_at(groups, F.greatest(n, F.lit(1))), lambda v: v <= x)))


def dealt_ranges(docs: DataFrame, per_range: int = PER_RANGE) -> DataFrame:
    """doc_id, text, tie, at, copy: rows dealt to ranges of descending doc_id, in which each row has its follower.

    Ranges are bounded by quantiles of the ids and hold about per_range rows, whatever the ids are; the rows of an id,
    or of none, that has more are dealt on by their texts' hash. There are at most MOST_RANGES, of whose bounds and
    first rows alone the driver hears, and as many more as such ids fill. A range's first row is also dealt, with
    copy = 1, to the range before (that of the very first to the last). Rows of one id follow each other by hash, then
    text. Equal rows that would fill a range by themselves become one, with their number in a further column, times.
    """
    rows = _keyed(docs)
    # digests only: what is needed of the texts to bound the ranges
    slim = written(rows.select("x", "tie"), f"{shared_dir(docs.sparkSession)}/ids")
    n, with_id = slim.select(F.count("*"), F.count("x")).first()
    most = max(per_range, -(-n // MOST_RANGES))
    shares = max(1, -(-with_id // most))
    lows = set()
    if shares > 1:
        lows |= set(slim.select(F.percentile_approx("x", _array([k / shares for k in range(1, shares)], "double"), max(10_000, 10 * shares))).first()[0])
    hot = {r["x"]: r["n"] for r in slim.groupBy("x").agg(F.count("*").alias("n")).filter(F.col("n") > most).collect()}
    same = slim.groupBy("x", "tie").agg(F.count("*").alias("n")).filter(F.col("n") > most).drop("n").collect() if hot else []
    if same:
        one = docs.sparkSession.createDataFrame([(*r, True) for r in same], "same_x long, same_tie long, same boolean")
        marked = rows.join(F.broadcast(one), F.col("x").eqNullSafe(F.col("same_x")) & (F.col("tie") == F.col("same_tie")), "left")
        as_one = marked.filter("same").groupBy("doc_id", "x", "tie", F.sha2("text", 256).alias("sha")).agg(F.first("text").alias("text"), F.count("*").alias("times"))
        rows = marked.filter("same is null").select(*rows.columns, F.lit(1).cast("long").alias("times")).unionByName(as_one.drop("sha"))
    for x in hot:
        if x is not None:
            lows |= {x, x + 1}
    lows = sorted(lows)
    # segments: below the first bound, between bounds, from the last on, and no id
    parts = [1, *[-(-hot[x] // most) if x in hot else 1 for x in lows], -(-hot.get(None, 0) // most) or 1]
    offsets = [0]
    for p in parts:
        offsets.append(offsets[-1] + p)
    segment = F.when(F.col("x").isNull(), len(parts) - 1).otherwise(_place(F.col("x"), lows) if lows else 0).cast("int")
    of = lambda values, i: F.element_at(_array(values, "int"), i + 1)
    share = F.floor((F.col("tie").cast("double") + 2.0**63) / 2.0**64 * of(parts, F.col("segment")))
    rows = rows.withColumn("segment", segment)
    rows = rows.withColumn("range", (of(offsets, F.col("segment")) + F.least(share, of(parts, F.col("segment")) - 1)).cast("int"))
    # the first row of each range, from the written digests
    slim = slim.withColumn("segment", segment).withColumn("range", (of(offsets, F.col("segment")) + F.least(share, of(parts, F.col("segment")) - 1)).cast("int"))
    firsts = slim.groupBy("range").agg(F.min(F.struct(F.coalesce("x", F.lit(0)).alias("x"), "tie")).alias("first")).collect()
    there = sorted((r["range"], r["first"]["x"], r["first"]["tie"]) for r in firsts)
    before = [(r, x, t, there[k - 1][0]) for k, (r, x, t) in enumerate(there)]
    where = docs.sparkSession.createDataFrame(before, "range int, first_x long, first_tie long, before int")
    near = rows.join(F.broadcast(where), "range")
    is_first = (F.coalesce("x", F.lit(0)) == F.col("first_x")) & (F.col("tie") == F.col("first_tie"))
    own, other = (F.struct(F.col(c).alias("at"), F.lit(k).alias("copy")) for c, k in (("range", 0), ("before", 1)))
    near = near.withColumn("to", F.explode(F.when(is_first, F.array(own, other)).otherwise(F.array(own))))
    return near.select("doc_id", "text", "tie", *(["times"] if same else []), F.col("to.at").alias("at"), F.col("to.copy").alias("copy"))


def fingerprint_report(docs: DataFrame, k: int = K) -> DataFrame:
    """Each text's fingerprint, that of its edited text, and their likeness: one row for each of docs.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and estimates for the
    edited text: contained_in_edited, n_shingles. The edited text has its last third replaced by the start of the
    document next in descending doc_id. One shuffle of the texts, by ranges of ids (dealt_ranges); both windows and
    the sketches follow in the same tasks. Nulls count as empty texts; null ids come last; repeated rows are each a
    document; with one row, the next is itself. An empty table gives no rows. Other columns are ignored.
    """
    rows = dealt_ranges(docs, PER_RANGE)
    w = Window.partitionBy("at").orderBy("copy", F.col("doc_id").desc_nulls_last(), "tie", "text")
    rows = with_sketch(rows.withColumn("next", F.lead("text").over(w)), "text", "own", k)
    rows = rows.withColumn("follower", F.lead("own").over(w)).filter("copy = 0").drop("at", "copy", "tie")
    times = "times" in rows.columns
    if times:  # of equal rows that are one here, all but the last are followed by their like
        like = F.struct((F.col("times") - 1).alias("rows"), F.col("text").alias("next"), F.col("own").alias("follower"))
        last = F.struct(F.lit(1).cast("long").alias("rows"), F.col("next").alias("next"), F.col("follower").alias("follower"))
        rows = rows.withColumn("each", F.explode(F.when(F.col("times") > 1, F.array(like, last)).otherwise(F.array(last)))).select("doc_id", "text", "own", "each.*")
    n = F.length("text")
    part = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.left("text", n - part), F.left("next", part)))
    rows = with_sketch(rows, "edited", "other", k)
    rows = rows.withColumn("with_edited", _union("own", "other", k)).withColumn("with_next", _union("own", "follower", k))
    out = rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        encoded(F.col("own")).alias("fingerprint"), encoded(F.col("other")).alias("edited_fingerprint"),
        _shared("with_edited", "own", "other").alias("near_edited"), _shared("with_next", "own", "follower").alias("near_next"),
        F.round(containment(F.col("own"), F.col("other"), k), 6).alias("contained_in_edited"), distinct_count(F.col("own"), k).alias("n_shingles"), *(["rows"] if times else []),
    )
    return out.withColumn("rows", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).drop("rows") if times else out
