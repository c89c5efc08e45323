"""Mixing sources to target weights by histograms of hashes, without sorting rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import join_small, shared_dir, written

#: Weights of the sources in order of their names, repeating; share of all words to take; most copies of a document.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Bits of the hash, and of them those that one histogram looks at.
BITS, STEP = 60, 12

_SIZE = "cast(coalesce(regexp_count(text, '[^ \\\\t-\\\\r]++'), 0) as long)"
_HASH = "cast(conv(substring(md5(coalesce(cast(doc_id as string), concat('null:', md5(coalesce(text, ''))))), 1, 15), 16, 10) as long)"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words), and a 60-bit hash of doc_id, or of the text where doc_id is null."""
    rows = docs.select("doc_id", docs["source"].cast("string").alias("source"), docs["text"].cast("string").alias("text"))
    return rows.selectExpr("doc_id", "source", f"{_SIZE} as size", f"{_HASH} as hash")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target: budgets by weight, each at most `most` times the source, the excess reshared.

    sizes: source, size. Filling up in closed form: sources ordered by limit per unit of weight stop at their limit
    while the level that the rest would share is at or over theirs. One row a source; windows run over these rows only,
    in one task: the number of sources (some 10 million at most) bounds it, not the documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (k + 1).cast("int"))
    all_ = Window.partitionBy()
    per = per.withColumn("w", weight).withColumn("cap", most * F.col("source_size"))
    per = per.withColumn("budget", share * F.sum("source_size").over(all_)).withColumn("all_w", F.sum("w").over(all_))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    full, used = F.coalesce(F.sum("cap").over(by_ratio), F.lit(0)), F.coalesce(F.sum("w").over(by_ratio), F.lit(0))
    per = per.withColumn("level", (F.col("budget") - full) / (F.col("all_w") - used))
    per = per.withColumn("final", F.min_by(F.when(F.col("level") < F.col("cap") / F.col("w"), F.col("level")), F.when(F.col("level") < F.col("cap") / F.col("w"), F.col("cap") / F.col("w"))).over(all_))
    target = F.when(F.col("final").isNull() | (F.col("cap") / F.col("w") <= F.col("final")), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("final"))
    return per.select("source", "source_size", target.alias("target"))


def thresholds(slim: DataFrame, folder: str, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """key (a struct of source), source_size, target, copies, cut, each: how often and below which hash to take documents.

    slim: source, size, hash. The threshold is found by histograms of words by source and hash bucket: the bucket in
    which the budget runs out is the only one that the next, finer histogram looks at, until it holds one hash.
    Histograms are aggregated before their shuffle, so a hot source is no hot task.
    """
    per = targets(slim, weights, share, most)
    per = per.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    per = written(per.withColumn("rest", F.floor(F.col("target") - F.col("copies") * F.col("source_size"))), f"{folder}/sources")
    keyed = slim.withColumn("key", F.struct("source"))
    state = per.select(F.struct("source").alias("key"), "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for level in range(1, BITS // STEP + 1):
        shift = BITS - STEP * level
        inside = join_small(keyed, state, "key", "inner").filter(F.shiftright("hash", shift + STEP) == F.col("prefix"))
        bins = inside.groupBy("key", "rest", "before", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"), F.min("hash").alias("least"), F.max("hash").alias("most"))
        up_to = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bins = bins.withColumn("after", F.col("before") + F.sum("words").over(up_to)).withColumn("start", F.col("after") - F.col("words"))
        bound = bins.filter((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("after")))
        state = written(bound.select("key", "rest", F.col("bucket").alias("prefix"), F.col("start").alias("before"), "rows", "least", "most"), f"{folder}/level{level}")
        if not state.filter("least < most").head(1):
            break
    cut = state.select(F.col("key.source").alias("source"), F.col("least").alias("cut"), F.floor((F.col("rest") - F.col("before")) / F.col("rows")).alias("each"))
    per = per.join(cut, per["source"].eqNullSafe(cut["source"]), "left").drop(cut["source"])
    return written(per.select(F.struct("source").alias("key"), "source_size", "target", "copies", "cut", "each"), f"{folder}/thresholds")


def _taken(prefix: str = "") -> tuple:
    """(whole copies, words of a further, cut copy) of a row with size and hash, joined with its source's thresholds."""
    size, hash_, copies, cut, each = (F.col(prefix + c) for c in ("size", "hash", "copies", "cut", "each"))
    whole = copies + F.when(hash_ < cut, 1).otherwise(0)
    return whole.cast("long"), F.when(hash_ == cut, F.least(size, each)).otherwise(0).cast("long")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, extra_words, source: one row for each of docs.

    Every document is taken `copies` times whole: as often as its whole source is, and once more if its hash lies
    under the source's threshold. The documents with the threshold's hash, mostly one, are cut (extra_words each), so
    that a source's taken words meet its target to the word, or with k rows of one hash within k words. Copies and
    cut never exceed `most` times a document.

    The rows' sizes and hashes are written to the shared folder and read by every step. A null source is a source;
    null texts have size 0; null ids hash by text; repeated rows share a hash and are treated alike; an empty table
    gives no rows. Reruns agree: hashes alone decide.
    """
    folder = shared_dir(docs.sparkSession)
    slim = written(sized(docs), f"{folder}/sizes")
    at = thresholds(slim, folder, weights, share, most)
    out = join_small(slim.withColumn("key", F.struct("source")), at, "key", "left")
    whole, extra = _taken()
    out = out.withColumn("whole", whole).withColumn("extra_words", extra)
    return out.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra_words")).alias("taken"), F.col("whole").alias("copies"), "extra_words", "source")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The rows of docs, all columns, as often as the mix takes them.

    A document that mixed() would cut is taken whole once more if at least half of it fits, so texts stay whole.
    """
    folder = shared_dir(docs.sparkSession)
    slim = written(sized(docs), f"{folder}/sizes")
    at = thresholds(slim, folder, weights, share, most)
    own = "__mix_"  # columns of docs may have any other name
    at = at.select(*[F.col(c).alias(own + c) for c in at.columns])
    out = docs.withColumns({f"{own}key": F.struct(docs["source"].cast("string").alias("source")), f"{own}size": F.expr(_SIZE), f"{own}hash": F.expr(_HASH)})
    whole, extra = _taken(own)
    n = whole + F.when((extra > 0) & (2 * extra >= F.col(f"{own}size")), 1).otherwise(0)
    out = join_small(out, at, f"{own}key", "inner").withColumn(f"{own}n", n.cast("int")).filter(f"{own}n > 0")
    return out.withColumn(f"{own}copy", F.explode(F.sequence(F.lit(1), F.col(f"{own}n")))).select(*docs.columns)


#: What mixed() returns, by sorting: for DuckDB.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]+', '', 'g')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))), 1, 15))::BIGINT AS hash
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 2 * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER b, 0)::BIGINT) / ((sum(w) OVER ())::BIGINT - coalesce(sum(w) OVER b, 0)::BIGINT) AS level
  FROM w WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, arg_min(level, cap / w) FILTER (level < cap / w) OVER () AS final FROM l),
t AS (SELECT source, source_size, CASE WHEN final IS NULL OR cap / w <= final THEN cap::DOUBLE ELSE w * final END AS target FROM f),
c AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
r AS (SELECT *, floor(target - copies * source_size)::BIGINT AS rest FROM c),
h AS (SELECT source, hash, sum(size)::BIGINT AS words, count(*) AS n FROM d GROUP BY source, hash),
g AS (SELECT source, hash, words, n, (sum(words) OVER (PARTITION BY source ORDER BY hash))::BIGINT AS after FROM h),
o AS (SELECT d.*, r.source_size, r.target, r.copies, r.rest, g.words, g.n, g.after, g.after - g.words AS before
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN g ON d.source IS NOT DISTINCT FROM g.source AND d.hash = g.hash),
e AS (SELECT *, CASE WHEN after <= rest THEN 1 ELSE 0 END AS more, CASE WHEN before <= rest AND rest < after THEN least(size, (rest - before) // n) ELSE 0 END AS extra FROM o)
SELECT doc_id, size, source_size, target, (size * (copies + more) + extra)::BIGINT AS taken, (copies + more)::BIGINT AS copies, extra::BIGINT AS extra_words, source FROM e
"""
