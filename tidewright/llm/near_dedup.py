"""Near-duplicate classes: DartMinHash signatures, banded candidates, exact verification, connected components.

The five-word shingles of a text weigh as often as they occur. Two texts resemble each other by the sum of their
shingles' lesser counts over the sum of the greater ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import blocks, check_key, drop, join_skewed, join_small, join_wide, settled, shared_dir, text_key, texts, tune, written
from tidewright.llm.dartminhash import band_keys, shingles, signatures
from tidewright.llm.words import sums

#: Words of a shingle, least similarity of a link.
WORDS, SIMILARITY = 5, 0.8
#: Bands and rows: a pair at the least similarity shares a band but for a chance of (1 - 0.8 ** 5) ** 30, 7 in a million.
BANDS, ROWS = 30, 5
#: Text bytes whose darts are thrown at a time.
BLOCK = 1 << 19
#: Texts of a group of prefix_pairs that are compared with all others of it; groups with more are parted, so many times at most.
MOST_ACTIVE, MOST_LEVELS = 2000, 8


def signed(docs: DataFrame, clashes: list[int]) -> DataFrame:
    """doc_id, v (key of the text), check, bands for each of docs. Documents without words have no bands."""
    tune(docs.sparkSession)
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), text_key(text, clashes).alias("v"), check_key(F.sha2(text, 256)).alias("check"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 1, BLOCK):
            elements, times, off = shingles(texts(block.column(1)), WORDS)
            sig = signatures(elements, times.astype(np.float64), off, BANDS * ROWS)
            keys = band_keys(sig, BANDS, ROWS)
            there = np.diff(off) > 0
            ends = np.concatenate([[0], np.cumsum(there * BANDS)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[there].ravel()))
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(2), block.column(3), bands], ["doc_id", "v", "check", "bands"])

    return rows.mapInArrow(sign, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, v long, check long, bands array<long>")


def shingle_sets(texts_: DataFrame) -> DataFrame:
    """v, set, times, n: each text's distinct shingle hashes, how often each occurs, and how many there are in all."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 1, BLOCK):
            elements, times, off = shingles(texts(block.column(1)), WORDS)
            ends = pa.array(off.astype(np.int32))
            sets, counts = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in (elements.astype(np.int64), times.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([block.column(0), sets, counts, pa.array(sums(times, off))], ["v", "set", "times", "n"])

    return texts_.select("v", "text").mapInArrow(cut, "v long, set array<long>, times array<int>, n long")


def _occurrences(of: str) -> Column:
    """A hash for each numbered occurrence of each element: what two texts have in common of these is the sum of lesser counts."""
    again = lambda x: F.transform(F.sequence(F.lit(2), x["times"]), lambda k: F.xxhash64(x["set"], k))
    more = F.flatten(F.transform(F.filter(F.arrays_zip(F.col(f"{of}.set"), F.col(f"{of}.times")), lambda x: x["times"] > 1), again))
    return F.when(F.size(f"{of}.set") == F.col(f"{of}.n"), F.col(f"{of}.set")).otherwise(F.concat(F.col(f"{of}.set"), more))


def linked(pairs: DataFrame, sets: DataFrame, folder: str, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (v, w; a written table) whose weighted sets resemble by at least `similarity`.

    The set of w, which should be in few pairs, goes with each of them; that of v, which may be in most, is copied to
    the tasks that a thousandth of all pairs makes, not to every pair.
    """
    per = written(pairs.groupBy("v").agg(F.count("*").alias("n")), f"{folder}/per")
    total = pairs.count()
    whole = F.struct("set", "times", "n")
    one, two = sets.select("v", whole.alias("one")), sets.select(F.col("v").alias("w"), whole.alias("two"))
    out = join_wide(pairs.join(two, "w"), one, per, "v", "n", total, "w")
    out = out.withColumn("common", F.size(F.array_intersect(_occurrences("one"), _occurrences("two"))))
    return out.filter(F.col("common") >= similarity * (F.col("one.n") + F.col("two.n") - F.col("common"))).select("v", "w")


def components(links: DataFrame, folder: str) -> DataFrame:
    """v, c: the least vertex of each linked vertex's component.

    Alternates large and small stars, each a minimum by vertex and a join back, until the links are stars around
    their least vertex. Every round is written to folder. Vertices of many links are no hot task (join_skewed).
    """
    edges = written(links.select(F.greatest("v", "w").alias("u"), F.least("v", "w").alias("w")).filter("u <> w").distinct(), f"{folder}/edges0")
    mark, n = None, 0
    while True:
        both = edges.union(edges.select("w", "u"))
        least = both.groupBy("u").agg(F.min("w").alias("m0"), F.count("*").alias("n")).select("u", F.least("u", "m0").alias("m"), "n")
        total = 2 * edges.count()
        large = join_skewed(both, least, "u", "n", total, "inner").filter("w > u").select(F.col("w").alias("u"), F.col("m").alias("w")).filter("u <> w").distinct()
        large = written(large, f"{folder}/large{n}")
        least = large.groupBy("u").agg(F.min("w").alias("m"), F.count("*").alias("n"))
        small = join_skewed(large, least, "u", "n", total, "inner")
        small = small.select(F.col("w").alias("u"), F.col("m").alias("w")).union(small.select("u", F.col("m").alias("w"))).filter("u <> w").distinct()
        n += 1
        edges = written(small, f"{folder}/edges{n}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "w").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("v"), F.col("w").alias("c")).union(edges.select(F.col("w").alias("v"), F.col("w").alias("c")).distinct())
        mark = now


def prefix_pairs(apart: DataFrame, sets: DataFrame, folder: str, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (v, w) of texts of different components that may resemble by `similarity`; it leaves out no pair that does.

    apart: v, c (component). Two sets of weights n and m that resemble enough share a weight of at least
    o = t / (1 + t) * (n + m). So, in any fixed order, the first element they share has a weight of at most n - o before it
    in the one and m - o in the other; in the lighter set that is at most n - 2t / (1 + t) * n, up to where it is said to
    be active. The order is by how many texts have an element, so that what large groups have in common hardly ever
    makes a pair.

    Texts with one of their first elements in common are a group. A group's active texts are compared with all of it
    if they are at most MOST_ACTIVE, so pairs grow with the texts. A group with more is parted in the same way by itself,
    in the order of what is rare within the group. Groups of the same texts are one, by the first of their elements in
    the order, where all their texts have the least place. A group that cannot be parted any
    more, or was MOST_LEVELS times, is compared all the same: there, all active texts have so much in common that they
    resemble one another, and their components are mostly one.
    """
    out = None
    # one row a text and group; sets are fetched by v, and what is shuffled of them has no more than it needs
    members = written(apart.join(sets.select("v", "n"), "v").select(F.col("v").alias("id"), "v", "c", "n", F.lit(0).cast("long").alias("g"), F.lit(-1).cast("long").alias("of")), f"{folder}/members")
    for level in range(MOST_LEVELS):
        at = f"{folder}/{level}"
        element = F.xxhash64("g", "x.set") if level else F.col("x.set")
        each = members.select("id", "v", "g").join(sets.select("v", "set", "times"), "v").select("id", "g", F.explode(F.arrays_zip("set", "times")).alias("x")).select("id", element.alias("e"), F.col("x.times").alias("k"))
        often = written(each.groupBy("e").agg(F.count("*").alias("texts")).filter("texts > 1"), f"{at}/often")
        total = often.agg(F.coalesce(F.sum("texts"), F.lit(0))).first()[0]
        # elements of one text only come first in its order, and need no rows: all others' weight tells theirs
        shared = join_wide(each, often, often, "e", "texts", total, "id").join(members, "id")
        whole, order = Window.partitionBy("id"), Window.partitionBy("id").orderBy("texts", "e").rowsBetween(Window.unboundedPreceding, 0)
        first = shared.withColumn("place", F.col("n") - F.sum("k").over(whole) + F.sum("k").over(order) - F.col("k")).filter(F.col("place") <= F.col("n") - F.ceil(similarity * F.col("n") - 1e-9))
        active = F.col("place") <= F.col("n") - F.ceil(2 * similarity / (1 + similarity) * F.col("n") - 1e-9)
        first = written(first.select("e", "v", "c", "n", "of", "texts", "place", active.alias("active")), f"{at}/first")
        groups = first.groupBy("e").agg(
            F.count("*").alias("m"), F.count_if("active").alias("actives"), F.first("texts").alias("texts"), F.first("of").alias("of"), F.min("c").alias("c1"), F.max("c").alias("c2"),
            F.bit_xor(F.xxhash64("v")).alias("x1"), F.bit_xor(F.xxhash64(F.lit("again"), "v")).alias("x2"),
        )
        groups = groups.filter("actives > 0 and c1 <> c2").groupBy("m", "x1", "x2").agg(F.min(F.struct("texts", "e", "actives")).alias("r"), F.first("of").alias("of"))
        large = (F.col("r.actives") > MOST_ACTIVE) & (F.col("of") != F.col("m")) & F.lit(level + 1 < MOST_LEVELS)
        groups = written(groups.select(F.col("r.e").alias("e"), "m", large.alias("large")), f"{at}/groups")
        total = groups.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
        rows = written(join_skewed(first.drop("of", "texts"), groups, "e", "m", total, "inner", small=False), f"{at}/rows")
        few = rows.filter("not large")
        actives = few.filter("active").groupBy("e", "m").agg(F.collect_list(F.struct("v", "c", "n", "place")).alias("x"))
        met = join_skewed(few.drop("active", "m"), written(actives, f"{at}/actives"), "e", "m", total, "inner", small=False)

        def near(x: Column) -> Column:
            o = F.ceil(similarity / (1 + similarity) * (F.col("n") + x["n"]) - 1e-9)
            return (x["n"] <= F.col("n")) & (x["c"] != F.col("c")) & (F.col("place") <= F.col("n") - o) & (x["place"] <= x["n"] - o)

        pairs = written(met.select("v", F.explode(F.transform(F.filter("x", near), lambda x: x["v"])).alias("w")).distinct(), f"{at}/pairs")  # noqa: B023
        out = pairs if out is None else out.union(pairs)
        if not groups.filter("large").head(1):
            break
        members = written(rows.filter("large").select(F.monotonically_increasing_id().alias("id"), "v", "c", "n", F.col("e").alias("g"), F.col("m").alias("of")), f"{at}/members")
    return out.select(F.least("v", "w").alias("v"), F.greatest("v", "w").alias("w")).distinct()


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, v, class_id, label, class_texts: one row for each of docs, with its class of near duplicates.

    Links join texts whose weighted five-word shingles resemble by at least `similarity`; classes are their components,
    class_id the least doc_id in the class (null if all are null), class_texts its distinct texts, label the least key
    of them. Copies share v, a key that no other text has (text_key), and enter once. Candidates share one of BANDS
    bands of a DartMinHash signature:

    1. in each band, every text is compared with the one that shares most bands with others (pairs grow with the texts,
       not their squares);
    2. links found so make components; texts of bands that still hold several of them are joined by rare elements
       (prefix_pairs), which finds every link between different components: no link within a band is lost.

    A text without words is the like of its copies only. Nulls count as empty texts; texts are taken some hundred kB at
    a time, a longer one by itself. Repeated rows are copies; null ids are the least of no class that has another. An
    empty table gives no rows. Other columns are ignored. Of the corpus, only counts come to the driver.
    """
    return _classes(docs, similarity)[0]


def _classes(docs: DataFrame, similarity: float) -> tuple[DataFrame, list[int]]:
    """(near_classes, the clashes by which its keys are distinct)."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    made: dict[str, DataFrame] = {}

    def keyed(clashes: list[int]) -> DataFrame:
        slim = made["slim"] = written(signed(docs, clashes), f"{folder}/signed")
        verts = slim.groupBy("v").agg(F.first("bands").alias("bands"), F.min("doc_id").alias("least_id"), F.count("*").alias("n"), F.min("check").alias("low"), F.max("check").alias("high"))
        made["verts"] = written(verts, f"{folder}/work/texts")
        return made["verts"]

    clashes = settled(keyed)
    slim, verts, work = made["slim"], made["verts"], f"{folder}/work"
    n_docs = slim.count()
    banded = verts.select(F.explode("bands").alias("key"), "v")
    shared = written(banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), f"{work}/bands")
    n_rows = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    members = written(join_skewed(banded, shared, "key", "n", n_rows, "inner"), f"{work}/shared")
    known = written(members.groupBy("v").agg(F.sum("n").alias("known")), f"{work}/known")
    heads = join_small(members, known, "v", "inner").groupBy("key").agg(F.max(F.struct("known", "v")).alias("h"), F.count("*").alias("n"))
    heads = written(heads.select("key", F.col("h.v").alias("head"), "n"), f"{work}/heads")
    members = written(join_skewed(members.drop("n"), heads, "key", "n", n_rows, "inner").drop("n"), f"{work}/members")
    drop(spark, f"{work}/shared", f"{work}/bands")
    pairs = written(members.filter("v <> head").select(F.col("head").alias("v"), F.col("v").alias("w")).distinct(), f"{work}/pairs")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    of_some = join_small(docs.select(text_key(text, clashes).alias("v"), text.alias("text")), known.select("v"), "v", "left_semi").groupBy("v").agg(F.first("text").alias("text"))
    sets = written(shingle_sets(of_some), f"{work}/sets")
    links = written(linked(pairs, sets, f"{work}/one", similarity), f"{work}/links1")
    found = written(components(links, f"{work}/first"), f"{work}/found1")
    # what the comparisons with the heads left apart within a band
    labelled = join_small(members, found, "v", "left").withColumn("c", F.coalesce("c", "v"))
    apart = written(labelled.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count("*").alias("n")).filter("c1 <> c2").select("key", "n"), f"{work}/bands2")
    total = apart.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    apart = written(join_skewed(labelled, apart, "key", "n", total, "inner").select("v", "c").distinct(), f"{work}/apart")
    pairs = written(prefix_pairs(apart, sets, f"{work}/prefix", similarity), f"{work}/pairs2")
    more = written(linked(pairs, sets, f"{work}/two", similarity), f"{work}/links2")
    if more.head(1):
        found = written(components(found.filter("v <> c").select("v", F.col("c").alias("w")).union(more), f"{work}/second"), f"{work}/found2")
    # a class has several texts or a text several rows; all others are their own
    classes = verts.select("v", "least_id", "n").join(found, "v", "left").withColumn("label", F.coalesce("c", "v")).drop("c")
    of_class = classes.groupBy("label").agg(F.min("least_id").alias("class_id"), F.count("*").alias("class_texts"), F.sum("n").alias("rows"))
    several = written(of_class.filter("rows > 1"), f"{work}/several")
    n_texts = several.agg(F.coalesce(F.sum("class_texts"), F.lit(0))).first()[0]
    in_class = written(join_skewed(classes, several, "label", "class_texts", n_texts, "inner").select("v", "n", "label", "class_id", "class_texts"), f"{folder}/classes")
    drop(spark, work)
    out = join_skewed(slim.select("doc_id", "v"), in_class, "v", "n", n_docs)
    alone = F.col("label").isNull()
    out = out.select("doc_id", "v", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("label", "v").alias("label"), F.coalesce("class_texts", F.lit(1)).cast("long").alias("class_texts"))
    return out, clashes


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, all columns, without those that near_classes puts in a class with an earlier one.

    Of each class, the row with the least doc_id stays (null ids last; then the least key of the text; of repeated
    rows one). Only rows of classes of several are shuffled with their texts, and each task passes on one row a class.
    Null, empty and long texts are as in near_classes; an empty table stays empty; columns may have any names.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    classes, clashes = _classes(docs, similarity)
    classes = written(classes, f"{folder}/near")
    # the key and label of every text that isn't alone: one row a text
    per_text = classes.groupBy("v").agg(F.first("label").alias("label"), F.count("*").alias("n"))
    per_class = written(per_text.groupBy("label").agg(F.sum("n").alias("rows"), F.count("*").alias("texts")).filter("rows > 1"), f"{folder}/per")
    n_texts = per_class.agg(F.coalesce(F.sum("texts"), F.lit(0))).first()[0]
    labels = written(join_skewed(per_text, per_class, "label", "texts", n_texts, "inner").select("v", "label", "n"), f"{folder}/labels")
    n = classes.count()
    drop(spark, f"{folder}/per")
    own = [f"c{k}" for k in range(len(docs.columns))]
    named = dict(zip(docs.columns, own, strict=True))
    text = F.coalesce(F.col(named["text"]).cast("string"), F.lit(""))
    rows = docs.toDF(*own).withColumn("v", text_key(text, clashes))
    both = join_skewed(rows, labels, "v", "n", n)
    several = both.filter(F.col("label").isNotNull())
    first = Window.partitionBy("label").orderBy(F.col(named["doc_id"]).asc_nulls_last(), "v")
    several = several.withColumn("r", F.row_number().over(first)).filter("r = 1")
    return both.filter(F.col("label").isNull()).select(*own).union(several.select(*own)).toDF(*docs.columns)
