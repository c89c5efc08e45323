"""Removal of long byte strings that occur again anywhere, by sorting sampled suffixes deep and shallow.

Every string of LENGTH bytes holds the sampled position (anchor) that its own bytes choose: the least hash of GRAM
bytes in it. So strings that are equal have anchors with equal contexts, and only suffixes at anchors whose GRAM bytes
occur more than once need sorting. Those are sorted by multikey quicksort to a depth of SHALLOW bytes; groups that are
still equal there are ordered by blind tries. Intervals of common prefixes of R bytes follow; two suffixes of one that
also share the L bytes before, with L + R at least LENGTH, are covered L back and R ahead.

An anchor's contexts that are too many for one task are parted by more and more of the bytes that follow, then of those
before; each part is sorted like any other. Contexts that match across parts share less than what parts have in common,
so of these only the strings that end there are compared as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import blocks, check_key, drop, join_skewed, join_small, settled, shared_dir, text_bytes, text_key, texts, tune, written
from tidewright.llm.words import lcp_intervals, mix

LENGTH, GRAM = 200, 40
#: Windows of grams in a string, and so the bytes that can stand before an anchor in it.
BACK = LENGTH - GRAM
#: Bytes that the quicksort looks at, some more than what an anchor's suffixes share anyway.
SHALLOW = 64
#: Text bytes that are hashed at a time; longer texts are cut with an overlap.
BLOCK = 1 << 20
#: Contexts that are sorted together, and rows that a task sorts at a time, if groups end there.
MOST_CONTEXTS, SORTED_ROWS = 20_000, 20_000
#: By how many bytes after the anchor, then before it, the contexts of an anchor are parted while they are too many.
AFTER, BEFORE = (48, 64, 96, 136, LENGTH), (40, 80, 120, BACK)

_FACTOR = 0x9E3779B97F4A7C15 | 1
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the factor and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0][0]) <= n:
        size = max(n + 1, 2 * BLOCK)
        with np.errstate(over="ignore"):
            _powers[0] = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, np.uint64(f)))]) for f in (_FACTOR, pow(_FACTOR, -1, 1 << 64)))
    return _powers[0]


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, gram hash) of the anchors in texts that lie in turn in data; off bounds the texts."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n >= 1 << 24:
        raise ValueError("block of texts is too long")
    ends = np.repeat(off[1:], np.diff(off))
    up, down = _power(n)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[:n])])
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
        # unique in a block: the upper bits of the hash, then the place, so that the leftmost least is taken
        ranked = (grams & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64)
        w = BACK + 1
        m = len(ranked) - w + 1
        padded = np.full(-(-len(ranked) // w) * w, np.uint64(2**64 - 1))
        padded[: len(ranked)] = ranked
        rows = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, 1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(behind[:m], ahead[w - 1 : w - 1 + m])
        least = least[np.arange(m) + LENGTH <= ends[:m]]
        change = np.ones(len(least), bool)
        change[1:] = least[1:] != least[:-1]
        at = np.unique((least[change] & np.uint64(0xFFFFFF)).astype(np.int64))
    return at, grams[at].astype(np.int64)


def _anchor_rows(v: np.ndarray, text: pa.Array) -> Iterator[pa.RecordBatch]:
    """h, c, d, v, at of the anchors of some texts: hash of the gram, 128 bits of the context, text, packed place."""
    data, off = text_bytes(text)
    k = 0
    while k < len(v):
        size = int(off[k + 1] - off[k])
        if size > BLOCK:  # cut with an overlap: every string lies within a part, and an anchor found twice is one
            end = k + 1
            own = np.array([0, size])
            parts = [(s, *anchors(data[off[k] + s : min(off[end], off[k] + s + BLOCK + LENGTH - 1)], np.array([0, min(size - s, BLOCK + LENGTH - 1)]))) for s in range(0, size - LENGTH + 1, BLOCK)]
            at, first = np.unique(np.concatenate([s + a for s, a, _ in parts]), return_index=True)
            h = np.concatenate([h for _, _, h in parts])[first]
        else:
            end = max(k + 1, min(int(np.searchsorted(off, off[k] + BLOCK, side="right")) - 1, len(v)))
            own = off[k : end + 1] - off[k]
            at, h = anchors(data[off[k] : off[end]], own)
        for s in range(0, len(at), 10_000):
            yield _rows(data[off[k] : off[end]], own, at[s : s + 10_000], h[s : s + 10_000], v[k:end])
        k = end


def _rows(data: np.ndarray, off: np.ndarray, at: np.ndarray, h: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Rows of anchors. The context has up to BACK bytes before the anchor and LENGTH from it, within the text."""
    doc = np.searchsorted(off, at, side="right") - 1
    before, after = np.minimum(at - off[doc], BACK), np.minimum(off[doc + 1] - at, LENGTH)
    held, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_128_digest
    found = b"".join([digest(held[a:b], s) for a, b, s in zip((at - before).tolist(), (at + after).tolist(), before.tolist(), strict=True)])
    both = np.frombuffer(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(h), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(v[doc]), pa.array(_packed(at - off[doc], before, after))], ["h", "c", "d", "v", "at"])


def _packed(place, before, after):
    return (place << 16) | (before << 8) | after


def shallow_sort(strings: list[bytes], depth: int = SHALLOW) -> list[list[int]]:
    """Groups of equal first `depth` bytes (a multiple of 8), in ascending order: multikey quicksort, eight bytes a key.

    Only groups that are still equal are looked at in the next key; all of a level's groups are parted at once.
    """
    n = len(strings)
    keys = np.frombuffer(b"".join(s[:depth].ljust(depth, b"\0") for s in strings), ">u8").reshape(n, depth // 8).astype(np.uint64)
    order, group = np.arange(n), np.zeros(n, np.int64)
    for k in range(depth // 8):
        sizes = np.bincount(group, minlength=n)
        tied = np.flatnonzero(sizes[group] > 1)
        if not len(tied):
            break
        col = keys[order[tied], k]
        by = np.lexsort((col, group[tied]))
        order[tied] = order[tied][by]
        col, g = col[by], group[tied]
        new = np.ones(len(tied), bool)
        new[1:] = (g[1:] != g[:-1]) | (col[1:] != col[:-1])
        group[tied] = np.maximum.accumulate(np.where(new, tied, 0))
    bounds = np.flatnonzero(np.diff(group, prepend=-1)).tolist() + [n]
    return [order[i:j].tolist() for i, j in zip(bounds, bounds[1:], strict=False)]


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """Orders strings by branching bytes alone: an inner node knows a depth, a leaf the strings that are equal to its end.

    A new string goes down by its bytes at the nodes' depths, blindly, to some leaf; comparing it with that one string
    tells its true common prefix, at which it branches off the path.
    """

    def __init__(self) -> None:
        self.root: list | None = None  # [depth, {byte or -1: node}] or [depth, None, numbers, string]

    def add(self, string: bytes, number: int) -> None:
        if self.root is None:
            self.root = [len(string), None, [number], string]
            return
        node = self.root
        while node[1] is not None:
            depth = node[0]
            node = node[1].get(string[depth] if depth < len(string) else -1) or next(iter(node[1].values()))
        other = node[3]
        lcp = common(string, other)
        if lcp == len(string) == len(other):
            node[2].append(number)
            return
        leaf = [len(string), None, [number], string]
        mine, its = (s[lcp] if lcp < len(s) else -1 for s in (string, other))
        up, node = None, self.root
        while node[1] is not None and node[0] < lcp:
            up, node = node, node[1][string[node[0]]]
        if node[1] is not None and node[0] == lcp:
            node[1][mine] = leaf
            return
        inner = [lcp, {mine: leaf, its: node}]
        if up is None:
            self.root = inner
        else:
            up[1][string[up[0]]] = inner

    def ordered(self) -> tuple[list[int], list[int]]:
        """(numbers in the strings' order, what each shares with the one before it; 0 first)."""
        order: list[int] = []
        lcp: list[int] = []
        stack: list[tuple[list, int]] = [(self.root, 0)] if self.root else []
        while stack:
            node, shared = stack.pop()
            if node[1] is None:
                lcp += [shared] + [node[0]] * (len(node[2]) - 1)
                order += node[2]
            else:
                keys = sorted(node[1])
                stack += [(node[1][b], node[0]) for b in reversed(keys[1:])] + [(node[1][keys[0]], shared)]
        return order, lcp


def deep_shallow(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """(order of the strings, bytes that each shares with the one before it): quicksort, then tries for what is left."""
    order: list[int] = []
    lcp: list[int] = []
    for group in shallow_sort(strings):
        if len(group) > 1:
            trie = BlindTrie()
            for k in group:
                trie.add(strings[k], k)
            group, shared = trie.ordered()
        else:
            shared = [0]
        shared[0] = common(strings[order[-1]], strings[group[0]]) if order else 0
        order += group
        lcp += shared
    return order, lcp


def covers(contexts: list[tuple[int, bytes, bytes]]) -> list[tuple[int, int]]:
    """(back, ahead) that equal strings cover around each anchor, (0, 0) if none.

    contexts: times it occurs, bytes before, bytes from the anchor on; all different.
    """
    n = len(contexts)
    back, ahead = [0] * n, [0] * n

    def cover(k: int, left: int, right: int) -> None:
        if left + right >= LENGTH:
            back[k], ahead[k] = max(back[k], left), max(ahead[k], right)

    for k, (times, before, after) in enumerate(contexts):
        if times > 1:
            cover(k, len(before), len(after))
    order, lcp = deep_shallow([a for _, _, a in contexts])
    turned = [b[::-1] for _, b, _ in contexts]
    rank = [0] * n
    for place, k in enumerate(sorted(range(n), key=turned.__getitem__)):
        rank[k] = place
    for first, last, right in zip(*(x.tolist() for x in lcp_intervals(lcp, GRAM)), strict=True):
        # within an interval, what stands before is most alike in neighbours by its order from the anchor back
        for x, y in pairwise(sorted(order[first : last + 1], key=rank.__getitem__)):
            left = common(turned[x], turned[y])
            cover(x, left, right)
            cover(y, left, right)
    return list(zip(back, ahead, strict=True))


_COVERS = "h long, c long, d long, n long, back int, ahead int"


def _sorted_covers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_COVERS for rows (h, part, c, d, n, before, after) in order of (h, part); several groups are sorted together."""
    held: dict[tuple, tuple[int, bytes, bytes]] = {}
    last = None

    def done() -> Iterator[pa.RecordBatch]:
        found = [(*key, held[key][0], b, a) for key, (b, a) in zip(held, covers(list(held.values())), strict=True) if b + a]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (*[pa.int64()] * 4, pa.int32(), pa.int32()), strict=True)], ["h", "c", "d", "n", "back", "ahead"])
        held.clear()

    for b in batches:
        for h, part, c, d, n, before, after in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if (h, part) != last and len(held) >= SORTED_ROWS:
                yield from done()
            last = h, part
            held[h, c, d] = (n, before, after)
    yield from done()


_CONTEXTS = "h long, c long, d long, n long, size long, before binary, after binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_CONTEXTS for rows (text, wanted)."""
    for b in batches:
        rows = []
        for text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            data = text.encode()
            for w in wanted:
                place, left, right = w["at"] >> 16, w["at"] >> 8 & 255, w["at"] & 255
                rows.append((w["h"], w["c"], w["d"], w["n"], w["size"], data[place - left : place], data[place : place + right]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 5, pa.binary(), pa.binary()), strict=True)], [x.split()[0] for x in _CONTEXTS.split(", ")])


def _all_covers(contexts: DataFrame, largest: int, most: int, folder: str) -> DataFrame:
    """_COVERS for all contexts; size is the number of contexts at an anchor's bytes, `largest` the greatest.

    Those of an anchor with more than `most` are parted by the hash of some bytes after the anchor, until a part has at
    most so many, then, among contexts alike in all that follows, by bytes before it. The last level tells all contexts
    apart. A context that was parted by its first D bytes shares less than D with those of other parts: they can match
    in strings with GRAM to D - 1 bytes from the anchor on, which are compared as a whole (_across).
    """
    kept, crossing = [contexts.withColumn("part", F.lit(0).cast("long"))], []
    if largest > most:
        contexts = written(contexts, f"{folder}/bytes")
        kept = [contexts.filter(F.col("size") <= most).withColumn("part", F.lit(0).cast("long"))]
        rest = contexts.filter(F.col("size") > most)
        levels = [(F.xxhash64(F.substring("after", 1, d)), LENGTH - d + 1) for d in AFTER]
        levels += [(F.xxhash64("after", F.col("before").substr(F.greatest(F.octet_length("before") - d, F.lit(0)) + 1, F.lit(d))), 0) for d in BEFORE]
        for k, (key, least_back) in enumerate(levels):
            keyed = rest.withColumn("part", key)
            sizes = written(keyed.groupBy("h", "part").agg(F.count("*").alias("parted")), f"{folder}/parts{k}")
            total = sizes.agg(F.coalesce(F.sum("parted"), F.lit(0))).first()[0]
            keyed = written(join_skewed(keyed, sizes, ["h", "part"], "parted", total, "inner"), f"{folder}/level{k}")
            small = F.col("parted") <= most
            here = keyed.filter(small if k + 1 < len(levels) else F.lit(True))
            kept.append(here.drop("parted"))
            crossing.append(here.select("h", "c", "d", "n", "before", "after", F.lit(least_back).alias("least_back")))
            rest = keyed.filter(~small).drop("parted", "part")
            if k + 1 == len(levels) or not rest.head(1):
                break
    rows = kept[0]
    for x in kept[1:]:
        rows = rows.unionByName(x)
    rows = rows.select("h", "part", "c", "d", "n", "before", "after").repartition("h", "part").sortWithinPartitions("h", "part")
    found = rows.mapInArrow(_sorted_covers, _COVERS)
    if not crossing:
        return found
    rows = crossing[0]
    for x in crossing[1:]:
        rows = rows.unionByName(x)
    found = found.unionByName(_across(rows, folder))
    return found.groupBy("h", "c", "d").agg(F.first("n").alias("n"), F.max("back").alias("back"), F.max("ahead").alias("ahead"))


def _across(rows: DataFrame, folder: str) -> DataFrame:
    """_COVERS for contexts of an anchor that match across parts: equal strings of LENGTH bytes with at least
    least_back bytes before the anchor, each a group of its own."""
    least = F.greatest(F.col("least_back"), LENGTH - F.octet_length("after"))
    most = F.least(F.octet_length("before"), F.lit(BACK))
    each = rows.filter(least <= most).withColumn("back", F.explode(F.sequence(least, most)))
    string = F.concat("before", "after").substr(F.octet_length("before") - F.col("back") + 1, F.lit(LENGTH))
    # a string counts once for each place of the anchor in it: anchors of equal bytes may lie in one string
    each = each.select("h", "back", F.sha2(string, 256).alias("key"), "c", "d", "n")
    twice = written(each.groupBy("h", "back", "key").agg(F.count("*").alias("contexts")).filter("contexts > 1"), f"{folder}/across")
    total = twice.agg(F.coalesce(F.sum("contexts"), F.lit(0))).first()[0]
    hit = join_skewed(each, twice, ["h", "back", "key"], "contexts", total, "inner")
    return hit.groupBy("h", "c", "d").agg(F.first("n").alias("n"), F.max("back").cast("int").alias("back"), F.max(LENGTH - F.col("back")).cast("int").alias("ahead"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """v, n_removed, n_spans, kept_sha256 for rows (v, text, spans as a list of start, end)."""
    for b in batches:
        out = []
        for v, text, spans in zip(*(x.to_pylist() for x in b.columns), strict=True):
            data = text.encode()
            digest, at, runs, removed = hashlib.sha256(), 0, 0, 0
            for s, e in runs_of([(x["s"], x["e"]) for x in spans]):
                digest.update(data[at:s])
                runs, removed, at = runs + 1, removed + e - s, e
            digest.update(data[at:])
            out.append((v, removed, runs, digest.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["v", "n_removed", "n_spans", "kept"])


def runs_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs of overlapping or touching spans."""
    found: list[list[int]] = []
    for s, e in sorted(spans):
        if found and s <= found[-1][1]:
            found[-1][1] = max(found[-1][1], e)
        else:
            found.append([s, e])
    return [(s, e) for s, e in found]


def repeated_spans(docs: DataFrame, folder: str, copies: DataFrame, clashes: list[int], most_contexts: int = MOST_CONTEXTS) -> tuple[DataFrame, DataFrame]:
    """(distinct texts v, text; spans: v, spans) of what repeats between or within distinct texts.

    copies: v, n, head of texts that occur in several rows; a text's row of id `head` stands for them all.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    base = join_small(docs.select("doc_id", text_key(text, clashes).alias("v"), text.alias("text")), copies.select("v", "head", F.lit(True).alias("several")), "v", "left")
    base = base.filter(F.col("several").isNull() | F.col("doc_id").eqNullSafe(F.col("head"))).select("v", "text")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 1, BLOCK):
            yield from _anchor_rows(b.column(0).to_numpy(), texts(b.column(1)))

    rows = written(base.mapInArrow(sample, "h long, c long, d long, v long, at long"), f"{folder}/anchors")
    often = written(rows.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), f"{folder}/often")
    total = often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = written(join_skewed(rows, often, "h", "n", total, "inner", small=False).drop("n"), f"{folder}/repeated")
    drop(spark, f"{folder}/anchors", f"{folder}/often")
    distinct = written(rows.groupBy("h", "c", "d").agg(F.count("*").alias("n"), F.first("v").alias("v"), F.first("at").alias("at")), f"{folder}/contexts")
    per = written(distinct.groupBy("h").agg(F.count("*").alias("size")), f"{folder}/per")
    total, largest = per.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    sized = join_skewed(distinct, per, "h", "size", total, "inner", small=False)
    # one context alone, several times: all of it occurs again
    left, right = F.shiftright("at", 8).bitwiseAND(255), F.col("at").bitwiseAND(255)
    sized = written(sized.filter((F.col("size") > 1) | (left + right >= LENGTH)), f"{folder}/sized")
    drop(spark, f"{folder}/contexts", f"{folder}/per")
    whole = sized.filter("size = 1").select("h", "c", "d", "n", left.cast("int").alias("back"), right.cast("int").alias("ahead"))
    wanted = written(sized.filter("size > 1").groupBy("v").agg(F.collect_list(F.struct("h", "c", "d", "n", "size", "at")).alias("wanted")), f"{folder}/wanted")
    near = join_small(base, wanted.select("v"), "v", "left_semi").join(wanted, "v").select("text", "wanted")
    found = _all_covers(near.mapInArrow(_contexts, _CONTEXTS), largest, most_contexts, folder).unionByName(whole)
    found = written(found, f"{folder}/covers")
    drop(spark, f"{folder}/sized", f"{folder}/wanted", f"{folder}/bytes")
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    place = F.shiftright("at", 16)
    spans = join_skewed(rows.select("h", "c", "d", "v", "at"), found, ["h", "c", "d"], "n", total, "inner", small=False).select("v", F.struct((place - F.col("back")).alias("s"), (place + F.col("ahead")).alias("e")).alias("span"))
    spans = written(spans.groupBy("v").agg(F.collect_set("span").alias("spans")), f"{folder}/spans")
    drop(spark, f"{folder}/repeated", f"{folder}/covers")
    return base, spans


def without_repeats(docs: DataFrame, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each of docs.

    Every byte of a text's UTF-8 that lies in a string of LENGTH bytes which also starts elsewhere, in this or
    another row, is removed; matches are judged on the input and never cross rows. Texts that several rows share
    count once, and are removed whole if they have LENGTH bytes. Texts are told apart by 124 bits, contexts by their
    gram's hash and 128 bits more. Null texts are empty: nothing to remove. Null ids and repeated rows are rows like
    others. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    folder = shared_dir(spark)
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))

    made: dict[str, DataFrame] = {}

    def keyed(clashes: list[int]) -> DataFrame:
        slim = docs.select("doc_id", text_key(text, clashes).alias("v"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("sha"))
        slim = made["slim"] = written(slim, f"{folder}/slim")
        check = check_key(F.col("sha"))
        copies = slim.groupBy("v").agg(F.count("*").alias("n"), F.min("doc_id").alias("head"), F.max("n_bytes").alias("size"), F.min(check).alias("low"), F.max(check).alias("high")).filter("n > 1")
        made["copies"] = written(copies, f"{folder}/copies")
        return made["copies"]

    clashes = settled(keyed)
    slim, copies = made["slim"], made["copies"]
    n_docs = slim.count()
    base, spans = repeated_spans(docs, folder, copies, clashes, most_contexts)
    spans = spans.join(copies.select("v"), "v", "left_anti")
    touched = join_small(base, spans.select("v"), "v", "left_semi").join(spans, "v").select("v", "text", "spans")
    kept = touched.mapInArrow(_kept, "v long, n_removed long, n_spans long, kept string")
    gone = copies.filter(F.col("size") >= LENGTH).select("v", "n", F.col("size").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(b""), 256).alias("kept"))
    changed = written(kept.select("v", F.lit(1).cast("long").alias("n"), "n_removed", "n_spans", "kept").union(gone), f"{folder}/changed")
    drop(spark, f"{folder}/spans")
    out = join_skewed(slim, changed, "v", "n", n_docs)
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"))
