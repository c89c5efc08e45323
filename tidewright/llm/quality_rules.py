"""Quality rules on whole texts, with repetition measured by suffix arrays over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewright.llm.common import blocks, text_bytes, texts, tune
from tidewright.llm.words import chunked, lcp_intervals, mix, ragged, sums

#: Words of the shortest repeat that counts.
LEAST = 5
# The base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Of a document that is kept, maximal repeats cover at most this share of the words' characters, ...
MAX_COVERED = 0.15
#: ... or that share if they are at most so many characters (a line that a short text has twice), ...
MAX_COVERED_SHORT, SHORT_CHARS = 0.25, 200
#: ... and the longest has at most so many words, however long the document is.
MAX_LONGEST = 50

_WHITE = " \t\n\r\x0b\x0c"
_WORD_START = np.zeros(256, np.uint8)
_WORD_START[[b for b in range(256) if b & 0xC0 != 0x80 and chr(b) not in _WHITE]] = 1
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[[ord(c) for c in SYMBOLS]] = 1


def ranges_sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of small values over ranges, empty ones included, without a running total of them all."""
    if not len(values):
        return np.zeros(len(off) - 1, np.int64)
    out = np.add.reduceat(values, np.minimum(off[:-1], len(values) - 1), dtype=np.int64)
    out[off[:-1] == off[1:]] = 0
    return out


def repeated_grams(codes: np.ndarray, owner: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """Positions whose next `least` words occur again in the same document, ascending. ends: the document's end, by position."""
    n = len(codes)
    if n < least:
        return np.zeros(0, np.int64)
    m = n - least + 1
    with np.errstate(over="ignore"):
        h = owner[:m].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(least):
            h = h * np.uint64(0xD1342543DE82EF95) + codes[k : k + m].astype(np.uint64) + np.uint64(1)
    at = np.flatnonzero(np.arange(m) + least <= ends[:m])
    h = mix(h[at])
    bits = max(12, len(h).bit_length() + 1)
    slots = (h >> np.uint64(64 - bits)).astype(np.int64)
    # a slot with one position cannot hold a repeat; what is left is compared by its whole hash
    last = np.zeros(1 << bits, np.int32)
    last[slots] = np.arange(len(slots), dtype=np.int32)
    shared = np.zeros(1 << bits, bool)
    shared[slots[last[slots] != np.arange(len(slots))]] = True
    some = np.flatnonzero(shared[slots])
    order = some[np.argsort(h[some], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    return np.sort(at[order[twice]])


def suffix_order(codes: np.ndarray, ends: np.ndarray, at: np.ndarray, owner: np.ndarray, least: int) -> np.ndarray:
    """The positions `at` in the order of their documents' suffixes, document by document; `at` as repeated_grams gives it.

    Sorts by the first `least` words, then by prefix doubling: groups that are still equal are ordered by the next
    words and by the rank of the position as far ahead as all words compared so far.
    """

    def word(p: np.ndarray, k: int) -> np.ndarray:
        q = p + k
        inside = q < ends[p]
        return np.where(inside, codes[np.minimum(q, len(codes) - 1)], -1)

    order = at[np.lexsort([word(at, k) for k in range(least - 1, -1, -1)] + [owner[at]])]
    new = np.ones(len(order), bool)
    new[1:] = owner[order[1:]] != owner[order[:-1]]
    for k in range(least):
        w = word(order, k)
        new[1:] |= w[1:] != w[:-1]
    depth = least
    rank = np.zeros(len(codes) + 1, np.int64)
    group = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    while True:
        rank[order] = group + 1
        sizes = np.bincount(group, minlength=len(order))
        open_ = np.flatnonzero(sizes[group] > 1)
        if not len(open_):
            return order
        p = order[open_]
        ahead = np.where(p + depth < ends[p], p + depth, len(codes))
        keys = [rank[ahead]] + [word(p, depth + k) for k in range(least - 1, -1, -1)]
        by = np.lexsort([*keys, group[open_]])
        order[open_] = p[by]
        split = np.ones(len(open_), bool)
        g = group[open_]
        split[1:] = g[1:] != g[:-1]
        for key in keys:
            k = key[by]
            split[1:] |= k[1:] != k[:-1]
        starts = np.where(split, open_, 0)
        group[open_] = np.maximum.accumulate(starts)
        depth *= 2


def common_prefixes(codes: np.ndarray, ends: np.ndarray, order: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Words that each suffix shares with the one before it in order (0 across documents).

    In text order a value falls by at most one; only where the words before two neighbours differ is it found by
    comparing, some words at a time for all of them, then in growing slices.
    """
    before = np.full(len(codes), -1, np.int64)
    same = owner[order[1:]] == owner[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    p, q = at, before[at]
    prev_q = np.where(p > 0, before[np.maximum(p - 1, 0)], -2)
    follows = (p > 0) & (q > 0) & (prev_q == q - 1) & (prev_q >= 0)
    follows[1:] &= p[1:] == p[:-1] + 1
    follows[:1] = False
    head = np.flatnonzero(~follows)
    hp, hq = p[head], q[head]
    length = np.zeros(len(head), np.int64)
    live = np.flatnonzero(hq >= 0)
    for k in range(16):
        a, b = hp[live] + k, hq[live] + k
        ok = (a < ends[hp[live]]) & (b < ends[hq[live]])
        ok[ok] = codes[a[ok]] == codes[b[ok]]
        live = live[ok]
        length[live] = k + 1
    for i in live.tolist():
        a, b, n = int(hp[i]), int(hq[i]), 16
        most = min(int(ends[a]) - a, int(ends[b]) - b)
        step = 64
        while n < most:
            m = min(step, most - n)
            differ = codes[a + n : a + n + m] != codes[b + n : b + n + m]
            if differ.any():
                n += int(differ.argmax())
                break
            n += m
            step *= 2
        length[i] = n
    run = np.cumsum(~follows) - 1
    found = np.zeros(len(codes), np.int64)
    found[p] = np.maximum(length[run] - (p - hp[run]), 0)
    return found[order]


def repeats(codes: np.ndarray, off: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(covered, longest, counts) by the maximal repeats of each document.

    A maximal repeat is an interval of common prefixes of at least `least` words whose suffixes don't all follow the
    same word: neither end can be extended without losing an occurrence. covered: whether each word is in one, longest:
    the words of each document's longest (0 if none), counts: how many different ones each document has. The spans'
    union needs, of each suffix, only the innermost interval: it is the longest that begins there, and if it isn't
    maximal, the suffix before it has a longer one that ends at the same word.
    """
    n = len(codes)
    counts = np.diff(off)
    owner = np.repeat(np.arange(len(counts)), counts)
    ends = np.repeat(off[1:], counts)
    at = repeated_grams(codes, owner, ends, least)
    covered, longest, found = np.zeros(n, bool), np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    if not len(at):
        return covered, longest, found
    order = suffix_order(codes, ends, at, owner, least)
    lcp = common_prefixes(codes, ends, order, owner, at)
    first, last, words = lcp_intervals(lcp.tolist(), least)
    if not len(first):
        return covered, longest, found
    # what stands before each suffix; a document's start is like nothing else
    before = np.where(order > off[owner[order]], codes[np.maximum(order - 1, 0)].astype(np.int64), -1 - order)
    changes = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    maximal = changes[last] > changes[first]
    first, last, words = first[maximal], last[maximal], words[maximal]
    docs = owner[order[first]]
    np.maximum.at(longest, docs, words)
    np.add.at(found, docs, 1)
    # a suffix's innermost interval is as deep as what it shares with the nearer of its neighbours
    inner = np.maximum(lcp, np.append(lcp[1:], 0))
    hit = inner >= least
    covers = np.zeros(n + 1, np.int64)
    np.add.at(covers, order[hit], 1)
    np.add.at(covers, order[hit] + inner[hit], -1)
    return np.cumsum(covers[:-1]) > 0, longest, found


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(_WHITE)]
    return len(lines) - len(set(lines))


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "longest_repeat", "repeat_chars", "n_repeats")


def measured(text: pa.Array, max_covered: float, max_longest: int) -> tuple[np.ndarray, ...]:
    """The measures of NAMES for some texts (no nulls)."""
    data, bounds = text_bytes(text)
    word_chars = ranges_sum(_WORD_START[data], bounds)
    symbols = ranges_sum(_SYMBOL[data], bounds)
    words, codes, off = chunked(text)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    n = np.diff(off)
    covered, longest, n_repeats = repeats(codes, off)
    n_covered = sums(covered, off)
    covered_chars = sums(np.where(covered, lengths[codes], 0) if len(codes) else np.zeros(0, np.int64), off)
    lines = np.fromiter(map(duplicate_lines, text.to_pylist()), np.int64, len(text))
    failed = (n < MIN_WORDS) | (100 * n_covered > MAX_REPEAT_PERCENT * n)
    share = np.where(covered_chars > SHORT_CHARS, max_covered, max(max_covered, MAX_COVERED_SHORT))
    kept = ~failed & (covered_chars <= share * word_chars) & (longest <= max_longest)
    return n, word_chars, symbols, lines, n_covered, failed, kept, longest, covered_chars, n_repeats


def quality_rules(docs: DataFrame, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """One row for each of docs, without a shuffle: doc_id, the rules' measures, base_failed and kept.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept (boolean), longest_repeat
    (words), repeat_chars, n_repeats (different maximal repeats). kept is false for base_failed, for repeats over
    max_covered of the characters (MAX_COVERED_SHORT up to SHORT_CHARS characters of repeats), and for a longest repeat
    of over max_longest words; both limits reach documents that the base rules pass. Texts are handled some MB at a time, a
    longer one by itself. A null or empty text has no words and fails the base rules. Ids may be null or repeated;
    an empty table gives no rows; other columns are ignored.
    """
    tune(docs.sparkSession)
    rows = docs.select("doc_id", docs["text"].cast("string").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 1):
            found = measured(texts(b.column(1)), max_covered, max_longest)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, found)], ["doc_id", *NAMES])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(measure, f"doc_id {kind}, " + ", ".join(f"{x} {'boolean' if x in ('base_failed', 'kept') else 'long'}" for x in NAMES))


def kept_documents(docs: DataFrame, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The rows of docs, all columns, that quality_rules keeps. docs needs a string column text.

    Null, empty and long texts, ties and repeated rows are as there: each row is judged by its own text. An empty table
    stays empty.
    """
    tune(docs.sparkSession)
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, place):
            kept = measured(texts(b.column(place)), max_covered, max_longest)[NAMES.index("kept")]
            yield b.filter(pa.array(kept))

    return docs.mapInArrow(keep, docs.schema)
