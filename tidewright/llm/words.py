"""Words and white-space chunks of Arrow text columns, in vector form.

A word is a run of characters other than the space and U+0009 to U+000D, which is also what Arrow's
ascii_split_whitespace leaves between its cuts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def chunked(array: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, code of each word of all texts in order, int64 offsets of the texts among the codes).

    array: strings without nulls. Texts without a word have an empty range.
    """
    lists = pc.ascii_split_whitespace(array)
    flat = lists.flatten()
    coded = flat.dictionary_encode()
    words = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    off = lists.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    if "" in words:
        gone = codes == words.index("")
        keep = ~gone
        off = np.concatenate([[0], np.cumsum(keep)])[off]
        codes = codes[keep]
    return words, codes, off


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values over the ranges that off bounds; empty ranges give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every range in turn."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts.astype(np.int64) - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit changes about half of the output bits."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def lcp_intervals(lcp: list[int], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, shared) of the intervals of an order of suffixes that share `least` symbols or more, inner ones first.

    lcp[k]: what suffix k shares with the one before it. A stack holds the open intervals, each within the one below;
    an interval is closed where less is shared.
    """
    first, last, length = [], [], []
    stack: list[tuple[int, int]] = []  # (shared, first)
    for k, shared in enumerate([*lcp[1:], 0], 1):
        begin = k - 1
        while stack and stack[-1][0] > shared:
            n, begin = stack.pop()
            first.append(begin)
            last.append(k - 1)
            length.append(n)
        if shared >= least and (not stack or stack[-1][0] < shared):
            stack.append((shared, begin))
    return tuple(np.array(x, np.int64) for x in (first, last, length))
