"""DartMinHash: weighted min-wise signatures by throwing hashed darts, for many documents at a time."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from tidewright.llm.words import chunked, mix, ragged

#: Darts expected over those that fill each of t coordinates once on average: t * (ln t + MORE).
MORE = 4.0

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
#: Upper bounds of a Poisson(1) count's distribution, in 64ths of the hash's range: counts beyond 18 never occur.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def all_shingles(array: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles in the order of the text, offsets of the texts among them).

    A text of fewer words has one shingle of them all; one without words has none.
    """
    words, codes, off = chunked(array)
    n = np.diff(off)
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(ends[-1], np.uint64)
    if not len(out):
        return out, ends
    h = word_hashes(words)[codes]
    with np.errstate(over="ignore"):
        if len(h) >= size:
            m = len(h) - size + 1
            s = np.zeros(m, np.uint64)
            for k in range(size):
                s = s * _C[0] + h[k : k + m] + _C[1]
            long = n >= size
            out[ragged(ends[:-1][long], counts[long])] = mix(s[ragged(off[:-1][long], counts[long])] ^ np.uint64(size))
        for few in range(1, size):
            short = np.flatnonzero(n == few)
            s = np.zeros(len(short), np.uint64)
            for k in range(few):
                s = s * _C[0] + h[off[short] + k] + _C[1]
            out[ends[short]] = mix(s ^ np.uint64(few))
    return out, ends


def shingles(array: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingle hashes, their counts, offsets of the texts among them); hashes ascend within each text."""
    s, off = all_shingles(array, size)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(s)))
    return s[first], times, np.searchsorted(doc[first], np.arange(len(off)))


def signatures(elements: np.ndarray, weights: np.ndarray, off: np.ndarray, t: int) -> np.ndarray:
    """Signatures of t coordinates for weighted sets; a row of zeros for an empty one.

    Over each element stands its region, its weight wide and, at first, high enough that about t * (ln t + MORE)
    darts of a process of density 1 fall into a document's regions. Darts come from hashes of the element and of the
    unit cell they lie in, so that equal parts of two documents hold equal darts. Each dart goes to one coordinate,
    which keeps the earliest; a document with an empty coordinate gets regions twice as high. Two coordinates are
    equal with the probability of the weighted resemblance.
    """
    n = len(off) - 1
    out = np.zeros((n, t), np.uint64)
    total = np.diff(np.concatenate([[0.0], np.cumsum(weights, dtype=np.float64)])[off])
    todo = np.flatnonzero(total > 0)
    height = np.zeros(n)
    height[todo] = t * (math.log(t) + MORE) / total[todo]
    while len(todo):
        filled = _thrown(elements, weights, off, todo, height[todo], t, out)
        todo = todo[~filled]
        height[todo] *= 2
    return out


def _thrown(elements, weights, off, docs, height, t, out) -> np.ndarray:
    """Fills out's rows for docs; which of them are complete."""
    counts = off[docs + 1] - off[docs]
    at = ragged(off[docs], counts)
    owner = np.repeat(np.arange(len(docs)), counts)
    # unit cells: one a started unit of weight and of height
    wide = np.ceil(weights[at]).astype(np.int64)
    cells = wide * np.ceil(height).astype(np.int64)[owner]
    which = np.repeat(np.arange(len(at)), cells)
    no = np.arange(len(which)) - np.repeat(np.cumsum(cells) - cells, cells)
    column, row = no % wide[which], no // wide[which]
    with np.errstate(over="ignore"):
        cell = mix(elements[at][which] ^ (column.astype(np.uint64) * _C[2]) ^ (row.astype(np.uint64) * _C[3]))
        darts = np.searchsorted(_POISSON, (mix(cell + _C[1]) >> np.uint64(11)).astype(np.float64) / 2.0**53, side="right")
        c = np.repeat(np.arange(len(cell)), darts)
        k = np.arange(len(c)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mix(cell[c] + (k.astype(np.uint64) + np.uint64(1)) * _C[0])
        when = row[c] + (dart >> np.uint64(11)).astype(np.float64) / 2.0**53
        where = column[c] + (mix(dart ^ _C[2]) >> np.uint64(11)).astype(np.float64) / 2.0**53
        hit = (when < height[owner[which[c]]]) & (where < weights[at][which[c]])
        dart, when = dart[hit], when[hit]
        slot = owner[which[c[hit]]] * t + (mix(dart ^ _C[3]) % np.uint64(t)).astype(np.int64)
    best = np.full(len(docs) * t, np.inf)
    np.minimum.at(best, slot, when)
    won = when == best[slot]
    found = np.zeros(len(docs) * t, np.uint64)
    found[slot[won]] = dart[won] | np.uint64(1)
    filled = np.isfinite(best).reshape(len(docs), t).all(1)
    out[docs[filled]] = found.reshape(len(docs), t)[filled]
    return filled


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    with np.errstate(over="ignore"):
        s = sig[:, : bands * rows].reshape(len(sig), bands, rows)
        h = np.broadcast_to(np.arange(bands, dtype=np.uint64) + _C[2], s.shape[:2])
        for k in range(rows):
            h = mix(h * _C[1] + s[:, :, k])
    return h.astype(np.int64)
