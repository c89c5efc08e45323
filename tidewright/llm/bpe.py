"""Byte-pair tokens of whole texts, exactly as the tokenizers library gives them, at the speed of table lookups.

Pre-tokens never span white space, so a text's ids are those of its white-space chunks in turn. A chunk that was
met before costs one lookup. A new chunk is cut into pre-tokens. A pre-token among the vocabulary strings that
provably encode alone as one token is taken as that id; what remains is merged, many pre-tokens at a time. Chunks
with characters beyond the alphabet checked here, or with what may be a special token, go to the library.

The proof is made once, on the driver, and stored in the shared folder under the digest of the tokenizer's file
(proof()); tasks read it. A file whose rules aren't those spelled out here is refused.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession

from tidewright.llm.common import filesystem, shared_base, text_bytes
from tidewright.llm.words import chunked, ragged, sums

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks and pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 200_000
#: Text bytes that are encoded at a time.
BLOCK = 2 << 20
#: Pre-tokens of more bytes are merged by the library.
LONG = 48
#: Stands right of a pre-token's last symbol; no merge has it.
NO_SYMBOL = 1 << 19
# The contractions and classes of the vocabulary's pre-tokenizer, spelled out for the alphabet below.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
LETTERS = "a-zA-Zªµºß-öø-ſÀ-ÖØ-Þ"
NUMBERS = "0-9²³¹¼½¾"
ALPHABET = re.compile("[!-~¡-¬®-įĲ-ňŊ-ž‘’“”–—…\n]*")
PRETOKEN = re.compile(f"\n|'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+")

_loaded: dict[str, WordPieces] = {}


def load(path: str, proof_at: str | None = None) -> WordPieces:
    """The tokenizer of a file, once a process; proof_at: where proof() has stored its proof, else it is made anew."""
    if path not in _loaded:
        _loaded[path] = WordPieces(path, proof_at)
    return _loaded[path]


def proof(spark: SparkSession, path: str) -> str:
    """The URI of the stored proof for a tokenizer's file: its whole-token strings and their ids as JSON.

    Made at the first call for a file and shared folder, by giving the library every candidate string by itself.
    """
    with open(path, "rb") as f:
        digest = hashlib.sha256(f.read()).hexdigest()
    base = shared_base(spark)
    at = f"{base}/whole-tokens-{digest}.json"
    fs, place = filesystem(at)
    if fs.get_file_info(place).type == pafs.FileType.NotFound:
        text = json.dumps(WordPieces(path).whole, ensure_ascii=False).encode()
        part = f"{place}.{uuid.uuid4().hex}"
        fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(part, compression=None) as f:
            f.write(text)
        fs.move(part, place)
    return at


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _stored(proof_at: str) -> dict[str, int]:
    fs, place = filesystem(proof_at)
    with fs.open_input_stream(place, compression=None) as f:
        return json.loads(f.read())


class PairTable:
    """Ranks of symbol pairs, looked up many at a time in a table with a few tries."""

    BITS = 18

    def __init__(self, left: np.ndarray, right: np.ndarray):
        pairs, ranks = self._key(left, right), np.arange(len(left), dtype=np.int32)
        self.tables = []
        for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
            at = self._slot(pairs, factor)
            keys, found = np.full(1 << self.BITS, np.uint64(2**64 - 1)), np.zeros(1 << self.BITS, np.int32)
            _, first = np.unique(at, return_index=True)
            keys[at[first]], found[at[first]] = pairs[first], ranks[first]
            self.tables.append((factor, keys, found))
            rest = np.setdiff1d(np.arange(len(pairs)), first)
            pairs, ranks = pairs[rest], ranks[rest]
            if not len(pairs):
                break
        if len(pairs):
            raise ValueError("merge table is too dense")

    def _key(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(20)) | right.astype(np.uint64)

    def _slot(self, pairs: np.ndarray, factor: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((pairs * np.uint64(factor)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray, none: int) -> np.ndarray:
        pairs = self._key(left, right)
        out = np.full(pairs.shape, none, np.int32)
        for factor, keys, found in self.tables:
            at = self._slot(pairs, factor)
            hit = keys[at] == pairs
            out[hit] = found[at[hit]]
        return out


class WordPieces:
    def __init__(self, path: str, proof_at: str | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        model = rules["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix")
        plain = ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")
        if model["type"] != "BPE" or not end or any(model.get(k) for k in plain) or rules["normalizer"] != NORMALIZER or rules["pre_tokenizer"] != PRE_TOKENIZER or rules["truncation"] or rules["padding"]:
            raise ValueError(f"{path}: the rules of this tokenizer aren't those that are known here")
        if not all(t["content"].startswith("<|") and not t["normalized"] for t in rules["added_tokens"]):
            raise ValueError(f"{path}: a special token doesn't begin with <|")
        self.letters = byte_letters()
        self.first = np.array([vocab[c] for c in self.letters], np.int64)
        self.last = np.array([vocab[c + end] for c in self.letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges]) for k in (0, 1))
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.pairs = PairTable(left, right)
        self.whole = self._proven(vocab, end) if proof_at is None else _stored(proof_at)
        self.forget()

    def over(self, rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a task; when they end, what was remembered for them is forgotten, so that idle workers stay small."""
        try:
            yield from rows
        finally:
            self.forget()

    def _proven(self, vocab: dict[str, int], end: str) -> dict[str, int]:
        """Vocabulary strings that the library, given them alone, encodes as that one token."""
        back = {c: b for b, c in enumerate(self.letters)}
        strings: dict[str, int] = {}
        for s, i in vocab.items():
            if s.endswith(end):
                try:
                    t = bytes(back[c] for c in s[: -len(end)]).decode()
                except (KeyError, UnicodeDecodeError):
                    continue
                if t == t.lower() and ALPHABET.fullmatch(t) and PRETOKEN.findall(t) == [t]:
                    strings[t] = i
        names = list(strings)
        alone = self.library.encode_batch(names, add_special_tokens=False)
        return {t: strings[t] for t, e in zip(names, alone, strict=True) if e.ids == [strings[t]]}

    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.starts, self.lengths = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(4096, np.uint32), 0

    def _learn(self, chunks: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, k = len(self.seen), len(chunks)
        while n + k > len(self.starts):
            self.starts, self.lengths = np.concatenate([self.starts, np.zeros_like(self.starts)]), np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.lengths[n : n + k] = lengths
        self.starts[n : n + k] = self.used + np.cumsum(lengths) - lengths
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.seen.update(zip(chunks, range(n, n + k), strict=True))

    def codes(self, chunks: list[str]) -> np.ndarray:
        """Index into starts and lengths for each chunk; new chunks are encoded first."""
        if len(self.seen) > REMEMBERED:
            self.forget()
        new = [c for c in chunks if c not in self.seen]
        if new:
            joined = "\n".join(new)
            odd: list[str] = []
            if "<|" in joined or not ALPHABET.fullmatch(joined):
                plain = []
                for c in new:
                    (odd if "<|" in c or not ALPHABET.fullmatch(c) else plain).append(c)
                new, joined = plain, "\n".join(plain)
            if new:
                self._learn(new, *self._encode(joined, len(new)))
            if odd:
                ids = [e.ids for e in self.library.encode_batch(odd, add_special_tokens=False)]
                self._learn(odd, np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64))
        return np.fromiter(map(self.seen.__getitem__, chunks), np.int64, len(chunks))

    def _encode(self, joined: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, token counts) of n chunks joined by line breaks."""
        pre = PRETOKEN.findall(joined.lower())
        names = list(dict.fromkeys(pre))
        number = dict(zip(names, range(len(names)), strict=True))
        at = np.fromiter(map(number.__getitem__, pre), np.int64, len(pre))
        starts, lengths, flat = self._merge(names)
        owner = np.cumsum(at == number.get("\n", -1))
        counts = lengths[at]
        return flat[ragged(starts[at], counts)], np.bincount(owner, weights=counts, minlength=n).astype(np.int64)

    def _merge(self, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, lengths, ids) of distinct pre-tokens: the whole ones by lookup, the rest by merging."""
        data, off = text_bytes(pa.array(names, pa.string()))
        begin, width = off[:-1], np.diff(off)
        whole = np.fromiter(map(self.whole.get, names, repeat(-1)), np.int64, len(names))
        lengths = np.ones(len(names), np.int64)
        rest, done = np.flatnonzero(whole < 0), []
        for n in np.unique(width[rest]).tolist():
            ks = rest[width[rest] == n]
            if n > LONG:
                for k in ks.tolist():
                    ids = [x.id for x in self.library.model.tokenize("".join(map(self.letters.__getitem__, names[k].encode())))]
                    lengths[k] = len(ids)
                    done.append((np.array([k]), np.array([ids], np.uint32), lengths[[k]]))
                continue
            rows = data[begin[ks][:, None] + np.arange(n)]
            s = self.first[rows]
            s[:, -1] = self.last[rows[:, -1]]
            ids, size = self._merge_rows(s)
            if n == 1:  # a line break stands between chunks and is no token
                size[rows[:, 0] == 10] = 0
            lengths[ks] = size
            done.append((ks, ids, size))
        starts = np.cumsum(lengths) - lengths
        flat = np.zeros(int(lengths.sum()), np.uint32)
        alone = whole >= 0
        flat[starts[alone]] = whole[alone]
        for ks, ids, size in done:
            cols = np.arange(ids.shape[1])
            used = cols < size[:, None]
            flat[(starts[ks][:, None] + cols)[used]] = ids[used]
        return starts, lengths, flat

    def _merge_rows(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges rows of as many symbols each: always the pair of least rank, leftmost first. (ids, their number by row)"""
        none = len(self.merged)
        n, width = s.shape
        done, size, alive = np.zeros((n, width), np.uint32), np.full(n, width, np.int64), np.arange(n)
        # one more column on the right, of pairs that never merge
        s = np.concatenate([s, np.full((n, 1), NO_SYMBOL)], 1).astype(np.int32)
        ranks = self.pairs.ranks(s[:, :-1], s[:, 1:], none)
        while len(s):
            row = np.arange(len(s))
            best = ranks.argmin(1)
            rank = ranks[row, best]
            stop = rank == none
            if stop.any():
                done[alive[stop], :width] = s[stop, :-1]
                size[alive[stop]] = width
                go = ~stop
                s, ranks, best, rank, alive = s[go], ranks[go], best[go], rank[go], alive[go]
                if not len(s):
                    break
                row = np.arange(len(s))
            kept = np.ones(s.shape, bool)
            kept[row, best + 1] = False
            s[row, best] = self.merged[rank]
            s = s[kept].reshape(len(s), width)
            ranks = ranks[kept[:, 1:]].reshape(len(s), width - 1)
            width -= 1
            ranks[row, best] = self.pairs.ranks(s[row, best], s[row, best + 1], none)
            left = row[best > 0]
            at = best[best > 0] - 1
            ranks[left, at] = self.pairs.ranks(s[left, at], s[left, at + 1], none)
        return done, size

    def counts(self, array: pa.Array) -> np.ndarray:
        """Tokens of each text; array: strings without nulls."""
        chunks, at, off = chunked(array)
        codes = self.codes(chunks)
        return sums(self.lengths[codes][at], off)

    def encode(self, array: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn as uint32, int64 offsets of the texts among them); end: an id to put after each text."""
        chunks, at, off = chunked(array)
        codes = self.codes(chunks)
        lengths = self.lengths[codes][at]
        total = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[ragged(self.starts[codes][at], lengths)]
        bounds = total[off]
        if end is not None:
            ids = np.insert(ids, bounds[1:], np.uint32(end))
            bounds = bounds + np.arange(len(bounds))
        return ids, bounds
