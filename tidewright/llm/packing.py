"""Hierarchical packing of documents into sequences of several lengths."""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidewright.llm.bpe import BLOCK, load, proof
from tidewright.llm.common import blocks, texts, tune

#: Context sizes, powers of two.
TIERS = (2048, 1024, 512, 256)
#: Ids of a step group, and groups that are dealt together.
STEP_TOKENS, OPEN_GROUPS = 32 * 2048, 8
#: A gap of fewer ids is closed by a cut at once, as hardly a whole document fits.
SMALL_GAP = 16
_SCHEMA = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Packer:
    """Packs the documents that one task sees; each add() gives back the sequences that are full.

    A document's whole windows of the largest tier are sequences of their own; what is left of it is routed to the
    least tier that holds it. Each tier is packed, longest first: a rest gets a window, its gap is filled by the
    longest rests of shorter tiers that fit, and the last bit by cutting one. A rest for which nothing is there to
    fill with waits for later documents. end() packs what waits into windows of the largest tier, of which the task's
    very last one is padded.

    Sequences of OPEN_GROUPS step groups are dealt together, the longest first and each to the group with the fewest
    ids, so that groups are alike and of all tiers; at the end of a task, the rest makes as many groups as it fills.
    """

    def __init__(self, prefix: int, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.prefix = tiers, prefix
        self.next, self.group, self.pieces = 0, 0, []
        self.waiting: list[tuple[int, list[tuple]]] = []  # (ids, pieces) of sequences without a step group
        self.waiting_ids = 0
        self.rests: list[tuple[int, int]] = []  # (ids, number), sorted
        self.of: dict[int, tuple] = {}  # number -> doc, start, ids, doc_tokens
        self.numbers = 0

    def _emit(self, parts: list[tuple]) -> None:
        total = sum(len(p[2]) for p in parts)
        tier = total if total in self.tiers else self.tiers[0]
        offset, found = 0, []
        for doc, start, ids, n in parts:
            found.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), n, self.prefix | self.next, offset, tier))
            offset += len(ids)
        self.next += 1
        self.waiting.append((total, found))
        self.waiting_ids += total
        if self.waiting_ids >= OPEN_GROUPS * STEP_TOKENS:
            self._deal(OPEN_GROUPS)

    def _deal(self, groups: int) -> None:
        """Deals the waiting sequences to so many new step groups."""
        open_ = [(0, self.group + k) for k in range(groups)]
        self.group += groups
        for total, found in sorted(self.waiting, key=lambda x: -x[0]):
            used, g = open_[0]
            heapq.heapreplace(open_, (used + total, g))
            self.pieces += [(*p, self.prefix | g) for p in found]
        self.waiting, self.waiting_ids = [], 0

    def _route(self, part: tuple) -> None:
        if len(part[2]):
            insort(self.rests, (len(part[2]), self.numbers))
            self.of[self.numbers] = part
            self.numbers += 1

    def _take(self, at: int) -> tuple:
        return self.of.pop(self.rests.pop(at)[1])

    def _filled(self, parts: list[tuple], gap: int, to: int) -> bool:
        """Fills a window's gap from rests of shorter tiers, or else of its own; False if there are too few ids."""
        while gap:
            at = bisect_right(self.rests, (gap, self.numbers)) - 1
            if at >= 0 and (gap > SMALL_GAP or self.rests[at][0] == gap):
                parts.append(self._take(at))
                gap -= len(parts[-1][2])
                continue
            longer = bisect_right(self.rests, (gap, self.numbers))
            if longer == len(self.rests):
                if at < 0:
                    return False
                parts.append(self._take(at))
                gap -= len(parts[-1][2])
                continue
            # cut the longest rest of the shorter tiers, so that the cut leaves as much as it can
            at = max(longer, bisect_right(self.rests, (to // 2, self.numbers)) - 1)
            doc, start, ids, n = self._take(at)
            parts.append((doc, start, ids[:gap], n))
            self._route((doc, start + gap, ids[gap:], n))
            gap = 0
        return True

    def add(self, documents: list[tuple]) -> list[tuple]:
        """documents: (doc_id, ids). Returns the pieces of the sequences that became full."""
        top = self.tiers[0]
        for doc, ids in documents:
            whole = len(ids) // top * top
            for k in range(0, whole, top):
                self._emit([(doc, k, ids[k : k + top], len(ids))])
            self._route((doc, whole, ids[whole:].copy(), len(ids)))
        for tier in self.tiers:
            below = tier // 2 if tier != self.tiers[-1] else 0
            waiting = []
            while self.rests:
                at = bisect_right(self.rests, (tier, self.numbers)) - 1
                if at < 0 or self.rests[at][0] <= below:
                    break
                parts = [self._take(at)]
                if not self._filled(parts, tier - len(parts[0][2]), tier):
                    waiting = parts
                    break
                self._emit(parts)
            for p in waiting:
                self._route(p)
            if waiting:
                break
        pieces, self.pieces = self.pieces, []
        return pieces

    def end(self) -> list[tuple]:
        top = self.tiers[0]
        while self.rests:
            parts = [self._take(len(self.rests) - 1)]
            room = top - len(parts[0][2])
            while room and self.rests:
                at = max(bisect_right(self.rests, (room, self.numbers)) - 1, 0)
                doc, start, ids, n = self._take(at)
                parts.append((doc, start, ids[:room], n))
                self._route((doc, start + room, ids[room:], n))
                room -= len(parts[-1][2])
            self._emit(parts)
        if self.waiting:
            self._deal(-(-self.waiting_ids // STEP_TOKENS))
        pieces, self.pieces = self.pieces, []
        return pieces


def packed(docs: DataFrame, tokenizer: str, end: int | None = 1, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Pieces of the sequences that all documents are packed into: one row a piece, without a shuffle.

    Every task packs its own partition, some MB of text at a time, so that memory is bounded by the tiers and the
    block, not by the partition; a longer text is encoded by itself and cut into windows. sequence_id and step_group
    carry the partition's number in their upper bits; tier is the sequence's length, one of `tiers`. Only a task's last
    sequence may hold fewer ids: it is of the largest tier, to which it is padded. Step groups hold about STEP_TOKENS
    ids each, of all tiers. A null or empty text is the id `end` alone, or without `end` has no piece. Ids may be null
    or repeated, each row is a document of its own; an empty table gives no rows. Other columns are ignored.
    """
    tune(docs.sparkSession)
    proven = proof(docs.sparkSession, tokenizer)
    rows = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, packer, of_id = load(tokenizer, proven), Packer(TaskContext.get().partitionId() << 33, tiers), pa.int64()

        def batch(found: list[tuple]) -> Iterator[pa.RecordBatch]:
            if found:
                types = (of_id, *[pa.int64()] * 6, pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"])

        for b in pieces.over(blocks(batches, 1, BLOCK)):
            of_id = b.column(0).type
            ids, off = pieces.encode(texts(b.column(1)), end)
            ids, bounds = ids.astype("<u4"), off.tolist()
            yield from batch(packer.add([(d, ids[i:j]) for d, i, j in zip(b.column(0).to_pylist(), bounds, bounds[1:], strict=False)]))
        yield from batch(packer.end())

    return rows.mapInArrow(pack, _SCHEMA.format(kind.simpleString()))
