"""Length-delimited records with masked CRC-32C checksums, the framing of TFRecord files, many records at a time."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

# Fixed values of the format: the reflected Castagnoli polynomial and the mask's constant.
POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8

#: Bytes that one lane of the vector computation holds.
LANE = 64


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


_T = _byte_table()
_pairs = np.arange(1 << 16, dtype=np.uint32)
for _ in range(2):
    _pairs = _T[_pairs & 0xFF] ^ (_pairs >> 8)
#: State after two more bytes, by the low half of state xor bytes.
_T2 = _pairs.astype(np.uint32)


def _zeros_operators(count: int = 40) -> list[np.ndarray]:
    """For each k, four tables of 256 that carry a state over LANE * 2**k zero bytes."""

    def tables(basis: np.ndarray) -> np.ndarray:
        out = np.zeros((4, 256), np.uint32)
        for byte in range(4):
            for bit in range(8):
                out[byte, np.arange(256) >> bit & 1 == 1] ^= basis[8 * byte + bit]
        return out

    basis = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(LANE):
        basis = _T[basis & 0xFF] ^ (basis >> 8)
    found = []
    for _ in range(count):
        found.append(tables(basis))
        basis = _carried(basis, found[-1])
    return found


def _carried(state: np.ndarray, op: np.ndarray) -> np.ndarray:
    return op[0][state & 0xFF] ^ op[1][state >> 8 & 0xFF] ^ op[2][state >> 16 & 0xFF] ^ op[3][state >> 24]


_OPS = _zeros_operators()


def crc32c(records: list[bytes]) -> np.ndarray:
    """CRC-32C of each record, as uint32."""
    sizes = np.array([len(r) for r in records], np.int64)
    out = np.zeros(len(records), np.uint32)
    small = np.flatnonzero(sizes < 4).tolist()
    for k in small:
        state = 0xFFFFFFFF
        for byte in records[k]:
            state = int(_T[(state ^ byte) & 0xFF]) ^ (state >> 8)
        out[k] = state ^ 0xFFFFFFFF
    rest = np.flatnonzero(sizes >= 4)
    if not len(rest):
        return out
    lanes = -(-sizes[rest] // LANE)
    ends = np.cumsum(lanes)
    padded = np.zeros(int(ends[-1]) * LANE, np.uint8)  # zeros stand before a record: they leave the state 0
    for k, end, n in zip(rest.tolist(), (ends * LANE).tolist(), sizes[rest].tolist(), strict=True):
        padded[end - n : end] = np.frombuffer(records[k], np.uint8)
        padded[end - n : end - n + 4] ^= 0xFF  # the start value of the checksum
    words = padded.view("<u2").reshape(-1, LANE // 2)
    state = np.zeros(len(words), np.uint32)
    for c in range(LANE // 2):
        state = _T2[(state ^ words[:, c]) & 0xFFFF] ^ (state >> 16)
    after = np.repeat(ends, lanes) - 1 - np.arange(len(words))
    k = 0
    while (after >> k).any():
        on = np.flatnonzero(after >> k & 1)
        state[on] = _carried(state[on], _OPS[k])
        k += 1
    out[rest] = np.bitwise_xor.reduceat(state, ends - lanes) ^ np.uint32(0xFFFFFFFF)
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


def frames(payloads: list[bytes]) -> list[bytes]:
    """Each payload between its length, the length's checksum and its own checksum."""
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    of_heads, of_payloads = masked(crc32c(heads)).tolist(), masked(crc32c(payloads)).tolist()
    return [h + struct.pack("<I", a) + p + struct.pack("<I", b) for h, a, p, b in zip(heads, of_heads, payloads, of_payloads, strict=True)]


class Damaged(ValueError):
    """A length or a payload doesn't match its checksum, or a file ends within a record."""


def unframed(stream, most: int = 4 << 20) -> Iterator[list[bytes]]:
    """Payloads of a stream with read(n), some MB at a time; every checksum is verified."""
    held: list[tuple[bytes, int, bytes, int]] = []
    size = 0

    def verified() -> list[bytes]:
        payloads = [p for _, _, p, _ in held]
        for parts, sums in (([h for h, _, _, _ in held], [a for _, a, _, _ in held]), (payloads, [b for _, _, _, b in held])):
            if (masked(crc32c(parts)) != np.array(sums, np.uint32)).any():
                raise Damaged("checksum")
        return payloads

    while head := stream.read(12):
        if len(head) < 12:
            raise Damaged("length")
        n, a = struct.unpack("<QI", head)
        if n > 1 << 20 and masked(crc32c([head[:8]]))[0] != a:
            raise Damaged("length")  # before so many bytes are asked for
        body = stream.read(n + 4)
        if len(body) < n + 4:
            raise Damaged("payload")
        held.append((head[:8], a, body[:n], struct.unpack("<I", body[n:])[0]))
        size += n
        if size >= most:
            yield verified()
            held, size = [], 0
    if held:
        yield verified()
