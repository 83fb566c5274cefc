"""Texts as one flat byte array: the numpy building blocks of the operators that run in Arrow
batches. A batch's UTF-8 bytes are taken from Arrow's own buffers, never as Python strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 2 << 20

# White space that separates words: space and U+0009 to U+000D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_MIX = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): row i is ``bytes[offsets[i]:offsets[i + 1]]``; NULL is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if len(col) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    o = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    if data is None or o[-1] == o[0]:
        return np.zeros(0, np.uint8), o - o[0]
    return np.frombuffer(data, dtype=np.uint8)[o[0]:o[-1]], o - o[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer text is a range of its own."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` bytes that do not cross rows: (starts, ends, first), where
    runs ``first[i]:first[i + 1]`` belong to row i."""
    if not len(inside):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cut = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words: runs without white space (space, U+0009 to U+000D)."""
    return spans(~_SPACE[buf], offsets)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, from one running sum over the whole array: the sum of
    mixed bytes times powers of an odd base, divided by the base's power at the start."""
    if not len(starts):
        return np.zeros(0, U64)
    n = len(buf)
    powers = np.full(n + 1, _BASE, U64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    run = np.zeros(n + 1, U64)
    np.cumsum(_BYTE_MIX[buf] * powers[:n], out=run[1:])
    inverse = np.full(n + 1, _BASE_INV, U64)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    h = (run[ends] - run[starts]) * inverse[starts]
    return mix64(h + (ends - starts).astype(U64))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(start, start + length)``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    s, ln = starts[keep].astype(np.int64), lengths[keep].astype(np.int64)
    at = np.cumsum(ln)[:-1]
    out[0] = s[0]
    out[at] = s[1:] - (s[:-1] + ln[:-1] - 1)
    return np.cumsum(out)
