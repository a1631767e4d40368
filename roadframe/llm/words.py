"""Words of many texts at once, [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, and their 64-bit hashes (XXH3 without a seed)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INK = np.ones(256, bool)
_INK[[32, *range(9, 14)]] = False
_U = np.uint64
#: Parts of the secret of XXH3 that short inputs meet.
_SHORT, _EIGHT, _LOW, _HIGH = _U(0x87275A9B), _U(0xC73AB174C5ECD5A2), _U(0x6782737BEA4239B9), _U(0xAF56BC3B0996523A)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of the texts in them); a null text is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_places(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): bytes at which words start and end, and the first word of each text (and one more)."""
    ink = _INK[raw]
    here = offsets[:-1][offsets[:-1] < offsets[1:]]
    start, end = ink.copy(), ink.copy()
    start[1:] &= ~ink[:-1]
    start[here] = ink[here]
    end[:-1] &= ~ink[1:]
    last = here[1:] - 1
    end[last] = ink[last]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def _folded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Low and high half of the 128-bit products, XORed."""
    half, low = _U(32), _U(0xFFFFFFFF)
    al, ah, bl, bh = a & low, a >> half, b & low, b >> half
    ll, lh, hl = al * bl, al * bh, ah * bl
    cross = (ll >> half) + (hl & low) + lh
    return (a * b) ^ (ah * bh + (hl >> half) + (cross >> half))


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << _U(n)) | (x >> _U(64 - n))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """xxh3_64 of the lower-cased words."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    text = np.zeros(len(raw) + 16, np.uint8)
    np.take(_LOWER, raw, out=text[8:8 + len(raw)])
    eight = np.ndarray((len(text) - 7,), "<u8", text.data, 0, (1,))  # at every byte, 8 bytes further up
    n = ends - starts
    for lo, hi in ((1, 3), (4, 8), (9, 16)):
        at = np.flatnonzero((n >= lo) & (n <= hi))
        if not len(at):
            continue
        size = n[at].astype(np.uint64)
        first, last = eight[starts[at] + 8], eight[ends[at]]
        if hi == 3:
            middle = text[starts[at] + 8 + (n[at] >> 1)].astype(np.uint64)
            h = (((first & _U(255)) << _U(16)) | (middle << _U(24)) | (last >> _U(56)) | (size << _U(8))) ^ _SHORT
            h = (h ^ (h >> _U(33))) * _U(0xC2B2AE3D27D4EB4F)
            h = (h ^ (h >> _U(29))) * _U(0x165667B19E3779F9)
            h ^= h >> _U(32)
        elif hi == 8:
            h = ((last >> _U(32)) + (first << _U(32))) ^ _EIGHT
            h = (h ^ _rotated(h, 49) ^ _rotated(h, 24)) * _U(0x9FB21C651E98DF25)
            h = (h ^ ((h >> _U(35)) + size)) * _U(0x9FB21C651E98DF25)
            h ^= h >> _U(28)
        else:
            a, b = first ^ _LOW, last ^ _HIGH
            h = size + a.byteswap() + b + _folded(a, b)
            h = (h ^ (h >> _U(37))) * _U(0x165667919E3779F9)
            h ^= h >> _U(32)
        out[at] = h
    for k in np.flatnonzero(n > 16):
        out[k] = xxhash.xxh3_64_intdigest(text[starts[k] + 8:ends[k] + 8].tobytes())
    return out
