"""Vectorised word and shingle hashes over Arrow batches of text.

A batch is handled in slices of a few megabytes, so memory does not depend on
the batch; one text is never cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that are part of words: all but ASCII blanks, and letters or digits or non-ASCII.
NON_BLANK = np.ones(256, bool)
NON_BLANK[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

SLICE_BYTES = 1 << 20
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 65536), base, np.uint64)
        steps[0] = 1
        have = _powers[kind] = np.multiply.accumulate(steps)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes, a blank after each, and n + 1 offsets. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    joined = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    _, offsets, data = joined.buffers()
    at = np.frombuffer(offsets, np.int64)[joined.offset : joined.offset + len(joined) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if len(joined) else np.empty(0, np.uint8)
    return raw, at - at[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """(low, high) row ranges of about ``limit`` bytes, one row at least."""
    n = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64) + 1
    end, low = np.cumsum(n), 0
    while low < len(n):
        base = end[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(end, base + limit, "right")))
        yield low, high
        low = high


def words(texts: pa.Array, keep: np.ndarray, lower: bool = True):
    """(hash, start byte, end byte, first word of each text) of the maximal runs of ``keep`` bytes.

    Bytes count from the start of the slice; ``first`` has n + 1 entries.
    """
    raw, at = text_bytes(texts)
    if lower:
        raw = LOWER[raw]
    mask = keep[raw]
    edge = np.flatnonzero(np.diff(mask, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    up, down = _power("up", _BASE, len(raw)), _power("down", _BASE_INV, len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, starts, ends, np.searchsorted(starts, at)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words within a text, and the index of each one's first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += hashes[j : j + n] * _MULT[j]
    room = np.repeat(first[1:], np.diff(first))[:n] - np.arange(n) >= k
    at = np.flatnonzero(room)
    return mix(total[at]), at


def whole(hashes: np.ndarray, low: int, high: int) -> np.uint64:
    """One hash of the word sequence ``low:high`` that depends on its length."""
    h = np.uint64(high - low)
    with np.errstate(over="ignore"):
        for x in hashes[low:high]:
            h = h * np.uint64(_BASE) + x
    return mix(np.array([h], np.uint64))[0]
