"""Vectorised numpy kernels over Arrow string columns.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``.  All separators are ASCII, so
the kernels work on UTF-8 bytes and never build Python strings.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

WS = np.zeros(256, bool)
WS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_CONTINUATION = (np.arange(256) & 0xC0) != 0x80


def _pow(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size > 1 << 22:  # one very long text: don't keep its tables
            return have
        _powers[name] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library keeps or frees memory by itself
    _trim = None


def release() -> None:
    """Give memory that is free back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch with at most ``max_bytes`` of ``column`` each (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype(np.int64))
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
        yield batch.slice(at, to - at)
        at = to
    release()


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, null as empty; offsets start at 0."""
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    if data is None or not len(arr) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that do not cross a text's border."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    borders = offsets[1:-1]
    before[borders[borders < n]] = False
    after[borders[borders > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash of bytes, for ``span_hash``."""
    out = np.zeros(len(data) + 1, np.uint64)
    if len(data):
        np.cumsum(_BYTE[data] * _pow("p", _P, len(data))[: len(data)], dtype=np.uint64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, the same wherever equal bytes stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    inverse = _pow("i", _PINV, len(prefix))
    h = (prefix[ends] - prefix[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def bytes_from(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on (zeros beyond the end), as one number each;
    place k is at k + 3, so three zeros stand before the first byte."""
    padded = np.concatenate([np.zeros(3, np.uint8), data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 4, "<u8", padded, strides=(1,))


MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def first_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first eight bytes of each span; zeros beyond its end."""
    return bytes_from(data)[starts + 3] & MASKS[np.minimum(ends - starts, 8)]


class Words:
    """Words of a slice: byte spans, 64-bit hashes, and each text's range of words."""

    def __init__(self, arr: pa.Array, lower: bool = False, hashes: bool = True):
        self.data, self.offsets = text_bytes(arr)
        if lower:
            self.data = LOWER[self.data]
        self.starts, self.ends = spans(~WS[self.data], self.offsets)
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        if hashes:
            self.prefix = prefix_hash(self.data)
            self.hash = span_hash(self.prefix, self.starts, self.ends)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each run of ``k`` words inside one text."""
        n = len(self.starts)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            h = h * np.uint64(0xD6E8FEB86659FD93) + self.hash[j : n - k + 1 + j]
        at = np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])
        return at, mix(h[at])


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of per-byte (or per-word) values over each text."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
