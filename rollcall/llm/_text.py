"""Vectorised helpers over Arrow text columns, used inside Spark tasks.

A text column arrives as one byte buffer with offsets, so words, lines and
windows of a whole batch are found with array operations, without one Python
object per word.  Words and lines are told apart by 64-bit names (``names``), runs of
words by names mixed one after the other (``shingles``).  ``Prefix`` is linear, so that it can name all windows of a
buffer: it serves to thin candidates and to hash features, never to decide equality.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_rng = np.random.default_rng(20240229)
_SYMBOL = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_FOLDED = _SYMBOL.copy()
_FOLDED[65:91] = _SYMBOL[97:123]
_BASE = int(_rng.integers(1, 2**62)) * 4 + 5
_BASE_INV = pow(_BASE, -1, 2**64)
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Kinds of bytes: words between white space; words of letters and digits; letters, digits and marks apart.
WORD = (~SPACE).astype(np.uint8)
PLAIN = np.zeros(256, np.uint8)
PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
TOKEN = WORD * np.uint8(3)
TOKEN[PLAIN == 1] = 1
TOKEN[48:58] = 2
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, PIECE + 65_536) if n <= PIECE + 65_536 else n
        for k, b in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, b, U)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    out = _POWERS[0][:n], _POWERS[1][:n]
    if n > 8 * PIECE:  # a giant text: don't keep its table
        _POWERS[:] = [np.ones(1, U), np.ones(1, U)]
    return out


def trimmed(run: Callable) -> Callable:
    """run, a function over Arrow batches, that gives free memory back to the machine at the end of its partition.

    Python workers live on for later stages, and what they hold counts against the executor.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # only the GNU library has it
            pass

    return wrapped


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and len + 1 offsets; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most limit bytes each, or one longer row."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


class Prefix:
    """Fingerprints of any byte ranges of one buffer, or of any ranges of 64-bit names, from one prefix sum."""

    def __init__(self, buf: np.ndarray, fold: bool = False):
        up, self._down = _powers(len(buf) + 1)
        self._sum = np.empty(len(buf) + 1, U)
        self._sum[0] = 0
        np.cumsum((buf if buf.dtype == U else (_FOLDED if fold else _SYMBOL)[buf]) * up[:-1], out=self._sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._down[start])


def find_words(buf: np.ndarray, off: np.ndarray, kind: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and each row's first word's number (len + 1).

    A word is a longest run of bytes of one kind other than 0.
    """
    of = kind[buf]
    edge = np.ones(len(buf) + 1, bool)
    edge[1:-1] = of[1:] != of[:-1]
    edge[off] = True
    inside = of != 0
    starts = np.flatnonzero(inside & edge[:-1])
    ends = np.flatnonzero(inside & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, off)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Ranges of more bytes are named one by one.
LONG = 256


def names(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit names of byte ranges, for words and lines.

    Eight bytes at a time are mixed in by a function that is one-to-one and not linear, so ranges of one length that
    differ in eight neighbouring bytes only never share a name, and no pattern of repeats cancels out.  Ranges of over
    LONG bytes are named by a cryptographic digest.
    """
    n = end - start
    eight = np.ndarray((len(buf) + 1,), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))
    mask = np.append(~(U(0xFFFFFFFFFFFFFFFF) << (np.arange(8, dtype=U) * U(8))), U(0xFFFFFFFFFFFFFFFF))
    out = mix((eight[start] & mask[np.minimum(n, 8)]) ^ mix(n.astype(U) + U(0x9E3779B97F4A7C15)))
    active, at = np.flatnonzero((n > 8) & (n <= LONG)), 8
    while len(active):
        part = eight[start[active] + at] & mask[np.minimum(n[active] - at, 8)]
        out[active] = mix(out[active] * U(0xD6E8FEB86659FD93) ^ part)
        at += 8
        active = active[n[active] > at]
    for i in np.flatnonzero(n > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each item, from the first item of each row (len + 1)."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of each row's k-word shingles (the whole row as one, if shorter), and each row's first (len + 1)."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(first[:-1] - begin[:-1], count) + np.arange(begin[-1])
    step = U(0x9E3779B97F4A7C15)
    short = np.flatnonzero((n > 0) & (n < k))
    padded = np.concatenate([h, np.zeros(k, U)])
    out = mix(padded[at] + U(k))
    for d in range(1, k):
        out = mix(out * step + padded[at + d])
    for r in short:
        x = mix(h[first[r] : first[r] + 1] + U(n[r]))
        for v in h[first[r] + 1 : first[r + 1]]:
            x = mix(x * step + v)
        out[begin[r]] = x[0]
    return out, begin


def spread(length: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given lengths."""
    return np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)


def union_length(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n cells lie in a range [start, end)."""
    d = np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(d[:n]) > 0
