"""Vectorised work on the UTF-8 bytes of Arrow string columns."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_MIX = (U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB))
#: Odd multipliers of the two polynomial hashes modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: Bytes handled at a time, so that the temporary arrays stay small.
CHUNK = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


#: Called by `trim`: caches that drop what has not been used for a while.
IDLE: list[Callable[[], None]] = []


def trim() -> None:
    """Give freed memory back to the system: a Python worker lives on after its task."""
    for check in IDLE:
        check()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    h = (h ^ (h >> U64(30))) * _MIX[0]
    h = (h ^ (h >> U64(27))) * _MIX[1]
    return h ^ (h >> U64(31))


def string_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, concatenated, and the offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def doc_chunks(off: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes together; a longer row stands alone."""
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def lower(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters."""
    out = _LOWER[data]
    if len(data) > 1:
        second = data[1:]
        at = (data[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
        out[1:][at] += 32
    return out


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of true bytes; runs end where their row ends."""
    n = len(inside)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    cut = cut[inside[cut] & inside[cut - 1]]
    first[cut] = True
    last[cut - 1] = True
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of bytes that are no ASCII white space."""
    return runs(~_SPACE[data], off)


def letter_runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return runs(_LETTER[data], off)


def token_runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters, of digits, and of other signs, in order."""
    parts = [runs(m, off) for m in (_LETTER[data], _DIGIT[data], ~(_LETTER[data] | _DIGIT[data] | _SPACE[data]))]
    start = np.concatenate([p[0] for p in parts])
    end = np.concatenate([p[1] for p in parts])
    order = np.argsort(start, kind="stable")
    return start[order], end[order]


class Poly:
    """Polynomial hashes of any span, from prefix sums modulo 2**64."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self._power = self._back = np.ones(1, U64)

    def _upto(self, n: int) -> None:
        if len(self._power) <= n:
            size = max(n + 1, CHUNK + 64)
            for name, b in (("_power", self.base), ("_back", self.inverse)):
                p = np.full(size, b, U64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=U64))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """values: bytes or 64-bit numbers."""
        n = len(values)
        self._upto(n)
        out = np.zeros(n + 1, U64)
        v = values.astype(U64)
        v += U64(1)
        v *= self._power[:n]
        np.cumsum(v, out=out[1:])
        return out

    def span(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self._back[start]


POLY = (Poly(BASES[0]), Poly(BASES[1]))


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All positions start[i] .. start[i] + length[i] - 1, one after the other."""
    total = int(length.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(total)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; `expand` needs their types and lengths."""
    raw = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def expand(blob: bytes) -> bytes:
    size = int.from_bytes(blob[:8], "little")
    return pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
