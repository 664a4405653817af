"""Words and shingles of whole Arrow string columns as numpy arrays, without one Python string per word."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=U)
_A, _B, _C = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
#: Words of the white-space kind: everything but blank and \t..\r.
WS = np.ones(256, bool)
WS[[32, *range(9, 14)]] = False
#: Words of digits, a-z and non-ASCII (after lower-casing).
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Words of a-z and non-ASCII.
ALPHA = ALNUM.copy()
ALPHA[0x30:0x3A] = False


def give_back() -> None:
    """Returns freed memory to the system: a Python worker waits for its next task no larger than it began."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(f: Callable) -> Callable:
    """``f``, a generator over a task's batches, that gives memory back at its end."""

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= _B
    x ^= x >> U(27)
    x *= _C
    x ^= x >> U(31)
    return x


@dataclass
class Words:
    """Words of a run of rows: ``h`` 64-bit hashes, ``first[i]:first[i+1]`` the words of row i; starts and lengths are in ``buf``."""

    h: np.ndarray
    first: np.ndarray
    start: np.ndarray
    length: np.ndarray
    buf: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def runs(column: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of at most about ``most`` bytes of text (one row at least)."""
    offsets = _offsets(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(end, len(column))
        at = min(end, len(column))


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)


def text_bytes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The rows' UTF-8 bytes behind one another (eight zeros follow) and where each row starts; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    off = _offsets(column)
    data = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    buf = np.zeros(len(data) + 8, np.uint8)
    buf[:-8] = _lower[data] if lower else data
    return buf, off - off[0]


def words(column: pa.Array, kind: np.ndarray, lower: bool = True) -> Words:
    """Words of ``kind`` (a table of 256 booleans) of the rows, A-Z lower-cased unless told otherwise."""
    buf, off = text_bytes(column, lower)
    n = len(buf) - 8
    first = np.zeros(len(off), np.int64)
    if not n:
        return Words(np.zeros(0, U), first, np.zeros(0, np.int64), np.zeros(0, np.int64), buf)
    inside = kind[buf[:n]]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = off[:-1][off[:-1] < n]
    begin[edge] = inside[edge]
    last = off[1:][off[1:] > 0] - 1
    end[last] = inside[last]
    start = np.flatnonzero(begin)
    length = np.flatnonzero(end) + 1 - start
    return Words(hashes(buf, start, length), np.searchsorted(start, off), start, length, buf)


def hashes(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes a step; ``buf`` has eight spare bytes at its end."""
    at8 = np.ndarray(shape=(len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    h = mix(length.astype(U) + _A)
    todo, at, rest = np.arange(len(start)), start, length
    while len(todo):
        v = at8[at] & _MASK[np.minimum(rest, 8)]
        h[todo] = mix((h[todo] ^ v) * _A + _C)
        more = rest > 8
        todo, at, rest = todo[more], at[more] + 8, rest[more] - 8
    return h


def grams(h: np.ndarray, first: np.ndarray, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n words from each place on, in order, and each row's first; with ``short``, a row of fewer words gives one hash of all."""
    count = np.diff(first)
    full = np.maximum(count - n + 1, 0)
    place = np.arange(len(h)) - np.repeat(first[:-1], count) if len(h) else np.zeros(0, np.int64)
    keep = np.flatnonzero(place < np.repeat(full, count))
    g = np.full(len(keep), n, U) * _C
    for k in range(n):
        g = mix((g ^ h[keep + k]) * _A + U(k + 1))
    if not short:
        return g, np.concatenate([[0], np.cumsum(full)])
    few = np.flatnonzero((count > 0) & (count < n))
    own = count[few].astype(U) * _C
    for k in range(n - 1):
        on = np.flatnonzero(count[few] > k)
        own[on] = mix((own[on] ^ h[first[few[on]] + k]) * _A + U(k + 1))
    many = full.copy()
    many[few] = 1
    at = np.concatenate([[0], np.cumsum(many)])
    out = np.empty(at[-1], U)
    out[at[few]] = own
    rest = np.ones(at[-1], bool)
    rest[at[few]] = False
    out[rest] = g
    return out, at


def sets(g: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes, ascending, and each row's first."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    return g[keep], np.searchsorted(row[keep], np.arange(len(first)))


def among(values: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Which values are in ``few`` (ascending); a table of top bits spares most of the searches."""
    out = np.zeros(len(values), bool)
    if len(few):
        top = np.zeros(1 << 20, bool)
        top[few >> U(44)] = True
        at = np.flatnonzero(top[values >> U(44)])
        found = np.minimum(np.searchsorted(few, values[at]), len(few) - 1)
        out[at] = few[found] == values[at]
    return out
