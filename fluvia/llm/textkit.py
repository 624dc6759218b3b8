"""Whole Arrow batches of UTF-8 text as flat NumPy arrays: words and hashes without a Python loop per word."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

#: Text bytes that are laid out at once; a longer text forms a piece of its own.
PIECE_BYTES = 1 << 18

U64 = np.uint64
_STEP = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1


def give_back_memory() -> None:
    """Return what Arrow's pool and the C heap hold free to the machine; workers live longer than their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library can
        return


_droppable: list[Callable[[], None]] = []


def dropped_by_others(clear: Callable[[], None]) -> None:
    """Have a cache that one operator keeps between its tasks cleared when the worker gets another's task."""
    if clear not in _droppable:
        _droppable.append(clear)


def tidy(run: Callable[[Iterator], Iterator], keeps: Callable[[], None] | None = None) -> Callable[[Iterator], Iterator]:
    """A function over a task's batches that leaves no free memory, and no other operator's caches, behind."""

    @wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        for clear in _droppable:
            if clear is not keeps:
                clear()
        try:
            yield from run(batches)
        finally:
            give_back_memory()

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed * 1_000_003)) * U64(_STEP))


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lower_ascii()
BYTE_CODE = stream(7, 256) | U64(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes outside [\x00-\x2F\x3A-\x60\x7B-\x7F].
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.empty(size, U64)
            out[0] = 1
            done, step = 1, base
            while done < size:  # doubling: out[done:2*done] = out[:done] * base**done
                take = min(done, size - done)
                out[done : done + take] = out[:take] * U64(pow(base, done, 1 << 64))
                done += take
            _powers[name] = out
    return _powers["up"][:n], _powers["down"][:n]


class Texts:
    """A run of texts: data holds their bytes, text i is data[offsets[i]:offsets[i+1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of every maximal run of bytes for which inside holds."""
        mask = inside[self.data]
        n = len(mask)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, none
        real = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = mask[:-1]
        before[real] = False
        starts = np.flatnonzero(mask & ~before)
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = mask[1:]
        after[real[1:] - 1] = False
        ends = np.flatnonzero(mask & ~after) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1

    def prefix_hash(self) -> np.ndarray:
        """h with h[j] - h[i] the base-shifted hash of data[i:j]."""
        up, _ = powers(len(self.data) + 1)
        h = np.zeros(len(self.data) + 1, U64)
        np.cumsum(BYTE_CODE[self.data] * up[: len(self.data)], out=h[1:])
        return h

    def hashes(self, starts: np.ndarray, ends: np.ndarray, h: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of the given byte ranges."""
        if not len(starts):
            return np.zeros(0, U64)
        h = self.prefix_hash() if h is None else h
        _, down = powers(len(self.data) + 1)
        return mix((h[ends] - h[starts]) * down[starts] + (ends - starts).astype(U64))


def pieces(column: pa.Array, table: np.ndarray | None = None, piece_bytes: int = PIECE_BYTES) -> Iterator[Texts]:
    """Cut a string column into runs of texts of about piece_bytes; null counts as empty; table maps bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + piece_bytes, "right")) - 1
        j = min(max(j, i + 1), n)
        part = data[offsets[i] : offsets[j]]
        yield Texts(part if table is None else table[part], offsets[i : j + 1] - offsets[i], i)
        i = j
