"""Words and hashes of whole Arrow text columns, computed with numpy over the UTF-8 bytes.

A column is worked through in slices of bounded bytes (`text_slices`); only a single text beyond the bound makes a
larger slice. Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

#: White space of the word rule `[^\x20\x09-\x0D]+`.
SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])

_U = np.uint64
_GOLDEN = 0x9E3779B97F4A7C15
_BASE = 0xA0761D6478BD6423  # odd and 3 modulo 8, so differences of its powers have few factors of two


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit values."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


with np.errstate(over="ignore"):
    _BYTE_VALUES = mix64((np.arange(256, dtype=_U) + _U(1)) * _U(_GOLDEN))
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, size: int) -> np.ndarray:
    """base**0 .. base**size modulo 2**64, kept up to the size of a slice."""
    have = _powers.get(base)
    if have is not None and len(have) > size:
        return have
    table = np.full(max(size, SLICE_BYTES) + 1, base, dtype=_U)
    table[0] = 1
    np.multiply.accumulate(table, out=table)
    if size <= 2 * SLICE_BYTES:
        _powers[base] = table
    return table


def byte_class(members: bytes) -> np.ndarray:
    """A table over all bytes that is true for the members."""
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


#: Words `[^\x20\x09-\x0D]+`.
NOT_SPACE = ~byte_class(SPACE_BYTES)


@dataclass
class Texts:
    """UTF-8 bytes of the texts of a slice; text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Number of set flags (one for each byte) in each text."""
        return np.diff(np.searchsorted(np.flatnonzero(flags), self.offsets))


def texts(column: pa.Array | pa.ChunkedArray) -> Texts:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or column.buffers()[2] is None:
        return Texts(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return Texts(data, offsets - offsets[0])


@dataclass
class Words:
    """Words of a slice in text order: bytes [start, end) of the slice's data; text i has words first[i]:first[i + 1]."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(t: Texts, is_word: np.ndarray = NOT_SPACE) -> Words:
    """Longest runs of word bytes; a run ends with its text."""
    inside = is_word[t.data]
    filled = t.offsets[:-1][np.diff(t.offsets) > 0]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[filled] = False
    start = np.flatnonzero(inside & ~before)
    after = before  # the same memory
    after[:-1] = inside[1:]
    if len(filled):
        after[filled[1:] - 1] = False
        after[-1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(start, t.offsets))


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the values in each [start, end), the same in every process and at every place."""
    if not len(start):
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        sums = np.empty(len(values) + 1, _U)
        sums[0] = 0
        np.cumsum(values * _power_table(_BASE, len(values))[: len(values)], out=sums[1:])
        h = (sums[end] - sums[start]) * _power_table(_INVERSE, len(values))[start]
        return mix64(h + (end - start).astype(_U) * _U(_GOLDEN))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes in each [start, end)."""
    return range_hashes(_BYTE_VALUES[data], start, end)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive values; shorter by n - 1."""
    size = max(0, len(hashes) - n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(size, _U)
        factor = 1
        for k in range(n):
            factor = factor * _GOLDEN % (1 << 64)
            total += (hashes[k : k + size] ^ _U(factor)) * _U(factor | 1)
        return mix64(total)


#: What modules keep from task to task and may let go; each decides for itself whether its time has come.
releases: list[Callable[[], None]] = []


def give_back() -> None:
    """Return freed memory to the system: workers are reused, and what one task frees another process may need."""
    for release in releases:
        release()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches unchanged; what is free goes back before the first and after the last."""
    give_back()
    yield from batches
    give_back()


def text_slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, cut into batches of at most limit text bytes (or one row)."""
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = texts(batch.column(batch.schema.get_field_index(column))).offsets
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            upto = min(max(upto, at + 1), batch.num_rows)
            yield batch.slice(at, upto - at)
            at = upto
    give_back()


def covered(length: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Flags of the positions below length inside any [start, end)."""
    steps = np.zeros(length + 1, np.int32)
    np.add.at(steps, start, 1)
    np.add.at(steps, end, -1)
    return np.cumsum(steps[:length]) > 0
