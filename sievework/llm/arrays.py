"""Whole texts as flat NumPy arrays, read straight from Arrow buffers.

A batch of texts becomes one byte array with document offsets; words, their
64-bit hashes and their shingles are computed for all texts of a block at once,
so no Python string is made for a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Keeps the first k of eight bytes.
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
#: Longer spans are hashed in pieces of so many bytes.
_PIECE = 64

#: Bytes of text that are worked on at once.
BLOCK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (each input bit reaches each output bit)."""
    x = x.astype(np.uint64, copy=True)
    spare = x >> np.uint64(30)
    x ^= spare
    x *= _MIX1
    np.right_shift(x, np.uint64(27), out=spare)
    x ^= spare
    x *= _MIX2
    np.right_shift(x, np.uint64(31), out=spare)
    x ^= spare
    return x


def by_group(group: np.ndarray, value: np.ndarray, groups: int) -> np.ndarray:
    """The order by group (ascending already) and value; values that share their upper 44 bits may stand in any order where groups are few enough to sort by one number."""
    if groups >= 1 << 20:
        return np.lexsort((value, group))
    return np.argsort((group.astype(np.uint64) << np.uint64(44)) | (value >> np.uint64(20)))


def among(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of x are in a sorted array."""
    if not len(some):
        return np.zeros(len(x), bool)
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x


def trim() -> None:
    """Gives free memory back to the system, so that idle Python workers hold little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


@dataclass
class Block:
    """Some consecutive rows: row indices first .. first+len(offsets)-1 of the batch."""

    first: int
    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # of each text, one more than texts
    null: np.ndarray  # texts that were null (their length is 0)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lowered(self) -> Block:
        """A-Z lower-cased; other characters stay."""
        upper = (self.data - np.uint8(ord("A"))) < 26
        return Block(self.first, self.data + (upper.view(np.uint8) << np.uint8(5)), self.offsets, self.null)


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # index of the text in its block
    bounds: np.ndarray  # words of text i: bounds[i] .. bounds[i+1]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts a string column into blocks of about ``limit`` bytes; one long text is a block of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_binary())
    null = np.asarray(column.is_null())
    _, offsets, data = column.buffers()
    kind = np.int32 if pa.types.is_string(column.type) else np.int64
    offsets = np.frombuffer(offsets, kind, n + 1 + column.offset)[column.offset :].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n)
        yield Block(at, whole[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], null[at:to])
        at = to


def words(block: Block, inside: np.ndarray | None = None) -> Words:
    """Maximal runs of bytes that are not white space, or of those for which ``inside`` holds, within each text."""
    if not len(block.data):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(len(block) + 1, np.int64))
    if inside is None:
        inside = (block.data != 0x20) & ((block.data - np.uint8(9)) > 4)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    firsts = block.offsets[:-1][np.diff(block.offsets) > 0]
    begins[firsts] = inside[firsts]
    ends[firsts[1:] - 1] = inside[firsts[1:] - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    bounds = np.searchsorted(start, block.offsets)
    return Words(start, end, np.repeat(np.arange(len(block)), np.diff(bounds)), bounds)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal spans have equal hashes, whatever block they are in."""
    size = end - start
    if not len(size):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, np.dtype("<u8"), padded, strides=(1,))  # eight bytes from every place on
    out = mix(size.astype(np.uint64) * _ODD + (eight[start] & _KEEP[np.minimum(size, 8)]))
    short = size <= _PIECE
    more = np.flatnonzero(short & (size > 8))
    done = 8
    while len(more):
        out[more] = mix(out[more] * _ODD + (eight[start[more] + done] & _KEEP[np.minimum(size[more] - done, 8)]))
        done += 8
        more = more[size[more] > done]
    long = np.flatnonzero(~short)
    if len(long):
        pieces = -(-size[long] // _PIECE)
        to = np.cumsum(pieces)
        number = np.arange(to[-1]) - np.repeat(to - pieces, pieces)
        begin = np.repeat(start[long], pieces) + number * _PIECE
        h = span_hashes(data, begin, np.minimum(begin + _PIECE, np.repeat(end[long], pieces)))
        out[long] = mix(np.add.reduceat(mix(h + (number.astype(np.uint64) + np.uint64(1)) * _MIX1), to - pieces) + size[long].astype(np.uint64) * _MIX2)
    return out


def runs(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words and bounds by text; a text of 1 to n-1 words has its whole sequence as one."""
    count = np.diff(bounds)
    many = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    to = np.concatenate([[0], np.cumsum(many)])
    at = np.arange(to[-1]) - np.repeat(to[:-1] - bounds[:-1], many)
    length = np.repeat(np.minimum(count, n), many)
    out = length.astype(np.uint64) * _ODD
    for i in range(n):
        use = i < length
        out[use] = mix(out[use] * _ODD + hashes[(at + i)[use]])
    return out, to


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
