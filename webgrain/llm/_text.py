"""Tokenising whole Arrow columns with numpy, and 64-bit hashes of words.

Everything works on the UTF-8 bytes of an Arrow string column: a table of 256
flags says which bytes belong to words, so a batch is cut into words without a
Python loop over words. Hashes are 64 bits wide; two different words or
shingles share one with a chance of about n * n / 2**65 for n distinct ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; bounds the numpy work space of a task.
SLICE_BYTES = 1 << 20

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C55)
_MIX1 = U64(0xBF58476D1CE4E5B9)
_MIX2 = U64(0x94D049BB133111EB)


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Words are runs of anything but ASCII white space.
NOT_SPACE = ~byte_table((0x20, 0x20), (0x09, 0x0D))
#: Words are runs of ASCII letters, digits and bytes of non-ASCII characters.
ALNUM = byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class Words(NamedTuple):
    """Words of a slice: 64-bit hash, index of the text, first byte and end within the text."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> U64(30))) * _MIX1
    x = (x ^ (x >> U64(27))) * _MIX2
    return x ^ (x >> U64(31))


def join_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hash of its beginning and its next item."""
    return mix(left * _BASE + right)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts on end, and the offsets of each (a null text is empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not (pa.types.is_string(texts.type) or pa.types.is_binary(texts.type)):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) else b"")
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if at[0] == at[-1]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts on end, and the offsets of each (a null text is empty)."""
    data, at = text_bytes(texts)
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype="<u4"), starts[at]


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the flags are set in each text."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[at[1:]] - sums[at[:-1]]


def slices(
    batches: Iterator[pa.RecordBatch], text_col: str, most: int = SLICE_BYTES, rows: int = 1 << 20
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many bytes of text and rows, or one row."""
    for batch in batches:
        _, at = text_bytes(batch.column(text_col))
        row = 0
        while row < batch.num_rows:
            upto = max(row + 1, min(row + rows, int(np.searchsorted(at, at[row] + most, side="right")) - 1))
            yield batch.slice(row, upto - row)
            row = upto


def run_hashes(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of bytes that stand on end, each of a size above 0."""
    first = np.cumsum(size) - size
    power = np.full(int(size.max()), _BASE, dtype=U64)
    power[0] = 1
    own = data.astype(U64) + U64(1)
    own *= np.cumprod(power, dtype=U64)[np.arange(own.size) - np.repeat(first, size)]
    return mix(np.add.reduceat(own, first) + size.astype(U64) * _MIX2)


def words(texts: pa.Array, table: np.ndarray, lower: bool) -> Words:
    data, at = text_bytes(texts)
    inside = table[data]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, U64), none, none, none)
    firsts = at[:-1][at[:-1] < at[1:]]
    lasts = at[1:][at[:-1] < at[1:]] - 1
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[firsts] = inside[firsts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[lasts] = inside[lasts]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    size = end - start
    doc = np.searchsorted(at, start, side="right") - 1
    hashed = run_hashes((_LOWER[data] if lower else data)[inside], size)
    return Words(hashed, doc, start - at[doc], end - at[doc])


def windows(hashed: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of width words inside one text, and the index of each run's first word."""
    n = hashed.size - width + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = hashed[:n]
    for k in range(1, width):
        out = join_hash(out, hashed[k : n + k])
    first = np.flatnonzero(doc[:n] == doc[width - 1 :])
    return out[first], first


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
