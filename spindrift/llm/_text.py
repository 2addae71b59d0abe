"""Words of whole Arrow string columns as 64-bit hashes, without a Python loop over words.

A word is a run of bytes other than space and 0x09 to 0x0D; A to Z count as a to z.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Another table of blanks: all of ASCII but letters and digits.
PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)
#: Texts are taken in pieces of about so many bytes; one text is never cut.
PIECE_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(29))
    x = x * U64(0xA0761D6478BD642F)
    return x ^ (x >> U64(32))


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, (1 << 19) + 1)
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.r_[U64(1), np.full(n - 1, _BASE, U64)])
            _inverses = np.cumprod(np.r_[U64(1), np.full(n - 1, pow(_BASE, -1, 1 << 64), U64)])


@dataclass
class Words:
    """data: the bytes; texts[i]:texts[i+1] are those of text i; starts, ends and hashes are of words;
    first[i]:first[i+1] are the words of text i."""

    data: np.ndarray
    texts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def owners(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins; null is empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    if len(column) == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def words(column: pa.Array, blank: np.ndarray = _BLANK) -> Words:
    """All words of a column of texts; ``blank`` marks the bytes that are part of no word."""
    data, texts = raw(column)
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, texts, none, none, np.zeros(0, U64), np.zeros(len(texts), np.int64))
    solid = ~blank[data]
    cut = texts[(texts > 0) & (texts < n)]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    before[cut] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[cut - 1] = False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    _grow(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, U64)
        np.cumsum((_LOWER[data].astype(U64) + U64(1)) * _powers[:n], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * _inverses[starts] + (ends - starts).astype(U64))
    return Words(data, texts, starts, ends, hashes, np.searchsorted(starts, texts))


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return None


def release() -> None:
    """Gives memory that arrays no longer need back to the system: workers live on from stage to stage, and what they
    keep is missing to the executor."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def pieces(batch: pa.RecordBatch, text: str = "text", size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each; memory is released behind the last."""
    if batch.num_rows == 0:
        return
    _, at = raw(batch.column(batch.schema.get_field_index(text)))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + size, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end
    release()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
