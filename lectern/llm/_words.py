"""Words and word windows of a batch of texts, as NumPy arrays over the UTF-8 bytes.

A batch is laid end to end in one byte array; words, their hashes and window hashes come from whole-array
operations, so no Python object is made per word. Hashes are 64-bit; whoever needs certainty compares the words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Byte is part of a word: ASCII letters and digits, and all of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Byte is part of a word: all but ASCII white space.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """Bit mixing, so that all bits of a hash can be used."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte runs `data[start:end]`, from one running sum over the bytes."""
    n = len(data)
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(n, base, dtype=np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    value = data.astype(np.uint64)
    value += np.uint64(1)
    value *= _powers[0][:n]
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(value, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers[1][starts] + (ends - starts).astype(np.uint64) * _STEP)


@dataclass
class Words:
    """Words of some texts. `bounds[i]:bounds[i + 1]` are the words of text i."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Start words and hashes of all windows of `size` words that lie within one text."""
        n = len(self.hashes)
        if n < size:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        h = np.zeros(n - size + 1, dtype=np.uint64)
        for j in range(size):
            h = h * _STEP + self.hashes[j : n - size + 1 + j]
        at = np.arange(len(h))
        last = np.repeat(self.bounds[1:], np.diff(self.bounds))[: len(h)]
        inside = at + size <= last
        return at[inside], mix(h[inside])


def words_of(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """Words of texts that lie end to end: text i is `data[offsets[i]:offsets[i + 1]]`. A-Z are lower-cased."""
    data = _LOWER[data]
    inside = table[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[:1] = False
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[-1:] = False
    cut = offsets[1:-1] - 1
    after[cut[cut >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    hashes = run_hashes(data, starts, ends) if len(starts) else np.empty(0, np.uint64)
    return Words(data, starts, ends, hashes, np.searchsorted(starts, offsets))


def slices(texts: pa.Array, most_bytes: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of texts of about `most_bytes`; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most_bytes, side="right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
