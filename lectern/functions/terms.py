"""Terms of lower-case texts, or of arrays of words, counted in Arrow batches: no Python object is made for a term.

Terms of a text are its words `[a-z0-9]+` and, where asked for, the character bigrams of each word, as `text.tokens` makes
them. Terms are numbered within a run of rows; a word of two characters and the bigram of the same ones are one term.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTERS = b"0123456789abcdefghijklmnopqrstuvwxyz"
_NUMBER = np.full(256, len(LETTERS), np.uint8)
_NUMBER[list(LETTERS)] = np.arange(len(LETTERS))
N_PAIRS = len(LETTERS) ** 2
PAIRS = pa.array([chr(a) + chr(b) for a in LETTERS for b in LETTERS], pa.string())
#: Rows and bytes of text that are looked at together, one text at least.
ROWS, BYTES = 512, 2 << 20


class Counted(NamedTuple):
    """Terms of the rows from `first` on: `times` that row `of` (from 0) holds `known[term]`, each pair once; all terms of each
    row, nulls too, in `size`."""

    first: int
    size: np.ndarray
    of: np.ndarray
    term: np.ndarray
    times: np.ndarray
    known: pa.Array


def counted(column: pa.Array, pairs: bool = False) -> Iterator[Counted]:
    """Counts of an array of texts (lower-case) or of lists of words; null ones hold nothing."""
    if pa.types.is_list(column.type):
        for first in range(0, len(column), ROWS):
            yield _of_lists(column.slice(first, ROWS), first)
        return
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + BYTES, side="right")) - 1
        last = min(n, first + ROWS, max(first + 1, last))
        yield _of_texts(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], first, pairs)
        first = last


def _tally(of: np.ndarray, term: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cell, times = np.unique(of * kinds + term, return_counts=True)
    return *np.divmod(cell, max(kinds, 1)), times


def _of_lists(words: pa.Array, first: int) -> Counted:
    size = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = words.flatten()
    of = np.repeat(np.arange(len(words)), size)[pc.is_valid(flat).to_numpy(zero_copy_only=False)]
    told = flat.drop_null().dictionary_encode()
    return Counted(first, size, *_tally(of, told.indices.to_numpy().astype(np.int64), len(told.dictionary)), told.dictionary)


def _of_texts(data: np.ndarray, offsets: np.ndarray, first: int, pairs: bool) -> Counted:
    n = len(offsets) - 1
    number = _NUMBER[data]
    inside = number < len(LETTERS)
    follows = inside.copy()  # a character of a word that is not its first
    follows[1:] &= inside[:-1]
    follows[offsets[:-1][offsets[:-1] < len(data)]] = False
    inner = follows[inside]
    starts = np.append(np.flatnonzero(~inner), len(inner)).astype(np.int32)
    told = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(data[inside])).dictionary_encode()
    word = told.indices.to_numpy().astype(np.int64)
    size = np.diff(np.searchsorted(np.flatnonzero(inside & ~follows), offsets))
    of = np.repeat(np.arange(n), size)
    if not pairs:
        return Counted(first, size, *_tally(of, word, len(told.dictionary)), told.dictionary)
    second = np.flatnonzero(follows)
    held = np.diff(np.searchsorted(second, offsets))
    cell = np.repeat(np.arange(n), held) * N_PAIRS + number[second - 1].astype(np.int64) * len(LETTERS) + number[second]
    same = pc.fill_null(pc.index_in(told.dictionary, value_set=PAIRS), -1).to_numpy(zero_copy_only=False).astype(np.int64)[word]
    short = same >= 0
    times = np.bincount(np.concatenate((cell, of[short] * N_PAIRS + same[short])), minlength=n * N_PAIRS)
    cell = np.flatnonzero(times)
    of, word, more = _tally(of[~short], word[~short], len(told.dictionary))
    known = pa.concat_arrays([PAIRS, told.dictionary])
    return Counted(first, size + held, np.concatenate((cell // N_PAIRS, of)), np.concatenate((cell % N_PAIRS, word + N_PAIRS)), np.concatenate((times[cell], more)), known)
