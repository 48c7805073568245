"""Runs of words that repeat at a period, by enumeration of maximal pairs over the tree of LCP intervals.

A run is a stretch of words with smallest period q and at least two periods long (and at least `LEAST` words) that no
neighbouring word extends at period q. Two places whose common words go on for l words, with unlike words in front and
behind, are a maximal pair; if their distance p is at most l, the stretch from the first place over p + l words is a
run of period p or a multiple of its smallest, and nothing has to be extended. So runs are the maximal pairs of distance at
most l with p + l >= `LEAST`, and of one stretch the smallest p is its period.

For a batch of texts at once, over NumPy arrays: words are hashed; documents where no six words stand twice have no run
and need no more (p <= l and p + l >= 12 mean l >= 6). The others' suffixes are sorted by prefix doubling, of which only
suffixes not yet told apart take part; equal ranks along the doublings give the LCP of neighbours, and a stack the intervals
of six words and more, bottom up. At each interval the places outside its largest child are held against all of the
interval. An interval's places within l of one another, if there are three or more, stand at equal distances, so all but
the first have the same word in front, and all but the last the same behind: of a place's partners within reach only the
first before it and the last behind it can be of another class of left words and of another child. These two are found
among the interval's places by a wavelet matrix, so time is about n log^2 n, also for one word a million times.

Words are told apart by 64-bit hashes; every run's words are then compared themselves, and a document in which two unlike
words had one hash is done again with numbers for hashes. Whole texts, no shuffle; memory grows with the longest text.

`planted` rewrites some documents so that their words repeat, by a checksum of the id. Null or empty text and text of white
space: no words, no runs. A null id has no checksum: nothing is planted. Rows are kept one to one. Empty table: empty
result. Columns that are kept and named as results give way.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm._words import NONSPACE, mix, run_hashes, slices
from lectern.llm.shared import release

#: Words that a run has at least, and of two places in a run the least that they have in common.
LEAST = 12
_DEEP = LEAST // 2
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that lie end to end, and the bounds of each text's."""
    inside = NONSPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1] if len(data) else inside
    after = np.concatenate((inside[1:], [False])) & ~edge[1:] if len(data) else inside
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(first word, period) where a document of n words is rewritten: word i from there on is the (i - first) % period-th."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return None
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and for each the number of smaller ones."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    rank = np.empty(len(key), np.int64)
    rank[order] = np.repeat(first, np.diff(np.concatenate((first, [len(s)]))))
    return order, rank


def suffixes(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of their suffixes, and the LCP of each with the one before (0 where it is less than six words).

    words: one number each; documents are `bounds[d]:bounds[d + 1]`, each of which ends with a number that stands nowhere
    else. Suffixes of two documents have nothing in common.
    """
    n = len(words)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    _, rank = _ranked(words)
    order, rank = _ranked(doc * np.int64(n) + rank)
    levels, k = [(1, rank)], 1
    sa = order
    while True:
        s = rank[sa]
        tied = np.concatenate((s[1:] == s[:-1], [False])) | np.concatenate(([False], s[1:] == s[:-1]))
        at = np.flatnonzero(tied)
        if not len(at):
            break
        places = sa[at]
        # Suffixes that agree in k words end no earlier than behind these.
        behind = rank[places + k]
        inner = np.lexsort((behind, s[at]))
        sa[at] = places[inner]
        g, b = s[at][inner], behind[inner]
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (b[1:] != b[:-1])))
        rank = rank.copy()
        firsts = np.flatnonzero(new)
        rank[sa[at]] = np.repeat(at[firsts], np.diff(np.concatenate((firsts, [len(at)]))))
        k *= 2
        levels.append((k, rank))
    lcp = np.zeros(n, np.int64)
    level4 = next((r for size, r in levels if size == 4), None)
    if level4 is not None:
        near = np.flatnonzero(level4[sa[1:]] == level4[sa[:-1]]) + 1
        x, y, m = sa[near - 1].copy(), sa[near].copy(), np.zeros(len(near), np.int64)
        for size, r in reversed(levels):
            same = r[x] == r[y]
            x[same] += size
            y[same] += size
            m[same] += size
        lcp[near] = np.where(m >= _DEEP, m, 0)
    return sa, lcp


def intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """LCP intervals bottom up: depth, first and last row (excluded), and the rows of the largest child of each."""
    done: list[tuple[int, int, int, int, int]] = []
    stack: list[list[int]] = []  # depth, first row, largest child
    deep = np.flatnonzero(lcp)
    # Where a stretch of common words ends, all intervals do.
    rows = np.union1d(deep, deep + 1)
    for i, depth in zip(rows.tolist(), np.append(lcp, 0)[rows].tolist(), strict=True):
        lo = child = i - 1
        while stack and stack[-1][0] > depth:
            own, lo, big_lo, big_hi = stack.pop()
            if i - child > big_hi - big_lo:
                big_lo, big_hi = child, i
            done.append((own, lo, i, big_lo, big_hi))
            child = lo
        if stack and stack[-1][0] == depth:
            if i - child > stack[-1][3] - stack[-1][2]:
                stack[-1][2:] = child, i
        elif depth:
            stack.append([depth, lo, child, i])
    return tuple(np.array(done, np.int64).reshape(-1, 5).T)


class Wavelet:
    """Counts and order statistics of values (distinct, from 0) within ranges of an array, for many questions at once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max()).bit_length()) if len(values) else 1
        self.levels = []
        for b in range(self.bits - 1, -1, -1):
            one = (values >> b) & 1
            zeros = np.concatenate(([0], np.cumsum(1 - one)))
            self.levels.append((b, zeros))
            values = values[np.argsort(one, kind="stable")]

    def below(self, lo: np.ndarray, hi: np.ndarray, v: np.ndarray) -> np.ndarray:
        """How many of the values at lo:hi are less than v."""
        n = np.zeros(len(lo), np.int64)
        over = v >= 1 << self.bits
        for b, zeros in self.levels:
            bit = (v >> b) & 1 == 1
            z_lo, z_hi, all_zeros = zeros[lo], zeros[hi], zeros[-1]
            n += np.where(bit, z_hi - z_lo, 0)
            lo = np.where(bit, all_zeros + lo - z_lo, z_lo)
            hi = np.where(bit, all_zeros + hi - z_hi, z_hi)
        return np.where(over, -1, n)

    def nth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of the values at lo:hi."""
        out = np.zeros(len(lo), np.int64)
        for b, zeros in self.levels:
            z_lo, z_hi, all_zeros = zeros[lo], zeros[hi], zeros[-1]
            here = z_hi - z_lo
            bit = k >= here
            k = np.where(bit, k - here, k)
            out |= np.where(bit, 1 << b, 0)
            lo = np.where(bit, all_zeros + lo - z_lo, z_lo)
            hi = np.where(bit, all_zeros + hi - z_hi, z_hi)
        return out


def maximal_pairs(words: np.ndarray, sa: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, distance, common words) of the maximal pairs whose distance is at most their common words. Before the
    first word of each document stands a number that stands nowhere else, so place 0 is never in a pair."""
    depth, lo, hi, big_lo, big_hi = intervals(lcp)
    if not len(depth):
        return (np.zeros(0, np.int64),) * 3
    # The rows of each interval that are outside its largest child.
    sizes = np.stack((big_lo - lo, hi - big_hi), axis=1).ravel()
    begins = np.stack((lo, big_hi), axis=1).ravel()
    node = np.repeat(np.repeat(np.arange(len(depth)), 2), sizes)
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(begins, sizes) + within
    # Only rows of intervals count; they are numbered anew, so that the matrix is small.
    kept = np.flatnonzero((lcp > 0) | np.concatenate((lcp[1:] > 0, [False])))
    values = np.unique(sa[kept])
    dense = np.searchsorted(values, sa[kept])
    at = np.full(len(sa) + 1, 0, np.int64)
    at[kept] = np.arange(len(kept))
    n_lo, n_hi = at[lo], at[hi - 1] + 1
    tree = Wavelet(dense)
    x, d = sa[row], depth[node]
    lo_, hi_ = n_lo[node], n_hi[node]
    found = []
    # The first place of the interval within reach before x.
    c = tree.below(lo_, hi_, np.searchsorted(values, np.maximum(x - d, 0)))
    y = values[tree.nth(lo_, hi_, c)]
    ok = y < x
    found.append((y[ok], x[ok], node[ok]))
    # The last one within reach behind x.
    v = np.searchsorted(values, x + d, side="right")
    c = tree.below(lo_, hi_, v)
    c = np.where(c < 0, hi_ - lo_, c) - 1
    y = values[tree.nth(lo_, hi_, c)]
    ok = y > x
    found.append((x[ok], y[ok], node[ok]))
    a, b, node = (np.concatenate(p) for p in zip(*found, strict=True))
    l = depth[node]
    # Of another class of left words, and of another child: the words behind the common ones differ.
    ok = (words[a - 1] != words[b - 1]) & (words[a + l] != words[b + l]) & (b - a + l >= LEAST)
    return a[ok], (b - a)[ok], l[ok]


def _runs(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, length, period) of all runs, in order. words, bounds: as for `suffixes`; a document's first number, too,
    stands nowhere else."""
    sa, lcp = suffixes(words, bounds)
    start, period, common = maximal_pairs(words, sa, lcp)
    length = period + common
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.concatenate(([True], (start[1:] != start[:-1]) | (length[1:] != length[:-1]))) if len(start) else np.zeros(0, bool)
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def runs(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of the runs of documents of words (64-bit hashes), by document and start."""
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    none = (np.zeros(0, np.int64),) * 4
    if len(words) < LEAST:
        return none
    # Documents in which six words stand twice.
    h = np.zeros(len(words) - _DEEP + 1, np.uint64)
    for j in range(_DEEP):
        h = h * _STEP + words[j : len(words) - _DEEP + 1 + j]
    inside = doc[: len(h)] == doc[_DEEP - 1 :]
    where = doc[: len(h)][inside]
    h = mix(h[inside] + where.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(h)
    twice = order[np.flatnonzero(h[order][1:] == h[order][:-1])]
    live = np.unique(where[twice])
    if not len(live):
        return none
    # The live documents' words, with a number of its own before and behind each document's.
    size = n[live] + 2
    ends = np.cumsum(size)
    of = np.repeat(np.arange(len(live)), size)
    place = np.arange(ends[-1]) - np.repeat(ends - size, size)
    edge = (place == 0) | (place == size[of] - 1)
    number = np.empty(ends[-1], np.int64)
    source = bounds[live][of] + place - 1
    _, dense = np.unique(words[source[~edge]], return_inverse=True)
    number[~edge] = dense
    number[edge] = len(words) + np.arange(edge.sum())
    start, length, period = _runs(number, np.concatenate(([0], ends)))
    d = of[start]
    return live[d], place[start] - 1, length, period


_LONGS = ["n_words", "n_runs", "start", "length", "period", "exponent_milli"]


def _bytes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> bytes:
    return data[starts[k] : ends[k]].tobytes()


def _checked(data, starts, ends, words: np.ndarray, bounds: np.ndarray, found) -> tuple:
    """The runs, once their words are compared themselves; documents with two unlike words of one hash are done again."""
    doc, start, length, period = found
    if not len(doc):
        return found
    n = length - period
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    x = np.repeat(bounds[doc] + start, n) + within
    y = x + np.repeat(period, n)
    sizes = ends - starts
    odd = sizes[x] != sizes[y]
    size = np.where(odd, 0, sizes[x])
    byte = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    unlike = np.repeat(np.arange(len(x)), size)[data[np.repeat(starts[x], size) + byte] != data[np.repeat(starts[y], size) + byte]]
    bad = np.unique(np.repeat(doc, n)[np.union1d(np.flatnonzero(odd), unlike)])
    if not len(bad):
        return found
    parts = [tuple(c[~np.isin(doc, bad)] for c in found)]
    for d in bad:
        numbers: dict[bytes, int] = {}
        own = np.array([numbers.setdefault(_bytes_of(data, starts, ends, k), len(numbers)) for k in range(bounds[d], bounds[d + 1])], np.uint64)
        again = runs(own, np.array([0, len(own)]))
        parts.append((np.full(len(again[0]), d), *again[1:]))
    doc, start, length, period = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((period, start, doc))
    return doc[order], start[order], length[order], period[order]


def _collapsed(data, starts, ends, bounds, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each text, one space between, end to end; and where each text's begin."""
    at = np.flatnonzero(keep)
    size = ends[at] - starts[at] + 1
    stop = np.cumsum(size)
    out = np.full(stop[-1] if len(stop) else 0, 32, np.uint8)
    inner = np.repeat(starts[at] - (stop - size), size - 1)
    # All but the last byte of each word's part, which is the space behind it.
    to = np.arange(len(out))
    if len(stop):
        space = np.zeros(len(out), bool)
        space[stop - 1] = True
        to = to[~space]
    out[to] = data[to + inner]
    return out, np.concatenate(([0], stop))[np.searchsorted(at, bounds)]


def find(df: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), plant: bool = False, collapse: bool = False) -> DataFrame:
    """`keep`, n_words, n_runs, the longest run (start, length, period, exponent_milli), `runs` (start, length, period), the
    SHA-256 of the runs and of the collapsed text, and with `collapse` that text, in which a run stands for one period.

    `plant`: documents are rewritten first, as `planted` says by `key`.
    """
    digests = ["runs_sha256", "collapsed_sha256"]
    keep = tuple(k for k in keep if k not in (*_LONGS, *digests, "runs", "collapsed"))
    run_type = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
    extra = [T.StructField("collapsed", T.StringType())] if collapse else []
    schema = T.StructType([*(df.schema[k] for k in keep), *(T.StructField(c, T.LongType()) for c in _LONGS), *(T.StructField(c, T.StringType()) for c in digests), T.StructField("runs", run_type), *extra])
    k = len(keep)

    def of(ids: list, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        starts, ends, bounds = _words(data, offsets)
        n = np.diff(bounds)
        for d, one in enumerate(ids if plant else ()):
            if (where := planted(one, int(n[d]))) is not None:
                a, p = where
                source = bounds[d] + a + np.arange(n[d] - a) % p
                starts[bounds[d] + a : bounds[d + 1]], ends[bounds[d] + a : bounds[d + 1]] = starts[source], ends[source]
        hashes = run_hashes(data, starts, ends) if len(starts) else np.empty(0, np.uint64)
        doc, start, length, period = _checked(data, starts, ends, hashes, bounds, runs(hashes, bounds))
        # A run's words after its first period go.
        change = np.zeros(len(starts) + 1, np.int64)
        np.add.at(change, bounds[doc] + start + period, 1)
        np.add.at(change, bounds[doc] + start + length, -1)
        flat, at = _collapsed(data, starts, ends, bounds, np.cumsum(change[:-1]) == 0)
        held = np.searchsorted(doc, np.arange(len(n) + 1))
        best = np.full(len(n), -1)
        order = np.lexsort((period, start, -length, doc))
        best[doc[order][::-1]] = order[::-1]
        view, prints, texts, collapsed = memoryview(flat), [], [], []
        for d in range(len(n)):
            said = "".join(f"{s},{l},{p}\n" for s, l, p in zip(start[held[d] : held[d + 1]].tolist(), length[held[d] : held[d + 1]].tolist(), period[held[d] : held[d + 1]].tolist(), strict=True))
            prints.append(hashlib.sha256(said.encode()).hexdigest())
            own = view[at[d] : max(at[d], at[d + 1] - 1)]
            texts.append(hashlib.sha256(own).hexdigest())
            if collapse:
                collapsed.append(bytes(own).decode())
        empty = best < 0
        of_best = lambda c: pa.array(np.where(empty, 0, c[best] if len(c) else 0).astype(np.int64), mask=empty)
        exponent = 1000 * length // np.maximum(period, 1)
        listed = pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in (start, length, period)], names=["start", "length", "period"])
        return [
            pa.array(n.astype(np.int64)), pa.array(np.diff(held).astype(np.int64)), of_best(start), of_best(length), of_best(period), of_best(exponent),
            pa.array(prints, pa.string()), pa.array(texts, pa.string()), pa.ListArray.from_arrays(pa.array(held, pa.int32()), listed), *([pa.array(collapsed, pa.string())] if collapse else []),
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(k).to_pylist()
            for a, b, data, offsets in slices(batch.column(k + 1)):
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(k)), *of(ids[a:b], data, offsets)], names=schema.names)
        release()

    return df.select(*keep, F.col(key).alias("__id"), F.col(text).alias("__text")).mapInArrow(run, schema)


def registered(spark, sf_dir: str) -> DataFrame:
    from lectern.session import table

    out = find(table(spark, sf_dir, "documents"), plant=True)
    return out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words")
