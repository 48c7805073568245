"""The word tokenizer's ids for plain texts, by whole-array operations.

Plain: printable ASCII, tab, newline, return, and Latin-1 letters, for which lower-casing, normal forms and the letter
class are fixed. There the tokenizer's steps (lower case, split into letters, digits, signs and contractions, merges by
rank) run over all distinct words of a batch at once. Other texts are left to the tokenizers library, whose ids these
equal (tests compare them). Distinct words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import json

import numpy as np

from lectern.llm._words import run_hashes

_SPACE, _LETTER, _DIGIT, _OTHER, _BAD = range(5)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[[9, 10, 13, 32]] = _SPACE
_CLASS[97:123] = _CLASS[65:91] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[*range(9), 11, 12, *range(14, 32), *range(127, 256)]] = _BAD
_NONE = np.int64(1 << 30)
#: Words whose ids are kept from batch to batch.
KNOWN_WORDS = 120_000


def plain(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts are plain."""
    bad = _CLASS[data] == _BAD
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.empty(0, np.int64)
    second = data[lead + 1]
    good = lead[(second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)]
    bad[good] = bad[good + 1] = False
    sums = np.concatenate(([0], np.cumsum(bad)))
    return sums[offsets[1:]] == sums[offsets[:-1]]


class Merges:
    """Ids of words by merges in order of rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        # The byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        letters = [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]
        self.first = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[self._slot(self.keys)] = True
        self.known: dict[int, bytes] = {}

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        out = np.full(len(key), _NONE)
        some = np.flatnonzero(self.maybe[self._slot(key)])
        spot = np.minimum(np.searchsorted(self.keys, key[some]), len(self.keys) - 1)
        real = self.keys[spot] == key[some]
        out[some[real]] = self.rank[spot[real]]
        return out

    def ids(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for words that lie end to end."""
        word = np.repeat(np.arange(len(lengths)), lengths)
        end = np.cumsum(lengths) - 1
        sym = self.first[data]
        sym[end] = self.last[data[end]]
        rank = np.full(len(sym), _NONE)
        inner = np.ones(len(sym), dtype=bool)
        inner[end] = False
        at = np.flatnonzero(inner)
        rank[at] = self.ranks(sym[at], sym[at + 1])
        done_sym, done_word = [], []
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(sym)), starts)
            busy = best >> 32 < _NONE
            busy_sym = np.repeat(busy, np.diff(np.append(starts, len(sym))))
            done_sym.append(sym[~busy_sym])
            done_word.append(word[~busy_sym])
            pos = best[busy] & 0xFFFFFFFF
            sym[pos] = self.made[best[busy] >> 32]
            busy_sym[pos + 1] = False
            place = np.cumsum(busy_sym) - 1
            pos = place[pos]
            sym, word, rank = sym[busy_sym], word[busy_sym], rank[busy_sym]
            for p in (pos - 1, pos):
                p = p[(p >= 0) & (p + 1 < len(sym))]
                same = word[p] == word[p + 1]
                rank[p[~same]] = _NONE
                rank[p[same]] = self.ranks(sym[p[same]], sym[p[same] + 1])
            rank[-1:] = _NONE
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(lengths))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lower-cased bytes, word starts, word lengths, word hashes, and bounds of the texts' words."""
    kind = _CLASS[data]
    lead = np.flatnonzero(data == 0xC3)
    kind[lead] = kind[lead + 1] = _LETTER
    low = data.copy()
    upper = (low >= 65) & (low <= 90)
    low[upper] += 32
    second = lead + 1
    second = second[(low[second] >= 0x80) & (low[second] <= 0x9E)]
    low[second] += 32
    begins = np.zeros(len(data), dtype=bool)
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    differs = np.ones(len(data), dtype=bool)
    differs[1:] = kind[1:] != kind[:-1]
    start = (kind != _SPACE) & (differs | begins | (kind == _DIGIT))
    # Contractions: an apostrophe that begins a run of signs, with these letters right behind it in the same text.
    quote = np.flatnonzero((low == 39) & start)
    text_end = offsets[np.searchsorted(offsets, quote, side="right")]
    one = quote[quote + 1 < text_end]
    end = text_end[quote + 1 < text_end]
    two = one + 2 < end
    a, b = low[one + 1], low[np.minimum(one + 2, len(low) - 1)]
    short = np.isin(a, [115, 116, 109, 100])
    long = two & (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)))
    for some, size in ((short, 2), (long & ~short, 3)):
        q, e = one[some], end[some]
        start[q + 1] = False
        more = q + size
        ok = more < e
        more = more[ok]
        start[more[kind[more] == _LETTER]] = True
    solid = kind != _SPACE
    begins |= start
    final = solid.copy()
    final[:-1] &= ~solid[1:] | begins[1:]
    starts, ends = np.flatnonzero(start), np.flatnonzero(final) + 1
    hashes = run_hashes(low, starts, ends) if len(starts) else np.empty(0, np.uint64)
    return low, starts, ends - starts, hashes, np.searchsorted(starts, offsets)


#: Bytes of a word that are merged in bulk at most, as each round merges one pair of a word; longer ones are for the library.
LONGEST = 256


def rules(path: str) -> tuple:
    """What a tokenizer file does to a text before its merges."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    model = said["model"]
    return said["normalizer"], said["pre_tokenizer"], model["type"], *(model.get(k) for k in ("end_of_word_suffix", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "dropout"))


def encode(merges: Merges, data: np.ndarray, offsets: np.ndarray, library) -> tuple[np.ndarray, np.ndarray]:
    """Ids of plain texts end to end, and the bounds of each text's ids. `library` encodes a list of texts."""
    low, starts, lengths, hashes, bounds = words(data, offsets)
    if not len(hashes):
        return np.empty(0, "<u4"), np.zeros(len(offsets), np.int64)
    distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    known = merges.known
    if len(known) > KNOWN_WORDS:
        known.clear()
    names = distinct.tolist()
    fresh = np.array([i for i, h in enumerate(names) if h not in known], dtype=np.int64)
    if len(fresh):
        begin = starts[first[fresh]]
        own = lengths[first[fresh]]
        long = np.flatnonzero(own > LONGEST)
        if len(long):
            said = library([low[b : b + n].tobytes().decode() for b, n in zip(begin[long].tolist(), own[long].tolist(), strict=True)])
            beyond = dict(zip([names[i] for i in fresh[long]], said, strict=True))
            short = own <= LONGEST
            fresh, begin, own = fresh[short], begin[short], own[short]
        else:
            beyond = {}
        if len(fresh):
            spot = np.repeat(begin - np.concatenate(([0], np.cumsum(own)[:-1])), own) + np.arange(own.sum())
            ids, counts = merges.ids(low[spot], own)
            flat, ends = ids.astype("<u4").tobytes(), np.cumsum(4 * counts).tolist()
            for i, s, e in zip(fresh.tolist(), [0, *ends], ends, strict=False):
                known[names[i]] = flat[s:e]
    else:
        beyond = {}
    found = [beyond[h] if h in beyond else known[h] for h in names]
    ids = np.frombuffer(b"".join(found), dtype="<u4")
    counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
    at = np.concatenate(([0], np.cumsum(counts)))
    n = counts[which]
    ends = np.concatenate(([0], np.cumsum(n)))
    spot = np.repeat(at[which] - ends[:-1], n) + np.arange(ends[-1])
    return ids[spot], ends[bounds]
