"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum over all
its segmentations into pieces, by a forward pass; a text's is the product over its words. (A piece holds the word mark
only at its front, so a segmentation of a text is one of each of its words.) Pieces' probabilities come from expected
counts over all segmentations (EM), learned on a bounded sample of labelled rows: up to `max_docs` per language, by
hash of the key, whole texts. Words of any length are scored whole, once per table of bounded size and letters, all new
ones of a batch at a time.

A row is never used with its own label, source or key when its language is predicted. A text without letters (Unicode
category L; numerals such as fractions are none), or null, is `und` with score 0. Ties go to the first language in order of name. The score is the winner's share of probability
per tenth of the words, from 0 to 1. Rows are kept one to one. Without labelled rows every text is `und`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.shared import forget, release, with_text

MODEL = "piece_bpe_32k.model"
MAX_DOCS = 600
CACHE_WORDS = 60_000
UNKNOWN = "und"
_MARK = "▁"
_FLOOR = 1e-7
#: Words of more letters are summed one by one, rescaled on the way; shorter ones many at a time. The sums are the same.
_LONG = 40
#: Letters of the words whose scores a worker keeps.
CACHE_LETTERS = 8_000_000
_WORD = re.compile(r"[^\W\d_]+")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


_vocabularies: dict[str, dict[str, int]] = {}


def vocabulary(path: str) -> dict[str, int]:
    """Pieces of letters, with or without the word mark, and their numbers."""
    if path not in _vocabularies:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
        _vocabularies[path] = {p: n for n, p in enumerate(p for p in pieces if p.lstrip(_MARK).isalpha() and p.count(_MARK) <= 1)}
    return _vocabularies[path]


def words_of(text: str) -> list[str]:
    """Words of letters (Unicode category L), lower-cased."""
    words = _WORD.findall(text.lower())
    if all(map(str.isalpha, words)):
        return words
    # Numerals such as fractions are no letters, though the pattern takes them.
    return [part for w in words for part in ((w,) if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BITS = 20


def _finish(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    return h * np.uint64(0xBF58476D1CE4E5B9)


class Lattice:
    """Finds the pieces within words, for many words at once: piece numbers by length and start."""

    def __init__(self, vocab: dict[str, int]):
        self.size = len(vocab)
        self.longest = max(map(len, vocab))
        self.tables = []
        for n in range(1, self.longest + 1):
            own = [(w, i) for w, i in vocab.items() if len(w) == n]
            h = np.zeros(len(own), dtype=np.uint64)
            for k in range(n):
                h = h * _MULTIPLIER + np.array([ord(w[k]) for w, _ in own], dtype=np.uint64)
            h = _finish(h)
            order = np.argsort(h)
            maybe = np.zeros(1 << _BITS, dtype=bool)
            maybe[(h >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.tables.append((h[order], np.array([i for _, i in own], dtype=np.int64)[order], maybe))

    def arcs(self, words: list[str]) -> tuple[dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], int, np.ndarray]:
        """{(start, end): (words that have a piece there, its numbers)} with the mark as character 0, the greatest
        length, and the lengths. A letter that is no piece gets number -1: a floor probability, so that every word has
        a segmentation."""
        lengths = np.array([len(w) + 1 for w in words])
        size = int(lengths.max())
        flat = np.frombuffer("".join((_MARK + w).ljust(size, "\0") for w in words).encode("utf-32-le"), "<u4")
        chars = np.ascontiguousarray(flat.reshape(len(words), size).T).astype(np.uint64)
        out = {}
        h = np.zeros_like(chars)
        for n in range(1, min(self.longest, size) + 1):
            h = h[: size - n + 1] * _MULTIPLIER + chars[n - 1 :]
            known, numbers, maybe = self.tables[n - 1]
            f = _finish(h)
            inside = np.arange(n, size + 1)[:, None] <= lengths[None, :]
            at = np.flatnonzero((maybe[(f >> np.uint64(64 - _BITS)).astype(np.int64)] if len(known) else np.zeros(f.shape, bool)) & inside)
            spot = np.minimum(np.searchsorted(known, f.ravel()[at]), max(len(known) - 1, 0))
            real = known[spot] == f.ravel()[at] if len(known) else np.zeros(0, bool)
            if n == 1:
                piece = np.where(inside, -1, -2)
                piece.ravel()[at[real]] = numbers[spot[real]]
                for i in range(size):
                    own = np.flatnonzero(piece[i] > -2)
                    out[i, i + 1] = (own, piece[i][own])
                continue
            at, piece = at[real], numbers[spot[real]]
            row, word = np.divmod(at, len(words))
            cuts = np.searchsorted(row, np.arange(size - n + 2))
            for i in range(size - n + 1):
                if cuts[i] < cuts[i + 1]:
                    out[i, i + n] = (word[cuts[i] : cuts[i + 1]], piece[cuts[i] : cuts[i + 1]])
        return out, size, lengths


    def grid(self, word: str) -> np.ndarray:
        """Piece numbers of one word by length - 1 and start, the mark being character 0: -1 a letter that is no piece,
        -2 no piece of that length there."""
        chars = np.frombuffer((_MARK + word).encode("utf-32-le"), "<u4").astype(np.uint64)
        size = len(chars)
        out = np.full((min(self.longest, size), size), -2, dtype=np.int32)
        out[0] = -1
        h = np.zeros(size + 1, np.uint64)
        for n in range(1, len(out) + 1):
            h = h[: size - n + 1] * _MULTIPLIER + chars[n - 1 :]
            known, numbers, _ = self.tables[n - 1]
            if len(known):
                f = _finish(h)
                spot = np.minimum(np.searchsorted(known, f), len(known) - 1)
                real = np.flatnonzero(known[spot] == f)
                out[n - 1, real] = numbers[spot[real]]
        return out


_lattices: dict[int, Lattice] = {}


def lattice(vocab: dict[str, int]) -> Lattice:
    if id(vocab) not in _lattices:
        _lattices[id(vocab)] = Lattice(vocab)
    return _lattices[id(vocab)]


def _forward(arcs: dict, size: int, n: int, probs: np.ndarray) -> np.ndarray:
    alpha = np.zeros((size + 1, n, probs.shape[1]))
    alpha[0] = 1
    for i, j in sorted(arcs, key=lambda x: x[1]):
        own, piece = arcs[i, j]
        alpha[j][own] += alpha[i][own] * probs[piece]
    return alpha


def _long_forward(grid: np.ndarray, probs: np.ndarray, run: int = 1024) -> np.ndarray:
    """Log of the sums over all segmentations of each beginning of a word (place x language)."""
    most, size = grid.shape
    known = np.vstack([probs, np.zeros(probs.shape[1])])
    out = np.zeros((size + 1, probs.shape[1]))
    held, scale = np.zeros((most, probs.shape[1])), np.zeros(probs.shape[1])
    held[-1] = 1
    for a in range(1, size + 1, run):
        b = min(a + run, size + 1)
        at = np.full((b - a, most), -2)
        for n in range(1, most + 1):
            lo = max(a, n)
            if lo < b:
                at[lo - a :, most - n] = grid[n - 1, lo - n : b - n]
        step = known[np.where(at == -2, len(probs), np.where(at == -1, len(probs) - 1, at))]
        row = np.concatenate([held, np.zeros((b - a, probs.shape[1]))])
        for k in range(b - a):
            row[most + k] = (row[k : k + most] * step[k]).sum(0)
            if k % 16 == 15:
                top = row[k + 1 : most + k + 1].max(0)
                row[k + 1 : most + k + 1] /= top
                out[a + k - 15 : a + k + 1] = np.log(np.maximum(row[most + k - 15 : most + k + 1] * top, 1e-300)) + scale
                scale = scale + np.log(top)
        left = (b - a) % 16
        if left:
            out[b - left : b] = np.log(np.maximum(row[len(row) - left :], 1e-300)) + scale
        held = row[b - a :]
    return out


def by_length(words: list[str], most: int = 4000) -> Iterator[np.ndarray]:
    """Numbers of the words of at most `_LONG` letters, words of like length together."""
    sizes = np.array([len(w) for w in words])
    order = np.argsort(sizes, kind="stable")
    order = order[: np.searchsorted(sizes[order], _LONG, side="right")]
    for at in range(0, len(order), most):
        yield order[at : at + most]


def forward(words: list[str], vocab: dict[str, int], probs: np.ndarray) -> np.ndarray:
    """Log-probabilities (word x language): sums over all segmentations. probs: piece x language, last row the floor."""
    out = np.zeros((len(words), probs.shape[1]))
    for own in by_length(words):
        arcs, size, lengths = lattice(vocab).arcs([words[i] for i in own])
        alpha = _forward(arcs, size, len(own), probs)
        out[own] = np.log(np.maximum(alpha[lengths, np.arange(len(own))], 1e-300))
    for i, w in enumerate(words):
        if len(w) > _LONG:
            out[i] = _long_forward(lattice(vocab).grid(w), probs)[-1]
    return out


def expected(words: list[str], counts: np.ndarray, vocab: dict[str, int], probs: np.ndarray) -> np.ndarray:
    """Expected piece counts (piece x language) of words seen `counts` times (word x language)."""
    out = np.zeros_like(probs)
    for own in by_length(words):
        arcs, size, lengths = lattice(vocab).arcs([words[i] for i in own])
        alpha = _forward(arcs, size, len(own), probs)
        every = np.arange(len(own))
        beta = np.zeros_like(alpha)
        beta[lengths, every] = 1
        weight = counts[own] / np.maximum(alpha[lengths, every], 1e-300)
        for i, j in sorted(arcs, key=lambda x: -x[0]):
            some, piece = arcs[i, j]
            step = probs[piece] * beta[j][some]
            beta[i][some] += step
            np.add.at(out, piece, alpha[i][some] * step * weight[some])
    for w, count in zip(words, counts, strict=True):
        if len(w) > _LONG:
            grid = lattice(vocab).grid(w)
            size = grid.shape[1]
            back = np.full_like(grid, -2)
            for n in range(1, len(grid) + 1):
                back[n - 1, : size - n + 1] = grid[n - 1, : size - n + 1][::-1]
            alpha, beta = _long_forward(grid, probs), _long_forward(back, probs)[::-1]
            for n in range(1, len(grid) + 1):
                at = np.flatnonzero(grid[n - 1] > -2)
                piece = grid[n - 1, at]
                np.add.at(out, piece, np.exp(alpha[at] + np.log(probs[piece]) + beta[at + n] - alpha[-1]) * count)
    return out


def fit(word_counts: dict[str, Counter], vocab: dict[str, int], rounds: int = 3) -> tuple[list[str], np.ndarray]:
    """Languages in order of name, and their piece probabilities (last row: the floor)."""
    langs = sorted(word_counts)
    words = sorted({w for c in word_counts.values() for w in c})
    counts = np.array([[word_counts[x][w] for x in langs] for w in words], dtype=float)
    probs = np.full((len(vocab) + 1, len(langs)), 1 / len(vocab))
    probs[-1] = _FLOOR
    for _ in range(rounds):
        seen = expected(words, counts, vocab, probs)
        seen[-1] = 0
        seen[:-1] += 0.01  # no piece is impossible
        probs = seen / seen.sum(0)
        probs[-1] = _FLOOR
    return langs, probs


def sample(df: DataFrame, text: str, label: str, key: str, max_docs: int) -> DataFrame:
    """Labelled rows to learn from: all of a language with up to about `max_docs`, else so many by hash of key and text."""
    rows = df.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("lang"), F.col(text).alias("text"), F.col(key).cast("string").alias("key"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return rows.drop("key").limit(0)
    most = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, int(1_000_000 * min(1.0, max_docs / n)))))
    return rows.filter(F.pmod(F.xxhash64("key", "text"), F.lit(1_000_000)) < most[F.col("lang")]).select("lang", "text")


def learn(train: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", model: str | None = None, max_docs: int = MAX_DOCS) -> tuple[list[str], np.ndarray]:
    """Fits on a bounded sample. Its word counts are made in tasks and summed by Spark."""
    vocab = vocabulary(model or default_model())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for lang, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.update((lang, w) for w in words_of(body))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])

    rows = sample(train, text, label, key, max_docs).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, Counter] = {}
    for r in rows.collect():  # words of the bounded sample
        counts.setdefault(r["lang"], Counter())[r["word"]] = r["n"]
    if not any(counts.values()):
        return [], np.zeros((len(vocab) + 1, 0))
    fitted = fit(counts, vocab)
    del counts
    forget(train.sparkSession)
    return fitted


class Scorer:
    """Scores texts; keeps the scores of at most `CACHE_WORDS` words."""

    def __init__(self, langs: list[str], probs: np.ndarray, path: str):
        self.langs, self.probs, self.vocab = langs, probs, vocabulary(path)
        self.number: dict[str, int] = {}
        self.letters = 0
        self.table = np.zeros((CACHE_WORDS, len(langs)))

    def score(self, texts: list[str]) -> list[tuple[str, float]]:
        parts = [words_of(t) if t else [] for t in texts]
        out: list[tuple[str, float]] = []
        at = 0
        while at < len(parts):
            if len(self.number) > CACHE_WORDS // 2 or self.letters > CACHE_LETTERS:
                self.number.clear()
                self.letters = 0
            end, fresh = at, {}
            while end < len(parts):
                new = {w for w in parts[end] if w not in self.number and w not in fresh}
                if end > at and len(self.number) + len(fresh) + len(new) > CACHE_WORDS:
                    break
                fresh.update(dict.fromkeys(new))
                end += 1
            fresh = list(fresh)
            self.letters += sum(map(len, fresh))
            first = len(self.number)
            if first + len(fresh) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((first + len(fresh) - len(self.table), len(self.langs)))])
            self.table[first : first + len(fresh)] = forward(fresh, self.vocab, self.probs)
            self.number.update(zip(fresh, range(first, first + len(fresh)), strict=True))
            for words in parts[at:end]:
                out.append(self._verdict(words))
            at = end
        return out

    def _verdict(self, words: list[str]) -> tuple[str, float]:
        if not words or not self.langs:
            return UNKNOWN, 0.0
        total = self.table[np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))].sum(0)
        best = int(total.argmax())
        share = np.exp((total - total[best]) / max(1.0, len(words) / 10))
        return self.langs[best], float(1 / share.sum())


def identify(df: DataFrame, langs: list[str], probs: np.ndarray, text: str = "text", keep: tuple[str, ...] = ("doc_id",), model: str | None = None) -> DataFrame:
    """`keep`, lang_pred and score of every row. A kept column of one of these two names gives way to the result."""
    keep = tuple(k for k in keep if k not in ("lang_pred", "score"))
    path = model or default_model()
    shared = df.sparkSession.sparkContext.broadcast((langs, probs.astype(np.float64)))  # vocabulary x languages
    schema = T.StructType([*(df.schema[k] for k in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    built: list[Scorer] = []
    chosen, at_text = with_text(df, keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            built.append(Scorer(*shared.value, path))
        for whole in batches:
            # In small parts, so that neither side holds the texts of a large batch more than once.
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                said: list[tuple[str, float]] = []
                for b in range(0, batch.num_rows, 128):
                    said += built[0].score(batch.column(at_text).slice(b, 128).to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())], names=schema.names)
            del whole, batch
            release()
        release()

    return chosen.mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """The fold that is never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(4)) == 2, F.lit(False))


def registered(spark, sf_dir: str) -> DataFrame:
    from lectern.session import table

    docs = table(spark, sf_dir, "documents")
    langs, probs = learn(docs.filter(~held_out()))
    said = identify(docs, langs, probs)
    return said.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
