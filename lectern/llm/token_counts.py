"""Token counts of whole texts by a SentencePiece model.

`mapInArrow` takes the texts in runs of bounded bytes. A text is split where no piece can reach across: at a space
after a character that is no space (a piece holds the space mark only at its front, so merges on the two sides never
meet; the space itself comes back as the mark that the model puts before every text). The distinct chunks of a run
go to the encoder as one batch, and only lengths return. A table bounded by entries and characters keeps the
lengths of chunks seen before.

Nulls: a null text counts as empty (0 bytes, 0 tokens). Empty table: empty result. Rows are kept one to one, repeated
ids and repeated texts included. Only the `keep` columns and the results return; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
CACHE_ENTRIES = 150_000
#: Characters of the chunks whose lengths a worker keeps.
CACHE_CHARACTERS = 16_000_000
_MARK = "▁"
_CUT = re.compile(r"(?<=[^ ▁]) ")
_loaded: dict[str, tuple] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def chunks(text: str) -> list[str]:
    """The parts of a text between safe boundaries; their token counts add up to the text's."""
    if "  " in text or _MARK in text or text[:1] == " ":
        return _CUT.split(text)
    return text.split(" ")


class Counter:
    """Counts tokens; keeps the counts of chunks up to `CACHE_ENTRIES` and `CACHE_CHARACTERS`, beyond which it starts anew."""

    def __init__(self, path: str):
        import sentencepiece

        self.encoder = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known: dict[str, int] = {}
        self.characters = 0

    def count(self, texts: list[str]) -> list[int]:
        if len(self.known) > CACHE_ENTRIES or self.characters > CACHE_CHARACTERS:
            self.known.clear()
            self.characters = 0
        parts = [chunks(t) if t else None for t in texts]
        known = self.known
        fresh = list({c for p in parts if p for c in p if c not in known})
        for c, ids in zip(fresh, self.encoder.encode(fresh, num_threads=1), strict=True):
            known[c] = len(ids)
        self.characters += sum(map(len, fresh))
        known[""] = 1  # a lone space at the end of a text
        return [sum(map(known.__getitem__, p)) if p else 0 for p in parts]


def _counter(path: str) -> Counter:
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def by_bytes(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most `most` bytes, or of one row."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def token_counts(
    df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), model: str | None = None,
    limit: int = LIMIT, batch_bytes: int = 1 << 20,
) -> DataFrame:
    """`keep`, n_bytes, n_tokens and over_limit (n_tokens > limit) for every row. A kept column of one of these names gives way."""
    keep = tuple(k for k in keep if k not in ("n_bytes", "n_tokens", "over_limit"))
    path = model or default_model()
    fields = [df.schema[k] for k in keep]
    schema = T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            texts = batch.column(len(keep)).fill_null("")
            sizes = pc.binary_length(texts).to_pylist()
            counts: list[int] = []
            for a, b in by_bytes(sizes, batch_bytes):
                counts += counter.count(texts.slice(a, b - a).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])],
                names=schema.names,
            )

    return df.select(*keep, df[text].alias("__text")).mapInArrow(run, schema)


def registered(spark, sf_dir: str) -> DataFrame:
    from lectern.session import table

    return token_counts(table(spark, sf_dir, "documents"))
