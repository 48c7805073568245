"""Encoders and tokenizers behind plain seams, and a corpus that is built into an index, loaded and searched by one.

A tokenizer has `offsets(text)`, (start, end) of each token, and `count(text)`, how many tokens an encoder makes of a text.
An encoder has `encode(texts)`, a matrix of unit vectors, a `signature` that an index is only searched with again, and its
`tokenizer`. It is made once per Python task by a function that is sent there, so models are never pickled. What it cannot
take whole (no text, or more tokens than `most_tokens`) is an error, never cut.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators import chunks, retrieval
from lectern.sources import readers, writers


class Characters:
    """The plainest tokenizer: a token per character, and two that an encoder adds."""

    added = 2

    def offsets(self, text: str) -> list[tuple[int, int]]:
        return [(i, i + 1) for i in range(len(text))]

    def count(self, text: str) -> int:
        return len(text) + self.added


class Words:
    """A token per word or other sign; white space belongs to none."""

    added = 2

    def offsets(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in re.finditer(r"\w+|[^\w\s]", text)]

    def count(self, text: str) -> int:
        return len(self.offsets(text)) + self.added


class Encoder:
    """What encoders share: texts are refused rather than cut, vectors are finite and of length one."""

    signature: dict
    tokenizer = Words()
    most_tokens = 8192

    def vectors(self, texts: list[str]) -> np.ndarray:
        raise NotImplementedError

    def encode(self, texts: list[str]) -> np.ndarray:
        for t in texts:
            if t is None or not t.strip():
                raise ValueError("only texts that are not empty can be encoded")
            if self.tokenizer.count(t) > self.most_tokens:
                raise ValueError(f"a text has more than {self.most_tokens} tokens")
        made = np.asarray(self.vectors(texts), dtype=np.float64).reshape(len(texts), -1)
        if made.shape[1] != self.signature["dimension"] and len(texts):
            raise ValueError(f"vectors of {made.shape[1]} dimensions")
        size = np.linalg.norm(made, axis=1, keepdims=True)
        if not np.isfinite(made).all() or (size == 0).any():
            raise ValueError("a vector is zero or not finite")
        return made / size


class Hashing(Encoder):
    """Words and character trigrams, hashed into signed places."""

    def __init__(self, dimension: int = 256):
        self.signature = {"model": "hashing", "version": 1, "dimension": dimension}

    def vectors(self, texts: list[str]) -> np.ndarray:
        n = self.signature["dimension"]
        out = np.zeros((len(texts), n))
        for row, t in zip(out, texts, strict=True):
            flat = t.lower()
            for part in [*re.findall(r"\w+", flat), *(flat[i : i + 3] for i in range(len(flat) - 2)), flat]:
                h = zlib.crc32(part.encode())
                row[h % n] += 1 if h >> 31 else -1
            if not row.any():
                row[0] = 1
        return out


class Terms(Encoder):
    """Counts of fixed terms, and a small constant so that no vector is zero."""

    def __init__(self, *terms: str):
        self.terms, self.signature = terms, {"model": "terms", "terms": list(terms), "dimension": len(terms) + 1}
        self.most_tokens = 1 << 40

    def vectors(self, texts: list[str]) -> np.ndarray:
        return np.array([[*(t.count(w) for w in self.terms), 0.01] for t in texts])


Make = Callable[[], Encoder]
#: Texts that an encoder is given at once.
BATCH = 64


def encode(df: DataFrame, make: Make, text: str = "text", vector: str = "vector", batch: int = BATCH) -> DataFrame:
    """`df` with a unit vector of each row's text; the encoder is made once per task and gets `batch` texts at a time."""
    schema = T.StructType([*(f for f in df.schema if f.name != vector), T.StructField(vector, T.ArrayType(T.DoubleType()))])
    kept = [f.name for f in schema][:-1]
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for rows in batches:
            for begin in range(0, rows.num_rows, batch):
                part = rows.slice(begin, batch)
                made = encoder.encode(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(made), pa.list_(pa.float64()))], names=schema.names)

    return df.select(*kept).mapInArrow(run, schema)


def _signature(make: Make) -> str:
    return json.dumps(make().signature, sort_keys=True, ensure_ascii=False)


def build(spark: SparkSession, corpus: str, path: str, make: Make, budget: int = 512, overlap: int = 64) -> int:
    """Reads a corpus, cuts it into passages, encodes these and publishes the index. Never overwrites; any source without
    text or of unknown kind is an error. Returns the number of passages."""
    texts = readers.titled_texts(readers.corpus(spark, corpus))
    bad = texts.filter("problem IS NOT NULL").select("source", "problem").first()
    if bad is not None:
        raise ValueError(f"{bad['source']}: {bad['problem']}")
    passages = chunks.sectioned(texts, make().tokenizer, budget, overlap)
    return writers.publish(encode(passages, make, "embedding_text"), path, signature=_signature(make))


def search(spark: SparkSession, path: str, queries: DataFrame, make: Make, k: int = 5) -> DataFrame:
    """queries (q, text) to the k best passages of each with unlike texts: q, place, score, id, source, locator, title,
    section, text. An index of another encoder is refused, as are queries without text or name."""
    if k < 1:
        raise ValueError("k has to be positive")
    if not queries.filter("q IS NULL OR trim(q) = '' OR text IS NULL OR trim(text) = ''").isEmpty():
        raise ValueError("a query without text or name")
    index = writers.load_index(spark, path, signature=_signature(make))
    # Names are numbered for the search, and each group of texts that differ in white space only is searched once.
    named = retrieval.top_groups(index.select("id", "text"))
    asked = encode(queries.select("q", "text").distinct(), make).withColumn("n", F.xxhash64("q"))
    held = index.join(named, "id", "left_semi").withColumn("number", F.xxhash64("id"))
    best = retrieval.dense_top(asked.select(F.col("n").alias("q"), F.col("vector").alias("qv")), held.select(F.col("number").alias("id"), F.col("vector").alias("v")), k)
    rows = best.withColumnsRenamed({"q": "n", "id": "number"}).join(asked.select("n", "q"), "n").join(held.drop("vector", "embedding_text"), "number")
    return rows.select("q", "place", "score", "id", "source", "locator", "title", "section", "text")
