"""Packing documents into fixed windows by Karmarkar-Karp multiway differencing.

1. Tokens. A document's ids (and its end id) fill whole windows first; what is left over is one shorter piece. Texts
   of plain characters are tokenised in bulk by whole-array operations, word by distinct word; all others by the library.
2. Groups. The left-over pieces (a few numbers each) are dealt evenly into groups of about `group_pieces`; a group is
   all that one task holds, however the documents are distributed.
3. Differencing, in each group: every piece starts as a partition into k windows, one of them used. The two partitions
   with the largest imbalance merge, the fullest window of one with the emptiest of the other, until one partition
   is left. k starts at the group's tokens over the capacity, and rises whenever the fullest window is over it.

Nulls: a null text is empty, so it has the end id alone. Rows are kept one to one, repeated ids included. Empty table:
no pieces. Every id lies in exactly one piece; no window is over the capacity.
"""

from __future__ import annotations

import functools
import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import _bpe
from lectern.llm._words import slices
from lectern.llm.shared import cut, release, small_batches

MODEL = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 2
GROUP_PIECES = 1000
_loaded: dict[str, tuple] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers; plain texts in bulk, the others by the library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The bulk path knows the rules of one file; texts of any other go to the library.
        self.merges = _bpe.Merges(path) if _bpe.rules(path) == _bpe.rules(default_model()) else None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        texts = texts.fill_null("")
        if self.merges is None:
            for at in range(0, len(texts), 256):
                yield from self.library(texts.slice(at, 256).to_pylist())
            return
        named = functools.reduce(pc.or_, (pc.match_substring(texts, s) for s in self.special)).to_numpy(zero_copy_only=False)
        for a, b, data, offsets in slices(texts):
            bulk = _bpe.plain(data, offsets) & ~named[a:b]
            run = texts.slice(a, b - a)
            out: list[bytes] = [b""] * (b - a)
            if not bulk.all():
                other = np.flatnonzero(~bulk)
                for i, ids in zip(other.tolist(), self.library(run.take(pa.array(other)).to_pylist()), strict=True):
                    out[i] = ids
                run = run.filter(pa.array(bulk))
            for _, _, data, offsets in slices(run, max(1, len(data))):
                ids, bounds = _bpe.encode(self.merges, data, offsets, self.library)
                flat, ends = ids.tobytes(), (4 * bounds).tolist()
                for n, i in enumerate(np.flatnonzero(bulk).tolist()):
                    out[i] = flat[ends[n] : ends[n + 1]]
            yield from out


def _encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


PIECE = T.StructType([
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()),
])


def pieces(df: DataFrame, text: str, key: str, model: str | None, capacity: int, end_id: int = END_ID) -> DataFrame:
    """`key`, start, length, ids_crc32 and doc_tokens of every piece: whole windows, then what is left over."""
    path = model or default_model()
    schema = T.StructType([df.schema[key], *PIECE.fields])
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            rows, start, length, crc, total = [], [], [], [], []
            for i, ids in enumerate(encoder.encode(batch.column(1))):
                ids += end
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    rows.append(i)
                    start.append(s)
                    length.append(min(capacity, n - s))
                    crc.append(zlib.crc32(ids[4 * s : 4 * (s + capacity)]))
                    total.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names=schema.names)
        release()

    return df.select(key, F.col(text).alias("__text")).mapInArrow(run, schema)


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: the numbers of the pieces in each of k windows, with near-equal sums."""
    if k == 1:
        return [list(range(len(sizes)))]
    heap: list[tuple] = []
    for i, n in enumerate(sizes):
        # Sparse partition: only used windows are listed, fullest first; the others hold nothing.
        heap.append((-n, i, [(n, [i])]))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        free = k - len(a)
        merged = a + b[:free]  # b's fullest windows go to a's empty ones
        for j, (n, items) in enumerate(b[free:]):
            # then on, b's next fullest goes to a's emptiest
            m, own = merged[len(a) - 1 - j]
            merged[len(a) - 1 - j] = (m + n, own + items)
        merged.sort(key=lambda x: -x[0])
        low = merged[-1][0] if len(merged) == k else 0
        if low:  # only differences matter from here on; the sums are kept aside in the items
            merged = [(n - low, items) for n, items in merged]
        heapq.heappush(heap, (-(merged[0][0]), serial, merged))
        serial += 1
    return [items for _, items in heap[0][2]]


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Pieces dealt to as few near-equal windows as hold them; the count rises while one is over capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = differencing(sizes, k)
        if max((sum(sizes[i] for i in p) for p in parts), default=0) <= capacity:
            return [p for p in parts if p]
        k += 1


def pack(
    df: DataFrame, text: str = "text", key: str = "doc_id", model: str | None = None, capacity: int = CAPACITY,
    end_id: int = END_ID, group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """One row per piece: `key`, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    The pieces (numbers, no tokens) are cut off by a checkpoint, so that counting and dealing them do not tokenise twice.
    """
    spark = df.sparkSession
    with small_batches(spark):
        made = cut(pieces(df, text, key, model, capacity, end_id).withColumn("__id", F.monotonically_increasing_id()))
    rest = made.filter(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_pieces))
    dealt = rest.withColumn("__group", F.pmod(F.xxhash64("__id"), F.lit(groups)))
    schema = T.StructType([*made.drop("__id").schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__id").reset_index(drop=True)
        number, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        sizes = pdf["length"].tolist()
        for n, part in enumerate(windows(sizes, capacity)):
            at = 0
            for i in sorted(part):
                number[i], offset[i] = n, at
                at += sizes[i]
        pdf["sequence_id"] = pdf["__group"].astype("int64") * (1 << 24) + number
        pdf["offset"] = offset
        return pdf[schema.names]

    full = made.filter(F.col("length") >= capacity).select("*", (-1 - F.col("__id")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).select(schema.names)
    return full.unionByName(dealt.repartition(min(groups, max(1, spark.sparkContext.defaultParallelism * 64)), "__group").groupBy("__group").applyInPandas(deal, schema))


def registered(spark, sf_dir: str) -> DataFrame:
    from lectern.session import table

    return pack(table(spark, sf_dir, "documents"))
