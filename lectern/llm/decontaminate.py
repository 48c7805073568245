"""Benchmark decontamination: find benchmark word windows in documents, and remove the words or the documents.

The benchmark's distinct windows (10 words; all words of a shorter item) are a hash set that goes to every task. Each
document's windows are hashed by whole-array operations, looked up, and every hit is verified word by word. The set is
broadcast in blocks of at most `most_windows` windows, whose number is counted first: a benchmark of any size is
covered by as many scans as it has blocks, whose findings are then merged by document.

Nulls: a null text, of a document or of an item, has no words. Items without words never occur. An item with a null id
marks words as hit but cannot be listed. Items with equal ids count once. Rows are kept one to one when the benchmark
fits one block; with more blocks, equal rows are merged by key and text and then brought back to every row. Empty
tables: no rows, or no hits.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm._words import ALNUM, slices, words_of
from lectern.llm.shared import aside, back, release, with_text

SIZE = 10
MOST_WINDOWS = 1_000_000
_BITS = 22


class WindowSet:
    """Hash set of windows: hashes by window size, and the items and words behind each hash."""

    def __init__(self, rows: list[tuple[int, int, bytes, list[int]]]):
        """rows: (size, hash as signed 64 bits, words joined by a space, item ids)."""
        self.behind: dict[tuple[int, int], list[tuple[bytes, list[int]]]] = defaultdict(list)
        for size, h, words, items in rows:
            self.behind[size, h & 0xFFFFFFFFFFFFFFFF].append((words, items))
        self.hashes = {}
        for size in {s for s, _ in self.behind}:
            self.hashes[size] = np.sort(np.array([h for s, h in self.behind if s == size], dtype=np.uint64))
        self.maybe = {}
        for size, hs in self.hashes.items():
            self.maybe[size] = np.zeros(1 << _BITS, dtype=bool)
            self.maybe[size][(hs >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def hits(self, words) -> Iterator[tuple[int, int, list[int]]]:
        """(first word, size, item ids) of every verified occurrence."""
        for size, table in self.hashes.items():
            at, h = words.windows(size)
            some = self.maybe[size][(h >> np.uint64(64 - _BITS)).astype(np.int64)]
            at, h = at[some], h[some]
            spot = np.minimum(np.searchsorted(table, h), len(table) - 1)
            real = table[spot] == h
            for k, hv in zip(at[real].tolist(), h[real].tolist(), strict=True):
                text = b" ".join(words.word(k + j) for j in range(size))
                for known, items in self.behind[size, hv]:
                    if known == text:
                        yield k, size, items


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """Distinct windows of the benchmark: size, hash, words, items (sorted distinct ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: list[tuple] = []
            for a, b, data, offsets in slices(batch.column(1)):
                w = words_of(data, offsets, ALNUM)
                counts = np.diff(w.bounds)
                for n in sorted({min(size, int(c)) for c in counts if c}):
                    at, h = w.windows(n)
                    doc = np.searchsorted(w.bounds, at, side="right") - 1
                    fits = (counts[doc] >= size) if n == size else (counts[doc] == n)
                    for k, hv, d in zip(at[fits].tolist(), h[fits].view(np.int64).tolist(), doc[fits].tolist(), strict=True):
                        out.append((n, hv, b" ".join(w.word(k + j) for j in range(n)), ids[a + d]))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.int64())], names=["size", "hash", "words", "item"])

    rows = benchmark.select(F.col(item).cast("long").alias("item"), F.col(text).alias("text")).mapInArrow(run, "size int, hash long, words binary, item long")
    return rows.groupBy("size", "hash", "words").agg(F.array_sort(F.collect_set("item")).alias("items"))


_FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.LongType())), T.StructField("hit_words", T.ArrayType(T.IntegerType())),
])


def _scan(df: DataFrame, text: str, keep: list[str], block: DataFrame) -> DataFrame:
    """`keep`, n_words, n_hit, items and hit_words (numbers of the hit words) against one block of windows."""
    rows = [(r["size"], r["hash"], bytes(r["words"]), list(r["items"])) for r in block.collect()]
    shared = df.sparkSession.sparkContext.broadcast(rows)
    schema = T.StructType([*(df.schema[k] for k in keep), *_FOUND.fields])
    built: list[WindowSet] = []
    chosen, at_text = with_text(df, keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            built.append(WindowSet(shared.value))
        # In small parts, so that neither side holds the texts of a large batch more than once.
        for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            n_words, n_hit, items, hit_words = [], [], [], []
            for a, b, data, offsets in slices(batch.column(at_text)):
                w = words_of(data, offsets, ALNUM)
                found: dict[int, tuple[set, set]] = defaultdict(lambda: (set(), set()))
                for k, size, ids in built[0].hits(w):
                    d = int(np.searchsorted(w.bounds, k, side="right")) - 1
                    first = k - int(w.bounds[d])
                    found[d][0].update(ids)
                    found[d][1].update(range(first, first + size))
                n_words += np.diff(w.bounds).tolist()
                for d in range(b - a):
                    i, hit = found.get(d, ((), ()))
                    n_hit.append(len(hit))
                    items.append(sorted(i))
                    hit_words.append(sorted(hit))
            arrays = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.int64())), pa.array(hit_words, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *arrays], names=schema.names)
        release()

    return chosen.mapInArrow(run, schema)


def find(
    df: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item: str = "item_id",
    item_text: str = "text", size: int = SIZE, most_windows: int = MOST_WINDOWS,
) -> DataFrame:
    """`keep`, n_words, n_hit, items (sorted ids) and hit_words for every document."""
    table = windows(benchmark, item, item_text, size)
    blocks = max(1, -(-table.count() // most_windows))
    if blocks == 1:
        return _scan(df, text, list(keep), table)
    keyed = df.select(*dict.fromkeys([*keep, text]), F.xxhash64(F.col(text)).alias("__key"))
    parts = None
    for i in range(blocks):
        part = _scan(keyed, text, [*keep, "__key"], table.filter(F.pmod(F.xxhash64("hash"), F.lit(blocks)) == i))
        parts = part if parts is None else parts.unionByName(part)
    merged = parts.groupBy(*keep, "__key").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("hit_words")))).alias("hit_words"),
    )
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*keep, "__key"]]
    joined = keyed.select(*keep, "__key").alias("a").join(merged.alias("b"), same)
    return joined.select(*(F.col(f"a.{k}") for k in keep), "n_words", F.size("hit_words").cast("long").alias("n_hit"), "items", "hit_words")


def digest(found: DataFrame) -> DataFrame:
    """The findings with the items as a count and a hash, and whether anything was hit."""
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.withColumns({
        "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(names, 256), "contaminated": F.col("n_hit") > 0,
    }).drop("items", "hit_words")


def clean(df: DataFrame, benchmark: DataFrame, text: str = "text", mode: str = "documents", **options) -> DataFrame:
    """The documents without those that hold a benchmark window (`documents`), or without the hit words (`spans`).

    A removed run of words goes with the characters between its words. All columns of `df` stay; a null text stays null.
    """
    if mode not in ("documents", "spans"):
        raise ValueError("mode is documents or spans")
    columns = df.columns
    df = aside(df, ["n_words", "n_hit", "items", "hit_words"])
    found = find(df, benchmark, text, tuple(df.columns), **options)
    if mode == "documents":
        return back(found.filter("n_hit = 0"), columns)
    # A word with what precedes it; the text after the last word is a part of its own.
    parts = F.regexp_extract_all(F.col(text), F.lit(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*(?:[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|$)"), F.lit(0))
    left = F.array_except(F.sequence(F.lit(0), F.size("__parts") - 1), "hit_words")
    kept = F.array_join(F.transform(left, lambda i: F.get("__parts", i)), "")
    found = found.withColumn("__parts", F.when(F.col("n_hit") > 0, parts))
    return back(found.withColumn(text, F.when(F.col("n_hit") > 0, kept).otherwise(F.col(text))), columns)


def registered(spark, sf_dir: str) -> DataFrame:
    from lectern.session import table

    return digest(find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def _oracle_words(table: str, key: str) -> str:
    return (
        f"SELECT {key} AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
        f"'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"
    )


ORACLE = f"""
WITH d AS ({_oracle_words('documents', 'doc_id')}),
b AS (SELECT k, w, least(10, len(w)) AS n FROM ({_oracle_words('benchmark', 'item_id')}) WHERE len(w) > 0),
bw AS (SELECT DISTINCT k AS item, n, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT k AS doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item AS VARCHAR), ',' ORDER BY CAST(item AS VARCHAR)) AS ids
          FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.k AS doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.k = words.doc_id LEFT JOIN items ON d.k = items.doc_id
"""
