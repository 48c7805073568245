"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with cosine >= t lie within epsilon = sqrt(2 - 2t) of each other, and so do their projections.

1. Equal vectors become one, with a count: a crowd of copies is combined before it moves.
2. Principal directions come from the matrix of second moments, summed over all vectors (d x d numbers, whatever the
   input). The leading projections, cut into cells of width epsilon, give each vector its place in grid order.
3. The order is cut into sequence intervals of equal length. Two intervals are joined unless the boxes around their
   projections are provably more than epsilon apart; intervals meet by the cell of their first projection.
4. Within a task the two intervals are halved again and again, and blocks that are provably distant are skipped; what
   is left is compared in double precision.

A task returns, for each vector, its number of links and one representative of what it hangs together with: no pairs.
What is linked is then brought together by star rounds. Vectors that are null, zero, or hold null or non-finite
components link with nothing, nor do vectors of different lengths. Ids are taken as unique (rows with an equal id are
one node). Empty table: empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.components import components
from lectern.llm.shared import cut

THRESHOLD = 0.9
LEADING = 16
INTERVAL = 8192
_LEAF = 128
_SLACK = 1e-6


def usable(v: Column) -> Column:
    """Not null or zero, and only finite components."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _moments(rows: DataFrame, d: int) -> np.ndarray:
    """Sum of outer products of the unit vectors; d x d sums per task, added up by Spark."""

    def run(batches):
        total = np.zeros((d, d))
        for batch in batches:
            x = _unit(batch.column(0), d)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(total.ravel())], names=["at", "x"])

    out = np.zeros(d * d)
    for r in rows.select("v").mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[r["at"]] = r["x"]
    return out.reshape(d, d)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, d)


def _unit(column: pa.Array, d: int) -> np.ndarray:
    x = _matrix(column, d)
    return x / np.linalg.norm(x / (s := np.abs(x).max(axis=1, keepdims=True)), axis=1)[:, None] / s if len(x) else x


def _near(xa, pa_, xb, pb, epsilon: float, threshold: float, same: bool, emit) -> None:
    """Halves both sides until blocks are distant or small; `emit` gets a small block's places and which of its pairs are
    linked (of a block with itself both ways)."""
    stack = [(0, len(xa), 0, len(xb))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        if same and b1 <= a0:
            continue
        if a0 >= a1 or b0 >= b1:
            continue
        pa1, pb1 = pa_[a0:a1], pb[b0:b1]
        gap = np.maximum(0, np.maximum(pa1.min(0) - pb1.max(0), pb1.min(0) - pa1.max(0)))
        if (gap * gap).sum() > (epsilon + _SLACK) ** 2:
            continue
        if a1 - a0 <= _LEAF and b1 - b0 <= _LEAF:
            linked = xa[a0:a1] @ xb[b0:b1].T >= threshold
            if same:
                linked &= np.arange(a0, a1)[:, None] < np.arange(b0, b1)[None, :]
            if linked.any():
                emit(a0, a1, b0, b1, linked)
        elif a1 - a0 >= b1 - b0:
            mid = (a0 + a1) // 2
            stack += [(a0, mid, b0, b1), (mid, a1, b0, b1)]
        else:
            mid = (b0 + b1) // 2
            stack += [(a0, a1, b0, mid), (a0, a1, mid, b1)]


def _held(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, column), at most one for each row and column, that hang together exactly as a block's links do."""
    far = linked.shape[0]
    row = np.arange(far)
    while True:
        column = np.where(linked, row[:, None], far).min(0)
        new = np.minimum(row, np.where(linked, column[None, :], far).min(1))
        if (new == row).all():
            break
        row = new
    # A column of each group stands for it: one that its first row is linked with.
    first = linked[:, :].argmax(1)
    i = np.flatnonzero(linked.any(1))
    j = np.flatnonzero(column < far)
    return np.concatenate([i, column[j]]), np.concatenate([first[row[i]], j])


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position each position hangs together with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _join(rows: DataFrame, d: int, threshold: float, leading: int, interval: int) -> DataFrame:
    """rows: id, n (copies), v (usable, of length d). (id, links, root): links by copies, and what it hangs together with."""
    epsilon = math.sqrt(max(0.0, 2 - 2 * threshold))
    width = max(epsilon, 1e-3)
    values, vectors = np.linalg.eigh(_moments(rows, d))
    axes = np.ascontiguousarray(vectors[:, np.argsort(-values)[: min(leading, d)]])
    k = axes.shape[1]

    def place(batches):
        for batch in batches:
            p = _unit(batch.column(2), d) @ axes
            cells = np.floor(p[:, : min(k, 6)] / width).astype(np.int64)
            key = np.zeros(len(p), np.int64)
            for c in cells.T:
                key = key * 4096 + (c + 2048)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, k), pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), flat, pa.array(key)], names=["id", "n", "v", "p", "key"])

    width = max(width, 2.0 / 2000)
    placed = rows.select("id", "n", "v").mapInArrow(place, "id long, n long, v array<double>, p array<double>, key long")
    ordered = cut(placed.orderBy("key", "id").withColumn("at", F.monotonically_increasing_id()))
    # The number of a row in the whole order: rows of earlier partitions, and its number in its own.
    sizes = sorted((r["part"], r["count"]) for r in ordered.groupBy(F.shiftright("at", 33).alias("part")).count().collect())
    first, offsets = 0, []
    for part, count in sizes:
        offsets.append((part, first))
        first += count
    spark = rows.sparkSession
    starts = spark.createDataFrame(offsets, "part long, first long")
    size = max(256, min(interval, -(-first // 8)))
    rank = F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1)
    blocks = cut(ordered.withColumn("part", F.shiftright("at", 33)).join(starts, "part").withColumn("block", F.floor(rank / size)).select("id", "n", "v", "p", "block"))
    box = blocks.groupBy("block").agg(*(f(F.col("p")[i]).alias(f"{name}{i}") for i in range(k) for name, f in (("lo", F.min), ("hi", F.max))))
    cell = lambda c: F.floor(c / F.lit(epsilon + _SLACK))
    left = box.select(F.col("block").alias("a"), *(F.col(f"{s}{i}").alias(f"a_{s}{i}") for i in range(k) for s in ("lo", "hi"))).withColumn("cell", F.explode(F.sequence(cell(F.col("a_lo0")), cell(F.col("a_hi0")))))
    right = box.withColumnRenamed("block", "b").withColumn("cell", F.explode(F.sequence(cell(F.col("lo0")) - 1, cell(F.col("hi0")) + 1)))
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"a_lo{i}") - F.col(f"hi{i}"), F.col(f"lo{i}") - F.col(f"a_hi{i}")), 2) for i in range(k)), F.lit(0.0))
    pairs = left.join(right, "cell").filter((F.col("a") <= F.col("b")) & (gap <= (epsilon + _SLACK) ** 2)).select("a", "b").distinct()
    one = pairs.join(blocks.withColumnRenamed("block", "a"), "a").select("a", "b", F.lit(False).alias("second"), "id", "n", "v", "p")
    two = pairs.filter("a < b").join(blocks.withColumnRenamed("block", "b"), "b").select("a", "b", F.lit(True).alias("second"), "id", "n", "v", "p")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        second = table["second"].to_numpy()
        ids, copies = table["id"].to_numpy(), table["n"].to_numpy()
        x = _unit(table["v"].combine_chunks() if isinstance(table["v"], pa.ChunkedArray) else table["v"], d)
        p = np.asarray(table["p"].combine_chunks().flatten() if isinstance(table["p"], pa.ChunkedArray) else table["p"].flatten()).reshape(-1, k)
        sides = [np.flatnonzero(~second), np.flatnonzero(second)]
        sides = [s[np.lexsort((ids[s], *(np.floor(p[s, i] / width) for i in range(min(k, 6) - 1, -1, -1))))] for s in sides]
        same = not len(sides[1])
        a, b = sides[0], sides[0] if same else sides[1]
        links, found = np.zeros(len(ids), np.int64), []

        def emit(a0, a1, b0, b1, linked):
            i, j = a[a0:a1], b[b0:b1]
            links[i] += linked @ copies[j]
            links[j] += copies[i] @ linked
            row, column = _held(linked)
            found.append((i[row], j[column]))

        _near(x[a], p[a], x[b], p[b], epsilon, threshold, same, emit)
        if not found:
            return pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        i, j = (np.concatenate(z) for z in zip(*found, strict=True))
        root = _roots(len(ids), i, j)
        some = np.flatnonzero(links)
        return pa.table({"id": ids[some], "links": links[some], "root": ids[root[some]]})

    return one.unionByName(two).groupBy("a", "b").applyInArrow(compare, "id long, links long, root long")


def link(
    df: DataFrame, vector: str = "embedding", key: str = "vec_id", threshold: float = THRESHOLD, leading: int = LEADING, interval: int = INTERVAL,
) -> DataFrame:
    """`key`, n_links, component_id and kept for every row."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).withColumn("ok", usable(F.col("v")))
    fine = rows.filter(F.col("ok") & F.col("id").isNotNull()).select("id", "v")
    distinct = cut(fine.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    parts = []
    for r in distinct.select(F.size("v").alias("d")).distinct().collect():  # lengths that occur, one in a sound table
        found = _join(distinct.filter(F.size("v") == r["d"]), r["d"], threshold, leading, interval)
        parts.append(cut(found))
    alone = rows.filter(~F.col("ok") | F.col("id").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if not parts:
        return alone.select(F.col("id").alias(key), "n_links", "component_id", F.lit(True).alias("kept"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    member = components(found.select(F.col("id").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("id"), "component")
    known = distinct.join(links, "id", "left").join(member, "id", "left").select(
        "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"),
    )
    joined = fine.join(known, "v").select("id", "n_links", "component_id")
    return joined.unionByName(alone).select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def registered(spark, sf_dir: str) -> DataFrame:
    from lectern.session import table

    return link(table(spark, sf_dir, "embeddings"))
