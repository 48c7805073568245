"""Connected components of a graph of links, as DataFrame rounds.

First each task replaces its links by a forest of stars: its own components, found without a shuffle. Links that one small
task can hold, by count, are settled there in the same way. More of them go through rounds of the large-star and small-star steps: every node's neighbours are linked to the smallest one seen. Each step
is an aggregate (combined before it moves) and a join back whose large partitions Spark can split, so a node with
very many links does not gather them in one task. Each round's edges are cut off by a checkpoint. About log(n) rounds.
No link is dropped, and the components are the same by either way. Links of a node with itself add no node; no links
give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import cut, few


#: Rows of the smallest neighbours that are told to every task at most (16 bytes each); more are joined.
BROADCAST_ROWS = 500_000
#: Links (16 bytes each) that one task settles alone at most.
TASK_LINKS = 100_000
#: Links that a task gathers before it replaces them by a forest.
GATHER = 1 << 20


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (u, v) in ascending order, and the smallest node that each can reach."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return nodes, nodes[root]
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:  # until every node points to the root of its tree
            up = root[root]
            if (up == root).all():
                break
            root = up


def _forests(edges: DataFrame, with_roots: bool) -> DataFrame:
    """(u, v): every node of a task's links and the smallest it reaches there, of long partitions in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, held = [], [], 0

        def settled() -> tuple[np.ndarray, np.ndarray]:
            node, root = roots(np.concatenate(us), np.concatenate(vs))
            return (node, root) if with_roots else (node[node != root], root[node != root])

        for batch in batches:
            us.append(batch.column(0).to_numpy())
            vs.append(batch.column(1).to_numpy())
            held += batch.num_rows
            if held >= GATHER:
                node, root = settled()
                if len(node) > GATHER // 2:  # what is gathered does not fall together
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["u", "v"])
                    us, vs, held = [], [], 0
                else:
                    us, vs, held = [node], [root], len(node)
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in settled()], names=["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """edges: (u, v) with u > v, distinct, n of them. Large star links the larger neighbours of a node, small star the others."""
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
    least = few(both.groupBy("a").agg(F.min("b").alias("m")), n).withColumn("m", F.least("a", "m"))
    joined = both.join(F.broadcast(least) if 2 * n <= BROADCAST_ROWS else least, "a")
    if large:
        moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("b").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("a").alias("u"), F.col("m").alias("v")))
    return few(moved.filter("u != v").groupBy("u", "v").agg(F.lit(1).alias("one")).drop("one"), n)


def components(edges: DataFrame, most_rounds: int = 40, most_links: int | None = None) -> DataFrame:
    """(node, component) of every node with a link: the smallest node it can reach. `edges`: (u, v), any order.
    most_links: where the caller knows that there are no more links than so many."""
    if most_links is not None and most_links <= TASK_LINKS:
        proper = edges.filter("u != v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
        return cut(_forests(proper.coalesce(1), True).toDF("node", "component"))
    own = _forests(edges.filter("u != v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")), False)
    now = cut(own.groupBy("u", "v").agg(F.lit(1).alias("one")).drop("one"))
    n = now.count()
    if n <= TASK_LINKS:
        return cut(_forests(now.coalesce(1), True).toDF("node", "component"))
    now = few(now, n)
    before = None
    for _ in range(most_rounds):
        now = cut(_star(_star(now, True, n), False, n))
        # Stars only: every node has one link, and no centre is itself linked to a smaller one.
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        n = state[0]
        if before is not None and tuple(state) == tuple(before):
            centres = few(now.groupBy(F.col("v").alias("node")).agg(F.first("v").alias("component")), n)
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)
        before = state
    raise RuntimeError("components did not settle")
