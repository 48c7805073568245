"""Ordered data: line offsets, islands, packing under a budget, sweeps over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import LINE_END, let, running


def lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line (from 0), body (without its end), start: code-point offset of each line. Lines end as `LINE_END` says;
    behind a text's last line end stands an empty line.

    Offsets come from an array fold within the row, so a document's lines need no shuffle.
    """
    parts = pieces(F.col(text))
    return df.select(key, F.posexplode(parts).alias("line", "z")).select(key, "line", F.regexp_replace("z.raw", f"(?:\r\n|{_ENDS})$", "").alias("body"), "z.start")


_ENDS = r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def pieces(text: Column) -> Column:
    """Array of (raw, start): a text's lines with their ends, and where they start."""
    return let(F.split(text, LINE_END), lambda p: F.zip_with(p, running(F.transform(p, F.length)), lambda raw, start: F.struct(raw.alias("raw"), start.alias("start"))))


def islands(df: DataFrame, key: str, position: str, reach: int = 0) -> DataFrame:
    """Ranges (first, last, n) of positions that are adjacent once each reaches `reach` to either side."""
    spread = df.select(key, F.explode(F.sequence(F.greatest(F.col(position) - reach, F.lit(0)), F.col(position) + reach)).alias("p")).distinct()
    w = W.partitionBy(key).orderBy("p")
    marked = spread.withColumn("fresh", F.coalesce((F.col("p") - F.lag("p").over(w) > 1).cast("int"), F.lit(1)))
    numbered = marked.withColumn("island", F.sum("fresh").over(w))
    return numbered.groupBy(key, "island").agg(F.min("p").alias("first"), F.max("p").alias("last"), F.count("*").alias("n"))


def greedy(items: Column, budget: int) -> Column:
    """Greedy packing with skips over an ordered array of struct(id, size): the ids taken.

    A later, smaller item may still fit after one that did not; not a running sum, hence a fold.
    """
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("ids"))
    return F.aggregate(
        items, start,
        lambda a, x: F.when(a["used"] + x["size"] <= budget, F.struct((a["used"] + x["size"]).alias("used"), F.array_append(a["ids"], x["id"]).alias("ids"))).otherwise(a),
        lambda a: a["ids"],
    )


def in_flight(events: DataFrame, by: str, at: str, change: str, tie: str) -> DataFrame:
    """Running sum of +1/-1 changes in order of time."""
    return events.withColumn("inflight", F.sum(change).over(W.partitionBy(by).orderBy(at, tie).rowsBetween(W.unboundedPreceding, 0)))
