"""Candidate segments of a notice: lines around pattern hits, scored, packed under a budget, in document order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import let

_SEGMENT = "array<struct<down:int,place:int,start:int,doc_id:string,end:int,text:string>>"


def around(doc: Column, place: Column, primary: str, secondary: str, reach: int, both: bool) -> Column:
    """Segments of one document: runs of lines within `reach` of a hit of the primary (or, with `both`, either) pattern."""
    lines = F.split(doc["text"], r"(?<=\n)")
    hit = lambda l: l.rlike(f"(?i){primary}") | (l.rlike(f"(?i){secondary}") if both else F.lit(False))
    hits = F.transform(lines, hit)
    near = let(
        F.struct(lines.alias("lines"), hits.alias("hits")),
        lambda z: F.transform(z["lines"], lambda l, i: F.struct(l.alias("text"), F.exists(F.slice(z["hits"], F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach)) + reach + 1), lambda h: h).alias("near"))),
    )

    def scored(start, text):
        down = -(10 * F.regexp_count(text, F.lit(f"(?i){primary}")) + 2 * F.regexp_count(text, F.lit(f"(?i){secondary}")))
        return F.struct(down.cast("int").alias("down"), place.cast("int").alias("place"), start.alias("start"), doc["doc_id"].alias("doc_id"), (start + F.length(text)).alias("end"), text.alias("text"))

    def step(a, x):
        closes = ~x["near"] & (a["now"] != "")
        return F.struct(
            (a["at"] + F.length(x["text"])).alias("at"), F.when(x["near"] & (a["now"] == ""), a["at"]).otherwise(a["start"]).alias("start"),
            F.when(x["near"], F.concat(a["now"], x["text"])).otherwise(F.lit("")).alias("now"),
            F.when(closes, F.array_append(a["done"], F.struct(a["start"].alias("start"), a["now"].alias("text")))).otherwise(a["done"]).alias("done"),
        )

    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("start"), F.lit("").alias("now"), F.array().cast("array<struct<start:int,text:string>>").alias("done"))
    runs = F.aggregate(near, begin, step, lambda a: F.when(a["now"] != "", F.array_append(a["done"], F.struct(a["start"].alias("start"), a["now"].alias("text")))).otherwise(a["done"]))
    return F.transform(F.filter(runs, lambda r: F.trim(F.regexp_replace(r["text"], r"\s", "")) != ""), lambda r: scored(r["start"], r["text"]))


def select(docs: Column, primary: str, secondary: str, reach: int = 2, both: bool = False, budget: int = 1800) -> Column:
    """(segments, truncated). Best first: what does not fit is skipped, unless nothing is taken yet: then it is cut.
    `truncated`: fewer segments than there were."""
    found = F.flatten(F.transform(docs, lambda d, i: around(d, i, primary, secondary, reach, both)))
    ranked = F.array_sort(found).cast(_SEGMENT)

    def step(a, s):
        left = budget - a["used"]
        fits, first = F.length(s["text"]) <= left, F.size(a["taken"]) == 0
        part = F.substring(s["text"], 1, budget)
        cut = F.struct(s["down"].alias("down"), s["place"].alias("place"), s["start"].alias("start"), s["doc_id"].alias("doc_id"), (s["start"] + F.length(part)).alias("end"), part.alias("text"))
        return (
            F.when((left > 0) & (fits | first), F.struct((a["used"] + F.least(F.length(s["text"]), left)).alias("used"), F.array_append(a["taken"], cut).alias("taken"))).otherwise(a)
        )

    begin = F.struct(F.lit(0).alias("used"), F.array().cast(_SEGMENT).alias("taken"))
    in_order = lambda t: F.array_sort(F.transform(t, lambda s: F.struct(s["doc_id"].alias("doc_id"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"))))
    return let(ranked, lambda r: F.aggregate(r, begin, step, lambda a: F.struct(in_order(a["taken"]).alias("segments"), (F.size(a["taken"]) < F.size(r)).alias("truncated"))))
