"""Contexts of notices for a model: heads of all documents, then the paragraphs that matter, within a number of characters
that is lowered until the whole is within a budget of tokens.

What may stand in a context, in order, does not depend on its size: these pieces are made by column expressions, once. Only
the choice of a size goes on in Arrow batches, as it has to count tokens: a size is tried, and as long as the tokens are
too many it shrinks by the share by which they are, at least by `STEP`, down to `LEAST` characters. So it ends for every
notice after a number of tries that the first size bounds. Notices without documents have an empty context. Null texts are
empty, null types and ids are read as empty.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import strip

HEAD, SHORT, LEAST = 1200, 10, 2000
STEP, AIM = 0.85, 0.95
# Marks of pieces, and the notes below a context.
HEAD_MARK, PART_MARK = "·앞부분", "·관련문단"
CUT_NOTE, LEFT_NOTE = "[절단] 공고문 뒷부분이 길이 예산으로 잘렸다", "[미수록 문서] "


def pieces(docs: Column, terms: list[str], order: list[str] = ()) -> Column:
    """Array of (type, doc, front, body) of what may stand in a context: `doc` is the document's place, negative for heads.

    Documents come in the order of their types in `order`, then of their ids. A paragraph matters if it holds a term, is not
    very short, and does not stand in its document's head.
    """
    said = lambda c: F.coalesce(c, F.lit(""))
    rank = lambda t: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)).cast("array<string>"), t), F.lit(0)), F.lit(len(order) + 1))
    pool = F.array_sort(F.transform(docs, lambda d, i: F.struct(rank(said(d["type"])).alias("rank"), said(d["doc_id"]).alias("id"), i.alias("i"), said(d["type"]).alias("type"), said(d["text"]).alias("text"))))
    front = lambda d, mark: F.concat(F.lit("["), d["type"], F.lit(":"), d["id"], mark, F.lit("]\n"))

    def head(d, n):
        return F.struct(d["type"].alias("type"), (-n - 1).alias("doc"), front(d, F.lit(HEAD_MARK)).alias("front"), F.left(d["text"], F.lit(HEAD)).alias("body"))

    def parts(d, n):
        def matters(p):
            named = F.lit(False)
            for t in terms:
                named = named | F.contains(p["body"], F.lit(t))
            return named & (F.length(p["body"]) >= SHORT) & (strip(p["body"]) != "") & ~F.contains(F.left(d["text"], F.lit(HEAD)), p["body"])

        each = F.transform(F.split(d["text"], r"\n(?U:\s)*\n"), lambda p, i: F.struct(d["type"].alias("type"), n.alias("doc"), front(d, F.concat(F.lit(PART_MARK), (i + 1).cast("string"))).alias("front"), p.alias("body")))
        return F.filter(each, matters)

    return F.concat(F.transform(pool, head), F.flatten(F.transform(pool, parts)))


def taken(found: list[dict], most: int, left_out: dict[str, int] | None = None) -> str:
    """The context of at most so many characters (its notes, and the blank lines between pieces, not counted)."""
    room, parts, missing, full, cut = most, [], Counter(left_out or {}), set(), False
    for p in found:
        if p["doc"] in full:
            continue
        if room <= 0:
            missing[p["type"]] += 1
            full.add(p["doc"])
            continue
        space = room - len(p["front"])
        if space > 0 and p["body"]:
            cut |= len(p["body"]) > space
            parts.append(p["front"] + p["body"][:space])
            room -= len(parts[-1])
    if found and not parts:
        missing[found[0]["type"]] += 1
    notes = [CUT_NOTE] * cut + [LEFT_NOTE + ", ".join(f"{t} {n}건" for t, n in sorted(missing.items()))] * bool(missing)
    return "\n\n".join(["\n\n".join(parts), *notes]) if notes else "\n\n".join(parts)


def fitted(found: list[dict], count: Callable[[str], int], budget: int, most: int, left_out: dict[str, int] | None = None) -> tuple[str, int, int, int]:
    """(context, tokens, size, tries) of the first size that is within the budget, or of the first at or below `LEAST`."""
    for tries in range(1, 1 + max(1, math.ceil(math.log(max(most, LEAST) / LEAST, 1 / STEP)) + 2)):
        text = taken(found, most, left_out)
        tokens = count(text)
        if tokens <= budget or most <= LEAST:
            break
        most = int(most * min(STEP, AIM * budget / tokens))
    return text, tokens, most, tries


def contexts(notices: DataFrame, terms: list[str], count: Callable[[str], int], budget: int, most: int = 12_000, order: list[str] = ()) -> DataFrame:
    """id, context, tokens, size and tries of notices (id, docs, and `dropped`, counts of left-out documents by type, if there).

    `count` says how many tokens a model makes of a context, with all that is put around it.
    """
    dropped = F.col("dropped") if "dropped" in notices.columns else F.lit(None)
    rows = notices.select("id", pieces(F.col("docs"), terms, order).alias("pieces"), dropped.cast("map<string,int>").alias("dropped"))
    schema = T.StructType([notices.schema["id"], T.StructField("context", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("tokens", "size", "tries"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out = [fitted(p or [], count, budget, most, dict(d or {})) for p, d in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64())))], names=schema.names)

    return rows.mapInArrow(run, schema)
