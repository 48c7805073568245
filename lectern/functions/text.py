"""Text functions as column expressions; Python only where offsets or normal forms are not expressible."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Units and patterns of Korean money amounts and of numbered headings. Java keeps the mark of a heading in a
# group of its own, as a level depends on it.
UNITS = {"조": 10**12, "억": 10**8, "천만": 10**7, "백만": 10**6, "십만": 10**5, "만": 10**4, "천": 10**3, "백": 10**2}
NUMBER = r"\d[\d,]*(?:\.\d+)?"
UNIT = r"조|억|천만|백만|십만|만|천|백"
MONEY = rf"(?<![\d.,])(?:(?:{NUMBER}\s*(?:{UNIT})\s*)+(?:{NUMBER}\s*)?원?|{NUMBER}\s*원)"
NUMBERED = r"^(제?\d+|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+)([.、):장절])"
#: A line ends behind each of these, and behind a carriage return that no line feed follows.
LINE_END = r"(?<=[\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029])|(?<=\r)(?!\n)"
EVIDENCE = 500
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())]))


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once a row, however often it is used (also within lambdas)."""
    return F.get(F.transform(F.array(value), use), 0)


def collapse(c: Column) -> Column:
    """Unicode white space as single spaces, trimmed: the key of equal texts."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


#: All white space of Unicode, and the separators that Python strips.
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(c: Column) -> Column:
    """Without any white space at either end."""
    return F.btrim(c, F.lit(WHITE))


def safe(c: Column) -> Column:
    """NULL for what a spreadsheet would read as a formula."""
    return F.when(~c.rlike("^[=+@]"), c)


def window(text: Column, at: Column, before: int = 180, size: int = EVIDENCE) -> Column:
    """At most `size` characters that begin `before` characters ahead of code point `at` (from 0)."""
    start = F.greatest(at - before, F.lit(0))
    return F.substr(text, start + 1, F.lit(size))


def levels(flat: Column) -> Column:
    """Numbering level of a heading without white space: 0 for chapters and Roman numbers, 2 for `1)`, 1 for other
    numbers, NULL without one. Lower levels hold higher ones."""
    number, mark = F.regexp_extract(flat, NUMBERED, 1), F.regexp_extract(flat, NUMBERED, 2)
    roman = (mark == "장") | ~F.regexp_replace(number, "^제", "").rlike(r"^\d+$")
    return F.when(number == "", F.lit(None).cast("int")).when(roman, 0).when(mark == ")", 2).otherwise(1)


def money(c: Column) -> Column:
    """Sum of number x unit over the parts of an amount, exact, cut to a whole number; NULL without digits."""
    names = "|".join(sorted(UNITS, key=len, reverse=True))
    pattern = rf"([0-9][0-9,]*(?:\.[0-9]+)?)\s*({names})?"
    numbers, units = F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.regexp_extract_all(c, F.lit(pattern), F.lit(2))
    table = F.create_map(*(F.lit(x) for k, v in UNITS.items() for x in (k, v)))
    part = lambda n, u: (F.regexp_replace(n, ",", "").cast("decimal(24,6)") * F.coalesce(table[u], F.lit(1)).cast("decimal(13,0)")).cast("decimal(38,6)")
    total = F.aggregate(F.zip_with(numbers, units, part), F.lit(0).cast("decimal(38,6)"), lambda s, x: (s + x).cast("decimal(38,6)"))
    return F.when(F.size(numbers) > 0, F.floor(total).cast("bigint"))


def amount(c: Column) -> Column:
    """A metadata amount: a number, digits with commas, or a whole money string; NULL for other text, and unless positive.
    A number with a fraction is cut; commas in it make it text."""
    flat = F.trim(c)
    digits, number = F.regexp_replace(flat, ",", ""), r"^\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$"
    value = F.when(digits.rlike(r"^\d+$"), digits.try_cast("bigint")).when(flat.rlike(number), flat.try_cast("double").try_cast("bigint")).when(flat.rlike(f"^{MONEY}$"), money(flat))
    return F.when(value > 0, value)


def running(sizes: Column) -> Column:
    """Sum of all sizes before each one. Folded in blocks, so that no long list is copied for each of its elements."""
    zero = F.lit(0).cast("bigint")

    def inner(block, at):
        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast("array<bigint>").alias("out")), lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"]).alias("out")))

    def fold(z):
        def outer(a, i):
            return let(inner(F.slice(z, i * 256 + 1, 256), a["at"]), lambda r: F.struct(r["at"].alias("at"), F.array_append(a["out"], r["out"]).alias("out")))

        blocks = F.sequence(F.lit(0), F.floor((F.size(z) - 1) / 256).cast("int"))
        start = F.struct(zero.alias("at"), F.array().cast("array<array<bigint>>").alias("out"))
        return F.when(F.size(z) > 0, F.aggregate(blocks, start, outer, lambda a: F.flatten(a["out"]))).when(F.size(z) == 0, F.array().cast("array<bigint>"))

    return let(sizes, fold)


def tokens(c: Column) -> Column:
    """Lower-case words, then the character bigrams of each word."""
    flat = F.lower(c)
    words = F.regexp_extract_all(flat, F.lit(r"[a-z0-9]+"), F.lit(0))
    pairs = F.regexp_extract_all(flat, F.lit(r"(?=([a-z0-9]{2}))"), F.lit(1))
    return F.concat(words, pairs)


def escape_markdown(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition."""
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@cache
def spans(pattern: str):
    """All matches of a Python pattern with code-point offsets."""
    found = re.compile(pattern)

    @F.pandas_udf(_SPANS)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"start": m.start(), "end": m.end(), "text": m[0]} for m in found.finditer(t)], na_action="ignore")

    return run


@F.pandas_udf(T.StringType())
def source_slice(text: pd.Series, start: pd.Series, size: pd.Series) -> pd.Series:
    """The source's own characters behind a piece of its collapsed text (each run of white space being one character)."""
    piece = re.compile(r"\s+|\S")

    def one(t, a, n):
        if t is None or a != a:
            return None
        spans = [m.span() for m in islice(piece.finditer(t), int(a), int(a + n))]
        return t[spans[0][0] : spans[-1][1]] if spans else ""

    return pd.Series([one(*x) for x in zip(text, start, size, strict=True)], dtype=object)


def _lost(part: str, whole: str) -> int | None:
    """Place of the first character of `part` that is not found in `whole` behind the ones before it."""
    at = 0
    for i, x in enumerate(part):
        at = whole.find(x, at) + 1
        if not at:
            return i
    return None


@F.arrow_udf(T.LongType())
def first_stray(clean: pa.Array, source: pa.Array) -> pa.Array:
    """Place in a cleaned text of the first character that shows that more was done than deleting: from which on the text is no
    subsequence of its source. NULL where nothing was put in or moved, and where either is NULL. One row at a time becomes text."""
    pairs = ((c.as_py(), s.as_py()) for c, s in zip(clean, source, strict=True))
    return pa.array([None if c is None or s is None else _lost(c, s) for c, s in pairs], pa.int64())


#: Characters whose places are gathered at once, of one text at least.
PLACES = 1 << 20
_MAPPED = pa.struct([("text", pa.string()), ("at", pa.list_(pa.int32()))])
#: White space as RE2, and so SQL, has it in `\s`.
PLAIN = "\t\n\f\r "


def _gaps(white: str) -> np.ndarray:
    """Whether a code point is one of `white`; the last entry stands for all beyond."""
    table = np.zeros(ord(max(white)) + 2, dtype=bool)
    table[[ord(c) for c in white]] = True
    return table


def _codes(t: str, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's code points, and whether each is a gap."""
    codes = np.frombuffer(t.encode("utf-32-le"), "<u4")
    return codes, gaps[np.minimum(codes, len(gaps) - 1)]


def _mapped(t: str, gaps: np.ndarray) -> tuple[str, np.ndarray]:
    """A collapsed text, and where each of its characters stands in the text; a space stands for the last of its run."""
    codes, gap = _codes(t, gaps)
    kept = ~gap
    kept[:-1] |= gap[:-1] & ~gap[1:]
    if len(t):
        kept[: int(gap.argmin())] = False
    at = np.flatnonzero(kept).astype(np.int32)
    return np.where(gap[at], np.uint32(32), codes[at]).astype("<u4").tobytes().decode("utf-32-le"), at


def _collapsing(white: str):
    gaps = _gaps(white)

    @F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("at", T.ArrayType(T.IntegerType()))]))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """Collapsed text, and the original offset of each of its characters. A few texts at a time are in memory."""

        def told(texts: list, places: list) -> pa.Array:
            ends = pa.array(np.cumsum([0, *map(len, places)]), pa.int32())
            return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(places)))], fields=list(_MAPPED))

        for batch in batches:
            texts, places, gathered = [], [], 0
            for x in batch:
                text, at = _mapped(x.as_py() or "", gaps)
                texts.append(text)
                places.append(at)
                gathered += len(at)
                if gathered >= PLACES:
                    yield told(texts, places)
                    texts, places, gathered = [], [], 0
            if texts:
                yield told(texts, places)

    return run


collapse_with_map = _collapsing(WHITE)
#: The same for `PLAIN` white space.
collapse_plain_with_map = _collapsing(PLAIN)

#: Places in one bitmap; Spark's aggregates of bitmaps have as many.
BITS = 1 << 15
_PIECE = T.StructType([T.StructField(k, t) for k, t in (("piece", T.IntegerType()), ("first", T.LongType()), ("n", T.LongType()), ("offsets", T.LongType()), ("gaps", T.BinaryType()), ("nexts", T.BinaryType()))])


def _pieces(t: str, gaps: np.ndarray) -> Iterator[dict]:
    gap = _codes(t, gaps)[1] if t else np.zeros(1, dtype=bool)
    follows = np.append(~gap[1:], False)
    for k in range(0, len(gap), BITS):
        own = np.flatnonzero(~gap[k : k + BITS]) + k
        bits = {name: np.packbits(x[k : k + BITS]).tobytes() for name, x in (("gaps", gap), ("nexts", follows))}
        yield {"piece": k // BITS, "first": int(own[0]) if len(own) else None, "n": len(own), "offsets": int(own.sum()), **bits}


@F.arrow_udf(T.ArrayType(_PIECE))
def plain_pieces(text: pa.Array) -> pa.Array:
    """A text's places in pieces of `BITS`: the first of a character other than `PLAIN` white space, how many such there are and the sum
    of their places, and as bitmaps which places are white space and which have another character next. An empty text is one
    character, as in SQL."""
    gaps = _gaps(PLAIN)
    kind = pa.list_(pa.struct([("piece", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("offsets", pa.int64()), ("gaps", pa.binary()), ("nexts", pa.binary())]))
    return pa.array([None if x is None else list(_pieces(x, gaps)) for x in (v.as_py() for v in text)], kind)


@F.arrow_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("offsets", T.LongType())]))
def gap_ends(gaps: pa.Array, nexts: pa.Array, piece: pa.Array, first: pa.Array) -> pa.Array:
    """How many places behind `first` are set in both bitmaps of a piece, and their sum."""

    def one(g, x, k, f):
        both = np.frombuffer(g, np.uint8) & np.frombuffer(x, np.uint8)
        at = np.flatnonzero(np.unpackbits(both)) + k * BITS
        at = at[at > f]
        return {"n": len(at), "offsets": int(at.sum())}

    rows = (tuple(v.as_py() for v in row) for row in zip(gaps, nexts, piece, first, strict=True))
    return pa.array([one(*row) for row in rows], pa.struct([("n", pa.int64()), ("offsets", pa.int64())]))


# What a clean-up of statutes deletes.
AMENDED = (r"<(?:개정|신설|전문개정|제목개정|본조신설|종전)[^>]*>", r"\[(?:전문개정|제목개정|본조신설|종전)[^\]]*\]", r"<!\[CDATA\[", r"\]\]>")


def clean_statute(c: Column, deletions: tuple[str, ...] = AMENDED) -> Column:
    """Without the deletions, in their order, blank lines and white space at line ends; NULL stays NULL."""
    for pattern in deletions:
        c = F.regexp_replace(c, pattern, "")
    kept = F.transform(F.split(c, LINE_END), lambda x: F.rtrim(x, F.lit(WHITE)))
    return strip(F.array_join(F.filter(kept, lambda x: x != ""), "\n"))


@F.arrow_udf(T.IntegerType())
def foreign(source: pa.Array, cleaned: pa.Array) -> pa.Array:
    """Proof that a clean-up only deleted: NULL where `cleaned` is a subsequence of `source`, else the first code point of
    `cleaned` that cannot be found behind the ones before it. A null source holds nothing; a null or empty `cleaned` is
    a subsequence of everything. One walk through both texts, of which one row at a time leaves Arrow; Series give a Series."""
    if isinstance(source, pd.Series):
        return pd.Series([_lost(b or "", a or "") for a, b in zip(source, cleaned, strict=True)], dtype="Int32")
    return pa.array([_lost(b.as_py() or "", a.as_py() or "") for a, b in zip(source, cleaned, strict=True)], pa.int32())
