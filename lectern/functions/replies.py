"""Model replies as column expressions: strict and lenient JSON, verdicts, canonical texts. Failures are NULL or a reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import let

_FENCE = r"(?s)```(?:json)?\s*(.*?)\s*```"
#: Texts that stand for a positive verdict, and the names of a judgement's parts.
POSITIVE = ("1", "위반", "true", "True")
WRAPPER, VERDICT, EVIDENCE = "판정", ("위반여부", "violation"), ("근거문구", "evidence")


def canonical(c: Column) -> Column:
    """A JSON text without white space between its parts: equal texts are equal in values, types and order."""
    return F.regexp_replace(c, r'("(?:[^"\\]|\\.)*+")|\s+', "$1")


def parsed(c: Column) -> Column:
    """A text that is one JSON value and nothing more, as a variant; else NULL. (The parser itself stops behind a value.)"""
    listed = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    return let(listed, lambda v: F.when(F.size(F.try_variant_get(v, "$", "array<variant>")) == 1, F.try_variant_get(v, "$[0]", "variant")))


def is_json(c: Column) -> Column:
    return F.coalesce(parsed(c).isNotNull(), F.lit(False))


def lenient(c: Column) -> Column:
    """The first JSON among the whole reply, its fenced parts, and what lies between its outermost braces; else NULL."""
    whole = F.trim(c)
    fenced = F.filter(F.regexp_extract_all(whole, F.lit(_FENCE), F.lit(1)), lambda x: is_json(x))
    first, last = F.instr(whole, "{"), F.length(whole) - F.instr(F.reverse(whole), "}") + 1
    between = F.when((first > 0) & F.contains(whole, F.lit("}")) & (last > first), F.substr(whole, first, last - first + 1))
    return F.when(is_json(whole), whole).when(F.size(fenced) > 0, F.get(fenced, 0)).when(is_json(between), between)


def strict(c: Column, finish: Column, items: list[str]) -> Column:
    """(json, fenced, error): one object with exactly these items, each 0 or 1 as a whole number, and a reply that came
    to its end. One complete fence around the whole is allowed and told. Repeated keys and NaN are no JSON."""
    whole = F.trim(c)
    inner = F.regexp_extract(whole, r"(?s)^```(?:json)?[ \t]*\n(.*)\n```$", 1)
    fenced = inner != ""
    body = F.when(fenced, inner).otherwise(whole)

    def checked(b):
        return let(parsed(b), lambda value: told(b, value))

    def told(b, value):
        keys = F.json_object_keys(b)
        kinds = [F.coalesce(F.schema_of_variant(F.try_variant_get(value, f"$['{i}']", "variant")), F.lit("")) for i in items]
        odd = [~((k == "BIGINT") & F.coalesce(F.try_variant_get(value, f"$['{i}']", "int").isin(0, 1), F.lit(False))) for i, k in zip(items, kinds, strict=True)]
        wrong = odd[0]
        for o in odd[1:]:
            wrong = wrong | o
        error = (
            F.when(~finish.eqNullSafe(F.lit("stop")), "not finished").when(value.isNull(), "no JSON").when(~F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False)), "no object")
            .when(~F.array_sort(keys).eqNullSafe(F.array(*map(F.lit, sorted(items)))), "other keys").when(wrong, "a verdict is not 0 or 1")
        )
        return F.struct(F.when(error.isNull(), b).alias("json"), fenced.alias("fenced"), error.alias("error"))

    return let(body, checked)


def found(c: Column) -> Column:
    """The value of `lenient`, as a variant: each candidate is parsed once, and only behind the ones that are no JSON."""

    def read(whole):
        fenced = F.filter(F.transform(F.regexp_extract_all(whole, F.lit(_FENCE), F.lit(1)), parsed), lambda v: v.isNotNull())
        first, last = F.instr(whole, "{"), F.length(whole) - F.instr(F.reverse(whole), "}") + 1
        between = F.when((first > 0) & F.contains(whole, F.lit("}")) & (last > first), F.substr(whole, first, last - first + 1))
        return F.coalesce(parsed(whole), F.get(fenced, 0), parsed(between))

    return let(F.trim(c), read)


def verdict(value: Column) -> Column:
    """A judgement's verdict as 0 or 1, from a variant object: whole numbers, booleans and known texts; NULL is missing."""

    def hit(kind, text):
        return (
            F.when(kind == "BOOLEAN", text == "true").when(kind == "STRING", text.isin(*POSITIVE)).when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), text.try_cast("double") != 0)
            .when(kind.startswith("ARRAY"), text != "[]").when(kind.startswith("OBJECT"), text != "{}").otherwise(F.lit(False))
        )

    def judged(v):
        raw = F.coalesce(*(F.try_variant_get(v, f"$['{n}']", "variant") for n in VERDICT))
        seen = let(raw, lambda r: F.struct(F.schema_of_variant(r).alias("kind"), F.trim(F.try_variant_get(r, "$", "string")).alias("text")))
        is_judgement = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
        return F.when(is_judgement, let(seen, lambda s: F.coalesce(hit(s["kind"], s["text"]), F.lit(False)).cast("int")))

    return let(value, judged)


def verdicts(c: Column, items: list[str]) -> Column:
    """(verdicts, missing): every item's verdict of a reply, read leniently; a missing item is 0 and listed."""

    def top(v):
        inner = F.try_variant_get(v, f"$['{WRAPPER}']", "variant")
        return let(inner, lambda w: F.when(F.schema_of_variant(w).startswith("OBJECT"), w).otherwise(v))

    def told(each):
        hits = [(i, F.get(each, k)) for k, i in enumerate(items)]
        return F.struct(F.create_map(*(x for i, e in hits for x in (F.lit(i), F.coalesce(e, F.lit(0))))).alias("verdicts"), F.array_compact(F.array(*(F.when(e.isNull(), F.lit(i)) for i, e in hits))).alias("missing"))

    each = let(let(found(c), top), lambda t: F.array(*(verdict(F.try_variant_get(t, f"$['{i}']", "variant")) for i in items)))
    return let(each, told)
