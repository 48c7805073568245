"""JSON schemas as column predicates: a schema is compiled to expressions over a variant, which name what is wrong and where.

Known words: type (one or several), required, properties, additionalProperties (false), enum, const, minimum, maximum,
minLength, maxLength, pattern, items, minItems, maxItems. Any other word that restricts is refused when compiling, so
that nothing passes unchecked. As in JSON schema a whole number may be written with a fraction of zeros, true is no number,
and words about one kind of value say nothing of other kinds. Arrays are checked within a lambda; places are `$.a.b[]`.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.replies import parsed
from lectern.functions.text import let

_WORDS = {"type", "required", "properties", "additionalProperties", "enum", "const", "minimum", "maximum", "minLength", "maxLength", "pattern", "items", "minItems", "maxItems"}
_NOTES = {"$schema", "$id", "title", "description", "default", "examples"}


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("NONE"))


def _number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def _is(v: Column, kind: Column, name: str) -> Column:
    value = F.try_variant_get(v, "$", "double")
    return {
        "object": kind.startswith("OBJECT"), "array": kind.startswith("ARRAY"), "string": kind == "STRING", "boolean": kind == "BOOLEAN", "null": kind == "VOID",
        "number": _number(kind), "integer": _number(kind) & (value == F.floor(value)),
    }[name]


def _equal(v: Column, kind: Column, value) -> Column:
    if value is None:
        return kind == "VOID"
    if isinstance(value, bool):
        return (kind == "BOOLEAN") & F.coalesce(F.try_variant_get(v, "$", "boolean") == value, F.lit(False))
    if isinstance(value, (int, float)):
        return _number(kind) & F.coalesce(F.try_variant_get(v, "$", "double") == float(value), F.lit(False))
    if isinstance(value, str):
        return (kind == "STRING") & F.coalesce(F.try_variant_get(v, "$", "string") == value, F.lit(False))
    raise ValueError("only plain values can be named in a schema")


def _field(name: str) -> str:
    if "'" in name or "\\" in name:
        raise ValueError(f"{name!r} cannot be a name")
    return f"$['{name}']"


def _wrong(v: Column, schema: dict, place: str) -> list[tuple[Column, str]]:
    """(condition, what it says) of all that may be wrong with a value that is there."""
    if unknown := schema.keys() - _WORDS - _NOTES:
        raise ValueError(f"unknown words {sorted(unknown)}")
    kind, out = _kind(v), []
    if "type" in schema:
        names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        fits = F.lit(False)
        for n in names:
            fits = fits | _is(v, kind, n)
        out.append((~fits, f"{place} is not {' or '.join(names)}"))
    for word, values in (("enum", schema.get("enum")), ("const", [schema["const"]] if "const" in schema else None)):
        if values is not None:
            fits = F.lit(False)
            for x in values:
                fits = fits | _equal(v, kind, x)
            out.append((~fits, f"{place} is none of {json.dumps(values, ensure_ascii=False)}"))
    number, text = F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "string")
    for word, test in (("minimum", lambda x: number < x), ("maximum", lambda x: number > x)):
        if word in schema:
            out.append((_number(kind) & test(schema[word]), f"{place} is beyond its {word}"))
    for word, test in (("minLength", lambda x: F.length(text) < x), ("maxLength", lambda x: F.length(text) > x), ("pattern", lambda x: ~text.rlike(x))):
        if word in schema:
            out.append(((kind == "STRING") & test(schema[word]), f"{place} is beyond its {word}"))
    is_object = kind.startswith("OBJECT")
    for name in schema.get("required", []):
        out.append((is_object & F.try_variant_get(v, _field(name), "variant").isNull(), f"{place}.{name} is missing"))
    if schema.get("additionalProperties", True) is False:
        keys = F.coalesce(F.json_object_keys(F.to_json(F.when(is_object, v))), F.array().cast("array<string>"))
        known = F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>")
        out.append((F.size(F.array_except(keys, known)) > 0, f"{place} has other keys"))
    elif schema.get("additionalProperties", True) is not True:
        raise ValueError("additionalProperties is true or false")
    for name, inner in schema.get("properties", {}).items():
        value = F.try_variant_get(v, _field(name), "variant")
        out += [(is_object & value.isNotNull() & wrong, what) for wrong, what in _wrong(value, inner, f"{place}.{name}")]
    parts = F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
    for word, test in (("minItems", lambda x: F.size(parts) < x), ("maxItems", lambda x: F.size(parts) > x)):
        if word in schema:
            out.append((parts.isNotNull() & test(schema[word]), f"{place} is beyond its {word}"))

    def some(k: int):
        return F.exists(parts, lambda x: F.coalesce(_wrong(x, schema["items"], "")[k][0], F.lit(False)))

    out += [(some(k), what) for k, (_, what) in enumerate(_wrong(v, schema["items"], f"{place}[]") if "items" in schema else ())]
    return out


def violations(text: Column, schema: dict) -> Column:
    """What is wrong with a JSON text by a schema, in the schema's order; empty if it is valid. No JSON is one violation."""

    def judged(v):
        told = [F.when(F.coalesce(wrong, F.lit(False)), F.lit(what)) for wrong, what in _wrong(v, schema, "$")]
        return F.when(v.isNull(), F.array(F.lit("no JSON"))).otherwise(F.array_compact(F.array(*told)) if told else F.array().cast("array<string>"))

    return let(parsed(text), judged)
