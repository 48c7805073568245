"""Compiled schemas against a plain reading of them; guards, sanitizer and proof of a clean-up on made rows."""

import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import schemas, text
from lectern.plans import registry

SCHEMA = {
    "type": "object", "required": ["verdicts", "id"], "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "minLength": 1, "pattern": "^n[0-9]+$"}, "note": {"type": ["string", "null"], "maxLength": 3},
        "verdicts": {"type": "object", "required": ["v1"], "properties": {"v1": {"type": "integer", "enum": [0, 1]}, "v2": {"type": "number", "minimum": -1, "maximum": 2.5}}},
        "list": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "object", "required": ["x"], "properties": {"x": {"type": "boolean"}}, "additionalProperties": False}}, "kind": {"const": "a"},
    },
}


def plain(v, s, place="$"):
    """All that is wrong with a value, as a set."""
    out = set()
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    kinds = {"object": isinstance(v, dict), "array": isinstance(v, list), "string": isinstance(v, str), "boolean": isinstance(v, bool), "null": v is None, "number": number, "integer": number and v == int(v)}
    if "type" in s:
        names = [s["type"]] if isinstance(s["type"], str) else s["type"]
        if not any(kinds[n] for n in names):
            out.add(f"{place} is not {' or '.join(names)}")
    same = lambda a, b: a == b and isinstance(a, bool) == isinstance(b, bool)
    for values in [s.get("enum")] * ("enum" in s) + [[s.get("const")]] * ("const" in s):
        if not any(same(v, x) for x in values):
            out.add(f"{place} is none of {json.dumps(values)}")
    tests = {"minimum": number and v < s.get("minimum", 0), "maximum": number and v > s.get("maximum", 0)}
    if isinstance(v, str):
        tests |= {"minLength": len(v) < s.get("minLength", 0), "maxLength": len(v) > s.get("maxLength", 1e9), "pattern": not re.search(s.get("pattern", ""), v)}
    if isinstance(v, list):
        tests |= {"minItems": len(v) < s.get("minItems", 0), "maxItems": len(v) > s.get("maxItems", 1e9)}
        for x in v if "items" in s else ():
            out |= plain(x, s["items"], f"{place}[]")
    out |= {f"{place} is beyond its {w}" for w, bad in tests.items() if w in s and bad}
    if isinstance(v, dict):
        out |= {f"{place}.{k} is missing" for k in s.get("required", []) if k not in v}
        if s.get("additionalProperties") is False and v.keys() - s.get("properties", {}).keys():
            out.add(f"{place} has other keys")
        for k, inner in s.get("properties", {}).items():
            if k in v:
                out |= plain(v[k], inner, f"{place}.{k}")
    return out


def test_schemas_as_read(spark):
    rng = random.Random(6)
    odd = [None, True, False, 0, 1, 2, 1.0, 2.5, 3.25, -2, "", "n1", "nx", "long", [], {}, [1], {"x": 1}]
    some = lambda *own: rng.choice([*own] * 4 + odd)
    values = list(odd)
    for _ in range(300):
        item = lambda: some({"x": True}, {"x": some(False)}, {"x": True, "y": 1}, {})
        full = {"id": some("n1", "n22"), "note": some("abc", None), "verdicts": some({"v1": some(0, 1), "v2": some(1, 2.5)}, {"v1": 1}, {}), "list": some([item()], [item(), item()], [item()] * 3), "kind": some("a"), "more": 1}
        values.append({k: v for k, v in full.items() if rng.random() < (0.1 if k == "more" else 0.85)})
    values += [{"id": "n1", "verdicts": {"v1": i % 2}, **more} for i, more in enumerate([{}, {"note": None}, {"note": "ab"}, {"list": [{"x": True}]}, {"kind": "a"}, {"list": [{"x": False}, {"x": True}]}])]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(9_000, "{"), (9_001, None), (9_002, '{"id": "n1", "id": "n2"}'), (9_003, "{} {}")]
    got = {r["i"]: r["w"] for r in spark.createDataFrame(rows, "i int, j string").select("i", schemas.violations(F.col("j"), SCHEMA).alias("w")).collect()}
    for i, v in enumerate(values):
        assert set(got[i]) == plain(v, SCHEMA) and len(got[i]) == len(set(got[i])), v
    assert all(got[i] == ["no JSON"] for i in range(9_000, 9_004))
    assert sum(not got[i] for i in range(len(values))) > 5


@pytest.mark.parametrize("schema", [{"anyOf": []}, {"properties": {"a": {"format": "date"}}}, {"enum": [[1]]}, {"additionalProperties": {"type": "string"}}, {"required": ["a'b"]}])
def test_what_cannot_be_compiled_is_refused(spark, schema):
    with pytest.raises(ValueError):
        schemas.violations(F.lit("{}"), schema)


def test_first_stray(spark):
    rng = random.Random(7)
    pairs = [("", ""), ("", "abc"), ("abc", ""), ("ab\n", "a\n b\n"), (None, "a"), ("a", None)]
    pairs += [("".join(rng.choice("ab") for _ in range(rng.randint(0, 5))), "".join(rng.choice("ab") for _ in range(rng.randint(0, 6)))) for _ in range(300)]
    rows = [(i, *p) for i, p in enumerate(pairs)]
    got = {r["i"]: r["x"] for r in spark.createDataFrame(rows, "i int, c string, s string").select("i", text.first_stray("c", "s").alias("x")).collect()}
    for i, c, s in rows:
        held = lambda part, s=s: any("".join(x) == part for x in itertools.combinations(s, len(part)))
        want = None if c is None or s is None else next((k for k in range(len(c)) if not held(c[: k + 1])), None)
        assert got[i] == want, (c, s)


def test_clean_up_proof(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in registry.queries()["clean_up_proof"](spark, sf).collect():
        clean = "\n".join(b.rstrip(" ") for b in texts[r["doc_id"]].split("\n") if b.strip(" ")).strip()
        assert r["n"] == len(clean) and r["stray"] is None
        assert (r["first_deleted"] is None) == (clean == texts[r["doc_id"]])


def test_guards_strip_first(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["\n=1+1", "\t+x", "　@a", " = b", "\r\n ok ", "-1", "\x1c=z", ""])]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["item_id"]: r["evidence"] for r in registry.queries()["evidence_clean"](spark, str(tmp_path)).collect()}
    assert got == {0: "", 1: "", 2: "", 3: "", 4: "ok", 5: "-1", 6: "", 7: ""}


def test_sanitizer_keeps_json_only(spark, tmp_path):
    rows = [(1, i, "user", t) for i, t in enumerate(['{"a": 1}', "{a", "{}x", "[1]", "1", "text"])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = [r["payload"] for r in registry.queries()["payload_sanitizer"](spark, str(tmp_path)).orderBy("turn").collect()]
    assert got[0] == '{"a": 1}' and got[3:5] == ["[1]", "1"] and all(g.startswith("[removed ") for g in (got[1], got[2], got[5]))


def test_a_text_is_parsed_once(spark):
    """However often its value is looked at. (A text's parser stands in the plan as often as it runs.)"""
    from pyspark.sql import functions as F

    from lectern.functions import replies, schemas

    df = spark.createDataFrame([("3",)], "t string")
    schema = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 10}}}
    for c, most in ((schemas.violations(F.col("t"), schema), 1), (replies.verdicts(F.col("t"), ["b", "a"]), 3), (replies.strict(F.col("t"), F.lit("stop"), ["b"]), 1)):
        plan = df.select(c.alias("c"))._jdf.queryExecution().analyzed().toString()
        assert 1 <= plan.count("parse_json") <= most
