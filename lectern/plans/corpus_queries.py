"""Queries over places, encoded texts, groups of vectors, schemas and clean-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import schemas
from lectern.functions import text as tx
from lectern.operators import encoders
from lectern.operators import retrieval as rt
from lectern.plans.registry import register
from lectern.session import table

_LINES = "length(substr(d.text, 1, {0})) - length(replace(substr(d.text, 1, {0}), chr(10), '')) + 1"
_AT = "position(b.text IN d.text) - 1"


@register("item_places", f"SELECT doc_id, item_id, {_AT} AS at, {_LINES.format(_AT)} AS line, {_LINES.format(_AT + ' + length(b.text)')} AS last_line FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def item_places(spark, d):
    """First place and span of lines of every whole item in every document that holds it; no text is joined with another."""
    found = rt.places(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("said")))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "at", "line", "last_line")


_DOT = "round(greatest(-1, least(1, list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: CAST(q.embedding[i] AS DOUBLE) * CAST(e.embedding[i] AS DOUBLE))))), 6)"


@register(
    "grouped_semantic_topk",
    f"""WITH s AS (SELECT q.label AS g, e.vec_id AS id, q.vec_id AS part, {_DOT} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, id ORDER BY score DESC, part) AS k FROM s) WHERE k = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, id) AS place FROM b) SELECT g, id, part, score, place FROM r WHERE place <= 5""",
)
def grouped_semantic_topk(spark, d):
    """The five vectors nearest to any of a label's query vectors, and to which."""
    e = table(spark, d, "embeddings")
    queries = e.filter("vec_id % 50 = 0").select(F.col("label").cast("long").alias("g"), F.col("vec_id").alias("part"), F.col("embedding").alias("qv"))
    return rt.grouped_top(queries, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 5)


TERMS = ["the", "ion", "ing", "eau", "sch", "ado", "ent", "que", "ung", "ment"]


def _vector(c: str) -> str:
    return "[" + ", ".join(f"(length({c}) - length(replace({c}, '{w}', ''))) / {len(w)}.0" for w in TERMS) + ", 0.01]"


@register(
    "encoded_topk",
    f"""WITH u AS (SELECT 'q' AS kind, item_id AS id, {_vector('text')} AS v FROM benchmark WHERE trim(text) <> '' UNION ALL SELECT 'd', doc_id, {_vector('text')} FROM documents WHERE trim(text) <> ''),
    n AS (SELECT kind, id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM u),
    s AS (SELECT q.id AS q, e.id AS id, round(least(1, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] / q.size * (e.v[i] / e.size)))), 6) AS score FROM n q, n e WHERE q.kind = 'q' AND e.kind = 'd'),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS place FROM s) SELECT q, place, score FROM r WHERE place <= 5""",
)
def encoded_topk(spark, d):
    """Documents and items through one encoder, then exact search: every item against all documents. (Scores, not ids, are
    returned, as a last digit may decide between equal ones.)"""
    terms = list(TERMS)
    make = lambda: encoders.Terms(*terms)
    solid = F.trim("text") != ""
    asked = encoders.encode(table(spark, d, "benchmark").filter(solid).select(F.col("item_id").alias("q"), "text"), make, vector="qv")
    held = encoders.encode(table(spark, d, "documents").filter(solid).select(F.col("doc_id").alias("id"), "text"), make, vector="v")
    return rt.dense_top(asked.select("q", "qv"), held.select("id", "v"), 5).select("q", "place", "score")


#: Of events' properties: a whole number `k` from 10 on, and nothing else.
PROPS = {"type": "object", "required": ["k"], "additionalProperties": False, "properties": {"k": {"type": "integer", "minimum": 10}}}


@register(
    "schema_violations",
    """WITH p AS (SELECT event_type, json_valid(props) AS ok, CASE WHEN json_valid(props) THEN props ELSE '{}' END AS j FROM events), k AS (SELECT *, json_extract(j, '$.k') AS v, json_type(j) = 'OBJECT' AS obj FROM p)
    SELECT event_type, count(*) AS n, count(*) FILTER (NOT ok) AS broken, count(*) FILTER (ok AND obj AND v IS NULL) AS missing, count(*) FILTER (ok AND obj AND json_type(v) IN ('UBIGINT', 'BIGINT') AND CAST(v AS BIGINT) < 10) AS small,
    count(*) FILTER (ok AND obj AND len(json_keys(j)) > CASE WHEN v IS NULL THEN 0 ELSE 1 END) AS more FROM k GROUP BY event_type""",
)
def schema_violations(spark, d):
    """Violations of a schema per type of event, by kind."""
    e = table(spark, d, "events").select("event_type", schemas.violations(F.col("props"), PROPS).alias("w"))
    has = lambda what: F.count(F.when(F.array_contains("w", what), 1))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), has("no JSON").alias("broken"), has("$.k is missing").alias("missing"), has("$.k is beyond its minimum").alias("small"), has("$ has other keys").alias("more"))


@register("clean_up_proof")
def clean_up_proof(spark, d):
    """Documents without blank lines and ends of lines, and whether that clean-up only deleted; held against brute force."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda b: F.rtrim(b)), lambda b: F.trim(b) != "")
    clean = tx.strip(F.array_join(lines, "\n"))
    return table(spark, d, "documents").select("doc_id", F.length(clean).alias("n"), tx.first_stray(clean, F.col("text")).alias("stray"), tx.first_stray(F.col("text"), clean).alias("first_deleted"))


@register("fitted_contexts")
def fitted_contexts(spark, d):
    """Every document as a notice, its context shrunk to 900 tokens of words; held against a plain loop in the tests."""
    from lectern.operators.contexts import contexts

    notice = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array(F.struct(F.col("doc_id").cast("string").alias("doc_id"), F.lit("notice").alias("type"), "text")).alias("docs"))
    found = contexts(notice, ["licen", "tion", "ung"], encoders.Words().count, 900)
    return found.select(F.col("id").alias("doc_id"), "tokens", "size", "tries", F.md5(F.col("context").cast("binary")).alias("context"))
