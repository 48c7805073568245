"""Queries over judgements and replies: evidence, lenient and strict JSON, orders, state machines, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import replies
from lectern.functions import text as tx
from lectern.operators import chunks, evidence
from lectern.operators.evaluation import count_where
from lectern.plans.evaluation_queries import BASE, judged
from lectern.plans.registry import register
from lectern.plans.text_queries import WHITE
from lectern.session import table
from lectern.streaming.folds import fold

_CLAIMS = f"""{BASE}, c AS (SELECT j.doc_id AS doc_id, j.item AS item, b AS verdict, text, lang = 'fr' AND j.item = 'quality' AS absence,
    CASE WHEN j.doc_id % 5 = 0 THEN '=' || substr(text, 1, 20) WHEN j.doc_id % 5 = 1 THEN upper(substr(text, 1, 30)) WHEN j.doc_id % 5 = 2 THEN substr(text, 5, 600) WHEN j.doc_id % 5 = 3 THEN '' ELSE substr(text, 3, 80) END AS evidence
    FROM j JOIN documents USING (doc_id))"""


def claims(spark, d):
    """Verdicts with evidence that is sound, unsafe, foreign, too long or missing, and items about absence."""
    t, k = F.col("text"), F.col("doc_id") % 5
    said = F.when(k == 0, F.concat(F.lit("="), F.substring(t, 1, 20))).when(k == 1, F.upper(F.substring(t, 1, 30))).when(k == 2, F.substring(t, 5, 600)).when(k == 3, "").otherwise(F.substring(t, 3, 80))
    docs = table(spark, d, "documents").select("doc_id", "lang", said.alias("evidence"))
    return judged(spark, d).join(docs, "doc_id").select(F.col("doc_id").alias("id"), "item", F.col("b").alias("verdict"), "evidence", ((F.col("lang") == "fr") & (F.col("item") == "quality")).alias("absence"))


def sources(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


@register(
    "evidence_finalized",
    f"""WITH {_CLAIMS}, s AS (SELECT *, verdict = 1 AND NOT absence AND evidence <> '' AS stated, regexp_matches(evidence, '^[=+@]') OR NOT contains(text, evidence) AS bad FROM c)
    SELECT doc_id, item, CASE WHEN stated AND NOT bad THEN md5(evidence) END AS evidence, stated AND bad AS dropped FROM s""",
)
def evidence_finalized(spark, d):
    """Evidence as it may be shown; what is unsafe or not in its source is dropped and counted."""
    rows = evidence.finalize(claims(spark, d), sources(spark, d))
    return rows.select(F.col("id").alias("doc_id"), "item", F.md5(F.col("evidence").cast("binary")).alias("evidence"), "dropped")


@register(
    "evidence_reasons",
    f"""WITH {_CLAIMS}, r AS (SELECT item, evidence <> '' AS said, list_filter([CASE WHEN evidence <> '' AND verdict <> 1 THEN 'negative verdict' END, CASE WHEN evidence <> '' AND absence THEN 'item about absence' END,
    CASE WHEN length(evidence) > 500 THEN 'too long' END, CASE WHEN regexp_matches(evidence, '^[=+@]') THEN 'unsafe start' END, CASE WHEN evidence <> '' AND NOT contains(text, evidence) THEN 'not in the source' END,
    CASE WHEN evidence = '' AND verdict = 1 AND NOT absence THEN 'missing' END], lambda x: x IS NOT NULL) AS reasons FROM c)
    SELECT item, array_to_string(reasons, '; ') AS reasons, count(*) AS n, count(*) FILTER (said) AS nonempty, count(*) FILTER (said AND len(reasons) > 0) AS invalid FROM r GROUP BY 1, 2""",
)
def evidence_reasons(spark, d):
    """The five-way audit with ordered reasons, and counts of stated, invalid and missing evidence."""
    said = F.col("evidence") != ""
    rows = evidence.reasons(claims(spark, d), sources(spark, d)).select("item", said.alias("said"), F.size("reasons").alias("size"), F.array_join("reasons", "; ").alias("reasons"))
    return rows.groupBy("item", "reasons").agg(F.count("*").alias("n"), count_where(F.col("said")).alias("nonempty"), count_where(F.col("said") & (F.col("size") > 0)).alias("invalid"))


_REPLY = "CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN 'Answer: ' || props || ' done' WHEN 3 THEN 'none' WHEN 4 THEN substr(props, 1, length(props) - 1) ELSE props || ' ' END"


def said(spark, d):
    p, k = F.col("props"), F.col("event_id") % 6
    fence = F.concat(F.lit("```json\n"), p, F.lit("\n```"))
    text = F.when(k == 0, p).when(k == 1, fence).when(k == 2, F.concat(F.lit("Answer: "), p, F.lit(" done"))).when(k == 3, "none").when(k == 4, F.expr("substr(props, 1, length(props) - 1)")).otherwise(F.concat(p, F.lit(" ")))
    return table(spark, d, "events").select("event_id", "event_type", "props", text.alias("reply"))


@register(
    "lenient_replies",
    f"""WITH r AS (SELECT event_id, trim({_REPLY}) AS t FROM events), x AS (SELECT event_id, t, regexp_extract(t, '```(?:json)?\\s*(.*?)\\s*```', 1, 's') AS f, substr(t, position('{{' IN t), length(t) - position('}}' IN reverse(t)) + 2 - position('{{' IN t)) AS b FROM r),
    y AS (SELECT event_id, CASE WHEN json_valid(t) THEN t WHEN json_valid(f) THEN f WHEN json_valid(b) THEN b END AS j FROM x) SELECT event_id, json_extract_string(j, '$.k') AS k FROM y""",
)
def lenient_replies(spark, d):
    """JSON as the whole reply, in a fence, or between the outermost braces."""
    return said(spark, d).select("event_id", F.get_json_object(replies.lenient(F.col("reply")), "$.k").alias("k"))


@register(
    "strict_replies",
    f"""WITH r AS (SELECT event_id, trim({_REPLY.replace('props', 'p')}) AS t, CASE WHEN event_id % 7 = 0 THEN 'length' ELSE 'stop' END AS finish FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN props WHEN event_id % 4 = 1 THEN '{{"k": true}}' ELSE '{{"k": ' || CAST(event_id % 3 AS VARCHAR) || '}}' END AS p FROM events)),
    x AS (SELECT *, regexp_extract(t, '^```(?:json)?[ \\t]*\\n(.*)\\n```$', 1, 's') AS f FROM r), y AS (SELECT *, CASE WHEN f <> '' THEN f ELSE t END AS b FROM x),
    z AS (SELECT f <> '' AS fenced, CASE WHEN finish <> 'stop' THEN 'not finished' WHEN NOT json_valid(b) THEN 'no JSON' WHEN json_type(b) <> 'OBJECT' THEN 'no object' WHEN json_keys(b) <> ['k'] THEN 'other keys'
    WHEN json_type(b, '$.k') NOT IN ('UBIGINT', 'BIGINT') OR json_extract_string(b, '$.k') NOT IN ('0', '1') THEN 'a verdict is not 0 or 1' END AS error FROM y) SELECT fenced, error, count(*) AS n FROM z GROUP BY 1, 2""",
)
def strict_replies(spark, d):
    """Exactly the asked keys with whole 0 or 1, in a finished reply; reasons in fixed order."""
    e, k = table(spark, d, "events"), F.col("event_id") % 4
    props = F.when(k == 0, F.col("props")).when(k == 1, '{"k": true}').otherwise(F.concat(F.lit('{"k": '), (F.col("event_id") % 3).cast("string"), F.lit("}")))
    finish = F.when(F.col("event_id") % 7 == 0, "length").otherwise("stop")
    p, k6 = F.col("p"), F.col("event_id") % 6
    text = F.when(k6 == 0, p).when(k6 == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(k6 == 2, F.concat(F.lit("Answer: "), p, F.lit(" done"))).when(k6 == 3, "none").when(k6 == 4, F.expr("substr(p, 1, length(p) - 1)")).otherwise(F.concat(p, F.lit(" ")))
    read = e.select("event_id", props.alias("p")).select(replies.strict(text, finish, ["k"]).alias("r"))
    return read.groupBy("r.fenced", "r.error").agg(F.count("*").alias("n"))


@register(
    "coerced_verdicts",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 WHEN 4 THEN CAST(event_id % 3 <> 0 AS INT) ELSE 0 END AS hit, CASE WHEN event_id % 6 = 5 THEN 'b,a' ELSE 'b' END AS missing FROM events""",
)
def coerced_verdicts(spark, d):
    """Texts, booleans and numbers as verdicts; what is missing is 0 and listed."""
    k = F.col("event_id") % 6
    value = F.when(k == 0, '{"violation": true}').when(k == 1, '{"violation": "0"}').when(k == 2, '{"위반여부": " 위반 "}').when(k == 3, "{}").when(k == 4, F.concat(F.lit('{"violation": '), (F.col("event_id") % 3).cast("string"), F.lit("}"))).otherwise("3")
    reply = F.concat(F.lit('So: {"판정": {"a": '), value, F.lit("}}"))
    x = table(spark, d, "events").select("event_id", replies.verdicts(reply, ["b", "a"]).alias("r"))
    return x.select("event_id", F.element_at("r.verdicts", "a").alias("hit"), F.array_join("r.missing", ",").alias("missing"))


@register("canonical_json", "SELECT event_id, CAST(json(props) AS VARCHAR) AS canonical, CAST(json(props) AS VARCHAR) = '{\"k\":' || CAST(event_id % 10 AS VARCHAR) || '}' AS same FROM events")
def canonical_json(spark, d):
    """Equality that depends on types and order, by canonical texts."""
    c = replies.canonical(F.col("props"))
    return table(spark, d, "events").select("event_id", c.alias("canonical"), (c == F.concat(F.lit('{"k":'), (F.col("event_id") % 10).cast("string"), F.lit("}"))).alias("same"))


@register("compact_json", "SELECT conv_id, turn, md5('{\"role\":\"' || role || '\",\"turn\":' || CAST(turn AS VARCHAR) || ',\"chars\":' || CAST(length(text) AS VARCHAR) || ',\"note\":\"판정 é\"}') AS line FROM conversations")
def compact_json(spark, d):
    """No white space, keys in order, other scripts as they are."""
    line = F.to_json(F.struct("role", "turn", F.length("text").alias("chars"), F.lit("판정 é").alias("note")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(line.cast("binary")).alias("line"))


_COVER = "SELECT doc_id, unnest(range(0, length(text), 100)) AS lo FROM documents"


@register("passage_coverage", f"WITH p AS ({_COVER}), g AS (SELECT p.doc_id AS doc_id, sum(length(regexp_replace(substr(text, lo + 91, 10), '\\s', '', 'g'))) AS n FROM p JOIN documents USING (doc_id) GROUP BY 1) SELECT d.doc_id AS doc_id, length(regexp_replace(text, '\\s', '', 'g')) AS total, coalesce(n, 0) AS uncovered FROM documents d LEFT JOIN g USING (doc_id)")
def passage_coverage(spark, d):
    """Characters in no passage; passages overlap, and each hundred characters leave ten out."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    lo = docs.select(F.col("doc_id").alias("id"), F.length("text").alias("size"), F.explode(tx.let(F.length("text"), lambda n: F.filter(F.sequence(F.lit(0), n, F.lit(100)), lambda x: x < n))).alias("lo"))
    spans = lo.select("id", F.explode(F.array(*(F.struct((F.col("lo") + a).cast("long").alias("start"), F.least(F.col("lo") + b, F.col("size")).cast("long").alias("stop")) for a, b in ((0, 50), (30, 90))))).alias("s"))
    return chunks.uncovered(docs.select(F.col("doc_id").alias("id"), "text"), spans.select("id", "s.start", "s.stop")).withColumnRenamed("id", "doc_id")


@register("custom_order", "SELECT lang, source, CAST(row_number() OVER (PARTITION BY lang ORDER BY CASE source WHEN 'src2' THEN 1 WHEN 'src0' THEN 2 ELSE 3 END, TRY_CAST(regexp_extract(source, '[0-9]+$') AS INT) NULLS FIRST, source) AS INT) AS place FROM (SELECT DISTINCT lang, source FROM documents)")
def custom_order(spark, d):
    """A given order of categories, unknown ones last and there by the number they end with (`v10` behind `v9`)."""
    from pyspark.sql import Window as W

    given = F.create_map(F.lit("src2"), F.lit(1), F.lit("src0"), F.lit(2))
    number = F.regexp_extract("source", "[0-9]+$", 0).try_cast("int")
    w = W.partitionBy("lang").orderBy(F.coalesce(given[F.col("source")], F.lit(3)), number.asc_nulls_first(), "source")
    return table(spark, d, "documents").select("lang", "source").distinct().withColumn("place", F.row_number().over(w))


@register("best_chunk", "WITH x AS (SELECT doc_id, i, length(string_split(text, chr(10))[i + 1]) AS n FROM (SELECT doc_id, text, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)) SELECT doc_id, CAST(arg_max(i, (n, -i)) AS INT) AS chunk, max(n) AS n FROM x GROUP BY doc_id")
def best_chunk(spark, d):
    """The chunk with the greatest score; the first of equals. Within the row."""
    cells = F.transform(F.split("text", "\n"), lambda b, i: F.struct(F.length(b).alias("n"), (-i).alias("up")))
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.array_max(cells).alias("b")).select("doc_id", (-F.col("b.up")).alias("chunk"), "b.n")


@register("event_concat", "WITH x AS (SELECT conv_id, role, count(*) AS n, sum(length(text)) AS chars FROM conversations GROUP BY 1, 2) SELECT conv_id, CAST(sum(n) AS BIGINT) AS events, CAST(sum(chars) AS BIGINT) AS chars, string_agg(role || ':' || CAST(n AS VARCHAR), ',' ORDER BY role) AS parts FROM x GROUP BY conv_id")
def event_concat(spark, d):
    """Events of a conversation's attempts side by side with summed counters: copies stay."""
    x = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    parts = F.array_sort(F.collect_list(F.struct("role", "n")))
    return x.groupBy("conv_id").agg(F.sum("n").alias("events"), F.sum("chars").alias("chars"), F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p["role"], p["n"].cast("string"))), ",").alias("parts"))


@register("columns_all_equal", "SELECT l_orderkey, count(DISTINCT l_returnflag) = 1 AS flag, count(DISTINCT l_linestatus) = 1 AS status, count(DISTINCT l_suppkey) = 1 AS supplier FROM lineitem GROUP BY l_orderkey")
def columns_all_equal(spark, d):
    """Whether all of a record's rows agree, column by column: least and greatest value, combined before they move."""
    same = lambda c, n: (F.min(c) == F.max(c)).alias(n)
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(same("l_returnflag", "flag"), same("l_linestatus", "status"), same("l_suppkey", "supplier"))


@register("nested_lines", "SELECT c_custkey, 'name: ' || c_name || chr(10) || 'place:' || chr(10) || '  nation: ' || n_name || chr(10) || '  region: ' || r_name AS lines FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def nested_lines(spark, d):
    """A nested mapping as indented lines. Nation and region are 25 and 5 rows by their definition."""
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    inner = F.transform(F.array(F.struct(F.lit("nation").alias("k"), F.col("n_name").alias("v")), F.struct(F.lit("region").alias("k"), F.col("r_name").alias("v"))), lambda e: F.concat(F.lit("  "), e["k"], F.lit(": "), e["v"]))
    return c.select("c_custkey", F.concat(F.lit("name: "), "c_name", F.lit("\nplace:\n"), F.array_join(inner, "\n")).alias("lines"))


@register("manifest_check", "WITH m AS (SELECT doc_id, sha256(text) AS told FROM documents WHERE doc_id % 11 <> 3 UNION ALL SELECT -doc_id - 1, sha256(text) FROM documents WHERE doc_id % 11 = 3), c AS (SELECT coalesce(m.doc_id, d.doc_id) AS id, told, sha256(CASE WHEN d.doc_id % 13 = 5 THEN text || ' ' ELSE text END) AS found, m.doc_id IS NULL AS extra, d.doc_id IS NULL AS absent FROM m FULL JOIN documents d ON m.doc_id = d.doc_id) SELECT CASE WHEN absent THEN 'absent' WHEN extra THEN 'not listed' WHEN told IS DISTINCT FROM found THEN 'changed' ELSE 'equal' END AS state, count(*) AS n FROM c GROUP BY 1")
def manifest_check(spark, d):
    """Artifacts against their manifest of hashes: equal, changed, absent or not listed."""
    docs = table(spark, d, "documents")
    k = F.col("doc_id") % 11
    listed = docs.select(F.when(k == 3, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id"), F.sha2("text", 256).alias("told"), F.lit(True).alias("listed"))
    there = docs.select("doc_id", F.sha2(F.when(F.col("doc_id") % 13 == 5, F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256).alias("found"), F.lit(True).alias("there"))
    state = F.when(F.col("there").isNull(), "absent").when(F.col("listed").isNull(), "not listed").when(~F.col("told").eqNullSafe(F.col("found")), "changed").otherwise("equal")
    return listed.join(there, "doc_id", "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@register("replay_differences", "WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem), b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 97 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity, CASE WHEN l_orderkey % 89 = 0 THEN NULL ELSE l_discount END AS l_discount FROM lineitem) SELECT l_orderkey, l_linenumber, a.l_quantity IS DISTINCT FROM b.l_quantity AS quantity, a.l_discount IS DISTINCT FROM b.l_discount AS discount FROM a JOIN b USING (l_orderkey, l_linenumber) WHERE a.l_quantity IS DISTINCT FROM b.l_quantity OR a.l_discount IS DISTINCT FROM b.l_discount")
def replay_differences(spark, d):
    """A saved run beside its replay: the fields that differ, NULLs compared as values."""
    key = ["l_orderkey", "l_linenumber"]
    a = table(spark, d, "lineitem").select(*key, "l_quantity", "l_discount")
    b = a.select(*key, F.when(F.col("l_orderkey") % 97 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")).alias("q"), F.when(F.col("l_orderkey") % 89 != 0, F.col("l_discount")).alias("x"))
    j = a.join(b, key).select(*key, (~F.col("l_quantity").eqNullSafe(F.col("q"))).alias("quantity"), (~F.col("l_discount").eqNullSafe(F.col("x"))).alias("discount"))
    return j.filter("quantity OR discount")


@register("run_links", "WITH o AS (SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders) SELECT o_orderkey AS run, 'after' AS link, before AS other FROM o WHERE before IS NOT NULL UNION ALL SELECT before, 'before', o_orderkey FROM o WHERE before IS NOT NULL")
def run_links(spark, d):
    """Predecessor links and the same links from the other side."""
    from pyspark.sql import Window as W

    o = table(spark, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("before")).filter("before IS NOT NULL")
    both = F.explode(F.array(F.struct(F.col("o_orderkey").alias("run"), F.lit("after").alias("link"), F.col("before").alias("other")), F.struct(F.col("before").alias("run"), F.lit("before").alias("link"), F.col("o_orderkey").alias("other"))))
    return o.select(both.alias("l")).select("l.run", "l.link", "l.other")


@register("paired_cosine", "WITH a AS (SELECT vec_id, embedding AS x FROM embeddings), b AS (SELECT vec_id - 1 AS vec_id, embedding AS y FROM embeddings) SELECT vec_id, round(list_sum(list_transform(range(1, len(x) + 1), lambda i: CAST(x[i] AS DOUBLE) * CAST(y[i] AS DOUBLE))) / (sqrt(list_sum(list_transform(x, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))) * sqrt(list_sum(list_transform(y, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))))), 6) AS cosine FROM a JOIN b USING (vec_id)")
def paired_cosine(spark, d):
    """Cosine of the rows of two encoders, joined by key."""
    from lectern.operators.retrieval import dot

    e = table(spark, d, "embeddings")
    j = e.select("vec_id", F.col("embedding").alias("x")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")
    return j.select("vec_id", F.round(dot(F.col("x"), F.col("y")) / (F.sqrt(dot(F.col("x"), F.col("x"))) * F.sqrt(dot(F.col("y"), F.col("y")))), 6).alias("cosine"))


@register("clean_lines", r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS b, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), c AS (SELECT doc_id, i, regexp_replace(b, '[0-9]+|https?://[^ ]+', '', 'g') AS b FROM l) SELECT doc_id, count(*) AS lines, md5(string_agg(b, chr(10) ORDER BY i)) AS text FROM c WHERE trim(b) <> '' GROUP BY doc_id")
def clean_lines(spark, d):
    """Deletions by pattern, and no blank lines. Within the row."""
    kept = F.filter(F.transform(F.split("text", "\n"), lambda b: F.regexp_replace(b, "[0-9]+|https?://[^ ]+", "")), lambda b: F.trim(b) != "")
    return table(spark, d, "documents").select("doc_id", kept.alias("k")).filter("size(k) > 0").select("doc_id", F.size("k").cast("long").alias("lines"), F.md5(F.array_join("k", "\n").cast("binary")).alias("text"))


@register(
    "turn_machine",
    """WITH RECURSIVE o AS (SELECT conv_id, turn, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
    m AS (SELECT conv_id, 0 AS k, 'start' AS state, 0 AS rounds, 0 AS retries, 0 AS used FROM (SELECT DISTINCT conv_id FROM o) UNION ALL
    SELECT m.conv_id, o.k, CASE WHEN state IN ('final', 'failed') THEN state WHEN used + n > 6000 THEN 'failed' WHEN role = 'user' AND state = 'waiting' AND retries >= 1 THEN 'failed' WHEN role = 'user' THEN 'waiting' WHEN role = 'assistant' AND rounds + 1 >= 3 THEN 'final' WHEN role = 'assistant' THEN 'answered' ELSE state END,
    CASE WHEN state NOT IN ('final', 'failed') AND used + n <= 6000 AND role = 'assistant' THEN rounds + 1 ELSE rounds END, CASE WHEN state = 'waiting' AND role = 'user' AND used + n <= 6000 AND retries < 1 THEN retries + 1 ELSE retries END, CASE WHEN state IN ('final', 'failed') OR used + n > 6000 THEN used ELSE used + n END
    FROM m JOIN o ON m.conv_id = o.conv_id AND o.k = m.k + 1)
    SELECT conv_id, arg_max(state, k) AS state, arg_max(rounds, k) AS rounds, arg_max(retries, k) AS retries, arg_max(used, k) AS used FROM m GROUP BY conv_id""",
)
def turn_machine(spark, d):
    """States of a conversation under budgets: at most one retry of an unanswered turn, three answers, 6000 characters."""

    def step(s, row):
        s = s or {"state": "start", "rounds": 0, "retries": 0, "used": 0}
        if s["state"] in ("final", "failed"):
            return s, []
        if s["used"] + row["n"] > 6000:
            return s | {"state": "failed"}, []
        used = s["used"] + row["n"]
        if row["role"] == "user":
            if s["state"] == "waiting" and s["retries"] >= 1:
                return s | {"state": "failed", "used": used}, []
            return s | {"state": "waiting", "used": used, "retries": s["retries"] + (s["state"] == "waiting")}, []
        if row["role"] == "assistant":
            return s | {"state": "final" if s["rounds"] + 1 >= 3 else "answered", "rounds": s["rounds"] + 1, "used": used}, []
        return s | {"used": used}, []

    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    return fold(rows, "conv_id", ["turn"], step, "conv_id long, state string, rounds int, retries int, used int", lambda k, s: [(k, s["state"], s["rounds"], s["retries"], s["used"])])


@register(
    "bounded_admission",
    """WITH RECURSIVE o AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN 'done' WHEN event_type = 'click' THEN 'ask' END AS kind, CAST(floor(value) AS INT) % 50 + 10 AS size, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('click', 'purchase')),
    m AS (SELECT user_id, 0 AS k, CAST([] AS INTEGER[]) AS live, NULL::BIGINT AS event_id, NULL::VARCHAR AS said FROM (SELECT DISTINCT user_id FROM o) UNION ALL
    SELECT m.user_id, o.k, CASE WHEN kind = 'done' THEN live[2:] WHEN len(live) >= 3 THEN live WHEN len(live) > 0 AND list_sum(live) + size > 100 THEN live ELSE list_append(live, size) END, o.event_id,
    CASE WHEN kind = 'done' THEN 'done' WHEN len(live) >= 3 THEN 'record_window' WHEN len(live) > 0 AND list_sum(live) + size > 100 THEN 'source_token_budget' ELSE 'admit' END FROM m JOIN o ON m.user_id = o.user_id AND o.k = m.k + 1)
    SELECT user_id, said, count(*) AS n, max(event_id) AS last FROM m WHERE k > 0 GROUP BY 1, 2""",
)
def bounded_admission(spark, d):
    """Admission with at most three live records and a budget of tokens: the first always fits; why others have to wait."""

    def step(s, row):
        live = list(s["live"]) if s else []
        if row["kind"] == "done":
            return {"live": live[1:]}, [(row["user_id"], row["event_id"], "done")]
        if len(live) >= 3:
            return {"live": live}, [(row["user_id"], row["event_id"], "record_window")]
        if live and sum(live) + row["size"] > 100:
            return {"live": live}, [(row["user_id"], row["event_id"], "source_token_budget")]
        return {"live": [*live, row["size"]]}, [(row["user_id"], row["event_id"], "admit")]

    e = table(spark, d, "events").filter(F.col("event_type").isin("click", "purchase"))
    rows = e.select("user_id", "ts", "event_id", F.when(F.col("event_type") == "purchase", "done").otherwise("ask").alias("kind"), (F.floor("value").cast("int") % 50 + 10).alias("size"))
    told = fold(rows, "user_id", ["ts", "event_id"], step, "user_id long, event_id long, said string")
    return told.groupBy("user_id", "said").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@register("clean_evidence", rf"WITH x AS (SELECT b.item_id AS item_id, trim(replace(nfc_normalize(b.text), chr(13), ''), {WHITE}) AS e FROM benchmark b), y AS (SELECT item_id, CASE WHEN regexp_matches(e, '^[=+@]') THEN '' ELSE substr(e, 1, 500) END AS e FROM x) SELECT item_id, CASE WHEN e <> '' AND EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, e)) THEN md5(e) END AS evidence FROM y")
def clean_evidence(spark, d):
    """Composed, guarded, cut, and blank unless it stands in a source."""
    from lectern.operators.retrieval import contained

    e = tx.strip(F.replace(tx.nfc("text"), F.lit("\r"), F.lit("")))
    items = table(spark, d, "benchmark").select("item_id", F.coalesce(F.substring(tx.safe(e), 1, 500), F.lit("")).alias("e"))
    held = contained(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), items.filter("e <> ''").select(F.col("item_id").alias("item"), F.col("e").alias("said"))).select(F.col("item").alias("item_id"), F.lit(True).alias("held")).distinct()
    return items.join(held, "item_id", "left").select("item_id", F.when(F.col("held"), F.md5(F.col("e").cast("binary"))).alias("evidence"))


_SAID = f"""t AS (SELECT doc_id, trim(body, {WHITE}) AS b, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) WHERE trim(body, {WHITE}) <> ''),
    c AS (SELECT doc_id, line, b, concat_ws(' ', lag(b) OVER w, b, lead(b) OVER w) AS x FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
    k AS (SELECT *, regexp_matches(x, 'licen[sc]e') AS e, regexp_matches(x, 'public|open') AS o, regexp_matches(x, 'region|local|near') AS r FROM c WHERE NOT regexp_matches(x, 'copyright'))"""
CANDIDATES = {"experience": "licen[sc]e", "institution": "public|open", "region": "region|local|near", "basic": "local", "bad": "copyright", "qualification": "permission|terms", "adjacent": "near", "token": "region"}


@register(
    "line_candidates",
    f"""WITH {_SAID}, n AS (SELECT doc_id, count(*) FILTER (e) AS n_experience, count(*) FILTER (o) AS n_institution, count(*) FILTER (r) AS n_region,
    sum(CASE WHEN e THEN len(regexp_extract_all(x, '[0-9][0-9,]*(?:[.][0-9]+)?')) ELSE 0 END) AS n_amounts, coalesce(bool_or(r AND regexp_matches(x, 'local')), false) AS basic,
    coalesce(bool_or(r AND regexp_matches(x, 'near')), false) AS near, sum(CASE WHEN r THEN len(regexp_extract_all(x, 'region')) ELSE 0 END) AS tokens FROM k GROUP BY doc_id)
    SELECT doc_id, n_experience, n_institution, n_region, n_amounts::BIGINT AS n_amounts, concat_ws(',', CASE WHEN n_amounts > 0 AND n_institution > 0 THEN 'v4' END, CASE WHEN n_region > 0 THEN 'v5' END, CASE WHEN basic THEN 'v6' END, CASE WHEN n_region > 0 AND (near OR tokens >= 2) THEN 'v7' END) AS flags
    FROM n WHERE n_experience + n_institution + n_region > 0""",
)
def line_candidates(spark, d):
    """Lines that speak of licences, openness or places, judged with their neighbours, and the flags that they raise."""
    from lectern.operators.candidates import extract

    notices = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array(F.struct("text")).alias("docs"))
    counts = [F.col(c).cast("long").alias(c) for c in ("n_experience", "n_institution", "n_region")]
    found = extract(notices, CANDIDATES).filter("n_experience + n_institution + n_region > 0")
    return found.select(F.col("id").alias("doc_id"), *counts, F.size("amounts").cast("long").alias("n_amounts"), F.array_join("flags", ",").alias("flags"))


@register("cleaning_proof", "SELECT doc_id, length(text) AS chars, -1 AS cleaned_at, CASE WHEN strpos(substr(text, 2), substr(text, 1, 1)) > 0 THEN NULL ELSE 0 END AS moved_at FROM documents WHERE length(text) > 0 AND length(trim(replace(text, chr(10), ' '))) > 0")
def cleaning_proof(spark, d):
    """Deletions leave a subsequence of each text (-1); its first character, looked for in the rest alone, need not stand there."""
    x = table(spark, d, "documents").filter("length(text) > 0 AND length(trim(replace(text, chr(10), ' '))) > 0")
    cleaned = tx.clean_statute(F.col("text"), ("[0-9]+",))
    return x.select("doc_id", F.length("text").cast("long").alias("chars"), F.coalesce(tx.foreign(F.col("text"), cleaned), F.lit(-1)).alias("cleaned_at"), tx.foreign(F.substr("text", F.lit(2)), F.substring("text", 1, 1)).alias("moved_at"))
