"""Evidence, replies, passages, recovery, numbers and whole-text search on small fixtures."""

import json
import re

from pyspark.sql import functions as F

from lectern.functions import replies
from lectern.operators import chunks, evidence, judge, retrieval
from lectern.plans.evaluation_queries import numbered
from lectern.streaming.folds import fold


def test_evidence(spark):
    docs = spark.createDataFrame([("a", "first text"), ("a", "second text"), ("b", "=1+1 third"), ("c", None)], "id string, text string")
    rows = [("a", "v1", 1, "second", False), ("a", "v2", 0, "second", False), ("a", "v3", 1, "fourth", False), ("b", "v1", 1, "=1+1", False), ("b", "v2", 1, "third", True), ("c", "v1", 1, "x", False), ("d", "v1", 1, None, False), ("a", "v4", 1, "", True)]
    claims = spark.createDataFrame(rows, "id string, item string, verdict int, evidence string, absence boolean")
    got = {(r["id"], r["item"]): (r["evidence"], r["dropped"]) for r in evidence.finalize(claims, docs).collect()}
    assert got == {("a", "v1"): ("second", False), ("a", "v2"): (None, False), ("a", "v3"): (None, True), ("b", "v1"): (None, True), ("b", "v2"): (None, False), ("c", "v1"): (None, True), ("d", "v1"): (None, False), ("a", "v4"): (None, False)}
    said = {(r["id"], r["item"]): r["reasons"] for r in evidence.reasons(claims.withColumn("evidence", F.when(F.col("item") == "v3", F.repeat(F.lit("=z"), 300)).otherwise(F.col("evidence"))), docs).collect()}
    assert said["a", "v3"] == ["too long", "unsafe start", "not in the source"] and said["a", "v2"] == ["negative verdict"] and said["b", "v2"] == ["item about absence"] and said["d", "v1"] == ["missing"] and said["a", "v4"] == []


def test_strict_replies(spark):
    good = '{"a": 1, "b": 0}'
    cases = {
        good: None, f"```json\n{good}\n```": None, f"```\n{good}\n```": None, good + " done": "no JSON", f"x ```json\n{good}\n```": "no JSON", '{"a": 1, "a": 0, "b": 1}': "no JSON", '{"a": NaN, "b": 0}': "no JSON",
        '{"a": true, "b": 0}': "a verdict is not 0 or 1", '{"a": 1.0, "b": 0}': "a verdict is not 0 or 1", '{"a": "1", "b": 0}': "a verdict is not 0 or 1", '{"a": 2, "b": 0}': "a verdict is not 0 or 1", '{"a": 1}': "other keys", '{"a": 1, "b": 0, "c": 0}': "other keys", "[1, 0]": "no object", "": "no JSON",
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", replies.strict(F.col("t"), F.lit("stop"), ["a", "b"]).alias("r")).collect()
    assert {r["t"]: r["r"]["error"] for r in rows} == cases
    assert {r["t"] for r in rows if r["r"]["fenced"]} == {t for t in cases if t.startswith("```")}
    cut = spark.createDataFrame([(good, "length"), (good, None)], "t string, f string").select(replies.strict(F.col("t"), F.col("f"), ["a", "b"])["error"].alias("e")).collect()
    assert [r["e"] for r in cut] == ["not finished"] * 2


def test_lenient_replies_and_verdicts(spark):
    one = '{"판정": {"v1": {"위반여부": "true", "근거문구": "x"}, "v2": {"violation": false}, "v3": 5}}'
    texts = [one, f"so\n```json\n{one}\n```\nend", f"here: {one}.", "nothing", "", None, "{broken", "```json\nno\n```" + one]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(replies.lenient(F.col("t")).alias("j"), replies.verdicts(F.col("t"), ["v1", "v2", "v3"]).alias("v")).collect()
    assert [r["j"] is not None and json.loads(r["j"]) == json.loads(one) for r in rows] == [True, True, True, False, False, False, False, True]
    assert rows[0]["v"]["verdicts"] == {"v1": 1, "v2": 0, "v3": 0} and rows[0]["v"]["missing"] == ["v3"] and rows[3]["v"]["missing"] == ["v1", "v2", "v3"]


def test_sectioned_passages(spark):
    body = "머리말 줄\n" + "제1조(목적)\n" + "".join(f"내용 {i}번 줄입니다.\n" for i in range(60)) + "제2조의2\n짧은 글"
    rows = chunks.sectioned(spark.createDataFrame([("s", "text", "법", body), ("t", "text", "법", " ")], "source string, locator string, title string, text string"), budget=128, overlap=8).collect()
    assert all(r["text"] == body[r["char_start"] : r["char_end"]] and len(r["embedding_text"]) <= 128 for r in rows)
    covered = set().union(*(range(r["char_start"], r["char_end"]) for r in rows))
    assert all(i in covered or c.isspace() for i, c in enumerate(body)) and len({r["id"] for r in rows}) == len(rows)
    assert {r["section"] for r in rows} == {"", "제1조(목적)", "제2조의2"} and all(r["embedding_text"].startswith("법\n") for r in rows)
    starts = [m.start() for m in re.finditer("(?m)^제", body)]
    assert all(not (r["char_start"] < s < r["char_end"]) for r in rows for s in starts)
    spans = spark.createDataFrame([("a", 0, 2), ("a", 1, 3), ("a", 5, 6)], "id string, start long, stop long")
    texts = spark.createDataFrame([("a", "ab cd ef"), ("b", "x y"), ("c", "")], "id string, text string")
    assert {r["id"]: (r["total"], r["uncovered"]) for r in chunks.uncovered(texts, spans).collect()} == {"a": (6, 4), "b": (2, 2), "c": (0, 0)}


def test_recovery_in_steps(spark):
    def make_model():
        return lambda prompts: ['{"x": 1}' if "lost" not in p and ("bad" not in p or "late" in p) else "no" for p in prompts]

    task = spark.createDataFrame([("r1:a", "r1", "a", ["x"], "good"), ("r1:b", "r1", "b", ["x"], "lost"), ("r2:a", "r2", "a", ["x"], "late bad"), ("r3:a", "r3", "a", ["x"], "good")], "task_id string, id string, grp string, items array<string>, prompt string")
    first = judge.judge(task.withColumn("prompt", F.when(F.col("id") == "r2", "bad").otherwise(F.col("prompt"))), make_model)
    got = {r["task_id"]: (r["verdicts"], r["error"] is None, r["attempts"]) for r in judge.recover_in_steps(first, task, make_model).collect()}
    assert got == {"r1:a": ({"x": 1}, True, 2), "r1:b": (None, False, 6), "r2:a": ({"x": 1}, True, 3), "r3:a": ({"x": 1}, True, 1)}


def test_numbers_with_wide_rows(spark):
    n = 600_000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.repeat(F.lit("wide "), 20).alias("more"))
    got = numbered(df, "k")
    assert got.select("rn").distinct().count() == n and got.filter("rn <> k").isEmpty()


def test_contained_in_blocks(spark):
    docs = spark.createDataFrame([(1, "a needle here"), (2, "needles"), (3, None), (4, "")], "id long, text string")
    items = spark.createDataFrame([("x", "needle"), ("y", "le h"), ("z", ""), ("n", None), ("w", "needle")], "item string, said string")
    want = {(1, "x"), (1, "w"), (1, "y"), (2, "x"), (2, "w"), (1, "z"), (2, "z"), (4, "z")}
    for most in (1_000_000, 3):
        assert {tuple(r) for r in retrieval.contained(docs, items, most).collect()} == want


def test_folds_walk_each_key_in_order(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("k"), (-F.col("id")).alias("at"))
    step = lambda s, r: ({"n": (s or {"n": 0})["n"] + 1, "last": r["at"], "ok": s is None or (s["ok"] and r["at"] > s["last"])}, [])
    got = fold(rows, "k", ["at"], step, "k long, n long, ok boolean", lambda k, s: [(k, s["n"], s["ok"])]).collect()
    assert sorted(r["k"] for r in got) == list(range(7)) and sum(r["n"] for r in got) == 5000 and all(r["ok"] for r in got)


def test_gaps_of_a_long_text_take_linear_time(spark):
    """Each place is looked for near by, not from the begin of its text."""
    import time

    from pyspark.sql import functions as F

    from lectern.operators import chunks

    n = 1_000_000
    texts = spark.range(1).select(F.lit("a").alias("id"), F.repeat(F.lit("é b\n"), n // 4).alias("text"))
    spans = spark.range(n // 50).select(F.lit("a").alias("id"), (F.col("id") * 50).alias("start"), (F.col("id") * 50 + 45).alias("stop"))
    begin = time.time()
    assert [tuple(r) for r in chunks.uncovered(texts, spans).collect()] == [("a", n // 2, sum(1 for i in range(n) if i % 50 >= 45 and i % 4 in (0, 2)))]
    assert time.time() - begin < 15
