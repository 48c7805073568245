"""Sources, sinks, chunks, the model seam and recovery on temporary files."""

import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.operators import chunks, judge
from lectern.sources import readers, writers


def test_notices(spark, tmp_path):
    good = {"id": "a", "meta": {"k": 1}, "docs": [{"doc_id": "D0", "type": "공고문", "text": "x"}], "labels": "secret"}
    lines = [good, {**good, "id": "b", "docs": []}, {**good, "id": "c", "docs": [{"doc_id": "D", "type": "기타", "text": "x"}]}, {**good, "id": ""}, good]
    with gzip.open(tmp_path / "n.jsonl.gz", "wt") as f:
        f.write("\n\n".join(json.dumps(x) for x in lines) + "\n{broken\n")
    df = readers.notices(spark, str(tmp_path / "n.jsonl.gz"))
    assert "labels" not in df.columns
    found = sorted((r["id"] or "", r["problem"]) for r in readers.problems(df.cache()).collect())
    assert found == [("", "no id"), ("", "unreadable line"), ("a", "repeated id"), ("b", "no documents"), ("c", "no main document")]


def test_strict_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿id,v1,v2\na,0,1\nb,2,1\na,1,0\n")
    table, found = readers.strict_csv(spark, str(tmp_path / "t.csv"), "id", ["v1", "v2"])
    assert table.count() == 3 and sorted(map(tuple, found.collect())) == [("a", "repeated key"), ("b", "v1 is not 0 or 1")]
    with pytest.raises(ValueError):
        readers.strict_csv(spark, str(tmp_path / "t.csv"), "id", ["v2", "v1"])


def test_corpus(spark, tmp_path):
    c = tmp_path / "c"
    (c / "sub").mkdir(parents=True)
    (c / "a.txt").write_text("﻿법 제1조", encoding="utf-8")
    (c / "sub" / "b.csv").write_text("번호,품목,특이사항\n00123,제품,예외 있음\n00124,,\n", encoding="utf-8")
    (c / "bad.pdf").write_bytes(b"x")
    (c / "empty.txt").write_bytes(b" \n")
    (c / "sub" / "none.txt").write_bytes(b"")
    cell = lambda t, r=1, k=1: f"<tc><p><t>{t}</t></p><cellSpan rowSpan='{r}' colSpan='{k}'/></tc>"
    with zipfile.ZipFile(c / "d.hwpx", "w") as z:
        z.writestr("Contents/section0.xml", f"<s><p><t>본문</t></p><p><tbl><tr>{cell('분류')}{cell('품목')}</tr><tr>{cell('공통', 2)}{cell('가')}</tr><tr>{cell('나')}</tr></tbl></p></s>")
    rows = readers.source_texts(readers.corpus(spark, str(c))).collect()
    texts = {r["text"] for r in rows if r["text"]}
    assert texts == {"법 제1조", "번호: 00123\n품목: 제품\n특이사항: 예외 있음", "번호: 00124", "본문", "분류: 공통\n품목: 가", "분류: 공통\n품목: 나"}
    assert sorted(r["problem"] for r in rows if r["problem"]) == ["no text", "no text", "unknown kind pdf"]


def test_log_numbers(spark, tmp_path):
    (tmp_path / "l.log").write_text("start\nkv cache 10.2 GiB\nmax concurrency 6.36x\n")
    r = readers.log_numbers(spark, str(tmp_path / "l.log"), {"gib": r"cache ([0-9.]+) GiB", "x": r"concurrency ([0-9.]+)x"}).agg(F.max("gib"), F.max("x")).first()
    assert tuple(r) == (10.2, 6.36)


def test_submission_refuses_gaps(spark, tmp_path):
    rows = [("a", "v1", 1, "x"), ("a", "v2", 0, None), ("b", "v1", 0, None)]
    df = spark.createDataFrame(rows, "id string, item string, verdict int, evidence string")
    with pytest.raises(ValueError):
        writers.submission(df, "id", ["v1", "v2"], str(tmp_path / "s"))
    writers.submission(df.filter("id = 'a'"), "id", ["v1", "v2"], str(tmp_path / "s"))
    writers.sparse(df, "id", ["v1", "v2"], str(tmp_path / "p"))
    assert spark.read.csv(str(tmp_path / "s"), header=True).columns == ["id", "v1", "v2", "e_v1", "e_v2"]
    assert {tuple(r) for r in spark.read.csv(str(tmp_path / "p"), header=True).collect()} == {("a", "1", "0"), ("b", "0", None)}


def test_markdown_and_publish(spark, tmp_path):
    n = spark.createDataFrame([("n", {"a|b": "<x>"}, [{"doc_id": "D", "type": "t", "text": "```code```"}])], "id string, meta map<string,string>, docs array<struct<doc_id:string,type:string,text:string>>")
    page = writers.markdown(n).first()["page"]
    assert "````\n```code```\n````" in page and "a\\|b" in page and "&lt;x>" in page
    good = spark.createDataFrame([("a", [1.0, 0.0])], "id string, vector array<double>")
    assert writers.publish(good, str(tmp_path / "i")) == 1
    with pytest.raises(Exception):
        writers.publish(good, str(tmp_path / "i"))
    with pytest.raises(ValueError):
        writers.publish(spark.createDataFrame([("a", [2.0, 0.0])], "id string, vector array<double>"), str(tmp_path / "j"))
    assert not (tmp_path / "j").exists() and writers.load_index(spark, str(tmp_path / "i")).count() == 1
    for wrong in ({"version": "2"}, {"signature": "other"}):
        with pytest.raises(ValueError):
            writers.load_index(spark, str(tmp_path / "i"), **wrong)
    good.withColumn("id", F.lit("z")).write.mode("overwrite").parquet(str(tmp_path / "i" / "passages"))
    with pytest.raises(ValueError):
        writers.load_index(spark, str(tmp_path / "i"))


def test_chunks_are_exact_and_cover(spark):
    text = "제1조\n" + "abc def 반복 문장\n" * 100 + "제2조 끝"
    df = spark.createDataFrame([("s", "l", text), ("s", "m", "")], "source string, locator string, text string")
    rows = sorted(chunks.passages(df, budget=128, overlap=8).collect(), key=lambda r: r["start"])
    assert all(text[r["start"] : r["end"]] == r["text"] and len(r["text"]) <= 128 for r in rows)
    covered = {i for r in rows for i in range(r["start"], r["end"])}
    assert all(i in covered for i, c in enumerate(text) if not c.isspace()) and len({r["id"] for r in rows}) == len(rows)


@pytest.mark.parametrize("reply", ['{"v1": 1, "v1": 0}', '{"v1": NaN}', '{"v1": true}', '{"v1": 1, "v2": 0}', "[1]", '{"v1": "1"}', "{"])
def test_strict_replies(reply):
    with pytest.raises(ValueError):
        judge.parse(reply, ["v1"])


def test_recovery_reruns_only_failures(spark):
    df = spark.createDataFrame([("a", "good"), ("b", "bad")], "id string, prompt string")
    task = judge.tasks(df, {"g1": ["v1", "v2"], "g2": ["v3"]})

    def flaky():
        return lambda prompts: ["{}" if p == "bad" else '{"v1": 1, "v2": 0}' for p in prompts]

    def steady():
        return lambda prompts: ['{"v3": 1}' for _ in prompts]

    first = judge.judge(task, flaky)
    rows = {r["task_id"]: r for r in first.collect()}
    assert rows["a:g1"]["verdicts"] == {"v1": 1, "v2": 0} and rows["a:g2"]["error"] and rows["b:g1"]["attempts"] == 2
    after = {r["task_id"]: r for r in judge.recover(first, task, steady).collect()}
    assert after["a:g1"]["verdicts"] == {"v1": 1, "v2": 0} and not after["a:g1"]["recovered"]
    assert after["b:g2"]["verdicts"] == {"v3": 1} and after["b:g1"]["error"]
    merged = {r["id"]: r for r in judge.records(judge.recover(first, task, steady)).collect()}
    assert merged["a"]["verdicts"] == {"v1": 1, "v2": 0, "v3": 1} and merged["b"]["verdicts"] is None and merged["b"]["error"]
