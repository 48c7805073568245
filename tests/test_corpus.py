"""Corpora from files to answers: stacked table headers, passages, encoders, places of items, numbered lines, files per record."""

import gzip
import json
import random
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import chunks, encoders, retrieval
from lectern.sources import readers, writers


def cell(text, y, x, rows=1, cols=1, header=0):
    paragraphs = "".join(f"<hp:p><hp:run><hp:t>{t}</hp:t></hp:run></hp:p>" for t in text.split("|"))
    return f'<hp:tc header="{header}"><hp:subList>{paragraphs}</hp:subList><hp:cellAddr colAddr="{x}" rowAddr="{y}"/><hp:cellSpan colSpan="{cols}" rowSpan="{rows}"/></hp:tc>'


def document(path, *rows, body="고시 본문"):
    with zipfile.ZipFile(path, "w") as z:
        table = "".join(f"<hp:tr>{r}</hp:tr>" for r in rows)
        z.writestr("Contents/section0.xml", f'<s xmlns:hp="urn:test"><hp:p><hp:run><hp:t>{body}</hp:t></hp:run></hp:p><hp:p><hp:run><hp:tbl>{table}</hp:tbl></hp:run></hp:p></s>')


def test_stacked_headers(spark, tmp_path):
    document(
        tmp_path / "표.hwpx",
        cell("구분", 0, 0, rows=2, header=1) + cell("규격", 0, 1, cols=2, header=1) + cell("", 0, 3, header=1),
        cell("길이", 1, 1, header=1) + cell("무게", 1, 2, header=1) + cell("", 1, 3, header=1),
        cell("가|나", 2, 0, rows=2) + cell("10", 2, 1) + cell("", 2, 2) + cell("비고", 2, 3),
        cell("30", 3, 1, cols=2) + cell(" ", 3, 3),
        body="",
    )
    (tmp_path / "gone.hwpx").write_bytes(b"no archive")
    document(tmp_path / "none.hwpx", body="")
    files = readers.corpus(spark, str(tmp_path))
    rows = {r["locator"]: r["text"] for r in readers.table_rows(files).collect()}
    assert rows == {
        "Contents/section0.xml/table:1/row:3": "구분: 가 나\n규격 / 길이: 10\n열4: 비고",
        "Contents/section0.xml/table:1/row:4": "구분: 가 나\n규격 / 길이: 30\n규격 / 무게: 30",
    }
    told = {(r["title"], r["problem"]) for r in readers.titled_texts(files).collect()}
    assert told == {("표", None), ("gone", "File is not a zip file"), ("none", "no text")}


def test_cells_without_places(spark, tmp_path):
    """Cells that do not say where they stand follow one another; header rows are told apart by their cells only."""
    plain = lambda t, r=1, k=1, h=0: f"<tc header='{h}'><p><t>{t}</t></p><cellSpan rowSpan='{r}' colSpan='{k}'/></tc>"
    with zipfile.ZipFile(tmp_path / "a.hwpx", "w") as z:
        z.writestr("Contents/section0.xml", f"<s><p><tbl><tr>{plain('x', 2, 1, 1)}{plain('y', 1, 1, 1)}</tr><tr>{plain('z', 1, 1, 1)}</tr><tr>{plain('1')}{plain('2')}</tr></tbl></p></s>")
    assert [r["text"] for r in readers.table_rows(readers.corpus(spark, str(tmp_path))).collect()] == ["x: 1\ny / z: 2"]


TEXT = "법령 머리말\n제1조(목적) " + "긴 조문과 예외 사항.\n" * 100 + "제2조(끝) 마지막 단서." + " 그리고 끝없는 한 줄" * 60


def test_passages_keep_text_and_budget(spark):
    rows = [("법령.txt", "text", "법령 제목", TEXT), ("법령.txt", "other", "법령 제목", TEXT), ("a", "b", "t", None), ("a", "c", "t", " \n"), ("a", "d", "t", "")]
    frame = spark.createDataFrame(rows, "source string, locator string, title string, text string").withColumn("section", F.lit("own"))
    for tokenizer, budget in ((encoders.Characters(), 128), (encoders.Words(), 40)):
        got = chunks.sectioned(frame.drop("section"), tokenizer, budget, 8).collect()
        own = [r for r in got if r["locator"] == "text"]
        assert len(own) > 6 and len({r["id"] for r in got}) == len(got) == 2 * len(own)
        covered = set()
        tokens = [s for s, _ in tokenizer.offsets(TEXT)]
        for r in own:
            a, b = r["char_start"], r["char_end"]
            assert TEXT[a:b] == r["text"] and r["embedding_text"].endswith(r["text"]) and tokenizer.count(r["embedding_text"]) <= budget
            assert a == 0 or a in tokens and (b in tokens or b == len(TEXT) or TEXT[b - 1] == "\n")
            covered.update(range(a, b))
        assert all(i in covered for i, c in enumerate(TEXT) if not c.isspace())
        assert {r["section"] for r in own} == {"", "제1조(목적)", "제2조(끝)"}
        # Passages end at lines where they can.
        first = [r for r in own if r["section"] == "제1조(목적)"]
        assert all(r["text"].endswith("\n") for r in first)


def plain_spans(starts, text, room, overlap, budget):
    """Passages by their definition, token by token, for a tokenizer whose counts add up."""
    out, at = [], 0
    while True:
        lo = 0 if at == 0 else starts[at]
        stop = min(len(starts), at + room)
        hi = len(text) if stop == len(starts) else starts[stop]
        if stop < len(starts):
            lines = [i + 1 for i in range(lo + (hi - lo) // 2, hi) if text[i] == "\n"]
            if lines and (k := sum(s < lines[-1] for s in starts)) > at + overlap:
                stop, hi = k, lines[-1]
        out.append((lo, hi))
        if stop == len(starts):
            return out
        at = max(at + 1, stop - overlap)


def test_spans_by_their_definition():
    rng = random.Random(8)
    for _ in range(400):
        text = "".join(rng.choice(["ab ", "c", ".", "\n", "ddd ", "\n\n", " "]) for _ in range(rng.randint(1, 120)))
        starts = [a for a, _ in encoders.Words().offsets(text)]
        if not starts:
            continue
        room, overlap = rng.randint(3, 30), rng.randint(0, 1)
        spans = chunks.Spans(np.array(starts), np.array([m.end() for m in re.finditer("\n", text)], dtype=np.int64), len(text), lambda lo, hi: True)
        assert spans.plan(room, overlap) == plain_spans(starts, text, room, overlap, None), text


def test_passages_that_cannot_be(spark):
    frame = spark.createDataFrame([("s", "l", "a title that is long", "text")], "source string, locator string, title string, text string")
    with pytest.raises(Exception, match="leaves no room"):
        chunks.sectioned(frame, budget=24, overlap=4).collect()
    with pytest.raises(ValueError):
        chunks.sectioned(frame, budget=8, overlap=8)
    tight = chunks.Spans(np.arange(10), np.array([], np.int64), 10, lambda lo, hi: hi - lo <= 3)
    assert [b - a for a, b in tight.plan(8, 1)] == [3, 3, 3, 3, 2][: len(tight.plan(8, 1))]
    with pytest.raises(ValueError):
        chunks.Spans(np.arange(10), np.array([], np.int64), 10, lambda lo, hi: False).plan(8, 1)


@pytest.fixture
def corpus(tmp_path):
    c = tmp_path / "corpus"
    c.mkdir()
    (c / "입찰법.txt").write_text("제1조(입찰) 입찰 입찰 자격.\n")
    (c / "소프트웨어법.txt").write_text("제1조(참여) 소프트웨어 소프트웨어 사업.\n")
    return c


def _maker():
    def make():
        encoder = encoders.Terms("입찰", "소프트웨어")
        encoder.tokenizer, encoder.most_tokens = encoders.Characters(), 128
        return encoder

    return make


make = _maker()


def test_build_load_search(spark, tmp_path, corpus):
    (corpus / "복제.txt").write_text("제1조(입찰)  입찰 입찰 자격.\n")
    index = str(tmp_path / "index")
    assert encoders.build(spark, str(corpus), index, make, 128, 8) == 3
    asked = spark.createDataFrame([("second", "소프트웨어"), ("first", "입찰")], "q string, text string")
    best = {r["q"]: r for r in encoders.search(spark, index, asked, make, 1).collect()}
    assert best["second"]["title"] == "소프트웨어법" and "자격" in best["first"]["text"]
    assert encoders.search(spark, index, asked, make, 10).filter("q = 'first'").count() == 2  # equal texts once
    assert encoders.search(spark, index, asked.filter("false"), make).count() == 0
    for rows, k in (([("q", "")], 1), ([("", "입찰")], 1), ([("q", "입찰")], 0)):
        with pytest.raises(ValueError):
            encoders.search(spark, index, spark.createDataFrame(rows, "q string, text string"), make, k)
    with pytest.raises(ValueError):
        encoders.search(spark, index, asked, lambda: encoders.Hashing(3))
    with pytest.raises(ValueError):
        encoders.build(spark, str(corpus), index, make, 128, 8)
    with pytest.raises(Exception, match="more than 128"):
        encoders.encode(spark.createDataFrame([("x" * 200,)], "text string"), make).collect()


@pytest.mark.parametrize("name, content", [("empty.txt", b""), ("unhandled.pdf", b"x")])
def test_sources_are_never_left_out(spark, tmp_path, corpus, name, content):
    (corpus / name).write_bytes(content)
    with pytest.raises(ValueError, match=name):
        encoders.build(spark, str(corpus), str(tmp_path / "index"), make, 128, 8)
    assert not (tmp_path / "index").exists()


def test_hashing_encoder():
    a, b, c = encoders.Hashing().encode(["입찰 참가 자격 요건", "입찰 참가 자격 조건", "weather report"])
    assert a @ b > 0.5 > a @ c and abs(a @ a - 1) < 1e-9
    with pytest.raises(ValueError):
        encoders.Hashing().encode([" "])


def test_places(spark):
    docs = [(0, "one\ntwo three\nfour\ntwo three"), (1, "a\\nb and a\nb"), (2, None), (3, "x a\nb"), (4, "")]
    items = [("p", "two three\nfour"), ("p", "two three\nfour"), ("q", "a\\nb"), ("r", ""), ("s", None), ("t", "nowhere"), ("v", "four"), ("v", "one")]
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    got = retrieval.places(frame(docs, "id long, text string"), frame(items, "item string, said string"), unescape=True)
    want = set()
    for i, text in docs:
        for item, said in items:
            if text is None or said is None:
                continue
            at, found, changed = text.find(said), said, False
            if at < 0 and "\\n" in said:
                at, found, changed = text.find(said.replace("\\n", "\n")), said.replace("\\n", "\n"), True
            if at >= 0:
                want.add((i, item, at, text[:at].count("\n") + 1, text[: at + len(found)].count("\n") + 1, changed))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    pairs = retrieval.contained(frame(docs, "id long, text string"), frame(items, "item string, said string")).collect()
    assert sorted(map(tuple, pairs)) == sorted({(i, item) for i, t in docs for item, s in items if t is not None and s is not None and s in t})


def test_grouped_top(spark):
    rng = np.random.default_rng(1)
    passages = [(i, v.tolist()) for i, v in enumerate(np.round(rng.normal(size=(300, 6)), 1))]
    queries = [(g, p, np.round(rng.normal(size=6), 1).tolist()) for g in (7, 8, 9) for p in range(g)]
    queries.append((9, 99, queries[-1][2]))
    want = []
    for g in (7, 8, 9):
        best = []
        for i, v in passages:
            scores = [(round(max(-1, min(1, float(np.dot(q, v)))), 6), -p) for h, p, q in queries if h == g]
            best.append((-max(scores)[0], i, -max(scores)[1]))
        want += [(g, i, p, -s, n) for n, (s, i, p) in enumerate(sorted(best)[:4], 1)]
    for cells in (10_000, 30):
        got = retrieval.grouped_top(spark.createDataFrame(queries, "g long, part long, qv array<double>"), spark.createDataFrame(passages, "id long, v array<double>").repartition(3), 4, cells)
        assert sorted(map(tuple, got.select("g", "id", "part", "score", "place").collect())) == sorted(want)


def test_numbered_lines(spark, tmp_path):
    rng = random.Random(3)
    want, n = [], 0
    for name in ("a.jsonl", "b.jsonl.gz", "c.jsonl"):
        lines = ["x" * rng.randint(0, 400) if rng.random() < 0.8 else " " for _ in range(2_000)]
        with (gzip.open if name.endswith("gz") else open)(tmp_path / name, "wt") as f:
            f.write("\n".join(lines) + "\n")
        for k, line in enumerate(lines, 1):
            if line.strip():
                want.append((name, k, n, line))
                n += 1
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = readers.numbered_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 10
        got = sorted((r["file"].rsplit("/", 1)[-1], r["line"], r["ord"], r["value"]) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)
    assert got == sorted(want)


def test_first_lines_and_line_problems(spark, tmp_path):
    good = {"id": "b", "meta": {"k": 1}, "docs": [{"doc_id": "D0", "type": "공고문", "text": "x"}]}
    lines = [json.dumps(good), "", "{broken", json.dumps({**good, "id": "a"}), json.dumps(good), json.dumps({**good, "id": ""}), "{late"]
    (tmp_path / "n.jsonl").write_text("\n".join(lines) + "\n")
    all_ = readers.numbered_notices(spark, str(tmp_path / "n.jsonl"))
    assert [r["id"] for r in all_.filter("_bad IS NULL").orderBy("ord").collect()] == ["b", "a", "b", ""]
    told = sorted((r["line"], r["problem"]) for r in readers.line_problems(all_).collect())
    assert told == [(3, "unreadable line"), (5, "repeated id"), (6, "no id"), (7, "unreadable line")]
    first = readers.numbered_notices(spark, str(tmp_path / "n.jsonl"), 3)
    assert [r["line"] for r in first.orderBy("ord").collect()] == [1, 3, 4]
    assert [r["line"] for r in readers.line_problems(first).collect()] == [3]


def test_a_file_per_record(spark, tmp_path):
    pages = spark.createDataFrame([(f"n{i}", f"# {i}\n가") for i in range(40)], "id string, page string").repartition(5)
    writers.file_per_row(pages, str(tmp_path / "md"))
    assert {f.name: f.read_text() for f in (tmp_path / "md").iterdir()} == {f"n{i}.md": f"# {i}\n가" for i in range(40)}
    for rows in ([("n1", "again")], [("x", "a"), ("x", "b")], [("../y", "a"), ("ok", "b")], [(None, "a"), ("ok", "b")]):
        with pytest.raises(Exception):
            writers.file_per_row(spark.createDataFrame(rows, "id string, page string").repartition(2), str(tmp_path / "md"))
        assert len(list((tmp_path / "md").iterdir())) == 40 and (tmp_path / "md" / "n1.md").read_text() == "# 1\n가"


def test_csv_with_mark(spark, tmp_path):
    writers.csv_with_mark(spark.createDataFrame([("가", 'a "b", c')], "id string, e string").coalesce(1), str(tmp_path / "c"))
    (part,) = (tmp_path / "c").glob("part-*")
    assert part.read_bytes() == "﻿id,e\n가,\"a \"\"b\"\", c\"\n".encode()
