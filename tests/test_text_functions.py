"""Money, levels, guards, packing and windows on small fixtures."""

import time

import pyarrow as pa
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import sequences as seq


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_money(spark):
    cases = {"3천만원": 30_000_000, "1억 5천만원": 150_000_000, "1.5억원": 150_000_000, "50,000천원": 50_000_000, "300백만원": 300_000_000, "1억 5,000만원": 150_000_000}
    rows = spark.createDataFrame(list(cases), "string").select("value", tx.money(F.col("value")).alias("y")).collect()
    assert {r["value"]: r["y"] for r in rows} == cases


def test_amount_needs_to_be_positive(spark):
    cases = {"1,200": 1200, "0": None, "-5": None, "three": None, "2024년 5월": None, "1,200.5": None, "1200.5": 1200, "약 3억원": None, " 3억원 ": 300_000_000, "1억 5천만원": 150_000_000, "5": 5}
    assert {v: one(spark, v, tx.amount) for v in cases} == cases and one(spark, None, tx.amount) is None


def test_guard_and_collapse(spark):
    assert one(spark, "=1+1", tx.safe) is None and one(spark, "a=1", tx.safe) == "a=1"
    assert one(spark, " a \u00a0\n b ", tx.collapse) == "a b"


def test_levels(spark):
    assert [one(spark, h, tx.levels) for h in ("1.자격", "2)자격", "제3장자격", "Ⅳ.자격", "제2절", "5:자격", "가.자격", "자격")] == [1, 2, 0, 0, 1, 1, None, None]


def test_greedy_skips_but_goes_on(spark):
    df = spark.sql("SELECT array(struct(1L AS id, 6L AS size), struct(2L AS id, 7L AS size), struct(3L AS id, 4L AS size)) AS a")
    assert df.select(seq.greedy(F.col("a"), 10).alias("ids")).first()["ids"] == [1, 3]


def test_whitespace_offsets_map_back(spark):
    text = "  a \n\t b  c "
    r = spark.createDataFrame([(text,)], "x string").select(tx.collapse_with_map("x").alias("c")).first()["c"]
    assert r["text"] == "a b c" and [text[i] for i in r["at"] if not text[i].isspace()] == ["a", "b", "c"]


def test_spans(spark):
    r = spark.createDataFrame([("é12 x3",)], "x string").select(tx.spans(r"\d+")("x").alias("s")).first()["s"]
    assert [(m["start"], m["end"], m["text"]) for m in r] == [(1, 3, "12"), (5, 6, "3")]


def test_lines_of_empty_and_unicode(spark):
    df = spark.createDataFrame([(1, ""), (2, "é\n\nb"), (3, "a\r\nb\rc\u2028d\n")], "k long, text string")
    rows = sorted(map(tuple, seq.lines(df, "k").collect()))
    assert rows == [(1, 0, "", 0), (2, 0, "é", 0), (2, 1, "", 2), (2, 2, "b", 3), (3, 0, "a", 0), (3, 1, "b", 3), (3, 2, "c", 5), (3, 3, "d", 7), (3, 4, "", 9)]


def test_many_short_lines_in_linear_time(spark):
    n = 200_000
    df = spark.range(1).select("id", F.repeat(F.lit("ab\n"), n).alias("text"))
    began = time.perf_counter()
    assert seq.lines(df, "id").agg(F.max("start"), F.count("*")).first() == (3 * n, n + 1)
    assert time.perf_counter() - began < 10


def test_source_characters(spark):
    text = "a  b\n\tc d"
    rows = spark.createDataFrame([(text, 2, 3), (None, 0, 1), (text, None, None)], "t string, a long, n long")
    assert [r["x"] for r in rows.select(tx.source_slice("t", "a", "n").alias("x")).collect()] == ["b\n\tc", None, None]


def test_places_of_many_texts_are_told_in_parts(spark):
    """A batch's places are never in memory together."""
    import re

    pieces = [len(x) for x in tx.collapse_with_map.func(iter([pa.array(["ab " * 100_000] * 40 + [None, "", " \n", "　a\x85\x1c b "])]))]
    assert len(pieces) > 5 and sum(pieces) == 44
    texts = ["", " ", None, "a", " a", "a ", "a  b", "한 \U0001f600　x\x1fy\xa0\n", "a" * 9 + " \t" * 9 + "b"]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.collapse_with_map("t").alias("c")).collect():
        want = [i for i, c in enumerate(r["t"] or "") if not c.isspace() or (re.match(r"\s(?=\S)", r["t"][i:]) and r["t"][:i].strip())]
        assert (r["c"]["text"], r["c"]["at"]) == (" ".join((r["t"] or "").split()), want)


def test_a_proof_reads_arrow_row_by_row():
    """Whole batches of texts are never Python's."""
    assert tx.foreign.func(pa.array(["abc", None, "a"]), pa.array(["ca", "x", None])).to_pylist() == [1, 0, None]


def test_a_stray_is_found_in_arrow_row_by_row():
    assert tx.first_stray.func(pa.array(["ca", None, "ac", "b"]), pa.array(["abc", "x", "abc", None])).to_pylist() == [1, None, None, None]
