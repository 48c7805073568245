"""Review rules on small notices: boundaries are strict, excluded contexts decide 0."""

import re
import time

import pytest
from pyspark.sql import functions as F

from lectern.operators import rules

HEAD = "3. 입찰참가자격\n"


def notice(text, **meta):
    base = {"입찰추정가격": "100000000", "배정예산금액": "110000000", "적용계약법": "국가계약법", "업무구분": "일반용역", "계약방법": "제한경쟁"}
    return ("n", {**base, **meta}, [{"doc_id": "D0", "type": "공고문", "text": text}])


def judged(spark, *notices):
    return rules.judge(spark.createDataFrame([(f"{i}", *n[1:]) for i, n in enumerate(notices)], rules.NOTICE)).orderBy("id").collect()


@pytest.mark.parametrize(
    ("text", "meta", "v2", "v3"),
    [
        (HEAD + "- 최근 3년간 단일 계약 1억 5천만원 이상의 실적이 있는 업체\n", {}, 1, 1),
        (HEAD + "- 1억 1천만원 이상의 수행실적을 보유한 자\n", {}, 1, 0),  # amount equals budget
        (HEAD + "- 2억원 이상의 실적\n", {"입찰추정가격": "230000000"}, 0, 1),  # estimate equals threshold
        (HEAD + "- 2억원 이상의 실적\n", {"입찰추정가격": "229,999,999"}, 1, 1),
        (HEAD + "- 2억원 이상의 실적\n", {"적용계약법": "기타"}, 0, 1),
        (HEAD + "- 2억원 이상의 실적\n", {"업무구분": "공사"}, 0, 1),
        (HEAD + "- 실적 배점표: 2억원 이상 10점\n", {}, 0, 0),
        (HEAD + "- 1억원 이상 2억원 미만의 실적\n", {}, 0, 0),
        (HEAD + "- 업체 등록\n4. 제출서류\n- 2억원 이상의 실적증명\n", {}, 0, 0),
        (HEAD + "1) 등록업체\n2) 300백만원 이상 실적\n", {}, 1, 1),
        ("2억원 이상의 실적\n", {}, 0, 0),
        ("입찰참가자격등록증 사본\n- 2억원 이상의 실적\n", {}, 0, 0),
        ("", {}, 0, 0),
    ],
)
def test_experience(spark, text, meta, v2, v3):
    r = judged(spark, notice(text, **meta))[0]
    assert (r["v2"], r["v3"]) == (v2, v3)
    assert (r["e2"] is not None) == bool(v2) and (r["e2"] is None or r["e2"] in text)


def test_money_of_candidates(spark):
    r = judged(spark, notice(HEAD + "- 단일 1억 5,000만원 이상 또는 누계 50,000천원 이상의 실적\n"))[0]
    assert [c["amount"] for c in r["candidates"]] == [150_000_000, 50_000_000]


@pytest.mark.parametrize(
    ("text", "meta", "v22"),
    [
        ("사업설명회에 불참한 업체는 입찰에 참가할 수 없음", {"낙찰방법": "협상에 의한 계약"}, 1),
        ("현장설명 참석 업체에 한하여 제안서 제출 가능", {"낙찰방법": "협상"}, 1),
        ("입찰 참가자격: 제안요청 설명회에 참석한 업체", {"계약방법": "협상"}, 1),
        ("사업설명회에 불참한 업체는 입찰에 참가할 수 없음", {}, 0),
        ("계약방법: 협상. 사업설명회에 불참한 업체는 입찰에\n참가할 수 없음", {}, 1),
        ("제안서 설명회(평가)에 불참한 업체는 제안서 평가 대상에서 제외", {"낙찰방법": "협상"}, 0),
        ("사업설명회는 자율 참석", {"낙찰방법": "협상"}, 0),
    ],
)
def test_briefing(spark, text, meta, v22):
    assert judged(spark, notice(text, **meta))[0]["v22"] == v22


def test_order_of_notices_does_not_matter(spark):
    many = [notice(HEAD + f"- {n}억원 이상의 실적\n") for n in range(1, 6)]
    assert [r["v3"] for r in judged(spark, *many)] == [0, 1, 1, 1, 1]


def test_evidence_of_briefings_is_the_source(spark):
    text = "계약방법: 협상.\n사업설명회에  불참한 업체는 입찰에\n\t참가할 수 없음"
    r = judged(spark, notice(text))[0]
    assert r["v22"] == 1 and r["e22"] in text and "입찰에\n\t참가" in r["e22"]


def test_lines_end_at_all_line_ends(spark):
    for end in ("\n", "\r\n", "\r", "\u2028", "\x0b"):
        text = end.join(["3. 입찰참가자격", "- 2억원 이상의 실적", "4. 제출서류", "- 3억원 이상의 실적"])
        r = judged(spark, notice(text))[0]
        assert [c["amount"] for c in r["candidates"]] == [200_000_000]


def test_matches_with_offsets_and_surroundings(spark):
    text = "x" * 50 + "12 y 345" + "é" * 45 + "6"
    got = spark.createDataFrame([(text,), ("none",), ("7",), (None,)], "t string").select(rules.matches(F.col("t"), "[0-9]+").alias("m")).collect()
    want = [[(m.start(), m[0], t[max(0, m.start() - 40) : m.start()], t[m.end() : m.end() + 40]) for m in re.finditer("[0-9]+", t)] for t in (text, "none", "7")]
    assert [[tuple(m) for m in r["m"] or ()] for r in got] == [*want, []]


def test_many_matches_in_linear_time(spark):
    df = spark.range(1).select(F.repeat(F.lit("2억원 이상의 실적 "), 20_000).alias("t"))
    began = time.perf_counter()
    assert df.select(F.size(rules.matches(F.col("t"), rules.MONEY))).first()[0] == 20_000
    assert time.perf_counter() - began < 10
