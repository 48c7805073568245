"""Candidate lines against a brute-force version, and the proof that a clean-up only deleted."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import candidates

WORDS = ["실적", "1억 5천만원", "2.5 억원", "3 천 만 원", "12,000", "공공기관", "지역 제한", "본점", "[지역: 가, 단위=기초]", "[지역: 나]", "인접", "배점", "서식", "입찰 참가", "자격", "일반", "업체", ""]


def brute(texts):
    """id's flags and counts by loops over lines."""
    said = [x.strip() for x in "\n".join(t or "" for t in texts or []).splitlines() if x.strip()]
    has = lambda name, x: re.search(candidates.PATTERNS[name], x) is not None
    near = [" ".join(said[max(0, i - 1) : i + 2]) for i in range(len(said))]
    near = [x for x in near if not has("bad", x)]
    of = {name: [x for x in near if has(name, x)] for name in ("experience", "institution", "region")}
    values = []
    for x in of["experience"]:
        for m in re.finditer(r"(\d[\d,]*(?:\.\d+)?)\s*(억|천\s*만|백\s*만|만)?\s*원?", x):
            values.append((int(float(m[1].replace(",", "")) * candidates.UNITS.get((m[2] or "").replace(" ", ""), 1)), m.start()))
    joined = " ".join(of["region"])
    flags = []
    if values and of["institution"]:
        flags.append("v4")
    if of["region"]:
        flags.append("v5")
    if any(has("basic", x) for x in of["region"]):
        flags.append("v6")
    if of["region"] and (has("adjacent", joined) or joined.count("[지역:") >= 2):
        flags.append("v7")
    return flags, [len(of[k]) for k in ("experience", "institution", "region")], values, has("qualification", "\n".join(t or "" for t in texts or []))


def test_candidates_equal_brute_force(spark):
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 4)))
    notices = [(i, [rng.choice(["\n", "\r\n", "\n\n"]).join(line() for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(0, 3))]) for i in range(300)]
    notices += [(900, None), (901, [None, ""]), (902, ["실적\n" * 40]), (903, ["입찰\n\n참가 자격"])]
    df = spark.createDataFrame([(i, None if t is None else [(x,) for x in t]) for i, t in notices], "id long, docs array<struct<text:string>>")
    seen = set()
    for r, (_, texts) in zip(candidates.extract(df).orderBy("id").collect(), notices, strict=True):
        flags, counts, values, qualified = brute(texts)
        assert r["flags"] == flags and [r["n_experience"], r["n_institution"], r["n_region"]] == counts, texts
        assert [(a["value"], a["start"]) for a in r["amounts"]] == values and r["qualified"] == qualified, texts
        assert [len(r["evidence"][k]) for k in candidates.SHOWN] == [min(n, most) for n, most in zip(counts, candidates.SHOWN.values(), strict=True)]
        seen.update(flags)
    assert seen == {"v4", "v5", "v6", "v7"}


def test_extra_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, [("실적 1억원",)], "x")], "id long, docs array<struct<text:string>>, flags string")
    assert candidates.extract(df).first()["n_experience"] == 1
    assert candidates.extract(df.limit(0)).collect() == []


def first_foreign(source, part):
    """By the longest prefix of `part` that is a subsequence, tried one by one."""
    for n in range(1, len(part) + 1):
        if re.search(".*?".join(map(re.escape, part[:n])), source, re.S) is None:
            return n - 1
    return None


@settings(max_examples=200, deadline=None)
@given(st.text("ab\n", max_size=12), st.text("ab\n", max_size=6))
def test_foreign_equals_brute_force(source, part):
    import pandas as pd

    got = tx.foreign.func(pd.Series([source]), pd.Series([part]))[0]
    assert (None if pd.isna(got) else int(got)) == first_foreign(source, part)


def test_clean_statute(spark):
    rows = [
        ("제1조(목적) <개정 2020.1.1> 이 법은\n\n  \n[전문개정 2019]\n<![CDATA[끝]]>  \n", "제1조(목적)  이 법은\n끝"), ("", ""), (None, None), (" \n ", ""), ("a\r\nb", "a\nb"), ("가" * 300_000 + "<신설 1>", "가" * 300_000),
    ]
    got = spark.createDataFrame(rows, "t string, want string").select("want", tx.clean_statute(F.col("t")).alias("got"), tx.foreign(F.col("t"), tx.clean_statute(F.col("t"))).alias("at"), tx.foreign(F.col("t"), F.lit("z")).alias("z")).collect()
    assert all(r["got"] == r["want"] and r["at"] is None and r["z"] == 0 for r in got)


def test_clean_up_that_adds_a_line_end_is_told(spark):
    df = spark.createDataFrame([("a\x0bb",)], "t string")
    assert df.select(tx.foreign(F.col("t"), tx.clean_statute(F.col("t")))).first()[0] == 1
