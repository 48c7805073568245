"""The permutation by brute force, the law of its shards, and odd tables."""

import zlib
from collections import Counter

import pytest
from compare import differ
from pyspark.sql import functions as F

from lectern.llm import sharding as s


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 16, 17, 100, 255, 1_000, 1_003])
def test_permutation(n):
    for seed in ("a", "b"):
        p = s.Permutation(n, seed)
        places = [p.place(i) for i in range(n)]
        assert sorted(slot * s.SHARDS + shard for shard, slot in places) == list(range(n))
        assert [p.number_at(*at) for at in places] == list(range(n))
        walked = 0
        for i in range(n):
            x, passes = p.once(i), 0
            while x >= n:
                x, passes = p.once(x), passes + 1
            walked = max(walked, passes)
        assert walked == p.walk() and p.a * p.b - n < p.a + (n == 0)


def test_seeds_and_spread():
    a, b = (s.Permutation(10_000, seed) for seed in ("a", "b"))
    assert sum(a.place(i) == b.place(i) for i in range(10_000)) < 20
    # Neighbours are dealt apart: which shard follows which is even.
    pairs = Counter((a.place(i)[0], a.place(i + 1)[0]) for i in range(9_999))
    assert len(pairs) == 256 and max(pairs.values()) < 80


def test_huge_tables_stay_exact():
    p = s.Permutation((1 << 59) + 12_345)
    for number in (0, 1, 10**17, (1 << 59) + 12_344):
        x = p.once(number)
        assert 0 <= x < p.a * p.b and p.back(x) == number


def test_column_is_place(spark):
    for n in (1, 7, 17, 300):
        p = s.Permutation(n)
        got = [r["x"] for r in spark.range(n).select("id", p.column(F.col("id")).alias("x")).orderBy("id").collect()]
        assert [(x % s.SHARDS, x // s.SHARDS) for x in got] == [p.place(i) for i in range(n)]


def test_equals_sql(spark, sf):
    assert differ(s.registered, s.ORACLE, spark, sf) is None


def test_odd_rows(spark):
    rows = [(None, "a"), (None, None), (3, ""), (3, None), *[(5, "same")] * 700, (9, "ü" * 300_000), (4, "\x00")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS number", "2 AS shard", "3 AS size", "4 AS __at", "5 AS __part")
    got = s.shard(frame).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted(r["number"] for r in got) == list(range(len(rows)))
    each = {k: sorted(r["slot"] for r in got if r["shard"] == k) for k in range(s.SHARDS)}
    assert all(slots == list(range(len(slots))) for slots in each.values())
    assert max(map(len, each.values())) - min(map(len, each.values())) <= 1
    p = s.Permutation(len(rows))
    assert all(p.place(r["number"]) == (r["shard"], r["slot"]) for r in got)
    again = s.shard(frame.repartition(7, "text")).collect()
    key = lambda r: (str(r["doc_id"]), r["text_crc32"], r["number"], r["shard"], r["slot"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert s.shard(frame.filter("false")).count() == 0


def test_native(spark, sf):
    plan = s.registered(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
