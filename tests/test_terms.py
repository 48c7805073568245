"""Terms counted in Arrow beside plain Python, and BM25 over texts beside BM25 over arrays of words."""

import math
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.functions import terms
from lectern.functions import text as tx
from lectern.operators import retrieval

TEXTS = ["ab ab abc", None, "", "x", "é9éab-ab", "a" * 70, "no wordſ İ ı", "—", "ab", " tail ab1", "1 22 333 22"]


def plain(text, pairs):
    words = re.findall("[a-z0-9]+", text or "")
    return Counter(words + [w[i : i + 2] for w in words for i in range(len(w) - 1)] * pairs)


@pytest.mark.parametrize("pairs", [False, True])
@pytest.mark.parametrize("rows, most", [(512, 1 << 20), (3, 1 << 20), (512, 1), (512, 12)])
def test_counts(monkeypatch, pairs, rows, most):
    monkeypatch.setattr(terms, "ROWS", rows)
    monkeypatch.setattr(terms, "BYTES", most)
    column = pa.array(["cut off", *TEXTS, "cut off"]).slice(1, len(TEXTS))
    got, size = [Counter() for _ in TEXTS], []
    for c in terms.counted(column, pairs):
        assert len(set(zip(c.of.tolist(), c.term.tolist(), strict=True))) == len(c.of)
        for i, t, n in zip(c.of.tolist(), c.term.tolist(), c.times.tolist(), strict=True):
            got[c.first + i][c.known[t].as_py()] += n
        size += c.size.tolist()
    assert got == [plain(t, pairs) for t in TEXTS] and size == [sum(g.values()) for g in got]


def test_counts_of_lists():
    column = pa.array([["a", None, "b", "a"], None, [], ["b"]], pa.list_(pa.string()))
    (c,) = terms.counted(column)
    found = sorted((i, c.known[t].as_py(), n) for i, t, n in zip(c.of.tolist(), c.term.tolist(), c.times.tolist(), strict=True))
    assert found == [(0, "a", 2), (0, "b", 1), (3, "b", 1)] and c.size.tolist() == [4, 0, 0, 1]


@pytest.mark.parametrize("floor", [None, retrieval.FLOOR])
@pytest.mark.parametrize("most", [500_000, 2])
def test_texts_rank_as_their_words(spark, monkeypatch, floor, most):
    monkeypatch.setattr(retrieval, "MOST_KINDS", most)
    monkeypatch.setattr(retrieval, "MOST_IDS", most)
    held = spark.createDataFrame([*enumerate(TEXTS), (20, "AB Abc K"), (21, "k ab")], "id long, text string")
    asked = spark.createDataFrame([(1, "ab abc"), (2, "k"), (3, "22 tail 22"), (4, None)], "q long, text string")
    words = [t.select(key, F.coalesce(tx.tokens(F.col("text")), F.array().cast("array<string>")).alias("words")) for t, key in ((asked, "q"), (held, "id"))]
    some = held.filter("id != 8").select("id")
    by_words = retrieval.bm25_top(*words, 3, floor, among=some).collect()
    by_text = retrieval.bm25_top(words[0], held, 3, floor, among=some, pairs=True).collect()
    assert sorted(by_text) == sorted(by_words) and len({r["q"] for r in by_text}) == 3 and 8 not in {r["id"] for r in by_text}


@pytest.mark.parametrize("floor", [None, retrieval.FLOOR])
def test_terms_that_nobody_asks_for_are_not_kept(spark, monkeypatch, floor):
    """Their number grows with the corpus; weights need only how many there are of each count of documents."""
    kept, cut = [], retrieval.cut

    def counting(df):
        kept.append(cut(df))
        return kept[-1]

    monkeypatch.setattr(retrieval, "cut", counting)
    held = spark.range(400).select("id", F.concat(F.lit("all ab "), F.concat_ws(" ", *(F.concat(F.lit(f"z{k}y"), F.col("id").cast("string")) for k in range(5)))).alias("text"))
    asked = spark.createDataFrame([(1, ["ab", "z3y7"]), (2, ["none", None])], "q long, words array<string>")
    best = sorted(retrieval.bm25_top(asked, held, 2, floor).collect(), key=lambda r: r["place"])
    assert sum(df.count() for df in kept) < 10 and [(r["q"], r["id"]) for r in best] == [(1, 7), (1, 0)]
    n, df, ln = 400, {"ab": 400, "z3y7": 1}, math.log
    raw = {t: ln(n - x + 0.5) - ln(x + 0.5) for t, x in df.items()}
    mean = (2 * raw["ab"] + 2000 * raw["z3y7"]) / 2002
    w = {t: ln((n - x + 0.5) / (x + 0.5) + 1) if floor is None else raw[t] if raw[t] >= 0 else floor * mean for t, x in df.items()}
    assert [r["score"] for r in best] == [round(w["ab"] + w["z3y7"], 6), round(w["ab"], 6)]
