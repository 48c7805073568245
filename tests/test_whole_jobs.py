"""Queries that look at all of their input, on small tables made for it."""

import random
from collections import defaultdict

import pytest
from compare import differ

from lectern.operators import retrieval
from lectern.plans import registry

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def run(spark, tmp_path, name, docs, items=()):
    rows = [(i, t, "en", "web", len(t or "") or 1) for i, t in enumerate(docs)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return registry.queries()[name](spark, str(tmp_path))


def test_evidence_whole_audit(spark, tmp_path):
    long = "=" + " ".join(f"word{i}" for i in range(120))
    docs = [f"xx {long} yy", "a bar, baz\nqux b", "rebar, baz\nquxes", "one", None, "", "é=+@", "Bar, baz\nqux", long[:300]]
    items = [(1, long), (2, "bar, baz\nqux"), (3, "ar, baz\nqu"), (4, "one"), (5, ""), (6, None), (7, "+@"), (7, "bar"), (8, "+ bar baz"), (9, long[:60])]
    got = {r["item_id"]: tuple(r)[1:] for r in run(spark, tmp_path, "evidence_whole_audit", docs, items).collect()}
    want = {}
    for k, said in items:
        own = (len(docs), sum(said in t for t in docs if t is not None) if said is not None else 0, len(docs) * (said or "").startswith(("=", "+", "@")), len(docs) * (len(said or "") > 500))
        want[k] = tuple(a + b for a, b in zip(want.get(k, (0, 0, 0, 0)), own, strict=True))
    assert got == want and got[1][3] == len(docs) and got[2][1] == 2


def test_review_rules_fire(spark, tmp_path):
    head = "3. 입찰참가자격\n"
    docs = [head + "- 2억원 이상의 실적\n", head + "- 업체 등록\n", "계약방법: 협상. 사업설명회에 불참한 업체는 입찰에 참가할 수 없음", head + "- 50원 이상의 실적\n"]
    got = {r["id"]: (r["v2"], r["v3"], r["v22"]) for r in run(spark, tmp_path, "review_rules", docs).collect()}
    assert (got["0"], got["1"], got["2"]) == ((1, 1, 0), (0, 0, 0), (0, 0, 1))


def test_candidate_union_keeps_every_short_item(spark, tmp_path):
    n = 100_050
    got = run(spark, tmp_path, "candidate_union", ["b a c"], [(i, "a") for i in range(n)])
    assert got.count() == n


@pytest.mark.parametrize("said", ["one two\nthree four five", "one\ntwo three four five", "one two three\nfour five"])
def test_candidate_union_splits_items_as_documents(spark, tmp_path, said):
    assert run(spark, tmp_path, "candidate_union", [f"so {said} it is"], [(1, said)]).count() == 1


def test_blocks_hold_every_row_once(spark):
    rows = spark.range(1000)
    parts = [{r["id"] for r in b.collect()} for b in retrieval.blocks(rows, 300)]
    assert len(parts) == 4 and sum(map(len, parts)) == 1000 and set().union(*parts) == set(range(1000))


def test_terms_without_weight_find_documents(spark):
    """A term that half of the documents hold weighs nothing, but who holds it is found."""
    asked, held = (spark.createDataFrame(rows, f"{k} long, words array<string>") for k, rows in (("q", [(1, ["a"])]), ("id", [(1, ["a", None]), (2, ["b"])])))
    assert [tuple(r) for r in retrieval.bm25_top(asked, held, 5, retrieval.FLOOR).collect()] == [(1, 1, 0.0, 1)]


ODD = "ab  \n\t\r\f\v\x1c\x85\xa0\u3000é\U0001f600"
TEXTS = [None, "", " ", " \n", "a", " a", "a ", "a  b", "a\v\vb", "a\xa0 \xa0b", "\u3000a\x1c\x1cb\x85", "\x00  \x00", *("a" * n + " " * m + "b" for n, m in ((0, 32768), (1, 32767), (32767, 2)))]


def mapped(spark, tmp_path, pairs):
    spark.createDataFrame([(i, t, "en", "web", 1) for i, t in pairs], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    return registry.queries()["whitespace_map"]


@pytest.mark.parametrize("times", [1, 3])
def test_whitespace_map_of_odd_texts(spark, tmp_path, times):
    """White space as in the SQL, no row without characters, and copies that share an id."""
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choices(ODD, k=rng.randrange(60))) for _ in range(200)]
    query = mapped(spark, tmp_path, [(i or None, t) for i, t in enumerate(texts)] * times)
    assert differ(query, registry.oracles()["whitespace_map"], spark, str(tmp_path)) is None


@pytest.mark.parametrize("most", [retrieval.MOST_IDS, 0])
def test_whitespace_map_of_texts_that_share_an_id(spark, tmp_path, monkeypatch, most):
    """The SQL leaves open which of several texts' characters of one place comes first; here white space is behind the others."""
    monkeypatch.setattr(retrieval, "MOST_IDS", most)
    rng = random.Random(5)
    pairs = [(rng.randrange(90) or None, "".join(rng.choices(ODD, k=rng.randrange(60)))) for _ in range(200)] + [(rng.choice([None, 1, 100, 101]), t) for t in TEXTS * 2]
    want, places = {}, defaultdict(list)
    for k, t in pairs:
        places[k] += [(i, c in {*" \t\n\r\f"}) for i, c in enumerate(t or "")] or [(0, False)] * (t == "")
    for k, held in places.items():
        held.sort()
        first = min((i for i, gap in held if not gap), default=None)
        kept = [i for (i, gap), (_, after) in zip(held, [*held[1:], (0, True)], strict=True) if not gap or (first is not None and i > first and not after)]
        if kept:
            want[k] = (len(kept), sum(kept))
    got = mapped(spark, tmp_path, pairs)(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["n"], r["offsets"]) for r in got} == want and len(got) == len(want)
