"""Inputs on which mining and fitting must not take exponential or quadratic time."""

import random
import time

import pytest

from lectern.llm import html_extract, url_filters


def test_urls_with_many_shared_words(spark):
    words = "/".join(f"w{i}" for i in range(40))
    known = [(i, f"https://h{i % 5}.net/es/{words}/promo/{i}") for i in range(100)] + [(100 + i, f"https://h{i % 5}.com/x/{words}/story/{i}") for i in range(100)]
    asked = [(900, "https://q.org/w3/promo"), (901, "https://q.org/w3/w4/story"), (902, f"https://q.org/{words}/z"), (903, "https://h3.de/a/es/q")]
    began = time.perf_counter()
    rows = {r["page_id"]: r for r in url_filters.judge(spark.createDataFrame(known + asked, "page_id long, url string")).collect()}
    assert time.perf_counter() - began < 60
    assert [rows[k]["verdict"] for k, _ in asked] == ["block", "allow", "allow", "block"]


def test_items_stand_for_all_their_tokens(spark):
    """Rules over items, listed with every choice of tokens, are the pruned rules that counting finds."""
    rng = random.Random(2)
    data = []
    for _ in range(120):
        tokens = [t for group, p in ((("a", "b"), 0.5), (("c", "d", "e"), 0.6), (("f",), 0.4), (("g",), 0.3)) if rng.random() < p for t in group]
        data.append((tokens, "block" if ("a" in tokens and "c" in tokens) or "g" in tokens else rng.choice(["allow", "allow", "block"])))
    frame = spark.createDataFrame(data, "tokens array<string>, verdict string")
    got = {(tuple(r["items"]), r["verdict"]): round(r["confidence"], 6) for r in url_filters.mine(frame, 0.05, 0.7).collect()}
    want, names = {}, "abcdefg"
    for mask in range(1, 1 << len(names)):
        items = tuple(t for i, t in enumerate(names) if mask >> i & 1)
        own = [v for t, v in data if set(items) <= set(t)]
        for v in ("block", "allow"):
            if own and own.count(v) / len(own) >= 0.7 and own.count(v) / len(data) >= 0.05:
                want[items, v] = own.count(v) / len(own)
    pruned = {k: round(c, 6) for k, c in want.items() if not any(set(o[0]) < set(k[0]) and o[1] == k[1] and oc >= c for o, oc in want.items())}
    assert got == pruned and len(got) > 4


@pytest.mark.parametrize("piece", ["<article>", "<article", "<", "</p>", "<main>x</main", "<p>a</p>", "</article >"])
def test_dressing_in_linear_time(piece):
    page = "<article><p>one</p>" + piece * (1_000_000 // len(piece)) + "</article>"
    began = time.perf_counter()
    assert html_extract.dressed(page, random.Random(1), 0)
    assert html_extract.dressed(piece * (1_000_000 // len(piece)), random.Random(1), 0) is not None
    assert time.perf_counter() - began < 2


def test_main_element():
    assert html_extract._main("a<MAIN id='x'>b</main>c</Main >d") == ("MAIN", 1, 14, 23, 31)
    assert html_extract._main("<article><main>b</main>") == ("main", 9, 15, 16, 23)
    assert html_extract._main("<article>b") is None and html_extract._main("<articles>b</articles>") is None and html_extract._main("<article") is None
