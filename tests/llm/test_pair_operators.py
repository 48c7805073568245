"""Joins, components, URL rules, pages and the pipeline against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import components, epsilon_grid, html_extract, jaccard_join, url_filters


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("task_links, gather", [(100_000, 1 << 20), (0, 1 << 20), (0, 7), (100_000, 7)])
def test_components(spark, monkeypatch, task_links, gather):
    """The same components from one task and from star rounds, also where a task's links are settled in parts."""
    monkeypatch.setattr(components, "TASK_LINKS", task_links)
    monkeypatch.setattr(components, "GATHER", gather)
    rng = random.Random(1)
    pairs = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5001 + i) for i in range(300)]
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    frame = spark.createDataFrame(pairs, "u long, v long").repartition(5)
    rows = [tuple(r) for r in components.components(frame).collect()]
    assert sorted(map(tuple, components.components(frame, most_links=frame.count()).collect())) == sorted(rows)
    assert len(rows) == len(set(rows)) and dict(rows) == union([p for p in pairs if p[0] != p[1]], nodes)


def test_components_of_nothing(spark):
    assert components.components(spark.createDataFrame([(3, 3)], "u long, v long")).collect() == []


def test_roots_of_a_long_path():
    """Links in any order; negative numbers are nodes like others."""
    n = np.arange(-500, 500)
    rng = np.random.default_rng(5)
    order = rng.permutation(len(n) - 1)
    nodes, root = components.roots(n[1:][order], n[:-1][order])
    assert (nodes == n).all() and (root == -500).all()


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_jaccard(rows):
    sets = {k: shingles(t) for k, t in rows}
    lists = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            lists[x].append(k)
    pairs = {(a, b) for v in lists.values() for i, a in enumerate(v) for b in v[i + 1 :]}
    links = []
    for a, b in pairs:
        n = len(sets[a] & sets[b])
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            links.append((a, b))
    roots = union(links, sets)
    return {k: (len(sets[k]), roots[k]) for k in sets}


def test_jaccard_join(spark, sf):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    crowd = []
    for i in range(120):  # near copies of all degrees, with a passage shared by unrelated texts
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w.insert(rng.randrange(len(w)), f"x{rng.randint(0, 999)}")
        crowd.append((10_000 + i, " ".join(w)))
    crowd += [(20_000 + i, " ".join(base[:25] + [f"y{i}_{j}" for j in range(rng.randint(3, 40))])) for i in range(60)]
    crowd += [(30_000 + i, t) for i, t in enumerate([None, "", " \n", "a b", "A b", "a  b", "zz", "b a"])]
    crowd += [(31_000 + i, " ".join(base)) for i in range(40)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(crowd, "doc_id long, text string"))
    frame = docs.withColumns({"id": F.lit(1), "n": F.lit("n"), "key": F.lit(0)})
    want = brute_jaccard([tuple(r) for r in docs.collect()])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(frame).collect()}
    assert got == want
    assert jaccard_join.join(frame.filter("false")).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 8))
    rows = [(i, (centres[i % 30] + rng.normal(size=8) * rng.choice([0.05, 0.2, 0.4])).astype("f4").tolist()) for i in range(500)]
    rows += [(600 + i, rows[0][1]) for i in range(50)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0, None] + [0.0] * 6), (904, []), (905, [float("inf")] + [1.0] * 7)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit("x"), "v": F.lit(0)})
    ok = [i for i, (k, v) in enumerate(rows) if k < 900]
    x = np.array([rows[i][1] for i in ok], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = np.triu(x @ x.T >= 0.9, 1)
    links = defaultdict(int)
    pairs = [(rows[ok[a]][0], rows[ok[b]][0]) for a, b in zip(*np.nonzero(near), strict=True)]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    roots = union(pairs, [k for k, _ in rows])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in epsilon_grid.link(frame, interval=64).collect()}
    assert got == {k: (links[k], roots[k], k == roots[k]) for k, _ in rows}
    assert epsilon_grid.link(frame.filter("false")).count() == 0


def test_url_rules(spark, sf):
    odd = [(90_001, None), (90_002, ""), (90_003, "abc"), (90_004, "http://EXAMPLE.com"), (90_005, "https://www.Example.com/en/x?y"), (90_006, "http://a.net/es/1"), (90_007, "x://net/fr/"), (90_008, "http://xnet/fr/"), (90_009, "http://net?/fr/")]
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").unionByName(spark.createDataFrame(odd, "page_id long, url string"))
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    rows = url_filters.judge(pages.withColumns({"rule": F.lit(1), "host": F.lit(2)})).collect()
    assert len(rows) == len(urls)
    for r in rows:
        m = re.search(r"://(.*)", urls[r["page_id"]] or "", re.S)
        rest = m[1] if m else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(h + p, v) for v, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda f: len(f[0])) if fits else (None, r["verdict"])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict) and verdict in ("allow", "block")


def test_mined_rules_by_counting(spark):
    data = [(["a", "b"], "block")] * 30 + [(["a"], "allow")] * 20 + [(["c", "b"], "allow")] * 30 + [(["c"], "allow")] * 20
    frame = spark.createDataFrame(data, "tokens array<string>, verdict string")
    got = {(tuple(r["items"]), r["verdict"]): round(r["confidence"], 6) for r in url_filters.mine(frame, 0.05, 0.8).collect()}
    want = {}
    for items in [("a",), ("b",), ("c",), ("a", "b"), ("b", "c")]:
        own = [v for t, v in data if set(items) <= set(t)]
        for v in ("block", "allow"):
            if own and own.count(v) / len(own) >= 0.8 and own.count(v) / len(data) >= 0.05:
                want[items, v] = round(own.count(v) / len(own), 6)
    pruned = {k: c for k, c in want.items() if not any(set(o[0]) < set(k[0]) and o[1] == k[1] and oc >= c for o, oc in want.items())}
    assert got == pruned


ARTICLE = """<html><head><title>T</title><script>var a = "</p>";</script></head><body><header class="site-header"><h2>My site</h2></header>
<div class="cookie-banner"><p>We use cookies here.</p></div><div id="content"><h1>Big story</h1><p>First paragraph of the story, long enough to count &amp; matter.</p>
<p>Second one, <b>bold</b>   text
here. More words follow.</p><div class="ad">Buy now</div><p>Third paragraph follows.</p></div><aside class="sidebar"><p>Some related text with words.</p></aside>
<section id="comments"><div class="comment"><p>Great article! I liked it.</p></div></section><form><p>Subscribe now</p><input></form><footer>c 2020</footer></body></html>"""


def test_html_extraction(spark, sf):
    import html

    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    odd = spark.createDataFrame([(900, "u", None), (901, None, ""), (902, "u", "plain text"), (903, "u", "<p>a<p>b"), (904, "u", "<" * 3000), (905, "u", ARTICLE)], "page_id long, url string, html string")
    frame = pages.unionByName(odd).withColumns({"text": F.lit(1), "n_chars": F.lit(2)})
    got = {r["page_id"]: r for r in html_extract.extract(frame, learn_from=pages).collect()}
    assert len(got) == frame.count() and all(r["n_chars"] == len(r["text"]) for r in got.values())
    good = 0
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?p>|</?h1>", inner))
        good += got[r["page_id"]]["text"] == "\n".join(b for b in blocks if b)
    assert good >= 0.95 * pages.count()
    assert got[900]["text"] == got[901]["text"] == ""
    text = got[905]["text"]
    assert "First paragraph of the story, long enough to count & matter." in text and "bold text here." in text
    assert not any(s in text for s in ("cookies", "Buy now", "related text", "Great article", "Subscribe", "2020", "var a"))


def test_pipeline(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = first = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in pipeline.STAGES[:2]:
        docs = stage(spark, docs, sf)
        assert docs.columns == first.columns, name
    want = brute_jaccard([(r["doc_id"], r["text"]) for r in first.collect() if re.search(r"[^\W\d_]", r["text"] or "")])
    assert {r["doc_id"] for r in docs.collect()} == {k for k, (_, c) in want.items() if c == k}
    for name, stage in pipeline.STAGES[2:4]:
        docs = stage(spark, docs, sf)
        assert docs.columns == first.columns, name
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    assert pipeline.STAGES[4][1](spark, docs, sf).select("doc_id").distinct().count() == docs.count()
