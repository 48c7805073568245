"""Odd tables for every operator and the pipeline: nulls, empty tables, repeated rows and ids, ties, very long texts, clashing names."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import decontaminate, epsilon_grid, html_extract, jaccard_join, langid, licenses, packing, secrets, shared, token_counts, url_filters

LONG = "abcdefgh " * 120_000  # 1 MB
TEXTS = [(1, "the same words stand here and there again"), (1, "the same words stand here and there again"), (2, None), (2, ""), (3, "½ ²"), (None, "the same words stand here and there again"), (4, "x"), (5, LONG), (6, "a" * 300_000)]


@pytest.fixture(scope="module")
def odd(spark):
    frame = spark.createDataFrame(TEXTS, "doc_id long, text string")
    names = ["n_bytes", "n_tokens", "n_words", "n_hit", "items", "found", "labels", "lang_pred", "score", "id", "n", "print", "node", "key", "length", "component_id", "n_shingles"]
    return frame.withColumns({"lang": F.when(F.col("doc_id") == 1, "en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), **{n: F.lit("own") for n in names}})


def test_texts(spark, sf, odd):
    bench = spark.createDataFrame([(1, "stand here and there"), (None, "x"), (2, None)], "item_id long, text string")
    n = len(TEXTS)
    langs, probs = langid.learn(spark.read.parquet(f"{sf}/documents.parquet"))
    runs = {
        "op1": lambda df: token_counts.token_counts(df), "op2": lambda df: decontaminate.digest(decontaminate.find(df, bench)), "op3": lambda df: licenses.scan(df),
        "op7": lambda df: secrets.digest(secrets.scan(df)), "op8": lambda df: langid.identify(df, langs, probs), "op4": lambda df: jaccard_join.join(df),
    }
    for name, run in runs.items():
        assert run(odd).count() == n, name
        assert run(odd.filter("false")).count() == 0, name
    packed = packing.pack(odd)
    assert packed.filter("doc_id = 1").count() >= 2 and packing.pack(odd.filter("false")).count() == 0
    said = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(odd, langs, probs).collect()}
    assert (2, "und") in said and (3, "und") in said and (6, "und") not in said
    assert langid.identify(odd, langs, probs, keep=tuple(odd.columns)).columns.count("score") == 1
    own = {"n_bytes", "n_tokens", "over_limit"}
    assert set(token_counts.token_counts(odd, keep=("doc_id", "n_tokens")).columns) == {"doc_id", *own}


def test_jaccard_ids(spark):
    a, b = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen fifteen"
    rows = [(7, a), (7, b), (None, a), (None, b + " x"), (3, b), (3, b), (9, None), (None, None), (None, "q")]
    got = sorted(map(tuple, jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    want = sorted([(7, 4, 7), (7, 3, 3), (None, 4, 7), (None, 4, 3), (3, 3, 3), (3, 3, 3), (9, 0, 9), (None, 0, None), (None, 1, None)], key=repr)
    assert got == want


def test_jaccard_rounds_agree(spark):
    """Star rounds, blocks and parts of any size give the same components."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 300)}"
        rows.append((i, " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    first = {tuple(r) for r in jaccard_join.join(frame).collect()}
    assert {tuple(r) for r in jaccard_join.join(frame, star_rounds=0, part_bytes=2000).collect()} == first


def test_words_beyond_any_length():
    vocab = langid.vocabulary(langid.default_model())
    rng = np.random.default_rng(0)
    probs = rng.random((len(vocab) + 1, 3))
    probs /= probs.sum(0)
    probs[-1] = 1e-7
    words, counts = ["internationalisation", "donaudampfschifffahrt", "日本語", "a" * 40], rng.random((4, 3))
    whole, seen = langid.forward(words, vocab, probs), langid.expected(words, counts, vocab, probs)
    kept, langid._LONG = langid._LONG, 0
    try:
        assert np.allclose(langid.forward(words, vocab, probs), whole) and np.allclose(langid.expected(words, counts, vocab, probs), seen)
    finally:
        langid._LONG = kept
    # All segmentations, written out.
    pieces, w = langid.vocabulary(langid.default_model()), "▁nation"
    total = np.zeros(3)
    for cuts in itertools.product([0, 1], repeat=len(w) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(w)]
        p = np.ones(3)
        for i, j in itertools.pairwise(at):
            part = w[i:j]
            p = p * (probs[pieces[part]] if part in pieces else probs[-1] if j - i == 1 else 0)
        total += p
    assert np.allclose(langid.forward(["nation"], vocab, probs)[0], np.log(total))
    assert langid.words_of("½ ² Ⅷ") == [] and langid.words_of("x½y") == ["x", "y"]


def test_viterbi_by_enumeration():
    rng = np.random.default_rng(3)
    model = {"weights": rng.normal(size=(secrets.N_FEATURES, 3)), "moves": rng.normal(size=(3, 3))}
    rows = [(rng.random((n, secrets.N_FEATURES)) < 0.3).astype(float) for n in (1, 2, 5, 6)]
    for x, tags in zip(rows, secrets.viterbi(model, rows), strict=True):
        e, t = secrets._emissions(x, model["weights"]), model["moves"] + secrets._ALLOWED
        score = lambda s: secrets._START[s[0]] + sum(e[i, k] for i, k in enumerate(s)) + sum(t[a, b] for a, b in itertools.pairwise(s))  # noqa: B023, E731
        best = max(itertools.product(range(3), repeat=len(x)), key=score)
        assert math.isclose(score(tuple(tags)), score(best))


def test_secrets_of_kinds_that_were_never_labelled(spark, sf):
    """Recall of credentials that no base pattern knows, and silence on other texts, after a fit on the tables' own labels."""
    texts = [r["text"] for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("text").collect() if r["text"]]
    model = secrets.train([t for t in texts if secrets.base_spans(t)] + [t for t in texts if not secrets.base_spans(t) and any(c.isdigit() for c in t)])
    rng = random.Random(5)
    made = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    plain = [t[:400] for t in texts if not any(c.isdigit() for c in t) and " " in t[100:300]]
    for front in ("ghp_", "sk-", "Bearer "):
        good = 0
        for _ in range(40):
            t, said = rng.choice(plain), front + made(36)
            i = t.index(" ", 100)
            t = f"{t[:i]} {said} {t[i:]}"
            lo = t.index(said.split()[-1])
            for chain in secrets.chains(t):
                tags = secrets.viterbi(model, [secrets.features(t, chain)])[0]
                if any(a < lo + 36 and b > lo and k != 2 for (a, b), k in zip(chain, tags, strict=True)):
                    good += 1
                    break
        assert good >= 36, front
    silent = sum(not any((secrets.viterbi(model, [secrets.features(t, c)])[0] != 2).any() for c in secrets.chains(t)) for t in plain)
    assert silent >= 0.99 * len(plain)


def test_redaction_replaces_all_found_spans(spark):
    rows = spark.createDataFrame([(1, "a password = hunter22 b"), (2, None), (3, "nothing"), (4, "token=" + "0123456789abcdef" * 2 + "," + "x " * 200_000 + "secret: abcdefg")], "doc_id long, text string").withColumn("found", F.lit("own"))
    got = {r["doc_id"]: r for r in secrets.redact(rows).collect()}
    assert got[1]["text"] == "a [secret] b" and got[2]["text"] is None and got[3]["text"] == "nothing" and got[3]["found"] == "own"
    assert got[4]["text"].startswith("[secret],x ") and got[4]["text"].endswith("[secret]")


def test_mined_verdicts_by_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    pages = pages.unionByName(pages.limit(3)).unionByName(spark.createDataFrame([(None, None), (7_001, "http://a.de/x/y.html?q=1")], "page_id long, url string"))
    host, path = url_filters.host_and_path(F.col("url"))
    rows = pages.withColumns({"h": host, "p": path})
    rule, said = url_filters.fixed(F.col("h"), F.col("p"))
    rows = rows.withColumns({"rule": rule, "said": said, "tokens": url_filters.tokens(F.col("url"), F.col("h"), F.col("p"))})
    rules = url_filters.mine(rows.filter("rule IS NOT NULL").select("tokens", F.col("said").alias("verdict"))).collect()
    want = []
    for r in rows.collect():
        fits = [(m["confidence"], m["support"], m["size"], m["verdict"], m["rule_id"]) for m in rules if set(m["items"]) <= set(r["tokens"])]
        want.append((r["page_id"], r["said"] if r["rule"] else max(fits)[3] if fits else url_filters.DEFAULT))
    got = [(r["page_id"], r["verdict"]) for r in url_filters.judge(pages).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and url_filters.judge(pages.filter("false")).count() == 0


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert epsilon_grid.link(frame).count() == len(rows)
    rng = np.random.default_rng(1)
    for same in (True, False):
        linked = rng.random((40, 40)) < 0.03
        if same:
            linked &= np.triu(np.ones((40, 40), bool), 1)
        i, j = epsilon_grid._held(linked)
        assert len(i) <= 80
        full = epsilon_grid._roots(80, *(x + o for x, o in zip(np.nonzero(linked), (0, 0 if same else 40), strict=True)))
        assert (epsilon_grid._roots(80, i, j + (0 if same else 40)) == full).all()


def test_pages(spark):
    page = "<html><body><nav><p>menu</p></nav><article><p>Area <math><mi>r</mi></math> and <button>b</button> <object>alt text</object> end</p></article></body></html>"
    rows = [(1, "u", page), (1, "u", page), (None, None, None), (2, "u", ""), (3, "u", "<p>" + "word " * 200_000 + "</p>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("own"))
    got = html_extract.extract(frame, max_pages=2).collect()
    assert len(got) == 5 and [r["text"] for r in got if r["page_id"] == 1] == ["Area r and alt text end"] * 2
    assert html_extract.extract(frame.filter("false")).count() == 0


@pytest.mark.parametrize("bad", ["<a x ", '<a "', '<a ">" ', "<script>", "<svg><script>", "<!-- ", "<![ ", "<svg>", "<a b='", "</p>"])
def test_broken_pages_in_linear_time(bad):
    began = time.perf_counter()
    nodes = html_extract.order(html_extract.parse("<div><p>" + bad * (1_000_000 // len(bad))))
    assert len(nodes) >= 2 and time.perf_counter() - began < 10


def test_decoding_by_enumeration():
    """Of all choices that contradict no ancestor the best one is found."""
    page = "<body><div>a<p>b</p><p>c</p></div><div><p>d</p>e</div></body>"
    nodes = html_extract.order(html_extract.parse(page))
    rng = np.random.default_rng(4)
    for _ in range(20):
        p = rng.random(len(nodes)) * 0.98 + 0.01
        choice = html_extract.decode(nodes, p)
        weight = [1.0 if any(isinstance(s, str) and s and not s.isspace() for s in n.parts) else 0.3 for n in nodes]
        above = html_extract.parents(nodes)

        def score(c):
            total = 0.0
            for i, n in enumerate(nodes):
                own = c[i]
                if n.parent is not None and c[above[i]] != -1 and own != c[above[i]]:
                    return -math.inf
                if own == -1 and not n.children:
                    return -math.inf
                if own == -1:
                    total += (weight[i] * max(math.log(p[i]), math.log(1 - p[i])) if weight[i] == 1.0 else 0.0) - html_extract.MIXED_COST
                else:
                    total += weight[i] * math.log(p[i] if own else 1 - p[i])
            return total

        best = max(map(score, itertools.product((0, 1, -1), repeat=len(nodes))))
        assert math.isclose(score(choice), best, abs_tol=1e-9)


def test_long_texts_in_linear_time(spark):
    frame = spark.createDataFrame([(1, "cc by " * 16_000), (2, "a" * 1_000_000), (3, "1" * 1_000_000)], "doc_id long, text string")
    began = time.perf_counter()
    assert {r["doc_id"]: r["n_base"] for r in licenses.scan(frame).collect()} == {1: 16_000, 2: 0, 3: 0}
    assert secrets.digest(secrets.scan(frame)).count() == 3
    assert time.perf_counter() - began < 90


def test_checkpoints_need_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Frame:
        sparkSession = type("S", (), {"sparkContext": Context()})()

    with pytest.raises(RuntimeError):
        shared.cut(Frame())


def test_pipeline_on_odd_tables(spark, sf, odd):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = odd.withColumn("lang", F.when(F.col("doc_id").isin(1, 5), "en"))
    for frame in (docs, docs.filter("false")):
        now = frame
        for name, stage in pipeline.STAGES[:4]:
            now = stage(spark, now, sf)
            assert now.columns == frame.columns, name
        kept = [r["doc_id"] for r in now.collect()]
        assert pipeline.STAGES[4][1](spark, now, sf).count() >= len(kept)
    first = [r["doc_id"] for r in pipeline.STAGES[0][1](spark, docs, sf).collect()]
    assert 2 not in first and 3 not in first and first.count(1) == 2 and None in first
