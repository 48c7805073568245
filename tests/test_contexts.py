"""Contexts against a plain reading: pieces in order until the characters are used up, shrunk until the tokens fit."""

import hashlib
import random
import re
from collections import Counter

from lectern.operators import contexts, encoders
from lectern.plans import registry

TERMS, ORDER = ["alpha", "beta"], ["main", "annex"]
SCHEMA = "id string, docs array<struct<doc_id:string,type:string,text:string>>, dropped map<string,int>"


def plain(docs, most, dropped, terms=TERMS, order=ORDER):
    pool = sorted(docs, key=lambda d: (order.index(d["type"]) if d["type"] in order else len(order), d["doc_id"]))
    used, out, missing, cut = 0, [], Counter(dropped or {}), [False]

    def put(front, body):
        nonlocal used
        if most - used <= len(front) or not body:
            return
        cut[0] |= len(front + body) > most - used
        out.append((front + body)[: most - used])
        used += len(out[-1])

    for d in pool:
        if used >= most:
            missing[d["type"]] += 1
        else:
            put(f"[{d['type']}:{d['doc_id']}·앞부분]\n", d["text"][:1200])
    for d in pool:
        for k, p in enumerate(re.split(r"\n\s*\n", d["text"]), 1):
            if len(p) >= 10 and p.strip() and any(t in p for t in terms) and p not in d["text"][:1200]:
                if used >= most:
                    missing[d["type"]] += 1
                    break
                put(f"[{d['type']}:{d['doc_id']}·관련문단{k}]\n", p)
    if pool and not out:
        missing[pool[0]["type"]] += 1
    text = "\n\n".join(out)
    text += "\n\n[절단] 공고문 뒷부분이 길이 예산으로 잘렸다" if cut[0] else ""
    return text + ("\n\n[미수록 문서] " + ", ".join(f"{t} {n}건" for t, n in sorted(missing.items())) if missing else "")


def shrunk(docs, count, budget, most, dropped=None, **how):
    while True:
        text = plain(docs, most, dropped, **how)
        n = count(text)
        if n <= budget or most <= 2000:
            return text, n, most
        most = int(most * min(0.85, 0.95 * budget / n))


def test_contexts(spark):
    rng = random.Random(4)
    count = encoders.Words().count
    rows = [("none", [], None), ("wide", [{"doc_id": "1", "type": "main", "text": "alpha " * 90_000}], None)]
    for i in range(60):
        docs = []
        for k in range(rng.randint(1, 4)):
            text = "".join(rng.choice(["alpha and some more words here", "plain text of no use", "beta", "gamma " * 60, "alpha " * 50]) + rng.choice(["\n", "\n\n", "\n \n", " "]) for _ in range(rng.randint(0, 90)))
            docs.append({"doc_id": f"D{k}", "type": rng.choice(["main", "annex", "other"]), "text": text})
        rows.append((f"n{i}", docs, rng.choice([None, {}, {"other": 2}])))
    frame = spark.createDataFrame(rows, SCHEMA)
    for budget, most in ((400, 12_000), (5, 3_000), (10_000, 700)):
        got = {r["id"]: (r["context"], r["tokens"], r["size"]) for r in contexts.contexts(frame, TERMS, count, budget, most, ORDER).collect()}
        for i, docs, dropped in rows:
            assert got[i] == shrunk(docs, count, budget, most, dropped), i


def test_it_ends_for_every_count():
    found = [{"type": "t", "doc": -1, "front": "[t]\n", "body": "x" * 1200}] * 500
    for count in (lambda t: 10**9, lambda t: 901, len):
        text, tokens, size, tries = contexts.fitted(found, count, 900, 1_000_000)
        assert (tokens <= 900 or size <= contexts.LEAST) and tries < 60 and tokens == count(text)


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in registry.queries()["fitted_contexts"](spark, sf).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        text, tokens, size = shrunk([{"doc_id": str(i), "type": "notice", "text": t}], encoders.Words().count, 900, 12_000, terms=["licen", "tion", "ung"], order=[])
        assert (got[i]["tokens"], got[i]["size"], got[i]["context"]) == (tokens, size, hashlib.md5(text.encode()).hexdigest())
