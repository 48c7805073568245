"""Segments against a plain reading of their definition."""

import random
import re

from pyspark.sql import functions as F

from lectern.operators import segments


def plain(docs, primary, secondary, reach, both, budget):
    ranked = []
    for n, d in enumerate(docs):
        lines = re.split(r"(?<=\n)", d["text"])
        hits = {i for i, s in enumerate(lines) if re.search(primary, s, re.I) or (both and re.search(secondary, s, re.I))}
        near = [any(abs(i - h) <= reach for h in hits) for i in range(len(lines))]
        i, at = 0, 0
        while i < len(lines):
            if not near[i]:
                at += len(lines[i])
                i += 1
                continue
            j = i
            while j < len(lines) and near[j]:
                j += 1
            text = "".join(lines[i:j])
            if text.strip():
                ranked.append((-(10 * len(re.findall(primary, text, re.I)) + 2 * len(re.findall(secondary, text, re.I))), n, at, d["doc_id"], text))
            at += len(text)
            i = j
    taken, used = [], 0
    for _, _, start, doc, text in sorted(ranked):
        if used >= budget:
            break
        if len(text) > budget - used:
            if not taken:
                taken.append((doc, start, text[:budget]))
                used = budget
            continue
        taken.append((doc, start, text))
        used += len(text)
    return sorted(taken), len(taken) < len(ranked)


def test_segments(spark):
    rng = random.Random(1)
    rows = []
    for k in range(60):
        docs = [{"doc_id": f"D{i}", "type": "t", "text": "".join(rng.choice(["alpha x", "beta", "plain words", " ", "alpha beta alpha"]) + rng.choice(["\n", " and more\n"]) for _ in range(rng.randint(0, 14)))} for i in range(2)]
        rows.append((str(k), docs))
    df = spark.createDataFrame(rows, "id string, docs array<struct<doc_id:string,type:string,text:string>>")
    for reach, both, budget in ((1, False, 60), (0, True, 25), (2, False, 1800)):
        got = df.select("id", segments.select(F.col("docs"), "alpha", "beta", reach, both, budget).alias("s")).collect()
        for r in got:
            want, cut = plain(dict(rows)[r["id"]], "alpha", "beta", reach, both, budget)
            assert ([(s["doc_id"], s["start"], s["text"]) for s in r["s"]["segments"]], r["s"]["truncated"]) == (want, cut)
