"""Runs held against brute force over all periods and places; damage, longest run and collapsed text in plain Python."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import periodic_runs as pr


def brute(words):
    """(start, length, period) of all runs: for each period the longest stretches that keep it, if it is their smallest."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= 2 * q:
                found.setdefault((i, length), q)  # a smaller period of the same stretch came first
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items() if n >= pr.LEAST)


def as_rows(found):
    return sorted((int(s), int(n), int(q)) for _, s, n, q in zip(*found, strict=True))


def hashes(words):
    return np.array([(zlib.crc32(str(w).encode()) << 20) + 7 for w in words], np.uint64)


def made(rng):
    """Words with runs within runs."""
    out = []
    for _ in range(rng.randint(1, 5)):
        part = [rng.choice("abc") for _ in range(rng.randint(1, rng.choice([3, 9, 30])))]
        out += part * rng.randint(1, rng.choice([2, 4, 14]))
        out += [rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))]
    return out * rng.choice([1, 1, 2])


def test_runs_are_all_runs():
    rng = random.Random(5)
    for _ in range(700):
        docs = [made(rng) if rng.random() < 0.8 else [rng.choice("ab") for _ in range(rng.randint(0, 60))] for _ in range(rng.randint(1, 3))]
        bounds = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
        doc, *rest = pr.runs(hashes(sum(docs, [])), bounds)
        for d, words in enumerate(docs):
            assert as_rows((doc[doc == d], *(c[doc == d] for c in rest))) == brute(words), words


def test_words_of_the_fibonacci_word():
    """A word with as many runs as a word can have, nearly."""
    a, b = "a", "ab"
    while len(b) < 400:
        a, b = b, b + a
    assert as_rows(pr.runs(hashes(b), np.array([0, len(b)]))) == brute(b)


@pytest.mark.parametrize("words", [["x"] * 300_000, ["a", "b", "c"] * 100_000, [w for i in range(40_000) for w in ("so", "it", "is", "said", "here", "again", i)]])
def test_long_texts_in_good_time(words):
    began = time.perf_counter()
    got = as_rows(pr.runs(hashes(words), np.array([0, len(words)])))
    assert time.perf_counter() - began < 30
    assert got == ([(0, len(words), len(set(words[:9])))] if len(set(words)) < 9 else [])


def by_hand(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and words and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    said = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (len(words), len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


NAMES = ["n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in pr.registered(spark, sf).collect()}
    assert len(got) == len(texts)
    for doc_id, text in texts:
        if len(text) < 6_000:
            assert got[doc_id] == by_hand(doc_id, text), doc_id
    assert sum(g[1] > 0 for g in got.values()) > len(got) / 20


def test_odd_rows(spark):
    rng = random.Random(1)
    odd = [(None, "a b " * 20), (None, None), (1, ""), (2, " \t\x0b\n"), (3, "x"), (3, "x " * 11), (3, "x\n" * 12), (4, "A a " * 9), (5, "y" * 300_000 + " z " * 2_000), (6, "é\xa0è  ü\x1f" * 30), *((i, " ".join(made(rng))) for i in range(7, 120))]
    frame = spark.createDataFrame(odd, "doc_id long, text string").coalesce(2).withColumns({c: F.lit("own") for c in ("length", "start", "runs", "n_words", "id", "collapsed")})
    got = pr.find(frame, plant=True, keep=("doc_id", "text", "length"), collapse=True).collect()
    assert sorted((tuple(r[c] for c in NAMES) for r in got), key=repr) == sorted((by_hand(*r) for r in odd), key=repr)
    for r in got:
        assert hashlib.sha256(r["collapsed"].encode()).hexdigest() == r["collapsed_sha256"]
        assert [tuple(x) for x in r["runs"]] == sorted(map(tuple, r["runs"])) and len(r["runs"]) == r["n_runs"]
    assert pr.find(frame.filter("false")).count() == 0


def test_unlike_words_of_one_hash(spark, monkeypatch):
    """Documents whose words the hash mixes up are done again by the words themselves."""
    monkeypatch.setattr(pr, "run_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    texts = [b"aa bb cc dd " * 6, b"ab cd " * 20, b"once upon a time there was " * 3]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    starts, ends, bounds = pr._words(data, offsets)
    h = pr.run_hashes(data, starts, ends)
    doc, *rest = pr._checked(data, starts, ends, h, bounds, pr.runs(h, bounds))
    for d, t in enumerate(texts):
        assert as_rows((doc[doc == d], *(c[doc == d] for c in rest))) == brute(t.split())
