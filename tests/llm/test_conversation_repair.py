"""Repair of conversations held against brute force: a shortest path over (cost, edits) for the search, plain Python for all else."""

import hashlib
import heapq
import random
import re
import time
import zlib

import pytest

from lectern.llm import conversation_repair as cr

COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def cheapest(rows):
    """(cost, edits, roles) of least cost, then of least edits, by Dijkstra over rows x text of initials so far."""
    queue, done = [(0, "", 0, "")], set()
    while queue:
        cost, edits, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, edits
        for c in "ua":
            if re.fullmatch({"": "u", "s": "u", "u": "a", "a": "u"}[state], c):
                heapq.heappush(queue, (cost + 3, edits + "I", i, c))
        if i < len(rows):
            kind = rows[i]
            heapq.heappush(queue, (cost + 4, edits + "D", i + 1, state))
            if kind != "d":
                more = 3 * kind.isupper()
                for c in "ua":
                    if c == {"": "u", "s": "u", "u": "a", "a": "u"}[state]:
                        heapq.heappush(queue, (cost + 3 + more, edits + "R", i + 1, c))
                if kind.lower() in {"": "su", "s": "u", "u": "a", "a": "u"}[state]:
                    heapq.heappush(queue, (cost + more, edits + "K", i + 1, kind.lower()))


def by_hand(table):
    """The query in plain Python over (conv_id, turn, role, text)."""
    rows, ids = {}, set()
    for conv, turn, role, text in table:
        ids.add(conv)
        said = [" " if x is None else x for x in (conv, turn, role, text)]
        fate = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        role, text = ("user" if fate == 4 else said[2]), ("" if fate == 1 else re.sub("[.!?]", "", said[3]) if fate == 2 else said[3])
        rows.setdefault(conv, []).extend([] if fate == 0 else [(turn, role, text)] * (2 if fate == 3 else 1))
    out = {}
    for conv in ids:
        own = sorted(rows.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        turns = {r[0] for r in own if r[0] is not None}
        faults = []
        for i, (_, role, text) in enumerate(own):
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("b" if not solid else "d" if any(r[1:] == (role, text) for r in own[:i]) else "t" if solid[-1] not in ".!?" else "")
        kinds = "".join("d" if f in ("b", "d") and f else (k := role[:1] if role[:1] in ("s", "u", "a") else "o").upper() if f == "t" else (role[:1] if role[:1] in ("s", "u", "a") else "o") for (_, role, _), f in zip(own, faults, strict=True))
        cost, edits = cheapest(kinds)
        made, i, last = [], 0, ""
        for e in edits:
            new = {"": "user", "s": "user", "u": "assistant", "a": "user"}[last]
            if e == "I":
                made.append(f"{new}:")
                last = new[0]
                continue
            _, role, text = own[i]
            i += 1
            if e != "D":
                role = role if e == "K" else new
                made.append(f"{role}:{text}")
                last = role[0]
        assert re.fullmatch("(s?(ua)+)?", "".join(m[0] for m in made))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:], strict=False)]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, edits, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def test_search_is_cheapest_and_first():
    rng = random.Random(3)
    for n in [*range(8)] * 60 + [30, 70, 90]:
        rows = "".join(rng.choice(rng.choice(["suaUAod", "ua", "uaud"])) for _ in range(n))
        for block in (64, 5):
            assert cr.repair(rows, block) == cheapest(rows), rows


def test_long_conversations_in_linear_time():
    rng = random.Random(4)
    rows = "".join(rng.choice("uuaaUAods") for _ in range(40_000))
    began = time.perf_counter()
    cost, edits = cr.repair(rows)
    assert time.perf_counter() - began < 20 and len(edits.replace("I", "")) == 40_000 and cost > 0
    assert cr.repair("u" * 5_000)[0] == 3 * 2_500


def got(df):
    return {r["id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_query(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in cr.registered(spark, sf).collect()}
    assert rows == by_hand([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_odd_rows(spark):
    rng = random.Random(9)
    texts = ["Yes.", "No", "", " \t", None, "What?\n ", "Go! on", "\xa0", "x.\x0b"]
    table = [(c, rng.choice([None, *range(-3, 9)]), rng.choice(["user", "assistant", "system", None, "", "bot", "sys", "u"]), rng.choice(texts)) for c in [None, *range(60)] for _ in range(rng.randint(1, 12))]
    table += [(1000, t, "user", "x" * 300_000) for t in range(40)] + [(1001, t, ("user", "assistant")[t % 2], "same.") for t in range(500)]
    frame = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    named = frame.selectExpr("*", "1 AS id", "2 AS kind", "3 AS digest", "4 AS told", "5 AS audit", "6 AS gone", "7 AS cost")
    rows = cr.damaged(named)
    assert got(cr.repaired(rows, cr.audit(rows))) == by_hand(table)
    none = cr.damaged(frame.filter("false"))
    assert cr.repaired(none, cr.audit(none)).count() == 0


def test_dropped_whole(spark):
    gone = next((c, t) for c in range(100) for t in range(100) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    rows = cr.damaged(spark.createDataFrame([(*gone, "user", "Hello.")], "conv_id long, turn long, role string, text string"))
    assert got(cr.repaired(rows, cr.audit(rows))) == {gone[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("kind", ["string", "int"])
def test_texts_and_types(spark, kind):
    table = [("7", 0, "user", "Hello."), ("7", 1, "user", "Hello again."), ("7", 2, "assistant", "Well.")]
    frame = spark.createDataFrame(table, "conv_id string, turn int, role string, text string").selectExpr(f"CAST(conv_id AS {kind}) AS conv_id", "turn", "role", "text")
    rows = cr.damaged(frame)
    audits = cr.audit(rows)
    whole = sorted((r["place"], f"{r['role']}:{r['text']}") for r in cr.repaired(rows, audits, texts=True).collect())
    assert hashlib.sha256("\n".join(t for _, t in whole).encode()).hexdigest() == cr.repaired(rows, audits).first()["repaired_sha256"]
