"""Repair of conversations' structure: the cheapest edits after which the turns' roles are lawful, by iterative-deepening A*.

Roles are lawful if their initials read `(s?(ua)+)?`. Each row is kept (0), given the role that fits (3) or deleted (4);
an empty turn may be inserted anywhere (3). Blank and repeated rows have to be deleted; a truncated row that stays costs
3 more. Of the cheapest edits the ones whose initials D, I, K, R come first in ASCII order are the answer.

The search goes depth first through the edits in ASCII order, for a bound on the costs that starts at a lower bound and
rises to the least cost that went beyond it. A state is (next row, state of the grammar), and what a new turn's role must
be follows from it. The table keeps, for every state, the least that the rest is proven to cost: first what its faulty
rows cost in any case, and once a state has failed, the least cost that went beyond its allowance; it holds for all bounds
to come. The first path that is accepted is the answer. Long conversations are proven from their end in blocks, so that
the bound that rises is only ever that of a block, and time is linear in the turns.

Texts are not needed for the search: a task walks through sorted rows of facts (initial, fault, hash) and keeps a few bytes
for each turn of one conversation, as the result, a letter for each turn, does. The repaired texts are hashed by a second
walk over the sorted rows, each conversation's edits in front of its rows; no conversation's texts gather. A digest of the
whole is sequential: one conversation is walked through by one task, however long it is.

Nulls in role, text, turn and id are one space where they are read as text; rows without an id are one conversation. A role
without characters has no initial and cannot be kept. Rows are in order of turn (nulls first), then role, then the text's
MD5. Empty table: empty result; a conversation without rows has no edits, cost 0 and the hash of nothing. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
WHITE = " \t\n\x0b\x0c\r"
#: Rows whose costs are proven before those ahead of them.
BLOCK = 16
#: Distinct short conversations whose edits a task remembers, and how long they may be.
REMEMBERED, SHORT = 50_000, 40

#: States of the grammar: begun, after s, after u, after a. What an initial leads to, and where a new turn leads.
_KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_NEW = (2, 2, 3, 2)
_ENDS = (0, 3)
ROLES = {2: "user", 3: "assistant"}


def _base(rows: str, rest: list[int]) -> list[list[int]]:
    """Lower bounds of the rest at each of some rows: what the faulty ones cost whatever is done, and the least of `rest`,
    which is proven for what comes behind them."""
    at, table = min(rest), []
    for kind in reversed(rows):
        at += DELETE if kind == "d" else min(DELETE, TRUNCATED) if kind.isupper() else 0
        table.append([at] * 4)
    return [*reversed(table), rest]


def _edits(rows: str, i: int, q: int) -> list[tuple[str, int, int, int]]:
    """(initial, cost, next row, next state) of each edit in ASCII order."""
    out = [("D", DELETE, i + 1, q)] if i < len(rows) else []
    out.append(("I", INSERT, i, _NEW[q]))
    if i < len(rows) and rows[i] != "d":
        more = TRUNCATED if rows[i].isupper() else 0
        to = _KEEP[q].get(rows[i].lower())
        if to is not None:
            out.append(("K", more, i + 1, to))
        out.append(("R", REROLE + more, i + 1, _NEW[q]))
    return out


def _search(rows: str, table: list[list[int]], i: int, q: int, proven: int) -> str:
    """The first accepted path from a state, by rising bounds. From row `proven` on the table's costs are exact, and
    reaching it within the bound is enough; then the path ends there. Raises the table's bounds as it fails."""
    while True:
        bound = table[i][q]
        # Of each open state: row, state, allowance, edits, next edit, least need beyond the allowance.
        stack, path = [[i, q, bound, _edits(rows, i, q), 0, 1 << 60]], []
        while stack:
            state = stack[-1]
            r, s, left, edits, k, _ = state
            if r >= proven or (r == len(rows) and s in _ENDS):
                return "".join(path)
            if k == len(edits):
                table[r][s] = max(table[r][s], state[5])
                stack.pop()
                if stack:
                    path.pop()
                    before = stack[-1]
                    before[5] = min(before[5], before[3][before[4] - 1][1] + table[r][s])
                continue
            state[4] += 1
            name, cost, r2, s2 = edits[k]
            if cost + table[r2][s2] > left:
                state[5] = min(state[5], cost + table[r2][s2])
            else:
                stack.append([r2, s2, left - cost, _edits(rows, r2, s2), 0, 1 << 60])
                path.append(name)


def repair(rows: str, block: int = BLOCK) -> tuple[int, str]:
    """(cost, edits' initials). rows: a letter for each row, `d` where it has to go, else its role's initial (s, u, a, or o
    for any other), in upper case where the row is truncated."""
    rest, last = [0, 2 * INSERT, INSERT, 0], len(rows) + 1  # of the end: the turns that it lacks
    blocks, stop = [], len(rows)
    for start in [*range(len(rows) - block, 0, -block), 0]:
        part = rows[start:stop]
        table = _base(part, rest)
        for q in range(4) if start else (0,):
            _search(part, table, 0, q, len(part) if stop < len(rows) else last)
        rest, stop = table[0], start
        blocks.append(table[:-1] if stop + len(part) < len(rows) else table)
    whole = [row for table in reversed(blocks) for row in table]
    return whole[0][0], _search(rows, whole, 0, 0, last)


def damaged(df: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """id, turn, role, text and `gone` of a table damaged by the checksum of its ids: of twenty, 0 drops a row (it stays, as
    `gone`), 1 empties its text, 2 takes out its `.!?`, 3 repeats it, 4 makes it a user's."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(said(conversation), F.lit(":"), said(turn)).cast("binary")) % 20
    text = F.when(F.col("__fate") == 1, "").when(F.col("__fate") == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    rows = df.select(F.col(conversation).alias("id"), F.col(turn).alias("turn"), "role", "text", fate.alias("__fate"))
    rows = rows.select("id", "turn", F.when(F.col("__fate") == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), (F.col("__fate") == 0).alias("gone"), "__fate")
    return rows.withColumn("__n", F.explode(F.array_repeat(F.lit(0), F.when(F.col("__fate") == 3, 2).otherwise(1)))).drop("__n", "__fate")


_ORDER = ("turn", "role", "digest")


def _dealt(rows: DataFrame, *first: str) -> DataFrame:
    """Rows of a conversation in one task, in order; its `first` columns decide before the turn does."""
    keys = [F.col("id").asc_nulls_first(), *first, *(F.col(c).asc_nulls_first() for c in _ORDER)]
    return rows.repartition("id").sortWithinPartitions(*keys)


def _report(turns: list, kinds: list[str], facts: list[int], known: dict[str, tuple[int, str]]) -> tuple:
    """Counts, cost and edits of one conversation's rows."""
    seen = {t for t in turns if t is not None}
    gaps = max(seen) - min(seen) + 1 - len(seen) if seen else 0
    initials = [k.lower() for k in kinds]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    rows = "".join("d" if f in (1, 2) else k.upper() if f == 3 else k for k, f in zip(kinds, facts, strict=True))
    if (found := known.get(rows)) is None:
        found = repair(rows)
        if len(rows) <= SHORT and len(known) < REMEMBERED:
            known[rows] = found
    return gaps, facts.count(1), facts.count(2), facts.count(3), illegal, *found


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def audit(rows: DataFrame) -> DataFrame:
    """id, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation. rows: id, turn, role, text, gone."""
    solid = F.rtrim("text", F.lit(WHITE))
    fault = F.when(F.col("gone"), -1).when(solid == "", 1).when(~F.right(solid, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    initial = F.left("role", F.lit(1))
    facts = rows.select("id", F.col("turn").cast("long").alias("turn"), "role", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), fault.cast("int").alias("fault"), F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("audit", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, str]] = {}
        now, begun = None, False
        turns, kinds, faults, seen = [], [], [], set()
        for batch in batches:
            ids, out = [], []
            for one, turn, role, digest, fault, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or one != now:
                    if begun:
                        ids.append(now)
                        out.append(_report(turns, kinds, faults, known))
                    now, begun = one, True
                    turns, kinds, faults, seen = [], [], [], set()
                if fault == -1:
                    continue
                said = (role, digest)
                faults.append(2 if fault != 1 and said in seen else fault)
                seen.add(said)
                turns.append(turn)
                kinds.append(kind)
            if ids:
                yield _batch(ids, out, batch.schema.field(0).type)
        if begun:
            yield _batch([now], [_report(turns, kinds, faults, known)], batch.schema.field(0).type)

    def _batch(ids, out, kind) -> pa.RecordBatch:
        columns = [pa.array(ids, kind), *(pa.array([r[k] for r in out], pa.int64()) for k in range(len(_COUNTS))), pa.array([r[-1] for r in out], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    return _dealt(facts).mapInArrow(run, schema)


def repaired(rows: DataFrame, audits: DataFrame, texts: bool = False) -> DataFrame:
    """The audits with `repaired_sha256` of their conversations' repaired rows; with `texts` the repaired rows themselves:
    id, place (from 0), edit, role and text. Both walk through the sorted rows, each conversation's edits in front."""
    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    told = F.struct(*_COUNTS, "audit")
    blank = {"turn": "long", "role": "string", "digest": "binary", "text": "string"}
    front = audits.select("id", F.lit(0).alias("kind"), *(F.lit(None).cast(t).alias(c) for c, t in blank.items()), told.alias("told"))
    behind = rows.filter(~F.col("gone")).select("id", F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), "role", digest.alias("digest"), "text", F.lit(None).cast(audits.select(told.alias("t")).schema["t"].dataType).alias("told"))
    id_type = audits.schema["id"]
    if texts:
        schema = T.StructType([id_type, T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    else:
        schema = T.StructType([*audits.schema.fields, T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = None
        out: list[tuple] = []
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for key, what, role, text, told in zip(*(part.column(c).to_pylist() for c in ("id", "kind", "role", "text", "told")), strict=True):
                    if what == 0:
                        if one is not None:
                            one.end(out)
                        one = _Walk(key, told, texts)
                    else:
                        one.row(role, text, out)
                if out:
                    yield _rows(out, kind)
                    out.clear()
        if one is not None:
            one.end(out)
            if out:
                yield _rows(out, kind)

    def _rows(out: list[tuple], kind) -> pa.RecordBatch:
        types = [kind, *(pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in schema.fields[1:])]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=schema.names)

    return _dealt(front.unionByName(behind), "kind").mapInArrow(run, schema)


class _Walk:
    """One conversation's edits, applied row by row; what is made is hashed, or listed, and not kept."""

    def __init__(self, key, told: dict, texts: bool):
        self.key, self.told, self.texts = key, told, texts
        self.edits, self.at, self.state, self.made, self.hash = told["audit"], 0, 0, 0, hashlib.sha256()

    def _make(self, edit: str, role: str, text: str, out: list[tuple]) -> None:
        if self.texts:
            out.append((self.key, self.made, edit, role, text))
        else:
            self.hash.update(f"{chr(10) if self.made else ''}{role}:{text}".encode())
        self.made += 1

    def _inserts(self, out: list[tuple]) -> None:
        while self.edits[self.at : self.at + 1] == "I":
            self.state = _NEW[self.state]
            self._make("I", ROLES[self.state], "", out)
            self.at += 1

    def row(self, role: str, text: str, out: list[tuple]) -> None:
        self._inserts(out)
        edit = self.edits[self.at]
        self.at += 1
        if edit != "D":
            self.state = _KEEP[self.state][role[0]] if edit == "K" else _NEW[self.state]
            self._make(edit, role if edit == "K" else ROLES[self.state], text, out)

    def end(self, out: list[tuple]) -> None:
        self._inserts(out)
        if not self.texts:
            out.append((self.key, *self.told.values(), self.hash.hexdigest()))


def registered(spark, sf_dir: str) -> DataFrame:
    from lectern.session import table

    rows = damaged(table(spark, sf_dir, "conversations"))
    return repaired(rows, audit(rows)).withColumnRenamed("id", "conv_id")
