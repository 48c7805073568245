"""Shards by a Feistel permutation of global row numbers: a shuffle that can be repeated, and computed for any one row.

Rows are numbered from 0 in order of their key (then checksum, size and hash of the text), by range partitions and the
partitions' offsets. N row numbers are laid on a grid of a x b places, a the root of N rounded up, b the rows that are
needed, so that fewer than a places are outside. A Feistel network permutes the grid: in turn each coordinate is moved,
modulo its own side, by a keyed function of the other. A number that lands outside is permuted again until it lands
inside (cycle walking). What comes out is a permutation of 0 to N - 1; shard and slot are its remainder and quotient by
the number of shards, so shards differ by one row at most, and slots have no gaps.

Column expressions only. How often a number has to walk at most is counted beforehand, exactly, over the places outside
that can be entered (fewer than the root of N); so the walk is a fold of known length within the row. `Permutation` does the
same on numbers alone: `place` says where a row goes, `number_at` which row lies in a slot, without reading a table.

Law: `rows`. Equal texts are not kept together, as one text may be a third of all rows. Null text: no bytes, checksum 0.
A null key comes first. Rows are kept one to one; rows equal in key and text are interchangeable. Repeated ids and
ties are ordered by checksum, size and hash, then by place, so a hot id is dealt over many tasks. Empty table: empty
result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.shared import cut

SHARDS = 16
SEED = "lectern"
ROUNDS = 6
_PRIME = (1 << 31) - 1


def _div(x: Column, y) -> Column:
    """Whole quotient of whole numbers, without the rounding of a quotient of doubles."""
    return F.call_function("div", x, y if isinstance(y, Column) else F.lit(y).cast("long"))


class Permutation:
    """The permutation of 0 to n - 1 that a seed names. All arithmetic stays below 2 ** 62."""

    def __init__(self, n: int, seed: str = SEED, rounds: int = ROUNDS):
        if not 0 <= n < 1 << 60:
            raise ValueError(f"{n} rows")
        self.n, self.seed = n, seed
        self.a = math.isqrt(n - 1) + 1 if n else 1
        self.b = max(1, -(-n // self.a))
        self.keys = [self._key(i) for i in range(rounds)]

    def _key(self, i: int) -> tuple[int, int, int, int]:
        """Of each round: what is added, a factor, what is added, a factor."""
        said = hashlib.sha256(f"{self.seed}:{i}".encode()).digest()
        return tuple(1 + int.from_bytes(said[4 * k : 4 * k + 4], "big") % (_PRIME - 1) for k in range(4))

    @staticmethod
    def _moved(x, key):
        p, q, r, s = key
        v = ((x + p) % _PRIME * q + r) % _PRIME
        return (v ^ (v >> 13)) % _PRIME * s % _PRIME

    def once(self, x):
        """One pass through the network, of a number or an array; it may lie outside."""
        u, v = x // self.b, x % self.b
        for i, key in enumerate(self.keys):
            if i % 2:
                v = (v + self._moved(u, key)) % self.b
            else:
                u = (u + self._moved(v, key)) % self.a
        return u * self.b + v

    def back(self, x):
        """The pass the other way."""
        u, v = x // self.b, x % self.b
        for i in range(len(self.keys) - 1, -1, -1):
            if i % 2:
                v = (v - self._moved(u, self.keys[i])) % self.b
            else:
                u = (u - self._moved(v, self.keys[i])) % self.a
        return u * self.b + v

    def walk(self) -> int:
        """How many passes more than one any number needs at most."""
        outside = np.arange(self.n, self.a * self.b, dtype=np.int64)
        at, passes = outside[self.back(outside) < self.n], 0
        while len(at):
            at = self.once(at)
            at, passes = at[at >= self.n], passes + 1
        return passes

    def place(self, number: int, shards: int = SHARDS) -> tuple[int, int]:
        """(shard, slot) of a row number."""
        x = self.once(number)
        while x >= self.n:
            x = self.once(x)
        return x % shards, x // shards

    def number_at(self, shard: int, slot: int, shards: int = SHARDS) -> int:
        """The row number that lies there."""
        x = self.back(slot * shards + shard)
        while x >= self.n:
            x = self.back(x)
        return x

    def column(self, number: Column) -> Column:
        """The permuted number as a column expression: a fold over the rounds within a fold over the walk."""
        keys = F.array(*(F.struct(F.lit(i % 2 == 1).alias("odd"), *(F.lit(k).cast("long").alias(name) for k, name in zip(key, "pqrs", strict=True))) for i, key in enumerate(self.keys)))
        prime, a, b = (F.lit(x).cast("long") for x in (_PRIME, self.a, self.b))

        def moved(x: Column, key: Column) -> Column:
            v = ((x + key["p"]) % prime * key["q"] + key["r"]) % prime
            return v.bitwiseXOR(F.shiftright(v, 13)) % prime * key["s"] % prime

        def step(z: Column, key: Column) -> Column:
            return F.struct(
                F.when(key["odd"], z["u"]).otherwise((z["u"] + moved(z["v"], key)) % a).alias("u"),
                F.when(key["odd"], (z["v"] + moved(z["u"], key)) % b).otherwise(z["v"]).alias("v"),
            )

        def once(x: Column) -> Column:
            return F.aggregate(keys, F.struct(_div(x, b).alias("u"), (x % b).alias("v")), step, lambda z: z["u"] * b + z["v"])

        passes = self.walk()
        first = once(number)
        return F.aggregate(F.sequence(F.lit(1), F.lit(passes)), first, lambda x, _: F.when(x < self.n, x).otherwise(once(x))) if passes else first


def numbered(df: DataFrame, *order: Column, name: str = "number") -> DataFrame:
    """Rows with their global number from 0 in this order; equal rows in order of their place."""
    names = [f"__o{i}" for i in range(len(order))]
    keyed = df.withColumns({**dict(zip(names, order, strict=True)), "__at": F.monotonically_increasing_id()})
    # The sorted rows are kept: their places must not depend on how often they are made.
    held = cut(keyed.orderBy(*(F.col(n).asc_nulls_first() for n in names), "__at").drop(*names, "__at").withColumn("__at", F.monotonically_increasing_id()))
    held = held.withColumns({"__part": F.shiftright("__at", 33), "__place": F.col("__at").bitwiseAND((1 << 33) - 1)})
    # A row for each partition.
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    firsts = held.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    return held.join(F.broadcast(firsts), "__part").withColumn(name, F.col("__first") + F.col("__place")).drop("__part", "__place", "__first", "__at")


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """`key`, size (UTF-8 bytes and one), text_crc32, number (global row number), shard and slot of every row."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    crc = F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long")
    small = df.select(F.col(key), size.alias("size"), crc.alias("text_crc32"), F.xxhash64(text).alias("__hash"))
    rows = numbered(small, F.col(key), F.col("text_crc32"), F.col("size"), F.col("__hash")).drop("__hash")
    order = Permutation(rows.count(), seed)
    return (
        rows.withColumn("__to", order.column(F.col("number")))
        .select(key, "size", "text_crc32", "number", (F.col("__to") % shards).cast("int").alias("shard"), _div(F.col("__to"), shards).alias("slot"))
    )


def registered(spark, sf_dir: str) -> DataFrame:
    from lectern.session import table

    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "number")


def _oracle() -> str:
    """The same in SQL: the rounds as nested selects, the walk as a recursive query."""

    def moved(x: str, key) -> str:
        p, q, r, s = key
        v = f"((({x} + {p}) % {_PRIME} * {q} + {r}) % {_PRIME})"
        return f"(xor({v}, {v} >> 13) % {_PRIME} * {s} % {_PRIME})"

    def once(source: str) -> str:
        said = f"SELECT number, n, a, b, x // b AS u, x % b AS v FROM {source}"
        for i, key in enumerate(Permutation(1).keys):
            u, v = ("u", f"(v + {moved('u', key)}) % b") if i % 2 else (f"(u + {moved('v', key)}) % a", "v")
            said = f"SELECT number, n, a, b, {u} AS u, {v} AS v FROM ({said})"
        return f"SELECT number, n, a, b, u * b + v AS x FROM ({said})"

    # CRC-32 over the bytes; the table's entries come from the polynomial.
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    codes = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    crc = f"xor(list_reduce({codes}, lambda s, c: xor(s >> 8, tab[1 + (xor(s, c) & 255)]), 4294967295), 4294967295)"
    return f"""WITH RECURSIVE lookup AS (SELECT {table}::BIGINT[] AS tab), d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, CAST({crc} AS BIGINT) AS text_crc32 FROM documents, lookup),
    r AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS number FROM d), m AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM d),
    g AS (SELECT number, number AS x, n, a, (n + a - 1) // a AS b FROM r, m), walk AS ({once('g')} UNION ALL {once('(SELECT * FROM walk WHERE x >= n)')})
    SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(x % {SHARDS} AS INTEGER) AS shard, x // {SHARDS} AS slot, CAST(NULL AS INTEGER) AS grown_shard, number FROM r JOIN walk USING (number) WHERE x < n"""


ORACLE = _oracle()
