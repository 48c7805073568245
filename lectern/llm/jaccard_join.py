"""N-gram Jaccard join: documents whose sets of 5-word shingles are alike, by a grouped prefix join.

1. Tallies. One pass over all texts names every set by a print (equal sets are one class) and counts, of the first
   shingles of each set in order of hash, those that another class holds too. Linked sets share their first common
   shingles early in that order, so a class with too few shared ones is linked with nothing and goes. What a task holds
   twice it counts itself and tells others once, so a very common shingle does not gather its documents.
2. Order. Shingles of the classes that stay are counted exactly; rare ones come first. Those that no other class holds
   need no entry, they only fill the prefix.
3. Prefixes. Sets with Jaccard >= t share a shingle among the first n - ceil(t n) + 1 of each. Classes with the same
   prefix and size become one group, and only groups enter the inverted index. A key's place in its prefix is kept: a
   pair is made only where enough elements follow in both sets. Keys of one group are dropped; then groups are expanded
   into their classes.
4. Verification in star rounds. In each list one class is the centre; the members that are not yet connected to it, of
   fitting size and signature and not compared before, are verified against it on whole sets. A centre leaves its list
   after the round, and lists whose members all hang together are dropped. Every other round's centres are of their list's
   largest component, so that what is scattered around a crowd joins it. The last round compares what still shares a key across components, so
   no link is lost that joins different components; links within one component add nothing to the result. Its lists
   are dealt in blocks, and only pairs that sizes, places and signatures allow leave the join.

Returned are components, not pairs. Shingles and sets are compared by 64-bit hashes. Nulls and texts without words have an
empty set, size 0, and are linked with nothing; texts of fewer words have their whole sequence as one shingle. Rows are
kept one to one, each judged by its own text also where ids repeat. A null id never names a component: its row has the
smallest id of the others linked with it, or null. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm._words import NONSPACE, Words, mix, slices, words_of
from lectern.llm.components import components
from lectern.llm.shared import cut, few, forget, release, small_batches

SIZE = 5
PERCENT = 75
#: Of this share of a set's size, shared shingles beyond the first are asked for in the tallies.
EXTRA = 15
STAR_ROUNDS = 6
#: Bytes of text whose shingles are counted in one task.
PART_BYTES = 16 << 20
#: Entries that a task gathers before it tells them.
GATHER = 1 << 20
#: Ids that are told to every task at most (8 bytes each); more are joined.
BROADCAST_IDS = 1_000_000
#: Members of a list that one task of the last round takes on its left side.
BLOCK = 1_000
#: Bits of a set's signature; element hashes toggle bits, so that two signatures differ in no more bits than the sets
#: differ in elements. Pairs whose signatures differ in too many bits are ruled out before any set moves.
SIGNATURE = 4096


def _hashes(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, and the bounds of each text's; a short text has its whole sequence."""
    at, h = w.windows(size)
    counts = np.diff(w.bounds)
    short = np.flatnonzero((counts > 0) & (counts < size))
    n = np.maximum(counts - size + 1, 0)
    n[short] = 1
    bounds = np.concatenate(([0], np.cumsum(n)))
    out = np.empty(bounds[-1], dtype=np.uint64)
    long = np.repeat(counts >= size, n)
    out[long] = h
    for d in short:
        own = w.hashes[w.bounds[d] : w.bounds[d + 1]]
        value = np.uint64(len(own))
        for x in own:
            value = mix(np.array([value], dtype=np.uint64) * np.uint64(31) + x)[0]
        out[bounds[d]] = value
    return out, bounds


def _sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, the bounds of each text's, and the sets' prints."""
    h, bounds = _hashes(words_of(data, offsets, NONSPACE), size)
    for d in range(len(bounds) - 1):
        h[bounds[d] : bounds[d + 1]].sort()
    first = np.ones(len(h), dtype=bool)
    first[1:] = h[1:] != h[:-1]
    first[bounds[:-1][bounds[:-1] < len(h)]] = True
    kept = np.concatenate(([0], np.cumsum(first)))[bounds]
    h = h[first]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h), dtype=np.uint64)))
    prints = mix(sums[kept[1:]] - sums[kept[:-1]] + np.diff(kept).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return h, kept, prints


def prefix_length(n, percent: int = PERCENT):
    return n - -(-percent * n // 100) + 1


def _asked(n, extra: int):
    """Shared shingles that are asked for in a long prefix of a set of size n."""
    return np.maximum(1, n * extra // 100)


def _told(docs: DataFrame, parts: int, size: int, percent: int, extra: int) -> DataFrame:
    """Rows (kind, part, id, print, x, twice) of lists, from one pass over all texts.

    Kind 0: ids, prints and sizes x of sets. Kind 1: prefix entries of one part of the hash space, as prints and hashes x
    that this task saw in one class, and the hashes that it saw in more. Kind 2: prints and numbers x of the latter.
    """

    def lists(values: np.ndarray, ends: np.ndarray, kind) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values, kind))

    def flush(ids: list, sizes: list, names: list, held: list, of: list) -> pa.RecordBatch:
        h, p = np.concatenate(held), np.concatenate(of)
        order = np.lexsort((p, h))
        h, p = h[order], p[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (p[1:] != p[:-1])  # copies within the task
        h, p = h[new], p[new]
        same = h[1:] == h[:-1]
        twice = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(h) else np.zeros(0, bool)
        whose, times = np.unique(p[twice], return_counts=True)
        many = np.unique(h[twice])
        h, p = h[~twice], p[~twice]  # in order of hash, so in order of part
        low = [(x & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32) for x in (h, many)]
        part = [((x >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64) for x in (h, many)]
        here = np.union1d(*part)
        ends = [np.searchsorted(x, here, side="right") for x in part]
        at = int(whose[0] % np.uint64(parts)) if len(whose) else int(here[0]) if len(here) else 0
        n = len(here)
        none = np.zeros(n, np.int64)
        all_ids, all_names = pa.concat_arrays(ids), np.concatenate(names)
        rows = [
            pa.array([1] * n + [0, 2], pa.int32()),
            pa.array([*here.tolist(), at, at], pa.int32()),
            pa.ListArray.from_arrays(pa.array(np.concatenate(([0], none, [len(all_ids)] * 2)), pa.int32()), all_ids),
            lists(np.concatenate((p, all_names, whose)).view(np.int64), np.concatenate((ends[0], len(p) + np.cumsum([len(all_names), len(whose)]))), pa.int64()),
            lists(np.concatenate((low[0], np.concatenate(sizes).astype(np.int32), times.astype(np.int32))), np.concatenate((ends[0], len(p) + np.cumsum([len(all_names), len(whose)]))), pa.int32()),
            lists(low[1], np.concatenate((ends[1], [len(many)] * 2)), pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(rows, names=["kind", "part", "id", "print", "x", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, names, held, of, gathered = [], [], [], [], [], 0
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                h, bounds, prints = _sets(data, offsets, size)
                n = np.diff(bounds)
                long = np.minimum(n, prefix_length(n, percent) - 1 + _asked(n, extra))
                place = np.arange(len(h)) - np.repeat(bounds[:-1], n)
                early = place < np.repeat(long, n)
                ids.append(batch.column(0).slice(a, b - a))
                sizes.append(n)
                names.append(prints)
                held.append(h[early])
                of.append(np.repeat(prints, long))
                gathered += len(held[-1]) + b - a
                if gathered >= GATHER:
                    yield flush(ids, sizes, names, held, of)
                    ids, sizes, names, held, of, gathered = [], [], [], [], [], 0
        if ids:
            yield flush(ids, sizes, names, held, of)
        release()

    return docs.select("id", "text").mapInArrow(run, "kind int, part int, id array<long>, print array<long>, x array<int>, twice array<int>")


def _tallied(told: DataFrame) -> DataFrame:
    """Rows (id, n, print) of every document, and rows (print, shared) of partial tallies, their other columns null."""

    def run(table: pa.Table) -> pa.Table:
        def flat(kind: int, name: str):
            return table.column(name).filter(pc.equal(table.column("kind"), kind)).combine_chunks().flatten()

        p, h, twice = flat(1, "print").to_numpy(), flat(1, "x").to_numpy(), flat(1, "twice").to_numpy()
        order = np.lexsort((p, h))
        p, h = p[order], h[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (p[1:] != p[:-1])
        p, h = p[new], h[new]
        same = h[1:] == h[:-1]
        shared = np.isin(h, twice)
        shared[1:] |= same
        shared[:-1] |= same
        whose, times = np.unique(p[shared], return_counts=True)
        ids, n, prints = flat(0, "id"), flat(0, "x"), flat(0, "print")
        more = [flat(2, "print"), flat(2, "x")]
        m = len(whose) + len(more[0])
        return pa.Table.from_arrays(
            [
                pa.concat_arrays([ids, pa.nulls(m, pa.int64())]),
                pa.concat_arrays([n, pa.nulls(m, pa.int32())]),
                pa.concat_arrays([prints, pa.array(whose, pa.int64()), more[0]]),
                pa.concat_arrays([pa.nulls(len(ids), pa.int32()), pa.array(times, pa.int32()), more[1]]),
            ],
            names=["id", "n", "print", "shared"],
        )

    return told.groupBy("part").applyInArrow(run, "id long, n int, print long, shared int")


def _full(docs: DataFrame, size: int) -> DataFrame:
    """print, n, hashes (ascending) and signature of the set of every document (text, want) whose print is the wanted one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = SIGNATURE // 64
        for batch in batches:
            want = batch.column(1).to_numpy()
            for a, b, data, offsets in slices(batch.column(0)):
                h, bounds, prints = _sets(data, offsets, size)
                bit = (mix(h) & np.uint64(SIGNATURE - 1)).astype(np.int64)
                signs = [np.packbits(np.bincount(bit[bounds[d] : bounds[d + 1]], minlength=SIGNATURE) & 1).view(np.int64) for d in range(b - a)]
                out = pa.RecordBatch.from_arrays(
                    [
                        pa.array(prints.view(np.int64)),
                        pa.array(np.diff(bounds), pa.int32()),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(h.view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, words * (b - a) + 1, words), pa.int32()), pa.array(np.concatenate(signs))),
                    ],
                    names=["print", "n", "hashes", "sign"],
                )
                yield out.filter(pa.array(prints.view(np.int64) == want[a:b]))
        release()

    return docs.select("text", "want").mapInArrow(run, "print long, n int, hashes array<long>, sign array<long>")


def _needed(n: Column, percent: int) -> Column:
    return F.ceil(n * percent / 100)


def _allowed(percent: int) -> Column:
    """Signatures sa and sb of sets of sizes na and nb differ in no more bits than linked sets can."""
    differ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return differ * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)


def _possible(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that their sizes and signatures do not rule out."""
    one = signs.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sign").alias("sa"))
    two = signs.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sign").alias("sb"))
    return pairs.join(one, "a").join(two, "b").filter(_allowed(percent)).select("a", "b")


def _verified(pairs: DataFrame, n_pairs: int, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) whose whole sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            xs, ys = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                x, y = xs[i].values.to_numpy(), ys[i].values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    # Only sets that stand in a pair move.
    named = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).groupBy("node").agg(F.lit(1).alias("one")).select("node")
    held = sets.join(F.broadcast(named) if 2 * n_pairs <= BROADCAST_IDS else named, "node", "left_semi")
    one, two = held.select(F.col("node").alias("a"), F.col("hashes").alias("x")), held.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _keyed(full: DataFrame, percent: int) -> DataFrame:
    """node, n, alone (shingles of no other class), keys (the rest of the prefix, rare first) and group of each class."""
    entries = full.select("node", F.explode("hashes").alias("h"))
    often = entries.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1")
    listed = entries.join(often, "h").groupBy("node").agg(F.sort_array(F.collect_list(F.struct(F.col("c").cast("int").alias("c"), "h"))).alias("s"))
    listed = full.select("node", "n").join(listed, "node").filter(F.size("s") >= _needed(F.col("n"), percent)).withColumn("alone", F.col("n") - F.size("s"))
    left = (F.col("n") - _needed(F.col("n"), percent) + 1 - F.col("alone")).cast("int")
    listed = listed.withColumn("keys", F.slice("s", F.lit(1), F.greatest(left, F.lit(0)))["h"])
    group = F.when(F.col("alone") == 0, F.xxhash64("n", "keys")).otherwise(F.col("node"))
    return listed.select("node", "n", "alone", "keys", group.alias("grp"))


def _own_list() -> Column:
    """The name of the list of a group's own classes."""
    return F.xxhash64("grp", F.lit("group"))


def _names(keyed: DataFrame) -> DataFrame:
    """node and names: all keys under which a class can be listed, in the one order of all keys, its group's own list first."""
    return keyed.select("node", F.concat(F.array(_own_list()), "keys").alias("names"))


def _first_shared(key: Column) -> Column:
    """Of all keys that two classes of names `own` and `others` share, `key` is the first."""
    return F.get(F.array_intersect("own", "others"), 0) == key


def _lists(keyed: DataFrame) -> DataFrame:
    """Inverted lists (key, node, n, pos) of the keys that several groups hold, and of every group of several classes."""
    groups = keyed.groupBy("grp").agg(F.min("n").alias("n"), F.min("alone").alias("alone"), F.min_by("keys", "node").alias("keys"), F.count("*").alias("m"))
    entries = groups.select("grp", "n", "alone", F.posexplode("keys").alias("at", "key")).select("key", "grp", "n", (F.col("alone") + F.col("at")).alias("pos"))
    several = entries.groupBy("key").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).filter("lo != hi").select("key")
    # Classes of one group meet under the group's own name as well, in case no other group shares its keys.
    own = groups.filter("m > 1").select(_own_list().alias("key"), "grp", "n", F.lit(0).alias("pos"))
    return entries.join(several, "key").unionByName(own).join(keyed.select("grp", "node"), "grp").select("key", "node", "n", "pos")


def _grown(member: DataFrame | None, found: DataFrame, most: int, gained: int) -> tuple[DataFrame, int]:
    """The components (node, component) once `gained` more links are found, and the most rows these can be; `most` rows before."""
    edges = found.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if member is not None:
        edges = edges.unionByName(member.select(F.col("node").alias("u"), F.col("component").alias("v")))
    return components(edges, most_links=most + gained), most + 2 * gained


def _settled(pairs: DataFrame, member: DataFrame | None, most: int, sets: DataFrame, percent: int, few_first: int = 3) -> DataFrame | None:
    """The components once all pairs across components are verified: first one pair of each two components, a few times,
    as one link makes the others of these two needless; then all that are left. member has `most` rows at most."""
    for turn in range(few_first + 1):
        forget(pairs.sparkSession)
        if member is not None:
            for side, c in (("a", "ca"), ("b", "cb")):
                pairs = pairs.join(member.select(F.col("node").alias(side), F.col("component").alias(c)), side, "left")
        else:
            pairs = pairs.withColumns({"ca": F.lit(None).cast("long"), "cb": F.lit(None).cast("long")})
        ca, cb = F.coalesce("ca", "a"), F.coalesce("cb", "b")
        across = pairs.select("a", "b", F.least(ca, cb).alias("lo"), F.greatest(ca, cb).alias("hi")).filter("lo != hi")
        across = cut(across)
        n = across.count()
        if not n:
            return member
        if turn < few_first:
            r = F.xxhash64("a", "b")
            some = few(across.groupBy("lo", "hi").agg(F.min_by("a", r).alias("a"), F.min_by("b", r).alias("b")), n, 20_000).select("a", "b")
            some = cut(some)
            n = some.count()
        else:
            some = across.select("a", "b")
        found = cut(few(_verified(some, n, sets, percent), n, 500))
        gained = found.count()
        if gained:
            member, most = _grown(member, found, most, gained)
        pairs = across.select("a", "b").join(some, ["a", "b"], "left_anti")
    return member


def _linked(lists: DataFrame, n_nodes: int, sets: DataFrame, signs: DataFrame, percent: int, star_rounds: int) -> DataFrame | None:
    """(node, component) of every class with a link; None where there is no link. sets: node, hashes; signs: node, n, sign, names."""
    # Of a linked pair the first shared key stands so early in both that enough is left behind it to share. That one key
    # is enough to find the pair; where it stands late, a pair cannot be linked and is not made.
    need = F.ceil(percent * (F.col("n") + F.col("m")) / (100 + percent))
    fits = (F.col("n") - F.col("pos") >= need) & (F.col("m") - F.col("opos") >= need) & (F.col("c") != F.col("oc"))
    enough = max(20, n_nodes // 200)
    pair = [F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")]
    checked = member = None
    most = 0  # rows of member at most
    last, turn, n = star_rounds == 0, -1, lists.count()
    while True:
        turn += 1
        forget(lists.sparkSession)
        if member is None:
            now = lists.withColumns({"c": F.col("node"), "w": F.lit(1).cast("long")})
        else:
            weighed = member.join(member.groupBy("component").agg(F.count("*").alias("w")), "component")
            now = lists.join(weighed, "node", "left").select(*lists.columns, F.coalesce("component", "node").alias("c"), F.coalesce("w", F.lit(1)).cast("long").alias("w"))
        # One of each list by hash, later one of its largest component, as what is scattered around a crowd is linked with
        # some of it, and every other time one of any component. The hash of one number is different for each number, so all
        # that is kept at first is of one member.
        if turn == 0:
            kept = [F.min_by(c, F.xxhash64("node", F.lit(turn))).alias(to) for c, to in (("node", "other"), ("n", "m"), ("pos", "opos"), ("c", "oc"))]
            mixed = now.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size"), *kept).filter("lo != hi")
        else:
            largest = -F.col("w") if turn % 2 else F.lit(0)
            kept = F.min(F.struct(largest.alias("w"), F.xxhash64("c", F.lit(turn)).alias("r"), F.xxhash64("node", F.lit(turn)).alias("s"), F.col("node").alias("other"), F.col("n").alias("m"), F.col("pos").alias("opos"), F.col("c").alias("oc")))
            mixed = now.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size"), kept.alias("centre")).filter("lo != hi")
            mixed = mixed.select("key", "lo", "hi", "size", "centre.other", "centre.m", "centre.opos", "centre.oc")
        now = cut(few(now.join(mixed.drop("lo", "hi"), "key"), n, 20_000))
        if last:
            blocks = F.ceil(F.col("size") / BLOCK).cast("int")
            signed = now.select("key", "node", "n", "pos", "c", "size").join(signs.select("node", "sign", "names"), "node").withColumn("blocks", blocks)
            one = signed.select("key", "node", "n", "pos", "c", F.col("n").alias("na"), F.col("sign").alias("sa"), F.col("names").alias("own"), F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"))
            two = signed.select("key", F.col("node").alias("other"), F.col("n").alias("m"), F.col("pos").alias("opos"), F.col("c").alias("oc"), F.col("n").alias("nb"), F.col("sign").alias("sb"), F.col("names").alias("others"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
            one, two = one.alias("one"), two.alias("two")
            # Of all lists that hold a pair only that of its first shared key makes it. Where one of them has left that list as
            # its centre, or the list has gone, they have been compared, or hang together.
            on = (F.col("one.key") == F.col("two.key")) & (F.col("one.block") == F.col("two.block")) & (F.col("node") < F.col("other")) & fits & _allowed(percent) & _first_shared(F.col("one.key"))
            pairs = one.join(two, on)
        else:
            pairs = now.filter((F.col("node") != F.col("other")) & fits)
        pairs = few(pairs.select(*pair).groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b"), n, 20_000)
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        pairs = cut(few(pairs if last else _possible(pairs, signs, percent), n, 20_000))
        if last:
            return _settled(pairs, member, most, sets, percent)
        n_pairs = pairs.count()
        found = cut(few(_verified(pairs, n_pairs, sets, percent), n_pairs, 500))
        gained = found.count()
        checked = pairs if checked is None else checked.unionByName(pairs)
        if gained:
            member, most = _grown(member, found, most, gained)
        # A list's centre has met all of its list, and leaves it.
        lists = now.filter(F.col("node") != F.col("other")).select(*lists.columns)
        n = lists.count()
        # Star rounds end when they bring little more together; what they leave is for the last round.
        last = gained < enough or turn + 1 >= star_rounds


def join(
    df: DataFrame, text: str = "text", key: str = "doc_id", size: int = SIZE, percent: int = PERCENT, star_rounds: int = STAR_ROUNDS, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """`key`, n_shingles and component_id (smallest key reachable by links, itself included) for every row."""
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    bytes_ = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    with small_batches(df.sparkSession):
        said = cut(_tallied(_told(docs, bytes_ // part_bytes + 1, size, percent, EXTRA)))
    rows = said.filter("n is not null").select("id", "n", "print")
    classes = rows.filter("n > 0").groupBy("print").agg(F.min("id").alias("id"), F.first("n").alias("n"))
    tally = said.filter("n is null").groupBy("print").agg(F.sum("shared").alias("shared"))
    # A partner may be smaller, and be asked for less.
    asked = F.greatest(F.lit(1), F.floor(_needed(F.col("n"), percent) * EXTRA / 100))
    live = cut(classes.join(tally, "print").filter(F.col("shared") >= asked).select("print", "id"))
    wanted = live.select(F.col("id").alias("rid"), F.col("print").alias("want"))
    told = live.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(wanted) if told else wanted, F.col("id").eqNullSafe(F.col("rid")))
    full = _full(texts, size)
    if not rows.groupBy("id", "print").count().filter("count > 1").isEmpty():  # repeated rows
        full = full.groupBy("print").agg(*(F.first(c).alias(c) for c in ("n", "hashes", "sign")))
    with small_batches(df.sparkSession):
        full = cut(full.withColumn("node", F.monotonically_increasing_id()))
    keyed = cut(_keyed(full, percent))
    n_keyed = keyed.count()
    kept = full.join(F.broadcast(keyed.select("node")) if n_keyed <= BROADCAST_IDS else keyed.select("node"), "node", "left_semi")
    signs = cut(kept.select("node", "n", "sign").join(_names(keyed), "node"))
    member = _linked(cut(_lists(keyed)), n_keyed, kept.select("node", "hashes"), signs, percent, star_rounds)
    if member is None:
        named = classes.select("print", F.col("id").alias("component_id"))
    else:
        placed = full.select("node", "print").join(member, "node").join(classes.select("print", "id"), "print").select("print", "id", "component")
        least = placed.groupBy("component").agg(F.min("id").alias("component_id"))
        moved = placed.join(least, "component").select("print", "component_id")
        named = classes.join(moved, "print", "left").select("print", F.coalesce("component_id", "id").alias("component_id"))
    linked = rows.filter("n > 0").join(named, "print").select("id", "n", "component_id")
    alone = rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), "component_id")


def registered(spark, sf_dir: str) -> DataFrame:
    from lectern.session import table

    return join(table(spark, sf_dir, "documents"))
