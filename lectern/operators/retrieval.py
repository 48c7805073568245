"""Ranking: unit vectors, dense top-k with distinct texts, BM25, interleaving of ranked lists."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from lectern.functions import terms
from lectern.functions.text import collapse
from lectern.session import cut

K1, B, FLOOR = 1.5, 0.75, 0.25


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """L2-normalised; NULL for zero or non-finite vectors."""
    n = F.sqrt(dot(v, v))
    return F.when((n > 0) & (n < float("inf")), F.transform(v, lambda x: x.cast("double") / n))


def dense_scores(queries: DataFrame, passages: DataFrame, most_queries: int = 20_000) -> DataFrame:
    """(q, id, score): queries (q, qv) against all passages (id, v). A stated query set, told to every task in blocks of
    counted size; passages never move."""
    n = queries.count()
    parts = max(1, -(-n // most_queries))
    out = None
    for i in range(parts):
        block = queries if parts == 1 else queries.filter(F.pmod(F.xxhash64("q"), F.lit(parts)) == i)
        scored = passages.join(F.broadcast(block)).select("q", "id", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("qv"), F.col("v")))).alias("score"))
        out = scored if out is None else out.unionByName(scored)
    return out


def top_k(scored: DataFrame, k: int, by: str = "q", tie: str = "id") -> DataFrame:
    """The k best per query; equal scores in order of `tie`. Spark limits each task's rows before they move."""
    w = W.partitionBy(by).orderBy(F.desc("score"), tie)
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def keep_first(scored: DataFrame, text_key: str, by: str = "q", tie: str = "id") -> DataFrame:
    """Of passages with the same text the best ranked per query."""
    w = W.partitionBy(by, text_key).orderBy(F.desc("score"), tie)
    return scored.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


#: Cells (terms x queries, or queries x dimensions) of a matrix that is told to every task at most.
MOST_CELLS = 4_000_000


def _best(queries: DataFrame, blocks: int, passages: DataFrame, k: int, scorer) -> DataFrame:
    """(q, id, score, place): the k best passages of every query; scores to six digits, equal ones in order of id.

    Queries are told to the tasks in `blocks` blocks by hash. `scorer(rows)` makes, from a block's rows, the ids of its
    queries and a function from a batch to its scores (passage x query, -inf for none). A task scores its passages
    batch by batch and keeps the k best of each query, so passages never move, nor do scores that cannot win.
    """

    def block(i: int) -> DataFrame:
        rows = (queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i)).collect()
        shared = queries.sparkSession.sparkContext.broadcast(rows)

        def run(batches):
            names, score = scorer(shared.value)
            ids, best = np.zeros((len(names), 0), np.int64), np.zeros((len(names), 0))
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    new = np.round(score(part), 6).T
                    ids = np.concatenate([ids, np.broadcast_to(part.column(0).to_numpy(), new.shape)], axis=1)
                    best = np.concatenate([best, new], axis=1)
                    order = np.lexsort((ids, -best), axis=1)[:, :k]
                    ids, best = np.take_along_axis(ids, order, 1), np.take_along_axis(best, order, 1)
            own = best > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, own.sum(1))), pa.array(ids[own]), pa.array(best[own])], names=["q", "id", "score"])

        return passages.mapInArrow(run, "q long, id long, score double")

    return top_k(reduce(DataFrame.unionByName, map(block, range(blocks))), k)


def dense_top(queries: DataFrame, passages: DataFrame, k: int, most_cells: int = MOST_CELLS) -> DataFrame:
    """The k passages (id, v) of greatest dot product for every query (q, qv), by matrix products. Exact."""

    def scorer(rows):
        matrix = np.array([r["qv"] for r in rows], dtype=np.float64)

        def score(part):
            v = part.column(1)
            x = np.asarray(v.flatten(), dtype=np.float64).reshape(len(v), -1)
            return np.clip(x @ matrix.T, -1, 1) if len(rows) else np.zeros((len(v), 0))

        return np.array([r["q"] for r in rows], dtype=np.int64), score

    cells = queries.agg(F.sum(F.size("qv"))).first()[0] or 0
    return _best(queries, max(1, -(-cells // most_cells)), passages.select("id", "v"), k, scorer)


def dense_top_distinct(queries: DataFrame, passages: DataFrame, kind: str, k: int, most_cells: int = MOST_CELLS) -> DataFrame:
    """(q, id, `kind`, score, place): of the passages (id, v, `kind`) of one kind the one of greatest dot product, then the k
    best kinds for every query (q, qv). Scores to six digits, equal ones in order of id. A task keeps the k best kinds of each
    query of all it has seen, of which the k best of all tasks are the k best kinds there are."""
    cells = queries.agg(F.sum(F.size("qv"))).first()[0] or 0
    n = max(1, -(-cells // most_cells))
    # Kinds are compared by number, and named again among the few that are left.
    numbered = passages.select("id", "v", F.xxhash64(kind).alias("__kind"), kind)
    schema = StructType([StructField("q", LongType()), StructField("id", LongType()), StructField("__kind", LongType()), StructField("score", DoubleType()), StructField(kind, passages.schema[kind].dataType)])

    def block(i: int) -> DataFrame:
        rows = (queries if n == 1 else queries.filter(F.pmod(F.xxhash64("q"), F.lit(n)) == i)).collect()
        shared = queries.sparkSession.sparkContext.broadcast(rows)

        def run(batches):
            rows = shared.value
            names, matrix = np.array([r["q"] for r in rows], dtype=np.int64), np.array([r["qv"] for r in rows], dtype=np.float64)
            best = [np.zeros((len(rows), 0), t) for t in (np.int64, np.int64, np.float64)]
            called: dict[int, object] = {}
            for batch in batches:
                for at in range(0, batch.num_rows, 256) if len(rows) else ():
                    part = batch.slice(at, 256)
                    v, of = part.column(1), part.column(2).to_numpy()
                    scores = np.round(np.clip(np.asarray(v.flatten(), dtype=np.float64).reshape(len(v), -1) @ matrix.T, -1, 1), 6).T
                    new = [np.broadcast_to(x, scores.shape) for x in (part.column(0).to_numpy(), of)] + [scores]
                    best = [np.concatenate(pair, axis=1) for pair in zip(best, new, strict=True)]
                    order = np.lexsort((best[0], -best[2], best[1]), axis=1)  # kinds together, each with its best first
                    best = [np.take_along_axis(b, order, 1) for b in best]
                    again = np.zeros(best[1].shape, bool)
                    again[:, 1:] = best[1][:, 1:] == best[1][:, :-1]
                    order = np.lexsort((best[0], -best[2], again), axis=1)[:, :k]
                    keep = ~np.take_along_axis(again, order, 1)
                    best = [np.take_along_axis(b, order, 1) for b in best]
                    best[2] = np.where(keep, best[2], -np.inf)
                    for number, name in zip(of.tolist(), part.column(3).to_pylist(), strict=True):
                        called.setdefault(number, name)
                    if len(called) > 4 * best[1].size + 4096:
                        held = set(best[1].ravel().tolist())
                        called = {x: name for x, name in called.items() if x in held}
            own = best[2] > -np.inf
            ids, kinds, scores = (b[own] for b in best)
            last = pa.array([called[x] for x in kinds.tolist()], to_arrow_type(schema[kind].dataType))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, own.sum(1))), pa.array(ids), pa.array(kinds), pa.array(scores), last], names=schema.names)

        return numbered.mapInArrow(run, schema)

    found = reduce(DataFrame.unionByName, map(block, range(n)))
    return top_k(keep_first(found, "__kind"), k).drop("__kind")


#: Kinds of terms that a task gathers before it tells them.
MOST_KINDS = 500_000
#: Ids that are told to every task at most; more are joined.
MOST_IDS = 1_000_000


def _held_by(docs: DataFrame, pairs: bool, blank: bool) -> DataFrame:
    """(term, df, size): how many documents (id, terms) hold each term; a row of no term counts documents and all of their
    terms. Without `blank` documents of no term do not count. A task adds up its own before they move."""

    def run(batches):
        gathered, held = [], 0

        def told() -> pa.Table:
            return pa.concat_tables(gathered).group_by("term", use_threads=False).aggregate([("df", "sum"), ("size", "sum")]).rename_columns(["term", "df", "size"])

        for batch in batches:
            for c in terms.counted(batch.column(1), pairs):
                df = np.bincount(c.term, minlength=len(c.known))
                own = np.flatnonzero(df)
                names = pa.concat_arrays([c.known.take(pa.array(own)), pa.nulls(1, pa.string())])
                df = np.append(df[own], len(c.size) if blank else np.count_nonzero(c.size))
                gathered.append(pa.table({"term": names, "df": df, "size": np.append(np.zeros(len(own), np.int64), c.size.sum())}))
                held += len(names)
            if held >= MOST_KINDS:
                gathered = [told()]
                held = len(gathered[0])
                if held >= MOST_KINDS // 2:
                    yield from gathered[0].to_batches()
                    gathered, held = [], 0
        if gathered:
            yield from told().to_batches()

    found = docs.mapInArrow(run, "term string, df long, size long")
    return found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("size").alias("size"))


def bm25_top(queries: DataFrame, docs: DataFrame, k: int, floor: float | None = None, k1: float = K1, b: float = B, most_cells: int = MOST_CELLS, among: DataFrame | None = None, pairs: bool = False) -> DataFrame:
    """The k best documents for every query (q, words: array), by BM25; `among`: ids that may win. Exact.

    Documents are (id, words: array) or (id, text); terms of a text are made within the tasks: its lower-case words, with
    `pairs` their character bigrams, too. Neither texts nor their terms move, but where more ids than can be told may win.

    Without `floor` a term's weight is log((N - n + 0.5) / (n + 0.5) + 1), N counts documents with words, and a query's
    repeated words count once. With it the weight is log((N - n + 0.5) / (n + 0.5)), negative ones give way to `floor`
    times the mean over all of the corpus' terms, N counts all documents, and repeated words count as often.
    """
    told = queries.select("q", F.explode("words").alias("term")).groupBy("q", "term").agg(F.count("*").alias("n"))
    docs = docs.select("id", F.lower("text").alias("text") if "text" in docs.columns else "words")
    # Only terms of queries are kept by name; of others it is enough how many there are of each `df`.
    named = told.select("term").distinct().withColumn("asked", F.col("term"))
    counts = _held_by(docs, pairs, floor is not None).join(named, "term", "left")
    counts = cut(counts.groupBy(F.col("term").isNull().alias("all"), F.col("asked").alias("term"), "df").agg(F.count("*").alias("kinds"), F.sum("size").alias("size")))
    n_docs, total = counts.filter("all").select("df", "size").first() or (0, 0)
    counts = counts.filter("NOT all")
    n = F.lit(float(n_docs))
    if floor is None:
        weighed = told.join(counts, "term").withColumns({"idf": F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), "n": F.lit(1)})
    else:
        raw = F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        mean = counts.agg(F.sum(raw * F.col("kinds")) / F.sum("kinds")).first()[0] or 0.0
        weighed = told.join(counts, "term").withColumn("idf", F.when(raw < 0, F.lit(floor * mean)).otherwise(raw))
    held = cut(weighed.select("q", "term", (F.col("idf") * F.col("n")).alias("w")))
    n_terms, n_queries = held.agg(F.count_distinct("term"), F.count_distinct("q")).first()
    average = (total or 0) / max(n_docs, 1) or 1.0

    def scorer(rows):
        names = sorted({r["q"] for r in rows})
        place, column = {q: i for i, q in enumerate(names)}, {}
        for r in rows:
            column.setdefault(r["term"], len(column))
        matrix, held_by = np.zeros((len(column), len(names))), np.zeros((len(column), len(names)), np.float32)
        for r in rows:
            matrix[column[r["term"]], place[r["q"]]] = r["w"]
            held_by[column[r["term"]], place[r["q"]]] = 1
        known = pa.array(list(column), pa.string())
        positive = all(r["w"] > 0 for r in rows)  # then a score is positive where any term is shared

        def score(part):
            out = np.full((part.num_rows, len(names)), -np.inf)
            for c in terms.counted(part.column(1), pairs):
                at = pc.fill_null(pc.index_in(c.known, value_set=known), -1).to_numpy(zero_copy_only=False)[c.term]
                own = at >= 0
                of, at, tf = c.of[own], at[own], c.times[own]
                used, at = np.unique(at, return_inverse=True)
                gain = np.zeros((len(c.size), len(used)))
                gain[of, at] = tf * (k1 + 1) / (tf + k1 * (1 - b + b * c.size[of] / average))
                scores = gain @ matrix[used]
                found = scores > 0 if positive else (gain > 0).astype(np.float32) @ held_by[used] > 0
                out[c.first : c.first + len(c.size)] = np.where(found, scores, -np.inf)
            return out

        return np.array(names, dtype=np.int64), score

    if among is not None:
        among = cut(among.select("id"))
        docs = docs.join(F.broadcast(among) if among.count() <= MOST_IDS else among, "id", "left_semi")
    return _best(held, max(1, -(-n_terms * n_queries // most_cells)), docs, k, scorer)


MOST_ROWS = 100_000


def blocks(rows: DataFrame, most: int = MOST_ROWS) -> list[DataFrame]:
    """Distinct rows in blocks of about `most`, by hash; none for no rows. Each can be told to every task."""
    n = -(-rows.count() // most)
    return [rows.filter(F.pmod(F.xxhash64(*rows.columns), F.lit(n)) == i) for i in range(n)]


def top_groups(texts: DataFrame) -> DataFrame:
    """(id) of one row, the one with the smallest id, of each group of rows (id, text) that differ in white space only."""
    return texts.groupBy(F.sha2(collapse(F.col("text")), 256).alias("t")).agg(F.min("id").alias("id")).select("id")


def grouped_top(queries: DataFrame, passages: DataFrame, k: int, most_cells: int = MOST_CELLS) -> DataFrame:
    """(g, id, part, score, place): the k passages (id, v) that are best for a group of query vectors (g, part, qv). A
    passage's score is that of the vector of the group nearest to it (`part`; the smallest of equal ones), to six digits.
    Groups are told to the tasks in blocks of about `most_cells` cells, a group's vectors together; passages never move."""
    cells = queries.agg(F.sum(F.size("qv"))).first()[0] or 0
    n = max(1, -(-cells // most_cells))

    def block(i: int) -> DataFrame:
        rows = (queries if n == 1 else queries.filter(F.pmod(F.xxhash64("g"), F.lit(n)) == i)).collect()
        rows.sort(key=lambda r: (r["g"], r["part"]))
        shared = queries.sparkSession.sparkContext.broadcast(rows)

        def run(batches):
            rows = shared.value
            groups = np.array([r["g"] for r in rows], dtype=np.int64)
            parts = np.array([r["part"] for r in rows], dtype=np.int64)
            matrix = np.array([r["qv"] for r in rows], dtype=np.float64)
            names, firsts = np.unique(groups, return_index=True)
            lasts = np.append(firsts[1:], len(rows))
            best = [np.zeros((len(names), 0), kind) for kind in (np.int64, np.int64, np.float64)]
            for batch in batches:
                for at in range(0, batch.num_rows, 256) if len(rows) else ():
                    v = batch.slice(at, 256).column(1)
                    x = np.asarray(v.flatten(), dtype=np.float64).reshape(len(v), -1)
                    scores = np.round(np.clip(x @ matrix.T, -1, 1), 6)
                    won = np.stack([a + scores[:, a:b].argmax(1) for a, b in zip(firsts, lasts, strict=True)])
                    ids = np.broadcast_to(batch.column(0).slice(at, 256).to_numpy(), won.shape)
                    new = (ids, parts[won], np.take_along_axis(scores.T, won, 0))
                    best = [np.concatenate(pair, axis=1) for pair in zip(best, new, strict=True)]
                    order = np.lexsort((best[0], -best[2]), axis=1)[:, :k]
                    best = [np.take_along_axis(b, order, 1) for b in best]
            flat = [pa.array(b.ravel()) for b in best]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, best[0].shape[1])), *flat], names=["g", "id", "part", "score"])

        return passages.select("id", "v").mapInArrow(run, "g long, id long, part long, score double")

    return top_k(reduce(DataFrame.unionByName, map(block, range(n))), k, by="g")


MOST_CHARS = 1_000_000


def contained(docs: DataFrame, items: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """(id, item) of every document (id, text) that holds an item's whole text (item, said), once for each distinct item."""
    found = places(docs, items, most_chars=most_chars).select("id", "item")
    # Only an item with several texts can be found twice in a document.
    several = items.groupBy("item").agg(F.min("said").alias("a"), F.max("said").alias("b")).filter("a != b")
    return found if several.isEmpty() else found.distinct()


def places(docs: DataFrame, items: DataFrame, unescape: bool = False, most_chars: int = MOST_CHARS) -> DataFrame:
    """(id, item, at, line, last_line, unescaped): where each text of an item (item, said) first stands in each document
    (id, text) that holds it: the code point, from 0, and the lines, from 1, that it covers. A row for each of an item's texts.

    With `unescape` a text in which line ends are written as backslash and n is also looked for with true line ends, and
    found that way where it does not stand as it is. The texts are told to the tasks in blocks of about `most_chars`
    characters, by hash; a task finds all of a block in one pass over a document (Aho-Corasick). Null texts hold nothing and
    are held by nothing; the empty text stands at the begin of every document. Repeated rows of `items` count once.
    """
    items = items.filter("said IS NOT NULL").select("item", "said").distinct()
    n = max(1, -(-(items.agg(F.sum(F.length("said"))).first()[0] or 0) // most_chars))
    item, name = items.schema["item"].dataType, docs.schema["id"].dataType
    kinds = [("id", name), ("item", item), ("at", LongType()), ("line", LongType()), ("last_line", LongType()), ("unescaped", BooleanType())]
    schema = StructType([StructField(c, t) for c, t in kinds])
    return reduce(DataFrame.unionByName, (_holders(docs, items if n == 1 else items.filter(F.pmod(F.xxhash64("said"), F.lit(n)) == i), schema, unescape) for i in range(n)))


def _holders(docs: DataFrame, block: DataFrame, schema: StructType, unescape: bool) -> DataFrame:
    known: dict[str, list] = {}
    for r in block.collect():
        known.setdefault(r["said"], []).append(r["item"])
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        import ahocorasick

        finder = ahocorasick.Automaton()
        wanted: dict[str, list[tuple[str, bool]]] = {}  # what is looked for: the texts it stands for, and whether unescaped
        for said in shared.value:
            wanted.setdefault(said, []).append((said, False))
            if unescape and "\\n" in said:
                wanted.setdefault(said.replace("\\n", "\n"), []).append((said, True))
        for text in wanted:
            if text:
                finder.add_word(text, text)
        finder.make_automaton()
        for batch in batches:
            rows, out = [], [[] for _ in range(5)]
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text is None:
                    continue
                first = {"": 0} if "" in wanted else {}
                if len(finder):
                    for end, found in finder.iter(text):
                        if found not in first:
                            first[found] = end + 1 - len(found)
                if not first:
                    continue
                ends = [m.start() for m in re.finditer("\n", text)]
                best: dict[str, tuple[int, str, bool]] = {}  # as it is, before unescaped
                for found, at in first.items():
                    for said, changed in wanted[found]:
                        if said not in best or best[said][2]:
                            best[said] = (at, found, changed)
                for said, (at, found, changed) in best.items():
                    for name in shared.value[said]:
                        rows.append(i)
                        line = (bisect_left(ends, at) + 1, bisect_left(ends, at + len(found)) + 1)
                        for column, value in zip(out, (name, at, *line, changed), strict=True):
                            column.append(value)
            types = [to_arrow_type(f.dataType) for f in schema.fields[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=schema.names)

    return docs.select("id", "text").mapInArrow(run, schema)
