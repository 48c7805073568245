"""Sources: notices, strict tables, corpora of text, CSV and zipped XML documents, logs. Errors are rows, never skips."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.operators.rules import NOTICE

MAIN_TYPE = "공고문"
SUFFIXES = ("txt", "csv", "hwpx")


def notices(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Notices from JSON lines, also gzipped (then one task a file: split the files, or repartition after). `_bad` holds
    an unreadable line; a limit takes the first ids in order."""
    df = spark.read.schema(NOTICE + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    df = df.withColumn("file", F.input_file_name())
    return df.orderBy("id").limit(limit) if limit is not None else df


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, ord, value): the lines of text files that are not blank, each with its number in its file (from 1, blank
    ones counted) and its place in the order of input (from 0, over files in order of name, blank ones not counted).

    A file is read in blocks by many tasks. Lines are counted within their task; how many come before a block is a sum over
    the counts of blocks, of which there is a row each. No task reads a file whole, and no line moves.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"), "value")
    rows = rows.withColumn("__all", F.monotonically_increasing_id())
    solid = F.trim(F.regexp_replace("value", r"\s+", " ")) != ""
    blocks = rows.groupBy("file", "__block").agg(F.count("*").alias("n"), F.count(F.when(solid, 1)).alias("m"), F.min("__all").alias("__first"))
    before = W.partitionBy("file").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    files = blocks.groupBy("file").agg(F.sum("m").alias("k")).withColumn("__files", F.coalesce(F.sum("k").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("k")
    held = blocks.withColumns({c: F.coalesce(F.sum(n).over(before), F.lit(0)) for c, n in (("__lines", "n"), ("__solid", "m"))}).join(files, "file")
    held = held.select("file", "__block", "__first", "__lines", F.col("__solid").cast("long") + F.col("__files"))
    held = held.toDF("file", "__block", "__first", "__lines", "__ord")
    kept = rows.filter(solid).withColumn("__kept", F.monotonically_increasing_id())
    # Both counters rise by one within a task; a block's first ones are taken off.
    begin = kept.groupBy("file", "__block").agg(F.min("__kept").alias("__begin"))
    placed = kept.join(F.broadcast(held.join(begin, ["file", "__block"])), ["file", "__block"])
    return placed.select("file", (F.col("__all") - F.col("__first") + F.col("__lines") + 1).alias("line"), (F.col("__kept") - F.col("__begin") + F.col("__ord")).alias("ord"), "value")


def numbered_notices(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Notices from JSON lines with file, line and ord (the order of input), and `_bad` for what cannot be read. A limit takes
    the first lines of the input as they stand, and nothing behind them is looked at, also not for problems."""
    lines = numbered_lines(spark, path)
    if limit is not None:
        lines = lines.filter(F.col("ord") < limit)
    said = F.from_json("value", NOTICE + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return lines.withColumn("r", said).select("file", "line", "ord", "r.*")


def line_problems(df: DataFrame) -> DataFrame:
    """(file, line, id, problem) of invalid notices, and of every repetition of an id but the first in order of input."""
    bad = df.select("file", "line", "id", first_problem().alias("problem")).filter("problem IS NOT NULL")
    first = df.filter("id IS NOT NULL").groupBy("id").agg(F.min("ord").alias("__first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    twice = df.join(first, "id").filter(F.col("ord") > F.col("__first")).select("file", "line", "id", F.lit("repeated id").alias("problem"))
    return bad.unionByName(twice)


def first_problem() -> Column:
    """The first reason why a notice is not valid, or NULL."""
    main = F.size(F.filter("docs", lambda d: d["type"] == MAIN_TYPE))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return (
        F.when(F.col("_bad").isNotNull(), "unreadable line").when(blank(F.col("id")), "no id").when(F.col("meta").isNull(), "no meta")
        .when(F.col("docs").isNull() | (F.size("docs") == 0), "no documents").when(F.exists("docs", lambda d: blank(d["doc_id"]) | d["text"].isNull()), "incomplete document")
        .when(main < 1, "no main document")
    )


def problems(df: DataFrame) -> DataFrame:
    """(id, problem) of invalid and of repeated notices; empty when all is well."""
    bad = df.select("id", first_problem().alias("problem")).filter("problem IS NOT NULL")
    twice = df.filter("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit("repeated id").alias("problem"))
    return bad.unionByName(twice)


def strict_csv(spark: SparkSession, path: str, key: str, binary: list[str], texts: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(table, problems) of a CSV with exactly these columns in this order; cells of `binary` are 0 or 1, keys unique."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    raw = raw.withColumnRenamed(raw.columns[0], raw.columns[0].removeprefix("﻿"))
    want = [key, *binary, *texts]
    if raw.columns != want:
        raise ValueError(f"columns are {raw.columns}, not {want}")
    cells = F.explode(F.array_compact(F.array(*(F.when(~F.coalesce(F.col(b), F.lit("")).isin("0", "1"), F.lit(f"{b} is not 0 or 1")) for b in binary))))
    twice = raw.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key, F.lit("repeated key").alias("problem"))
    found = raw.select(key, cells.alias("problem")).unionByName(twice)
    return raw.select(key, *(F.col(b).try_cast("int").alias(b) for b in binary), *(F.coalesce(t, F.lit("")).alias(t) for t in texts)), found


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder: source, suffix, sha256, bytes and content. Spark's reader leaves out files of 0 bytes; these
    are listed by the file system, so that no source is left out without a word."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "content")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(place, True)
    empty = []
    while listed.hasNext():
        f = listed.next()
        if f.getLen() == 0 and not f.getPath().getName().startswith(("_", ".")):
            empty.append((f.getPath().toString(), 0, bytearray()))
    if empty:
        files = files.unionByName(spark.createDataFrame(empty, "path string, length long, content binary"))
    return files.select(F.col("path").alias("source"), F.lower(F.substring_index("path", ".", -1)).alias("suffix"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), "content")


def _cell_text(node) -> str:
    return " ".join("".join(t.text or "" for t in node.iter() if t.tag.rsplit("}", 1)[-1] == "t").split())


def _local(node) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _grid(table) -> list[list[str]]:
    """A table as a dense grid: a cell that spans rows or columns stands in each of them."""
    grid: dict[tuple[int, int], str] = {}
    for r, row in enumerate(n for n in table.iter() if _local(n) == "tr"):
        c = 0
        for cell in (n for n in row if _local(n) == "tc"):
            while (r, c) in grid:
                c += 1
            span = next((n for n in cell if _local(n) == "cellSpan"), None)
            rows, cols = (int(span.get(k, 1)) if span is not None else 1 for k in ("rowSpan", "colSpan"))
            text = " ".join(filter(None, (_cell_text(p) for p in cell.iter() if _local(p) == "p")))
            for i in range(rows):
                for j in range(cols):
                    grid[r + i, c + j] = text
            c += cols
    if not grid:
        return []
    height, width = max(r for r, _ in grid) + 1, max(c for _, c in grid) + 1
    return [[grid.get((r, c), "") for c in range(width)] for r in range(height)]


class _Cells:
    """Table function: every cell of the tables of a zipped document, with its place, its spans and whether it is a header."""

    def eval(self, content: bytes):
        try:
            archive = zipfile.ZipFile(io.BytesIO(content or b""))
            parts = [(name, ElementTree.fromstring(archive.read(name))) for name in _sections(archive)]
        except (zipfile.BadZipFile, ElementTree.ParseError):
            return  # told as a problem by `source_texts`
        for name, root in parts:
            for t, table in enumerate((n for n in root.iter() if _local(n) == "tbl"), 1):
                number, taken = 0, set()
                for r, row in enumerate(n for n in table if _local(n) == "tr"):
                    for cell in (n for n in row if _local(n) == "tc"):
                        own = {_local(n): n.attrib for n in cell}
                        span, at = own.get("cellSpan", {}), own.get("cellAddr")
                        rows, cols = int(span.get("rowSpan", 1)), int(span.get("colSpan", 1))
                        y = int(at["rowAddr"]) if at else r
                        x = int(at["colAddr"]) if at else next(c for c in range(len(taken) + 1) if (r, c) not in taken)
                        if not at:
                            taken |= {(y + i, x + j) for i in range(rows) for j in range(cols)}
                        number += 1
                        yield name, t, number, y, x, rows, cols, cell.get("header") == "1", _cell_words(cell)


hwpx_cells = F.udtf(_Cells, returnType="section string, tbl int, n int, y int, x int, n_rows int, n_cols int, header boolean, said string")


def _sections(archive: zipfile.ZipFile) -> list[str]:
    return sorted(n for n in archive.namelist() if "section" in n.lower() and n.lower().endswith(".xml"))


def _cell_words(cell) -> str:
    """A cell's text on one line: paragraphs, line breaks and tabs are spaces."""
    out = []
    for n in cell.iter():
        kind = _local(n)
        out.append("".join(n.itertext()) if kind == "t" else " " if kind in ("p", "lineBreak", "tab") else "")
    return " ".join("".join(out).split())


def table_rows(files: DataFrame) -> DataFrame:
    """(source, locator, text): every row of the tables of zipped documents as `label: value` lines, for rows without a
    header cell. A cell that spans rows and columns stands in each of them. A column's label is made of the header rows'
    unlike texts from top to bottom; a column without one is called by its number."""
    cells = files.filter("suffix = 'hwpx'").lateralJoin(hwpx_cells(F.col("content").outer())).drop("content")
    table = ["source", "section", "tbl"]
    spread = cells.withColumn("y", F.explode(F.sequence("y", F.col("y") + F.col("n_rows") - 1))).withColumn("x", F.explode(F.sequence("x", F.col("x") + F.col("n_cols") - 1)))
    grid = spread.groupBy(*table, "y", "x").agg(F.max_by("said", "n").alias("said")).filter("said != ''")
    heads = cells.filter("header").select(*table, "y").distinct()
    listed = F.array_sort(F.collect_list(F.struct("y", "said")))
    labels = grid.join(heads, [*table, "y"], "left_semi").groupBy(*table, "x").agg(F.array_join(F.array_distinct(F.transform(listed, lambda h: h["said"])), " / ").alias("label"))
    body = grid.join(heads, [*table, "y"], "left_anti").join(labels, [*table, "x"], "left")
    field = F.concat(F.coalesce("label", F.concat(F.lit("열"), (F.col("x") + 1).cast("string"))), F.lit(": "), "said")
    rows = body.groupBy(*table, "y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", field.alias("f")))), lambda c: c["f"]), "\n").alias("text"))
    return rows.select("source", F.concat("section", F.lit("/table:"), F.col("tbl").cast("string"), F.lit("/row:"), (F.col("y") + 1).cast("string")).alias("locator"), "text")


def titled_texts(files: DataFrame) -> DataFrame:
    """(source, title, locator, text, problem): all texts of a corpus, tables of zipped documents row by row. The title is the
    file's name without its kind. A source without any text is a problem, as is one that is broken or of unknown kind."""
    texts = source_texts(files, tables=False)
    texts = texts.unionByName(table_rows(files).withColumn("problem", F.lit(None).cast("string")))
    silent = files.select("source").join(texts.select("source"), "source", "left_anti")
    texts = texts.unionByName(silent.select("source", *(F.lit(None).cast("string").alias(c) for c in ("locator", "text")), F.lit("no text").alias("problem")))
    return texts.withColumn("title", F.regexp_replace(F.url_decode(F.replace(F.substring_index("source", "/", -1), F.lit("+"), F.lit("%2B"))), r"\.[^.]*$", ""))


def _zipped(content: bytes, tables: bool = True) -> Iterator[tuple[str, str]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in _sections(z):
            root = ElementTree.fromstring(z.read(name))
            inside = {id(x) for t in root.iter() if _local(t) == "tbl" for x in t.iter()}
            body = [_cell_text(p) for p in root.iter() if _local(p) == "p" and id(p) not in inside and not any(_local(x) == "tbl" for x in p.iter())]
            if text := "\n".join(filter(None, body)):
                yield name, text
            for t, table in enumerate(n for n in root.iter() if _local(n) == "tbl" and tables):
                head, *rows = _grid(table) or [[]]
                for r, row in enumerate(rows):
                    if said := "\n".join(f"{h}: {v}" if h else v for h, v in zip(head, row, strict=True) if v):
                        yield f"{name}:table{t + 1}:row{r + 2}", said


def _texts(suffix: str, content: bytes, tables: bool) -> Iterator[tuple[str, str]]:
    if suffix == "txt":
        yield "text", content.decode("utf-8-sig")
    elif suffix == "csv":
        table = pd.read_csv(io.BytesIO(content), dtype=str, keep_default_na=False, encoding="utf-8-sig")
        for n, row in enumerate(table.to_dict("records"), 2):
            if said := "\n".join(f"{k}: {v.strip()}" for k, v in row.items() if v.strip()):
                yield f"row:{n}", said
    else:
        yield from _zipped(content, tables)


def source_texts(files: DataFrame, tables: bool = True) -> DataFrame:
    """(source, locator, text, problem): texts of every file; a file that is empty, broken or of unknown kind is a problem.
    Without `tables` those of zipped documents are left to `table_rows`, and such a document may have no text here."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for source, suffix, content in zip(batch["source"], batch["suffix"], batch["content"], strict=True):
                try:
                    if suffix not in SUFFIXES:
                        raise ValueError(f"unknown kind {suffix}")
                    own = [(source, where, text, None) for where, text in _texts(suffix, content, tables) if text.strip()]
                    if not own and (tables or suffix != "hwpx"):
                        raise ValueError("no text")
                    out += own
                except (ValueError, zipfile.BadZipFile, ElementTree.ParseError, pd.errors.ParserError) as e:
                    out.append((source, None, None, str(e)))
            yield pd.DataFrame(out, columns=["source", "locator", "text", "problem"])

    return files.select("source", "suffix", "content").mapInPandas(run, "source string, locator string, text string, problem string")


def log_numbers(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """Numbers of a log by the first group of named patterns; lines without any are left out."""
    found = {k: F.regexp_extract("value", p, 1).try_cast("double") for k, p in patterns.items()}
    return spark.read.text(path).select(*(c.alias(k) for k, c in found.items())).dropna(how="all")
