"""Sinks: submissions, sparse tables, JSON lines, pages of Markdown, published indexes. Spark's commit makes them atomic."""

from __future__ import annotations

import os
import re
import uuid
from dataclasses import dataclass

from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from lectern.functions.text import escape_markdown
from lectern.operators.evaluation import wide_form


def submission(long: DataFrame, key: str, items: list[str], path: str) -> None:
    """Writes key, verdicts and evidence (`e` columns) as CSV; refuses if any verdict is missing. long: key, item, verdict, evidence."""
    wide = wide_form(long, key, items, "verdict").join(wide_form(long, key, items, "evidence").select(key, *(F.col(i).alias(f"e_{i}") for i in items)), key)
    gaps = wide.filter(" OR ".join(f"`{i}` IS NULL" for i in items)).limit(1).count()
    if gaps:
        raise ValueError("a verdict is missing; nothing is filled with 0")
    wide.select(key, *items, *(F.coalesce(f"e_{i}", F.lit("")).alias(f"e_{i}") for i in items)).write.mode("errorifexists").csv(path, header=True)


def sparse(long: DataFrame, key: str, items: list[str], path: str) -> None:
    """As a table in which missing verdicts stay blank."""
    wide = wide_form(long, key, items, "verdict")
    wide.select(key, *(F.coalesce(F.col(i).cast("string"), F.lit("")).alias(i) for i in items)).write.mode("errorifexists").csv(path, header=True)


def json_lines(df: DataFrame, path: str, compressed: bool = False) -> None:
    df.write.mode("errorifexists").json(path, compression="gzip" if compressed else "none")


def markdown(notices: DataFrame) -> DataFrame:
    """(id, page): metadata as a table and each document in a fence that is longer than any within it."""
    rows = F.array_join(F.transform(F.array_sort(F.map_entries("meta")), lambda e: F.concat(F.lit("| "), escape_markdown(e["key"]), F.lit(" | "), escape_markdown(F.coalesce(e["value"], F.lit(""))), F.lit(" |"))), "\n")

    def block(d):
        longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(d["text"], F.lit("`+"), F.lit(0)), lambda x: F.length(x))), F.lit(0))
        fence = F.repeat(F.lit("`"), F.greatest(longest + 1, F.lit(3)))
        return F.concat(F.lit("## "), d["doc_id"], F.lit("\n"), fence, F.lit("\n"), d["text"], F.lit("\n"), fence)

    return notices.select("id", F.concat_ws("\n", F.concat(F.lit("# "), "id"), F.lit("| key | value |\n|---|---|"), rows, F.array_join(F.transform("docs", block), "\n")).alias("page"))


class _Files(DataSource):
    """Sink of one file per row (name, text): tasks write beside the place, and only when all have ended well do the files get
    their names. A failed or repeated task leaves nothing."""

    @classmethod
    def name(cls) -> str:
        return "lectern_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FilesWriter(self.options["path"], self.options.get("suffix", ""))


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    names: list[str]


class _FilesWriter(DataSourceWriter):
    def __init__(self, path: str, suffix: str):
        self.path, self.suffix, self.run = path.rstrip("/"), suffix, uuid.uuid4().hex

    def _place(self):
        return FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("/") else FileSystem.from_uri(os.path.abspath(self.path))

    def write(self, iterator) -> WriterCommitMessage:
        files, place = self._place()
        folder, names = f"{place}/_stage-{self.run}/{uuid.uuid4().hex}", []
        for row in iterator:
            if row["name"] is None or row["text"] is None or not row["name"].strip(".") or re.search(r"[/\\\0]", row["name"]):
                raise ValueError(f"{row['name']!r} is no name of a file")
            if not names:
                files.create_dir(folder, recursive=True)
            with files.open_output_stream(f"{folder}/{row['name']}{self.suffix}") as out:
                out.write(row["text"].encode())
            names.append(row["name"] + self.suffix)
        return _Written(folder, names)

    def commit(self, messages) -> None:
        files, place = self._place()
        told = [m for m in messages if m is not None]
        names = [n for m in told for n in m.names]
        there = {f.base_name for f in files.get_file_info(FileSelector(place, allow_not_found=True))}
        if len(set(names)) != len(names) or there & set(names):
            self.abort(messages)
            raise ValueError("a name stands twice, or its file exists")
        for m in told:
            for n in m.names:
                files.move(f"{m.folder}/{n}", f"{place}/{n}")
        self.abort(messages)

    def abort(self, messages) -> None:
        files, place = self._place()
        stage = f"{place}/_stage-{self.run}"
        if files.get_file_info(stage).type.name == "Directory":
            files.delete_dir(stage)


def file_per_row(pages: DataFrame, path: str, suffix: str = ".md") -> None:
    """Writes each row's (id, page) as a file of its own, named by its id. `path` is a folder that driver and executors share,
    or a store that Arrow knows. Refuses names that are no names, that stand twice, or that exist; then nothing is written."""
    pages.sparkSession.dataSource.register(_Files)
    pages.select(F.col("id").cast("string").alias("name"), F.col("page").alias("text")).write.format("lectern_files").mode("append").option("path", path).option("suffix", suffix).save()


def csv_with_mark(df: DataFrame, path: str) -> None:
    """CSV whose every part begins with a byte order mark, as spreadsheets want it, and then its header."""
    first, *rest = df.columns
    df.select(F.col(first).alias("\ufeff" + first), *rest).write.mode("errorifexists").option("escape", '"').csv(path, header=True)


def _state(passages: DataFrame) -> dict:
    """What a manifest says of an index: rows, dimension, and a checksum of ids, texts and vectors in any order."""
    told = [c for c in ("id", "text", "vector") if c in passages.columns]
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    odd = F.count(F.when(~F.coalesce(F.abs(norm - 1) <= 1e-4, F.lit(False)), 1))
    n, ids, odd, least, most, check = passages.agg(F.count("*"), F.count_distinct("id"), odd, F.min(F.size("vector")), F.max(F.size("vector")), F.sum(F.xxhash64(*told).cast("decimal(38,0)"))).first()
    if n != ids or odd or least != most:
        raise ValueError(f"{n - ids} repeated ids, {odd} vectors without unit norm, {least} to {most} dimensions")
    return {"rows": n, "dimension": most, "checksum": str(check)}


def publish(passages: DataFrame, path: str, version: str = "1", signature: str = "") -> int:
    """Writes an index beside its place, reads it back and checks it, and only then gives it its name. Never overwrites;
    a refused index leaves nothing under `path`. Returns its rows."""
    spark = passages.sparkSession
    jvm = spark.sparkContext._jvm
    place, stage = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "._stage")
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(place):
        raise ValueError(f"{path} exists")
    files.delete(stage, True)
    passages.write.mode("errorifexists").parquet(f"{stage}/passages")
    try:
        state = _state(spark.read.parquet(f"{stage}/passages"))
        spark.createDataFrame([{"version": version, "signature": signature, **state}]).coalesce(1).write.json(f"{stage}/manifest")
    except ValueError:
        files.delete(stage, True)
        raise
    if not files.rename(stage, place):
        raise ValueError(f"{path} could not be named")
    return state["rows"]


def load_index(spark: SparkSession, path: str, version: str = "1", signature: str = "") -> DataFrame:
    """A published index; refused if its version or the encoder's signature differ, or its content is not what was published."""
    manifest = spark.read.json(f"{path}/manifest").first().asDict()
    if manifest["version"] != version or manifest.get("signature", "") != signature:
        raise ValueError(f"an index of version {manifest['version']} by {manifest.get('signature')!r}")
    passages = spark.read.parquet(f"{path}/passages")
    state = _state(passages)
    if any(manifest[k] != v for k, v in state.items()):
        raise ValueError("the index is not what was published")
    return passages


def append_batches(stream: DataFrame, path: str, checkpoint: str):
    """Appends each micro-batch as JSON lines; a repeated batch overwrites its own folder, so nothing is written twice."""
    write = lambda df, n: df.write.mode("overwrite").json(f"{path}/batch={n}")
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
