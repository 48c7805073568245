"""A training-data pipeline over `documents`: each stage calls one operator on all that its predecessor kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `docs`, also
where these are named as an operator's own. Null texts have no language and go in the first stage; so do texts without
letters. Texts of any length are read whole. Rows with an equal doc_id are one document to the Jaccard stage: they go
only if every one of them is a copy. A row with a null doc_id stays there. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, jaccard_join, langid, packing, secrets
from lectern.llm.shared import aside, back, cut
from lectern.session import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows outside the held-out fold; documents without a language go."""
    langs, probs = langid.learn(docs.filter(~langid.held_out()))
    held = aside(docs, ["lang_pred", "score"])
    said = langid.identify(held, langs, probs, keep=tuple(held.columns))
    return back(said.filter(F.col("lang_pred") != langid.UNKNOWN), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays."""
    found = jaccard_join.join(docs).groupBy("doc_id").agg(F.max(F.col("component_id") == F.col("doc_id")).alias("first"))
    gone = found.filter(~F.col("first")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), mode="documents")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text, and n_chars follows; no document goes."""
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in windows of 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packed),
]
#: Language models, fields and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


#: Stages whose results are kept by a checkpoint: what follows reads them several times. The others are read once.
KEPT = ("language_id", "decontamination")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name in KEPT:
            docs = cut(docs)
    return docs
