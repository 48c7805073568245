"""Evidence of judgements: what may be shown, and why not. All within expressions and one join on the record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST = 500


def located(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """claims (id, ..., evidence) with `found`: whether the evidence stands in a text of its record. docs: id, text."""
    asked = claims.filter(F.coalesce("evidence", F.lit("")) != "").select("id", "evidence").distinct()
    texts = docs.join(asked.select("id").distinct(), "id", "left_semi")  # only of records that state evidence
    held = texts.join(asked, "id").filter(F.contains("text", F.col("evidence"))).select("id", "evidence").distinct()
    return claims.join(held.withColumn("found", F.lit(True)), ["id", "evidence"], "left").select(*claims.columns, F.coalesce("found", F.lit(False)).alias("found"))


def unsafe(evidence: Column) -> Column:
    return evidence.rlike("^[=+@]")


def finalize(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """claims (id, item, verdict, evidence, absence): evidence is NULL for negative verdicts and items about absence, and
    where it is unsafe or not in the source; only the latter two count as `dropped`."""
    said = F.when((F.col("verdict") == 1) & ~F.col("absence") & (F.coalesce("evidence", F.lit("")) != ""), F.col("evidence"))
    bad = unsafe(F.col("evidence")) | ~F.col("found")
    rows = located(claims.withColumn("evidence", said), docs).withColumn("dropped", F.coalesce(bad & F.col("evidence").isNotNull(), F.lit(False)))
    return rows.withColumn("evidence", F.when(~F.col("dropped"), F.col("evidence"))).drop("found")


def reasons(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """claims with `reasons`: why stated evidence is not valid, in fixed order, or why evidence is missing."""
    rows = located(claims, docs)
    said = F.coalesce("evidence", F.lit("")) != ""
    told = [
        (said & (F.col("verdict") != 1), "negative verdict"), (said & F.col("absence"), "item about absence"), (said & (F.length("evidence") > LONGEST), "too long"),
        (said & unsafe(F.col("evidence")), "unsafe start"), (said & ~F.col("found"), "not in the source"), (~said & (F.col("verdict") == 1) & ~F.col("absence"), "missing"),
    ]
    return rows.withColumn("reasons", F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(why)) for c, why in told)))).drop("found")
