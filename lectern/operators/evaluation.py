"""Evaluation of binary judgements: confusion counts, ratios under several policies, comparison of runs.

NULL means failed or unknown and is never read as 0. A judgement table is long: key, item, and one column per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def confusion(df: DataFrame, by: list[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Confusion counts per group; rows with a NULL prediction count as neither."""
    g, p = F.col(gold), F.col(pred)
    return df.groupBy(*by).agg(
        count_where((g == 1) & (p == 1)).alias("tp"), count_where((g == 0) & (p == 1)).alias("fp"),
        count_where((g == 1) & (p == 0)).alias("fn"), count_where((g == 0) & (p == 0)).alias("tn"),
        count_where(p.isNull() & (g == 1)).alias("invalid_pos"), count_where(p.isNull() & (g == 0)).alias("invalid_neg"),
    )


def ratio(top: Column, bottom: Column, undefined: float | None = 0.0) -> Column:
    """top / bottom; an undefined ratio is 0 by default, or NULL."""
    value = F.try_divide(top.cast("double"), bottom.cast("double"))
    return value if undefined is None else F.coalesce(value, F.lit(undefined))


def scores(counts: DataFrame, undefined: float | None = 0.0) -> DataFrame:
    """Adds precision, recall and F1 to confusion counts."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({
        "precision": ratio(tp, tp + fp, undefined), "recall": ratio(tp, tp + fn, undefined), "f1": ratio(2 * tp, 2 * tp + fp + fn, undefined),
    })


def bounds(counts: DataFrame) -> DataFrame:
    """F1 over valid predictions only, and its bounds when invalid ones could be all wrong or all right."""
    tp, fp, fn, ip, neg = (F.col(c) for c in ("tp", "fp", "fn", "invalid_pos", "invalid_neg"))
    return counts.withColumns({
        "f1_valid": ratio(2 * tp, 2 * tp + fp + fn),
        "f1_lower": ratio(2 * tp, 2 * tp + fp + fn + ip + neg),
        "f1_upper": ratio(2 * (tp + ip), 2 * (tp + ip) + fp + fn),
        "recall_all": ratio(tp, tp + fn + ip),
    })


def long_form(wide: DataFrame, key: str, items: list[str], value: str) -> DataFrame:
    return wide.unpivot([key], items, "item", value)


def wide_form(long: DataFrame, key: str, items: list[str], value: str) -> DataFrame:
    """One row per key with a column per item."""
    return long.groupBy(key).pivot("item", items).agg(F.first(value))


def compare(df: DataFrame, by: list[str]) -> DataFrame:
    """df: gold, a, b. Items that run b fixed, broke and changed against run a."""
    right_a, right_b = F.col("a") == F.col("gold"), F.col("b") == F.col("gold")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), count_where(~right_a & right_b).alias("fixed"), count_where(right_a & ~right_b).alias("broken"),
        count_where(F.col("a") != F.col("b")).alias("changed"),
    )


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str], failed: Column) -> DataFrame:
    """Rows of `old` that failed are replaced by `new` where it has them; all others stay as they are."""
    fresh = new.select(key, *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__has"))
    joined = old.join(fresh, key, "left")
    use = failed & F.coalesce(F.col("__has"), F.lit(False))
    picked = {c: F.when(use, F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns({**picked, "recovered": use}).drop("__has", *(f"__{c}" for c in columns))
