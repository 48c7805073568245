"""The model seam: tasks in, judgements out. Failures are values; recovery reruns only what failed."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.evaluation import upsert
from lectern.session import cut

Model = Callable[[list[str]], list[str]]
SCHEMA = "task_id string, id string, grp string, verdicts map<string,int>, error string, attempts int"


def parse(reply: str, items: list[str]) -> dict[str, int]:
    """Strict: one JSON object with exactly these items, whole 0 or 1; no repeated keys, no booleans, no NaN."""

    def once(pairs):
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def no(x):
        raise ValueError(f"{x} is no number")

    said = json.loads(reply, object_pairs_hook=once, parse_constant=no)
    if not isinstance(said, dict) or set(said) != set(items):
        raise ValueError("other keys than asked for")
    if any(isinstance(v, bool) or v not in (0, 1) for v in said.values()):
        raise ValueError("a verdict is not 0 or 1")
    return said


def tasks(records: DataFrame, plan: dict[str, list[str]]) -> DataFrame:
    """records (id, prompt) x groups of a plan: a short list told to every task."""
    groups = F.explode(F.array(*(F.struct(F.lit(g).alias("grp"), F.array(*map(F.lit, items)).alias("items")) for g, items in plan.items())))
    return records.select("id", "prompt", groups.alias("g")).select(F.concat_ws(":", "id", "g.grp").alias("task_id"), "id", "g.grp", "g.items", "prompt")


def judge(task: DataFrame, make_model: Callable[[], Model], retries: int = 1, batch: int = 16) -> DataFrame:
    """Asks an injected model, loaded once per task, in batches; an invalid reply is asked again `retries` times."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch].reset_index(drop=True)
                verdicts, errors, tries = [None] * len(part), [None] * len(part), [0] * len(part)
                todo = list(range(len(part)))
                for _ in range(retries + 1):
                    replies = model([part["prompt"][i] for i in todo])
                    left = []
                    for i, reply in zip(todo, replies, strict=True):
                        tries[i] += 1
                        try:
                            verdicts[i], errors[i] = parse(reply, list(part["items"][i])), None
                        except ValueError as e:
                            errors[i] = str(e)
                            left.append(i)
                    if not (todo := left):
                        break
                yield pd.DataFrame({"task_id": part["task_id"], "id": part["id"], "grp": part["grp"], "verdicts": verdicts, "error": errors, "attempts": tries})

    return task.select("task_id", "id", "grp", "items", "prompt").mapInPandas(run, SCHEMA)


def recover(first: DataFrame, task: DataFrame, make_model: Callable[[], Model]) -> DataFrame:
    """Reruns the tasks that failed, and only those; successes stay as they are."""
    again = judge(task.join(first.filter("error IS NOT NULL").select("task_id"), "task_id", "left_semi"), make_model)
    return upsert(first, again, "task_id", ["verdicts", "error", "attempts"], F.col("error").isNotNull())


def recover_in_steps(first: DataFrame, task: DataFrame, make_model: Callable[[], Model]) -> DataFrame:
    """Two levels: records with a failed task are asked again whole, and only if all of a record's tasks succeed do they
    take its place; of the rest each failed task is asked alone. What succeeded once is never asked for again there, and
    `attempts` adds up."""
    first = cut(first)
    failed = first.filter("error IS NOT NULL").select("id").distinct()
    again = cut(judge(task.join(failed, "id", "left_semi"), make_model))
    whole = again.groupBy("id").agg(F.bool_and(F.col("error").isNull()).alias("whole"), F.first("id").alias("one")).filter("whole").select("id")
    tried = again.select("task_id", F.col("attempts").alias("more"), "verdicts", "error")
    spent = first.join(tried.select("task_id", "more"), "task_id", "left").withColumn("attempts", F.col("attempts") + F.coalesce("more", F.lit(0))).drop("more")
    better = tried.join(again.join(whole, "id", "left_semi").select("task_id"), "task_id", "left_semi").select("task_id", F.col("verdicts").alias("v2"), F.lit(True).alias("better"))
    second = spent.join(better, "task_id", "left").select("task_id", "id", "grp", F.when(F.col("better"), F.col("v2")).otherwise(F.col("verdicts")).alias("verdicts"), F.when(~F.coalesce("better", F.lit(False)), F.col("error")).alias("error"), "attempts")
    second = cut(second)
    alone = cut(judge(task.join(second.filter("error IS NOT NULL").select("task_id"), "task_id", "left_semi"), make_model))
    last = alone.select("task_id", F.col("verdicts").alias("v3"), F.col("error").alias("e3"), F.col("attempts").alias("more"))
    joined = second.join(last, "task_id", "left")
    tried = F.col("more").isNotNull()
    return joined.select("task_id", "id", "grp", F.when(tried, F.col("v3")).otherwise(F.col("verdicts")).alias("verdicts"), F.when(tried, F.col("e3")).otherwise(F.col("error")).alias("error"), (F.col("attempts") + F.coalesce("more", F.lit(0))).alias("attempts"))


def records(judged: DataFrame) -> DataFrame:
    """(id, verdicts, error): a record's verdicts as one map, NULL if any of its tasks failed, with errors in order."""
    merged = F.map_from_entries(F.flatten(F.collect_list(F.map_entries("verdicts"))))
    errors = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("grp", "error")))), lambda e: e["error"]), "; ")
    rows = judged.groupBy("id").agg(F.bool_or(F.col("error").isNotNull()).alias("failed"), merged.alias("verdicts"), errors.alias("error"))
    return rows.select("id", F.when(~F.col("failed"), F.col("verdicts")).alias("verdicts"), F.when(F.col("failed"), F.col("error")).alias("error"))
