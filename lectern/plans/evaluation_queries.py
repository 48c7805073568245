"""Evaluation queries: gold labels against two fixed rules over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.operators import evaluation as ev
from lectern.operators.retrieval import contained
from lectern.plans.registry import register
from lectern.session import cut, table

ITEMS = ["quality", "toxic"]
HARSH = ["idiot", "moron", "scum", "worthless"]


def gold(spark, d) -> DataFrame:
    return ev.long_form(table(spark, d, "labels"), "doc_id", ITEMS, "gold")


def judged(spark, d) -> DataFrame:
    """doc_id, source, item, a, b: verdicts of two rules; run a fails (NULL) on short documents."""
    docs = table(spark, d, "documents")
    harsh = sum((F.contains(F.lower("text"), F.lit(w)).cast("int") for w in HARSH), F.lit(0))
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    wide = docs.select(
        "doc_id", "source", (F.col("n_chars") < 120).alias("failed"),
        (F.col("n_chars") >= 1500).cast("int").alias("a_quality"), (harsh >= 1).cast("int").alias("a_toxic"),
        (lines >= 3).cast("int").alias("b_quality"), (harsh >= 2).cast("int").alias("b_toxic"),
    )
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("item"), F.when(~F.col("failed"), F.col(f"a_{i}")).alias("a"), F.col(f"b_{i}").alias("b")) for i in ITEMS)))
    return wide.select("doc_id", "source", cells.alias("c")).select("doc_id", "source", "c.item", "c.a", "c.b")


def matched(spark, d) -> DataFrame:
    return judged(spark, d).join(gold(spark, d), ["doc_id", "item"])


_HARSH_SQL = " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in HARSH)
BASE = f"""
w AS (SELECT doc_id, source, n_chars, {_HARSH_SQL} AS harsh, length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM documents),
j AS (SELECT doc_id, source, 'quality' AS item, CASE WHEN n_chars >= 120 THEN CAST(n_chars >= 1500 AS INT) END AS a, CAST(lines >= 3 AS INT) AS b FROM w
      UNION ALL SELECT doc_id, source, 'toxic', CASE WHEN n_chars >= 120 THEN CAST(harsh >= 1 AS INT) END, CAST(harsh >= 2 AS INT) FROM w),
g AS (SELECT doc_id, 'quality' AS item, quality AS gold FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels),
m AS (SELECT j.*, gold FROM j JOIN g USING (doc_id, item))"""
_COUNTS = """count(*) FILTER (gold = 1 AND {p} = 1) AS tp, count(*) FILTER (gold = 0 AND {p} = 1) AS fp,
  count(*) FILTER (gold = 1 AND {p} = 0) AS fn, count(*) FILTER (gold = 0 AND {p} = 0) AS tn,
  count(*) FILTER (gold = 1 AND {p} IS NULL) AS invalid_pos, count(*) FILTER (gold = 0 AND {p} IS NULL) AS invalid_neg"""


def counts_sql(p: str, by: str = "item", source: str = "m") -> str:
    return f"SELECT {by}, {_COUNTS.format(p=p)} FROM {source} GROUP BY {by}"


def _r(top: str, bottom: str) -> str:
    return f"coalesce(CAST({top} AS DOUBLE) / nullif(CAST({bottom} AS DOUBLE), 0), 0)"


_RATIOS = f"round({_r('tp', 'tp + fp')}, 6) AS precision, round({_r('tp', 'tp + fn')}, 6) AS recall, round({_r('2 * tp', '2 * tp + fp + fn')}, 6) AS f1"


@register("eval_per_item_report", f"WITH {BASE}, c AS ({counts_sql('b')}) SELECT item, tp, fp, fn, tn, tp + fn AS support, tp + fp AS predicted, {_RATIOS} FROM c")
def eval_per_item_report(spark, d):
    """Confusion counts, support and ratios per item; undefined ratios are 0."""
    c = ev.scores(ev.confusion(matched(spark, d), ["item"], pred="b"))
    return c.select("item", "tp", "fp", "fn", "tn", (F.col("tp") + F.col("fn")).alias("support"), (F.col("tp") + F.col("fp")).alias("predicted"), *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@register(
    "eval_macro_micro",
    f"""WITH {BASE}, c AS ({counts_sql('b')}), s AS (SELECT *, {_r('tp', 'tp + fp')} AS p, {_r('tp', 'tp + fn')} AS r, {_r('2 * tp', '2 * tp + fp + fn')} AS f FROM c)
    SELECT round(avg(f), 6) AS macro_f1, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall,
    round({_r('2 * sum(tp)', '2 * sum(tp) + sum(fp) + sum(fn)')}, 6) AS micro_f1 FROM s""",
)
def eval_macro_micro(spark, d):
    s = ev.scores(ev.confusion(matched(spark, d), ["item"], pred="b"))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return s.agg(
        F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.avg("precision"), 6).alias("macro_precision"), F.round(F.avg("recall"), 6).alias("macro_recall"),
        F.round(ev.ratio(2 * tp, 2 * tp + fp + fn), 6).alias("micro_f1"),
    )


@register(
    "eval_exact_match",
    f"""WITH {BASE}, e AS (SELECT doc_id, bool_and(b = gold) AS same, count(*) FILTER (b = gold) AS hits, count(*) AS cells FROM m GROUP BY doc_id)
    SELECT count(*) AS documents, count(*) FILTER (same) AS exact, round(count(*) FILTER (same) / CAST(count(*) AS DOUBLE), 6) AS exact_share,
    round(sum(hits) / CAST(sum(cells) AS DOUBLE), 6) AS label_accuracy FROM e""",
)
def eval_exact_match(spark, d):
    same = F.col("b") == F.col("gold")
    e = matched(spark, d).groupBy("doc_id").agg(F.bool_and(same).alias("same"), ev.count_where(same).alias("hits"), F.count("*").alias("cells"))
    exact = ev.count_where(F.col("same"))
    return e.agg(F.count("*").alias("documents"), exact.alias("exact"), F.round(ev.ratio(exact, F.count("*")), 6).alias("exact_share"), F.round(ev.ratio(F.sum("hits"), F.sum("cells")), 6).alias("label_accuracy"))


@register("eval_zero_support", f"WITH {BASE} SELECT item, string_agg(source, ',' ORDER BY source) AS sources FROM (SELECT source, item FROM m GROUP BY source, item HAVING sum(gold) = 0) GROUP BY item")
def eval_zero_support(spark, d):
    """Sources without a positive label, as a sorted list per item."""
    none = matched(spark, d).groupBy("source", "item").agg(F.sum("gold").alias("support")).filter("support = 0")
    return none.groupBy("item").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@register(
    "eval_bounds_with_invalid",
    f"""WITH {BASE}, c AS ({counts_sql('a')}) SELECT item, tp, fp, fn, tn, invalid_pos, invalid_neg, round({_r('2*tp', '2*tp+fp+fn')}, 6) AS f1_valid,
    round({_r('2*tp', '2*tp+fp+fn+invalid_pos+invalid_neg')}, 6) AS f1_lower, round({_r('2*(tp+invalid_pos)', '2*(tp+invalid_pos)+fp+fn')}, 6) AS f1_upper,
    round({_r('tp', 'tp+fn+invalid_pos')}, 6) AS recall_all FROM c""",
)
def eval_bounds_with_invalid(spark, d):
    b = ev.bounds(ev.confusion(matched(spark, d), ["item"], pred="a"))
    return b.select("item", "tp", "fp", "fn", "tn", "invalid_pos", "invalid_neg", *(F.round(c, 6).alias(c) for c in ("f1_valid", "f1_lower", "f1_upper", "recall_all")))


def _n(top: str, bottom: str) -> str:
    return f"CAST({top} AS DOUBLE) / nullif(CAST({bottom} AS DOUBLE), 0)"


@register(
    "eval_nullable_ratio",
    f"""WITH {BASE}, c AS ({counts_sql('a', 'source, item')}), s AS (SELECT *, {_n('tp', 'tp+fp')} AS p, {_n('tp', 'tp+fn')} AS r, {_n('2*tp', '2*tp+fp+fn')} AS f FROM c)
    SELECT source, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f), 6) AS macro_f1,
    count(*) FILTER (f IS NULL) AS undefined, sum(tp + tn) AS right_cells, sum(tp + tn + fp + fn) AS valid_cells FROM s GROUP BY source""",
)
def eval_nullable_ratio(spark, d):
    """Undefined ratios are NULL and do not enter the means."""
    s = ev.scores(ev.confusion(matched(spark, d), ["source", "item"], pred="a"), undefined=None)
    return s.groupBy("source").agg(
        F.round(F.avg("precision"), 6).alias("macro_precision"), F.round(F.avg("recall"), 6).alias("macro_recall"), F.round(F.avg("f1"), 6).alias("macro_f1"),
        ev.count_where(F.col("f1").isNull()).alias("undefined"), F.sum(F.col("tp") + F.col("tn")).alias("right_cells"),
        F.sum(F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("valid_cells"),
    )


_PAIR = "p AS (SELECT * FROM m WHERE a IS NOT NULL)"


@register(
    "compare_runs",
    f"""WITH {BASE}, {_PAIR} SELECT item, count(*) AS n, count(*) FILTER (a <> gold AND b = gold) AS fixed, count(*) FILTER (a = gold AND b <> gold) AS broken,
    count(*) FILTER (a <> b) AS changed FROM p GROUP BY item""",
)
def compare_runs(spark, d):
    return ev.compare(matched(spark, d).filter("a IS NOT NULL"), ["item"])


@register(
    "compare_item_deltas",
    f"""WITH {BASE}, x AS ({counts_sql('a', source='(SELECT * FROM m WHERE a IS NOT NULL)')}), y AS ({counts_sql('b', source='(SELECT * FROM m WHERE a IS NOT NULL)')})
    SELECT x.item AS item, round({_r('2*x.tp', '2*x.tp+x.fp+x.fn')}, 6) AS f1_a, round({_r('2*y.tp', '2*y.tp+y.fp+y.fn')}, 6) AS f1_b, y.tp - x.tp AS d_tp, y.fp - x.fp AS d_fp FROM x JOIN y USING (item)""",
)
def compare_item_deltas(spark, d):
    pairs = matched(spark, d).filter("a IS NOT NULL")
    one = ev.scores(ev.confusion(pairs, ["item"], pred="a")).select("item", F.round("f1", 6).alias("f1_a"), F.col("tp").alias("tp_a"), F.col("fp").alias("fp_a"))
    two = ev.scores(ev.confusion(pairs, ["item"], pred="b")).select("item", F.round("f1", 6).alias("f1_b"), "tp", "fp")
    return one.join(two, "item").select("item", "f1_a", "f1_b", (F.col("tp") - F.col("tp_a")).alias("d_tp"), (F.col("fp") - F.col("fp_a")).alias("d_fp"))


_CASE = "CASE WHEN a = gold AND b = gold THEN 'still_correct' WHEN a = gold THEN 'regressed' WHEN b = gold THEN 'corrected' ELSE 'still_wrong' END"


@register("transitions", f"WITH {BASE}, {_PAIR} SELECT source, {_CASE} AS category, count(*) AS n FROM p GROUP BY 1, 2")
def transitions(spark, d):
    right_a, right_b = F.col("a") == F.col("gold"), F.col("b") == F.col("gold")
    category = F.when(right_a & right_b, "still_correct").when(right_a, "regressed").when(right_b, "corrected").otherwise("still_wrong")
    return matched(spark, d).filter("a IS NOT NULL").groupBy("source", category.alias("category")).agg(F.count("*").alias("n"))


_NAMED = "CASE WHEN gold = 1 AND a = 1 AND b = 0 THEN 'new_fn' WHEN gold = 1 AND a = 0 AND b = 1 THEN 'resolved_fn' WHEN gold = 0 AND a = 1 AND b = 0 THEN 'resolved_fp' WHEN gold = 0 AND a = 0 AND b = 1 THEN 'new_fp' ELSE 'same' END"


@register("transition_matrix8", f"WITH {BASE}, {_PAIR} SELECT gold, a, b, {_NAMED} AS name, count(*) AS n FROM p GROUP BY 1, 2, 3, 4")
def transition_matrix8(spark, d):
    g, a, b = F.col("gold"), F.col("a"), F.col("b")
    name = F.when((g == 1) & (a == 1) & (b == 0), "new_fn").when((g == 1) & (a == 0) & (b == 1), "resolved_fn").when((g == 0) & (a == 1) & (b == 0), "resolved_fp").when((g == 0) & (a == 0) & (b == 1), "new_fp").otherwise("same")
    return matched(spark, d).filter("a IS NOT NULL").groupBy("gold", "a", "b", name.alias("name")).agg(F.count("*").alias("n"))


@register(
    "counterfactual",
    f"""WITH {BASE}, {_PAIR}, x AS (SELECT *, CASE WHEN item = 'toxic' THEN b ELSE a END AS c FROM p), c AS ({counts_sql('c', source='x')})
    SELECT round(avg({_r('2*tp', '2*tp+fp+fn')}), 6) AS macro_f1, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM c""",
)
def counterfactual(spark, d):
    """Run a with the verdicts of run b for one item, scored again."""
    mixed = matched(spark, d).filter("a IS NOT NULL").withColumn("c", F.when(F.col("item") == "toxic", F.col("b")).otherwise(F.col("a")))
    s = ev.scores(ev.confusion(mixed, ["item"], pred="c"))
    return s.agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


@register(
    "id_set_audit",
    """SELECT coalesce(d.source, '') AS source, count(*) FILTER (l.doc_id IS NULL) AS unlabelled, count(*) FILTER (d.doc_id IS NULL) AS unknown, count(*) FILTER (d.doc_id = l.doc_id) AS shared
    FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""",
)
def id_set_audit(spark, d):
    """Ids on either side only, by a full outer join."""
    a, b = table(spark, d, "documents").select(F.col("doc_id").alias("x"), "source"), table(spark, d, "labels").select(F.col("doc_id").alias("y"))
    return a.join(b, F.col("x") == F.col("y"), "full_outer").groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(
        ev.count_where(F.col("y").isNull()).alias("unlabelled"), ev.count_where(F.col("x").isNull()).alias("unknown"), ev.count_where(F.col("x") == F.col("y")).alias("shared"))


@register("missing_ids", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@register("merge_recovery", f"WITH {BASE} SELECT doc_id, item, coalesce(a, b) AS verdict, a IS NULL AS recovered FROM j")
def merge_recovery(spark, d):
    """Failed verdicts of the first run are replaced by the second's; successes stay untouched."""
    rows = judged(spark, d).withColumn("k", F.concat_ws(":", F.col("doc_id").cast("string"), "item"))
    old, new = rows.select("k", "doc_id", "item", F.col("a").alias("verdict")), rows.select("k", F.col("b").alias("verdict"))
    return ev.upsert(old, new, "k", ["verdict"], F.col("verdict").isNull()).select("doc_id", "item", "verdict", "recovered")


@register(
    "attempt_union",
    f"WITH {BASE}, u AS (SELECT doc_id, item, a AS verdict, 'main' AS stage FROM j UNION ALL SELECT doc_id, item, b, 'recovery' FROM j WHERE a IS NULL) SELECT stage, item, count(*) AS n, count(verdict) AS valid, coalesce(sum(verdict), 0) AS positive FROM u GROUP BY 1, 2",
)
def attempt_union(spark, d):
    """First attempts and their repeats in one table, later ones marked as recovery."""
    rows = judged(spark, d)
    both = rows.select("item", F.col("a").alias("verdict"), F.lit("main").alias("stage")).unionByName(rows.filter("a IS NULL").select("item", F.col("b").alias("verdict"), F.lit("recovery").alias("stage")))
    return both.groupBy("stage", "item").agg(F.count("*").alias("n"), F.count("verdict").alias("valid"), F.coalesce(F.sum("verdict"), F.lit(0)).alias("positive"))


@register(
    "paired_cohort",
    f"WITH {BASE}, ok AS (SELECT doc_id FROM j GROUP BY doc_id HAVING bool_and(a IS NOT NULL) INTERSECT SELECT doc_id FROM labels) SELECT source, count(*) AS cells, sum(CAST(a = b AS INT)) AS agree FROM j WHERE doc_id IN (SELECT doc_id FROM ok) GROUP BY source",
)
def paired_cohort(spark, d):
    """Only documents that succeeded under every condition."""
    rows = judged(spark, d)
    ok = rows.groupBy("doc_id").agg(F.bool_and(F.col("a").isNotNull()).alias("ok")).filter("ok").select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))
    return rows.join(ok, "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("cells"), F.sum((F.col("a") == F.col("b")).cast("int")).alias("agree"))


@register("co_positive_pairs", f"WITH {BASE} SELECT x.item AS item_1, y.item AS item_2, count(*) AS n FROM j x JOIN j y ON x.doc_id = y.doc_id AND x.item < y.item AND x.b = 1 AND y.b = 1 GROUP BY 1, 2")
def co_positive_pairs(spark, d):
    """How often two items are positive together; a document's items are one short list, so no self-join is needed."""
    sets = judged(spark, d).filter("b = 1").groupBy("doc_id").agg(F.array_sort(F.collect_set("item")).alias("s"))
    pairs = sets.select(F.col("s"), F.posexplode("s").alias("i", "item_1")).select("item_1", F.explode(F.expr("slice(s, i + 2, size(s))")).alias("item_2"))
    return pairs.groupBy("item_1", "item_2").agg(F.count("*").alias("n"))


@register("breakdown_by_feature", f"WITH {BASE} SELECT source, item, a IS NULL AS failed, count(*) AS n, sum(gold) AS positive, sum(b) AS predicted FROM m GROUP BY 1, 2, 3")
def breakdown_by_feature(spark, d):
    return matched(spark, d).groupBy("source", "item", F.col("a").isNull().alias("failed")).agg(F.count("*").alias("n"), F.sum("gold").alias("positive"), F.sum("b").alias("predicted"))


@register("submission_pivot", f"WITH {BASE} SELECT doc_id, max(b) FILTER (item = 'quality') AS quality, max(b) FILTER (item = 'toxic') AS toxic FROM j GROUP BY doc_id")
def submission_pivot(spark, d):
    return ev.wide_form(judged(spark, d), "doc_id", ITEMS, "b")


@register(
    "submission_violations",
    f"""WITH {BASE}, w2 AS (SELECT doc_id, max(a) FILTER (item = 'quality') AS q, max(a) FILTER (item = 'toxic') AS t FROM j GROUP BY doc_id)
    SELECT doc_id, 'missing verdict' AS violation FROM w2 WHERE q IS NULL OR t IS NULL UNION ALL SELECT doc_id, 'toxic but good' FROM w2 WHERE q = 1 AND t = 1
    UNION ALL SELECT l.doc_id, 'label without document' FROM labels l WHERE l.doc_id NOT IN (SELECT doc_id FROM documents)""",
)
def submission_violations(spark, d):
    """Every broken rule of a submission as a row; nothing raises within the plan."""
    wide = ev.wide_form(judged(spark, d), "doc_id", ITEMS, "a")
    found = F.array_compact(F.array(F.when(F.col("quality").isNull() | F.col("toxic").isNull(), F.lit("missing verdict")), F.when((F.col("quality") == 1) & (F.col("toxic") == 1), F.lit("toxic but good"))))
    strange = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit("label without document").alias("violation"))
    return wide.select("doc_id", F.explode(found).alias("violation")).unionByName(strange)


_DRAW = "CAST(('0x' || substr(md5(CAST(b.range AS VARCHAR) || ':' || CAST(i.rn AS VARCHAR)), 1, 8)) AS BIGINT) % n"


@register(
    "bootstrap_ci",
    f"""WITH {BASE}, r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS n, sum(CAST(b = gold AS INT)) - sum(CAST(coalesce(a, 1 - gold) = gold AS INT)) AS delta FROM m GROUP BY doc_id),
    draws AS (SELECT b.range AS resample, {_DRAW} AS pick FROM range(100) b, r i), s AS (SELECT resample, avg(delta) AS x FROM draws JOIN r ON pick = r.rn GROUP BY resample)
    SELECT round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.5), 6) AS mid, round(quantile_cont(x, 0.975), 6) AS high, count(*) AS resamples FROM s""",
)
def bootstrap_ci(spark, d, resamples: int = 100):
    """Paired bootstrap over documents with draws by hash: the same on every engine and partitioning."""
    per = matched(spark, d).groupBy("doc_id").agg((F.sum((F.col("b") == F.col("gold")).cast("int")) - F.sum((F.coalesce("a", 1 - F.col("gold")) == F.col("gold")).cast("int"))).alias("delta"))
    # Draws are of row numbers: numbered through range partitions, not in one task.
    rows = numbered(per, "doc_id")
    n = per.count()
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("resample").cast("string"), F.col("rn").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    draws = rows.select("rn", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample")).select("resample", (draw % n).alias("rn"))
    means = draws.join(rows, "rn").groupBy("resample").agg(F.avg("delta").alias("x"))
    return means.agg(*(F.round(F.percentile("x", F.lit(q)), 6).alias(name) for name, q in (("low", 0.025), ("mid", 0.5), ("high", 0.975))), F.count("*").alias("resamples"))


def numbered(df: DataFrame, *keys: str, name: str = "rn") -> DataFrame:
    """Rows numbered from 0 in order of keys: a sort by range, numbers within partitions, and the partitions' offsets.

    The sorted rows are computed once and kept: planned twice, their partitions could be merged in two ways.
    """
    ordered = cut(df.orderBy(*keys).withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    marked = ordered.withColumns({"__part": part, "__place": place}).drop("__at")
    # One row for each partition.
    offsets = marked.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__first", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return marked.join(F.broadcast(offsets.select("__part", "__first")), "__part").withColumn(name, F.col("__first") + F.col("__place")).drop("__part", "__place", "__first")


@register(
    "best_run",
    f"WITH {BASE}, x AS (SELECT source, 'a' AS run, avg(CAST(coalesce(a, -1) = gold AS INT)) AS acc FROM m GROUP BY source UNION ALL SELECT source, 'b', avg(CAST(b = gold AS INT)) FROM m GROUP BY source) SELECT source, run, round(acc, 6) AS accuracy, round(acc * 1853, 4) AS expected_right FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY acc DESC, run) AS k FROM x) WHERE k = 1",
)
def best_run(spark, d):
    """The more accurate run per source (first wins ties), and its linear projection to 1853 documents."""
    acc = matched(spark, d).groupBy("source").agg(F.avg((F.coalesce("a", F.lit(-1)) == F.col("gold")).cast("int")).alias("a"), F.avg((F.col("b") == F.col("gold")).cast("int")).alias("b"))
    best = F.greatest("a", "b")
    return acc.select("source", F.when(F.col("a") >= F.col("b"), "a").otherwise("b").alias("run"), F.round(best, 6).alias("accuracy"), F.round(best * 1853, 4).alias("expected_right"))


@register("rule_override", f"WITH {BASE} SELECT item, count(*) AS n, sum(CASE WHEN item = 'toxic' THEN b ELSE a END) AS positive, count(*) FILTER (item = 'toxic' AND a IS DISTINCT FROM b) AS overridden FROM j GROUP BY item")
def rule_override(spark, d):
    """Verdict maps merged with the right side winning, per document."""
    maps = judged(spark, d).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("item", "a"))).alias("model"), F.map_from_entries(F.collect_list(F.struct("item", "b"))).alias("rule"))
    rules = F.map_filter("rule", lambda k, v: k == "toxic")
    kept = F.map_filter("model", lambda k, v: ~F.map_contains_key(rules, k))
    merged = maps.select("doc_id", "model", F.explode(F.map_concat(kept, rules)).alias("item", "verdict"))
    return merged.groupBy("item").agg(F.count("*").alias("n"), F.sum("verdict").alias("positive"), ev.count_where((F.col("item") == "toxic") & ~F.col("verdict").eqNullSafe(F.element_at("model", F.col("item")))).alias("overridden"))


@register(
    "merge_group_judgements",
    f"WITH {BASE}, x AS (SELECT doc_id, string_agg(CASE WHEN a IS NULL THEN item || ' failed' END, '; ' ORDER BY item) AS error, sum(a) AS total FROM j GROUP BY doc_id) SELECT doc_id, coalesce(error, '') AS error, CASE WHEN error IS NULL THEN CAST(total AS BIGINT) END AS positives FROM x",
)
def merge_group_judgements(spark, d):
    """A document's verdicts as one row: NULL if any part failed, with the errors in order."""
    errors = F.array_sort(F.collect_list(F.when(F.col("a").isNull(), F.concat("item", F.lit(" failed")))))
    x = judged(spark, d).groupBy("doc_id").agg(F.array_join(errors, "; ").alias("error"), F.sum("a").alias("total"))
    return x.select("doc_id", "error", F.when(F.col("error") == "", F.col("total")).alias("positives"))


@register("error_cases", f"WITH {BASE} SELECT doc_id, item, gold, b AS pred FROM m WHERE b <> gold")
def error_cases(spark, d):
    return matched(spark, d).filter("b <> gold").select("doc_id", "item", "gold", F.col("b").alias("pred"))


@register("label_cross_check", f"WITH {BASE} SELECT item, count(*) AS n, count(*) FILTER (a IS DISTINCT FROM b) AS mismatches FROM j GROUP BY item")
def label_cross_check(spark, d):
    rows = judged(spark, d)
    return rows.select("doc_id", "item", "a").join(rows.select("doc_id", "item", "b"), ["doc_id", "item"]).groupBy("item").agg(F.count("*").alias("n"), ev.count_where(~F.col("a").eqNullSafe(F.col("b"))).alias("mismatches"))


@register(
    "plan_partition_check",
    f"WITH {BASE}, p AS (SELECT source, count(*) AS n, count(DISTINCT (doc_id, item)) AS distinct_cells, count(DISTINCT item) AS items FROM j GROUP BY source) SELECT source, n, distinct_cells, n = distinct_cells AS disjoint, items = 2 AS complete FROM p",
)
def plan_partition_check(spark, d):
    """Whether each group's cells are distinct and cover every item."""
    p = judged(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("doc_id", "item").alias("distinct_cells"), F.count_distinct("item").alias("items"))
    return p.select("source", "n", "distinct_cells", (F.col("n") == F.col("distinct_cells")).alias("disjoint"), (F.col("items") == len(ITEMS)).alias("complete"))


@register(
    "evidence_substring_audit",
    """SELECT item_id, (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM documents d WHERE contains(d.text, b.text)) AS found, evidence_unsafe AS unsafe, size > 500 AS too_long
    FROM (SELECT item_id, text, text LIKE '=%' OR text LIKE '+%' OR text LIKE '@%' AS evidence_unsafe, length(text) AS size FROM benchmark) b""",
)
def evidence_substring_audit(spark, d):
    """In how many documents each whole item stands, and whether it may be shown as evidence. No pair of texts is joined:
    tasks find all items of a text in one pass over it."""
    docs, items = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("said"))
    found = contained(docs, items).groupBy("item").agg(F.count("*").alias("found"))
    return items.join(found, "item", "left").select(F.col("item").alias("item_id"), F.lit(docs.count()).alias("n"), F.coalesce("found", F.lit(0)).alias("found"), F.col("said").rlike("^[=+@]").alias("unsafe"), (F.length("said") > 500).alias("too_long"))


@register("evidence_whole_audit")
def evidence_whole_audit(spark, d):
    """Counts over all pairs of whole items and documents, items with equal ids together; held against brute force in the tests."""
    docs, items = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), table(spark, d, "benchmark").select("item_id", F.col("text").alias("said"))
    texts = items.filter("said IS NOT NULL").select(F.col("said").alias("item"), "said").distinct()
    found = contained(docs, texts).groupBy("item").agg(F.count("*").alias("c")).withColumnRenamed("item", "said")
    per = items.join(found, "said", "left").withColumn("all", F.lit(docs.count()))
    return per.groupBy("item_id").agg(
        F.sum("all").alias("n"), F.sum(F.coalesce("c", F.lit(0))).alias("found"), F.sum(F.when(F.col("said").rlike("^[=+@]"), F.col("all")).otherwise(0)).alias("unsafe"),
        F.sum(F.when(F.length("said") > 500, F.col("all")).otherwise(0)).alias("too_long"))
