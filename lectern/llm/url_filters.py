"""URL filters: fixed host-and-path rules first, then association rules mined by Spark's FP-growth.

The fixed rules label the URLs they fit. From those labels FP-growth mines which combinations of URL tokens (domain
suffixes, host labels, path words, file type, query names, scheme) go with a verdict. A mined rule is kept if its
confidence and support reach the thresholds and no rule with fewer tokens says the same with no less confidence.

Tokens that the same labelled URLs hold are one item (any of them stands for it: rules with two of them are pruned anyway,
and a rule with one is as good as with another). An item of which all URLs have one verdict is a rule by itself and is
mined no further: with more items the rule would be pruned, and for the other verdict there is none. So URLs of one
template, however many tokens they share, do not make FP-growth list the subsets of these. What is left to it are items
that occur with both verdicts and in different URLs; where very many of those meet in very many URLs, it is still slow.

An inverted index matches the rest: each URL's tokens join the rules' items, and a rule matches where all its items do.
The most confident, then most supported, then longest rule decides; without one the verdict is `allow`.

DataFrame functions and Spark ML only. Nulls: a null url, or one without `://`, has an empty host and path, no tokens
but its own absence, and so the default verdict. Rows are kept one to one. Empty table: empty result, nothing is mined.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import cut

#: Verdict, host, path: fixed values of the query's contract.
RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
DEFAULT = "allow"
MIN_SUPPORT = 0.02
MIN_CONFIDENCE = 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or a url without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def fixed(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """All distinct tokens of a URL; path words that hold digits only stand for one token."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.lit("domain="), F.array_join(F.slice(labels, -n, n), ".")))
    words = F.filter(F.split(path, "[/._-]"), lambda w: w != "")
    words = F.transform(words, lambda w: F.concat(F.lit("path="), F.when(w.rlike("^[0-9]+$"), F.lit("#")).otherwise(F.lower(w))))
    names = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)="), F.lit(1)), lambda q: F.concat(F.lit("query="), F.lower(q)))
    more = F.array(F.concat(F.lit("scheme="), F.lower(F.substring_index(url, "://", 1))), F.concat(F.lit("label="), labels[0]))
    last = F.regexp_extract(path, r"\.([^./]+)$", 1)
    kind = F.when(last != "", F.array(F.concat(F.lit("type="), F.lower(last)))).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(suffixes, words, names, more, kind))
    return F.when(F.instr(url, "://") > 0, F.filter(every, lambda t: t.isNotNull())).otherwise(F.array().cast("array<string>"))


def items_of(labelled: DataFrame, n: int, min_support: float = MIN_SUPPORT) -> DataFrame:
    """(item, tokens, n, verdict, most): the frequent tokens of n rows of `tokens` and `verdict`, grouped into items where the
    same rows hold them (by count and two 64-bit sums); an item's first token names it. Its rows, and its commonest verdict
    with the rows that have it. A row has its tokens once, so there are no more items than tokens of a row / min_support."""
    rows = labelled.withColumn("__row", F.monotonically_increasing_id())
    said = rows.select(F.explode(F.array_distinct("tokens")).alias("token"), "verdict", F.xxhash64("__row").alias("a"), F.xxhash64("__row", F.lit(1)).alias("b"))
    sums = [F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")]
    each = said.groupBy("token", "verdict").agg(F.count("*").alias("m"), *sums)
    each = each.groupBy("token").agg(F.sum("m").alias("n"), F.max(F.struct("m", "verdict")).alias("best"), *sums).filter(F.col("n") >= min_support * n)
    kinds = each.groupBy("n", "a", "b", "best").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    return kinds.select(F.col("tokens")[0].alias("item"), "tokens", "n", "best.verdict", F.col("best.m").alias("most"))


def mine_items(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Pruned rules (rule_id, items, size, verdict, confidence, support) over items, and the items, from rows of `tokens` and
    `verdict`. Counts cover all rows. FP-growth's trees are summed by item before they move, so hot tokens do not gather rows.
    """
    n = labelled.count()
    items = cut(items_of(labelled, n, min_support))
    pure = items.filter("most = n").select(F.array("item").alias("items"), F.lit(1).alias("size"), "verdict", F.lit(1.0).alias("confidence"), (F.col("n") / n).alias("support"))
    mixed = [r["item"] for r in items.filter("most < n").select("item").collect()]
    said = pure
    if mixed:
        own = F.array_intersect("tokens", F.array(*map(F.lit, mixed)))
        baskets = labelled.select(F.concat(own, F.array(F.concat(F.lit("verdict="), F.col("verdict")))).alias("items"))
        model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
        said = pure.unionByName(model.associationRules.filter(F.col("consequent")[0].startswith("verdict=")).select(
            F.array_sort("antecedent").alias("items"), F.size("antecedent").alias("size"),
            F.substring_index(F.col("consequent")[0], "=", -1).alias("verdict"), "confidence", "support",
        ))
    said = cut(said.withColumn("rule_id", F.xxhash64("items", "verdict")))
    one = said.select(F.col("rule_id").alias("small_id"), F.col("items").alias("small"), F.col("size").alias("n"), "verdict", F.col("confidence").alias("c"))
    # A smaller rule shares each of its items with the larger: found by item, not by pairs of rules.
    shared = said.withColumn("item", F.explode("items")).join(one.withColumn("item", F.explode("small")), ["item", "verdict"])
    covered = shared.filter((F.col("n") < F.col("size")) & (F.col("c") >= F.col("confidence"))).groupBy("rule_id", "small_id", "n").count()
    return said.join(covered.filter("count = n").select("rule_id").distinct(), "rule_id", "left_anti"), items


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """The pruned rules with every choice of one token for each of their items: a list to read, as `judge` needs items only."""
    rules, items = mine_items(labelled, min_support, min_confidence)
    told = rules.select("rule_id", F.explode("items").alias("item")).join(items.select("item", "tokens"), "item").groupBy("rule_id").agg(F.collect_list("tokens").alias("options"))
    one = F.array().cast("array<string>")
    choices = F.aggregate("options", F.array(one), lambda done, tokens: F.flatten(F.transform(done, lambda d: F.transform(tokens, lambda t: F.array_append(d, t)))))
    listed = rules.drop("items").join(told, "rule_id").withColumn("items", F.explode(choices)).withColumn("items", F.array_sort("items"))
    return listed.select(F.xxhash64("items", "verdict").alias("rule_id"), "items", "size", "verdict", "confidence", "support")


def judge(
    df: DataFrame, url: str = "url", key: str = "page_id", rules=RULES, default: str = DEFAULT,
    min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """`key`, host, path, rule (null without a fixed one), verdict, and the confidence of a mined rule (else null)."""
    host, path = host_and_path(F.col("__url"))
    rows = df.select(key, F.col(url).alias("__url")).withColumns({"host": host, "path": path})
    rule, verdict = fixed(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict})
    known = rows.filter(F.col("rule").isNotNull())
    out = [key, "host", "path", "rule"]
    labelled = known.select(tokens(F.col("__url"), F.col("host"), F.col("path")).alias("tokens"), "verdict")
    none = F.lit(None).cast("double").alias("confidence")
    told = known.select(*out, "verdict", none)
    rest = rows.filter(F.col("rule").isNull())
    if labelled.isEmpty():
        return told.unionByName(rest.select(*out, F.lit(default).alias("verdict"), none))
    mined, items = mine_items(labelled, min_support, min_confidence)
    index, names = mined.withColumn("item", F.explode("items")).drop("items"), items.select("item", F.explode("tokens").alias("token"))
    # Equal token sets are judged once.
    rest = rest.withColumn("__tokens", F.array_sort(tokens(F.col("__url"), F.col("host"), F.col("path"))))
    sets = rest.select("__tokens").groupBy("__tokens").agg(F.lit(1).alias("one"))
    held = sets.select("__tokens", F.explode("__tokens").alias("token")).join(names, "token").groupBy("__tokens", "item").agg(F.lit(1).alias("one"))
    hits = held.join(index, "item")
    full = hits.groupBy("__tokens", "rule_id", "size", "verdict", "confidence", "support").agg(F.count("*").alias("n")).filter("n = size")
    best = full.groupBy("__tokens").agg(F.max(F.struct("confidence", "support", "size", "verdict", "rule_id")).alias("best"))
    found = rest.join(best, "__tokens", "left")
    judged = found.select(*out, F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.col("best.confidence").alias("confidence"))
    return told.unionByName(judged)


def registered(spark, sf_dir: str) -> DataFrame:
    from lectern.session import table

    return judge(table(spark, sf_dir, "pages"))
