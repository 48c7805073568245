"""Event-log queries: `click` stands for a submitted request, `purchase` for a completed one, per user."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.operators import sequences as seq
from lectern.operators.evaluation import count_where
from lectern.plans.evaluation_queries import numbered
from lectern.plans.registry import register
from lectern.session import table


def events(spark, d):
    """The events with their time in whole microseconds."""
    return table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


E = "e AS (SELECT *, epoch_us(ts) AS us FROM events)"
W_USER = "OVER (PARTITION BY user_id ORDER BY us, event_id"
FLIGHT = f"{E}, f AS (SELECT *, sum(CASE WHEN event_type = 'click' THEN 1 ELSE -1 END) {W_USER} ROWS UNBOUNDED PRECEDING) AS inflight FROM e WHERE event_type IN ('click', 'purchase'))"


def flight(spark, d):
    some = events(spark, d).filter(F.col("event_type").isin("click", "purchase"))
    return seq.in_flight(some.withColumn("change", F.when(F.col("event_type") == "click", 1).otherwise(-1)), "user_id", "us", "change", "event_id")


def by_user():
    return W.partitionBy("user_id").orderBy("us", "event_id")


@register("inflight_peak", f"WITH {FLIGHT} SELECT user_id, max(inflight) AS peak, min(inflight) AS low, count(*) AS n FROM f GROUP BY user_id")
def inflight_peak(spark, d):
    return flight(spark, d).groupBy("user_id").agg(F.max("inflight").alias("peak"), F.min("inflight").alias("low"), F.count("*").alias("n"))


@register("occupancy_hist", f"WITH {FLIGHT} SELECT inflight, count(*) AS n FROM f WHERE event_type = 'click' GROUP BY inflight")
def occupancy_hist(spark, d):
    return flight(spark, d).filter("event_type = 'click'").groupBy("inflight").agg(F.count("*").alias("n"))


_SPANS = f"{E}, s AS (SELECT user_id, event_id, event_type, us AS lo, lead(us) {W_USER}) AS hi FROM e), sp AS (SELECT * FROM s WHERE hi IS NOT NULL AND event_type IN ('click', 'view'))"


def spans(spark, d):
    """Each event lasts until the user's next one."""
    s = events(spark, d).withColumn("hi", F.lead("us").over(by_user()))
    return s.filter(F.col("hi").isNotNull() & F.col("event_type").isin("click", "view")).select("user_id", "event_id", "event_type", F.col("us").alias("lo"), "hi")


@register(
    "sweep_overlap",
    f"""WITH {_SPANS}, day AS (SELECT *, lo // 86400000000 AS day FROM sp), pts AS (SELECT day, lo AS t, CAST(event_type = 'click' AS INT) AS dp, CAST(event_type = 'view' AS INT) AS dd FROM day
    UNION ALL SELECT day, hi, -CAST(event_type = 'click' AS INT), -CAST(event_type = 'view' AS INT) FROM day),
    g AS (SELECT day, t, sum(dp) AS dp, sum(dd) AS dd FROM pts GROUP BY day, t),
    r AS (SELECT day, sum(dp) OVER w AS p, sum(dd) OVER w AS q, lead(t) OVER (PARTITION BY day ORDER BY t) - t AS len FROM g WINDOW w AS (PARTITION BY day ORDER BY t ROWS UNBOUNDED PRECEDING))
    SELECT day, coalesce(sum(len) FILTER (p > 0 AND q = 0), 0) AS first_only, coalesce(sum(len) FILTER (p = 0 AND q > 0), 0) AS second_only, coalesce(sum(len) FILTER (p > 0 AND q > 0), 0) AS overlap FROM r GROUP BY day""",
)
def sweep_overlap(spark, d):
    """Sweep line: how long only clicks, only views, or both are open, by the day they begin. Equal times are summed first."""
    s = spans(spark, d).withColumns({"day": F.floor(F.col("lo") / 86_400_000_000), "p": (F.col("event_type") == "click").cast("int"), "q": (F.col("event_type") == "view").cast("int")})
    points = s.select("day", F.col("lo").alias("t"), "p", "q").unionByName(s.select("day", F.col("hi").alias("t"), (-F.col("p")).alias("p"), (-F.col("q")).alias("q")))
    sums = points.groupBy("day", "t").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    w = W.partitionBy("day").orderBy("t")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    r = sums.select("day", F.sum("p").over(run).alias("p"), F.sum("q").over(run).alias("q"), (F.lead("t").over(w) - F.col("t")).alias("len"))
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("len"))), F.lit(0))
    p, q = F.col("p"), F.col("q")
    return r.groupBy("day").agg(part((p > 0) & (q == 0)).alias("first_only"), part((p == 0) & (q > 0)).alias("second_only"), part((p > 0) & (q > 0)).alias("overlap"))


@register(
    "time_weighted_mean",
    f"WITH {E}, x AS (SELECT user_id, value, lead(us) {W_USER}) - us AS len FROM e) SELECT user_id, round(sum(value * len) / nullif(sum(len), 0), 6) AS weighted, round(sum(len) FILTER (value < 10) / CAST(nullif(sum(len), 0) AS DOUBLE), 6) AS idle FROM x WHERE len IS NOT NULL GROUP BY user_id",
)
def time_weighted_mean(spark, d):
    x = events(spark, d).select("user_id", "value", (F.lead("us").over(by_user()) - F.col("us")).alias("len")).filter("len IS NOT NULL")
    return x.groupBy("user_id").agg(
        F.round(F.try_divide(F.sum(F.col("value") * F.col("len")), F.sum("len").cast("double")), 6).alias("weighted"),
        F.round(F.try_divide(F.sum(F.when(F.col("value") < 10, F.col("len"))).cast("double"), F.sum("len").cast("double")), 6).alias("idle"))


@register(
    "interval_overlap_join",
    f"WITH {_SPANS} SELECT a.user_id AS user_id, count(*) AS pairs, sum(least(a.hi, b.lo + 3600000000) - greatest(a.lo, b.lo)) AS overlap FROM sp a JOIN sp b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' AND a.lo < b.lo + 3600000000 AND b.lo < a.hi GROUP BY 1",
)
def interval_overlap_join(spark, d):
    """Range join of clicks with the hour after each view of the same user. A view meets, by the hour it begins in, only
    the clicks that are open within the hour before or then, so a busy user's pairs are dealt over hours."""
    hour = 3_600_000_000
    s = spans(spark, d)
    a = s.filter("event_type = 'click'").select("user_id", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / hour) - 1, F.floor(F.col("hi") / hour))).alias("at"))
    b = s.filter("event_type = 'view'").select("user_id", F.col("lo").alias("blo"), (F.col("lo") + hour).alias("bhi"), F.floor(F.col("lo") / hour).alias("at"))
    both = a.join(b, ["user_id", "at"]).filter((F.col("lo") < F.col("bhi")) & (F.col("blo") < F.col("hi")))
    return both.groupBy("user_id").agg(F.count("*").alias("pairs"), F.sum(F.least("hi", "bhi") - F.greatest("lo", "blo")).alias("overlap"))


@register(
    "seed_dependency",
    f"WITH {E}, s AS (SELECT user_id, min(us) FILTER (event_type = 'purchase') AS seed FROM e GROUP BY user_id) SELECT user_id, count(*) AS early FROM e JOIN s USING (user_id) WHERE event_type = 'click' AND us < seed GROUP BY user_id",
)
def seed_dependency(spark, d):
    """Followers that began before their seed completed."""
    x = events(spark, d).withColumn("seed", F.min(F.when(F.col("event_type") == "purchase", F.col("us"))).over(W.partitionBy("user_id")))
    return x.filter((F.col("event_type") == "click") & (F.col("us") < F.col("seed"))).groupBy("user_id").agg(F.count("*").alias("early"))


@register("emit_on_change", f"WITH {E}, x AS (SELECT user_id, event_id, event_type, lag(event_type) {W_USER}) AS before FROM e) SELECT user_id, event_id, event_type FROM x WHERE event_type IS DISTINCT FROM before")
def emit_on_change(spark, d):
    x = events(spark, d).withColumn("before", F.lag("event_type").over(by_user()))
    return x.filter(~F.col("event_type").eqNullSafe(F.col("before"))).select("user_id", "event_id", "event_type")


@register("monotonic", f"WITH {E}, x AS (SELECT user_id, us, lag(us) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM e) SELECT user_id, count(*) FILTER (us < before) AS backward, count(*) AS n FROM x GROUP BY user_id")
def monotonic(spark, d):
    x = events(spark, d).withColumn("before", F.lag("us").over(W.partitionBy("user_id").orderBy("event_id")))
    return x.groupBy("user_id").agg(count_where(F.col("us") < F.col("before")).alias("backward"), F.count("*").alias("n"))


@register(
    "nth_event",
    f"WITH {E}, r AS (SELECT user_id, event_type, us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) AS k FROM e), n AS (SELECT user_id, max(us) FILTER (event_type = 'click' AND k = 5) AS fifth, max(us) FILTER (event_type = 'purchase' AND k = 1) AS done FROM r GROUP BY user_id) SELECT user_id, fifth, done, fifth > done AS after_first_done FROM n WHERE fifth IS NOT NULL AND done IS NOT NULL",
)
def nth_event(spark, d):
    r = events(spark, d).withColumn("k", F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("us", "event_id"))).filter("k <= 5")
    n = r.groupBy("user_id").agg(F.max(F.when(F.expr("event_type = 'click' AND k = 5"), F.col("us"))).alias("fifth"), F.max(F.when(F.expr("event_type = 'purchase' AND k = 1"), F.col("us"))).alias("done"))
    return n.filter("fifth IS NOT NULL AND done IS NOT NULL").withColumn("after_first_done", F.col("fifth") > F.col("done"))


_ORDERED = "o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS rn, count(*) OVER () AS n FROM orders)"


@register("stratified_midpoints", f"WITH {_ORDERED} SELECT o_orderkey, o_totalprice FROM o WHERE rn IN (SELECT CAST(floor((i.range + 0.5) * n / 32) AS BIGINT) FROM range(32) i, (SELECT max(n) AS n FROM o))")
def stratified_midpoints(spark, d, strata: int = 32):
    """The middle row of each of 32 strata of equal frequency (a sample of fixed size is what is asked for)."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    n = o.count()
    picks = [int((i + 0.5) * n / strata) for i in range(strata)]
    return numbered(o, "o_totalprice", "o_orderkey").filter(F.col("rn").isin(picks)).drop("rn")


@register("order_stat_sample", f"WITH {_ORDERED} SELECT o_orderkey, o_totalprice FROM o WHERE rn IN (SELECT CAST(round_even(i.range * (n - 1) / 15.0, 0) AS BIGINT) FROM range(16) i, (SELECT max(n) AS n FROM o))")
def order_stat_sample(spark, d, size: int = 16):
    """Evenly spaced order statistics; halves are rounded to even."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    n = o.count()
    return numbered(o, "o_totalprice", "o_orderkey").filter(F.col("rn").isin(sorted({round(i * (n - 1) / (size - 1)) for i in range(size)}))).drop("rn")


@register("bucket8", "WITH d AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS rn FROM documents) SELECT rn // 8 AS bucket, count(*) AS n, min(n_chars) AS lo, max(n_chars) AS hi, round(avg(n_chars), 6) AS mean FROM d GROUP BY 1")
def bucket8(spark, d):
    """Runs of eight documents of like length."""
    x = numbered(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id")
    return x.groupBy(F.floor(F.col("rn") / 8).alias("bucket")).agg(F.count("*").alias("n"), F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"), F.round(F.avg("n_chars"), 6).alias("mean"))


@register("alternating_order", "WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents) SELECT doc_id, rn, CASE WHEN (rn // 2) % 2 = 0 THEN 'ab' ELSE 'ba' END AS turn FROM d")
def alternating_order(spark, d):
    x = numbered(table(spark, d, "documents").select("doc_id"), "doc_id")
    return x.select("doc_id", "rn", F.when(F.pmod(F.floor(F.col("rn") / 2), F.lit(2)) == 0, "ab").otherwise("ba").alias("turn"))


@register(
    "latency_percentiles",
    "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS lo, max(value) AS hi, round(sum(value), 4) AS total, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type",
)
def latency_percentiles(spark, d):
    """Distribution with linear interpolation between ranks."""
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))
    x = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.sum("value"), 4).alias("total"), p.alias("p"))
    return x.select("event_type", "n", "mean", "lo", "hi", "total", *(F.round(F.col("p")[i], 6).alias(c) for i, c in enumerate(("p50", "p90", "p95"))))


@register(
    "nearest_index_percentiles",
    "WITH x AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1 AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT lang, max(n) AS n, max(n_chars) FILTER (rn = least(n - 1, CAST(floor(n * 0.5) AS BIGINT))) AS p50, max(n_chars) FILTER (rn = least(n - 1, CAST(floor(n * 0.9) AS BIGINT))) AS p90, max(n_chars) AS hi FROM x GROUP BY lang",
)
def nearest_index_percentiles(spark, d):
    """sorted[min(n - 1, int(n p))]: not the interpolating percentile."""
    counts = table(spark, d, "documents").groupBy("lang", "n_chars").agg(F.count("*").alias("c"))
    w = W.partitionBy("lang")
    run = counts.withColumns({"end": F.sum("c").over(w.orderBy("n_chars")), "n": F.sum("c").over(w)})
    at = lambda p: F.min(F.when(F.col("end") > F.least(F.col("n") - 1, F.floor(F.col("n") * p)), F.col("n_chars")))
    return run.groupBy("lang").agg(F.max("n").alias("n"), at(0.5).alias("p50"), at(0.9).alias("p90"), F.max("n_chars").alias("hi"))


@register("histogram2k", "SELECT (n_chars // 2000) * 2000 AS lo, count(*) AS n FROM documents GROUP BY 1")
def histogram2k(spark, d):
    return table(spark, d, "documents").groupBy((F.floor(F.col("n_chars") / 2000) * 2000).alias("lo")).agg(F.count("*").alias("n"))


@register("thresholds", "SELECT t AS threshold, count(*) FILTER (n_chars > t) AS over, round(100.0 * count(*) FILTER (n_chars > t) / count(*), 6) AS pct FROM documents, (VALUES (500), (2000), (8000), (16000)) v(t) GROUP BY t")
def thresholds(spark, d):
    """Exceedance counts: all thresholds in one pass, not a row per document and threshold."""
    limits = [500, 2000, 8000, 16000]
    one = table(spark, d, "documents").agg(F.count("*").alias("n"), *(count_where(F.col("n_chars") > t).alias(f"t{t}") for t in limits))
    cells = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("over")) for t in limits)))
    return one.select("n", cells.alias("c")).select("c.threshold", "c.over", F.round(F.try_divide(F.col("c.over") * F.lit(100.0), F.col("n")), 6).alias("pct"))


@register("token_ratio", "SELECT role, sum(length(text)) AS total, sum(length(text)) FILTER (turn > 0) AS cached, round(sum(length(text)) FILTER (turn > 0) / CAST(nullif(sum(length(text)), 0) AS DOUBLE), 6) AS fraction FROM conversations GROUP BY role")
def token_ratio(spark, d):
    """A ratio of sums, never a mean of ratios."""
    n, late = F.sum(F.length("text")), F.sum(F.when(F.col("turn") > 0, F.length("text")))
    return table(spark, d, "conversations").groupBy("role").agg(n.alias("total"), late.alias("cached"), F.round(F.try_divide(late.cast("double"), n.cast("double")), 6).alias("fraction"))


@register("phase_rollup", "SELECT l_returnflag AS phase, l_linestatus AS size, count(*) AS calls, round(sum(l_extendedprice), 2) AS amount, round(sum(l_discount * l_extendedprice) / nullif(sum(l_extendedprice), 0), 6) AS fraction FROM lineitem GROUP BY 1, 2")
def phase_rollup(spark, d):
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("phase"), F.col("l_linestatus").alias("size")).agg(
        F.count("*").alias("calls"), F.round(F.sum(price).cast("double"), 2).alias("amount"), F.round(F.try_divide(F.sum(F.col("l_discount") * F.col("l_extendedprice")), F.sum("l_extendedprice")), 6).alias("fraction"))


@register("value_counts", "SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) AS place FROM events GROUP BY event_type")
def value_counts(spark, d):
    """Values by how often they occur, numbered through range partitions."""
    from lectern.plans.evaluation_queries import numbered

    c = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("down", -F.col("n"))
    return numbered(c, "down", "event_type", name="place").select("event_type", "n", (F.col("place") + 1).alias("place"))


@register("length_bins", "SELECT CASE WHEN n_chars <= 1000 THEN 'short' WHEN n_chars <= 4000 THEN 'medium' ELSE 'long' END AS bin, count(*) AS n, round(avg(n_chars), 6) AS mean FROM documents GROUP BY 1")
def length_bins(spark, d):
    b = F.when(F.col("n_chars") <= 1000, "short").when(F.col("n_chars") <= 4000, "medium").otherwise("long")
    return table(spark, d, "documents").groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"))


@register(
    "submit_complete",
    f"WITH {E}, r AS (SELECT user_id, event_type, us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) AS k FROM e WHERE event_type IN ('click', 'purchase')), p AS (SELECT user_id, k, max(us) FILTER (event_type = 'click') AS s, max(us) FILTER (event_type = 'purchase') AS c FROM r GROUP BY user_id, k) SELECT user_id, count(*) FILTER (s IS NOT NULL AND c IS NOT NULL) AS matched, count(*) FILTER (c IS NULL) AS open, count(*) FILTER (s IS NULL) AS unknown, sum(c - s) AS latency FROM p GROUP BY user_id",
)
def submit_complete(spark, d):
    """The k-th submission beside the k-th completion, by a conditional aggregate instead of a self-join."""
    r = events(spark, d).filter(F.col("event_type").isin("click", "purchase")).withColumn("k", F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("us", "event_id")))
    p = r.groupBy("user_id", "k").agg(F.max(F.when(F.col("event_type") == "click", F.col("us"))).alias("s"), F.max(F.when(F.col("event_type") == "purchase", F.col("us"))).alias("c"))
    return p.groupBy("user_id").agg(count_where(F.col("s").isNotNull() & F.col("c").isNotNull()).alias("matched"), count_where(F.col("c").isNull()).alias("open"), count_where(F.col("s").isNull()).alias("unknown"), F.sum(F.col("c") - F.col("s")).alias("latency"))


@register(
    "accounting_identity",
    "WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT o_orderstatus AS status, count(*) AS orders, count(l.n) AS with_lines, sum(coalesce(l.n, 0)) AS lines, (SELECT count(*) FROM lineitem) AS all_lines FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY 1",
)
def accounting_identity(spark, d):
    """The same total from two sides."""
    lines = table(spark, d, "lineitem")
    per = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    x = table(spark, d, "orders").join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("orders"), F.count("n").alias("with_lines"), F.sum(F.coalesce("n", F.lit(0))).alias("lines"))
    return x.crossJoin(F.broadcast(lines.agg(F.count("*").alias("all_lines"))))  # one row


@register("shape_inventory", "SELECT array_to_string(list_sort(json_keys(props)), ',') AS shape, json_type(props, '$.k') AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def shape_inventory(spark, d):
    """Structural signature of JSON values."""
    v = F.try_parse_json("props")
    kind = F.when(F.schema_of_variant(F.try_variant_get(v, "$.k", "variant")) == "BIGINT", F.when(F.try_variant_get(v, "$.k", "bigint") >= 0, "UBIGINT").otherwise("BIGINT")).otherwise(F.schema_of_variant(F.try_variant_get(v, "$.k", "variant")))
    return table(spark, d, "events").groupBy(F.array_join(F.array_sort(F.json_object_keys("props")), ",").alias("shape"), kind.alias("kind")).agg(F.count("*").alias("n"))


@register("first_three_examples", "WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events) SELECT event_type, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM r WHERE k <= 3 GROUP BY event_type")
def first_three_examples(spark, d):
    r = table(spark, d, "events").withColumn("k", F.row_number().over(W.partitionBy("event_type").orderBy("event_id"))).filter("k <= 3")
    return r.groupBy("event_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("ids"))


_MAPS = "x AS (SELECT l_orderkey, l_linenumber AS k, l_quantity AS q, l_extendedprice AS p FROM lineitem), a AS (SELECT * FROM x WHERE l_orderkey % 2 = 0), b AS (SELECT l_orderkey - 1 AS l_orderkey, k, q, p FROM x WHERE l_orderkey % 2 = 1)"


@register("map_difference", f"WITH {_MAPS} SELECT coalesce(a.l_orderkey, b.l_orderkey) AS pair, count(*) FILTER (a.q IS DISTINCT FROM b.q) AS changed, count(*) FILTER (a.q IS NOT DISTINCT FROM b.q) AS same, max(abs(a.q - b.q)) AS largest FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.k = b.k GROUP BY 1")
def map_difference(spark, d):
    """Changed and equal keys of two maps, and the greatest difference over shared keys (NULL if disjoint)."""
    x = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("k"), F.col("l_quantity").alias("q"))
    a, b = x.filter("l_orderkey % 2 = 0"), x.filter("l_orderkey % 2 = 1").select((F.col("l_orderkey") - 1).alias("l_orderkey"), "k", F.col("q").alias("q2"))
    j = a.join(b, ["l_orderkey", "k"], "full_outer")
    same = F.col("q").eqNullSafe(F.col("q2"))
    return j.groupBy(F.col("l_orderkey").alias("pair")).agg(count_where(~same).alias("changed"), count_where(same).alias("same"), F.max(F.abs(F.col("q") - F.col("q2"))).alias("largest"))


@register("repeatability", "WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, o_orderpriority AS p FROM orders) SELECT a.o_custkey AS o_custkey, a.p = b.p AS repeated FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.k = 1 AND b.k = 2")
def repeatability(spark, d):
    o = table(spark, d, "orders").withColumn("k", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))).filter("k <= 2")
    x = o.groupBy("o_custkey").agg(F.max(F.when(F.col("k") == 1, F.col("o_orderpriority"))).alias("a"), F.max(F.when(F.col("k") == 2, F.col("o_orderpriority"))).alias("b"))
    return x.filter("b IS NOT NULL").select("o_custkey", (F.col("a") == F.col("b")).alias("repeated"))


@register("last_follower", f"WITH {E} SELECT user_id, max(us) FILTER (event_type = 'view') AS last_view, max_by(event_id, (us, event_id)) AS last_event FROM e GROUP BY user_id")
def last_follower(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "view", F.col("us"))).alias("last_view"), F.max_by("event_id", F.struct("us", "event_id")).alias("last_event"))


@register("tumbling_windows", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, d):
    """Event-time windows of an hour; `streaming.windows` runs the same plan over a stream with a watermark."""
    from lectern.streaming.windows import hourly

    return hourly(table(spark, d, "events"))


@register("session_windows", f"WITH {E}, x AS (SELECT user_id, us, value, CASE WHEN us - lag(us) {W_USER}) < 1800000000 THEN 0 ELSE 1 END AS fresh, event_id FROM e), s AS (SELECT *, sum(fresh) {W_USER} ROWS UNBOUNDED PRECEDING) AS session FROM x) SELECT user_id, min(us) AS first_us, count(*) AS n FROM s GROUP BY user_id, session")
def session_windows(spark, d):
    """Sessions that end after half an hour without an event."""
    return events(spark, d).groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.min("us").alias("first_us"), F.count("*").alias("n")).drop("session_window")


@register("admission_simulation", f"WITH {FLIGHT} SELECT user_id, event_id, inflight > 3 AS blocked FROM f WHERE event_type = 'click' AND inflight >= 3")
def admission_simulation(spark, d):
    """Which submissions a bound of three live requests would hold back."""
    return flight(spark, d).filter("event_type = 'click' AND inflight >= 3").select("user_id", "event_id", (F.col("inflight") > 3).alias("blocked"))


@register("record_complete", "SELECT l_orderkey, count(*) AS n, count(*) = max(l_linenumber) AS complete FROM lineitem GROUP BY l_orderkey")
def record_complete(spark, d):
    """Records all of whose parts have arrived."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), (F.count("*") == F.max("l_linenumber")).alias("complete"))
