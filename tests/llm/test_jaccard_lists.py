"""Inverted lists of the Jaccard join: whoever shares some of them is a pair of one list only."""

from pyspark.sql import functions as F

from lectern.llm import jaccard_join


def test_pairs_stand_in_one_list_each(spark):
    crowd = list(range(1000, 1040))
    sets = [crowd[i % 5 :] + [i // 3] * (i % 3 > 0) for i in range(24)] + [list(range(i, i + 12)) for i in range(2000, 2030, 2)]
    full = spark.createDataFrame([(i, len(set(s)), sorted(set(s))) for i, s in enumerate(sets)], "node long, n int, hashes array<long>")
    keyed = jaccard_join._keyed(full, 75).cache()
    held = jaccard_join._lists(keyed).select("key", "node").join(jaccard_join._names(keyed), "node")
    one, two = held.withColumnRenamed("names", "own").alias("one"), held.select("key", F.col("node").alias("other"), F.col("names").alias("others")).alias("two")
    pairs = one.join(two, (F.col("one.key") == F.col("two.key")) & (F.col("node") < F.col("other")))
    every = {tuple(r) for r in pairs.select("node", "other").collect()}
    kept = [tuple(r) for r in pairs.filter(jaccard_join._first_shared(F.col("one.key"))).select("node", "other").collect()]
    assert pairs.count() > len(every) == len(kept) and set(kept) == every
