import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tantu.operators import orphans
from tests.conftest import rows

DAY = datetime(2024, 1, 1)
CHILD = "id long, key string, t timestamp, `__h` string, since string, held string"
PARENT = "key string, since timestamp, until timestamp, extra string"


def day(n):
    return None if n is None else DAY + timedelta(days=n)


def brute(children, parents):
    return {c[0] for c in children if not any(c[1] is not None and p[0] == c[1] and c[2] is not None and p[1] is not None and p[1] <= c[2] and (p[2] is None or p[2] > c[2]) for p in parents)}


def test_against_brute_force_with_nulls_ties_and_clashing_names(spark):
    rng = random.Random(1)
    some = lambda most: rng.choice([None, *range(most)])
    children = [(i, rng.choice([None, "a", "b", "c", "d", "e"]), day(some(9)), "x", "y", "z") for i in range(300)]
    parents = [(rng.choice([None, "a", "b", "c", "zz"]), day(some(9)), day(some(9)), "q") for _ in range(12)]
    found = orphans.orphans(spark.createDataFrame(children, CHILD), spark.createDataFrame(parents, PARENT), most=64)
    assert found.columns == ["id", "key", "t", "__h", "since", "held"]
    assert {r.id for r in found.collect()} == brute(children, parents)
    assert found.count() == len(brute(children, parents))


def test_a_crowded_filter_changes_nothing(spark):
    children = spark.range(5000).select("id", F.col("id").cast("string").alias("key"), F.lit(day(5)).cast("timestamp").alias("t"))
    parents = spark.range(0, 5000, 3).select(F.col("id").cast("string").alias("key"), F.lit(day(0)).cast("timestamp").alias("since"), F.lit(None).cast("timestamp").alias("until"))
    assert orphans.orphans(children, parents, most=4).count() == orphans.orphans(children, parents).count() == 5000 - 1667


def test_the_filter_proves_most_orphans(spark):
    parents = spark.range(1000).select(F.xxhash64("id").alias("h"))
    filter_words, n = orphans.bloom_words(parents, "h")
    assert n == 256 and filter_words.count() <= n and orphans.bloom_words(parents, "h", 16)[1] == 16
    known = orphans.might_contain(parents, F.col("h"), filter_words, n, "m")
    other = orphans.might_contain(spark.range(1000, 11_000).select(F.xxhash64("id").alias("h")), F.col("h"), filter_words, n, "m")
    assert known.where("m").count() == 1000
    assert other.where("m").count() < 500


def test_empty_tables(spark):
    children, parents = spark.createDataFrame([(1, "a", day(1), "", "", "")], CHILD), spark.createDataFrame([], PARENT)
    assert rows(orphans.orphans(children, parents).select("id")) == {(1,)}
    assert orphans.orphans(children.limit(0), parents).count() == 0


def test_report_counts_what_is_found(spark, small):
    from functools import partial

    from tantu.session import table

    t = partial(table, spark, small)
    found = orphans.orphan_references(t).collect()
    report = {(r.src, r.yyyymm): (r.orphans, r.rows) for r in orphans.orphan_report(t).collect()}
    assert sum(n for n, _ in report.values()) == len(found)
    assert {k for k in report} == {(r.src, r.yyyymm) for r in found}
