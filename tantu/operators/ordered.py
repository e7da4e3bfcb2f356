"""Order-preserving relational helpers: first match, ordered dedupe and merge, longest prefix.

Order is never taken from how rows happen to lie: every helper asks for the columns that define it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tantu.session import hinted, written


def _struct(columns: list[str]) -> Column:
    return F.struct(*columns)


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first in that order. Aggregated before and after the shuffle, nothing is sorted.

    Null keys are a key of their own; the order's nulls come first. Ties in the whole order are settled by the other
    columns, so that the result does not depend on the partitioning. Map columns can't be compared and are not allowed.
    """
    rest = [c for c in df.columns if c not in keys]
    tail = [c for c in rest if c not in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *tail)).alias("__first"))
    return best.select(*keys, "__first.*").select(*df.columns)


def first_match(candidates: DataFrame, table: DataFrame, ids: list[str], candidate: str, order: str, key: str) -> DataFrame:
    """For each row of candidates (ids, with its tries in order) the first try that ``table`` has.

    candidates: ids, ``candidate`` (a key to try), ``order``. table: unique ``key`` and payload. Rows without any hit are
    left out; join them back for a left result.
    """
    hits = candidates.join(table.withColumnRenamed(key, candidate), candidate)
    return first_by(hits, ids, [order])


def tries(df: DataFrame, keys: Column, order: str = "try_no", name: str = "try_key") -> DataFrame:
    """One row for each candidate key of an array column, numbered from 0."""
    return df.select("*", F.posexplode(keys).alias(order, name))


def longest_prefix(df: DataFrame, table: DataFrame, ids: list[str], text: str, key: str, least: int, proper: bool = True) -> DataFrame:
    """The longest beginning of ``text`` (at least ``least`` characters, by default not all of it) that ``table`` has as key.

    Beginnings are exploded and joined by equality, so the join hashes instead of comparing everything with everything; a
    left semi join keeps the table's payload out of the shuffle until the best is known. Texts without a hit are left out.
    """
    top = F.length(text) - (1 if proper else 0)
    lengths = F.when(top >= least, F.sequence(F.lit(least), top))
    begun = df.where(F.length(text) >= least).select(*ids, text, F.explode(lengths).alias("__n"))
    begun = begun.withColumn("__p", F.substring(F.col(text), F.lit(1), F.col("__n")))
    known = table.select(F.col(key).alias("__p")).distinct()
    best = begun.join(known, "__p", "left_semi").groupBy(*ids).agg(F.max("__n").alias("prefix_len"), F.max_by("__p", "__n").alias("prefix"))
    return best


def suffix_trim(df: DataFrame, table: DataFrame, ids: list[str], text: str, key: str, cuts: tuple[int, ...] = (1, 2), least: int = 3) -> DataFrame:
    """ids, stem, cut: the text without its last characters, by the smallest cut whose rest ``table`` has as key."""
    cut = df.select(*ids, text, F.explode(F.array(*[F.lit(c) for c in cuts])).alias("cut"))
    cut = cut.withColumn("stem", F.substring(F.col(text), F.lit(1), F.length(text) - F.col("cut"))).where(F.length(text) - F.col("cut") >= least)
    known = table.select(F.col(key).alias("stem")).distinct()
    return first_by(cut.join(known, "stem", "left_semi").select(*ids, "cut", "stem"), ids, ["cut"])


def ordered_dedupe(df: DataFrame, keys: list[str], identity: list[str], order: list[str], richer: Column | None = None) -> DataFrame:
    """Rows of each key without repeats of ``identity``; the first stays, in the place of the first.

    With ``richer`` a later twin for which it holds takes the place of a first one for which it does not. Adds ``place``
    (struct of the order columns at which the identity was first seen).
    """
    rest = [c for c in df.columns if c not in keys + identity]
    pick = F.struct(*([(~richer).alias("__poorer")] if richer is not None else []), *order, *[c for c in rest if c not in order])
    out = df.groupBy(*keys, *identity).agg(F.min(F.struct(*order)).alias("place"), F.min(pick).alias("__row"))
    names = [c for c in df.columns if c in rest]
    return out.select(*keys, *identity, "place", *[F.col(f"__row.{c}").alias(c) for c in names])


def ordered_merge(existing: DataFrame, new: DataFrame, keys: list[str], identity: list[str], order: list[str]) -> DataFrame:
    """Existing entries of each key, then the new ones that it does not have yet, in their order.

    Adds ``ord`` (0 is the first of its key) and ``is_new``. Merging the result with the same new entries again changes
    nothing: what is there already is never added.
    """
    both = existing.withColumn("__src", F.lit(0)).unionByName(new.withColumn("__src", F.lit(1)), allowMissingColumns=True)
    once = ordered_dedupe(both, keys, identity, ["__src", *order])
    by_place = Window.partitionBy(*keys).orderBy("place")
    return once.withColumn("ord", F.row_number().over(by_place) - 1).withColumn("is_new", F.col("place.__src") == 1).drop("place", "__src")


def merge_stats(merged: DataFrame, new: DataFrame, keys: list[str], origin: str) -> DataFrame:
    """By origin: entries delivered, entries added, keys that did not exist before and came first from this origin."""
    fresh = merged.groupBy(*keys).agg(F.bool_and("is_new").alias("fresh"), F.min_by(origin, "ord").alias("first_origin"))
    added = merged.where("is_new").groupBy(F.col(origin).alias("origin")).agg(F.count("*").alias("added"))
    keys_added = fresh.where("fresh").groupBy(F.col("first_origin").alias("origin")).agg(F.count("*").alias("new_keys"))
    seen = new.groupBy(F.col(origin).alias("origin")).agg(F.count("*").alias("entries"))
    filled = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return seen.join(added, "origin", "left").join(keys_added, "origin", "left").select("origin", "entries", filled("added"), filled("new_keys"))


def ranked_overall(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """All rows numbered from 1 in one order: ranges of it are numbered apart, each from where the range before ends.

    No task sees more than its range. Rows alike in all of ``order`` come in any order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = written(df.sparkSession, df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranges.withColumn("__at", within).join(hinted(starts, parts), "__range").withColumn(name, F.col("__start") + F.col("__at")).drop("__range", "__at", "__start")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "ord") -> DataFrame:
    """Rows of each key numbered from 0."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
