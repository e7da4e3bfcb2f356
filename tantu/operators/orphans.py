"""References whose target is not there at the referring row's time.

A Bloom filter of all parent keys proves most orphans at once; only what the filter lets pass is verified by an exact
join on key and interval. The filter is a table of words of 64 bits: all bits of a key lie in one word, so a test is one
lookup in a broadcast table of checked size. Children are read once: those that the filter disproves go through the join
under a key that no parent has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tantu.session import written

BITS_A_KEY = 16  # of the filter, rounded up to a power of two
MOST_WORDS = 1 << 20  # of the filter (8 MB): beyond some 4 million keys it fills up, and more is left to the exact join
HASHES = 4


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(words)).cast("int")


def _mask(key: Column) -> Column:
    """HASHES bits of 64, taken from one more hash, six bits of it each."""
    h = F.xxhash64(key, F.lit(1))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    out = bit(0)
    for i in range(1, HASHES):
        out = out.bitwiseOR(bit(i))
    return out


def bloom_words(parents: DataFrame, key: str, most: int = MOST_WORDS) -> tuple[DataFrame, int]:
    """(word, bits) of the filter of column ``key``, and how many words it may have: BITS_A_KEY a key, ``most`` at most.

    Bits are joined by bit_or before and after the shuffle, so no more rows move than the filter has words.
    """
    held = parents.where(F.col(key).isNotNull())
    n = held.agg(F.approx_count_distinct(key)).first()[0]
    words = min(most, 1 << max(4, (n * BITS_A_KEY // 64).bit_length()))
    return held.groupBy(_word(F.col(key), words).alias("word")).agg(F.bit_or(_mask(F.col(key))).alias("bits")), words


def might_contain(children: DataFrame, key: Column, filter_words: DataFrame, words: int, name: str) -> DataFrame:
    """children with the column ``name``: false only if no parent has that key (or the key is null)."""
    held = F.broadcast(filter_words.select(F.col("word").alias("__word"), F.col("bits").alias("__bits")))  # ``words`` rows at most
    hit = F.coalesce(F.col("__bits").bitwiseAND(F.col("__mask")) == F.col("__mask"), F.lit(False)) & key.isNotNull()
    tested = children.withColumns({"__at": _word(key, words), "__mask": _mask(key)}).join(held, F.col("__at") == F.col("__word"), "left")
    return tested.withColumn(name, hit).drop("__at", "__mask", "__word", "__bits")


def orphans(children: DataFrame, parents: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """The rows of ``children`` whose target is not there at their time.

    children: any columns, with ``key`` (struct or scalar, the reference) and ``t``. parents: ``key``, ``since``, ``until``
    (null: still there). A parent is there at t if since <= t and (until is null or until > t); several rows of a key are
    joined by or. A child with a null key part never finds a target; a null t finds none either, as nothing is known to be
    there at that time. Rows are neither merged nor dropped: repeated children come out as often as they came in.
    """
    own = [F.col(f"`{c}`") for c in children.columns]
    boxed = children.select(F.struct(*own).alias("row"), F.col("key").alias("k"), F.xxhash64("key").alias("h"), F.col("t").alias("at"))  # no name can clash
    held = parents.select(F.col("key").alias("held"), F.xxhash64("key").alias("hh"), "since", "until")
    filter_words, words = bloom_words(held, "hh", most)
    filter_words = written(children.sparkSession, filter_words, "bloom")
    tested = might_contain(boxed, F.col("h"), filter_words, words, "maybe")
    # a disproved child is spread by a hash of its own and meets no parent: parents are of spread 0
    spread = F.when(F.col("maybe"), F.lit(0).cast("bigint")).otherwise(F.xxhash64("k", "at").bitwiseOR(F.lit(1)))
    there = (F.col("k") == F.col("held")) & (F.col("spread") == F.col("of")) & (F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("until") > F.col("at")))
    return tested.withColumn("spread", spread).join(held.withColumn("of", F.lit(0).cast("bigint")), there, "left_anti").select("row.*")


def unit_references(spark_tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(references to units, units, references to works, works) of the corpus tables, in the shape ``orphans`` takes."""
    trans, occ, groups, units, works = (spark_tables(n) for n in ("trans_files", "occ_index", "parse_groups", "work_units", "works"))

    def refs(df: DataFrame, src: str, row: str, ref: Column, t: str) -> DataFrame:
        return df.select(F.lit(src).alias("src"), F.col(row).alias("row_id"), F.col("work_id"), ref.alias("ref"), F.col(t).alias("t"))

    to_units = (
        refs(trans, "trans_files", "file_id", F.explode("units.ref"), "loaded_at")
        .union(refs(occ, "occ_index", "shard_id", F.explode(F.map_keys("refs")), "loaded_at"))
        .union(refs(groups, "parse_groups", "group_id", F.col("ref"), "seen_at"))
        .where("ref is not null")
        .withColumn("key", F.concat_ws("\x1f", F.coalesce("work_id", F.lit("\x00")), "ref"))
    )
    held_units = units.where("work_id is not null and ref is not null").select(F.concat_ws("\x1f", "work_id", "ref").alias("key"), F.col("ingested_at").alias("since"), F.col("deleted_at").alias("until"))
    to_works = refs(units, "work_units", "unit_id", F.col("ref"), "ingested_at").where("ref is not null").withColumn("key", F.coalesce("work_id", F.lit("\x00")))
    held_works = works.where("work_id is not null").select(F.col("work_id").alias("key"), F.col("added_at").alias("since"), F.col("removed_at").alias("until"))
    return to_units, held_units, to_works, held_works


def orphan_references(spark_tables, most: int = MOST_WORDS) -> DataFrame:
    """(src, yyyymm, row_id, ref): every reference of the corpus tables whose target is not there at its time; distinct."""
    to_units, units, to_works, works = unit_references(spark_tables)
    found = orphans(to_units, units, most).union(orphans(to_works, works, most))
    return found.select("src", F.date_format("t", "yyyy-MM").alias("yyyymm"), "row_id", "ref").distinct()


def orphan_report(spark_tables, most: int = MOST_WORDS) -> DataFrame:
    """Orphans per table and month: src, yyyymm, orphans (distinct rows and refs), rows (with at least one)."""
    return orphan_references(spark_tables, most).groupBy("src", "yyyymm").agg(F.count("*").alias("orphans"), F.countDistinct("row_id").alias("rows"))
