"""Building morphology and editions: analysis rows to shards, fallback tiers, occurrence editions and their reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tantu.functions.feats import contextual_parse, mark_inferred, parse_analysis
from tantu.functions.keys import initial_slice, row_keys
from tantu.functions.translit import iast_to_dev, slp1_to_iast
from tantu.operators.lookup import fallback_stems
from tantu.operators.ordered import ordered_dedupe
from tantu.session import spread


def analysis_entries(rows: DataFrame) -> DataFrame:
    """(key, l, p, f, row_id, pos): analyses of each row under each of its keys; rows without either are left out."""
    keyed = spread(rows.select("row_id", "morph_analysis", "sandhied_word", "word", "morph_in_context"), "row_id").select("row_id", parse_analysis(F.col("morph_analysis")).alias("a"), row_keys(F.col("sandhied_word"), F.col("word"), F.col("morph_in_context")).alias("k"))
    return keyed.select("row_id", F.explode("k").alias("key"), "a").select("row_id", "key", F.posexplode("a").alias("pos", "e")).select("key", "e.l", "e.p", "e.f", "row_id", "pos")


def morph_shards(entries: DataFrame) -> DataFrame:
    """(letter, key, ord, l, p, f): the distinct analyses of each key in order; keys that begin with no letter drop out."""
    once = ordered_dedupe(entries, ["key"], ["l", "p", "f"], ["row_id", "pos"])
    ranked = once.withColumn("ord", F.row_number().over(Window.partitionBy("key").orderBy("place")) - 1)
    return ranked.where(F.col("key").rlike("^[a-z]")).select(F.substring("key", 1, 1).alias("letter"), "key", "ord", "l", "p", "f")


def with_fallbacks(shards: DataFrame, wanted: DataFrame, headword_keys: DataFrame) -> DataFrame:
    """Shards and, for wanted keys (key) that they lack, inferred entries: of the trimmed stem, else of a headword."""
    stems = fallback_stems(wanted, shards.select("key"), headword_keys)
    cloned = stems.where("tier = 'trim'").select(F.col("key").alias("new_key"), F.col("stem").alias("key")).join(shards, "key")
    cloned = cloned.select(F.substring("new_key", 1, 1).alias("letter"), F.col("new_key").alias("key"), "ord", "l", "p", mark_inferred(F.col("f")).alias("f"))
    made = stems.where("tier = 'mw'").select(F.substring("key", 1, 1).alias("letter"), "key", F.lit(0).alias("ord"), iast_to_dev(slp1_to_iast(F.col("stem"))).alias("l"), F.lit("stem").alias("p"), mark_inferred(F.lit("")).alias("f"))
    return shards.unionByName(cloned).unionByName(made)


def occurrence_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placed, omitted) of analysis rows for a source-locked edition.

    placed: work_id, ref (chapter.verse), token_index in verse order (ties by row), word, and the one reading of its context.
    omitted: rows without a word, a numeric place or exactly one reading. Rows with an unreadable chapter or verse are
    omitted, too.
    """
    number = lambda c: F.trim(c).try_cast("double")
    chapter, verse = number("chpatno").try_cast("int"), number("slokano").try_cast("int")
    r = rows.withColumn("place", number("poem")).withColumn("parse", contextual_parse(F.col("morph_in_context"))).withColumn("chapter", chapter).withColumn("verse", verse)
    good = F.coalesce(F.col("word") != "", F.lit(False)) & F.col("place").isNotNull() & F.col("parse").isNotNull() & F.col("chapter").isNotNull() & F.col("verse").isNotNull()
    ref = F.concat_ws(".", F.col("chapter").cast("string"), F.col("verse").cast("string"))
    index = F.row_number().over(Window.partitionBy("work_id", "chapter", "verse").orderBy("place", "row_id")) - 1
    placed = r.where(good).select("work_id", ref.alias("ref"), index.alias("token_index"), "word", F.col("parse.l").alias("l"), F.col("parse.p").alias("p"), F.col("parse.f").alias("f"), F.replace("english_meaning", F.lit("_"), F.lit(" ")).alias("g"), "row_id")
    omitted = r.where(~good).select("work_id", "row_id", ref.alias("ref"), F.coalesce("word", F.lit("")).alias("word"))
    return placed, omitted


def edition(placed: DataFrame) -> DataFrame:
    """(work_id, ref, words): the units of the edition, words in their order."""
    ordered = F.array_sort(F.collect_list(F.struct("token_index", "word")))
    return placed.groupBy("work_id", "ref").agg(F.transform(ordered, lambda x: x["word"]).alias("words"))


def edition_report(placed: DataFrame, omitted: DataFrame) -> DataFrame:
    """By work: tokens shown, tokens with an entry, their share as measured by the join, rows omitted."""
    shown = edition(placed).select("work_id", "ref", F.posexplode("words").alias("token_index", "word"))
    aligned = shown.join(placed.select("work_id", "ref", "token_index", F.lit(1).alias("hit")).distinct(), ["work_id", "ref", "token_index"], "left")
    counts = aligned.groupBy("work_id").agg(F.count("*").alias("reader_tokens"), F.count("hit").alias("aligned"))
    left_out = omitted.groupBy("work_id").agg(F.count("*").alias("omitted"))
    return counts.join(left_out, "work_id", "left").select("work_id", "reader_tokens", "aligned", F.round(100.0 * F.col("aligned") / F.col("reader_tokens"), 3).alias("alignment_pct"), F.coalesce("omitted", F.lit(0)).alias("omitted"))


def slice_sizes(index: DataFrame) -> DataFrame:
    """(slice, forms, bytes) of the surface index by initial letter; forms without one are under null."""
    return index.groupBy(initial_slice(F.col("form")).alias("slice")).agg(F.count("*").alias("forms"), F.sum(F.octet_length("form") + F.octet_length("key")).alias("bytes"))
