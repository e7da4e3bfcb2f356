"""Tokens, pages and references of works, and what translations say beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tantu.operators.ordered import first_by

PAGE = 30  # units on a page
JUMP = 40  # pages that a jump loads at most


def unit_words(df: DataFrame) -> Column:
    """Words of a unit in either shape: a list, or one text with plain spaces."""
    return F.coalesce("words", F.filter(F.split("w", " "), lambda x: x != ""))


def latest_units(units: DataFrame) -> DataFrame:
    """Every unit once, by its latest delivery; its words in one shape. Null words are an empty list."""
    rows = units.select("unit_id", "work_id", "ref", F.coalesce(unit_words(units), F.array().cast("array<string>")).alias("words"), "ingested_at", "deleted_at")
    best = rows.groupBy("unit_id").agg(F.max(F.struct("ingested_at", "work_id", "ref", "words", "deleted_at")).alias("u"))
    return best.select("unit_id", "u.work_id", "u.ref", "u.words", "u.ingested_at", "u.deleted_at")


def tokens(units: DataFrame) -> DataFrame:
    """(unit_id, work_id, ref, token_index, form) of all words; token_index counts from 0."""
    return latest_units(units).select("unit_id", "work_id", "ref", F.posexplode("words").alias("token_index", "form"))


def work_tokens(token_rows: DataFrame, works: DataFrame) -> DataFrame:
    """(work_id, form): the distinct words of each catalogued work whose language (sa where none is given) is not Pali."""
    kept = works.where(F.coalesce("lang", F.lit("sa")) != "pi").select("work_id").distinct()
    return token_rows.where("form <> ''").select("work_id", "form").distinct().join(kept, "work_id", "left_semi")


def ref_place(ref: str = "ref") -> list[Column]:
    """Order of refs: the numbers of their pieces, then the pieces as text (1.2 before 1.10, 1.2 before 1.2a)."""
    pieces = F.split(F.col(ref), r"\.")
    numbers = F.transform(pieces, lambda p: F.coalesce(F.regexp_extract(p, r"^(\d+)", 1).try_cast("int"), F.lit(-1)))
    return [numbers, F.col(ref)]


def placed_units(units: DataFrame) -> DataFrame:
    """Latest units with ``idx``, their place in their work from 0, in the order of refs."""
    by_ref = Window.partitionBy("work_id").orderBy(*ref_place(), "unit_id")
    return latest_units(units).withColumn("idx", F.row_number().over(by_ref) - 1)


def pages(placed: DataFrame, size: int = PAGE) -> DataFrame:
    """Page of each unit (from 0), whether it opens the page, and the badge that every fifth unit carries."""
    return placed.withColumn("page", F.floor(F.col("idx") / size).cast("int")).withColumn("opens", F.col("idx") % size == 0).withColumn("badge", F.col("idx") % 5 == 0)


def page_counts(placed: DataFrame, size: int = PAGE) -> DataFrame:
    """Units and pages (one at least) of each work."""
    return placed.groupBy("work_id").agg(F.count("*").alias("units"), F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("int").alias("pages"))


def jump_targets(placed: DataFrame, refs: DataFrame, size: int = PAGE, most: int = JUMP) -> DataFrame:
    """(work_id, ref, page, reached): the page of the first unit of each wanted ref; beyond ``most`` pages it isn't reached."""
    at = placed.groupBy("work_id", "ref").agg(F.min("idx").alias("idx"))
    found = refs.join(at, ["work_id", "ref"], "left").withColumn("page", F.floor(F.col("idx") / size).cast("int"))
    return found.select("work_id", "ref", "page", (F.col("page").isNotNull() & (F.col("page") <= most)).alias("reached"))


def unique_refs(df: DataFrame, keys: list[str], order: list[Column | str], ref: str = "ref") -> DataFrame:
    """Adds dom_ref: the first of equal refs keeps it, the next get a to z, then numbers."""
    n = F.row_number().over(Window.partitionBy(*keys, ref).orderBy(*order)) - 1
    name = F.when(n == 0, F.col(ref)).when(n <= 26, F.concat(F.col(ref), F.char(96 + n))).otherwise(F.concat(F.col(ref), n.cast("string")))
    return df.withColumn("dom_ref", name)


def translation_units(files: DataFrame) -> DataFrame:
    """(file_id, work_id, part_ref, lang, pos, ref, text) of the elements that hold a text in any of three shapes."""
    rows = files.select("file_id", "work_id", "part_ref", "lang", F.posexplode("units").alias("pos", "u"))
    text = F.coalesce("u.text", F.array_join("u.words", " "), "u.w")
    return rows.select("file_id", "work_id", "part_ref", "lang", "pos", F.col("u.ref").alias("ref"), text.alias("text")).where("text is not null").distinct()


def texts_by_ref(elements: DataFrame, lang: str) -> DataFrame:
    """(work_id, ref, text) of one language: the first text of each ref, by file and position; blank texts don't count."""
    rows = elements.where((F.col("lang") == lang) & F.col("ref").isNotNull() & (F.trim("text") != ""))
    return first_by(rows.select("work_id", "ref", "text", "file_id", "pos"), ["work_id", "ref"], ["file_id", "pos"]).select("work_id", "ref", "text")


def beside(placed: DataFrame, elements: DataFrame) -> DataFrame:
    """Units with their Chinese line by ref, and their English one by ref, else by place in the part; a dash where none is.

    Place: the n-th unit of a part beside the n-th element of the part's first English file.
    """
    zh = texts_by_ref(elements, "zh").withColumnRenamed("text", "zh")
    en = texts_by_ref(elements, "en").withColumnRenamed("text", "en_ref")
    english = elements.where("lang = 'en' and trim(text) <> ''")
    first_file = english.groupBy("work_id", "part_ref").agg(F.min("file_id").alias("file_id"))
    by_pos = english.join(first_file, ["work_id", "part_ref", "file_id"]).groupBy("work_id", "part_ref", F.col("pos").alias("at")).agg(F.min("text").alias("en_pos"))
    part = F.regexp_replace("ref", r"\.[^.]*$", "")
    units = placed.withColumn("part_ref", part)
    units = units.withColumn("at", F.row_number().over(Window.partitionBy("work_id", "part_ref").orderBy("idx")) - 1)
    joined = units.join(zh, ["work_id", "ref"], "left").join(en, ["work_id", "ref"], "left").join(by_pos, ["work_id", "part_ref", "at"], "left")
    return joined.select("unit_id", "work_id", "ref", F.coalesce("zh", F.lit("—")).alias("zh"), F.coalesce("en_ref", "en_pos", F.lit("—")).alias("en"))


def zh_line(placed: DataFrame, elements: DataFrame) -> DataFrame:
    """Units with one line: Chinese by ref, else English by ref (then missing_zh holds), else a dash."""
    zh = texts_by_ref(elements, "zh").withColumnRenamed("text", "zh")
    en = texts_by_ref(elements, "en").withColumnRenamed("text", "en")
    joined = placed.join(zh, ["work_id", "ref"], "left").join(en, ["work_id", "ref"], "left")
    return joined.select("unit_id", "work_id", "ref", F.coalesce("zh", "en", F.lit("—")).alias("line"), (F.col("zh").isNull() & F.col("en").isNotNull()).alias("missing_zh"))


def paired_once(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left and right rows (keys, ref, pos, text) paired one to one, and what is left over of both.

    The n-th left row of a ref takes the n-th right row of that ref; left rows that found none take the right row at their
    own position, if no ref has taken it. Columns: keys, left_pos, right_pos, how (ref, pos, left, right).
    """
    number = lambda df: F.row_number().over(Window.partitionBy(*keys, "ref").orderBy("pos"))
    a = left.select(*keys, "ref", F.col("pos").alias("left_pos"), number(left).alias("n"))
    b = right.select(*keys, "ref", F.col("pos").alias("right_pos"), number(right).alias("n"))
    by_ref = a.where("ref is not null").join(b.where("ref is not null"), [*keys, "ref", "n"]).select(*keys, "left_pos", "right_pos", F.lit("ref").alias("how"))
    rest_a = a.join(by_ref, [*keys, "left_pos"], "left_anti").select(*keys, "left_pos")
    rest_b = b.join(by_ref, [*keys, "right_pos"], "left_anti").select(*keys, "right_pos")
    outer = rest_a.withColumn("__at", F.col("left_pos")).join(rest_b.withColumn("__at", F.col("right_pos")), [*keys, "__at"], "full").drop("__at")
    how = F.when(F.col("left_pos").isNull(), "right").when(F.col("right_pos").isNull(), "left").otherwise("pos")
    return by_ref.unionByName(outer.withColumn("how", how))


def speaker_shares(elements: DataFrame, speaker: Column, least: float = 0.75) -> DataFrame:
    """By file: elements, those that open with a speaker, their share, and whether it is enough to trust the mapping."""
    marked = elements.withColumn("__s", speaker)
    share = F.count("__s") / F.count("*")
    return marked.groupBy("file_id").agg(F.count("*").alias("elements"), F.count("__s").alias("speakers"), share.alias("share"), (share >= least).alias("trusted"))


def occurrence_index(df: DataFrame, edition: str = "source-locked") -> DataFrame:
    """Rows of the occurrence index that the reader takes: of the right source and edition, with refs."""
    return df.where((F.col("source") == "dcs") & (F.col("edition") == edition) & F.col("refs").isNotNull())


def _raw_parses(shards: DataFrame, kind) -> DataFrame:
    """(work_id, ref, token, parses) of documents that are JSON text; what can't be read gives no row."""
    doc = F.coalesce(F.get_json_object("raw_json", "$.occurrence"), F.col("raw_json"))
    raw = shards.where("occurrence is null and raw_json is not null").select("work_id", F.explode(F.from_json(doc, "map<string,string>")).alias("ref", "t"))
    raw = raw.select("work_id", "ref", F.explode(F.from_json("t", "map<string,string>")).alias("token", "ps")).where("ps is not null")
    listed = F.when(F.ltrim("ps").startswith("["), F.col("ps")).otherwise(F.concat(F.lit("["), "ps", F.lit("]")))
    return raw.select("work_id", "ref", "token", F.from_json(listed, kind).alias("parses"))


def occurrence_parses(df: DataFrame, edition: str = "source-locked", units: DataFrame | None = None) -> DataFrame:
    """(work_id, ref, token_index, parses) of occurrence documents whose parses are all sure: of the source, confidence 1.

    Both versions of documents: typed ones, and those whose content is JSON text, in an envelope or not, where a token may
    hold one parse without a list. A token with an empty list, or with any doubtful parse, gives no row. With ``units``
    (work_id, ref) only shards whose index names one of them are read.
    """
    shards = occurrence_index(df, edition)
    if units is not None:
        asked = units.select("work_id", F.col("ref").alias("__ref")).distinct()
        named = shards.select("shard_id", "work_id", F.explode(F.map_keys("refs")).alias("__ref")).join(asked, ["work_id", "__ref"], "left_semi")
        shards = shards.join(named.select("shard_id").distinct(), "shard_id", "left_semi")
    typed = shards.where("occurrence is not null").select("work_id", F.explode("occurrence").alias("ref", "tokens"))
    typed = typed.select("work_id", "ref", F.explode("tokens").alias("token", "parses"))
    kind = typed.schema["parses"].dataType
    every = typed
    if "raw_json" in df.columns:
        every = typed.union(_raw_parses(shards, kind))
    sure = F.forall("parses", lambda p: F.coalesce((p["source"] == "dcs") & (p["confidence"] == 1.0), F.lit(False)))
    return every.where((F.size("parses") > 0) & sure).select("work_id", "ref", F.col("token").try_cast("int").alias("token_index"), "parses")


def with_occurrence(token_rows: DataFrame, parses: DataFrame) -> DataFrame:
    """Tokens with the parse of their occurrence, by work, ref and place, never by form; null where there is none."""
    one = parses.groupBy("work_id", "ref", "token_index").agg(F.min(F.element_at("parses", 1)).alias("parse"))
    return token_rows.join(one, ["work_id", "ref", "token_index"], "left")
