"""Files of a corpus: catalogs, work parts, JSON shards, dictionaries, annotated sentences, XML analyses; and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tantu.functions.feats import map_feats, map_pos, parse_feats
from tantu.functions.keys import form_keys, initial_slice
from tantu.functions.misc import feature_abbr, pos_code
from tantu.functions.translit import iast_to_dev
from tantu.session import spread

PARSE = "l string, p string, f string, g string, x string, r string, source string, confidence double, m array<struct<d: string, l: string, p: string, f: string>>"


def whole(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): files read as one text each."""
    return spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())


def one_document(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): one small document, also if its name begins with _, which scans of folders leave out."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return spark.createDataFrame([(path, text)], "file string, value string")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Works of a catalog document, each with its author, in the catalog's order.

    Language: the work's, else the author's, else sa. Flags say whether it has translations.
    """
    doc = spark.read.option("multiLine", True).json(path)
    authors = doc.select(F.posexplode("authors").alias("author_ord", "a"))
    works = authors.select("author_ord", "a", F.posexplode("a.works").alias("work_ord", "w"))
    have = {f.name for f in works.schema["w"].dataType.fields}
    held = {f.name for f in works.schema["a"].dataType.fields}
    w = lambda c: F.col(f"w.{c}") if c in have else F.lit(None).cast("string")
    a = lambda c: F.col(f"a.{c}") if c in held else F.lit(None).cast("string")
    files = lambda c: F.coalesce(F.size(F.col(f"w.{c}.files")) > 0, F.lit(False)) if c in have else F.lit(False)
    return works.select(
        "author_ord", "work_ord", a("key").alias("author_key"), F.trim(F.coalesce(a("name"), F.lit(""))).alias("author"), F.trim(F.coalesce(a("nameZh"), F.lit(""))).alias("author_zh"),
        w("id").alias("work_id"), w("title").alias("title"), F.trim(F.coalesce(w("titleZh"), F.lit(""))).alias("title_zh"), F.coalesce(w("lang"), a("lang"), F.lit("sa")).alias("lang"),
        (F.col("w.files") if "files" in have else F.array().cast("array<string>")).alias("files"), (F.col("w.unitCount") if "unitCount" in have else F.lit(None).cast("bigint")).alias("unit_count"),
        files("translation").alias("has_translation"), files("translationZh").alias("has_zh"),
    ).withColumn("untranslated", ~F.col("has_translation") & ~F.col("has_zh"))


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """(work_id, part_file, idx, ref, words) of work parts, in either shape of unit."""
    schema = "id string, author string, title string, kind string, edition string, units array<struct<ref: string, words: array<string>, w: string>>"
    docs = whole(spark, path).select("file", F.from_json("value", schema).alias("d"))
    units = docs.select(F.col("d.id").alias("work_id"), F.col("file").alias("part_file"), F.posexplode("d.units").alias("idx", "u"))
    words = F.coalesce("u.words", F.filter(F.split("u.w", " "), lambda x: x != ""), F.array().cast("array<string>"))
    return units.select("work_id", "part_file", "idx", F.col("u.ref").alias("ref"), words.alias("words"))


def read_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(file, key, value) of JSON objects whose keys are data. Read as maps, so keys that differ only in case stay apart."""
    docs = whole(spark, path).select("file", F.from_json("value", f"map<string,{value}>").alias("m"))
    return docs.select("file", F.explode("m").alias("key", "value"))


def read_morph_shards(spark: SparkSession, path: str) -> DataFrame:
    """(slp_key, ord_no, l, p, f, g, x, m): entries of morph shards in their order; the _provenance key is none."""
    rows = read_map(spark, path, "array<string>").where("key <> '_provenance'").select(F.col("key").alias("slp_key"), F.posexplode("value").alias("ord_no", "e"))
    return rows.select("slp_key", "ord_no", F.from_json("e", PARSE).alias("e")).select("slp_key", "ord_no", "e.l", "e.p", "e.f", "e.g", "e.x", "e.m")


def read_gloss_shards(spark: SparkSession, path: str) -> DataFrame:
    """(key, u, g, exact_key): entries of gloss shards by lower-case key; the key as it stands is kept beside it."""
    rows = read_map(spark, path, "struct<u: string, g: string>")
    return rows.select(F.lower("key").alias("key"), F.col("value.u").alias("u"), F.col("value.g").alias("g"), F.col("key").alias("exact_key"))


def read_surface(spark: SparkSession, path: str) -> DataFrame:
    """(file, form, key) of surface index slices."""
    return read_map(spark, path, "string").select("file", F.col("key").alias("form"), F.col("value").alias("key"))


def read_occurrences(spark: SparkSession, path: str) -> DataFrame:
    """(file, ref, token_index, parses) of occurrence shards; a shard that can't be read gives no rows."""
    docs = whole(spark, path).select("file", F.from_json("value", f"map<string,map<string,array<struct<{_struct(PARSE)}>>>>").alias("m"))
    refs = docs.select("file", F.explode("m").alias("ref", "t")).select("file", "ref", F.explode("t").alias("token", "parses"))
    return refs.select("file", "ref", F.col("token").try_cast("int").alias("token_index"), "parses")


def _struct(ddl: str) -> str:
    """Top-level fields of a DDL string as fields of a struct type."""
    out, depth = [], 0
    for piece in ddl.split(", "):
        fresh = depth == 0
        depth += piece.count("<") - piece.count(">")
        out.append(piece.replace(" ", ": ", 1) if fresh else piece)
    return ", ".join(out)


def read_postings(spark: SparkSession, meta: str, path: str) -> DataFrame:
    """(term, total, work_id, first_ref) of a word index: its list of works and its shards of mixed arrays."""
    works = one_document(spark, meta).select(F.from_json("value", "v bigint, letters array<string>, works array<string>").alias("d")).select(F.posexplode("d.works").alias("i", "work_id"))
    rows = read_map(spark, path, "array<string>").select(F.col("key").alias("term"), F.col("value")[0].try_cast("bigint").alias("total"), F.explode(F.from_json(F.col("value")[1], "array<array<string>>")).alias("p"))
    return rows.select("term", "total", F.col("p")[0].try_cast("int").alias("i"), F.col("p")[1].alias("first_ref")).join(works, "i").select("term", "total", "work_id", "first_ref")


def read_snippets(spark: SparkSession, path: str) -> DataFrame:
    """(work_id, ref, snippet) of a translation index document."""
    docs = whole(spark, path).select(F.from_json("value", "v bigint, w array<string>, e array<array<string>>").alias("d"))
    rows = docs.select("d.w", F.explode("d.e").alias("e"))
    return rows.select(F.try_element_at("w", F.col("e")[0].try_cast("int") + 1).alias("work_id"), F.col("e")[1].alias("ref"), F.col("e")[2].alias("snippet"))


def read_translations(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, ref, text, translator, year, license, alignment, note) of translation files in all three shapes."""
    schema = "units array<struct<ref: string, text: string, words: array<string>, w: string>>, translator string, year string, license string, alignment string, note string"
    docs = whole(spark, path).select("file", F.from_json("value", schema).alias("d"))
    rows = docs.select("file", "d", F.posexplode("d.units").alias("pos", "u"))
    text = F.coalesce("u.text", F.array_join("u.words", " "), "u.w")
    return rows.select("file", "pos", F.col("u.ref").alias("ref"), text.alias("text"), "d.translator", "d.year", "d.license", "d.alignment", "d.note").where("text is not null")


def read_analysis(spark: SparkSession, path: str, keep_file: bool = False) -> DataFrame:
    """Analysis rows of JSON arrays with row_id, their place in their array; with keep_file also the array's file."""
    fields = ("chpatno", "slokano", "poem", "word", "sandhied_word", "morph_analysis", "morph_in_context", "english_meaning")
    docs = whole(spark, path).select("file", F.from_json("value", "array<map<string,string>>").alias("a"))
    rows = docs.select("file", F.posexplode("a").alias("row_id", "r"))
    return rows.select(*(["file"] if keep_file else []), F.col("row_id").cast("bigint"), *[F.col("r")[f].alias(f) for f in fields])


def read_slokas(spark: SparkSession, path: str) -> DataFrame:
    """(form): the distinct tokens of verse rows, without the marks around them."""
    docs = whole(spark, path).select(F.explode(F.from_json("value", "array<struct<spart1: string, spart2: string>>")).alias("s"))
    marks = r"[।॥1०.,;:!?“”()\-]+"
    words = F.split(F.concat_ws(" ", F.coalesce("s.spart1", F.lit("")), F.coalesce("s.spart2", F.lit(""))), r"\s+")
    return docs.select(F.explode(words).alias("form")).select(F.regexp_replace("form", f"^{marks}|{marks}$", "").alias("form")).where("form <> ''").distinct()


def read_headword_keys(spark: SparkSession, path: str) -> DataFrame:
    """(key): headword keys of a dictionary dump with <L> records."""
    lines = spark.read.text(path).where("value like '<L>%'")
    return lines.select(F.lower(F.trim(F.regexp_extract("value", "<k1>([^<]*)", 1))).alias("key")).where(F.col("key").rlike("^[a-z~]+$")).distinct()


def annotated_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): the lines of annotated sentence files in order.

    Files are read whole, a row each, because only a file knows the order of its lines; such files are a few megabytes.
    """
    rows = whole(spark, path).select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))
    return rows


def annotated_rows(lines: DataFrame) -> DataFrame:
    """Lines (file, line_no, value) as rows: file, line_no, sentence, sent_id, kind and the ten columns.

    kind: blank, comment, range, empty (decimal ids and too few columns), mark (punctuation and symbols) or token. sentence
    counts blank lines before the row; sent_id is that of the sentence's comment.
    """
    by_file = Window.partitionBy("file").orderBy("line_no")
    c = F.split("value", "\t")
    col = lambda i: F.try_element_at(c, F.lit(i + 1))
    blank = F.trim("value") == ""
    kind = (
        F.when(blank, "blank").when(F.col("value").startswith("#"), "comment").when((F.size(c) < 6) | col(0).contains("."), "empty")
        .when(col(0).contains("-"), "range").when(col(3).isin("PUNCT", "SYM"), "mark").otherwise("token")
    )
    names = ("id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc")
    rows = lines.select("file", "line_no", "value", kind.alias("kind"), *[col(i).alias(n) for i, n in enumerate(names)])
    rows = rows.withColumn("sentence", F.sum((F.col("kind") == "blank").cast("int")).over(by_file))
    sent = F.when(F.col("value").rlike("^# sent_id = "), F.trim(F.regexp_extract("value", "^# sent_id = (.*)$", 1)))
    return rows.withColumn("sent_id", F.max(sent).over(Window.partitionBy("file", "sentence"))).drop("value")


def annotated_entries(rows: DataFrame) -> DataFrame:
    """Tokens with their analysis: file, line_no, sentence, sent_id, id, form, keys, l, p, f (l null without a lemma)."""
    tokens = spread(rows.where("kind = 'token'"), "file", "sentence")
    feats = parse_feats(F.col("feats"))
    unsandhied = F.regexp_extract(F.coalesce("misc", F.lit("")), r"(?:^|\|)Unsandhied=([^|]*)", 1)
    keys = F.array_distinct(F.concat(form_keys(F.col("form")), F.when(unsandhied != "", form_keys(unsandhied)).otherwise(F.array().cast("array<string>"))))
    lemma = F.when(F.coalesce("lemma", F.lit("_")).isin("", "_"), None).otherwise(iast_to_dev(F.col("lemma")))
    return tokens.select("file", "line_no", "sentence", "sent_id", "id", "form", F.nullif(unsandhied, F.lit("")).alias("unsandhied"), "misc", keys.alias("keys"), lemma.alias("l"), map_pos(F.col("upos"), feats).alias("p"), map_feats(F.col("upos"), feats).alias("f"))


def compound_entries(rows: DataFrame) -> DataFrame:
    """Compounds of range rows (a-b): file, line_no, form, keys, l, p, f, m; only those whose members all arrive.

    The b-a+1 tokens after a range row are its members, whatever lies between; a new range takes over from an open one.
    """
    by_file = Window.partitionBy("file").orderBy("line_no")
    low, high = F.substring_index("id", "-", 1).try_cast("int"), F.substring_index("id", "-", -1).try_cast("int")
    opened = F.when((F.col("kind") == "range") & low.isNotNull() & high.isNotNull(), F.struct("line_no", "form", (high - low + 1).alias("n")))
    r = rows.where("kind in ('range', 'token')").withColumn("open", F.last(opened, ignorenulls=True).over(by_file)).where("kind = 'token' and open is not null")
    feats = parse_feats(F.col("feats"))
    unsandhied = F.nullif(F.regexp_extract(F.coalesce("misc", F.lit("")), r"(?:^|\|)Unsandhied=([^|]*)", 1), F.lit(""))
    member = F.struct(iast_to_dev(F.coalesce(unsandhied, F.col("form"))).alias("d"), F.when(F.coalesce("lemma", F.lit("_")).isin("", "_"), "").otherwise(iast_to_dev(F.col("lemma"))).alias("l"), map_pos(F.col("upos"), feats).alias("p"), map_feats(F.col("upos"), feats).alias("f"))
    arrival = F.row_number().over(Window.partitionBy("file", "open.line_no").orderBy("line_no"))
    fed = r.select("file", "line_no", "open", member.alias("m"), arrival.alias("n")).where("n <= open.n")
    whole_ = fed.groupBy("file", "open").agg(F.count("*").alias("k"), F.array_sort(F.collect_list(F.struct("n", "m"))).alias("ms")).where("k = open.n and k > 0")
    m = F.transform("ms", lambda x: x["m"])
    out = whole_.select("file", F.col("open.line_no").alias("line_no"), F.col("open.form").alias("form"), m.alias("m"))
    last = F.element_at("m", -1)
    lemma = F.when(last["l"] != "", last["l"]).otherwise(F.element_at("m", 1)["l"])
    return out.select("file", "line_no", "form", form_keys(F.col("form")).alias("keys"), lemma.alias("l"), last["p"].alias("p"), last["f"].alias("f"), "m").where("size(keys) > 0 and l <> ''")


def fused_spans(rows: DataFrame, longest: int = 4, least_chars: int = 8, most_chars: int = 48) -> DataFrame:
    """Runs of 2 to ``longest`` neighbouring tokens as one form: file, line_no, sentence, n, form, keys, l, p, f, m.

    Runs end at sentence ends and at tokens without keys or lemma, not at punctuation. Forms that are too short or too
    long, and runs that end in the negation, are none.
    """
    entries = annotated_entries(rows).withColumn("usable", (F.size("keys") > 0) & F.col("l").isNotNull())
    by_sentence = Window.partitionBy("file", "sentence").orderBy("line_no")
    entries = entries.withColumn("island", F.sum((~F.col("usable")).cast("int")).over(by_sentence)).where("usable")
    bare = F.translate("form", "'’", "")
    elided = F.regexp_extract("form", "^(['’]*)", 1)
    shown = F.concat(F.regexp_replace(elided, "['’]", "ऽ"), iast_to_dev(F.regexp_replace("form", "^['’]+", "")))
    item = F.struct(bare.alias("form"), F.struct(shown.alias("d"), F.col("l"), F.col("p"), F.col("f")).alias("m"))
    history = F.collect_list(item).over(Window.partitionBy("file", "sentence", "island").orderBy("line_no").rowsBetween(1 - longest, 0))
    runs = entries.select("file", "line_no", "sentence", history.alias("h")).where("size(h) >= 2").select("*", F.explode(F.sequence(F.lit(2), F.size("h"))).alias("n"))
    run = F.slice("h", -F.col("n"), F.col("n"))
    runs = runs.select("file", "line_no", "sentence", "n", F.array_join(F.transform(run, lambda x: x["form"]), "").alias("form"), F.transform(run, lambda x: x["m"]).alias("m"))
    last = F.element_at("m", -1)
    fit = spread(runs, "file", "line_no").where(F.length("form").between(least_chars, most_chars) & (last["l"] != "न"))
    kept = fit.withColumn("keys", F.explode(F.array(form_keys(F.col("form"))))).where("size(keys) > 0")  # made once: a filter on a column is put below it and makes it again
    return kept.select("file", "line_no", "sentence", "n", "form", "keys", last["l"].alias("l"), last["p"].alias("p"), last["f"].alias("f"), "m")


def gated(spans: DataFrame, allowed: DataFrame) -> DataFrame:
    """Spans one of whose keys is allowed (key), with all their keys."""
    hit = spans.select("file", "line_no", "n", F.explode("keys").alias("key")).join(allowed.select("key").distinct(), "key", "left_semi").select("file", "line_no", "n").distinct()
    return spans.join(hit, ["file", "line_no", "n"], "left_semi")


def sentence_edition(rows: DataFrame) -> DataFrame:
    """(ref, token_index, word, l, p, f, r): tokens of sentences with an id, as a source-locked edition.

    ref is dcs- and the sentence's id; r is the token's OccId, else its file, sentence and id. Sentences without an id drop
    out; of sentences that share one the first counts.
    """
    entries = annotated_entries(rows).where("sent_id is not null")
    first = entries.groupBy("sent_id").agg(F.min(F.struct("file", "sentence")).alias("s"))
    once = entries.join(first, "sent_id").where("file = s.file and sentence = s.sentence")
    occ = F.nullif(F.regexp_extract(F.coalesce("misc", F.lit("")), r"(?:^|\|)OccId=([^|]+)", 1), F.lit(""))
    base = F.element_at(F.split("file", "/"), -1)
    index = F.row_number().over(Window.partitionBy("sent_id").orderBy("line_no")) - 1
    return once.select(F.concat(F.lit("dcs-"), "sent_id").alias("ref"), index.alias("token_index"), iast_to_dev(F.col("form")).alias("word"), "l", "p", "f", F.coalesce(occ, F.concat_ws(":", base, "sent_id", "id")).alias("r"))


_TEXT = "struct<_VALUE: string>"
_INFL = f"struct<{', '.join(f'{tag}: {_TEXT}' for tag in ('pofs', 'mood', 'tense', 'voice', 'person', 'pers', 'gend', 'case', 'num'))}, stemtype: array<{_TEXT}>, derivtype: array<{_TEXT}>, dialect: array<{_TEXT}>, dial: array<{_TEXT}>>"
_ENTRY = f"dict struct<hdwd: {_TEXT}>, infl array<{_INFL}>"


def read_xml_analyses(texts: DataFrame, column: str = "xml") -> DataFrame:
    """(entry, infl, l, p, f, x) of morphology answers in XML, whatever their namespaces and however deep the entries lie.

    Entries are cut out and parsed as XML, entities and CDATA included; malformed ones give no rows.
    """
    plain = F.regexp_replace(F.regexp_replace(column, r"<(/?)[A-Za-z0-9_.-]+:", "<$1"), r"\s(?:xmlns(?::\w+)?|\w+:\w+)=\"[^\"]*\"", "")
    whole_ = F.regexp_extract_all(plain, F.lit(r"(?s)<entry\b.*?</entry>"), F.lit(0))
    parsed = F.from_xml("e", _ENTRY, {"mode": "PERMISSIVE"})
    entries = texts.select(F.posexplode(whole_).alias("entry", "e")).select("entry", parsed.alias("e"))
    said = lambda c: F.trim(F.coalesce(c["_VALUE"], F.lit("")))
    lemma = F.trim(F.element_at(F.split(said(F.col("e.dict.hdwd")), ","), -1))
    infl = entries.select("entry", lemma.alias("l"), F.posexplode("e.infl").alias("infl", "i"))
    pos = said(F.col("i.pofs"))
    some = lambda *tags: F.coalesce(*[F.nullif(feature_abbr(said(F.col(f"i.{tag}"))), F.lit("")) for tag in tags])
    mood = F.when(F.lower(pos) == "participle", F.lit("part")).otherwise(some("mood"))
    every = lambda *tags: F.concat(*[F.coalesce(F.col(f"i.{tag}"), F.array().cast(f"array<{_TEXT}>")) for tag in tags])
    stems = F.array_join(F.transform(every("stemtype", "derivtype"), said), ",")
    dialects = F.array_join(F.transform(every("dialect", "dial"), said), " ")
    x = F.concat_ws("|", F.nullif(dialects, F.lit("")), F.nullif(stems, F.lit("")))
    f = F.concat_ws(" ", some("tense"), mood, some("voice"), some("person"), some("gend"), some("case"), some("num"))
    return infl.select("entry", "infl", "l", pos_code(pos).alias("p"), f.alias("f"), x.alias("x"))


def write_morph(shards: DataFrame, path: str) -> None:
    """Morph shards, a partition for each letter; what was there before is replaced."""
    shards.where(F.col("letter").rlike("^[a-z]$")).repartition("letter").write.mode("overwrite").partitionBy("letter").parquet(path)


def write_surface(index: DataFrame, by_work: DataFrame, path: str) -> None:
    """The surface index as a whole, by initial slice and by work; slices that are no more vanish with the old folder."""
    index.write.mode("overwrite").parquet(f"{path}/all")
    index.withColumn("slice", initial_slice(F.col("form"))).where("slice is not null").repartition("slice").write.mode("overwrite").partitionBy("slice").parquet(f"{path}/by-slice")
    by_work.repartition("work_id").write.mode("overwrite").partitionBy("work_id").parquet(f"{path}/by-work")


def write_edition(placed: DataFrame, path: str, edition: str = "source-locked") -> None:
    """A source-locked edition (work_id, ref, token_index, word, l, p, f, g): ``text``, ``shards`` and ``index`` by work.

    text: the work's units. shards: by chapter, refs to token places to a list of one parse, sure and of the source. index:
    in which shard each ref lies. What was there before is replaced.
    """
    chapter = F.substring_index("ref", ".", 1)
    parse = F.struct("l", "p", "f", "g", F.lit("dcs").alias("source"), F.lit(1.0).alias("confidence"))
    words = F.transform(F.array_sort(F.collect_list(F.struct("token_index", "word"))), lambda x: x["word"])
    tokens = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("token_index").cast("string"), F.array(parse)))))
    refs = placed.groupBy("work_id", "ref").agg(words.alias("words"), tokens.alias("tokens")).withColumn("chapter", chapter)
    text = F.to_json(F.struct(F.first("work_id").alias("id"), F.lit(edition).alias("edition"), F.array_sort(F.collect_list(F.struct("ref", "words"))).alias("units")))
    refs.groupBy("work_id").agg(text.alias("value")).write.mode("overwrite").partitionBy("work_id").text(f"{path}/text")
    shard = F.to_json(F.map_from_entries(F.collect_list(F.struct("ref", "tokens"))))
    refs.groupBy("work_id", "chapter").agg(shard.alias("value")).write.mode("overwrite").partitionBy("work_id", "chapter").text(f"{path}/shards")
    index = F.to_json(F.struct(F.lit("dcs").alias("source"), F.lit(edition).alias("edition"), F.map_from_entries(F.collect_list(F.struct("ref", F.concat(F.lit("chapter="), "chapter")))).alias("refs")))
    refs.groupBy("work_id").agg(index.alias("value")).write.mode("overwrite").partitionBy("work_id").text(f"{path}/index")


def ordered_files(spark: SparkSession, roots: list[str], pattern: str, least: int = 0) -> list[str]:
    """The files of several roots, root by root in the order given, sorted by path within each.

    A root that is not there, or fewer than ``least`` files in all, is an error at once.
    """
    found: list[str] = []
    for root in roots:
        at = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            raise FileNotFoundError(root)
        hits = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{pattern}"))
        found += sorted(h.getPath().toString() for h in hits or [])
    if len(found) < least:
        raise ValueError(f"{len(found)} files where {least} are wanted")
    return found


def write_report(report: DataFrame, path: str, mode: str = "append") -> None:
    report.coalesce(1).write.mode(mode).json(path)


def write_resolution(coverage: DataFrame, path: str) -> None:
    """Resolution by work as text separated by bars."""
    coverage.select("work_id", "loose_pct", "strict_pct", F.concat_ws("/", "loose_hits", "words").alias("hits")).orderBy("work_id").coalesce(1).write.mode("overwrite").option("sep", "|").option("header", True).csv(path)


def write_json_maps(df: DataFrame, path: str, key: str, value: str, by: str) -> None:
    """One JSON object a partition value, compact, gzip-compressed."""
    pairs = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))))
    df.groupBy(by).agg(pairs.alias("value")).write.mode("overwrite").partitionBy(by).option("compression", "gzip").text(path)


def part_column(ref: Column) -> Column:
    return F.regexp_replace(ref, r"\.[^.]*$", "")
