"""Queries over files: tables written in the corpus' own file formats, read back by its readers."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tantu.operators import build, lookup, ordered, ranking, reading, search, stores
from tantu.plans import corpus, duck
from tantu.plans.duck import ELEMENTS, TOKENS, UNITS
from tantu.session import shared_dir, table, written
from tantu.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query over (spark, reader of tables by name, an own folder for files)."""

    def register(f):
        def run(spark: SparkSession, path: str) -> DataFrame:
            return f(spark, lambda n: table(spark, path, n), f"{shared_dir(spark)}/{f.__name__}-{uuid.uuid4().hex}")

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("""select distinct coalesce(author_key, '') as author_key, work_id, title, trim(coalesce(title_zh, '')) as title_zh, coalesce(lang, 'sa') as lang from works""")
def catalog_file(spark, t, folder):
    """The catalog as one document of authors with their works."""
    w = t("works").select(F.coalesce("author_key", F.lit("")).alias("author_key"), "work_id", "title", "title_zh", "lang").distinct()
    work = F.struct(F.col("work_id").alias("id"), "title", F.col("title_zh").alias("titleZh"), "lang")
    authors = w.groupBy("author_key").agg(F.array_sort(F.collect_list(work)).alias("works")).select(F.struct(F.col("author_key").alias("key"), F.lit("n").alias("name"), "works").alias("a"))
    authors.agg(F.to_json(F.struct(F.array_sort(F.collect_list("a")).alias("authors"))).alias("value")).write.text(folder)
    return files.read_catalog(spark, folder).select("author_key", "work_id", "title", "title_zh", "lang")


@query(f"with {UNITS} select work_id, ref, array_to_string(words, ' ') as words from units where work_id is not null")
def part_files(spark, t, folder):
    """Parts of works as documents, half of their units in the compact shape."""
    u = reading.latest_units(t("work_units")).where("work_id is not null")
    compact = F.length("ref") % 2 == 0
    unit = F.struct("ref", F.when(~compact, F.col("words")).alias("words"), F.when(compact, F.array_join("words", " ")).alias("w"))
    parts = u.groupBy("work_id", files.part_column(F.col("ref")).alias("part")).agg(F.array_sort(F.collect_list(unit)).alias("units"))
    parts.select(F.concat_ws("-", "work_id", "part").alias("f"), F.to_json(F.struct(F.col("work_id").alias("id"), "units")).alias("value")).repartition("f").write.partitionBy("f").option("maxRecordsPerFile", 1).text(folder)
    return files.read_parts(spark, f"{folder}/*/*").select("work_id", "ref", F.array_join("words", " ").alias("words"))


@query("""select slp_key, (row_number() over (partition by slp_key order by entry_id) - 1)::int as ord_no, l, p, f, g, x from (select distinct entry_id, slp_key, l, p, f, g, x from morph_entries where slp_key is not null and regexp_matches(slp_key, '^[a-z]'))""")
def morph_shard_files(spark, t, folder):
    """Morph shards: one map of keys to parses for each pair of first letters."""
    e = t("morph_entries").where(F.col("slp_key").rlike("^[a-z]")).dropDuplicates(["entry_id"])
    parse = F.struct("entry_id", F.struct("l", "p", "f", "g", "x", "m").alias("e"))
    slots = e.groupBy("slp_key").agg(F.transform(F.array_sort(F.collect_list(parse)), lambda s: s["e"]).alias("parses")).withColumn("letter", F.substring("slp_key", 1, 2))
    files.write_json_maps(slots, folder, "slp_key", "parses", "letter")
    return files.read_morph_shards(spark, f"{folder}/*/*").select("slp_key", "ord_no", "l", "p", "f", "g", "x")


SQL["morph_shard_files"] = """with e as (select entry_id, any_value(slp_key) as slp_key, any_value(l) as l, any_value(p) as p, any_value(f) as f, any_value(g) as g, any_value(x) as x from (select distinct entry_id, slp_key, l, p, f, g, x from morph_entries where slp_key is not null and regexp_matches(slp_key, '^[a-z]')) group by entry_id)
 select slp_key, (row_number() over (partition by slp_key order by entry_id) - 1)::int as ord_no, l, p, f, g, x from e"""


@query("""select distinct iast as exact_key, u, g from headwords""")
def gloss_shard_files(spark, t, folder):
    """Gloss shards with keys that differ only in case, read as maps."""
    h = t("headwords").select("iast", F.struct("u", "g").alias("v"), F.substring("iast", 1, 1).alias("letter")).distinct()
    files.write_json_maps(h, folder, "iast", "v", "letter")
    return files.read_gloss_shards(spark, f"{folder}/*/*").select("exact_key", "u", "g")


@query(f"with {ELEMENTS} select file_id, pos, ref, text from elements")
def translation_files(spark, t, folder):
    """Translation files in all three shapes of their elements."""
    f = t("trans_files").dropDuplicates(["file_id"])
    f.select(F.col("file_id").cast("string").alias("f"), F.to_json(F.struct("units", "translator", F.col("pub_year").alias("year"), "license", "alignment", "note")).alias("value")).write.partitionBy("f").option("maxRecordsPerFile", 1).text(folder)
    rows = files.read_translations(spark, f"{folder}/*/*")
    return rows.select(F.regexp_extract("file", "f=(\\d+)", 1).cast("bigint").alias("file_id"), "pos", "ref", "text")


@query("""select work_id, word, morph_in_context, count(*) as n from (select distinct * from analysis_rows) group by all""")
def analysis_files(spark, t, folder):
    """Analysis rows as JSON arrays, one for each chapter of a work; a row's place in its array is its id."""
    names = ("chpatno", "slokano", "poem", "word", "sandhied_word", "morph_analysis", "morph_in_context", "english_meaning")
    rows = t("analysis_rows").distinct()
    ordered = F.array_sort(F.collect_list(F.struct("row_id", F.struct(*names).alias("r"))))
    docs = rows.groupBy("work_id", "chpatno").agg(F.to_json(F.transform(ordered, lambda x: x["r"])).alias("value"))
    docs.repartition("work_id", "chpatno").write.partitionBy("work_id", "chpatno").option("maxRecordsPerFile", 1).text(folder)
    back = files.read_analysis(spark, f"{folder}/*/*/*", keep_file=True)
    return back.groupBy(F.regexp_extract("file", "work_id=([^/]*)", 1).alias("work_id"), "word", "morph_in_context").agg(F.count("*").alias("n"))


def _annotated(t, ranges: bool = False) -> DataFrame:
    """Units as annotated sentences: one file for each part of a work, a sentence for each unit, a line for each word.

    With ranges a range row stands over every two words, with both as one form.
    """
    tokens = reading.tokens(t("work_units")).where("work_id is not null and form is not null and form <> ''")
    if ranges:  # numbered without gaps, so that a range's two words follow each other
        tokens = tokens.withColumn("token_index", F.row_number().over(Window.partitionBy("unit_id").orderBy("token_index")) - 1)
    n = F.col("token_index") + 1
    iast = lookup_iast(F.col("form"))
    line = F.concat_ws("\t", n.cast("string"), F.lower(iast), iast, F.lit("NOUN"), F.lit("_"), F.concat(F.lit("Case=Nom|Number="), F.when(n % 2 == 0, "Sing").otherwise("Plur")), F.lit("_"), F.lit("_"), F.lit("_"), F.concat(F.lit("OccId="), F.col("unit_id"), F.lit("-"), n))
    if ranges:
        after = F.lead(iast).over(Window.partitionBy("unit_id").orderBy("token_index"))
        over = F.concat_ws("\t", F.concat_ws("-", n.cast("string"), (n + 1).cast("string")), F.lower(F.concat(iast, after)), *[F.lit("_")] * 8)
        line = F.when((n % 2 == 1) & after.isNotNull(), F.concat_ws("\n", over, line)).otherwise(line)
    tokens = tokens.withColumn("part", files.part_column(F.col("ref"))).withColumn("line", line)
    sentences = tokens.groupBy("work_id", "part", "unit_id").agg(F.array_sort(F.collect_list(F.struct("token_index", "line"))).alias("ls"))
    text = F.concat(F.lit("# sent_id = "), F.col("unit_id"), F.lit("\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.lit("\n"))
    whole = sentences.groupBy("work_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_id", text.alias("s")))), lambda x: x["s"]), "\n").alias("value"))
    return whole.select("value", F.concat_ws("-", "work_id", "part").alias("f"))


def lookup_iast(form):
    from tantu.functions.translit import dev_to_iast

    return F.regexp_replace(dev_to_iast(form), r"\s", "")


_CLEAN = f"{UNITS}, toks as (select unit_id, work_id, (row_number() over (partition by unit_id order by i) - 1)::int as token_index, words[i] as form from (select *, unnest(range(1, len(words) + 1)) as i from units) where words[i] <> '' and work_id is not null)"


@query(f"with {_CLEAN} select 'dcs-' || unit_id as ref, token_index, 'noun' as p from toks")
def sentence_editions(spark, t, folder):
    """Annotated sentence files, written from the units and read back as editions."""
    _annotated(t).repartition("f").write.partitionBy("f").option("maxRecordsPerFile", 1).text(folder)
    rows = files.annotated_rows(files.annotated_lines(spark, f"{folder}/*/*"))
    return files.sentence_edition(rows).select("ref", "token_index", "p")


@query()
def fused_spans(spark, t, folder):
    """Neighbouring tokens that fuse to a form whose key the morph table knows."""
    _annotated(t).repartition("f").write.partitionBy("f").option("maxRecordsPerFile", 1).text(folder)
    rows = files.annotated_rows(files.annotated_lines(spark, f"{folder}/*/*"))
    spans = files.fused_spans(rows)
    return spans.select("sentence", "line_no", "n", "form", F.array_join("keys", " ").alias("keys"), "l", "p", "f", F.size("m").alias("members"))


@query("select distinct letter, key, l, p, f from (select substring(slp_key, 1, 1) as letter, slp_key as key, l, p, f from morph_entries where regexp_matches(slp_key, '^[a-z]'))")
def morph_tables(spark, t, folder):
    """Morph shards as a table with a partition for each letter, read back with that letter pruned."""
    e = t("morph_entries").where("slp_key is not null").select(F.substring("slp_key", 1, 1).alias("letter"), F.col("slp_key").alias("key"), "l", "p", "f").distinct()
    files.write_morph(e, folder)
    return spark.read.schema("key string, l string, p string, f string, letter string").parquet(folder).select("letter", "key", "l", "p", "f")


@query()
def surface_tables(spark, t, folder):
    """The surface index by slice and by work, counted as it stands in its folders."""
    index = lookup.surface_index(reading.tokens(t("work_units")), t("morph_entries").where("slp_key is not null").select(F.col("slp_key").alias("key")))
    files.write_surface(index, lookup.work_slices(reading.tokens(t("work_units")), index), folder)
    by_slice = spark.read.parquet(f"{folder}/by-slice").groupBy(F.col("slice").cast("string").alias("part")).agg(F.count("*").alias("forms")).select(F.lit("slice").alias("kind"), "part", "forms")
    by_work = spark.read.parquet(f"{folder}/by-work").groupBy(F.col("work_id").cast("string").alias("part")).agg(F.count("*").alias("forms")).select(F.lit("work").alias("kind"), "part", "forms")
    return by_slice.unionByName(by_work)


@query()
def word_index_files(spark, t, folder):
    """The word index as documents of mixed arrays with its list of works, read back as postings."""
    posted = search.postings(reading.tokens(t("work_units")), [F.struct(*reading.ref_place()), "unit_id", "token_index"]).where("work_id is not null")
    works = posted.select("work_id").distinct()
    meta = works.agg(F.to_json(F.struct(F.lit(1).alias("v"), F.array_sort(F.collect_list("work_id")).alias("works"))).alias("value"))
    meta.coalesce(1).write.text(f"{folder}/meta")
    meta_file = spark.read.text(f"{folder}/meta").select(F.input_file_name()).first()[0]
    order = F.from_json(meta.select("value").scalar(), "works array<string>")["works"]
    pair = F.concat(F.lit("["), (F.array_position(order, F.col("work_id")) - 1).cast("string"), F.lit(',"'), F.col("first_ref"), F.lit('"]'))
    terms = posted.withColumn("pair", pair).groupBy("letter", "term").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list("pair")), ",").alias("ps"))
    name = F.concat(F.lit('"'), F.col("term"), F.lit('"'))  # terms are plain letters and digits
    lines = terms.select(F.coalesce(F.nullif("letter", F.lit("")), F.lit("_")).alias("letter"), F.concat(name, F.lit(":["), F.col("n").cast("string"), F.lit(",["), F.col("ps"), F.lit("]]")).alias("e"))
    lines.groupBy("letter").agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list("e")), ","), F.lit("}")).alias("value")).write.partitionBy("letter").text(f"{folder}/shards")
    return files.read_postings(spark, meta_file, f"{folder}/shards/*/*").select("term", "total", "work_id", "first_ref")


@query()
def edition_files(spark, t, folder):
    """A source-locked edition with its report and resolution, as written and read back."""
    placed, omitted = build.occurrence_rows(t("analysis_rows").distinct())
    files.write_report(build.edition_report(placed, omitted), f"{folder}/report")
    return spark.read.schema("work_id string, reader_tokens bigint, aligned bigint, alignment_pct double, omitted bigint").json(f"{folder}/report")


SQL["word_index_files"] = f"with p as ({corpus.SQL['word_index']}) select term, (sum(n) over (partition by term))::bigint as total, work_id, first_ref from p where work_id is not null"
SQL["edition_files"] = corpus.SQL["edition_report"]
SQL["surface_tables"] = f"""with s as ({corpus.SQL['slice_sizes']}), w as ({corpus.SQL['work_slices']}) select 'slice' as kind, slice as part, forms from s where slice is not null
 union all select 'work', work_id, count(*) from w group by work_id"""


@query(f"""with {UNITS}, x as (select unnest(words) as x from units), w as (select distinct unnest(regexp_split_to_array(x, '\\s+')) as form from x) select distinct form from (select regexp_replace(form, '^[।॥1०.,;:!?“”()\\-]+|[।॥1०.,;:!?“”()\\-]+$', '', 'g') as form from w) where form <> ''
 union select distinct word from analysis_rows where word <> ''""")
def sloka_files(spark, t, folder):
    """Verses of two halves as JSON arrays: their distinct tokens, and the words of the reader's own rows."""
    u = reading.latest_units(t("work_units"))
    half = F.floor(F.size("words") / 2).cast("int")
    verse = F.struct(F.array_join(F.slice("words", F.lit(1), half), " ").alias("spart1"), F.array_join(F.slice("words", half + 1, F.size("words")), " ").alias("spart2"))
    u.groupBy((F.col("unit_id") % 7).alias("f")).agg(F.to_json(F.collect_list(verse)).alias("value")).write.partitionBy("f").text(folder)
    return files.read_slokas(spark, f"{folder}/*/*").union(t("analysis_rows").where("word <> ''").select("word")).distinct()


@query(f"select distinct {duck.slp1_key_for('u')} as key from headwords where u <> ''")
def dictionary_dump(spark, t, folder):
    """Headword keys of a dictionary dump, a record a line."""
    from tantu.functions.translit import dev_to_slp1

    slp = dev_to_slp1(F.col("u"))
    t("headwords").where("u <> ''").select(F.concat(F.lit("<L>"), "head_id", F.lit("<pc>1,1<k1>"), slp, F.lit("<k2>"), slp).alias("value")).union(spark.createDataFrame([("<LEND>",), ("no record <k1>x",)], "value string")).write.text(folder)
    return files.read_headword_keys(spark, folder)


@query(f"with {ELEMENTS} select work_id, ref, text as snippet from elements where lang = 'en' and work_id is not null")
def snippet_files(spark, t, folder):
    """The translation index: a list of works and entries that point into it, a document for each file of translations."""
    e = reading.translation_units(t("trans_files")).where("lang = 'en' and work_id is not null")
    entry = F.array(F.lit("0"), F.col("ref"), F.col("text"))
    docs = e.groupBy("file_id", "work_id").agg(F.to_json(F.struct(F.lit(1).alias("v"), F.array("work_id").alias("w"), F.collect_list(entry).alias("e"))).alias("value"))
    docs.select(F.col("file_id").cast("string").alias("f"), "value").write.partitionBy("f").option("maxRecordsPerFile", 1).text(folder)
    return files.read_snippets(spark, f"{folder}/*/*")


@query(corpus.SQL["latest_marks"])
def store_files(spark, t, folder):
    """Stores as JSON lines, corrupt ones among them, which read as empty."""
    kept = stores.latest(corpus._log(t), ["author_key", "work_id"])
    stores.as_json(kept, ["author_key", "work_id", "ref", "ts"]).union(spark.createDataFrame([("{broken",), ("[]",), ("",)], "json string")).write.text(folder)
    return stores.read_store(spark.read.text(folder), "author_key string, work_id string, ref string, ts timestamp_ntz", "value").where("author_key is not null")


@query(f"select work_id, loose_pct, strict_pct, loose_hits || '/' || words as hits from ({corpus.SQL['coverage_by_work']})")
def resolution_files(spark, t, folder):
    """Resolution by work, written as text separated by bars and read back."""
    files.write_resolution(lookup.coverage(reading.tokens(t("work_units")), corpus._index(t), t("morph_entries").where("slp_key is not null").select(F.col("slp_key").alias("key"))), folder)
    return spark.read.option("sep", "|").option("header", True).schema("work_id string, loose_pct double, strict_pct double, hits string").csv(folder)


@query(f"select work_id, ref, token_index, l, g from ({corpus.SQL['verse_order']}) where work_id is not null")
def occurrence_edition_files(spark, t, folder):
    """A source-locked edition as text, occurrence shards by chapter and an index of refs; the shards read back."""
    placed, _ = build.occurrence_rows(t("analysis_rows").distinct())
    files.write_edition(placed.where("work_id is not null"), folder)
    rows = files.read_occurrences(spark, f"{folder}/shards/*/*/*")
    first = F.element_at("parses", 1)
    return rows.select(F.regexp_extract("file", "work_id=([^/]*)", 1).alias("work_id"), "ref", "token_index", first["l"].alias("l"), first["g"].alias("g"))


_PAIRS = f"""{UNITS}, tk as (select unit_id, n, regexp_replace({duck.dev_to_iast('form')}, '\\s', '', 'g') as w from (select unit_id, row_number() over (partition by unit_id order by i) as n, words[i] as form from (select *, unnest(range(1, len(words) + 1)) as i from units) where work_id is not null and words[i] <> '')),
 pr as (select lower(a.w) || lower(b.w) as form, case when b.w <> '' then b.w else a.w end as lw, b.n from tk a join tk b on a.unit_id = b.unit_id and a.n % 2 = 1 and b.n = a.n + 1),
 kk as (select form, {duck.form_keys('form')} as ks, {duck.iast_to_dev('lw')} as l, n from pr)"""


@query(f"""with {_PAIRS} select form, array_to_string(ks, ' ') as keys, l, '1;एक' as f, 2 as members from kk where l <> '' and len(list_filter(ks, lambda k: length(k) % 2 = 0)) > 0""")
def compound_files(spark, t, folder):
    """Pairs of tokens under range rows, as compounds of annotated sentences; those with an allowed key, here of an even number of letters."""
    _annotated(t, ranges=True).repartition("f").write.partitionBy("f").option("maxRecordsPerFile", 1).text(folder)
    rows = files.annotated_rows(files.annotated_lines(spark, f"{folder}/*/*"))
    found = written(spark, files.compound_entries(rows).withColumn("n", F.lit(1)), "compounds")
    kept = files.gated(found, found.select(F.explode("keys").alias("key")).where("length(key) % 2 = 0"))
    return kept.select("form", F.array_join("keys", " ").alias("keys"), "l", "f", F.size("m").alias("members"))


_SIDE = {"पुं": "Gender=Masc", "स्त्री": "Gender=Fem", "नपुं": "Gender=Neut", "एक": "Number=Sing", "द्वि": "Number=Dual", "बहु": "Number=Plur", "उत्तम": "Person=1", "मध्यम": "Person=2", "प्रथम": "Person=3", "लट्": "Mood=Ind|Tense=Pres", "लङ्": "Mood=Ind|Tense=Impf", "लृट्": "Mood=Ind|Tense=Fut", "लिट्": "Tense=Perf", "लोट्": "Mood=Imp|Tense=Imp", "सम्बोधन": "Case=Voc", "Cpd": "Case=Cpd"}
_SIDE |= {str(i + 1): f"Case={c}" for i, c in enumerate(("Nom", "Acc", "Ins", "Dat", "Abl", "Gen", "Loc"))}
_TAGGED = "(select list_filter(ts, lambda x: x in ({0})) from (select string_split(f, ';') as ts))"
_NOMINAL = [_TAGGED.format("'पुं', 'स्त्री', 'नपुं'"), _TAGGED.format("'1', '2', '3', '4', '5', '6', '7', 'सम्बोधन', 'Cpd'"), _TAGGED.format("'एक', 'द्वि', 'बहु'")]
_FINITE = [_TAGGED.format("'लट्', 'लङ्', 'लृट्', 'लिट्', 'लोट्'"), _TAGGED.format("'उत्तम', 'मध्यम', 'प्रथम'"), _NOMINAL[2]]
_PLAIN = "p in ('noun', 'verb') and regexp_matches(f, '^[^;,|/ \"；、]+(;[^;,|/ \"；、]+)*$') and len(list_distinct(string_split(f, ';'))) = len(string_split(f, ';')) and list_has_all([{0}], string_split(f, ';'))"


@query(f"""with e as (select distinct entry_id, p, f from morph_entries where {_PLAIN.format(', '.join(map(duck.quote, _SIDE)))}), s as (select entry_id, p, case when p = 'noun' then [{', '.join(_NOMINAL)}] else [{', '.join(_FINITE)}] end as g, f from e)
 select entry_id, p, array_to_string(flatten(g), ';') as f from s where list_max(list_transform(g, lambda x: len(x))) <= 1""")
def mapped_features(spark, t, folder):
    """Tags of morph entries written as features of the annotation scheme, in its order, and mapped back to tags."""
    from tantu.functions import feats

    e = t("morph_entries").select("entry_id", "p", "f").distinct().where(F.col("p").isin("noun", "verb"))
    tags = F.split("f", ";")
    known = F.array(*[F.lit(k) for k in _SIDE])
    e = e.where((F.size(F.array_except(tags, known)) == 0) & (F.size(F.array_distinct(tags)) == F.size(tags)))
    side = F.create_map(*[F.lit(x) for kv in _SIDE.items() for x in kv])
    pairs = F.array_sort(F.flatten(F.transform(tags, lambda x: F.split(side[x], r"\|"))))
    names = F.transform(pairs, lambda x: F.substring_index(x, "=", 1))
    e = e.where(F.size(F.array_distinct(names)) == F.size(names))
    once = F.when(F.col("p") == "noun", F.forall(names, lambda x: x.isin("Gender", "Case", "Number"))).otherwise(F.lit(True))
    e.where(once).select("entry_id", F.concat_ws("\t", F.col("entry_id").cast("string"), F.lit("a"), F.lit("a"), F.when(F.col("p") == "noun", "NOUN").otherwise("VERB"), F.lit("_"), F.array_join(pairs, "|")).alias("value")).select("value").write.text(folder)
    c = F.split("value", "\t")
    upos, parsed = c[3], feats.parse_feats(c[5])
    return spark.read.text(folder).select(c[0].cast("bigint").alias("entry_id"), feats.map_pos(upos, parsed).alias("p"), feats.map_feats(upos, parsed).alias("f"))


@query(f"""with {corpus._OCC}, {TOKENS}, one as (select work_id, ref, token_index, min({{l: parses[1]->>'l', p: parses[1]->>'p', f: parses[1]->>'f'}}) as o from occ group by all), tp as ({corpus.SQL['top_parses']}), du as (select form, min({{l: l, p: p, f: f}}) as t, min(hidden) as hidden from tp group by form)
 select unit_id, toks.token_index, toks.form, coalesce(o, t).l as l, coalesce(o, t).p as p, coalesce(o, t).f as f, case when o is not null then 'occurrence' when t is not null then 'ranked' end as source, case when o is null then hidden end as hidden
 from toks left join one on toks.work_id = one.work_id and toks.ref = one.ref and toks.token_index = one.token_index left join du on toks.form = du.form""")
def shown_parses(spark, t, folder):
    """The parse under each token of the units: of its occurrence, else the best ranked of its form."""
    tokens = reading.tokens(t("work_units"))
    occ = reading.with_occurrence(tokens, reading.occurrence_parses(t("occ_index"))).where("parse is not null").select("unit_id", "token_index", "parse.l", "parse.p", "parse.f")
    best = ordered.first_by(ranking.top_parses(corpus._ranked(t), ["form"]).select("form", "l", "p", "f", "hidden"), ["form"], ["l", "p", "f", "hidden"])
    top = tokens.select("unit_id", "token_index", "form").join(best, "form").drop("form")
    return ranking.shown_parses(tokens.select("unit_id", "token_index", "form"), occ, top, ["unit_id", "token_index"])


@query(f"with {TOKENS} select distinct work_id, form from toks where form <> '' and work_id in (select work_id from works where coalesce(lang, 'sa') <> 'pi')")
def work_tokens(spark, t, folder):
    """The token set of each catalogued work, less those whose language is Pali."""
    return reading.work_tokens(reading.tokens(t("work_units")), t("works"))


_ROWS = f"""{UNITS}, tk as (select unit_id, work_id, regexp_replace(ref, '\\.[^.]*$', '') as part, i as n, regexp_replace({duck.dev_to_iast('words[i]')}, '\\s', '', 'g') as w from (select *, unnest(range(1, len(words) + 1)) as i from units) where work_id is not null and words[i] <> ''),
 us as (select work_id, part, unit_id, count(*) as k from tk group by all), up as (select *, row_number() over (partition by work_id, part order by unit_id) - 1 as sentence, coalesce(sum(k + 2) over (partition by work_id, part order by unit_id rows between unbounded preceding and 1 preceding), 0) as start from us),
 rw as (select tk.work_id, tk.part, tk.unit_id, n, sentence, start + row_number() over (partition by tk.unit_id order by n) as line_no, lower(w) as form, {duck.iast_to_dev('w')} as l, '1;' || case when n % 2 = 0 then 'एक' else 'बहु' end as f from tk join up using (unit_id)),
 en as (select *, len({duck.form_keys('form')}) > 0 and l <> '' as usable from rw), isl as (select *, sum((not usable)::int) over (partition by unit_id order by n) as island from en), ok as (select *, translate(form, '''’', '') as b, row_number() over (partition by unit_id, island order by n) as nth from isl where usable),
 sp as (select *, lag(b, 1) over w as b1, lag(b, 2) over w as b2, lag(b, 3) over w as b3 from ok window w as (partition by unit_id, island order by n)),
 ru as (select sentence, line_no, 2 as n, b1 || b as form, l, f from sp where nth >= 2 union all select sentence, line_no, 3, b2 || b1 || b, l, f from sp where nth >= 3 union all select sentence, line_no, 4, b3 || b2 || b1 || b, l, f from sp where nth >= 4),
 kp as (select *, {duck.form_keys('form')} as ks from ru where length(form) between 8 and 48 and l <> 'न')"""
SQL["fused_spans"] = f"with {_ROWS} select sentence::bigint as sentence, line_no::int as line_no, n, form, array_to_string(ks, ' ') as keys, l, 'noun' as p, f, n as members from kp where len(ks) > 0"
