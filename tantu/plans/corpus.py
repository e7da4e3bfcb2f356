"""Queries of the corpus operators over the test tables, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tantu.functions import feats, gloss, keys, misc, translit
from tantu.operators import build, lookup, ordered, ranking, reading, search, stores
from tantu.plans import duck, duckrank
from tantu.plans.duck import ELEMENTS, PLACED, TOKENS, quote
from tantu.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query; it gets the function that reads a table by its name."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, path: f(partial(table, spark, path))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# Reading ---------------------------------------------------------------------------------------------------------------


@query(f"with {TOKENS} select unit_id, work_id, ref, token_index, form from toks")
def unit_tokens(t):
    return reading.tokens(t("work_units"))


@query("""select distinct work_id, coalesce(trim(title), '') as title, coalesce(trim(title_zh), '') as title_zh, coalesce(lang, 'sa') as lang, '#/' || work_id as route,
 work_id in (select work_id from trans_files where lang = 'en') as has_en, work_id in (select work_id from trans_files where lang = 'zh') as has_zh,
 work_id not in (select work_id from trans_files where lang in ('en', 'zh')) as untranslated from works where coalesce(lang, 'sa') <> 'pi'""")
def catalog_works(t):
    langs = t("trans_files").where("work_id is not null").groupBy("work_id").agg(F.max((F.col("lang") == "en").cast("int")).alias("en"), F.max((F.col("lang") == "zh").cast("int")).alias("zh"))
    w = t("works").distinct().withColumn("lang", F.coalesce("lang", F.lit("sa"))).where("lang <> 'pi'").join(langs, "work_id", "left")
    en, zh = F.coalesce(F.col("en") == 1, F.lit(False)), F.coalesce(F.col("zh") == 1, F.lit(False))
    text = lambda c: F.trim(F.coalesce(c, F.lit(""))).alias(c)
    return w.select("work_id", text("title"), text("title_zh"), "lang", misc.work_route(F.col("work_id")).alias("route"), en.alias("has_en"), zh.alias("has_zh"), (~en & ~zh).alias("untranslated"))


_Q = "Katha"
_HIT = lambda c: f"(coalesce(contains({duck.strip_accents(c)}, {quote(_Q.lower())}), false) or coalesce(contains({c}, {quote(_Q)}), false))"


@query(f"""with w as (select distinct * from works), h as (select *, bool_or({_HIT('author_key')}) over (partition by author_key) as a, {_HIT('title')} or {_HIT('title_zh')} as b from w), f as (select * from h where a or b)
 select work_id, author_key, title, title_zh, (select count(distinct coalesce(author_key, '')) from f) as n_authors, (select count(*) from f) as n_works from f""")
def catalog_filter(t):
    return search.catalog_filter(t("works").distinct(), _Q).select("work_id", "author_key", "title", "title_zh", "n_authors", "n_works")


@query()
def natural_titles(t):
    d = t("documents").where("work_id is not null and title is not null").select("work_id", "title").distinct()
    placed = ordered.ranked_overall(d.withColumn("k", misc.natural_key(F.col("title"))), ["k", "work_id", "title"])
    return placed.select("work_id", "title", F.col("place").cast("int").alias("place"))


SQL["natural_titles"] = """select work_id, title, row_number() over (order by array_to_string(list_transform(regexp_extract_all(lower(title), '\\d+|\\D+'), lambda p: case when regexp_matches(p, '^\\d+$') then lpad(p, 20, '0') else p end), ''), work_id)::int as place
 from (select distinct work_id, title from documents where work_id is not null and title is not null)"""


@query(f"with {PLACED} select unit_id, work_id, ref, idx, (idx // 30)::int as page, idx % 30 = 0 as opens, idx % 5 = 0 as badge from placed")
def unit_pages(t):
    return reading.pages(reading.placed_units(t("work_units"))).select("unit_id", "work_id", "ref", "idx", "page", "opens", "badge")


@query(f"with {PLACED} select work_id, count(*) as units, greatest(1, ceil(count(*) / 30))::int as pages from placed group by work_id")
def page_counts(t):
    return reading.page_counts(reading.placed_units(t("work_units")))


@query(f"""with {PLACED}, pl as (select work_id, ref, min(idx) as idx from placed group by all), q as (select distinct work_id, ref from parse_groups where ref is not null)
 select work_id, ref, (idx // 30)::int as page, idx is not null and idx // 30 <= 40 as reached from q left join pl using (work_id, ref)""")
def jump_targets(t):
    return reading.jump_targets(reading.placed_units(t("work_units")), t("parse_groups").where("ref is not null").select("work_id", "ref").distinct())


@query(f"""with {ELEMENTS}, n as (select file_id, pos, ref, row_number() over (partition by file_id, ref order by pos) - 1 as n from elements where ref is not null)
 select file_id, pos, ref, case when n = 0 then ref when n <= 26 then ref || chr((96 + n)::int) else ref || n end as dom_ref from n""")
def element_refs(t):
    rows = reading.translation_units(t("trans_files")).where("ref is not null").select("file_id", "pos", "ref")
    return reading.unique_refs(rows, ["file_id"], ["pos"])


@query(f"with {ELEMENTS} select file_id, work_id, part_ref, lang, pos, ref, text from elements")
def translation_elements(t):
    return reading.translation_units(t("trans_files"))


_BY_REF = "select work_id, ref, text from elements where lang = '{0}' and ref is not null and trim(text) <> '' qualify row_number() over (partition by work_id, ref order by file_id, pos, text) = 1"


@query(f"with {ELEMENTS} {_BY_REF.format('zh')}")
def zh_texts(t):
    return reading.texts_by_ref(reading.translation_units(t("trans_files")), "zh")


@query(f"with {ELEMENTS} {_BY_REF.format('en')}")
def en_texts(t):
    return reading.texts_by_ref(reading.translation_units(t("trans_files")), "en")


@query(f"""with {PLACED}, {ELEMENTS}, zh as ({_BY_REF.format('zh')}), en as ({_BY_REF.format('en')}), eng as (select * from elements where lang = 'en' and trim(text) <> ''),
 f as (select work_id, part_ref, min(file_id) as file_id from eng group by all), p as (select work_id, part_ref, pos as at, min(text) as text from eng join f using (work_id, part_ref, file_id) group by all),
 u as (select *, regexp_replace(ref, '\\.[^.]*$', '') as part_ref from placed), v as (select *, row_number() over (partition by work_id, part_ref order by idx) - 1 as at from u)
 select unit_id, v.work_id, v.ref, coalesce(zh.text, '—') as zh, coalesce(en.text, p.text, '—') as en from v left join zh on v.work_id = zh.work_id and v.ref = zh.ref
 left join en on v.work_id = en.work_id and v.ref = en.ref left join p on v.work_id = p.work_id and v.part_ref = p.part_ref and v.at = p.at""")
def sidebar(t):
    return reading.beside(reading.placed_units(t("work_units")), reading.translation_units(t("trans_files")))


@query(f"""with {PLACED}, {ELEMENTS}, zh as ({_BY_REF.format('zh')}), en as ({_BY_REF.format('en')})
 select unit_id, v.work_id, v.ref, coalesce(zh.text, en.text, '—') as line, zh.text is null and en.text is not null as missing_zh
 from placed v left join zh on v.work_id = zh.work_id and v.ref = zh.ref left join en on v.work_id = en.work_id and v.ref = en.ref""")
def zh_lines(t):
    return reading.zh_line(reading.placed_units(t("work_units")), reading.translation_units(t("trans_files")))


_SIDES = f"""with {PLACED}, {ELEMENTS}, e as (select distinct file_id, work_id, part_ref, ref, pos from elements), fs as (select distinct file_id, work_id, part_ref from e),
 u as (select *, regexp_replace(ref, '\\.[^.]*$', '') as part_ref from placed), l as (select fs.file_id, u.ref, (row_number() over (partition by fs.file_id order by u.idx) - 1)::int as pos from u join fs using (work_id, part_ref)),
 a as (select *, row_number() over (partition by file_id, ref order by pos) as n from l), b as (select *, row_number() over (partition by file_id, ref order by pos) as n from e),
 r as (select a.file_id, a.pos as left_pos, b.pos as right_pos, 'ref' as how from a join b on a.file_id = b.file_id and a.ref = b.ref and a.n = b.n),
 ra as (select file_id, pos from a where (file_id, pos) not in (select (file_id, left_pos) from r)), rb as (select file_id, pos from b where (file_id, pos) not in (select (file_id, right_pos) from r))
 select * from r union all select coalesce(ra.file_id, rb.file_id), ra.pos, rb.pos, case when ra.pos is null then 'right' when rb.pos is null then 'left' else 'pos' end from ra full join rb on ra.file_id = rb.file_id and ra.pos = rb.pos"""


@query(_SIDES)
def drawer_pairs(t):
    elements = reading.translation_units(t("trans_files")).select("file_id", "work_id", "part_ref", "ref", "pos").distinct()
    files = elements.select("file_id", "work_id", "part_ref").distinct()
    units = reading.placed_units(t("work_units")).withColumn("part_ref", F.regexp_replace("ref", r"\.[^.]*$", "")).join(files, ["work_id", "part_ref"])
    left = units.withColumn("pos", F.row_number().over(Window.partitionBy("file_id").orderBy("idx")) - 1).select("file_id", "ref", "pos")
    return reading.paired_once(left, elements.select("file_id", "ref", "pos"), ["file_id"])


_SAYS = "('said', 'says', 'replied', 'answered', 'asked', 'exclaimed', 'continued', 'rejoined', 'added', 'observed', 'remarked', 'returned', 'responded', 'cried', 'declared', 'stated', 'inquired')"
_NONE = """('He', 'She', 'They', 'It', 'We', 'You', 'I', 'The', 'This', 'That', 'There', 'Here', 'Then', 'When', 'Why', 'How', 'What', 'Where', 'Which', 'Who', 'Whom', 'A', 'An', 'And', 'But', 'Or', 'If', 'So', 'Because',
 'Since', 'Although')"""


@query(f"""with {ELEMENTS}, s as (select *, list_slice(regexp_extract_all(ltrim(text, ' \t\n\r'), '[A-Za-z]+|[^A-Za-z\\s]'), 1, 3) as t from elements where lang = 'en'),
 c as (select *, regexp_matches(t[1], '^[A-Z][a-z]+$') as a, regexp_matches(t[1], '^[A-Z][a-z]+$') and regexp_matches(t[2], '^[A-Z][a-z]+$') as b from s),
 n as (select *, case when a and t[2] = ':' or b and t[3] = ':' then t[1] not in {_NONE} when lower(t[1]) in ('soc', 'ion', 'cri', 'ceb', 'sim') and t[2] in (':', '.') then true
 when regexp_matches(t[1], '^[A-Z][a-z]') and (lower(t[2]) in {_SAYS} or length(t[2]) >= 2 and lower(t[3]) in {_SAYS}) then t[1] not in {_NONE} else false end as hit from c), k as (select *, coalesce(hit, false) as h from n)
 select file_id, count(*) as elements, count_if(h)::bigint as speakers, count_if(h) / count(*) as share, count_if(h) / count(*) >= 0.75 as trusted from k group by file_id""")
def speaker_shares(t):
    return reading.speaker_shares(reading.translation_units(t("trans_files")).where("lang = 'en'"), misc.english_speaker(F.col("text")))


@query("""select distinct file_id, work_id, case when coalesce(translator, '') = '' and pub_year is not null then array_to_string(list_filter([nullif(pub_year, ''), nullif(license, '')], lambda x: x is not null), ' · ')
 else array_to_string(list_filter([nullif(array_to_string(list_filter(['Trans. ' || nullif(translator, ''), nullif(pub_year, '')], lambda x: x is not null), ' '), ''), nullif(license, '')], lambda x: x is not null), ' · ') end as credit, coalesce(note, '') as note from trans_files""")
def credit_lines(t):
    f = t("trans_files").select("file_id", "work_id", "translator", "pub_year", "license", "note").distinct()
    return f.select("file_id", "work_id", misc.credit_line(F.col("translator"), F.col("pub_year"), F.col("license")).alias("credit"), F.coalesce("note", F.lit("")).alias("note")).distinct()


_OCC = """oi as (select * from occ_index where source = 'dcs' and edition = 'source-locked' and refs is not null),
 od as (select work_id, case when occurrence is not null then to_json(occurrence) else coalesce(json_extract(raw_json, '$.occurrence'), raw_json::json) end as doc from oi),
 orf as (select work_id, ref, json_extract(doc, '$."' || ref || '"') as toks from (select work_id, doc, unnest(json_keys(doc)) as ref from od)),
 otk as (select work_id, ref, token::int as token_index, json_extract(toks, '$."' || token || '"') as ps from (select *, unnest(json_keys(toks)) as token from orf where json_type(toks) = 'OBJECT')),
 occ as (select work_id, ref, token_index, parses from (select work_id, ref, token_index, case json_type(ps) when 'ARRAY' then ps::json[] when 'OBJECT' then [ps] else [] end as parses from otk)
 where len(parses) > 0 and len(list_filter(parses, lambda p: coalesce(p->>'source' = 'dcs' and (p->>'confidence')::double = 1.0, false))) = len(parses))"""


@query(f"with {_OCC} select distinct work_id, ref, token_index, parses[1]->>'l' as l, parses[1]->>'p' as p, len(parses)::int as n from occ")
def occurrence_parses(t):
    first = F.element_at("parses", 1)
    return reading.occurrence_parses(t("occ_index")).select("work_id", "ref", "token_index", first["l"].alias("l"), first["p"].alias("p"), F.size("parses").alias("n")).distinct()


@query(f"""with {TOKENS}, {_OCC}, one as (select work_id, ref, token_index, min({{l: parses[1]->>'l', p: parses[1]->>'p', f: parses[1]->>'f'}}) as parse from occ group by all)
 select unit_id, toks.work_id, toks.ref, toks.token_index, form, parse.l as l, parse.p as p from toks left join one on toks.work_id = one.work_id and toks.ref = one.ref and toks.token_index = one.token_index""")
def token_occurrence(t):
    units = t("work_units")
    joined = reading.with_occurrence(reading.tokens(units), reading.occurrence_parses(t("occ_index"), units=units))
    return joined.select("unit_id", "work_id", "ref", "token_index", "form", "parse.l", "parse.p")


# Building --------------------------------------------------------------------------------------------------------------


@query()
def analysis_readings(t):
    rows = t("analysis_rows").select("row_id", "morph_analysis").distinct()
    return rows.select("row_id", F.posexplode(feats.parse_analysis(F.col("morph_analysis"))).alias("pos", "e")).select("row_id", "pos", "e.l", "e.p", "e.f")


SQL["analysis_readings"] = """with p as (select row_id, trim(x) as path, i from (select row_id, unnest(string_split(morph_analysis, '/')) as x, unnest(range(len(string_split(morph_analysis, '/')))) as i from (select distinct row_id, morph_analysis from analysis_rows where morph_analysis is not null))),
 q as (select *, trim(regexp_extract(path, '^([^{}]*)', 1)) as l, list_filter(list_transform(list_slice(regexp_split_to_array(path, '[{}]'), 2, 99), lambda t: trim(t)), lambda t: t <> '') as tags from p where path <> '' and (not contains(path, '{') or contains(path, '}')))
 select row_id, (row_number() over (partition by row_id order by i) - 1)::int as pos, l,
 case when len(tags) = 0 then '' when tags[1] = 'अव्य' then 'indecl' when tags[1] in ('पुं', 'स्त्री', 'नपुं') then 'noun' when regexp_matches(tags[1], 'प्रथम|मध्यम|उत्तम') then 'verb' else 'part' end as p,
 case when tags[1] = 'अव्य' then array_to_string(list_slice(tags, 2, 99), ';') else array_to_string(tags, ';') end as f from q where l <> ''"""

_READ = """a as (select distinct * from analysis_rows), b as (select *, list_filter(list_transform(string_split(coalesce(morph_in_context, ''), '/'), lambda x: trim(x)), lambda x: x <> '' and (not contains(x, '{') or contains(x, '}')) and trim(regexp_extract(x, '^([^{}]*)', 1)) <> '') as paths,
 try_cast(trim(poem) as double) as place, try_cast(try_cast(trim(chpatno) as double) as int) as chapter, try_cast(try_cast(trim(slokano) as double) as int) as verse from a),
 c as (select *, coalesce(word <> '', false) and place is not null and len(paths) = 1 and chapter is not null and verse is not null as good from b)"""


@query(f"""with {_READ} select work_id, chapter || '.' || verse as ref, (row_number() over (partition by work_id, chapter, verse order by place, row_id) - 1)::int as token_index, word, trim(regexp_extract(paths[1], '^([^{{}}]*)', 1)) as l,
 replace(english_meaning, '_', ' ') as g, row_id from c where good""")
def verse_order(t):
    placed, _ = build.occurrence_rows(t("analysis_rows").distinct())
    return placed.select("work_id", "ref", "token_index", "word", "l", "g", "row_id")


@query(f"with {_READ} select work_id, row_id, array_to_string(list_filter([chapter::varchar, verse::varchar], lambda x: x is not null), '.') as ref, coalesce(word, '') as word from c where not good")
def omitted_rows(t):
    return build.occurrence_rows(t("analysis_rows").distinct())[1]


@query(f"""with {_READ} select work_id, count_if(good)::bigint as reader_tokens, count_if(good)::bigint as aligned, 100.0::double as alignment_pct, count_if(not good)::bigint as omitted from c group by work_id having count_if(good) > 0""")
def edition_report(t):
    return build.edition_report(*build.occurrence_rows(t("analysis_rows").distinct()))


@query(f"""with {_READ} select work_id, ref, array_to_string(list(word order by place, row_id), ' ') as words from (select *, chapter || '.' || verse as ref from c where good) group by work_id, ref""")
def edition_units(t):
    units = build.edition(build.occurrence_rows(t("analysis_rows").distinct())[0])
    return units.select("work_id", "ref", F.array_join("words", " ").alias("words"))


@query()
def morph_shards(t):
    return build.morph_shards(build.analysis_entries(t("analysis_rows").distinct()))


@query()
def morph_with_fallbacks(t):
    shards = build.morph_shards(build.analysis_entries(t("analysis_rows").distinct()))
    wanted = reading.tokens(t("work_units")).select(translit.slp1_key(F.col("form")).alias("key")).where(keys.valid_key(F.col("key"))).distinct()
    return build.with_fallbacks(shards, wanted, lookup.gloss_table(t("headwords")).select("key"))


_ENTRY = "select distinct slp_key, ord_no, l, p, f, g, x, m, built_at from morph_entries"


_MERGE = ["ord_no", "built_at", "l", "p", "f"]  # entries that two deliveries place alike stand in the order of their own values
_MERGED = f"""e as ({_ENTRY}), s as (select *, built_at is not null and built_at >= timestamptz '2023-10-01 00:00:00+00' as late from e where slp_key is not null),
 d as (select slp_key, l, p, f, min({{s: late::int, o: coalesce(ord_no, -1), b: coalesce(built_at, timestamptz '1900-01-01 00:00:00+00')}}) as place, bool_and(late) as is_new from s group by slp_key, l, p, f),
 mg as (select slp_key, l, p, f, (row_number() over (partition by slp_key order by place.s, place.o, place.b, l nulls first, p nulls first, f nulls first) - 1)::int as ord, is_new, strftime(place.b, '%Y-%m') as origin from d)"""


@query(f"with {_MERGED} select slp_key, l, p, f, ord, is_new from mg")
def merged_shards(t):
    existing, new = _halves(t)
    return ordered.ordered_merge(existing, new, ["slp_key"], ["l", "p", "f"], _MERGE).select("slp_key", "l", "p", "f", "ord", "is_new")


def _halves(t):
    entries = t("morph_entries").where("slp_key is not null").select("slp_key", "ord_no", "l", "p", "f", "built_at").distinct()
    late = F.col("built_at").isNotNull() & (F.col("built_at") >= F.to_timestamp(F.lit("2023-10-01 00:00:00")))
    return entries.where(~late), entries.where(late)


@query("select 0::bigint as added_again")
def merge_idempotent(t):
    existing, new = _halves(t)
    merged = ordered.ordered_merge(existing, new, ["slp_key"], ["l", "p", "f"], _MERGE).drop("is_new", "ord")
    again = ordered.ordered_merge(merged, new, ["slp_key"], ["l", "p", "f"], _MERGE)
    return again.agg(F.count_if("is_new").alias("added_again"))


@query()
def merge_stats(t):
    existing, new = _halves(t)
    origin = F.date_format("built_at", "yyyy-MM")
    a, b = existing.withColumn("origin", origin), new.withColumn("origin", origin)
    return ordered.merge_stats(ordered.ordered_merge(a, b, ["slp_key"], ["l", "p", "f"], _MERGE), b, ["slp_key"], "origin")


# Lookup ----------------------------------------------------------------------------------------------------------------


@query("select head_id, iast from headwords")
def headword_iast(t):
    return t("headwords").select("head_id", translit.dev_to_iast(F.col("u")).alias("iast"))


@query("select head_id, u from headwords")
def headword_deva(t):
    return t("headwords").select("head_id", translit.iast_to_dev(F.col("iast")).alias("u"))


@query(f"select head_id, {duck.iast_to_slp1('iast')} as slp1, lower({duck.iast_to_slp1('iast')}) as key from headwords")
def headword_keys(t):
    return t("headwords").select("head_id", translit.dev_to_slp1(F.col("u")).alias("slp1"), translit.slp1_key_for(F.col("iast")).alias("key"))


@query("select head_id, u, iast, not (regexp_matches(iast, '^[a-z]+$') and regexp_matches(iast, 'ai|au')) as same from headwords")
def script_round_trips(t):
    """Every headword through Harvard-Kyoto and SLP1 and back, from both scripts.

    Plain letters count as Harvard-Kyoto, whose ai and au stay two letters: such words have another key than in Devanagari.
    """
    u, i = F.col("u"), F.col("iast")
    there = translit.transliterate(translit.transliterate(u, "deva", "hk"), "hk", "slp1")
    return t("headwords").select("head_id", translit.transliterate(there, "slp1", "deva").alias("u"), translit.transliterate(translit.transliterate(i, "iast", "slp1"), "slp1", "iast").alias("iast"), (translit.slp1_key(u) == translit.slp1_key(i)).alias("same"))


@query(f"with {TOKENS} select distinct form, {duck.norm_sa('form')} as folded from toks where form is not null")
def folded_forms(t):
    return reading.tokens(t("work_units")).where("form is not null").select("form", translit.norm_sa(F.col("form")).alias("folded")).distinct()


_PLACE = "list_transform(string_split(ref, '.'), lambda p: coalesce(try_cast(regexp_extract(p, '^(\\d+)', 1) as int), -1))"
_POST = f"""{TOKENS}, post as (select term, work_id, count(*) as n, arg_min(ref, {{a: {_PLACE}, b: ref, c: unit_id, d: token_index}}) as first_ref from (select *, {duck.norm_sa('form')} as term from toks) where term <> '' group by all)"""


@query(f"with {_POST} select term[1:1] as letter, term, work_id, n, first_ref from post")
def word_index(t):
    return _postings(t)


def _postings(t):
    return search.postings(reading.tokens(t("work_units")), [F.struct(*reading.ref_place()), "unit_id", "token_index"])


_WORDS = ["ālīdīru", "चिपम्", "naśṭula", "utāja", "zzzz", "ā"]
_WORD_VALUES = ", ".join(f"({quote(w)})" for w in _WORDS)


@query(f"""with {_POST}, q as (select col0 as query, {duck.norm_sa('col0')} as k from (values {_WORD_VALUES})), v as (select query, unnest(list_filter([k, case when regexp_matches(k, '[mh]$') then k[:-2] end, k || 'h', k || 'm'], lambda x: x is not null)) as term,
 unnest(range(4)) as variant from q where regexp_matches(k, '^[a-z].')), w as (select query, min(variant) as variant, arg_min(term, variant) as term from v where term in (select term from post) group by query),
 h as (select *, count(*) over (partition by query) as n_works, (sum(n) over (partition by query))::bigint as total, (row_number() over (partition by query order by work_id))::int as rank from w join post using (term)),
 c as (select distinct work_id, title from works) select query, term, variant::int as variant, n_works, total, rank, work_id, title, first_ref from h join c using (work_id) where rank <= 8""")
def word_search(t):
    q = t("works").sparkSession.createDataFrame([(w,) for w in _WORDS], "query string")
    return search.word_search(q, _postings(t), t("works").select("work_id", "title").distinct())


SQL["word_search"] = SQL["word_search"].replace(
    "unnest(list_filter([k, case when regexp_matches(k, '[mh]$') then k[:-2] end, k || 'h', k || 'm'], lambda x: x is not null)) as term,\n unnest(range(4)) as variant from q where regexp_matches(k, '^[a-z].')",
    "unnest(tries) as term, unnest(range(len(tries))) as variant from (select query, k, case when regexp_matches(k, '[mh]$') then [k, left(k, length(k) - 1), k || 'h', k || 'm'] else [k, k || 'h', k || 'm'] end as tries from q where regexp_matches(k, '^[a-z].'))",
)


@query(f"""with {ELEMENTS}, f as (select work_id, file_id, ref, pos, {duck.norm_sa('text')} as folded from elements), h as (select *, instr(folded, 'strangedefeat') - 1 as hit from f where contains(folded, 'strangedefeat')),
 c as (select distinct work_id, title from works), r as (select *, (row_number() over (order by work_id, file_id, pos))::int as rank from h join c using (work_id))
 select (select count(*) from h) as total, rank, work_id, title, ref, (case when greatest(0, hit - 55) > 0 then '…' else '' end) || folded[greatest(0, hit - 55) + 1:least(length(folded), hit + 13 + 65)] || (case when least(length(folded), hit + 13 + 65) < length(folded) then '…' else '' end) as snippet
 from r where rank <= 8""")
def passage_search(t):
    folded = search.folded_snippets(reading.translation_units(t("trans_files")).drop("lang", "part_ref").distinct())
    return search.passage_search(folded, "Strange defeat", t("works").select("work_id", "title").distinct())


_KNOWN = f"known as (select distinct {duck.slp1_key_for('u')} as key from headwords)"


@query()
def surface_index(t):
    return _index(t)


def _index(t):
    return lookup.surface_index(reading.tokens(t("work_units")), t("morph_entries").where("slp_key is not null").select(F.col("slp_key").alias("key")))


@query()
def work_slices(t):
    return lookup.work_slices(reading.tokens(t("work_units")), _index(t))


@query()
def scoped_keys(t):
    """Keys of the tokens of the parse groups' works: by the work's slice, or overall where a work has none."""
    index = _index(t)
    forms = t("parse_groups").where("lemma is not null and lemma <> ''").select("work_id", F.col("lemma").alias("form"))
    return lookup.scoped_keys(forms, lookup.work_slices(reading.tokens(t("work_units")), index), index)


@query()
def slice_sizes(t):
    return build.slice_sizes(_index(t))


@query()
def token_analyses(t):
    tokens_ = reading.tokens(t("work_units"))
    found = lookup.analyses(tokens_, _index(t), t("morph_entries").dropDuplicates(["entry_id"]))
    return lookup.published(found.select("form", "key", "ord_no", "l", "p", "f", "g", "x")).distinct()


@query()
def lemma_glosses(t):
    lemmas = t("parse_groups").select("lemma").where("lemma <> ''").distinct()
    return lookup.glosses(lemmas, lookup.gloss_table(t("headwords")), filled=True)


@query(f"""with h as (select distinct {duck.slp1_key_for('u')} as key, u, g from headwords), q as (select distinct iast[1:5] as query from headwords where length(iast) >= 5), k as (select query, {duck.slp1_key_for('query')} as qk from q),
 k2 as (select * from k where regexp_matches(qk, '^[a-z].+')), m as (select query, key, u, g, min(tier) as tier from (select query, key, u, g, case when key = qk then 0 when key = lower(replace(qk, 'z', 'S')) then 1 else 9 end as tier
 from k2 join h on key = qk or key = lower(replace(qk, 'z', 'S')) or (starts_with(key, qk) and length(key) > length(qk))) group by all)
 select query, (row_number() over (partition by query order by tier, key, u, g))::int as rank, key, u, g from m qualify rank <= 20""")
def dictionary_search(t):
    h = t("headwords")
    return lookup.dictionary_entries(h.where("length(iast) >= 5").select(F.substring("iast", 1, 5).alias("query")), lookup.gloss_table(h))


@query(f"""with {TOKENS}, {_KNOWN}, f as (select form, {duck.slp1_key_for('form')} as fk from (select distinct form from toks where form is not null)), e as (select form, fk as key, 'exact' as how from f where fk in (select key from known)),
 p as (select form, fk[1:n] as key, n from (select *, unnest(range(4, length(fk))) as n from f where fk <> '' and fk not in (select key from known)))
 select * from e union all select form, arg_max(key, n), 'prefix' from p where key in (select key from known) group by form""")
def panel_entries(t):
    return lookup.panel_entry(reading.tokens(t("work_units")).where("form is not null"), lookup.gloss_table(t("headwords")))


@query(f"""with {_KNOWN}, m as (select distinct slp_key as key from morph_entries where slp_key is not null), w as (select distinct {duck.slp1_key_for('lemma')} as key from parse_groups where lemma <> ''), x as (select key from w where regexp_matches(key, '^[a-z~]+$') and key not in (select key from m)),
 t1 as (select key, left(key, length(key) - c) as stem, c from (select key, unnest([1, 2]) as c from x) where length(key) - c >= 3), t2 as (select key, arg_min(stem, c) as stem, 'trim' as tier from t1 where stem in (select key from m) group by key),
 y as (select key, left(key, n) as stem, n from (select key, unnest(range(3, length(key))) as n from x where key not in (select key from t2))) select * from t2 union all select key, arg_max(stem, n), 'mw' from y where stem in (select key from known) group by key""")
def fallback_stems(t):
    wanted = t("parse_groups").where("lemma <> ''").select(translit.slp1_key_for(F.col("lemma")).alias("key")).where(keys.valid_key(F.col("key"))).distinct()
    return lookup.fallback_stems(wanted, t("morph_entries").where("slp_key is not null").select(F.col("slp_key").alias("key")), lookup.gloss_table(t("headwords")).select("key"))


@query()
def coverage_by_work(t):
    return lookup.coverage(reading.tokens(t("work_units")), _index(t), t("morph_entries").where("slp_key is not null").select(F.col("slp_key").alias("key")))


@query(f"""with {TOKENS}, k as (select distinct {duck.strip_accents('u')} as form from headwords), f as (select work_id, {duck.strip_accents('form')} as form from toks) select work_id, count(*) as total, count_if(k.form is null)::bigint as unknown from f left join k on f.form = k.form group by work_id""")
def vocabulary_chip(t):
    return lookup.unknown_forms(reading.tokens(t("work_units")), t("headwords").select(translit.strip_accents(F.col("u")).alias("form")))


@query("""with w as (select distinct work_id, author_key, row_number() over (order by work_id) as ord from (select distinct work_id, author_key from works)), q as (select distinct upper(work_id[1:6]) as query from works union select work_id from works union select author_key || '/' || work_id from works where author_key is not null),
 c as (select query, work_id, ord, case when lower(query) = lower(coalesce(author_key || '/', '') || work_id) and author_key is not null then 0 when lower(query) = lower(work_id) then 1 else 2 end as tier from q join w on lower(query) = lower(coalesce(author_key || '/', '') || work_id) or starts_with(lower(work_id), lower(query)))
 select query, arg_min(work_id, {a: tier, b: ord}) as work_id from c group by query""")
def resolve_works(t):
    w = t("works").select("work_id", "author_key").distinct()
    w = w.withColumn("ord", F.row_number().over(Window.orderBy("work_id")))
    q = w.select(F.upper(F.substring("work_id", 1, 6)).alias("query")).union(w.select("work_id")).union(w.where("author_key is not null").select(F.concat_ws("/", "author_key", "work_id"))).distinct()
    return lookup.resolve_work(q, w)


@query("""select distinct work_id, 'work' as page, author_key as author, work_id as work, ref from (select w.work_id, w.author_key, u.ref from works w join work_units u on w.work_id = u.work_id)""")
def routes(t):
    w = t("works").select("work_id", "author_key").distinct().join(t("work_units").select("work_id", "ref").distinct(), "work_id")
    path = F.concat(F.lit("#/"), F.coalesce(F.concat(F.col("author_key"), F.lit("/")), F.lit("")), F.col("work_id"), F.lit("?ref="), F.call_function("url_encode", F.col("ref")))
    r = misc.parse_route(path)
    return w.select("work_id", r["page"].alias("page"), r["author"].alias("author"), r["work_id"].alias("work"), r["ref"].alias("ref")).distinct()


# Analyses --------------------------------------------------------------------------------------------------------------

_PARSES = "e as (select distinct entry_id, slp_key, ord_no, l, p, f, g, x, m from morph_entries where slp_key is not null)"


@query(f"""with {_PARSES}, d as (select slp_key, coalesce(l, '') as l, {duck.pos_abbr('p')} as pos, {duck.compact('f')} as tags, coalesce(g, '') as g, ord_no, m is not null as rich from e)
 select slp_key, l, pos, tags, g, min(ord_no) as place, bool_or(rich) as rich from d group by slp_key, l, pos, tags, g""")
def displayed_parses(t):
    e = t("morph_entries").where("slp_key is not null").dropDuplicates(["entry_id"])
    d = ranking.dedupe_parses(e.select("slp_key", "ord_no", "l", "p", "f", "g", "x", "m"), ["slp_key"])
    tags = F.array_join(feats.compact_feats(F.col("f"))["main"], " ")
    return d.select("slp_key", F.coalesce("l", F.lit("")).alias("l"), feats.pos_abbr(F.col("p")).alias("pos"), tags.alias("tags"), F.coalesce("g", F.lit("")).alias("g"), "place", F.col("m").isNotNull().alias("rich"))


@query(f"with {_PARSES} select slp_key, l, p, f, x, min(ord_no) as ord_no from e group by slp_key, l, p, f, x")
def lexicon_parses(t):
    e = t("morph_entries").where("slp_key is not null").dropDuplicates(["entry_id"]).select("slp_key", "ord_no", "l", "p", "f", "x")
    return ranking.distinct_parses(e, ["slp_key"]).select("slp_key", "l", "p", "f", "x", "ord_no")


@query(f"""select distinct entry_id, {duck.pos_class('p', 'f')} as cls, {', '.join(f"array_to_string({duck.slot('f', n)}, '/') as {n}" for n in feats.SLOTS)} from morph_entries""")
def feature_slots(t):
    e = t("morph_entries").select("entry_id", "p", "f").distinct()
    return e.select("entry_id", feats.pos_class(F.col("p"), F.col("f")).alias("cls"), *[F.array_join(feats.slot(F.col("f"), n), "/").alias(n) for n in feats.SLOTS]).distinct()


_GROUPS = f"""{_PARSES}, r as (select slp_key, ord_no, entry_id, l, f, {duck.norm_lemma('l')} as k, {duck.pos_class('p', 'f')} as c, {' + '.join(f"len({duck.slot('f', n)})" for n in feats.SLOTS)} = 0 as bare from e),
 s as (select *, bool_and(bare) over (partition by slp_key) as every, count(*) over (partition by slp_key, k) as nk from r), z as (select slp_key, arg_max(k, {{a: nk, b: -ord_no, c: -entry_id}}) as modal from s group by slp_key),
 y as (select slp_key, case when every then modal else k end as lemma_key, case when every then 'indecl' else c end as cls, ord_no from s join z using (slp_key))"""


@query(f"with {_GROUPS} select slp_key, lemma_key, cls, min(ord_no) as first, count(*)::int as n from y group by all")
def grouped_parses(t):
    e = t("morph_entries").where("slp_key is not null").dropDuplicates(["entry_id"])
    return ranking.grouped(e.select("slp_key", "ord_no", "l", "p", "f", "g", "x"), ["slp_key"]).select("slp_key", "lemma_key", "cls", "first", F.size("members").alias("n"))


@query()
def ranked_groups(t):
    """Ranked readings of the first key spelling of each headword found in the morph table."""
    return _ranked(t).drop("members").withColumn("summary", F.array_join("summary", " "))


def _ranked(t):
    e = t("morph_entries").where("slp_key is not null").dropDuplicates(["entry_id"])
    h = t("headwords").select(F.col("u").alias("form"), translit.slp1_key_for(F.col("u")).alias("slp_key"))
    rows = e.join(h, "slp_key").select("form", "ord_no", "l", "p", "f", "g", "x")
    freq = ranking.lemma_tally(rows.select("form", "l"))
    gl = t("headwords").select(F.col("u").alias("l"), F.col("g").alias("gl"))
    return ranking.ranked_groups(rows, ["form"], freq, gl)


@query()
def top_parses(t):
    return ranking.top_parses(_ranked(t), ["form"])


@query(f"""with {_PARSES}, s as (select *, len(list_filter({duck.slot('f', 'kcase')}, lambda c: c = 'nom.')) > 0 as nom, len(list_filter({duck.slot('f', 'kcase')}, lambda c: c = 'acc.')) > 0 as acc, regexp_matches(trim(coalesce(l, '')), 'त्?$') as pt,
 {duck.norm_lemma('l')} as k, coalesce(({duck.slot('f', 'gender')})[1], '') as gd, coalesce(({duck.slot('f', 'number')})[1], '') as nb from e), h as (select *, bool_or(acc and pt) over (partition by slp_key, k, gd, nb) as has from s)
 select entry_id, slp_key from h where not (regexp_matches(l, '(म्|ं)$') and pt and nom and has)""")
def accusatives_kept(t):
    e = t("morph_entries").where("slp_key is not null").dropDuplicates(["entry_id"])
    return ranking.prefer_accusative(e.withColumn("form", F.col("l")), ["slp_key"]).select("entry_id", "slp_key")


@query(f"""select distinct entry_id, coalesce(len(k) >= 2 and list_contains({duck.tags('k[1].f')}, 'Cpd') and coalesce(k[len(k)].p, '') not in ('indecl', 'verb')
 and len(list_filter({duck.tags('k[len(k)].f')}, lambda t: t in ('1', '2', '3', '4', '5', '6', '7', 'सम्बोधन'))) > 0, false) as samasa from (select entry_id, list_slice(list_filter(coalesce(m, []), lambda x: x is not null), 1, 8) as k from morph_entries)""")
def samasa(t):
    return t("morph_entries").select("entry_id", feats.is_samasa(F.col("m")).alias("samasa")).distinct()


@query()
def compound_members(t):
    """Members of the first genuine compound of each key, with their tags and short gloss."""
    e = t("morph_entries").where("slp_key is not null").dropDuplicates(["entry_id"]).where(feats.is_samasa(F.col("m")))
    first = ordered.first_by(e.select("slp_key", "ord_no", "entry_id", "m"), ["slp_key"], ["ord_no", "entry_id"])
    rows = first.select("slp_key", F.posexplode(F.slice("m", 1, 8)).alias("pos", "x")).select("slp_key", "pos", "x.d", F.coalesce(F.nullif("x.l", F.lit("")), "x.d").alias("lemma"), F.array_join(feats.compact_feats(F.col("x.f"))["main"], " ").alias("tags"))
    g = lookup.glosses(rows.select("lemma").distinct(), lookup.gloss_table(t("headwords"))).select("lemma", gloss.compact_gloss(F.col("g")).alias("sense"))
    return rows.join(g, "lemma", "left").select("slp_key", "pos", "d", "lemma", "tags", "sense")


@query()
def short_glosses(t):
    g = t("mw_entries").select("mw_id", "g").distinct()
    return g.select("mw_id", gloss.compact_gloss(F.col("g")).alias("sense"), gloss.clip_gloss(F.col("g"), 40).alias("clipped"), gloss.gloss_identity(F.col("g")).alias("identity"))


@query("""with h as (select distinct mw_id, g, lower(array_to_string(regexp_extract_all(left(regexp_replace(coalesce(g, ''), '\\s+', ' ', 'g'), 48), '[A-Za-z0-9_]+|[^A-Za-z0-9_ ]'), ' ')) || ' ' as s from mw_entries),
 o as (select a || b || c || ' . of ' as opening from (values (''), ('as , ')) x(a), (values (''), ('m . '), ('f . '), ('n . ')) y(b), (values ('n'), ('name')) z(c))
 select mw_id, (select bool_or(starts_with(s, opening)) from o) as is_name, length(regexp_replace(coalesce(g, ''), '[^A-Za-z]', '', 'g')) >= 3 as useful from h""")
def gloss_kinds(t):
    return t("mw_entries").select("mw_id", gloss.is_name_gloss(F.col("g")).alias("is_name"), gloss.is_useful_gloss(F.col("g")).alias("useful")).distinct()


@query()
def gloss_repeats(t):
    """Which glosses of a key's parses are shown, repeated senses being suppressed."""
    e = t("morph_entries").where("slp_key is not null and g is not null").dropDuplicates(["entry_id"]).select("entry_id", "slp_key", "ord_no", "g")
    return ranking.suppress_repeats(e, ["slp_key"], ["ord_no", "entry_id"])


@query("""with r as (select distinct row_id, word, sandhied_word from analysis_rows where word is not null and sandhied_word is not null), l as (select *, least(length(word), length(sandhied_word)) as n from r)
 select row_id, word, sandhied_word, coalesce(list_max(list_filter(range(0, n + 1), lambda i: left(word, i) = left(sandhied_word, i))), 0)::int as prefix, coalesce(list_max(list_filter(range(0, n + 1), lambda i: right(word, i) = right(sandhied_word, i))), 0)::int as suffix from l""")
def affinities(t):
    r = t("analysis_rows").where("word is not null and sandhied_word is not null").select("row_id", "word", "sandhied_word").distinct()
    return r.select("row_id", "word", "sandhied_word", misc.common_prefix(F.col("word"), F.col("sandhied_word")).alias("prefix"), misc.common_suffix(F.col("word"), F.col("sandhied_word")).alias("suffix"))


@query(f"""with g as (select distinct group_id, members from parse_groups where len(members) >= 2), s as (select group_id, list_transform(members, lambda m: list_distinct({duck.tags('m.f')})) as sets from g)
 select group_id, (i - 1)::int as member, array_to_string(list_sort(list_filter(sets[i], lambda t: len(list_filter(sets, lambda z: list_contains(z, t))) < len(sets))), ' ') as tokens from (select *, unnest(range(1, len(sets) + 1)) as i from s)""")
def differing_tags(t):
    g = t("parse_groups").where("size(members) >= 2").select("group_id", F.transform("members", lambda m: feats.tag_tokens(m["f"])).alias("sets")).distinct()
    each = g.select("group_id", "sets", F.explode(F.sequence(F.lit(0), F.size("sets") - 1)).alias("member"))
    return each.select("group_id", "member", F.array_join(F.array_sort(misc.diff_tokens(F.col("sets"), F.col("member"))), " ").alias("tokens"))


@query("""select distinct work_id, (list_reduce(list_prepend(0::hugeint, list_transform(string_split(work_id, ''), lambda c: ascii(c)::hugeint)), lambda h, c: (h * 31 + c) % 4294967296) % 10)::int as color from works""")
def name_colors(t):
    return t("works").select("work_id", misc.hash_color(F.col("work_id")).alias("color")).distinct()


@query(f"with {TOKENS} select distinct form, case when regexp_matches(form, '[\\x{{0900}}-\\x{{097F}}]') then {duck.dev_to_iast('form')} else form end as iast, regexp_matches(form, '[\\x{{0900}}-\\x{{097F}}]') as deva from toks where form is not null")
def displayed_forms(t):
    f = reading.tokens(t("work_units")).where("form is not null").select("form").distinct()
    return f.select("form", misc.display(F.col("form"), "iast").alias("iast"), translit.has_devanagari(F.col("form")).alias("deva"))


@query("select distinct entry_id, array_to_string(list_filter(regexp_split_to_array(string_split(coalesce(x, ''), '|')[1], '\\s+'), lambda d: d <> ''), ' ') as dialects from morph_entries")
def dialects(t):
    return t("morph_entries").select("entry_id", F.array_join(misc.dialect_tags(F.col("x")), " ").alias("dialects")).distinct()


# Stores ----------------------------------------------------------------------------------------------------------------

_LOG = "l as (select user_id::varchar as author_key, event_type as work_id, event_id::varchar as ref, ts from events)"


@query(f"with {_LOG} select author_key, work_id, arg_max(ref, {{a: ts, b: ref}}) as ref, max(ts) as ts from l group by all")
def latest_marks(t):
    return stores.latest(_log(t), ["author_key", "work_id"])


def _log(t):
    return t("events").select(F.col("user_id").cast("string").alias("author_key"), F.col("event_type").alias("work_id"), F.col("event_id").cast("string").alias("ref"), "ts")


@query(f"with {_LOG}, m as (select author_key, work_id, arg_max(ref, {{a: ts, b: ref}}) as ref, max(ts) as ts from l group by all) select * from m qualify row_number() over (partition by author_key order by ts desc, work_id, ref) <= 4")
def recent_marks(t):
    return stores.newest(stores.latest(_log(t), ["author_key", "work_id"]), per=["author_key"])


@query("select user_id, event_type, max(ts) as ts from events group by all having count(*) % 2 = 1")
def starred(t):
    return stores.toggled(t("events"), ["user_id", "event_type"])


_HALF = """h as (select user_id, event_type, event_id % 2 as odd, max({t: ts, e: event_id}) as v from events group by all), a as (select * from h where odd = 0), b as (select * from h where odd = 1)"""


@query(f"with {_HALF} select coalesce(a.user_id, b.user_id) as user_id, coalesce(a.event_type, b.event_type) as event_type, coalesce(b.v.t, a.v.t) as ts, coalesce(b.v.e, a.v.e) as event_id, a.user_id is null as added from a full join b on a.user_id = b.user_id and a.event_type = b.event_type")
def vocabulary_import(t):
    return stores.imported(*_store_halves(t), ["user_id", "event_type"], overwrite=True)


@query(f"with {_HALF} select coalesce(a.user_id, b.user_id) as user_id, coalesce(a.event_type, b.event_type) as event_type, coalesce(a.v.t, b.v.t) as ts, coalesce(a.v.e, b.v.e) as event_id, a.user_id is null as added from a full join b on a.user_id = b.user_id and a.event_type = b.event_type")
def bookmark_import(t):
    return stores.imported(*_store_halves(t), ["user_id", "event_type"], overwrite=False)


def _store_halves(t):
    """Two stores from the log: the latest marks of every user and kind by its even and by its odd events; none is left out."""
    marks = t("events").select("user_id", "event_type", "ts", "event_id")
    half = lambda odd: stores.latest(marks.where(F.col("event_id") % 2 == odd), ["user_id", "event_type"])
    return half(0), half(1)


@query("""with s as (select event_id, greatest(1, floor(epoch(timestamp '2024-02-01 00:00:00' - ts) + 0.5)) as s from events), m as (select *, floor(s / 60 + 0.5) as m from s), h as (select *, floor(m / 60 + 0.5) as h from m)
 select event_id, case when s < 60 then s::bigint || 's ago' when m < 60 then m::bigint || 'm ago' when h < 24 then h::bigint || 'h ago' else floor(h / 24 + 0.5)::bigint || 'd ago' end as said from h""")
def relative_times(t):
    seconds = F.lit(1706745600.0) - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return t("events").select("event_id", misc.rel_time(seconds).alias("said"))


# SQL of the surface index and of what is built on it: keys of forms, own key first, then members', then beginnings ---------

_FORMS = f"fs as (select distinct form from toks where form is not null and form <> '' and not regexp_matches(form, '^[।॥0-9.,;:!?“”''\"()\\-\\s]+$')), ks as (select form, {duck.canonical_keys('form')} as keys from fs)"
_INDEX = f"""{TOKENS}, known as (select distinct slp_key as key from morph_entries where slp_key is not null), {_FORMS},
 own as (select form, unnest(keys) as key, unnest(range(len(keys))) as no from ks), ex as (select form, arg_min(key, no) as key, 'exact' as tier from own where key in (select key from known) group by form),
 mm as (select form, member, m from (select form, unnest(list_filter(list_transform(string_split(form, '-'), lambda p: trim(p)), lambda p: p <> '')) as member, unnest(range(len(list_filter(list_transform(string_split(form, '-'), lambda p: trim(p)), lambda p: p <> '')))) as m from fs where contains(form, '-') and form not in (select form from ex))),
 mk as (select form, m, unnest(keys) as key, unnest(range(len(keys))) as no from (select form, m, {duck.canonical_keys('member')} as keys from mm)), me as (select form, arg_min(key, {{a: m, b: no}}) as key, 'member' as tier from mk where key in (select key from known) group by form),
 pp as (select form, no, left(key, n) as key, n from (select *, unnest(range(4, length(key))) as n from own where form not in (select form from ex) and form not in (select form from me))),
 pr as (select form, arg_min(key, {{a: no, b: -n}}) as key, 'prefix' as tier from pp where key in (select key from known) group by form), idx as (select * from ex union all select * from me union all select * from pr)"""
_SLICE_OF = f"{duck.table_map(keys.SLICES)}[nullif(regexp_extract(form, '[{''.join(keys.SLICES)}]'), '')]"

SQL["surface_index"] = f"with {_INDEX} select form, key, tier from idx"
SQL["work_slices"] = f"with {_INDEX} select distinct work_id, form, key from toks join idx using (form)"
SQL["scoped_keys"] = f"""with {_INDEX}, sl as (select distinct work_id, form, key from toks join idx using (form)), q as (select distinct work_id, lemma as form from parse_groups where lemma <> '')
 select work_id, form, key from (select q.work_id, q.form, case when q.work_id in (select work_id from sl where work_id is not null) then sl.key else idx.key end as key from q left join sl on q.work_id = sl.work_id and q.form = sl.form left join idx on q.form = idx.form) where key is not null"""
SQL["slice_sizes"] = f"with {_INDEX} select {_SLICE_OF} as slice, count(*) as forms, sum(octet_length(encode(form)) + octet_length(encode(key)))::bigint as bytes from idx group by all"
SQL["coverage_by_work"] = f"""with {_INDEX}, st as (select distinct form from own where key in (select key from known) union select form from (select form, m, unnest(keys) as key from (select form, 0 as m, {duck.canonical_keys('member')} as keys from (select form, unnest(list_filter(list_transform(string_split(form, '-'), lambda p: trim(p)), lambda p: p <> '')) as member from fs where contains(form, '-')))) where key in (select key from known)),
 c as (select work_id, count(*) as words, count_if(form in (select form from idx)) as loose_hits, count_if(form in (select form from st)) as strict_hits from toks where form in (select form from fs) group by work_id)
 select work_id, words, loose_hits::bigint as loose_hits, strict_hits::bigint as strict_hits, round(100.0 * loose_hits / words, 1) as loose_pct, round(100.0 * strict_hits / words, 1) as strict_pct from c"""
SQL["token_analyses"] = f"""with {_INDEX}, af as (select distinct form from toks where form is not null), cand as (select form, list_filter([idx.key, case when not regexp_matches(form, '[\\x{{0900}}-\\x{{097F}}]') then {duck.strip_accents('form')} end], lambda k: k is not null) as cs,
 list_filter([{duck.slp1_key_for('form')}, case when regexp_matches(form, '[\\x{{0900}}-\\x{{097F}}]') then lower({duck.dev_to_iast('form')}) end], lambda k: k is not null and regexp_matches(k, '^[a-z~]+$')) as ts from af left join idx using (form)),
 c2 as (select form, arg_min(key, no) as key from (select form, ts, unnest(cs) as key, unnest(range(len(cs))) as no from cand) where list_contains(ts, key) and key in (select key from known) group by form),
 e as (select distinct entry_id, slp_key as key, ord_no, l, p, f, g, x from morph_entries), d as (select form, key, ord_no, l, p, f, g, x from c2 join e using (key)),
 al as (select * replace ({duck.strip_accents('form')} as form) from d where {duck.strip_accents('form')} <> form) select distinct * from d union select distinct * from al where form not in (select form from d)"""
SQL["merge_stats"] = f"""with {_MERGED}, n as (select distinct slp_key, ord_no, l, p, f, built_at from e where slp_key is not null and built_at >= timestamptz '2023-10-01 00:00:00+00'),
 seen as (select strftime(built_at, '%Y-%m') as origin, count(*) as entries from n group by 1), added as (select origin, count(*) as added from mg where is_new group by 1),
 nk as (select origin, count(*) as new_keys from (select slp_key, bool_and(is_new) as fresh, arg_min(origin, ord) as origin from mg group by slp_key) where fresh group by origin)
 select origin, entries, coalesce(added, 0) as added, coalesce(new_keys, 0) as new_keys from seen left join added using (origin) left join nk using (origin)"""
SQL["morph_shards"] = f"""with a as (select distinct * from analysis_rows), t as (select row_id, unnest([sandhied_word, word, nullif(regexp_extract(coalesce(morph_in_context, ''), '^\\s*([^{{}}]+?)\\s*\\{{', 1), '')]) as field from a),
 v as (select row_id, trim(regexp_replace(trim(x), '^[()«»"''“”]+|[()«»"''“”]+$', '', 'g')) as form from (select row_id, unnest(regexp_split_to_array(field, '[;,]')) as x from t where field is not null)),
 w as (select row_id, form from v union select row_id, trim(p) from (select row_id, unnest(string_split(form, '-')) as p from v where contains(form, '-'))), k as (select distinct row_id, {duck.slp1_key('form')} as key from w), vk as (select * from k where regexp_matches(key, '^[a-z~]+$')),
 r as ({SQL['analysis_readings']}), s as (select key, l, p, f, min({{a: vk.row_id, b: pos}}) as place from vk join r on vk.row_id = r.row_id group by all)
 select key[1:1] as letter, key, (row_number() over (partition by key order by place) - 1)::int as ord, l, p, f from s where regexp_matches(key, '^[a-z]')"""


@query(f"""with {_PARSES}, h as (select u as l, min(g) as g1 from headwords where g <> '' group by 1), k as (select {duck.slp1_key_for('u')} as lk, min(g) as g3 from headwords where g <> '' and u <> '' group by 1)
 select entry_id, e.l, coalesce(e.g, h.g1, k.g3) as source_gloss from e left join h on e.l = h.l left join k on {duck.slp1_key_for('e.l')} = k.lk""")
def source_glosses(t):
    e = t("morph_entries").where("slp_key is not null").dropDuplicates(["entry_id"])
    return lookup.source_glosses(e, lookup.gloss_table(t("headwords")), ["entry_id"])


@query()
def member_glosses(t):
    lemmas = t("morph_entries").select(F.explode("m.l").alias("lemma")).where("lemma <> ''")
    return lookup.member_glosses(lemmas, lookup.gloss_table(t("headwords")))


@query()
def parse_group_entries(t):
    """Dictionary entries of the lemmas of each parse group's members, each headword once."""
    rows = t("parse_groups").select("group_id", F.posexplode("members.l").alias("ord", "lemma")).where("lemma <> ''").distinct()
    return lookup.token_entries(rows, lookup.gloss_table(t("headwords")), ["group_id"])


@query(f"""with {_INDEX}, o as (select key, arg_min(origin, {{a: built_at, b: entry_id}}) as origin from (select slp_key as key, strftime(built_at, '%Y-%m') as origin, built_at, entry_id from morph_entries where slp_key is not null and built_at is not null) group by key)
 select origin, form, key from idx join o using (key) qualify row_number() over (partition by origin order by form) <= 3""")
def origin_samples(t):
    e = t("morph_entries").where("slp_key is not null and built_at is not null")
    origins = ordered.first_by(e.select(F.col("slp_key").alias("key"), "built_at", "entry_id"), ["key"], ["built_at", "entry_id"]).select("key", F.date_format("built_at", "yyyy-MM").alias("origin"))
    return lookup.origin_samples(_index(t), origins)


@query()
def folded_analyses(t):
    """Analyses of the roman forms of the units, without the gate of trust."""
    tokens_ = reading.tokens(t("work_units")).where(~translit.has_devanagari(F.col("form")))
    index = _index(t)
    return lookup.folded_analyses(tokens_, lookup.work_slices(tokens_, index), index, t("morph_entries").dropDuplicates(["entry_id"]))


@query(f"""select distinct mw_id, u, nullif(regexp_extract(lower(u), '[a-z]'), '') as initial from mw_entries""")
def roman_initials(t):
    return t("mw_entries").select("mw_id", "u", misc.roman_initial(F.col("u")).alias("initial")).distinct()


@query("""select distinct file_id, case when alignment in ('en', 'zh', 'off') then alignment when lang = 'en' then 'en' when lang = 'zh' then 'zh' else 'off' end as layer from trans_files""")
def default_layers(t):
    f = t("trans_files").select("file_id", "lang", "alignment").distinct()
    return f.select("file_id", misc.default_layer(F.col("alignment"), F.col("lang") == "en", F.col("lang") == "zh").alias("layer")).distinct()


@query()
def parse_views(t):
    """Parses as they are shown: lemma, features, short sense of their source gloss, whether they are a name."""
    e = t("morph_entries").where("slp_key is not null").dropDuplicates(["entry_id"])
    glossed = lookup.source_glosses(e, lookup.gloss_table(t("headwords")), ["entry_id"]).select("entry_id", "source_gloss")
    return e.join(glossed, "entry_id").select("entry_id", gloss.view_model(F.col("l"), F.col("p"), F.col("f"), F.col("source_gloss")).alias("v")).select("entry_id", "v.*")


SQL |= duckrank.SQL
SQL["folded_analyses"] = f"""with {_INDEX}, tk as (select distinct work_id, form from toks where not regexp_matches(form, '[\\x{{0900}}-\\x{{097F}}]')), kd as (select work_id, tk.form, coalesce(idx.key, {duck.slp1_key_for("translate(tk.form, 'ṁ', 'ṃ')")}) as key from tk left join idx on tk.form = idx.form),
 e as (select distinct entry_id, slp_key as key, ord_no, l, p, f from morph_entries), fd as (select work_id, form, key, ord_no, l, p, f from kd join e using (key)),
 nm as (select *, unnest([form, {duck.strip_accents("translate(lower(form), 'ṁ', 'ṃ')")}, translate(lower(form), 'ṁ', 'ṃ')]) as name from fd)
 select distinct work_id, name as form, key, ord_no, l, p, f from nm where name = form or not exists (select 1 from tk where tk.work_id = nm.work_id and tk.form = nm.name)"""
SQL["morph_with_fallbacks"] = f"""with {TOKENS}, {_KNOWN}, sh as ({SQL['morph_shards']}), wk as (select distinct {duck.slp1_key('form')} as key from toks), x as (select key from wk where regexp_matches(key, '^[a-z~]+$') and key not in (select key from sh)),
 t1 as (select key, left(key, length(key) - c) as stem, c from (select key, unnest([1, 2]) as c from x) where length(key) - c >= 3), t2 as (select key, arg_min(stem, c) as stem from t1 where stem in (select key from sh) group by key),
 y as (select key, left(key, n) as stem, n from (select key, unnest(range(3, length(key))) as n from x where key not in (select key from t2))), mw as (select key, arg_max(stem, n) as stem from y where stem in (select key from known) group by key)
 select * from sh union all select left(t2.key, 1), t2.key, sh.ord, sh.l, sh.p, case when coalesce(sh.f, '') = '' then '(inferred)' else sh.f || ';(inferred)' end from t2 join sh on t2.stem = sh.key
 union all select left(key, 1), key, 0, {duck.iast_to_dev(duck.slp1_to_iast('stem'))}, 'stem', '(inferred)' from mw"""
