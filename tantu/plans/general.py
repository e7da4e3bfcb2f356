"""Queries of the general data-preparation operators: nested records, orphan references, packed values."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tantu.operators import nested, orphans, packed
from tantu.session import table


def p2_found(spark: SparkSession, path: str) -> DataFrame:
    return nested.parse_member_rows(table(spark, path, "occ_index"))


def p2_refs(spark: SparkSession, path: str) -> DataFrame:
    return nested.occurrence_tables(table(spark, path, "occ_index"))["refs"].select("shard_id", "ref").distinct()


def p2_parses(spark: SparkSession, path: str) -> DataFrame:
    keep = ["shard_id", "ref", "token_index", "parse_pos", "l", "p", "f", "g", "r", "source", "confidence"]
    return nested.occurrence_tables(table(spark, path, "occ_index"))["parses"].select(*keep).distinct()


def p2_members(spark: SparkSession, path: str) -> DataFrame:
    keep = ["shard_id", "ref", "token_index", "parse_pos", "member_pos", "d", "l", "p", "f"]
    return nested.occurrence_tables(table(spark, path, "occ_index"))["members"].select(*keep).distinct()


def p4_found(spark: SparkSession, path: str) -> DataFrame:
    return orphans.orphan_references(partial(table, spark, path))


def p4_report(spark: SparkSession, path: str) -> DataFrame:
    return orphans.orphan_report(partial(table, spark, path))


def p5_found(spark: SparkSession, path: str) -> DataFrame:
    return packed.packed_values(partial(table, spark, path))


def p5_dialects(spark: SparkSession, path: str) -> DataFrame:
    """How many distinct fields were read in each dialect, by source."""
    analysis = table(spark, path, "analysis_rows").select(F.col("morph_in_context").alias("text"))
    morph = table(spark, path, "morph_entries").select(F.explode("m.f").alias("text"))
    return packed.chosen_dialects(analysis.union(morph)).groupBy("dialect", "quote").agg(F.count("*").alias("fields"))


QUERIES = {f.__name__: f for f in (p2_found, p2_refs, p2_parses, p2_members, p4_found, p4_report, p5_found, p5_dialects)}

_DOCS = """d as (select shard_id, case when raw_json is not null then coalesce(json_extract(raw_json, '$.occurrence'), raw_json::json) else to_json(occurrence) end as doc from occ_index),
 r as (select shard_id, ref, json_extract(doc, '$."' || ref || '"') as toks from (select shard_id, doc, unnest(json_keys(doc)) as ref from d)),
 k as (select shard_id, ref, token, json_extract(toks, '$."' || token || '"') as ps from (select *, unnest(json_keys(toks)) as token from r where json_type(toks) = 'OBJECT')),
 p as (select shard_id, ref, token::int as token_index, i::int as parse_pos, case when json_type(ps) = 'ARRAY' then json_extract(ps, '$[' || i || ']') else ps end as parse
 from (select *, unnest(case json_type(ps) when 'ARRAY' then range(json_array_length(ps)::bigint) when 'OBJECT' then [0] else [] end) as i from k)),
 q as (select * from p where json_type(parse) = 'OBJECT'), m as (select shard_id, ref, token_index, parse_pos, j::int as member_pos, json_extract(parse, '$.m[' || j || ']') as member
 from (select *, unnest(case when json_type(json_extract(parse, '$.m')) = 'ARRAY' then range(json_array_length(json_extract(parse, '$.m'))::bigint) else [] end) as j from q))"""
_SPLIT = "list_filter(list_transform(regexp_extract_all({0}, '(?:\"[^\"]*\"|\\{{[^{{}}]*\\}}|[^{1}\"{{])+'), lambda v: trim(regexp_replace(trim(v), '^\"(.*)\"$', '\\1'))), lambda v: v <> '')"

SQL: dict[str, str] = {
    "p2_found": f"""with {_DOCS} select distinct shard_id, ref, token_index, parse_pos, -1 as member_pos from q
 union select shard_id, ref, token_index, parse_pos, member_pos from m where json_type(member) = 'OBJECT'""",
    "p2_refs": f"with {_DOCS} select distinct shard_id, ref from r where json_type(toks) = 'OBJECT'",
    "p2_parses": f"""with {_DOCS} select distinct shard_id, ref, token_index, parse_pos, {', '.join(f"parse->>'{c}' as {c}" for c in ('l', 'p', 'f', 'g', 'r', 'source'))}, (parse->>'confidence')::double as confidence from q""",
    "p2_members": f"""with {_DOCS} select distinct shard_id, ref, token_index, parse_pos, member_pos, {', '.join(f"member->>'{c}' as {c}" for c in ('d', 'l', 'p', 'f'))} from m where json_type(member) = 'OBJECT'""",
    "p4_found": """with u as (select distinct work_id, ref, ingested_at, deleted_at from work_units), r as (select 'trans_files' as src, file_id as row_id, work_id, x.ref as ref, loaded_at as t from (select file_id, work_id, loaded_at, unnest(units) as x from trans_files)
 union select 'occ_index', shard_id, work_id, unnest(map_keys(refs)), loaded_at from occ_index union select 'parse_groups', group_id, work_id, ref, seen_at from parse_groups)
 select src, strftime(t, '%Y-%m') as yyyymm, row_id, ref from r where ref is not null and not exists (select 1 from u where u.work_id = r.work_id and u.ref = r.ref and u.ingested_at <= r.t and (u.deleted_at is null or u.deleted_at > r.t))
 union select 'work_units', strftime(ingested_at, '%Y-%m'), unit_id, ref from work_units r where ref is not null and not exists (select 1 from works w where w.work_id = r.work_id and w.added_at <= r.ingested_at and (w.removed_at is null or w.removed_at > r.ingested_at))""",
    "p5_found": f"""with a as (select distinct 'analysis_rows' as src, row_id, -1 as member_pos, morph_in_context as t from analysis_rows union select distinct 'morph_entries', entry_id, (i - 1)::int, m[i].f from (select entry_id, m, unnest(range(1, len(m) + 1)) as i from morph_entries)),
 v as (select src, row_id, member_pos, case when src = 'analysis_rows' then {_SPLIT.format('t', '/;|,／；、，')} else {_SPLIT.format('t', '/;|,／；、， ')} end as vals from a where t is not null)
 select src, row_id, member_pos, (i - 1)::int as pos, vals[i] as val from (select *, unnest(range(1, len(vals) + 1)) as i from v where len(vals) >= 2)""",
}
SQL["p4_report"] = f"select src, yyyymm, count(*) as orphans, count(distinct row_id) as rows from ({SQL['p4_found']}) group by all"
