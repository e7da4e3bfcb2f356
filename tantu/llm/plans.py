"""Queries of the language-model operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tantu.functions.lookalike import IGNORABLE, LETTERS, SEQUENCES, SPACES
from tantu.llm import alignment, canon, leaks, lookalikes, mixing, quality, termcounts
from tantu.session import table


def p1_found(spark: SparkSession, path: str) -> DataFrame:
    return alignment.aligned_pairs(partial(table, spark, path))


def p3_found(spark: SparkSession, path: str) -> DataFrame:
    return lookalikes.lookalike_rows(partial(table, spark, path))


def p3_consistent(spark: SparkSession, path: str) -> DataFrame:
    """Every word of the corpus that is not in its consistent form, with that form and how often it occurs."""
    tables = partial(table, spark, path)
    every = lookalikes.canonical(lookalikes.corpus_words(tables), tables("headwords"), all_rows=True)
    return every.where("val <> spelling").groupBy("src", "val", "spelling", "head_id").agg(F.count("*").alias("n"))


def p7_found(spark: SparkSession, path: str) -> DataFrame:
    return canon.mapped_rows(partial(table, spark, path))


def p7_unmatched(spark: SparkSession, path: str) -> DataFrame:
    """The typed values that mean no headword, with how many rows hold them."""
    return canon.mapped_rows(partial(table, spark, path), cost=True).where("head_id = -1").groupBy("src", "val").agg(F.count("*").alias("n"))


def p6_found(spark: SparkSession, path: str) -> DataFrame:
    return termcounts.corpus_marks(partial(table, spark, path)).where("mark is not null").select("fld", "term", "mark")


def p6_counts(spark: SparkSession, path: str) -> DataFrame:
    return termcounts.corpus_marks(partial(table, spark, path)).select("fld", "term", "total", "records")


def p6_updated(spark: SparkSession, path: str) -> DataFrame:
    """The same counts by deliveries split at another day, where most records come with the second."""
    return termcounts.updated_counts(partial(table, spark, path), "2023-04-01").select("fld", "term", "total", "records")


def p8_found(spark: SparkSession, path: str) -> DataFrame:
    return leaks.leaked(table(spark, path, "documents"), table(spark, path, "eval_items"))


def p8_alignments(spark: SparkSession, path: str) -> DataFrame:
    found = leaks.alignments(table(spark, path, "documents"), table(spark, path, "eval_items"))
    return found.withColumn("share", F.round("share", 4))


def p9_mix(spark: SparkSession, path: str) -> DataFrame:
    return mixing.mixed(table(spark, path, "documents"), table(spark, path, "mix_targets"))[0]


def p9_shares(spark: SparkSession, path: str) -> DataFrame:
    report = mixing.mixed(table(spark, path, "documents"), table(spark, path, "mix_targets"))[1]
    return report.withColumn("share", F.round("share", 6))


def p10_found(spark: SparkSession, path: str) -> DataFrame:
    return quality.not_prose(table(spark, path, "documents"))


def p10_statistics(spark: SparkSession, path: str) -> DataFrame:
    found = quality.text_types(table(spark, path, "documents"))
    return found.select("doc_id", "kind", *[F.round(c, 4).alias(c) for c in (*quality.STATS, "p_prose", "p_list", "p_table", "p_junk")])


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p3_consistent, p6_found, p6_counts, p6_updated, p7_found, p7_unmatched, p8_found, p8_alignments, p9_mix, p9_shares, p10_found, p10_statistics)}
_LOOK = "".join(LETTERS)
_PLAIN = "".join(LETTERS.values())
_WIDE = "".join(chr(0xFF01 + i) for i in range(94)).replace("＇", "")
_NARROW = "".join(chr(0x21 + i) for i in range(94)).replace("'", "")


def _consistent_sql(x: str) -> str:
    """The look of a word by table alone, composed: what the automaton's free moves amount to."""
    out = f"translate({x}, '{IGNORABLE}', '')"
    out = f"trim(translate({out}, '{SPACES}', '{' ' * len(SPACES)}'), ' \t\r\n')"
    out = f"nfc_normalize(translate(translate({out}, '{_WIDE}', '{_NARROW}'), '{_LOOK}', '{_PLAIN}'))"
    for letter, shown in sorted(SEQUENCES.items(), key=lambda p: -len(p[1])):
        if letter != "।":
            out = f"replace({out}, '{shown}', '{letter}')"
    return out


_WORDS = """w as (select distinct 'work_units' as src, unit_id as row_id, (i - 1)::int as pos, ws[i] as v from (select *, unnest(range(1, len(ws) + 1)) as i from (select unit_id, coalesce(words, list_filter(string_split(w, ' '), lambda x: x <> '')) as ws from work_units))
 union select 'mw_entries', mw_id, 0, u from mw_entries union select 'morph_entries', entry_id, (i - 1)::int, m[i].l from (select entry_id, m, unnest(range(1, len(m) + 1)) as i from morph_entries))"""
_TERMS = """u as (select distinct unit_id, coalesce(words, list_filter(string_split(w, ' '), lambda x: x <> '')) as ws from work_units), a as (select unit_id, unnest(ws) as term from u), n as (select count(distinct unit_id) as n from work_units),
 g as (select distinct group_id, lemma from parse_groups where lemma <> ''), c as (select 'words' as fld, term, count(*) as total, count(distinct unit_id) as records, (select n from n) as n from a where term <> '' group by term
 union all select 'lemma', lemma, count(*), count(distinct group_id), (select count(distinct group_id) from g) from g group by lemma)"""

SQL: dict[str, str] = {
    "p3_found": f"with {_WORDS}, h as (select u as s, head_id from headwords union select iast, head_id from headwords) select distinct src, row_id, pos, head_id from (select *, {_consistent_sql('v')} as s from w where v <> '') x join h using (s) where v <> s",
    "p6_found": f"with {_TERMS} select fld, term, case when records < 3 then 'rare' else 'common' end as mark from c where records < 3 or records > 0.01 * n",
    "p6_counts": f"with {_TERMS} select fld, term, total, records from c",
}
SQL["p6_updated"] = SQL["p6_counts"]
