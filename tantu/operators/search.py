"""Word and passage search: inverted index, sandhi variants, translation snippets, catalog filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tantu.functions.gloss import snippet
from tantu.functions.translit import norm_sa, strip_accents
from tantu.operators.ordered import first_by, tries

HITS = 8


def postings(token_rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """(letter, term, work_id, n, first_ref): occurrences of each folded term in each work and where it is first seen.

    order: columns that place a token in its work. Partial aggregation keeps frequent terms from moving row by row.
    """
    terms = token_rows.select(norm_sa(F.col("form")).alias("term"), "work_id", "ref", F.struct(*order).alias("at")).where("term <> ''")
    out = terms.groupBy("term", "work_id").agg(F.count("*").alias("n"), F.min_by("ref", "at").alias("first_ref"))
    return out.select(F.substring("term", 1, 1).alias("letter"), "term", "work_id", "n", "first_ref")


def inverted_index(posted: DataFrame) -> DataFrame:
    """(term, total, works): occurrences of each term and its works (struct of work_id, first_ref), sorted."""
    works = F.array_sort(F.collect_list(F.struct("work_id", "first_ref")))
    return posted.groupBy("term").agg(F.sum("n").alias("total"), works.alias("works"))


def query_variants(key: Column) -> Column:
    """The folded query, without a final m or h, with h, with m."""
    bare = F.when(key.rlike("[mh]$"), F.substring(key, F.lit(1), F.length(key) - 1))
    return F.array_compact(F.array(key, bare, F.concat(key, F.lit("h")), F.concat(key, F.lit("m"))))


def word_search(queries: DataFrame, posted: DataFrame, works: DataFrame, most: int = HITS) -> DataFrame:
    """(query, term, variant, n_works, total, rank, work_id, title, first_ref): works that hold a query's word.

    The first variant with postings counts. n_works and total count all works; the first ``most`` of them are shown, less
    those that the catalog (work_id, title) doesn't have. Queries of fewer than 2 letters or not beginning with one find
    nothing.
    """
    q = queries.select("query").distinct().withColumn("k", norm_sa(F.trim("query"))).where(F.col("k").rlike("^[a-z]."))
    tried = tries(q, query_variants(F.col("k")), "variant", "term").select("query", "variant", "term")
    chosen = first_by(tried.join(posted.select("term").distinct(), "term", "left_semi").select("query", "variant", "term"), ["query"], ["variant"])
    by_query = Window.partitionBy("query")
    hits = chosen.join(posted, "term").withColumn("n_works", F.count("*").over(by_query)).withColumn("total", F.sum("n").over(by_query))
    hits = hits.withColumn("rank", F.row_number().over(by_query.orderBy("work_id"))).where(F.col("rank") <= most)
    shown = hits.join(works.select("work_id", "title"), "work_id")
    return shown.select("query", "term", "variant", "n_works", "total", "rank", "work_id", "title", "first_ref")


def folded_snippets(elements: DataFrame) -> DataFrame:
    """(work_id, ref, pos, folded) of translation elements: the text that a folded query is looked for in."""
    return elements.select("work_id", "file_id", "ref", "pos", norm_sa(F.col("text")).alias("folded")).where("folded <> ''")


def passage_search(folded: DataFrame, query: str | Column, works: DataFrame, most: int = HITS) -> DataFrame:
    """(total, rank, work_id, title, ref, snippet): passages that contain one query, the first ``most`` of them shown.

    total counts every passage; shown are those of works that the catalog (work_id, title) has. Queries of up to 3 folded letters find nothing.
    """
    needle = norm_sa(F.lit(query) if isinstance(query, str) else query)
    hits = folded.where((F.length(needle) > 3) & folded["folded"].contains(needle))
    total = hits.agg(F.count("*").alias("n")).scalar()
    known = hits.join(works.select("work_id", "title"), "work_id")
    first = known.orderBy("work_id", "file_id", "pos").limit(most)
    shown = first.withColumn("rank", F.row_number().over(Window.orderBy("work_id", "file_id", "pos")))  # ``most`` rows
    return shown.select(total.alias("total"), "rank", "work_id", "title", "ref", snippet(F.col("folded"), needle).alias("snippet"))


def catalog_filter(works: DataFrame, query: str) -> DataFrame:
    """Works of the catalog that a query finds: all of an author whose key has it, else those whose title has it.

    Also by Chinese title. Adds n_authors and n_works, which count what is found. An empty query finds everything.
    """
    q = F.lit(query.strip())
    folded = strip_accents(q)
    has = lambda c: F.coalesce(strip_accents(F.col(c)).contains(folded) | F.col(c).contains(q), F.lit(False))
    by_author = Window.partitionBy("author_key")
    author_hit = F.max(has("author_key")).over(by_author)
    found = works.withColumn("__hit", author_hit | has("title") | has("title_zh")).where("__hit").drop("__hit")
    counts = found.agg(F.countDistinct(F.coalesce("author_key", F.lit(""))).alias("n_authors"), F.count("*").alias("n_works"))
    return found.withColumns({c: counts.select(c).scalar() for c in counts.columns})
