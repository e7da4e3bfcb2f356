"""Forms to keys to analyses and glosses: tiered resolution, trust, dictionary search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tantu.functions.keys import canonical_keys, dict_keys, hyphen_members, is_punctuation, key_variants, trusted_keys
from tantu.functions.translit import slp1_key_for, strip_accents
from tantu.operators.ordered import first_by, longest_prefix, suffix_trim, tries
from tantu.session import spread


def surface_index(forms: DataFrame, keys: DataFrame, least: int = 4) -> DataFrame:
    """(form, key, tier) of distinct forms: an own key, else a hyphen member's, else the longest known beginning of a key.

    forms: ``form``; keys: ``key``. Tiers: exact, member, prefix. Among prefixes the form's first key spelling comes before
    longer ones of its other spelling. Punctuation and forms without any hit give no row.
    """
    distinct = spread(forms.select("form").where(F.col("form").isNotNull() & (F.col("form") != "")).distinct(), "form").where(~is_punctuation(F.col("form")))
    known = keys.select("key").distinct()
    # one join finds the exact hits and keeps every form's spellings for what comes next
    spelled = distinct.select("form", F.posexplode_outer(canonical_keys(F.col("form"))).alias("no", "key")).join(known.withColumn("hit", F.lit(True)), "key", "left")
    one = F.struct("no", "key")
    tried = spelled.groupBy("form").agg(F.min(F.when(F.col("hit"), one)).alias("best"), F.sort_array(F.collect_list(F.when(F.col("key").isNotNull(), one))).alias("spellings"))
    exact = tried.where("best is not null").select("form", F.col("best.key").alias("key"), F.lit("exact").alias("tier"))
    # the rest try their members, then the beginnings of their spellings, in one join as well
    member = F.flatten(F.transform(hyphen_members(F.col("form")), lambda m, i: F.transform(canonical_keys(m), lambda k, j: F.struct(F.lit(1).alias("tier"), (i * 100 + j).alias("a"), F.lit(0).alias("b"), k.alias("key")))))
    begun = lambda s: F.transform(F.when(F.length(s["key"]) > least, F.sequence(F.length(s["key"]) - 1, F.lit(least), F.lit(-1))).otherwise(F.array().cast("array<int>")), lambda n: F.struct(F.lit(2).alias("tier"), s["no"].alias("a"), (-n).alias("b"), F.substring(s["key"], F.lit(1), n).alias("key")))
    other = tried.where("best is null").select("form", F.explode(F.concat(member, F.flatten(F.transform("spellings", begun)))).alias("c")).select("form", "c.*")
    found = first_by(other.join(known, "key", "left_semi").select("form", "tier", "a", "b", "key"), ["form"], ["tier", "a", "b"])
    return exact.unionByName(found.select("form", "key", F.when(F.col("tier") == 1, "member").otherwise("prefix").alias("tier")))


def work_slices(token_rows: DataFrame, index: DataFrame) -> DataFrame:
    """(work_id, form, key): the index entries of each work's own forms; works without any drop out."""
    return token_rows.select("work_id", "form").distinct().join(index.select("form", "key"), "form").select("work_id", "form", "key")


def scoped_keys(forms: DataFrame, by_work: DataFrame, overall: DataFrame) -> DataFrame:
    """(work_id, form, key): the key of a form in its work's slice; only works without a slice ask the overall index."""
    sliced = by_work.select("work_id").distinct().withColumn("has_slice", F.lit(True))
    a = by_work.select("work_id", "form", F.col("key").alias("k1"))
    b = overall.select("form", F.col("key").alias("k2"))
    joined = forms.select("work_id", "form").distinct().join(sliced, "work_id", "left").join(a, ["work_id", "form"], "left").join(b, "form", "left")
    return joined.select("work_id", "form", F.when(F.col("has_slice"), F.col("k1")).otherwise(F.col("k2")).alias("key")).where("key is not null")


def member_keys(forms: DataFrame, by_work: DataFrame, overall: DataFrame) -> DataFrame:
    """As scoped_keys, but a miss in the work's slice still asks the overall index."""
    a = by_work.select("work_id", "form", F.col("key").alias("k1"))
    b = overall.select("form", F.col("key").alias("k2"))
    joined = forms.select("work_id", "form").distinct().join(a, ["work_id", "form"], "left").join(b, "form", "left")
    return joined.select("work_id", "form", F.coalesce("k1", "k2").alias("key")).where("key is not null")


def analyses(forms: DataFrame, index: DataFrame, morph: DataFrame) -> DataFrame:
    """(form, key, ord_no, l, p, f, g, x, m) of forms whose key is trusted.

    Candidates: the index's key, and for roman forms also the form without accents; the first that the morph table has
    counts. A key is trusted if it is one of the form's own spellings, so prefix matches of the index don't pass.
    """
    keyed = spread(forms.select("form").distinct().join(index.select("form", F.col("key").alias("via")), "form", "left"), "form")
    candidates = F.array_distinct(F.array_compact(F.array(F.col("via"), F.when(~F.col("form").rlike("[\\u0900-\\u097F]"), strip_accents(F.col("form"))))))
    tried = tries(keyed.select("form", candidates.alias("c")), F.col("c"), "no", "key").where(F.array_contains(trusted_keys(F.col("form")), F.col("key")))
    known = morph.select(F.col("slp_key").alias("key")).distinct()
    chosen = first_by(tried.join(known, "key", "left_semi").select("form", "no", "key"), ["form"], ["no"]).select("form", "key")
    return chosen.join(morph.withColumnRenamed("slp_key", "key"), "key").select("form", "key", "ord_no", "l", "p", "f", "g", "x", "m")


def published(found: DataFrame) -> DataFrame:
    """Results of forms also under the form without accents, where that is no form of its own."""
    own = found.select("form").distinct().withColumn("direct", F.lit(True))
    under = found.select("*", strip_accents(F.col("form")).alias("alias")).where("alias <> form")
    extra = under.join(own.withColumnRenamed("form", "alias"), "alias", "left_anti")
    return found.unionByName(extra.drop("form").withColumnRenamed("alias", "form"))


def glosses(lemmas: DataFrame, gloss: DataFrame, filled: bool = False) -> DataFrame:
    """(lemma, key, u, g): of each lemma the first of its dictionary keys that the gloss table (key, u, g) has.

    With filled=True entries without a gloss are passed over.
    """
    table = gloss.where("g is not null and g <> ''") if filled else gloss
    table = first_by(table.select("key", "u", "g"), ["key"], ["u", "g"])
    tried = tries(spread(lemmas.select("lemma").where("lemma is not null").distinct(), "lemma"), F.concat(dict_keys(F.col("lemma")), F.array(slp1_key_for(strip_accents(F.col("lemma"))))), "no", "key")
    hits = tried.join(table, "key")
    return first_by(hits.select("lemma", "no", "key", "u", "g"), ["lemma"], ["no"]).select("lemma", "key", "u", "g")


def gloss_table(headwords: DataFrame) -> DataFrame:
    """(key, u, g) of the word list, keyed by lower-case SLP1."""
    return headwords.where("u is not null and u <> ''").select(slp1_key_for(F.col("u")).alias("key"), "u", "g")


def dictionary_entries(queries: DataFrame, gloss: DataFrame, most: int = 20) -> DataFrame:
    """(query, rank, key, u, g): exact entries of a query, then those of its sibilant variants, then longer headwords by key.

    Queries whose key has fewer than 2 letters or doesn't begin with one find nothing.
    """
    q = queries.select("query").distinct().withColumn("qkey", slp1_key_for(F.col("query"))).where(F.col("qkey").rlike("^[a-z].+"))
    table = gloss.select("key", "u", "g").distinct()
    variants = tries(q, key_variants(F.col("qkey")), "tier", "key").join(table, "key").select("query", "tier", "key", "u", "g")
    # headwords by each of their beginnings: the prefix search becomes an equality join
    begun = table.where(F.length("key") >= 3).select("*", F.explode(F.sequence(F.lit(2), F.length("key") - 1)).alias("n")).withColumn("qkey", F.substring(F.col("key"), F.lit(1), F.col("n")))
    longer = q.join(begun, "qkey").select("query", F.lit(9).alias("tier"), "key", "u", "g")
    every = first_by(variants.unionByName(longer).withColumn("u", F.coalesce("u", "key")), ["query", "key", "u", "g"], ["tier"])
    rank = F.row_number().over(Window.partitionBy("query").orderBy("tier", "key", "u", "g"))
    return every.withColumn("rank", rank).where(F.col("rank") <= most).select("query", "rank", "key", "u", "g")


def panel_entry(forms: DataFrame, gloss: DataFrame, least: int = 4) -> DataFrame:
    """(form, key, how): the headword of a form's key, else the longest headword that the key begins with."""
    keyed = forms.select("form").distinct().withColumn("fkey", slp1_key_for(F.col("form"))).where("fkey <> ''")
    known = gloss.select("key").distinct()
    exact = keyed.join(known.withColumnRenamed("key", "fkey"), "fkey", "left_semi").select("form", F.col("fkey").alias("key"), F.lit("exact").alias("how"))
    rest = keyed.join(exact, "form", "left_anti")
    return exact.unionByName(longest_prefix(rest, known, ["form"], "fkey", "key", least).select("form", F.col("prefix").alias("key"), F.lit("prefix").alias("how")))


def fallback_stems(keys: DataFrame, morph_keys: DataFrame, headword_keys: DataFrame) -> DataFrame:
    """(key, stem, tier) of keys that the morph table lacks: its stem by trimming 1 or 2 characters, else the longest
    headword (3 characters at least) that it begins with."""
    missing = keys.select("key").distinct().join(morph_keys.select("key").distinct(), "key", "left_anti")
    trimmed = suffix_trim(missing, morph_keys.withColumnRenamed("key", "k"), ["key"], "key", "k").select("key", "stem", F.lit("trim").alias("tier"))
    rest = missing.join(trimmed, "key", "left_anti")
    stems = longest_prefix(rest.withColumn("text", F.col("key")), headword_keys.withColumnRenamed("key", "k"), ["key"], "text", "k", 3)
    return trimmed.unionByName(stems.select("key", F.col("prefix").alias("stem"), F.lit("mw").alias("tier")))


def coverage(token_rows: DataFrame, index: DataFrame, morph_keys: DataFrame) -> DataFrame:
    """By work: words, hits of the index (loose), words one of whose own or members' keys is in the morph table (strict).

    Counted by occurrence; forms are resolved once each. Punctuation doesn't count.
    """
    counted = token_rows.groupBy("work_id", "form").agg(F.count("*").alias("n")).where(~is_punctuation(F.col("form")))
    forms = spread(counted.select("form").distinct(), "form")
    spellings = F.concat(canonical_keys(F.col("form")), F.flatten(F.transform(hyphen_members(F.col("form")), canonical_keys)))
    strict = forms.select("form", F.explode(spellings).alias("key")).join(morph_keys.select("key").distinct(), "key", "left_semi").select("form").distinct().withColumn("strict", F.lit(1))
    loose = index.select("form").distinct().withColumn("loose", F.lit(1))
    joined = counted.join(loose, "form", "left").join(strict, "form", "left")
    total = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0)))
    out = joined.groupBy("work_id").agg(F.sum("n").alias("words"), total("loose").alias("loose_hits"), total("strict").alias("strict_hits"))
    pct = lambda c: F.round(100.0 * F.col(c) / F.col("words"), 1)
    return out.select("*", pct("loose_hits").alias("loose_pct"), pct("strict_hits").alias("strict_pct"))


def unknown_forms(token_rows: DataFrame, known: DataFrame) -> DataFrame:
    """By work: words and how many of their occurrences are of forms not in ``known`` (form)."""
    flagged = token_rows.select("work_id", strip_accents(F.col("form")).alias("form")).join(known.select("form").distinct().withColumn("k", F.lit(1)), "form", "left")
    return flagged.groupBy("work_id").agg(F.count("*").alias("total"), F.count_if(F.col("k").isNull()).alias("unknown"))


def resolve_work(queries: DataFrame, works: DataFrame) -> DataFrame:
    """(query, work_id): a work whose author and id, or id, is the query whatever its case, else the first whose id begins with it.

    works: work_id, author_key, ord (order of the catalog).
    """
    q = queries.select("query", F.lower(F.trim("query")).alias("q")).where("q <> ''")
    w = works.select("work_id", "ord", F.lower("work_id").alias("wid"), F.lower(F.concat_ws("/", "author_key", "work_id")).alias("full"))
    exact = q.join(w, F.col("q") == F.col("full")).select("query", "work_id", "ord", F.lit(0).alias("tier"))
    plain = q.join(w, F.col("q") == F.col("wid")).select("query", "work_id", "ord", F.lit(1).alias("tier"))
    begun = w.select("*", F.explode(F.sequence(F.lit(1), F.length("wid"))).alias("n")).withColumn("q", F.substring(F.col("wid"), F.lit(1), F.col("n")))
    prefix = q.join(begun, "q").select("query", "work_id", "ord", F.lit(2).alias("tier"))
    return first_by(exact.union(plain).union(prefix), ["query"], ["tier", "ord"]).select("query", "work_id")


def member_glosses(lemmas: DataFrame, gloss: DataFrame) -> DataFrame:
    """(lemma, g): gloss of a compound member's lemma by its dictionary keys, else by its own key or a sibilant variant."""
    filled = gloss.where("g is not null and g <> ''")
    asked = lemmas.select("lemma").where("lemma is not null").distinct().where(F.length(slp1_key_for(F.col("lemma"))) >= 2)
    by_keys = glosses(asked, filled).select("lemma", F.lit(0).alias("tier"), "g")
    own = tries(asked, key_variants(slp1_key_for(F.col("lemma"))), "no", "key").where(F.col("key").rlike("^[a-z]")).join(filled.select("key", "g"), "key")
    return first_by(by_keys.unionByName(own.select("lemma", (F.col("no") + 1).alias("tier"), "g")), ["lemma"], ["tier", "g"]).select("lemma", "g")


def source_glosses(parses: DataFrame, gloss: DataFrame, ids: list[str]) -> DataFrame:
    """parses (ids, l, g) with ``source_gloss``: their own gloss if it says something, else an entry's, by headword or by key."""
    from tantu.functions.gloss import compact_gloss

    said = gloss.where("g is not null and g <> ''")
    by_head = first_by(said.select(F.col("u").alias("l"), F.col("g").alias("g1")), ["l"], ["g1"])
    by_plain = first_by(said.select(F.col("u").alias("pl"), F.col("g").alias("g2")), ["pl"], ["g2"])
    by_key = first_by(said.select(F.col("key").alias("lk"), F.col("g").alias("g3")), ["lk"], ["g3"])
    rows = parses.select(*ids, "l", "g", strip_accents(F.col("l")).alias("pl"), slp1_key_for(F.col("l")).alias("lk"))
    joined = rows.join(by_head, "l", "left").join(by_plain, "pl", "left").join(by_key, "lk", "left")
    own = F.when(compact_gloss(F.col("g")).isNotNull(), F.col("g"))
    return joined.select(*ids, "l", F.coalesce(own, "g1", "g2", "g3").alias("source_gloss"))


def token_entries(token_lemmas: DataFrame, gloss: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, u, g): dictionary entries of a token's lemmas (ids, lemma, ord), each headword once, in order of first sight."""
    found = token_lemmas.join(glosses(token_lemmas.select("lemma").distinct(), gloss).select("lemma", "u", "g"), "lemma")
    return first_by(found.select(*ids, "u", "g", "ord"), [*ids, "u"], ["ord", "g"]).select(*ids, "u", "g")


def origin_samples(index: DataFrame, origins: DataFrame, most: int = 3) -> DataFrame:
    """(origin, form, key): for each source the first forms whose key it contributed first (origins: key, origin)."""
    joined = index.select("form", "key").join(origins.select("key", "origin"), "key")
    rank = F.row_number().over(Window.partitionBy("origin").orderBy("form"))
    return joined.withColumn("__r", rank).where(F.col("__r") <= most).select("origin", "form", "key")


def folded_analyses(forms: DataFrame, by_work: DataFrame, overall: DataFrame, morph: DataFrame) -> DataFrame:
    """Analyses of roman forms whose keys need no trust: by the work's slice, then overall, else the folded form itself.

    Published under the form, its plain folded spelling and its folded spelling, where these are not forms of their own.
    forms: work_id, form. Columns: work_id, form, key, ord_no, l, p, f.
    """
    from tantu.functions.keys import fold_niggahita

    keyed = forms.select("work_id", "form").distinct().join(member_keys(forms, by_work, overall), ["work_id", "form"], "left")
    keyed = keyed.withColumn("key", F.coalesce("key", slp1_key_for(fold_niggahita(F.col("form")))))
    found = keyed.join(morph.select(F.col("slp_key").alias("key"), "ord_no", "l", "p", "f"), "key").select("work_id", "form", "key", "ord_no", "l", "p", "f")
    folded = fold_niggahita(F.lower("form"))
    names = found.select("*", F.explode(F.array_distinct(F.array(F.col("form"), strip_accents(folded), folded))).alias("name"))
    own = forms.select("work_id", F.col("form").alias("name")).distinct().withColumn("__own", F.lit(True))
    kept = names.join(own, ["work_id", "name"], "left").where(F.col("__own").isNull() | (F.col("name") == F.col("form")))
    return kept.select("work_id", F.col("name").alias("form"), "key", "ord_no", "l", "p", "f").distinct()
