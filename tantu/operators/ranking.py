"""Analyses of a token grouped by lemma and class, summarised and ranked; every score is one expression over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tantu.functions.feats import compact_feats, has_slots, norm_lemma, pos_abbr, pos_class, slot, SLOTS
from tantu.functions.gloss import gloss_identity, is_name_gloss
from tantu.functions.misc import affinity, dialect_tags, plausible_lemma
from tantu.functions.translit import has_devanagari, iast_to_dev, strip_accents
from tantu.operators.ordered import ordered_dedupe
from tantu.session import spread

# Weights of the ranking.
FREQUENCY = 10
DIALECT = -5
INDECLINABLE = 35
ACCUSATIVE = 42
PARTICIPLE = 34
NAME = -15
SYNTHETIC = -30
STRONG, WEAK, DEMOTED = 0.55, 0.35, -90
# Dialects foreign to prose.
FOREIGN = ["epic", "homeric", "doric", "aeolic", "ionic"]


def dedupe_parses(parses: DataFrame, keys: list[str], order: str = "ord_no") -> DataFrame:
    """Analyses without those that would be displayed alike: same lemma, part of speech, abbreviated tags and gloss.

    The first keeps its place; a later twin with members takes its place over a first one without.
    """
    shown = F.array_join(compact_feats(F.col("f"))["main"], " ")
    rows = parses.withColumn("__pos", pos_abbr(F.col("p"))).withColumn("__tags", shown).withColumn("__l", F.coalesce("l", F.lit(""))).withColumn("__g", F.coalesce("g", F.lit("")))
    out = ordered_dedupe(rows, keys, ["__l", "__pos", "__tags", "__g"], [order], F.col("m").isNotNull())
    return out.withColumn("place", F.col(f"place.{order}")).drop("__pos", "__tags", "__l", "__g")


def distinct_parses(parses: DataFrame, keys: list[str], order: str = "ord_no") -> DataFrame:
    """Analyses without repeats of lemma, part of speech, tags and stem class; the first of each stays."""
    return ordered_dedupe(parses, keys, ["l", "p", "f", "x"], [order])


def lemma_tally(token_parses: DataFrame) -> DataFrame:
    """(lemma, n): how often a lemma is a plausible reading of a token (form, l), by the lemma without accents."""
    lemma = strip_accents(F.coalesce("l", F.lit("")))
    rows = token_parses.withColumn("lemma", lemma).where("lemma <> ''")
    return rows.where(plausible_lemma(norm_lemma(strip_accents(F.col("form"))), norm_lemma(F.col("lemma")))).groupBy("lemma").agg(F.count("*").alias("n"))


def prefer_accusative(parses: DataFrame, keys: list[str], form: str = "form") -> DataFrame:
    """Without nominatives that have an accusative twin (lemma, gender, number), for participles of forms in -am."""
    ends = F.when(has_devanagari(F.col(form)), F.col(form).rlike("(?:म्|ं)$")).otherwise(F.col(form).rlike("(?i)m$"))
    participle = F.trim(F.coalesce("l", F.lit(""))).rlike("त्?$")
    twin = [norm_lemma(F.col("l")), F.coalesce(F.try_element_at(slot(F.col("f"), "gender"), F.lit(1)), F.lit("")), F.coalesce(F.try_element_at(slot(F.col("f"), "number"), F.lit(1)), F.lit(""))]
    case = slot(F.col("f"), "kcase")
    rows = parses.withColumn("__acc", (F.array_contains(case, "acc.") & participle).cast("int"))
    has = F.max("__acc").over(Window.partitionBy(*keys, *twin))
    return rows.withColumn("__has", has).where(~(F.coalesce(ends, F.lit(False)) & participle & F.array_contains(case, "nom.") & (F.col("__has") == 1))).drop("__acc", "__has")


def grouped(parses: DataFrame, keys: list[str], order: str = "ord_no", best: list[str] | None = None) -> DataFrame:
    """(keys, lemma_key, cls, first, lemma, members): analyses by normal lemma and class, in order of first sight.

    A token none of whose analyses is inflected is one group (class indecl) under its most frequent lemma, the first of
    equals. members: array of structs of the analysis, in order. Of the columns ``best`` the greatest of a group is kept.
    """
    member = F.struct(F.col(order).alias("ord"), "l", "p", "f", "g", "x")
    rows = parses.withColumn("__k", norm_lemma(F.col("l"))).withColumn("__c", pos_class(F.col("p"), F.col("f"))).withColumn("__bare", ~has_slots(F.col("f"))).withColumn("__m", member)
    token = Window.partitionBy(*keys)
    said = F.coalesce("l", F.lit(""))
    rows = rows.withColumn("__all", F.min("__bare").over(token)).withColumn("__n", F.count("*").over(Window.partitionBy(*keys, "__k")))
    modal = F.max_by("__k", F.struct("__n", -F.col(order), "__k")).over(token)
    modal_lemma = F.max_by(said, F.struct(F.col("__n"), -F.col(order), said)).over(token)
    rows = rows.withColumn("lemma_key", F.when(F.col("__all"), modal).otherwise(F.col("__k"))).withColumn("cls", F.when(F.col("__all"), "indecl").otherwise(F.col("__c"))).withColumn("__lead", F.when(F.col("__all"), modal_lemma))
    lemma = F.coalesce(F.max("__lead"), F.min_by(said, F.struct(F.col(order), said)))
    return rows.groupBy(*keys, "lemma_key", "cls").agg(F.min(order).alias("first"), lemma.alias("lemma"), F.array_sort(F.collect_list("__m")).alias("members"), *[F.max(c).alias(c) for c in best or []])


def summary(members: Column) -> Column:
    """Abbreviations that sum up a group: one value as it is, up to three joined, more as "various"."""
    wide = {"tense": "various tenses", "voice": "various voices", "person": "various persons", "gender": "m./f./n.", "number": "sg./du./pl.", "kcase": "various cases"}

    def of(name: str) -> Column:
        values = F.array_distinct(F.flatten(F.transform(members, lambda m: slot(m["f"], name))))
        return F.when(F.size(values) == 0, F.lit(None).cast("string")).when(F.size(values) <= 3, F.array_join(values, "/")).otherwise(F.lit(wide[name]))

    parts = {name: of(name) for name in SLOTS}
    nominal = F.array(parts["tense"], parts["voice"], parts["gender"], parts["number"], parts["kcase"])
    verbal = F.array(parts["tense"], parts["person"], parts["number"], parts["voice"], parts["kcase"])
    tags = F.array_compact(F.when(parts["gender"].isNotNull(), nominal).otherwise(verbal))
    return F.filter(tags, lambda t, i: (i == 0) | (t != F.element_at(tags, F.greatest(i, F.lit(1)))))


def parse_score(form: Column, l: Column, p: Column, f: Column, x: Column, gloss: Column, frequency: Column, prose: bool = False) -> Column:  # noqa: E741
    """Score of one analysis of a form: corpus frequency of its lemma and what speaks for or against the reading."""
    deva = F.when(has_devanagari(form), form).otherwise(iast_to_dev(form))
    form_norm, lemma_norm = norm_lemma(deva), norm_lemma(l)
    cls = pos_class(p, f)
    exact = (form_norm != "") & (lemma_norm == form_norm)
    ends = F.when(has_devanagari(form), deva.rlike("म्$") | form.rlike("ं$")).otherwise(form.rlike("(?i)m$"))
    stem = F.regexp_replace(deva, "(?:म्|[ंः])$", "")
    participle = ends & (stem != "") & (norm_lemma(stem) == lemma_norm) & F.trim(l).rlike("त्?$")
    term = lambda cond, value: F.when(F.coalesce(cond, F.lit(False)), F.lit(value)).otherwise(F.lit(0))
    score = (
        F.log2(1 + F.coalesce(frequency, F.lit(0))) * FREQUENCY
        + term((cls == "indecl") & (affinity(form_norm, lemma_norm) >= WEAK), INDECLINABLE)
        + term((F.trim(F.coalesce(p, F.lit(""))) == "stem") | F.coalesce(f, F.lit("")).contains("(inferred)"), SYNTHETIC)
        + term(~exact & (cls != "indecl") & is_name_gloss(gloss), NAME)
        + term(ends & F.array_contains(slot(f, "kcase"), "acc."), ACCUSATIVE)
        + term(participle, PARTICIPLE)
    )
    if prose:
        score = score + term(F.arrays_overlap(dialect_tags(x), F.array(*[F.lit(d) for d in FOREIGN])), DIALECT)
    return score


def ranked_groups(parses: DataFrame, keys: list[str], frequency: DataFrame, gloss: DataFrame | None = None, order: str = "ord_no", form: str = "form", prose: bool = False) -> DataFrame:
    """(keys, rank, lemma, cls, score, summary, n): groups of each token, best first; ties in order of first sight, then by lemma and class.

    A group's score is the best of its analyses'; where some lemma is near the form, groups far from it are demoted.
    frequency: (lemma, n). gloss: (l, gl), glosses of lemmas for analyses that have none.
    """
    rows = spread(prefer_accusative(parses, keys, form), *keys)
    rows = rows.join(gloss, "l", "left") if gloss is not None else rows.withColumn("gl", F.lit(None).cast("string"))
    rows = rows.withColumn("g", F.coalesce("g", "gl")).withColumn("__fl", strip_accents(F.coalesce("l", F.lit(""))))
    rows = rows.join(frequency.select(F.col("lemma").alias("__fl"), F.col("n").alias("__freq")), "__fl", "left")
    deva = F.when(has_devanagari(F.col(form)), F.col(form)).otherwise(iast_to_dev(F.col(form)))
    rows = rows.withColumn("__score", parse_score(F.col(form), F.col("l"), F.col("p"), F.col("f"), F.col("x"), F.col("g"), F.col("__freq"), prose)).withColumn("__near", affinity(norm_lemma(deva), norm_lemma(F.col("l"))))
    scored = grouped(rows, keys, order, ["__score", "__near"])
    token = Window.partitionBy(*keys)
    demoted = (F.max("__near").over(token) >= STRONG) & (F.col("__near") < WEAK)
    scored = scored.withColumn("score", F.round(F.col("__score") + F.when(demoted, DEMOTED).otherwise(0), 6))
    rank = F.row_number().over(token.orderBy(F.desc("score"), "first", "lemma_key", "cls"))
    return scored.select(*keys, rank.alias("rank"), "lemma", "cls", "score", summary(F.col("members")).alias("summary"), F.size("members").alias("n"), "members")


def top_parses(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, l, p, f, hidden): the best analysis of each token and how many groups stay hidden behind it."""
    size = F.count("*").over(Window.partitionBy(*keys))
    best = ranked.withColumn("hidden", size - 1).where("rank = 1")
    return best.select(*keys, F.element_at("members", 1)["l"].alias("l"), F.element_at("members", 1)["p"].alias("p"), F.element_at("members", 1)["f"].alias("f"), "hidden")


def shown_parses(token_rows: DataFrame, occurrence: DataFrame, top: DataFrame, keys: list[str]) -> DataFrame:
    """The parse shown under a token: its occurrence's if the edition has one, else the best ranked; ``source`` tells which."""
    occ = occurrence.select(*keys, F.struct("l", "p", "f").alias("o"))
    best = top.select(*keys, F.struct("l", "p", "f").alias("t"), "hidden")
    joined = token_rows.join(occ, keys, "left").join(best, keys, "left")
    pick = F.coalesce("o", "t")
    return joined.select(*token_rows.columns, pick["l"].alias("l"), pick["p"].alias("p"), pick["f"].alias("f"), F.when(F.col("o").isNotNull(), "occurrence").when(F.col("t").isNotNull(), "ranked").alias("source"), F.when(F.col("o").isNull(), F.col("hidden")).alias("hidden"))


def suppress_repeats(rows: DataFrame, keys: list[str], order: list[str], gloss: str = "g") -> DataFrame:
    """Adds ``shown``: a gloss is shown the first time that its short sense appears among a token's rows."""
    sense = gloss_identity(F.col(gloss))
    n = F.row_number().over(Window.partitionBy(*keys, sense).orderBy(*order))
    return rows.withColumn("shown", (sense != "") & (n == 1))
