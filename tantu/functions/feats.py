"""Grammar: features of tokens from annotation schemes to tags, tags to abbreviations and slots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tantu.functions.translit import strip, strip_accents

# Tags of cases, genders, numbers, persons, voices and tenses, from the annotation scheme's names.
CASE = {"Nom": "1", "Acc": "2", "Ins": "3", "Dat": "4", "Abl": "5", "Gen": "6", "Loc": "7", "Voc": "सम्बोधन"}
GENDER = {"Masc": "पुं", "Fem": "स्त्री", "Neut": "नपुं"}
NUMBER = {"Sing": "एक", "Dual": "द्वि", "Plur": "बहु"}
PERSON = {"1": "उत्तम", "2": "मध्यम", "3": "प्रथम"}
VOICE = {"Act": "परस्मैपद", "Mid": "आत्मनेपद", "Pass": "आत्मनेपद"}
TENSE_MOOD = {
    ("Pres", "Ind"): "लट्", ("Impf", "Ind"): "लङ्", ("Fut", "Ind"): "लृट्", ("Fut", ""): "लृट्", ("Cond", ""): "लृङ्", ("Perf", ""): "लिट्", ("Aor", ""): "लुङ्",
    ("Imp", "Imp"): "लोट्", ("Pres", "Subj"): "विधिलिङ्", ("Pres", "Opt"): "विधिलिङ्", ("", "Subj"): "विधिलिङ्", ("", "Opt"): "विधिलिङ्",
}
# Abbreviations of the tags.
ABBR_CASE = {"1": "nom.", "2": "acc.", "3": "ins.", "4": "dat.", "5": "abl.", "6": "gen.", "7": "loc.", "सम्बोधन": "voc."}
ABBR_GENDER = {"पुं": "m.", "स्री": "f.", "स्त्री": "f.", "नपुं": "n."}
ABBR_NUMBER = {"एक": "sg.", "द्वि": "du.", "बहु": "pl."}
ABBR_PERSON = {"उत्तम": "1st", "मध्यम": "2nd", "प्रथम": "3rd"}
ABBR_TENSE = {"लट्": "pres.", "लङ्": "impf.", "लृट्": "fut.", "लृङ्": "cond.", "लिट्": "perf.", "लुङ्": "aor.", "लोट्": "imperat.", "विधिलिङ्": "opt."}
ABBR_VOICE = {"परस्मैपद": "act.", "आत्मनेपद": "mid."}
SLOTS = {"tense": ABBR_TENSE, "person": ABBR_PERSON, "voice": ABBR_VOICE, "gender": ABBR_GENDER, "number": ABBR_NUMBER, "kcase": ABBR_CASE}


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def parse_feats(field: Column) -> Column:
    """array<struct<k, v>> of a ``k=v|k=v`` field in its order: the last value of a key counts, keyless features have ''.

    ``_`` and null are empty; a pair without a key or a value is dropped.
    """
    parts = F.filter(F.transform(F.split(F.coalesce(field, F.lit("_")), r"\|"), lambda s: strip(s)), lambda p: (p != "") & (p != "_"))
    pair = lambda p: F.struct(
        F.when(p.contains("="), F.substring_index(p, "=", 1)).otherwise(p).alias("k"),
        F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise(F.lit("")).alias("v"),
    )
    kept = F.filter(parts, lambda p: ~p.contains("=") | p.rlike("^[^=]+=.+$"))
    pairs = F.transform(kept, pair)
    keys = F.array_distinct(F.transform(pairs, lambda x: x["k"]))
    last = lambda k: F.element_at(F.filter(pairs, lambda x: x["k"] == k), -1)
    return F.transform(keys, last)


def feat(feats: Column, key: str) -> Column:
    """Value of a feature, null if absent."""
    return F.try_element_at(F.filter(feats, lambda x: x["k"] == key), F.lit(1))["v"]


def map_pos(upos: Column, feats: Column) -> Column:
    """Coarse part of speech: noun, verb, part or indecl."""
    form = F.coalesce(feat(feats, "VerbForm"), F.lit(""))
    verbal = F.when(form.isin("Fin", ""), "verb").when(form == "Conv", "indecl").otherwise("part")
    return (
        F.when(upos.isin("NOUN", "ADJ", "NUM"), "noun")
        .when(upos.isin("VERB", "AUX"), verbal)
        .when(upos.isin("ADV", "PART", "CONJ", "SCONJ", "ADP", "INTJ"), "indecl")
        .otherwise("part")
    )


def map_feats(upos: Column, feats: Column) -> Column:
    """Tags joined by ;: finite verbs tense, person, number, voice; participles tense, voice, gender, case, number; else gender, case, number.

    Values without a tag stand as they are; features of no slot follow in their order.
    """
    tenses = _map({f"{t}|{m}": tag for (t, m), tag in TENSE_MOOD.items()})
    tense, mood = F.coalesce(feat(feats, "Tense"), F.lit("")), F.coalesce(feat(feats, "Mood"), F.lit(""))
    exact, plain = tenses[F.concat_ws("|", tense, mood)], tenses[F.concat(tense, F.lit("|"))]
    tag = lambda key, table: F.coalesce(_map(table)[feat(feats, key)], feat(feats, key))
    person, number, voice = tag("Person", PERSON), tag("Number", NUMBER), tag("Voice", VOICE)
    gender, case = tag("Gender", GENDER), tag("Case", CASE)
    verbal = upos.isin("VERB", "AUX")
    form = F.coalesce(feat(feats, "VerbForm"), F.lit(""))
    finite, participle = verbal & form.isin("Fin", ""), verbal & (form == "Part")
    some = lambda *tags: F.array(*tags)
    main = (
        F.when(finite, some(exact, person, number, voice))
        .when(participle, some(F.when(tense != "", F.coalesce(exact, plain)), voice, gender, case, number))
        .otherwise(some(gender, case, number))
    )
    rest = lambda *keys: F.transform(F.filter(feats, lambda x: ~x["k"].isin(*keys) & (x["v"] != "")), lambda x: x["v"])
    extras = (
        F.when(finite, rest("VerbForm", "Tense", "Mood", "Person", "Number", "Voice"))
        .when(participle, rest("VerbForm", "Tense", "Mood", "Voice", "Gender", "Case", "Number"))
        .otherwise(rest("Gender", "Case", "Number"))
    )
    return F.array_join(F.concat(F.array_compact(main), extras), ";")


def parse_analysis(field: Column) -> Column:
    """array<struct<l, p, f>> of ``form{tag}{tag;tag}/form{tag}``: unclosed readings and those without a form are dropped."""
    paths = F.transform(F.split(F.coalesce(field, F.lit("")), "/"), lambda s: strip(s))
    whole = F.filter(paths, lambda p: (p != "") & (~p.contains("{") | p.contains("}")) & (strip(F.regexp_extract(p, "^([^{}]*)", 1)) != ""))

    def reading(path: Column) -> Column:
        form = strip(F.regexp_extract(path, "^([^{}]*)", 1))
        tags = F.filter(F.transform(F.slice(F.split(path, "[{}]"), F.lit(2), F.size(F.split(path, "[{}]"))), lambda s: strip(s)), lambda t: t != "")
        first, every = F.try_element_at(tags, F.lit(1)), F.array_join(tags, ";")
        pos = (
            F.when(first.isNull(), "")
            .when(first == "अव्य", "indecl")
            .when(first.isin("पुं", "स्त्री", "नपुं"), "noun")
            .when(first.rlike("प्रथम|मध्यम|उत्तम"), "verb")
            .otherwise("part")
        )
        f = F.when(first == "अव्य", F.array_join(F.slice(tags, F.lit(2), F.size(tags)), ";")).otherwise(every)
        return F.struct(form.alias("l"), pos.alias("p"), f.alias("f"))

    return F.transform(whole, reading)


def contextual_parse(context: Column) -> Column:
    """The one reading of a row's context, null if it has none or several."""
    parses = parse_analysis(context)
    return F.when(F.size(parses) == 1, F.element_at(parses, 1))


def mark_inferred(f: Column) -> Column:
    return F.concat_ws(";", F.nullif(F.coalesce(f, F.lit("")), F.lit("")), F.lit("(inferred)"))


def tag_tokens(f: Column) -> Column:
    return F.filter(F.split(F.coalesce(f, F.lit("")), r"[;\s|]+"), lambda t: t != "")


def slot(f: Column, name: str) -> Column:
    """Abbreviations of one inflectional dimension of a tag string, each once, in order."""
    table = _map(SLOTS[name])
    return F.array_distinct(F.array_compact(F.transform(tag_tokens(f), lambda t: table[t])))


def feat_slots(f: Column) -> Column:
    return F.struct(*[slot(f, name).alias(name) for name in SLOTS])


def has_slots(f: Column) -> Column:
    every = _map({k: v for table in SLOTS.values() for k, v in table.items()})
    return F.exists(tag_tokens(f), lambda t: every[t].isNotNull())


def compact_feats(f: Column) -> Column:
    """struct<main, extras>: abbreviations in reading order (the last tense counts) and the tags that have none.

    With a gender: tense, voice, gender, number, case; else tense, person, number, voice, case. Unknown single digits
    count as cases and stand as they are.
    """
    tokens = tag_tokens(f)
    named = lambda name: F.array_compact(F.transform(tokens, lambda t: _map(SLOTS[name])[t]))
    digit = lambda t: F.when(t.rlike("^[0-9]$"), t)
    case = F.array_compact(F.transform(tokens, lambda t: F.coalesce(_map(ABBR_CASE)[t], digit(t))))
    tense, person, voice, gender, number = (named(n) for n in ("tense", "person", "voice", "gender", "number"))
    first = F.slice(tense, -1, 1)
    first = F.when(F.size(tense) > 0, first).otherwise(F.array().cast("array<string>"))
    main = F.when(F.size(gender) > 0, F.concat(first, voice, gender, number, case)).otherwise(F.concat(first, person, number, voice, case))
    known = _map({k: v for table in SLOTS.values() for k, v in table.items()})
    extras = F.filter(tokens, lambda t: known[t].isNull() & ~t.rlike("^[0-9]$"))
    return F.struct(main.alias("main"), extras.alias("extras"))


def pos_abbr(p: Column) -> Column:
    table = _map({"noun": "n.", "verb": "v.", "part": "ptcp.", "indecl": "indecl."})
    given = strip(F.coalesce(p, F.lit("")))
    return F.coalesce(table[given], F.when(given != "", F.concat(p, F.lit("."))), F.lit(""))


def pos_class(p: Column, f: Column) -> Column:
    """noun, verb, part, indecl or other; a participle without tense and voice counts as a noun."""
    given = strip(F.coalesce(p, F.lit("")))
    bare = (F.size(slot(f, "tense")) == 0) & (F.size(slot(f, "voice")) == 0)
    return F.when(given.isin("noun", "verb", "indecl"), given).when(given == "part", F.when(bare, "noun").otherwise("part")).otherwise("other")


def is_samasa(m: Column) -> Column:
    """A genuine compound: of its first 8 members two at least, the first marked Cpd, the head inflected and no verb."""
    members = F.slice(F.filter(F.coalesce(m, F.array().cast("array<struct<d:string,l:string,p:string,f:string>>")), lambda x: x.isNotNull()), 1, 8)
    head = F.try_element_at(members, F.lit(-1))
    cases = F.array(*[F.lit(c) for c in ABBR_CASE])
    return F.coalesce(
        (F.size(members) >= 2)
        & F.array_contains(tag_tokens(F.try_element_at(members, F.lit(1))["f"]), "Cpd")
        & ~F.coalesce(head["p"], F.lit("")).isin("indecl", "verb")
        & F.arrays_overlap(tag_tokens(head["f"]), cases),
        F.lit(False),
    )


def norm_lemma(lemma: Column) -> Column:
    """A lemma's identity in grouping: no accents, outer brackets or homonym number; visarga and anusvara resolved."""
    out = F.regexp_replace(strip_accents(F.coalesce(lemma, F.lit(""))), r"^[(\[]+|[)\]]+$", "")
    out = F.regexp_replace(out, r"^([\s\S]*\D)\d+$", "$1")
    return F.replace(F.replace(out, F.lit("ः"), F.lit("स्")), F.lit("ं"), F.lit("म्"))


def canonical_group_key(lemma: Column) -> Column:
    return F.regexp_replace(norm_lemma(lemma), "्$", "")
