"""Small text and number functions: affinities, colours, times, credits, routes, speakers, Beta Code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tantu.functions.translit import dev_to_iast, has_devanagari, iast_to_dev


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common beginning."""
    steps = F.sequence(F.lit(0), F.least(F.length(a), F.length(b)))
    same = F.filter(steps, lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.coalesce(F.array_max(same), F.lit(0))


def common_suffix(a: Column, b: Column) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b))


def affinity(form: Column, lemma: Column) -> Column:
    """Share of the form that the lemma begins with; 1 if either is empty."""
    empty = (F.length(F.coalesce(form, F.lit(""))) == 0) | (F.length(F.coalesce(lemma, F.lit(""))) == 0)
    return F.when(empty, F.lit(1.0)).otherwise(common_prefix(form, lemma) / F.length(form))


def plausible_lemma(word: Column, lemma: Column) -> Column:
    """Whether a lemma can be a reading of a word: one holds the other, or they share a first letter or a two-letter end.

    word and lemma in the normal form of grouping; their keys are compared as well.
    """
    from tantu.functions.translit import slp1_key_for

    a, b = word, lemma
    fa, fb = slp1_key_for(a), slp1_key_for(b)
    blank = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.coalesce(blank | a.contains(b) | b.contains(a) | (common_prefix(fa, fb) >= 1) | (common_suffix(fa, fb) >= 2) | (common_prefix(a, b) >= 1) | (common_suffix(a, b) >= 2), F.lit(True))


def diff_tokens(sets: Column, index: Column) -> Column:
    """Tokens of sets[index] that not all sets have; none for fewer than two sets."""
    common = F.aggregate(sets, F.try_element_at(sets, F.lit(1)), lambda acc, s: F.array_intersect(acc, s))
    own = F.array_distinct(F.try_element_at(sets, index + 1))
    return F.when(F.size(sets) < 2, F.array().cast("array<string>")).otherwise(F.array_except(own, common))


def hash_color(text: Column) -> Column:
    """0 to 9 by the polynomial 31 hash of the code points, modulo 2^32."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    whole = F.aggregate(letters, F.lit(0).cast("bigint"), lambda h, c: F.pmod(h * 31 + F.ascii(c), F.lit(4294967296)))
    return F.pmod(whole, F.lit(10)).cast("int")


def rel_time(seconds: Column) -> Column:
    """How long ago, rounded half up at each unit: seconds, minutes, hours, days."""
    half_up = lambda x: F.floor(x + 0.5)
    s = F.greatest(F.lit(1), half_up(seconds))
    m = half_up(s / 60)
    h = half_up(m / 60)
    d = half_up(h / 24)
    say = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(s < 60, say(s, "s ago")).when(m < 60, say(m, "m ago")).when(h < 24, say(h, "h ago")).otherwise(say(d, "d ago"))


def credit_line(translator: Column, year: Column, license: Column) -> Column:
    """Translator, year and licence of a translation; a year without a translator reads as an edition."""
    given = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    who = F.concat_ws(" ", F.concat(F.lit("Trans. "), given(translator)), given(year))
    return F.when(given(translator).isNull() & year.isNotNull(), F.concat_ws(" · ", given(year), given(license))).otherwise(F.concat_ws(" · ", F.nullif(who, F.lit("")), given(license)))


def work_route(work_id: Column, ref: Column | None = None) -> Column:
    """Address of a work, and of a passage in it."""
    base = F.concat(F.lit("#/"), work_id)
    return base if ref is None else F.concat(base, F.when(ref.isNotNull(), F.concat(F.lit("?ref="), F.call_function("url_encode", ref))).otherwise(""))


def parse_route(route: Column) -> Column:
    """struct<page, author, work_id, ref> of an address: home, about, pali, or a work, with or without its author."""
    path = F.regexp_replace(F.coalesce(route, F.lit("")), "^#?/*|/+$", "")
    base = F.substring_index(path, "?", 1)
    parts = F.filter(F.split(base, "/"), lambda p: p != "")
    ref = F.nullif(F.call_function("url_decode", F.regexp_extract(path, r"[?&]ref=([^&]*)", 1)), F.lit(""))
    n = F.size(parts)
    page = F.when(n == 0, "home").when((n == 1) & (base == "about"), "about").when(F.element_at(F.concat(parts, F.array(F.lit(""))), 1) == "pali", "pali").otherwise("work")
    work = F.when((page == "work") | ((page == "pali") & (n > 1)), F.try_element_at(parts, F.lit(-1)))
    author = F.when((page == "work") & (n > 1), F.try_element_at(parts, F.lit(1)))
    return F.struct(page.alias("page"), author.alias("author"), work.alias("work_id"), ref.alias("ref"))


# Verbs that follow a speaker's name, words that are no name, short forms of names.
SAY_VERBS = ["said", "says", "replied", "answered", "asked", "exclaimed", "continued", "rejoined", "added", "observed", "remarked", "returned", "responded", "cried", "declared", "stated", "inquired"]
NOT_SPEAKERS = [
    "He", "She", "They", "It", "We", "You", "I", "The", "This", "That", "There", "Here", "Then", "When", "Why", "How", "What", "Where", "Which", "Who", "Whom", "A", "An", "And", "But", "Or",
    "If", "So", "Because", "Since", "Although",
]
SHORT_NAMES = {"soc": "Socrates", "ion": "Ion", "cri": "Crito", "ceb": "Cebes", "sim": "Simmias"}


def english_speaker(text: Column) -> Column:
    """The name that opens a passage, null if none does: one or two words before a colon or a verb of saying, or a short form.

    Read from the first tokens (runs of letters, single signs) of the passage. Before a colon both words are capitalised,
    before a verb the first is.
    """
    opening = F.array_join(F.slice(F.split(F.ltrim(text, F.lit(" \t\n\r")), r"\s+", 6), 1, 5), " ")
    tokens = F.regexp_extract_all(opening, F.lit("[A-Za-z]+|[^A-Za-z ]"), F.lit(0))
    t = [F.coalesce(F.try_element_at(tokens, F.lit(i)), F.lit("")) for i in (1, 2, 3)]
    capital = lambda x: x.rlike("^[A-Z][a-z]+$")
    says = lambda x: F.lower(x).isin(SAY_VERBS)
    pair = F.concat_ws(" ", t[0], t[1])
    by_colon = F.when(capital(t[0]) & (t[1] == ":"), t[0]).when(capital(t[0]) & capital(t[1]) & (t[2] == ":"), pair)
    short = F.when(t[1].isin(":", "."), _map(SHORT_NAMES)[F.lower(t[0])])
    first = t[0].rlike("^[A-Z][a-z]")
    by_verb = F.when(first & t[1].rlike("^[A-Za-z]{2}") & says(t[2]), pair).when(first & says(t[1]), t[0])
    name = F.coalesce(by_colon, F.when(by_colon.isNull(), short), by_verb)
    blocked = F.when(by_colon.isNotNull() | short.isNull(), t[0].isin(NOT_SPEAKERS)).otherwise(F.lit(False))
    return F.when(name.isNotNull() & ~blocked, F.initcap(name))


def display(token: Column, script: str) -> Column:
    """A token in the wanted script (deva or iast); tokens of other scripts pass."""
    if script == "iast":
        return F.when(has_devanagari(token), dev_to_iast(token)).otherwise(token)
    return F.when(has_devanagari(token) | ~token.rlike("[A-Za-zāīūṛṝḷḹṅñṭḍṇśṣṃḥ]"), token).otherwise(iast_to_dev(token))


def dialect_tags(x: Column) -> Column:
    return F.filter(F.split(F.substring_index(F.coalesce(x, F.lit("")), "|", 1), r"\s+"), lambda t: t != "")


def natural_key(text: Column) -> Column:
    """Sort key in which numbers count by value: runs of digits padded to 20 places, the rest in lower case."""
    pieces = F.regexp_extract_all(F.lower(text), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 20, "0")).otherwise(p)), "")


# Beta Code letters in the order of the Greek alphabet.
BETA = dict(zip("αβγδεζηθικλμνξοπρστυφχψω", "abgdezhqiklmncoprstufxyw", strict=True))
# Combining marks and their Beta Code signs, in the order in which they are written.
BETA_MARKS = {"̓": ")", "̔": "(", "̈": "+", "́": "/", "̀": "\\", "͂": "=", "ͅ": "|"}


def to_beta(nfd: Column) -> Column:
    """Greek (decomposed) to Beta Code; a capital gets a star and its marks before the letter."""
    out = F.translate(nfd, "ς", "σ")
    out = F.translate(out, "".join(BETA_MARKS), "".join(BETA_MARKS.values()))
    upper = "".join(BETA).upper()
    out = F.regexp_replace(out, f"([{upper}])([)(+/\\\\=|]*)", "*$2$1")
    return F.translate(out, "".join(BETA) + upper, "".join(BETA.values()) * 2)


def from_beta(code: Column) -> Column:
    """Beta Code to Greek, with combining marks after their letter; length signs go, s at the end of a word is final."""
    out = F.translate(code, "^_", "")
    out = F.regexp_replace(out, r"\*([)(+/\\=|]*)([a-zA-Z])", "*$2$1")
    out = F.regexp_replace(out, "[sj](?![a-z)(+/\\\\=|])", "ς")
    out = F.translate(out, "".join(BETA.values()) + "j", "".join(BETA) + "σ")
    out = F.translate(out, "".join(BETA_MARKS.values()), "".join(BETA_MARKS))
    for small in BETA:
        out = F.replace(out, F.lit("*" + small), F.lit(small.upper()))
    return F.regexp_replace(F.regexp_replace(out, "^-+|-+$", ""), "-[\\s\\S]*$", "")


# Letters for parts of speech, short names of features.
POS_CODE = {
    "noun": "N", "verb": "V", "participle": "P", "adjective": "A", "adverb": "D", "conjunction": "C", "preposition": "R", "pronoun": "X", "article": "L", "particle": "G", "numeral": "M",
    "interjection": "E", "exclamation": "E", "punctuation": "U",
}
FEATURE_ABBR = {
    "nominative": "nom", "genitive": "gen", "dative": "dat", "accusative": "acc", "vocative": "voc", "ablative": "abl", "masculine": "masc", "feminine": "fem", "neuter": "neut", "common": "masc/fem",
    "singular": "sg", "plural": "pl", "dual": "dual", "present": "pres", "imperfect": "impf", "future": "fut", "aorist": "aor", "perfect": "perf", "pluperfect": "plup", "indicative": "ind",
    "subjunctive": "subj", "optative": "opt", "imperative": "imperat", "infinitive": "inf", "participle": "part", "gerund": "ger", "active": "act", "middle": "mid", "passive": "pass",
    "comparative": "comp", "superlative": "sup",
}


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def pos_code(name: Column) -> Column:
    return F.coalesce(_map(POS_CODE)[F.lower(F.trim(name))], F.upper(F.substring(F.trim(name), 1, 1)))


def feature_abbr(value: Column) -> Column:
    """Short names of a feature value, each part of a slash-separated one by itself."""
    parts = F.transform(F.split(F.trim(value), "/"), lambda s: F.trim(s))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(_map(FEATURE_ABBR)[F.lower(p)], p)), "/")


def roman_initial(word: Column) -> Column:
    """First letter a to z of a word in lower case, null without one."""
    return F.nullif(F.regexp_extract(F.lower(word), "[a-z]", 0), F.lit(""))


def pos_label(cls: Column) -> Column:
    """Name of a class of readings."""
    return F.coalesce(_map({"indecl": "indeclinable", "noun": "noun", "verb": "verb", "part": "participle"})[cls], F.lit("other"))


def feature_segments(f: Column) -> Column:
    """Tags of a string in its segments (divided by a middle dot), one array for each segment."""
    segments = F.filter(F.split(F.coalesce(f, F.lit("")), " · "), lambda s: F.trim(s) != "")
    return F.transform(segments, lambda s: F.filter(F.split(s, r"[;\s|]+"), lambda t: t != ""))


def speaker_run(words: Column, names: Column, most: int = 2) -> Column:
    """How many words at the start of a unit are speakers: names in title or upper case, ``most`` at most."""
    head = F.slice(words, 1, most)
    is_speaker = lambda w: F.coalesce(w.rlike(r"^(?:\p{Lu}\p{Ll}+|\p{Lu}+)[.:]?$") & F.array_contains(names, F.lower(F.regexp_replace(w, "[.:]$", ""))), F.lit(False))
    flags = F.transform(head, is_speaker)
    return F.aggregate(flags, F.lit(0), lambda n, s: F.when((n >= 0) & s, n + 1).when(n >= 0, -n - 1).otherwise(n), lambda n: F.when(n < 0, -n - 1).otherwise(n))


def default_layer(stored: Column, has_en: Column, has_zh: Column) -> Column:
    """The translation shown first: the stored choice if it is one, else English if there is one, else Chinese."""
    return F.when(stored.isin("en", "zh", "off"), stored).when(has_en, F.lit("en")).when(has_zh, F.lit("zh")).otherwise(F.lit("off"))
