"""Lookup keys of words and lemmas, and the order in which they are tried."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tantu.functions.translit import dev_to_iast, has_devanagari, iast_to_dev, slp1_key, slp1_key_for, strip

VALID = "^[a-z~]+$"
# What counts as punctuation in a displayed token.
PUNCTUATION = "^[।॥0-9.,;:!?“”'\"()\\-\\s]+$"


def valid_key(col: Column) -> Column:
    return col.rlike(VALID)


def valid_keys(keys: Column) -> Column:
    """The keys of an array that are valid, each once, in order."""
    return F.array_distinct(F.filter(keys, lambda k: k.isNotNull() & k.rlike(VALID)))


def is_punctuation(col: Column) -> Column:
    return col.rlike(PUNCTUATION)


def key_variants(key: Column) -> Column:
    """The key and, where it has a retroflex sibilant, the key with the palatal one."""
    return F.array_distinct(F.array(key, F.lower(F.replace(key, F.lit("z"), F.lit("S")))))


def _no_apostrophe(col: Column) -> Column:
    return F.translate(col, "'’", "")


def canonical_keys(form: Column) -> Column:
    """Valid keys of a surface form: by its own script and by way of the other, without apostrophes."""
    plain = _no_apostrophe(form)
    other = F.when(has_devanagari(plain), dev_to_iast(plain)).otherwise(iast_to_dev(plain))
    both = F.transform(F.array(plain, other), lambda x: _no_apostrophe(slp1_key(x)))  # bound, as a key names its text several times
    return valid_keys(both)


def trusted_keys(form: Column) -> Column:
    """Keys under which a form's own analyses can stand: of Devanagari also its romanisation, if that is plain letters."""
    roman = F.lower(dev_to_iast(form))
    both = F.array(slp1_key_for(form), F.when(has_devanagari(form) & roman.rlike("^[a-z]+$"), roman))
    return valid_keys(both)


def surface_key_trusted(form: Column, key: Column) -> Column:
    return F.array_contains(trusted_keys(form), key)


def hyphen_members(form: Column) -> Column:
    """The members of a hyphenated form, none for a plain one."""
    parts = F.filter(F.transform(F.split(form, "-"), lambda s: strip(s)), lambda p: p != "")
    return F.when(form.contains("-"), parts).otherwise(F.array().cast("array<string>"))


def form_keys(form: Column) -> Column:
    """Keys of a form and of its hyphen members, in order."""
    forms = F.concat(F.array(strip(form)), hyphen_members(form))
    return F.array_distinct(F.flatten(F.transform(F.filter(forms, lambda f: f != ""), canonical_keys)))


def variant_keys(field: Column) -> Column:
    """Keys of a field with variants (; or ,), wrapping marks gone, each with its hyphen members."""
    trimmed = F.transform(F.split(field, "[;,]"), lambda v: F.regexp_replace(strip(v), "^[()«»\"'“”]+|[()«»\"'“”]+$", ""))
    forms = F.flatten(F.transform(trimmed, lambda v: F.concat(F.array(v), hyphen_members(v))))
    return valid_keys(F.transform(F.transform(forms, lambda s: strip(s)), slp1_key))


def row_keys(sandhied: Column, word: Column, context: Column) -> Column:
    """Keys of an analysis row: of both its spellings and of the form before the first brace of its context."""
    head = F.regexp_extract(F.coalesce(context, F.lit("")), r"^\s*([^{}]+?)\s*\{", 1)
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(variant_keys(sandhied), empty), F.coalesce(variant_keys(word), empty), F.coalesce(variant_keys(head), empty)))


def normalize_lemma(lemma: Column) -> Column:
    """A lemma for dictionary lookup: without outer brackets and hyphens, homonym number and joiners."""
    out = F.regexp_replace(strip(F.coalesce(lemma, F.lit(""))), r"^[(\[]+|[)\]]+$", "")
    out = F.regexp_replace(out, "^-+|-+$", "")
    out = F.regexp_replace(out, r"^([\s\S]*\D)\d+$", "$1")
    return F.translate(out, "‌‍", "")


def fold_niggahita(col: Column) -> Column:
    return F.translate(col, "ṁ", "ṃ")


def dict_key(lemma: Column) -> Column:
    return slp1_key_for(fold_niggahita(normalize_lemma(lemma)))


def dict_keys(lemma: Column) -> Column:
    """All keys to try for a lemma, best first.

    Itself, the last member of a hyphenated lemma, its other members, without a final visarga, anusvara or virama, with
    these resolved, and without its last one or two characters; each with its sibilant variant.
    """
    norm = normalize_lemma(lemma)
    both = lambda text: key_variants(slp1_key_for(fold_niggahita(text)))
    none = F.array().cast("array<string>")
    members = hyphen_members(norm)
    head = F.try_element_at(members, F.lit(-1))
    bare = F.regexp_replace(F.regexp_replace(norm, "[ःं]$", ""), "्$", "")
    joined = F.replace(F.replace(norm, F.lit("ः"), F.lit("स्")), F.lit("ं"), F.lit("म्"))
    cut = lambda k: F.when((F.length(norm) >= 4) & (F.length(norm) - k >= 3), both(F.substring(norm, F.lit(1), F.length(norm) - k))).otherwise(none)
    parts = [
        both(norm),
        F.when(F.size(members) > 0, both(head)).otherwise(none),
        F.transform(F.when(F.size(members) > 0, members).otherwise(none), lambda m: slp1_key_for(fold_niggahita(normalize_lemma(m)))),
        F.when(bare != norm, both(bare)).otherwise(none),
        F.when(joined != norm, both(joined)).otherwise(none),
        cut(1),
        cut(2),
    ]
    return valid_keys(F.flatten(F.array(*parts)))


# Slices of the surface index by the first Devanagari letter of a token.
SLICES = {
    "अ": "a", "आ": "aa", "इ": "i", "ई": "ii", "उ": "u", "ऊ": "uu", "ऋ": "r", "ॠ": "r", "ऌ": "l", "ॡ": "l", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au", "ॐ": "om", "ऽ": "z",
    "क": "k", "क़": "k", "ख": "kh", "ख़": "kh", "ग": "g", "ग़": "g", "घ": "gh", "ङ": "ng", "च": "ch", "छ": "chh", "ज": "j", "ज़": "j", "झ": "jh", "ञ": "ny",
    "ट": "t", "त": "t", "ठ": "th", "थ": "th", "ड": "d", "द": "d", "ड़": "d", "ढ": "dh", "ध": "dh", "ढ़": "dh", "ण": "n", "न": "n", "प": "p", "फ": "ph", "फ़": "ph", "ब": "b", "भ": "bh", "म": "m",
    "य": "y", "य़": "y", "र": "r", "ल": "l", "ळ": "l", "व": "v", "श": "sh", "ष": "shh", "स": "s", "ह": "h",
}


def initial_slice(token: Column) -> Column:
    """Slice of a token by its first letter that has one; null if none has."""
    first = F.regexp_extract(token, "[" + "".join(SLICES) + "]", 0)
    names = F.create_map(*[F.lit(x) for kv in SLICES.items() for x in kv])
    return F.when(first != "", names[first])
