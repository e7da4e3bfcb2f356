"""Transliteration and folding as column expressions: they stay in generated code, no Python worker is involved."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tantu.functions.scripts import CONSONANTS, DIGITS, MATRAS, SIGNS, SLP1, VIRAMA, VOWELS

DEVANAGARI = "[\\u0900-\\u097F]"
_CONS = "".join(CONSONANTS.values())
_SIGN = "".join(MATRAS.values())
_JOIN = "‌‍"


def _translate(col: Column, table: dict[str, str]) -> Column:
    """Replace single characters by single characters, all at once."""
    return F.translate(col, "".join(table), "".join(table.values()))


def _replace_each(col: Column, table: dict[str, str]) -> Column:
    for old, new in table.items():
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def _split_table(table: dict[str, str]) -> tuple[dict[str, str], dict[str, str]]:
    """(those that map one character to one, the others with the longest first)."""
    single = {k: v for k, v in table.items() if len(k) == 1 and len(v) == 1}
    rest = {k: table[k] for k in sorted(set(table) - set(single), key=len, reverse=True)}
    return single, rest


def strip(col: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(col, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def has_devanagari(col: Column) -> Column:
    return col.rlike(DEVANAGARI)


def nfc_iast(col: Column) -> Column:
    """Compose the letters of IAST that came decomposed (the only ones that transliteration looks at)."""
    letters = [c for c in {*"".join(VOWELS), *"".join(CONSONANTS), *"ṃḥṁ"} if unicodedata.decomposition(c)]
    table = {unicodedata.normalize("NFD", c): c for c in letters}
    return _replace_each(col, {k: table[k] for k in sorted(table, key=len, reverse=True)})


def dev_to_iast(col: Column) -> Column:
    """Devanagari to IAST: consonants keep their a unless a vowel sign or virama follows (joiners in between don't count)."""
    out = F.regexp_replace(col, f"([{_CONS}][{_JOIN}]*+)(?![{_SIGN}{VIRAMA}])", "$1a")
    out = F.regexp_replace(out, f"([{_CONS}][{_JOIN}]*+){VIRAMA}", "$1")
    table = {v: k for part in (VOWELS, MATRAS, CONSONANTS, SIGNS) for k, v in part.items()}
    table |= {"ै": "ai", "ौ": "au", "ॐ": "oṃ"} | {d: str(i) for i, d in enumerate(DIGITS)}
    single, rest = _split_table(table)
    return _translate(_replace_each(out, rest), single)


def iast_to_dev(col: Column) -> Column:
    """IAST to Devanagari, whatever its case: a vowel after a consonant becomes its sign, a bare consonant gets a virama."""
    out = F.replace(nfc_iast(F.lower(col)), F.lit("m̐"), F.lit("ँ"))  # before its m is taken for a consonant
    single, rest = _split_table(CONSONANTS)
    out = _translate(_replace_each(out, rest), single)
    vowels = "|".join(sorted(VOWELS, key=len, reverse=True))
    out = F.regexp_replace(out, f"([{_CONS}])(?!{vowels})", f"$1{VIRAMA}")
    for iast in sorted(MATRAS, key=len, reverse=True):
        out = F.regexp_replace(out, f"(?<=[{_CONS}]){iast}", MATRAS[iast])
    out = F.regexp_replace(out, f"(?<=[{_CONS}])a", "")
    table = {**VOWELS, **SIGNS} | {str(i): d for i, d in enumerate(DIGITS)}
    single, rest = _split_table(table)
    return _translate(_replace_each(out, rest), single)


def iast_to_slp1(col: Column, keep: bool = False) -> Column:
    """IAST to SLP1; characters outside the scheme are dropped, or kept with keep=True."""
    single, rest = _split_table({k: v for k, v in SLP1.items() if k != v and k != "’"})
    out = _translate(_replace_each(nfc_iast(F.lower(col)), rest), single)
    return out if keep else F.regexp_replace(out, "[^A-Za-z~]", "")


def dev_to_slp1(col: Column) -> Column:
    return iast_to_slp1(dev_to_iast(col))


def slp1_key_for(col: Column) -> Column:
    """Lookup key of a Devanagari or IAST word: lower-case SLP1."""
    return F.lower(iast_to_slp1(dev_to_iast(col)))


def slp1_to_iast(col: Column) -> Column:
    single, rest = _split_table({v: k for k, v in SLP1.items()})
    return _replace_each(_translate(col, single), {k: v for k, v in rest.items() if k != v})


# Harvard-Kyoto letters (vocalics and sh as digraphs) and SLP1, in the order of the alphabet.
HK_OF_SLP1 = {
    "f": "Ri", "F": "RI", "x": "LRi", "X": "LRI", "K": "kh", "G": "gh", "N": "G", "C": "ch", "J": "jh", "Y": "J", "w": "T", "W": "Th", "q": "D", "Q": "Dh", "R": "N",
    "T": "th", "D": "dh", "P": "ph", "B": "bh", "S": "z", "z": "Sh",
}
HK_INITIAL = {"f": "RRi", "F": "RRI", "x": "LRi", "X": "LRI"}


def slp1_to_hk(col: Column) -> Column:
    """SLP1 to Harvard-Kyoto: a vocalic that begins a word is written in its independent form."""
    pieces = F.regexp_extract_all(col, F.lit(r"(?:(?<=^|\s)[fFxX]+)|[\s\S]"), F.lit(0))
    initial = F.create_map(*[F.lit(x) for kv in HK_INITIAL.items() for x in kv])
    inner = F.create_map(*[F.lit(x) for kv in HK_OF_SLP1.items() for x in kv])

    def one(piece: Column, position: Column) -> Column:
        runs = F.length(piece) > 1
        starts = piece.rlike("^[fFxX]+$") & ((position == 0) | (F.try_element_at(pieces, position) == " "))
        spelled = F.array_join(F.transform(F.split(piece, ""), lambda c: F.coalesce(initial[c], c)), "")
        return F.when(starts | runs, spelled).otherwise(F.coalesce(inner[piece], piece))

    return F.array_join(F.transform(pieces, one), "")


def hk_to_slp1(col: Column) -> Column:
    """Harvard-Kyoto to SLP1 by longest match; the digraphs ai and au stay as they are."""
    table = {v: k for k, v in {**HK_OF_SLP1}.items()} | {v: k for k, v in HK_INITIAL.items()}
    pattern = "|".join(sorted(table, key=len, reverse=True))
    pieces = F.regexp_extract_all(col, F.lit(f"{pattern}|[\\s\\S]"), F.lit(0))
    spelled = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(spelled[p], p)), "")


def transliterate(col: Column, source: str, target: str) -> Column:
    """Between deva, iast, slp1 and hk; characters unknown to a scheme pass."""
    if source == target:
        return col
    iast = {"deva": dev_to_iast, "iast": lambda c: c, "slp1": slp1_to_iast, "hk": lambda c: slp1_to_iast(hk_to_slp1(c))}[source](col)
    return {"deva": iast_to_dev, "iast": lambda c: c, "slp1": lambda c: iast_to_slp1(c, keep=True), "hk": lambda c: slp1_to_hk(iast_to_slp1(c, keep=True))}[target](iast)


def slp1_key(col: Column) -> Column:
    """Key of a word in any script: Devanagari and marked IAST by SLP1, plain letters taken for Harvard-Kyoto; lower case."""
    marked = col.rlike("[āīūṛṝḷḹṅñṭḍṇśṣṃḥ]")
    roman = F.lower(iast_to_slp1(dev_to_iast(col), keep=True))
    return F.when(has_devanagari(col) | marked, F.replace(roman, F.lit("’"), F.lit("'"))).otherwise(F.lower(hk_to_slp1(col)))


def _folding() -> tuple[str, str]:
    """Letters that decompose into a base and marks, and their bases: Latin and Greek blocks, by rule."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x370, 0x400), *range(0x1E00, 0x2000)]:
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code):
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _folding()


def strip_accents(col: Column) -> Column:
    """Lower case without accents, final sigma as sigma; a text with Devanagari stays as it is."""
    plain = F.regexp_replace(F.translate(F.lower(col), FOLD_FROM, FOLD_TO), "\\p{M}+", "")
    return F.when(has_devanagari(col), col).otherwise(F.translate(plain, "ς", "σ"))


def norm_sa(col: Column) -> Column:
    """Search key of a word in either script: IAST without marks, letters and digits only."""
    plain = F.translate(F.lower(dev_to_iast(col)), FOLD_FROM, FOLD_TO)
    return F.regexp_replace(plain, "[^a-z0-9]", "")
