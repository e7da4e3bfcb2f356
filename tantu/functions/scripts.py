"""Sanskrit in Devanagari, IAST, SLP1, Harvard-Kyoto and ITRANS: letter tables and text functions over them."""

from __future__ import annotations

import re
import unicodedata

# The letters in traditional order, in each scheme.
VOWELS = {"a": "अ", "ā": "आ", "i": "इ", "ī": "ई", "u": "उ", "ū": "ऊ", "ṛ": "ऋ", "ṝ": "ॠ", "ḷ": "ऌ", "ḹ": "ॡ", "e": "ए", "ai": "ऐ", "o": "ओ", "au": "औ"}
MATRAS = {"ā": "ा", "i": "ि", "ī": "ी", "u": "ु", "ū": "ू", "ṛ": "ृ", "ṝ": "ॄ", "ḷ": "ॢ", "ḹ": "ॣ", "e": "े", "ai": "ै", "o": "ो", "au": "ौ"}
CONSONANTS = {
    "k": "क", "kh": "ख", "g": "ग", "gh": "घ", "ṅ": "ङ", "c": "च", "ch": "छ", "j": "ज", "jh": "झ", "ñ": "ञ", "ṭ": "ट", "ṭh": "ठ", "ḍ": "ड", "ḍh": "ढ", "ṇ": "ण",
    "t": "त", "th": "थ", "d": "द", "dh": "ध", "n": "न", "p": "प", "ph": "फ", "b": "ब", "bh": "भ", "m": "म", "y": "य", "r": "र", "l": "ल", "v": "व", "ś": "श", "ṣ": "ष", "s": "स", "h": "ह", "ḻ": "ळ",
}
SIGNS = {"ṃ": "ं", "ḥ": "ः", "m̐": "ँ", "’": "ऽ"}
VIRAMA = "्"
DIGITS = "०१२३४५६७८९"
SLP1 = {
    "a": "a", "ā": "A", "i": "i", "ī": "I", "u": "u", "ū": "U", "ṛ": "f", "ṝ": "F", "ḷ": "x", "ḹ": "X", "e": "e", "ai": "E", "o": "o", "au": "O",
    "k": "k", "kh": "K", "g": "g", "gh": "G", "ṅ": "N", "c": "c", "ch": "C", "j": "j", "jh": "J", "ñ": "Y", "ṭ": "w", "ṭh": "W", "ḍ": "q", "ḍh": "Q", "ṇ": "R",
    "t": "t", "th": "T", "d": "d", "dh": "D", "n": "n", "p": "p", "ph": "P", "b": "b", "bh": "B", "m": "m", "y": "y", "r": "r", "l": "l", "v": "v", "ś": "S", "ṣ": "z", "s": "s", "h": "h", "ḻ": "L",
    "ṃ": "M", "ḥ": "H", "m̐": "~", "’": "'",
}
HK = {
    "ā": "A", "ī": "I", "ū": "U", "ṛ": "R", "ṝ": "RR", "ḷ": "lR", "ḹ": "lRR", "ṅ": "G", "ñ": "J", "ṭ": "T", "ṭh": "Th", "ḍ": "D", "ḍh": "Dh", "ṇ": "N", "ś": "z", "ṣ": "S", "ṃ": "M", "ḥ": "H", "’": "'",
}
ITRANS = {
    "ā": ("aa", "A"), "ī": ("ii", "I"), "ū": ("uu", "U"), "ṛ": ("RRi", "Ri", "R^i"), "ṝ": ("RRI", "R^I"), "ḷ": ("LLi", "L^i"), "ṅ": ("~N", "N^"), "c": ("ch",), "ch": ("Ch", "chh"), "ñ": ("~n", "JN"),
    "ṭ": ("T",), "ṭh": ("Th",), "ḍ": ("D",), "ḍh": ("Dh",), "ṇ": ("N",), "ś": ("sh",), "ṣ": ("Sh", "shh"), "ṃ": ("M", ".n"), "ḥ": ("H",), "v": ("v", "w"), "’": (".a",),
}

_LETTER = {v: k for k, v in {**VOWELS, **CONSONANTS, **SIGNS}.items()}
_CONSONANT = {v: k for k, v in CONSONANTS.items()}
_MATRA = {v: k for k, v in MATRAS.items()}
_JOINERS = "‌‍"


def dev_to_iast(text: str) -> str:
    """Devanagari to IAST; other characters pass, joiners do not end a consonant's inherent vowel."""
    out, pending = [], False
    for ch in text:
        if pending and ch not in _JOINERS:
            if ch in _MATRA:
                out.append(_MATRA[ch])
                pending = False
                continue
            if ch == VIRAMA:
                pending = False
                continue
            out.append("a")
            pending = False
        if ch in _CONSONANT:
            out.append(_CONSONANT[ch])
            pending = True
        elif ch in _LETTER:
            out.append(_LETTER[ch])
        elif ch == "ॐ":
            out.append("oṃ")
        elif ch in DIGITS:
            out.append(str(DIGITS.index(ch)))
        elif ch in _MATRA:
            out.append(_MATRA[ch])
        else:
            out.append(ch)
    if pending:
        out.append("a")
    return "".join(out)


def _longest(table: dict[str, str]) -> tuple[re.Pattern, dict[str, str]]:
    return re.compile("|".join(map(re.escape, sorted(table, key=len, reverse=True)))), table


_FROM = {
    "slp1": _longest({v: k for k, v in SLP1.items()}),
    "hk": _longest({**{k: k for k in CONSONANTS if k.isascii()}, **{k: k for k in VOWELS if k.isascii()}, **{v: k for k, v in HK.items()}}),
    "itrans": _longest({**{k: k for k in ("kh", "gh", "jh", "th", "dh", "ph", "bh", "ai", "au")}, **{form: k for k, forms in ITRANS.items() for form in forms}}),
}


def to_iast(text: str, scheme: str) -> str:
    """SLP1, Harvard-Kyoto or ITRANS to IAST by longest match; characters outside the scheme pass."""
    pattern, table = _FROM[scheme]
    return pattern.sub(lambda m: table[m[0]], text)


def strip_marks(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
