"""Characters that look alike or can't be seen, and the one form that all of them are brought to."""

from __future__ import annotations

import re
import unicodedata

# Code points that are not seen within a word.
IGNORABLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufe00\ufe01\ufe02\ufe03\ufe04\ufe05\ufe06\ufe07\ufe08\ufe09\ufe0a\ufe0b\ufe0c\ufe0d\ufe0e\ufe0f\ufeff"

# Spaces that look like the plain one.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

# Cyrillic, Greek and other letters drawn as Latin ones.
LETTERS = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "ո": "n", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "γ": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "Ѵ": "V", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ү": "Y", "ү": "y", "օ": "o", "ս": "u", "հ": "h", "ց": "g", "յ": "j", "Օ": "O", "Տ": "S",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮤ": "W", "Ꮓ": "Z",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ⅼ": "l", "ⅰ": "i", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s",
}

# Devanagari letters and signs that are drawn by several others, and signs taken for them.
SEQUENCES = {"आ": "अा", "ओ": "अाे", "औ": "अाै", "ऐ": "एे", "ो": "ाे", "ौ": "ाै", "ऑ": "अाॅ", "ॉ": "ाॅ", "ऍ": "एॅ", "ः": ":", "।": "|"}

# Letters in a style of their own (mathematical, wide, ligatures, numerals): by rule, what their compatibility form says.
STYLED = {
    chr(c): plain
    for start, stop in ((0x2100, 0x2150), (0x2160, 0x2180), (0xFB00, 0xFB07), (0x1D400, 0x1D800))
    for c in range(start, stop)
    if (plain := unicodedata.normalize("NFKD", chr(c))) != chr(c) and chr(c) not in LETTERS and plain.isalnum()
}

_DROP = {ord(c): None for c in IGNORABLE}
_SPACE = {ord(c): " " for c in SPACES}
_WIDE = {0xFF01 + i: 0x21 + i for i in range(94)} | {ord(c): plain for c, plain in STYLED.items()}
_PROTO = {ord(k): v for k, v in {**LETTERS, **SEQUENCES}.items()}
_OUTER = " \t\r\n" + SPACES


def skeleton(text: str) -> str:
    """What the text looks like: equal for two texts that can't be told apart by eye, or only by width."""
    text = text.translate(_DROP).strip(_OUTER)
    return unicodedata.normalize("NFD", text.translate(_WIDE).translate(_SPACE)).translate(_PROTO)


_IGNORED = frozenset(IGNORABLE)
_SPACED = frozenset(_OUTER)
_FREE: dict[str, str] = {}


def free_letters(text: str) -> list[str]:
    """The letters that each character of a text may be read as at no cost, one after the other; "" for what is not seen.

    A character stands for its own decomposition, in plain width and style, each letter as it is drawn; marks that follow
    a letter are read in their canonical order, whatever lies between them. Spaces around the text are not seen.
    """
    first, last = 0, len(text)
    while first < last and (text[first] in _SPACED or text[first] in _IGNORED):
        first += 1
    while last > first and (text[last - 1] in _SPACED or text[last - 1] in _IGNORED):
        last -= 1
    found = [""] * first
    at = first
    while at < last:
        end = at + 1
        while end < last and (unicodedata.combining(text[end]) or text[end] in _IGNORED):
            end += 1
        piece = text[at:end]
        read = _FREE.get(piece)
        if read is None:
            read = unicodedata.normalize("NFD", piece.translate(_DROP).translate(_WIDE).translate(_SPACE)).translate(_PROTO)
            if len(piece) < 8 and len(_FREE) < 100_000:
                _FREE[piece] = read
        found += list(read) or [""]
        at = end
    return found + [""] * (len(text) - last)


_BACK = sorted(((v, k) for k, v in SEQUENCES.items() if len(v) > 1), key=lambda p: -len(p[0]))


def consistent(text: str) -> str:
    """The text in one form, by table: no invisible characters, plain spaces, narrow, composed, letters of one script.

    A foreign look-alike is replaced where the rest of the word is Latin (or it stands alone among marks), a colon after
    Devanagari is a visarga. Words wholly of another script stay as they are.
    """
    text = text.translate(_DROP).strip(_OUTER).translate(_WIDE).translate(_SPACE)
    text = unicodedata.normalize("NFC", text)
    if any(ord(c) in _PROTO for c in text) and re.search("[A-Za-zÀ-ɏḀ-ỿ]", text):
        text = unicodedata.normalize("NFC", "".join(LETTERS.get(c, c) for c in text))
    if re.search("[ऀ-ॿ]", text):
        for shown, letter in _BACK:
            text = text.replace(shown, letter)
        text = re.sub("(?<=[ऀ-ॿ]):", "ः", text)
    return text


def _plain(code: int) -> bool:
    """Whether a character is the only one of its look, and stays as it is in composed texts."""
    c = chr(code)
    return unicodedata.normalize("NFC", c) == c and not unicodedata.combining(c) and c not in SPACES + IGNORABLE and code not in _PROTO and code not in _WIDE and not c.isspace()


def _ranges(codes: list[int]) -> str:
    """Characters as ranges of a class of a regular expression."""
    out, start = [], None
    for code, after in zip(codes, [*codes[1:], -1]):
        start = code if start is None else start
        if after != code + 1:
            out.append(f"\\x{{{start:X}}}-\\x{{{code:X}}}")
            start = None
    return "".join(out)


# Characters of which a consistent text consists, by rule: letters that nothing else looks like, and those whose look only
# others are brought to (virama, and letters drawn by sequences). Anything else makes a text one to look up.
_EVEN = [c for start, stop in ((0x21, 0x250), (0x900, 0x980), (0x1E00, 0x1F00), (0x3400, 0xA000)) for c in range(start, stop) if _plain(c) or c == 0x94D or chr(c) in SEQUENCES]

# A text in which nothing matches this is in the consistent form already, and two such texts that look alike are equal.
SUSPECT = f"[^{_ranges(_EVEN)}]|अ[ाॅोौॉ]|आ[ेैॅ]|ए[ेॅ]|ा[ेैॅ]|[ऀ-ॿ][:|]|(?<![ऀ-ॿ])[ः।]"
