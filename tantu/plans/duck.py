"""Pieces of SQL for the checks: the text functions of the engine as expressions of DuckDB's dialect."""

from __future__ import annotations

from tantu.functions.feats import SLOTS
from tantu.functions.scripts import CONSONANTS, DIGITS, MATRAS, SIGNS, SLP1, VIRAMA, VOWELS

CONS = "".join(CONSONANTS.values())
SIGN = "".join(MATRAS.values())
JOIN = "‌‍"

UNITS = """units as (select unit_id, work_id, ref, coalesce(words, list_filter(string_split(w, ' '), lambda x: x <> ''), []::varchar[]) as words, ingested_at, deleted_at
 from work_units qualify row_number() over (partition by unit_id order by ingested_at desc) = 1)"""
TOKENS = UNITS + """, toks as (select unit_id, work_id, ref, (i - 1)::int as token_index, words[i] as form from (select *, unnest(range(1, len(words) + 1)) as i from units))"""
PLACED = UNITS + """, placed as (select *, (row_number() over (partition by work_id order by list_transform(string_split(ref, '.'), lambda p: coalesce(try_cast(regexp_extract(p, '^(\\d+)', 1) as int), -1)), ref, unit_id) - 1)::int as idx from units)"""
ELEMENTS = """elements as (select distinct file_id, work_id, part_ref, lang, (i - 1)::int as pos, u.ref as ref, coalesce(u.text, array_to_string(u.words, ' '), u.w) as text
 from (select *, units[i] as u from (select *, unnest(range(1, len(units) + 1)) as i from trans_files)) where coalesce(u.text, array_to_string(u.words, ' '), u.w) is not null)"""


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def swap(x: str, table: dict[str, str]) -> str:
    return f"translate({x}, {quote(''.join(table))}, {quote(''.join(table.values()))})"


def swap_each(x: str, table: dict[str, str]) -> str:
    for old, new in table.items():
        x = f"replace({x}, {quote(old)}, {quote(new)})"
    return x


def _split(table: dict[str, str]) -> tuple[dict[str, str], dict[str, str]]:
    single = {k: v for k, v in table.items() if len(k) == 1 and len(v) == 1}
    return single, {k: table[k] for k in sorted(set(table) - set(single), key=len, reverse=True)}


def dev_to_iast(x: str) -> str:
    once = f"regexp_replace({x}, '([{CONS}][{JOIN}]*)([^{SIGN}{VIRAMA}{JOIN}]|$)', '\\1a\\2', 'g')"
    # the character after a consonant was taken along: what it hid is found by a second pass
    twice = f"regexp_replace({once}, '([{CONS}][{JOIN}]*)([^{SIGN}{VIRAMA}{JOIN}a]|$)', '\\1a\\2', 'g')"
    out = f"regexp_replace({twice}, '([{CONS}][{JOIN}]*){VIRAMA}', '\\1', 'g')"
    table = {v: k for part in (VOWELS, MATRAS, CONSONANTS, SIGNS) for k, v in part.items()}
    table |= {"ै": "ai", "ौ": "au", "ॐ": "oṃ"} | {d: str(i) for i, d in enumerate(DIGITS)}
    single, rest = _split(table)
    return swap(swap_each(out, rest), single)


def iast_to_slp1(x: str) -> str:
    single, rest = _split({k: v for k, v in SLP1.items() if k != v and k != "’"})
    return f"regexp_replace({swap(swap_each(f'nfc_normalize(lower({x}))', rest), single)}, '[^A-Za-z~]', '', 'g')"


def slp1_key_for(x: str) -> str:
    return f"lower({iast_to_slp1(dev_to_iast(x))})"


def norm_sa(x: str) -> str:
    return f"regexp_replace(lower(strip_accents({dev_to_iast(x)})), '[^a-z0-9]', '', 'g')"


def strip_accents(x: str) -> str:
    return f"case when regexp_matches({x}, '[\\x{{0900}}-\\x{{097F}}]') then {x} else replace(lower(strip_accents({x})), 'ς', 'σ') end"


def table_map(table: dict[str, str]) -> str:
    return "map {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in table.items()) + "}"


def tags(f: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({f}, ''), '[;\\s|]+'), lambda t: t <> '')"


def slot(f: str, name: str, distinct: bool = True) -> str:
    """Abbreviations of one dimension in order; repeats are dropped by position."""
    mapped = f"list_filter(list_transform({tags(f)}, lambda t: {table_map(SLOTS[name])}[t]), lambda t: t is not null)"
    return f"list_filter({mapped}, lambda t, i: list_position({mapped}, t) = i)" if distinct else mapped


def compact(f: str) -> str:
    """Abbreviations of a tag string in reading order, joined by spaces."""
    part = {n: slot(f, n, False) for n in SLOTS}
    case = f"list_filter(list_transform({tags(f)}, lambda t: coalesce({table_map(SLOTS['kcase'])}[t], case when regexp_matches(t, '^[0-9]$') then t end)), lambda t: t is not null)"
    tense = f"list_slice({part['tense']}, -1, -1)"
    nominal = f"list_concat(list_concat(list_concat(list_concat({tense}, {part['voice']}), {part['gender']}), {part['number']}), {case})"
    verbal = f"list_concat(list_concat(list_concat(list_concat({tense}, {part['person']}), {part['number']}), {part['voice']}), {case})"
    return f"array_to_string(case when len({part['gender']}) > 0 then {nominal} else {verbal} end, ' ')"


def norm_lemma(x: str) -> str:
    base = f"regexp_replace(({strip_accents(f'coalesce({x}, {quote(str())})')}), '^[(\\[]+|[)\\]]+$', '', 'g')"
    return f"replace(replace(regexp_replace({base}, '^((?s:.*)\\D)\\d+$', '\\1'), 'ः', 'स्'), 'ं', 'म्')"


def pos_class(p: str, f: str) -> str:
    bare = f"len({slot(f, 'tense')}) = 0 and len({slot(f, 'voice')}) = 0"
    return f"case when trim(coalesce({p}, '')) in ('noun', 'verb', 'indecl') then trim({p}) when trim(coalesce({p}, '')) = 'part' then (case when {bare} then 'noun' else 'part' end) else 'other' end"


def pos_abbr(p: str) -> str:
    return f"case trim(coalesce({p}, '')) when 'noun' then 'n.' when 'verb' then 'v.' when 'part' then 'ptcp.' when 'indecl' then 'indecl.' when '' then '' else {p} || '.' end"


def slp1_key(x: str) -> str:
    """Key of a word in any script, lower case; plain letters are Harvard-Kyoto."""
    pairs = {"RRi": "①", "RRI": "②", "LRi": "③", "LRI": "④", "kh": "⑤", "gh": "⑥", "ch": "⑦", "jh": "⑧", "Th": "⑨", "Dh": "⑩", "th": "⑪", "dh": "⑫", "ph": "⑬", "bh": "⑭", "Sh": "⑮", "Ri": "⑯", "RI": "⑰"}
    single = dict(zip("①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰TDGJNz", "ffxxkgcjwqtdpbzffwqnyrs", strict=True))
    hk = f"lower({swap(swap_each(x, pairs), single)})"
    return f"case when regexp_matches({x}, '[\\x{{0900}}-\\x{{097F}}āīūṛṝḷḹṅñṭḍṇśṣṃḥ]') then {roman_key(x)} else {hk} end"


def roman_key(x: str) -> str:
    """Lower-case SLP1 of a Devanagari or IAST word, with whatever else it holds."""
    single, rest = _split({k: v for k, v in SLP1.items() if k != v and k != "’"})
    return f"replace(lower({swap(swap_each(f'nfc_normalize(lower({dev_to_iast(x)}))', rest), single)}), '’', '''')"


def canonical_keys(x: str) -> str:
    """The one or two keys of a form, in order."""
    plain = f"translate({x}, '''’', '')"
    keys = f"[replace({slp1_key(plain)}, '''', ''), replace(case when regexp_matches({plain}, '[\\x{{0900}}-\\x{{097F}}]') then {slp1_key(dev_to_iast(plain))} else {roman_key(plain)} end, '''', '')]"
    return f"(select list_filter(ks, lambda k, i: regexp_matches(k, '^[a-z~]+$') and list_position(ks, k) = i) from (select {keys} as ks))"


def iast_to_dev(x: str) -> str:
    """IAST to Devanagari: every consonant gets a virama, which a vowel after it turns into its sign."""
    single, rest = _split(CONSONANTS)
    out = f"regexp_replace({swap(swap_each(f'nfc_normalize(lower({x}))', rest), single)}, '([{CONS}])', '\\1{VIRAMA}', 'g')"
    for iast in sorted(MATRAS, key=len, reverse=True):
        out = f"replace({out}, '{VIRAMA}{iast}', '{MATRAS[iast]}')"
    single, rest = _split({**VOWELS, **SIGNS} | {str(i): d for i, d in enumerate(DIGITS)})
    return swap(swap_each(f"replace({out}, '{VIRAMA}a', '')", rest), single)


def slp1_to_iast(x: str) -> str:
    single, rest = _split({v: k for k, v in SLP1.items()})
    return swap_each(swap(x, single), {k: v for k, v in rest.items() if k != v})


def form_keys(x: str) -> str:
    """Keys of a form and of its hyphen members, each once, in order."""
    members = f"case when contains({x}, '-') then list_filter(list_transform(string_split({x}, '-'), lambda p: trim(p)), lambda p: p <> '') else [] end"
    # the keys of one form are a subquery: members are told apart by position
    each = f"(select list(k order by i, j) from (select i, unnest(ks) as k, unnest(range(len(ks))) as j from (select i, {canonical_keys('fm')} as ks from (select unnest(fs) as fm, unnest(range(len(fs))) as i from (select list_concat([trim({x})], {members}) as fs)))))"
    return f"(select list_filter(w, lambda k, i: list_position(w, k) = i) from (select coalesce({each}, []) as w))"
