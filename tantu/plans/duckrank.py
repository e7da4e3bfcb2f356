"""SQL of glosses, dictionary keys and ranked readings for the checks; word lists are stated here, not taken from the engine."""

from __future__ import annotations

from tantu.plans import duck

# Labels and signs of a scholarly entry, as the contract states them.
LABELS = "('m', 'f', 'n', 'mf', 'ind', 'pron', 'nom', 'acc', 'dat', 'abl', 'gen', 'loc', 'voc', 'sg', 'du', 'pl', 'cf', 'see')"
SOURCES = "('rv', 'av', 'vs', 'ts', 'śbr', 'śb', 'mbh', 'r', 'pāṇ', 'pāṇini')"


def clip(t: str, most: int) -> str:
    head = f"left(s, {most - 1})"
    last = f"(length({head}) - instr(reverse({head}), ' '))"
    return f"(select case when length(s) <= {most} then s else (case when instr({head}, ' ') > 0 and {last} > {most / 2} then left({head}, {last}::bigint) else {head} end) || '…' end from (select {t} as s))"


def compact_gloss(t: str, most: int = 90) -> str:
    """One short sense of an entry; null if none is left."""
    plain = f"translate(regexp_replace(coalesce({t}, ''), '<[^>]*>|\\[[^\\]]*\\]|[\\x{{0900}}-\\x{{097F}}\\x{{3400}}-\\x{{9FFF}}]', ' ', 'g'), chr(9) || chr(13) || chr(10) || chr(160), '    ')"
    pieces = f"regexp_extract_all({plain}, '[\\p{{L}}\\p{{M}}_]+[^\\p{{L}}\\p{{M}}_]*|^[^\\p{{L}}\\p{{M}}_]+')"
    word = "regexp_extract(q, '^[\\p{L}\\p{M}_]*')"
    tail = f"substr(q, length({word}) + 1)"
    kept = f"""case when lower({word}) in {SOURCES} then ' ' || regexp_replace({tail}, '^\\.?\\s*[\\d.,;:()\\-–—]*', '')
 when lower({word}) in {LABELS} and not regexp_matches({tail}, '^[0-9]') then (case when {tail} = '.' then ' ' else ' ' || {tail} end) else q end"""
    told = f"array_to_string(list_transform({pieces}, lambda q: {kept}), '')"
    told = f"regexp_replace({told}, '(?i)\\b(?:and +so +on\\b|[qs]\\.v\\.\\b)[^.;]*', ' ', 'g')"
    told = f"regexp_replace(ltrim({told}, ' ,;:()-–—.'), ' +', ' ', 'g')"
    sense = f"trim(regexp_extract({told}, '^((?s:.)*?)(?:[;.](?: |$)|$)', 1))"
    sense = f"trim(regexp_replace(regexp_extract({sense}, '[A-Za-z].*'), '[^A-Za-z)\\- ]*$', ''))"
    return f"(select case when regexp_matches(c, '[A-Za-z]{{2}}') then {clip('c', most)} end from (select {sense} as c))"


def clip_gloss(t: str, most: int) -> str:
    sentence = f"regexp_extract(fl, '^((?s:.){{{min(12, most - 1)},{most - 1}}}?[.;?:])(?:\\s|$)', 1)"
    flat = f"trim(regexp_replace(coalesce({t}, ''), '\\s+', ' ', 'g'))"
    return f"(select case when length(fl) <= {most} then fl when {sentence} <> '' and length({sentence}) <= {most} then {sentence} else {clip('fl', most)} end from (select {flat} as fl))"


def opens_with_name(t: str, length: int, dotless: bool) -> str:
    said = f"lower(array_to_string(regexp_extract_all(left(regexp_replace(coalesce({t}, ''), '\\s+', ' ', 'g'), {length}), '[A-Za-z0-9_]+|[^A-Za-z0-9_ ]'), ' ')) || ' '"
    dot = "(?: \\.)?" if dotless else " \\."
    return f"regexp_matches({said}, '^(?:as , )?(?:[mfn]{dot} )?(?:n|name) \\. of ')"


def is_name_parse(p: str, f: str, g: str) -> str:
    tags = f"list_has_any(regexp_split_to_array(lower(coalesce({f}, '')), '[;|\\s]'), ['propn', 'proper', 'propername', 'name'])"
    return f"(lower(trim(coalesce({p}, ''))) in ('propn', 'proper', 'name') or {tags} or {opens_with_name(g, 60, True)})"


def _key(x: str) -> str:
    return duck.slp1_key_for(f"translate({x}, 'ṁ', 'ṃ')")


def _norm(x: str) -> str:
    out = f"regexp_replace(trim({x}), '^[(\\[]+|[)\\]]+$', '', 'g')"
    out = f"regexp_replace({out}, '^-+|-+$', '', 'g')"
    return f"translate(regexp_replace({out}, '^((?s:.)*\\D)\\d+$', '\\1'), '‌‍', '')"


def dict_keys(src: str) -> str:
    """CTEs up to dk (lemma, no, key): the keys to try for each lemma of ``src`` in their order."""
    both = lambda no, k: f"select lemma, {no} as no, {k} as key from dt union all select lemma, {no + 1}, lower(replace({k}, 'z', 'S')) from dt"
    return f"""dn as (select lemma, {_norm('lemma')} as norm from {src}), dm as (select lemma, norm, case when contains(norm, '-') then list_filter(list_transform(string_split(norm, '-'), lambda p: trim(p)), lambda p: p <> '') else [] end as members,
 regexp_replace(regexp_replace(norm, '[ःं]$', ''), '्$', '') as bare, replace(replace(norm, 'ः', 'स्'), 'ं', 'म्') as joined from dn),
 dt as (select lemma, {_key('norm')} as k1, case when len(members) > 0 then {_key('members[len(members)]')} end as k2, case when bare <> norm then {_key('bare')} end as k4, case when joined <> norm then {_key('joined')} end as k5,
 case when length(norm) >= 4 then {_key('left(norm, length(norm) - 1)')} end as k6, case when length(norm) >= 5 then {_key('left(norm, length(norm) - 2)')} end as k7, {duck.slp1_key_for(duck.strip_accents('lemma'))} as k8 from dm),
 dp as (select lemma, 300 + i as no, {_key(_norm('member'))} as key from (select lemma, unnest(members) as member, unnest(range(len(members))) as i from dm)),
 dv as ({both(100, 'k1')} union all {both(200, 'k2')} union all select * from dp union all {both(400, 'k4')} union all {both(500, 'k5')} union all {both(600, 'k6')} union all {both(700, 'k7')}),
 dk as (select lemma, no, key from dv where regexp_matches(key, '^[a-z~]+$') union all select lemma, 800, k8 from dt)"""


_GT = f"""gh as (select distinct {duck.slp1_key_for('u')} as key, u, g from headwords where u <> ''), gt as (select key, min({{u: u, g: g}}) as e from gh group by key), gf as (select key, min({{u: u, g: g}}) as e from gh where g <> '' group by key)"""

_E = "e as (select distinct entry_id, slp_key, ord_no, l, p, f, g, x from morph_entries where slp_key is not null)"

SQL: dict[str, str] = {
    "short_glosses": f"select mw_id, {compact_gloss('g')} as sense, {clip_gloss('g', 40)} as clipped, lower(coalesce({compact_gloss('g')}, '')) as identity from (select distinct mw_id, g from mw_entries)",
    "gloss_repeats": f"""with e as (select distinct entry_id, slp_key, ord_no, g from morph_entries where slp_key is not null and g is not null), s as (select *, lower(coalesce({compact_gloss('g')}, '')) as sense from e)
 select entry_id, slp_key, ord_no, g, sense <> '' and row_number() over (partition by slp_key, sense order by ord_no, entry_id) = 1 as shown from s""",
    "lemma_glosses": f"with {_GT}, src as (select distinct lemma from parse_groups where lemma <> ''), {dict_keys('src')} select lemma, arg_min(key, no) as key, arg_min(e, no).u as u, arg_min(e, no).g as g from dk join gf using (key) group by lemma",
    "member_glosses": f"""with {_GT}, ls as (select distinct x.l as lemma from (select unnest(m) as x from morph_entries) where x.l <> ''), src as (select lemma from ls where length({duck.slp1_key_for('lemma')}) >= 2), {dict_keys('src')},
 a as (select lemma, 0 as tier, arg_min(e, no).g as g from dk join gf using (key) group by lemma), o as (select lemma, {duck.slp1_key_for('lemma')} as k from src), v as (select lemma, 1 as tier, k as key from o union select lemma, 2, lower(replace(k, 'z', 'S')) from o where lower(replace(k, 'z', 'S')) <> k),
 b as (select * from a union all select lemma, tier, g from v join gh using (key) where g <> '' and regexp_matches(key, '^[a-z]')) select lemma, min({{t: tier, g: g}}).g as g from b group by lemma""",
    "parse_group_entries": f"""with {_GT}, m as (select distinct group_id, i - 1 as ord, members[i].l as lemma from (select group_id, members, unnest(range(1, len(members) + 1)) as i from parse_groups) where members[i].l <> ''), src as (select distinct lemma from m), {dict_keys('src')},
 gl as (select lemma, arg_min(e, no).u as u, arg_min(e, no).g as g from dk join gt using (key) group by lemma) select group_id, u, arg_min(g, {{o: ord, g: g}}) as g from m join gl using (lemma) group by group_id, u""",
    "compound_members": f"""with {_GT}, c as (select distinct entry_id, slp_key, ord_no, m from morph_entries where slp_key is not null), k as (select *, list_slice(list_filter(m, lambda x: x is not null), 1, 8) as ms from c),
 s as (select * from k where len(ms) >= 2 and list_contains({duck.tags('ms[1].f')}, 'Cpd') and coalesce(ms[len(ms)].p, '') not in ('indecl', 'verb') and len(list_filter({duck.tags('ms[len(ms)].f')}, lambda t: t in ('1', '2', '3', '4', '5', '6', '7', 'सम्बोधन'))) > 0),
 f1 as (select * from s qualify row_number() over (partition by slp_key order by ord_no, entry_id) = 1), r as (select slp_key, (i - 1)::int as pos, m[i].d as d, coalesce(nullif(m[i].l, ''), m[i].d) as lemma, m[i].f as f from (select slp_key, m, unnest(range(1, least(8, len(m)) + 1)) as i from f1)),
 src as (select distinct lemma from r where lemma is not null), {dict_keys('src')}, gl as (select lemma, arg_min(e, no).g as g from dk join gt using (key) group by lemma)
 select slp_key, pos, d, lemma, {duck.compact('f')} as tags, {compact_gloss('g')} as sense from r left join gl using (lemma)""",
    "parse_views": f"""with {_E}, h as (select u as l, min(g) as g1 from headwords where g <> '' group by 1), k as (select {duck.slp1_key_for('u')} as lk, min(g) as g3 from headwords where g <> '' and u <> '' group by 1),
 s as (select entry_id, e.l, p, f, coalesce(case when {compact_gloss('e.g')} is not null then e.g end, h.g1, h2.g1, k.g3) as sg from e left join h on e.l = h.l left join h h2 on {duck.strip_accents('e.l')} = h2.l left join k on {duck.slp1_key_for('e.l')} = k.lk)
 select entry_id, coalesce(l, '') as lemma, coalesce(f, '') as features, {compact_gloss('sg')} as sense, {is_name_parse('p', 'f', 'sg')} as is_name from s""",
}


def _prefix(a: str, b: str) -> str:
    return f"coalesce(list_max(list_filter(range(0, least(length({a}), length({b})) + 1), lambda i: left({a}, i) = left({b}, i))), 0)"


def _affinity(a: str, b: str) -> str:
    return f"case when coalesce({a}, '') = '' or coalesce({b}, '') = '' then 1.0 else {_prefix(a, b)} / length({a}) end"


def _has(f: str, tag: str) -> str:
    return f"list_contains({duck.slot(f, 'kcase')}, '{tag}')"


_WIDE = {"tense": "various tenses", "voice": "various voices", "person": "various persons", "gender": "m./f./n.", "number": "sg./du./pl.", "kcase": "various cases"}


def _said(name: str) -> str:
    """Abbreviations of one dimension over a group's tags in order, as a summary says them."""
    every = f"flatten(list_transform(fs, lambda f: {duck.slot('f', name)}))"
    return f"(select case when len(v) = 0 then null when len(v) <= 3 then array_to_string(v, '/') else '{_WIDE[name]}' end from (select list_filter(w, lambda t, i: list_position(w, t) = i) as v from (select {every} as w)))"


_RANKED = f"""{_E}, hd as (select u as form, {duck.slp1_key_for('u')} as slp_key from headwords), r0 as (select form, entry_id, ord_no, l, p, f, g, x from e join hd using (slp_key)),
 pl as (select {duck.strip_accents("coalesce(l, '')")} as lemma, {duck.norm_lemma('form')} as a, {duck.norm_lemma(duck.strip_accents("coalesce(l, '')"))} as b from r0), pk as (select *, {duck.slp1_key_for('a')} as fa, {duck.slp1_key_for('b')} as fb from pl where lemma <> ''),
 fq as (select lemma, count(*) as n from pk where a = '' or b = '' or contains(a, b) or contains(b, a) or left(fa, 1) = left(fb, 1) and fa <> '' or length(fa) >= 2 and length(fb) >= 2 and right(fa, 2) = right(fb, 2) or left(a, 1) = left(b, 1)
 or length(a) >= 2 and length(b) >= 2 and right(a, 2) = right(b, 2) group by lemma),
 a1 as (select *, {_has('f', 'nom.')} as nom, {_has('f', 'acc.')} as acc, regexp_matches(trim(coalesce(l, '')), 'त्?$') as pt, {duck.norm_lemma('l')} as k, coalesce(({duck.slot('f', 'gender')})[1], '') as gd, coalesce(({duck.slot('f', 'number')})[1], '') as nb from r0),
 a2 as (select *, bool_or(acc and pt) over (partition by form, k, gd, nb) as has from a1), a3 as (select * from a2 where not (regexp_matches(form, '(म्|ं)$') and pt and nom and has)),
 b1 as (select a3.* exclude (g), coalesce(a3.g, hw.g) as g, coalesce(fq.n, 0) as freq, {duck.norm_lemma('form')} as fn, {duck.pos_class('p', 'f')} as c, regexp_matches(form, '(म्|ं)$') as ends, regexp_replace(form, '(?:म्|[ंः])$', '') as stem from a3
 left join headwords hw on a3.l = hw.u left join fq on {duck.strip_accents("coalesce(a3.l, '')")} = fq.lemma),
 b2 as (select *, {_affinity('fn', 'k')} as near, {' + '.join(f"len({duck.slot('f', n)})" for n in _WIDE)} = 0 as bare from b1),
 b3 as (select *, log2(1 + freq) * 10 + case when c = 'indecl' and near >= 0.35 then 35 else 0 end + case when trim(coalesce(p, '')) = 'stem' or contains(coalesce(f, ''), '(inferred)') then -30 else 0 end
 + case when not (fn <> '' and fn = k) and c <> 'indecl' and {opens_with_name('g', 48, False)} then -15 else 0 end + case when ends and acc then 42 else 0 end
 + case when ends and stem <> '' and {duck.norm_lemma('stem')} = k and regexp_matches(trim(coalesce(l, '')), 'त्?$') then 34 else 0 end as score from b2),
 c1 as (select *, bool_and(bare) over (partition by form) as every, count(*) over (partition by form, k) as nk from b3),
 c2 as (select form, arg_max(k, {{a: nk, b: -ord_no, c: k}}) as modal, arg_max(coalesce(l, ''), {{a: nk, b: -ord_no, c: coalesce(l, '')}}) as modal_lemma from c1 group by form),
 c3 as (select c1.*, case when every then modal else k end as lemma_key, case when every then 'indecl' else c end as cls, modal_lemma from c1 join c2 using (form)),
 d1 as (select form, lemma_key, cls, min(ord_no) as first, case when bool_and(every) then any_value(modal_lemma) else arg_min(coalesce(l, ''), {{a: ord_no, b: coalesce(l, '')}}) end as lemma, max(score) as score, max(near) as near,
 list(f order by ord_no, l nulls first, p nulls first, f nulls first) as fs, list({{l: l, p: p, f: f}} order by ord_no, l nulls first, p nulls first, f nulls first)[1] as best, count(*)::int as n from c3 group by all),
 d2 as (select *, round(score + case when max(near) over (partition by form) >= 0.55 and near < 0.35 then -90 else 0 end, 6) as total from d1),
 d3 as (select *, (row_number() over (partition by form order by total desc, first, lemma_key, cls))::int as rank, count(*) over (partition by form) as groups from d2)"""
SQL["top_parses"] = f"with {_RANKED} select form, best.l as l, best.p as p, best.f as f, groups - 1 as hidden from d3 where rank = 1"
SQL["ranked_groups"] = f"""with {_RANKED}, s1 as (select *, {_said('tense')} as tense, {_said('voice')} as voice, {_said('person')} as person, {_said('gender')} as gender, {_said('number')} as number, {_said('kcase')} as kcase from d3),
 s2 as (select *, list_filter(case when gender is not null then [tense, voice, gender, number, kcase] else [tense, person, number, voice, kcase] end, lambda t: t is not null) as ts from s1)
 select form, rank, lemma, cls, total as score, array_to_string(list_filter(ts, lambda t, i: i = 1 or t <> ts[i - 1]), ' ') as summary, n from s2"""
