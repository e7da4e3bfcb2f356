"""Freely typed values to the entry of a reference list that is meant, by symmetric deletion and weighted edit distance."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tantu.functions.lookalike import consistent
from tantu.functions.scripts import dev_to_iast, strip_marks, to_iast

# Reference entries up to which the dictionary is broadcast. An entry has up to three keys and a key of ten letters 56 ways
# to lose two: 5,000 entries are under a million strings, some 100 MB in a worker. Beyond, deletion keys are joined.
LIMIT = 5_000
DISTANCE = 2  # characters deleted on either side of a key
FINE = 0.05  # weight of marks and of the spelling of a sound, beside an edit's 1


def allowed(key: str) -> float:
    """Edits accepted for a key: none up to 3 characters, 1 up to 5, then 2."""
    return 0.0 if len(key) < 4 else 1.0 if len(key) < 6 else 2.0


_NOTES = [
    (re.compile(r"\[sic\]|\[\?\]"), " "),
    (re.compile(r"[¹²³⁰-⁹°√*†?!„“”‟«»\"•]"), " "),
    (re.compile(r"^\s*\d+[.)]\s+"), ""),
    (re.compile(r"\s*,\s*(m|f|n|adj|adv|ind|mfn)\.\s*$"), ""),
    (re.compile(r"\s*\((m|f|n|adj|adv|ind|mfn)\.\)\s*$"), ""),
    (re.compile(r"\s+\d+\s*$"), ""),
    (re.compile(r"^\s*\((.*)\)\s*$"), r"\1"),
    (re.compile(r"^[\s\-–'‘’.,;:]+|[\s\-–,;.‘]+$"), ""),
]


def core(value: str) -> str:
    """The word itself: consistent characters, without numbering, sense numbers, grammar notes and editorial marks."""
    text = consistent(value)
    for pattern, to in _NOTES:
        text = pattern.sub(to, text)
    return text.strip()


_LETTERS = re.compile("[A-Za-zऀ-ॿÀ-ɏḀ-ỿ]")


def readings(value: str) -> list[str]:
    """What the value may spell, in IAST: as it stands, and for plain letters also as Harvard-Kyoto, SLP1 and ITRANS."""
    text = core(value)
    if not _LETTERS.search(text):
        return []
    if re.search("[ऀ-ॿ]", text):
        return [dev_to_iast(text).lower()]
    found = [text.lower().replace("ṁ", "ṃ")]
    if text.isascii():
        odd = re.search("[A-Z~^]", text[1:]) or text[:1].isupper()
        for scheme in ("hk", "slp1", "itrans") if odd else ("itrans",):
            found.append(to_iast(text, scheme).lower())
        if text[:1].isupper():  # a capital that only begins the word
            found.append(to_iast(text[0].lower() + text[1:], "itrans").lower())
            found.append(to_iast(text[0].lower() + text[1:], "hk").lower())
    return list(dict.fromkeys(found))


_SOUNDS = [("sh", "s"), ("w", "v"), ("aa", "a"), ("ii", "i"), ("uu", "u"), ("ee", "i"), ("oo", "u"), ("ri", "r"), ("ṛi", "r")]


def fold(iast: str, sounds: bool = True) -> str:
    """Key for candidate search: no marks, letters only, and with sounds the popular spellings of a sound made one."""
    key = strip_marks(iast)
    for said, to in _SOUNDS if sounds else ():
        key = key.replace(said, to)
    return re.sub("[^a-z]", "", key)


def deletions(key: str, most: int = DISTANCE) -> set[str]:
    """The key with up to ``most`` characters left out (fewer for short keys, so that something remains)."""
    found = {key}
    for k in range(1, min(most, max(0, len(key) - 2)) + 1):
        found |= {"".join(c) for c in itertools.combinations(key, len(key) - k)}
    return found


def search_keys(key: str, most: int = DISTANCE) -> set[str]:
    """Keys under which a key is searched: its deletions, and the key without h and doubled letters.

    Two edits reach one another by deletions. The only dearer way within 2.0 is three letters of 0.6 (an h or a doubled
    letter), which leave the last key as it is.
    """
    bare = re.sub(r"(.)\1+", r"\1", key.replace("h", ""))
    return deletions(key, most) | {bare}


_BASES: dict[str, str] = {}  # letters met, without their marks; a plain dict, as the package travels to workers by value


def _base(letter: str) -> str:
    """A letter without its marks."""
    found = _BASES.get(letter)
    if found is None:
        found = _BASES[letter] = strip_marks(letter)[:1]
    return found


def edit_cost(a: str, b: str, most: float, plain: bool = True) -> float:
    """Weighted Damerau-Levenshtein: an edit or a swap of neighbours 1, a doubled letter or an h 0.6.

    With plain=False letters that differ by a mark only weigh 0.25. Beyond ``most``: most + 1.
    """
    if a == b:
        return 0.0
    n, m = len(a), len(b)
    if abs(n - m) * 0.6 > most:
        return most + 1
    before, last = None, [0.0] * (m + 1)
    for j in range(1, m + 1):
        last[j] = last[j - 1] + 1.0
    for i in range(1, n + 1):
        x, row = a[i - 1], [last[0] + 1.0] + [0.0] * m
        for j in range(1, m + 1):
            y = b[j - 1]
            if x == y:
                best = last[j - 1]
            else:
                best = last[j - 1] + (1.0 if plain or _base(x) != _base(y) else 0.25)
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                    best = min(best, before[j - 2] + 1.0)
            gone = last[j] + (0.6 if i > 1 and x == a[i - 2] or x == "h" else 1.0)
            added = row[j - 1] + (0.6 if j > 1 and y == b[j - 2] or y == "h" else 1.0)
            row[j] = min(best, gone, added)
        before, last = last, row
        if min(row) > most and (before is None or min(before) > most):
            return most + 1
    return last[m]


def keys_of(value: str) -> list[tuple[str, str, str]]:
    """(kind, key, reading) of a typed value: its letters if Devanagari, and each reading's folded keys."""
    text = core(value)
    found = [("u", text, text)] if re.search("[ऀ-ॿ]", text) else []
    for reading in readings(value):
        found += [("plain", fold(reading, False), reading), ("sounds", fold(reading), reading)]
    return [k for k in found if k[1]]


def entry_keys_of(u: str | None, iast: str) -> dict[str, str]:
    return {kind: key for kind, key in (("u", u), ("plain", fold(iast, False)), ("sounds", fold(iast))) if key}


def rank(value: str, candidates: dict[int, tuple[str, str]], weights: dict[int, int]) -> tuple[int, float]:
    """(head_id, cost) of the candidate (id to u and IAST) with the least cost; ties: the more frequent, then the lower id.

    Edits count on the keys, within what the key's length allows; marks and the spelling of sounds decide among equals.
    -1 and -1.0 if no candidate is near enough.
    """
    best: tuple[float, int, int] | None = None
    held = [(ident, iast, entry_keys_of(u, iast)) for ident, (u, iast) in candidates.items()]
    for kind, key, reading in keys_of(value):
        bound = allowed(key)
        for ident, iast, others in held:
            other = others.get(kind)
            if other is None:
                continue
            cost = edit_cost(key, other, bound)
            if cost > bound:
                continue
            fine = 0.0 if kind == "u" else edit_cost(reading, iast, 8.0, plain=False)
            best = min(best or (99.0, 0, 0), (round(cost + FINE * min(fine, 9.0), 6), -weights.get(ident, 0), ident))
    return (best[2], best[0]) if best else (-1, -1.0)


def reference(headwords: DataFrame, values: DataFrame) -> DataFrame:
    """(head_id, iast, n): the list's entries with how often ``values`` (val) hold them exactly as spelled there."""
    both = headwords.select("head_id", "u", F.lower("iast").alias("iast"), F.explode(F.array_distinct(F.array("u", "iast"))).alias("val")).where("val is not null and val <> ''")
    used = values.groupBy("val").agg(F.count("*").alias("n"))
    return both.join(used, "val", "left").groupBy("head_id", "u", "iast").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))


_DICTIONARIES: dict[int, tuple] = {}  # the deletion dictionary of a task, whose functions come by value and share this


def deletion_dictionary(listed: list[tuple[int, str, str, int]], distance: int) -> tuple[dict[str, list[int]], dict[int, tuple[str, str]], dict[int, int]]:
    """Ids by deletion key, (u, iast) and frequency by id, of entries (head_id, iast, u, n)."""
    held = _DICTIONARIES.get(distance)
    if held is None or held[0] != listed:
        by_key: dict[str, list[int]] = {}
        entries_by_id, weights = {}, {}
        for ident, iast, u, n in listed:
            entries_by_id.setdefault(ident, (u, iast))
            weights[ident] = n
            for key in {k for e in entry_keys_of(u, iast).values() for k in search_keys(e, distance)}:
                by_key.setdefault(key, []).append(ident)
        held = _DICTIONARIES[distance] = listed, by_key, entries_by_id, weights
    return held[1:]


def meant(values: DataFrame, headwords: DataFrame, limit: int = LIMIT, distance: int = DISTANCE) -> DataFrame:
    """(val, head_id, cost) for every distinct val that equals no entry's u or iast: the entry meant, or -1 and -1.0.

    Null and empty values give no row. Values without letters, and those whose nearest entry is too far, mean none. The
    deletion dictionary is broadcast up to ``limit`` entries; beyond, keys of values and entries are joined, and the same
    candidates are ranked pair by pair.
    """
    spelled = headwords.select(F.explode(F.array("u", "iast")).alias("val")).where("val is not null")
    counted = values.where("val is not null and val <> ''")
    open_values = counted.select("val").distinct().join(spelled, "val", "left_anti")
    entries = reference(headwords, counted).where("iast is not null and iast <> ''")
    if headwords.limit(limit + 1).count() > limit:
        return _joined(open_values, entries, distance)
    listed = sorted((r.head_id, r.iast, r.u or "", r.n) for r in entries.collect())
    longest = distance + 1 + max((len(k) for e in listed for k in entry_keys_of(e[2], e[1]).values()), default=0)
    context = values.sparkSession.sparkContext
    held = context.broadcast(listed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_key, entries_by_id, weights = deletion_dictionary(held.value, distance)
        for batch in batches:
            out = []
            for value in batch["val"]:
                near: set[int] = set()
                for typed in {k for _, k, _ in keys_of(value) if len(k) <= longest}:  # a longer key is near to none
                    for key in search_keys(typed, distance):
                        near.update(by_key.get(key, ()))
                out.append((value, *rank(value, {i: entries_by_id[i] for i in near}, weights)))
            yield pd.DataFrame(out, columns=["val", "head_id", "cost"])

    # short values, long work: the partitions are asked for, as their bytes would have them merged into few tasks
    spread = open_values.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("val"))
    return spread.mapInPandas(run, "val string, head_id long, cost double")


def _joined(open_values: DataFrame, entries: DataFrame, distance: int) -> DataFrame:
    longest = distance + 1 + (entries.agg(F.max(F.greatest(F.length("iast"), F.length(F.coalesce("u", F.lit(""))))).alias("n")).first().n or 0)

    def value_keys(batches):
        for batch in batches:
            rows = [(v, k) for v in batch["val"] for k in {k for _, t, _ in keys_of(v) if len(t) <= longest for k in search_keys(t, distance)}]
            yield pd.DataFrame(rows, columns=["val", "key"])

    def entry_keys(batches):
        for batch in batches:
            rows = [(i, u, t, n, k) for i, u, t, n in batch.itertuples(index=False) for k in {k for e in entry_keys_of(u, t).values() for k in search_keys(e, distance)}]
            yield pd.DataFrame(rows, columns=["head_id", "u", "iast", "n", "key"])

    def costs(batches):
        for batch in batches:
            scored = [(v, i, n, rank(v, {i: (u or "", t)}, {})[1]) for v, i, u, t, n in batch.itertuples(index=False)]
            yield pd.DataFrame(scored, columns=["val", "head_id", "n", "cost"])

    left = open_values.mapInPandas(value_keys, "val string, key string")
    right = entries.select("head_id", "u", "iast", "n").mapInPandas(entry_keys, "head_id long, u string, iast string, n long, key string")
    pairs = left.join(right, "key").select("val", "head_id", "u", "iast", "n").distinct()
    near = pairs.mapInPandas(costs, "val string, head_id long, n long, cost double").where("cost >= 0")
    best = near.groupBy("val").agg(F.min(F.struct("cost", (-F.col("n")).alias("n"), "head_id")).alias("b"))
    return open_values.join(best, "val", "left").select("val", F.coalesce("b.head_id", F.lit(-1)).alias("head_id"), F.coalesce("b.cost", F.lit(-1.0)).alias("cost"))


def typed_values(tables) -> DataFrame:
    """(src, row_id, val): lemmas of the parse groups and headwords as contributors typed them, repeated rows once."""
    groups = tables("parse_groups").select(F.lit("parse_groups").alias("src"), F.col("group_id").alias("row_id"), F.col("lemma").alias("val"))
    return groups.union(tables("mw_entries").select(F.lit("mw_entries"), "mw_id", "u")).where("val is not null and val <> ''").distinct()


def mapped_rows(tables, cost: bool = False) -> DataFrame:
    """(src, row_id, head_id): the headword meant by every typed value that is spelled like none, -1 if it means none."""
    values = typed_values(tables)
    found = values.join(meant(values, tables("headwords")), "val")
    return found.select("src", "row_id", "val", "head_id", "cost") if cost else found.select("src", "row_id", "head_id").distinct()
