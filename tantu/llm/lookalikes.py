"""Words that look like a dictionary word but differ from it in characters, by an automaton over a trie of the dictionary."""

from __future__ import annotations

import heapq
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tantu.functions.lookalike import SUSPECT, consistent, free_letters
from tantu.session import written

LIMIT = 100_000  # dictionary entries up to which the trie is broadcast; beyond, skeletons are joined
MARK = 0.4  # weight of a combining mark that is added, left out or changed; other characters weigh 1
END = ""  # no letter is empty


def build_trie(words: list[tuple[str, str]]) -> dict:
    """Trie over (spelling, id) by the letters as they are drawn; a node's END holds the spellings that end there."""
    root: dict = {}
    for spelling, ident in words:
        node = root
        for ch in free_letters(spelling):
            if ch:
                node = node.setdefault(ch, {})
        node.setdefault(END, []).append((spelling, ident))
    return root


def _weight(ch: str) -> float:
    return MARK if unicodedata.combining(ch) else 1.0


def walk(trie: dict, token: str, budget: float = 0.0) -> tuple[float, list[tuple[str, str]]] | None:
    """(cost, spellings) of all nearest dictionary words of a token within the budget, or None.

    The automaton reads the token as it stands, character by character. Ignorables are passed at no cost, a character moves
    at no cost along any letter that it looks like; an added, missing or changed letter costs its weight. Cheapest states
    first, so the first final state is nearest; those that cost the same count too, so a tie doesn't depend on the trie.
    """
    read = free_letters(token)
    heap, seen, tick = [(0.0, 0, 0, trie)], set(), 0
    nearest, found = None, []
    while heap:
        cost, _, at, node = heapq.heappop(heap)
        if nearest is not None and cost > nearest:
            break
        while at < len(read) and not read[at]:  # not seen: free
            at += 1
        if (id(node), at) in seen:
            continue
        seen.add((id(node), at))
        if at == len(read) and END in node:
            nearest = cost
            found += node[END]
        here = read[at] if at < len(read) else None
        if here is not None and here in node:
            tick += 1
            heapq.heappush(heap, (cost, tick, at + 1, node[here]))
        left = budget - cost + 1e-9
        if left < MARK:
            continue
        moves = [] if here is None else [(_weight(here), at + 1, node)]
        for ch, child in node.items():
            if ch != END:
                moves.append((_weight(ch), at, child))
                if here is not None and ch != here:
                    moves.append((max(_weight(ch), _weight(here)), at + 1, child))
        for weight, new_at, child in moves:
            if weight <= left and (id(child), new_at) not in seen:
                tick += 1
                heapq.heappush(heap, (round(cost + weight, 9), tick, new_at, child))
    return None if nearest is None else (nearest, found)


_TRIES: dict[tuple, tuple] = {}  # the trie of a task, whose functions come by value and share this


def _trie(held) -> dict:
    key = hash(tuple(held.value[:50])), len(held.value)
    if key not in _TRIES:
        _TRIES.clear()
        _TRIES[key] = held.value, build_trie(held.value)
    words, trie = _TRIES[key]
    if words != held.value:
        _TRIES[key] = held.value, build_trie(held.value)
    return _TRIES[key][1]


def dictionary_words(headwords: DataFrame) -> DataFrame:
    """(spelling, head_id): both spellings of every headword that has an id; null and empty ones left out, the lowest id of a spelling."""
    both = headwords.where("head_id is not null").select(F.explode(F.array("u", "iast")).alias("spelling"), "head_id").where("spelling is not null and spelling <> ''")
    return both.groupBy("spelling").agg(F.min("head_id").alias("head_id"))


def corpus_words(tables) -> DataFrame:
    """(src, row_id, pos, val): words of the units, headwords of the contributors, lemmas of the members of morph parses."""
    units = tables("work_units").select(F.col("unit_id"), F.coalesce("words", F.filter(F.split("w", " "), lambda x: x != "")).alias("words"))
    return (
        units.select(F.lit("work_units").alias("src"), F.col("unit_id").alias("row_id"), F.posexplode("words").alias("pos", "val"))
        .union(tables("mw_entries").select(F.lit("mw_entries"), "mw_id", F.lit(0), "u"))
        .union(tables("morph_entries").select(F.lit("morph_entries"), "entry_id", F.posexplode("m.l")))
    )


def canonical(values: DataFrame, headwords: DataFrame, budget: float = 0.0, limit: int = LIMIT, all_rows: bool = False) -> DataFrame:
    """``values`` (columns src, row_id, pos, val) with head_id, spelling and cost, where val stands for a dictionary word.

    Only values that differ from the spelling come out, unless all_rows: then every value, with its consistent spelling:
    the dictionary's where one is within the budget, else the value normalised by table (head_id null). Of several words that
    are as near: the value itself, one of its script, the lowest id. Nulls and empty values give no row. The trie is broadcast
    up to ``limit`` spellings; a larger dictionary is matched by a join of what is read at no cost where nothing may cost, else
    by tries of its parts. All compare the same letters and settle ties in the same order, so the rows don't depend on it.
    """
    words = dictionary_words(headwords)
    rows = values.where("val is not null and val <> ''")
    if words.limit(limit + 1).count() > limit:
        return _joined(rows, words, all_rows) if budget <= 0 else _in_parts(rows, words, budget, limit, all_rows)
    found_words = words.withColumn("odd", F.col("spelling").rlike(SUSPECT)).collect()
    listed = sorted((r.spelling, r.head_id) for r in found_words)
    suspects = rows.where(F.col("val").rlike(SUSPECT)) if budget <= 0 and not all_rows else rows
    if any(r.odd for r in found_words):
        suspects = rows  # an uneven dictionary: plain values may be the odd ones
    found = _walked(suspects, listed, budget)
    return found if all_rows else found.where("head_id is not null and val <> spelling")


def _walked(rows: DataFrame, listed: list[tuple[str, int]], budget: float) -> DataFrame:
    """Every row with head_id, spelling and cost by the trie of the listed words; without a hit head_id and cost are null."""
    names = ["src", "row_id", "pos", "val"]
    schema = T.StructType([rows.schema[n] for n in names] + [T.StructField("head_id", T.LongType()), T.StructField("spelling", T.StringType()), T.StructField("cost", T.DoubleType())])
    held = rows.sparkSession.sparkContext.broadcast(listed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = _trie(held)
        known: dict[str, tuple] = {}
        for batch in batches:
            for val in batch["val"].unique():
                if val not in known:
                    hit = walk(trie, val, budget)
                    if hit:
                        near = min(hit[1], key=lambda w: (w[0] != val, skeleton_script(w[0]) != skeleton_script(val), w[1], w[0]))
                        known[val] = (near[1], near[0], hit[0])
                    else:
                        known[val] = (None, consistent(val), None)
            hits = [known[v] for v in batch["val"]]
            yield batch.assign(head_id=pd.array([h[0] for h in hits], dtype="Int64"), spelling=[h[1] for h in hits], cost=[h[2] for h in hits])
            if len(known) > 500_000:
                known.clear()

    return rows.select(*names).mapInPandas(run, schema)


def _in_parts(rows: DataFrame, words: DataFrame, budget: float, limit: int, all_rows: bool) -> DataFrame:
    """A dictionary too large for one trie: distinct values walk the trie of one part after the other, the nearest counts."""
    spark = rows.sparkSession
    vals = written(spark, rows.select(F.lit("").alias("src"), F.lit(0).cast("long").alias("row_id"), F.lit(0).alias("pos"), "val").distinct(), "vals")
    parts = -(-words.count() // limit)
    cut = words.withColumn("part", F.pmod(F.xxhash64("spelling"), F.lit(2 * parts)))  # half full on the average
    found = []
    for part in range(2 * parts):
        listed = sorted((r.spelling, r.head_id) for r in cut.where(F.col("part") == part).collect())
        found.append(written(spark, _walked(vals, listed, budget).where("head_id is not null").select("val", "head_id", "spelling", "cost"), "part"))
    best = _nearest(reduce(DataFrame.union, found))
    even = F.pandas_udf(lambda s: s.map(consistent), "string")
    out = rows.join(best, "val", "left" if all_rows else "inner").select("src", "row_id", "pos", "val", "w.head_id", F.coalesce("w.spelling", even("val")).alias("spelling"), "w.cost")
    return out if all_rows else out.where("val <> spelling")


def skeleton_script(word: str) -> bool:
    return any("ऀ" <= c <= "ॿ" for c in word)


def _nearest(found: DataFrame) -> DataFrame:
    """(val, w): the word (cost, head_id, spelling) of each value, in the order in which a walk settles ties."""
    script = lambda c: F.col(c).rlike("[\u0900-\u097F]")
    order = F.struct("cost", (F.col("spelling") != F.col("val")).alias("a"), (script("spelling") != script("val")).alias("b"), "head_id", "spelling")
    return found.groupBy("val").agg(F.min(order).alias("w"))


def _joined(rows: DataFrame, words: DataFrame, all_rows: bool) -> DataFrame:
    """A dictionary too large for one trie, where nothing may cost: distinct values join the words that are read as the same letters."""
    spark = rows.sparkSession
    looks = F.pandas_udf(lambda s: s.map(lambda x: "".join(free_letters(x))), "string")
    even = F.pandas_udf(lambda s: s.map(consistent), "string")
    vals = written(spark, rows.select("val").distinct().withColumn("look", looks("val")), "vals")
    held = words.withColumn("look", looks("spelling"))
    best = _nearest(vals.join(held, "look").withColumn("cost", F.lit(0.0)))
    out = rows.join(best, "val", "left" if all_rows else "inner").select("src", "row_id", "pos", "val", "w.head_id", F.coalesce("w.spelling", even("val")).alias("spelling"), "w.cost")
    return out if all_rows else out.where("val <> spelling")


def lookalike_rows(tables) -> DataFrame:
    """(src, row_id, pos, head_id): words that look like a headword without being equal to it; distinct."""
    return canonical(corpus_words(tables), tables("headwords")).select("src", "row_id", "pos", "head_id").distinct()
