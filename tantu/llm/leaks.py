"""Evaluation items that stand, wholly or in part, in corpus documents: rare n-gram seeds, then local alignment.

Texts are compared by their letters and digits alone, without case, accents, punctuation, spacing and look-alikes. Both
sides give hashed n-grams of those letters; documents keep only those that pass a Bloom bitmap of the items' n-grams, and
a join on the hash finds who shares what. How many documents hold an n-gram tells which are rare: the rarest of every
window of an item that is as long as a leak is a seed, so no whole run is lost however common the rest of it is, and for
alignments every n-gram held by few documents is one, too. Documents that share a seed with an item are aligned with it
(Smith-Waterman over words); the score decides, and for whole runs an exact check of the run follows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tantu.functions.lookalike import IGNORABLE, LETTERS, SEQUENCES
from tantu.session import written

WORDS, HAN = 10, 16  # a leak's consecutive words, and Chinese characters
GRAM, HAN_GRAM = 20, 8  # letters of an n-gram, and Chinese characters; shorter where an item's shortest window is
EDITED_GRAM = 10  # letters of an n-gram where edited copies are wanted as well: two or three words
RARE = 0.01  # share of the documents up to which an n-gram is rare
SHARE = 0.5  # share of an item's words that an edited copy must hold in alignment
COVER = 0.05  # share of an item's n-grams that an edited copy must hold to be aligned
MOST_BITS = 1 << 27  # of the Bloom bitmap (16 MB); more n-grams only let more through to the join
MATCH, MISMATCH, GAP = 2, -1, -1

_ODD = re.compile("[" + "".join(LETTERS) + "अआओऔऐए" + IGNORABLE + "]")
_PROTO = {**{ord(k): v.lower() for k, v in LETTERS.items()}, **{ord(k): v[0] for k, v in SEQUENCES.items() if v[0] not in ":|"}, **{ord(c): None for c in IGNORABLE}}
_OUT = re.compile(r"[\W_]+")
_DELETE = bytes(c for c in range(128) if not chr(c).isalnum())
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_HAN = re.compile("[㐀-䶿一-鿿豈-﫿]")


def letters(text: str) -> str:
    """The text's letters and digits: lower case, without marks, spaces, punctuation, invisible and look-alike characters."""
    if text.isascii():
        return text.encode("ascii").translate(_LOWER, _DELETE).decode("ascii")
    text = unicodedata.normalize("NFKD", text).lower()
    if _ODD.search(text):
        text = text.translate(_PROTO)
    return _OUT.sub("", text)


_MARKS = re.compile(r"[^\w\s]+")


def words(text: str) -> list[str]:
    """The text's words in the form of ``letters``; Chinese characters are words of their own."""
    found = []
    for piece in re.split(r"[\s‐-―\-/|>]+", unicodedata.normalize("NFKC", text)):
        plain = letters(piece)
        if not plain:
            continue
        if _HAN.search(plain):
            found += re.findall("[㐀-䶿一-鿿豈-﫿]|[^㐀-䶿一-鿿豈-﫿]+", plain)
        else:
            found.append(plain)
    return found


def is_han(text: str, lang: str | None) -> bool:
    plain = letters(text)
    return lang == "zh" or lang is None and len(_HAN.findall(plain)) * 2 > len(plain) > 0


def align(a: list[str], b: list[str]) -> tuple[int, int, int, int]:
    """Smith-Waterman over words: (score, equal words of the best local alignment, its end in a, its end in b)."""
    if not a or not b:
        return 0, 0, 0, 0
    codes = {w: i for i, w in enumerate(dict.fromkeys(a))}
    x = np.array([codes[w] for w in a])
    y = np.array([codes.get(w, -1) for w in b])
    slope = np.arange(len(y) + 1) * -GAP
    row = np.zeros(len(y) + 1, np.int64)
    best, where, rows = 0, (0, 0), [row]
    for i, code in enumerate(x, 1):
        diagonal = row[:-1] + np.where(y == code, MATCH, MISMATCH)
        new = np.zeros(len(y) + 1, np.int64)
        new[1:] = np.maximum(np.maximum(diagonal, row[1:] + GAP), 0)
        new = np.maximum.accumulate(new + slope) - slope  # gaps along b
        row = np.maximum(new, 0)
        rows.append(row)
        j = int(row.argmax())
        if row[j] > best:
            best, where = int(row[j]), (i, j)
    i, j = where
    equal = 0
    while i and j and rows[i][j] > 0:  # back along the best path
        same = y[j - 1] == x[i - 1]
        if rows[i][j] == rows[i - 1][j - 1] + (MATCH if same else MISMATCH):
            equal += int(same)
            i, j = i - 1, j - 1
        elif rows[i][j] == rows[i - 1][j] + GAP:
            i -= 1
        else:
            j -= 1
    return best, equal, where[0], where[1]


def holds_run(text: str, tokens: list[str], least: int, han: bool) -> bool:
    """Whether ``least`` consecutive tokens stand in the text, compared by letters; a run begins and ends with a word.

    Where the text's own spacing splits or joins words, letters decide; a run whose first or last word is only the end or
    start of a longer word in the text does not count.
    """
    plain = letters(text)
    starts = ends = None
    for k in range(len(tokens) - least + 1):
        run = "".join(tokens[k : k + least])
        at = plain.find(run)
        while at >= 0:
            if han:
                return True
            if starts is None:
                spans = np.cumsum([0, *(len(letters(p)) for p in re.split(r"[^\w\u0300-\u036f\u0900-\u097f]+", unicodedata.normalize("NFKD", text)))])
                starts = ends = set(spans.tolist())
                spaced = len(spans) > len(plain) / 20
            if not spaced or at in starts and at + len(run) in ends:
                return True
            at = plain.find(run, at + 1)
    return False


def item_tokens(text: str, lang: str | None) -> tuple[list[str], int, int]:
    """(words, words of a leak, letters of an n-gram) of an item; of a Chinese one its characters are the words."""
    if is_han(text, lang):
        return [c for w in words(text) for c in w], HAN, HAN_GRAM
    return words(text), WORDS, GRAM


def gram_hashes(plain: str, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n characters, by its place."""
    codes = np.frombuffer(plain.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    if len(codes) < n:
        return np.zeros(0, np.int64)
    # hashes of runs of 1, 2, 4 .. characters make up those of n: one multiplication for each doubling
    base, out, done, power, run = 0x9E3779B97F4A7C15, None, 0, codes, 1
    while run <= n:
        if n & run:
            held = len(codes) - n + 1
            part = power[done : done + held]
            out = part if out is None else out * np.uint64(pow(base, run, 1 << 64)) + part
            done += run
        if run * 2 <= n:
            power = power[: len(power) - run] * np.uint64(pow(base, run, 1 << 64)) + power[run:]
        run *= 2
    out = out + np.uint64(n)
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (out ^ (out >> np.uint64(29))).view(np.int64)


def item_windows(items: DataFrame, gram: int) -> DataFrame:
    """(item, window, at, gram): the n-grams of every window of an item that is as long as a leak, with their places."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(np.zeros(0, np.int64),) * 4]
            for item, text, lang in batch.itertuples(index=False):
                tokens, least, n = item_tokens(text, lang)
                n = n if n == HAN_GRAM else gram
                hashes = gram_hashes("".join(tokens), n)
                starts = np.cumsum([0, *map(len, tokens)])
                for w in range(len(tokens) - least + 1):
                    at = np.arange(starts[w], max(starts[w] + 1, starts[w + least] - n + 1))
                    at = at[at < len(hashes)]
                    found.append((np.full(len(at), item), np.full(len(at), w), at, hashes[at]))
            yield pd.DataFrame(dict(zip(("item", "window", "at", "gram"), map(np.concatenate, zip(*found)))))

    return items.select("item", "text", "lang").mapInPandas(run, "item long, window int, at int, gram long")


def shortest_window(items: DataFrame, most: int = GRAM) -> int:
    """Letters of the shortest run of WORDS words in the items that are not Chinese, ``most`` at most and 4 at least."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [most]
            for text, lang in batch.itertuples(index=False):
                tokens, least, n = item_tokens(text, lang)
                if n != HAN_GRAM:
                    ends = np.cumsum([0, *map(len, tokens)])
                    found += [int(x) for x in ends[least:] - ends[:-least]]
            yield pd.DataFrame({"n": [min(found)]})

    return max(4, items.select("text", "lang").mapInPandas(run, "n int").agg(F.min("n")).first()[0] or most)


def gram_bitmap(grams: DataFrame) -> tuple[np.ndarray, int]:
    """(bitmap, bits) of the column gram: two bits set of 32 an n-gram, MOST_BITS at most; its words are gathered, never the
    n-grams."""
    n = grams.agg(F.approx_count_distinct("gram")).first()[0]
    bits = min(MOST_BITS, 1 << max(16, (32 * n).bit_length()))
    spot = F.col("spot").bitwiseAND(F.lit(bits - 1))
    spots = grams.select(F.explode(F.array("gram", F.shiftrightunsigned("gram", 32))).alias("spot"))
    words_ = spots.select(F.shiftright(spot, 5).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), spot.bitwiseAND(F.lit(31)).cast("int")).alias("bit"))
    rows = words_.groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas()  # bits / 32 rows at most
    table = np.zeros(bits // 32, np.uint32)
    table[rows["word"].to_numpy(np.int64)] = rows["bit"].to_numpy(np.int64).astype(np.uint32)
    return table, bits


def document_grams(documents: DataFrame, bitmap: np.ndarray, bits: int, gram: int) -> DataFrame:
    """(doc_id, gram): the distinct n-grams of each document that the bitmap lets through."""
    held = documents.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, mask = held.value, np.int64(bits - 1)
        for batch in batches:
            idents, sizes, found = [], [], []
            for ident, text in batch.itertuples(index=False):
                plain = letters(text)
                hashes = gram_hashes(plain, gram)
                if not plain.isascii() and _HAN.search(plain):
                    hashes = np.concatenate([hashes, gram_hashes(plain, HAN_GRAM)])
                for spot in (hashes & mask, None):  # the second bit is looked up for those that have the first
                    spot = hashes >> 32 & mask if spot is None else spot
                    hashes = hashes[(table[spot >> 5] >> (spot & 31).astype(np.uint32) & 1).astype(bool)]
                hits = hashes
                if len(hits):
                    hits = np.unique(hits)
                    idents.append(ident)
                    sizes.append(len(hits))
                    found.append(hits)
            yield pd.DataFrame({"doc_id": np.repeat(np.array(idents, np.int64), sizes), "gram": np.concatenate(found) if found else np.zeros(0, np.int64)})

    return documents.where("doc_id is not null and text is not null and text <> ''").select("doc_id", "text").mapInPandas(run, "doc_id long, gram long")


def seeded_pairs(documents: DataFrame, items: DataFrame, gram: int, runs: bool, rare: float = RARE) -> DataFrame:
    """(doc_id, item, grams): documents and items that share a seed, with the hashes of the n-grams that they share.

    The rarest n-gram of every window is a seed (of equally rare ones the first): a window that stands in some document
    has only n-grams that occur, so its seed is among that document's. For ``runs`` nothing else is. Otherwise every
    n-gram in at most ``rare`` of the documents is a seed as well, and of common ones two that stand apart in the item; and
    a pair must share COVER of the item's n-grams.
    """
    spark = documents.sparkSession
    windows = written(spark, item_windows(items, gram), "windows")
    hits = written(spark, document_grams(documents, *gram_bitmap(windows), gram), "hits")
    places = windows.select("item", "at", "gram").distinct()
    held = hits.groupBy("gram").agg(F.count("*").alias("df"))  # a row for each document
    first = windows.join(held, "gram").groupBy("item", "window").agg(F.min(F.struct("df", "at", "gram")).alias("s"))
    seeds = written(spark, first.select("item", F.col("s.gram").alias("gram")).distinct(), "seeds")
    if runs:
        return hits.join(seeds, "gram").groupBy("doc_id", "item").agg(F.collect_set("gram").alias("grams"))
    few = F.greatest(F.lit(1.0), documents.agg((F.count("*") * rare).alias("n")).scalar())
    marked = places.join(held, "gram").join(seeds.withColumn("seed", F.lit(True)), ["item", "gram"], "left")
    size = F.max("at").over(Window.partitionBy("item"))
    marked = marked.select("item", "at", "gram", (F.coalesce("seed", F.lit(False)) | (F.col("df") <= few)).alias("seed"), size.alias("size"))
    pairs = hits.join(marked, "gram").groupBy("doc_id", "item").agg(F.max("seed").alias("seed"), (F.max("at") - F.min("at")).alias("apart"), F.collect_set("gram").alias("grams"), F.count("*").alias("n"), F.max("size").alias("size"))
    return pairs.where((F.col("seed") | (F.col("apart") >= gram)) & (F.col("n") >= COVER * F.col("size"))).select("doc_id", "item", "grams")


def passage_alignment(tokens: list[str], own: list[str], spots: list[int]) -> tuple[int, int]:
    """(score, equal words) of the best alignment of an item's words with the passages around places (words) of a text."""
    reach, until, best = 2 * len(tokens), -1, (0, 0)
    for word in spots:
        if word < until:  # within the passage aligned before
            continue
        until = word + reach
        score, equal, _, _ = align(tokens, own[max(0, word - reach) : until + reach])
        best = max(best, (score, equal))
    return best


def longest_true(flags: np.ndarray, least: int) -> int | None:
    """Where the longest run of true flags begins, if it has ``least`` of them."""
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False]))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    return int(starts[sizes.argmax()]) if len(sizes) and sizes.max() >= least else None


def alignments(documents: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, score, equal, share, run): whole runs and edited copies of items in documents.

    score and equal (words) belong to the best local alignment, share is equal by the item's words; run tells whether
    WORDS consecutive words (HAN Chinese characters) of the item stand there. A pair comes out with a run or a share of
    ``share`` at least. A copy so edited that no n-gram of EDITED_GRAM letters is left has no row. Null and empty texts give no row, nor do items
    shorter than a run. Repeated documents or items give one row; items that share an id give the union of their rows.
    """
    return _aligned(documents, items, False).where(F.col("run") | (F.col("share") >= share))


def _aligned(documents: DataFrame, items: DataFrame, runs: bool) -> DataFrame:
    listed = items.select("item_id", "text", "lang").where("text is not null and text <> ''").distinct()
    listed = listed.select("item_id", "text", "lang", F.xxhash64("item_id", "text", F.coalesce("lang", F.lit(""))).alias("item"))
    gram = shortest_window(listed, GRAM if runs else EDITED_GRAM)
    pairs = seeded_pairs(documents, listed, gram, runs)
    asked = pairs.join(listed, "item").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", F.col("text").alias("t"), "lang", "grams")).alias("asked"))
    asked = written(documents.sparkSession, asked, "asked")
    # ids of known size: where they are few, the planner sends them to the texts, and only texts that are asked for move
    texts = documents.select("doc_id", "text").where("text is not null and text <> ''").join(asked.select("doc_id"), "doc_id", "left_semi")
    texts = texts.join(asked.hint("merge"), "doc_id")
    spread: Column = F.xxhash64("doc_id")  # few rows, much work
    texts = texts.repartition(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), spread)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for ident, text, asked_items in batch[["doc_id", "text", "asked"]].itertuples(index=False):
                plain = letters(text)
                own = words(text)
                ends = np.cumsum([len(w) for w in own])
                characters = None
                hashes = gram_hashes(plain, gram)
                for asked_item in asked_items:
                    tokens, least, n = item_tokens(asked_item["t"], asked_item["lang"])
                    han = n == HAN_GRAM
                    if han and characters is None:
                        characters = [c for w in own for c in w]
                    places = np.flatnonzero(np.isin(gram_hashes(plain, n) if han else hashes, asked_item["grams"]))
                    spots = places if han else np.searchsorted(ends, places, side="right")
                    score, equal = passage_alignment(tokens, characters if han else own, spots.tolist())
                    certain = score >= MATCH * least
                    if not certain and not han:  # words may be broken or joined: where letters agree long enough, they are aligned
                        joined = "".join(tokens)
                        shortest = min(len("".join(tokens[k : k + least])) for k in range(len(tokens) - least + 1))
                        where = longest_true(np.isin(hashes, gram_hashes(joined, gram)), shortest - gram + 1)
                        certain = where is not None and passage_alignment(list(joined), list(plain), [where])[0] >= MATCH * shortest
                    whole = certain and holds_run(text, tokens, least, han)
                    if whole or not runs:
                        out.append((ident, asked_item["item_id"], score, equal, equal / len(tokens), whole))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "score", "equal", "share", "run"])

    return texts.mapInPandas(run, "doc_id long, item_id long, score int, equal int, share double, run boolean").distinct()


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that hold a run of an item.

    The alignment must score at least what a run scores (MATCH for each of its words); the exact check of the run follows.
    """
    return _aligned(documents, items, True).where("run").select("doc_id", "item_id").distinct()
