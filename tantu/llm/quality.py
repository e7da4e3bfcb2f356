"""Text statistics of every document, and the type of its text by noisy labelling functions whose accuracies are learned.

One pass computes the statistics. Thresholds on them are labelling functions: each fires for one type (prose, list, table
or junk) or abstains. How often each fires under each type is learned by expectation-maximisation from the votes of all
documents, counted by pattern; a document's posterior follows from its own votes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tantu.session import hinted, written

KINDS = ("prose", "list", "table", "junk")

# Frequent function words of English and particles of classical Chinese.
COMMON = frozenset("a an and are as at be but by for from had has he her his if in into is it its no not of on or our she so some such than that the their them then there these they this those to under until upon was were when where which while who whom whose will with without you".split())
PARTICLES = frozenset("之乎者也而以於其與所為皆乃則復若及焉矣哉")

STATS = [
    "words", "mean_word", "longest_word", "lines", "symbols", "digits", "letters", "ends", "common", "repeated", "packed", "foreign",
    "list_lines", "list_chars", "table_lines", "table_chars", "prose_lines", "prose_chars", "bullets", "pairs", "columns", "tags", "words_a_line", "stops", "junk_chars", "singles", "distinct", "vowels",
]

_BULLET = re.compile(r"(?:[-–—•*·‣◦▪○●]|\(?[0-9०-९]{1,4}[.):、]|[(\[]?[a-zA-Z][.)\]]|[☐✓])\s+\S")
_PAIR = re.compile(r"^[^\s:=]+(?: [^\s:=]+){0,4}(?::| [—–=-]|\t| →) ?\S")
_INDEX = re.compile(r"[,.;\s]\s*\d+(?:[.:]\d+)*[\s.;,।॥。]*$")
_END = re.compile(r"[.!?;:。！？；।॥…][\"”’»)\]]*$")
_NOT_LETTER = re.compile("[^\\w\u0300-\u036f\u0900-\u097f]+|[\\d_]+")
_NUMBER = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")
_FOREIGN = re.compile("[\u00c2-\u00f4][\u0080-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013\u2014\u2018-\u201e\u2020-\u2022\u2026\u2030\u2039\u203a\u20ac\u2122]|[\ufffd\u0080-\u009f]")  # UTF-8 read as Latin-1
_HAN = re.compile("[㐀-鿿]")
_STOP = re.compile(r"[.!?。！？।॥;；]")
_CELLS = [("|", 1), ("\t", 1), (";", 2), (",", 2), ("｜", 1)]
_GAPS = re.compile(r"\S {3,}(?=\S)")
_TAG = re.compile(r"^\s*</?[a-zA-Z!][^>]*>")


def _line_length(line: str, han: bool) -> float:
    """Words in a line; two Chinese characters count as a word."""
    return max(1, len(_HAN.findall(line)) / 2) + len(line.split()) - 1 if han else len(line.split())


def _columns(lines: list[str]) -> tuple[float, str, list[int], int]:
    """(share of lines, delimiter, its count in each line, the usual count) of the columns that most lines share."""
    n = len(lines)
    best: tuple[float, str, list[int], int] = (0.0, "", [], 0)
    if n < 3:
        return best
    for mark, least in _CELLS:
        counts = [line.count(mark) for line in lines]
        held = [k for k in counts if k >= least]
        if held:
            usual = max(set(held), key=lambda k: (held.count(k), k))
            share = held.count(usual) / n
            if share > best[0] + 0.05:
                best = share, mark, counts, usual
    gaps = [2 * (len(_GAPS.findall(line)) >= 2) for line in lines]  # aligned by spaces; a full cell may touch the next
    share = sum(g > 0 for g in gaps) / n
    return (share, "  ", gaps, 2) if share > best[0] + 0.05 else best


def statistics(text: str) -> tuple[float, ...]:
    """The statistics named in STATS; all 0 for a text without visible characters."""
    solid = _SPACE.sub("", text)
    size = len(solid)
    if not size:
        return (0.0,) * len(STATS)
    tokens = text.split()
    letters = len(_NOT_LETTER.sub("", solid))
    digits = sum(map(len, _NUMBER.findall(solid)))
    han = len(_HAN.findall(solid)) if not text.isascii() else 0
    chinese = han * 4 > size
    words = len(tokens) + (han / 2 if chinese else 0)
    lines = [line for line in map(str.strip, text.split("\n")) if line]
    n = len(lines)
    packed = len(zlib.compress(text.encode("utf-8", "replace"), 1)) / len(text.encode("utf-8", "replace"))
    foreign = 2 * len(_FOREIGN.findall(solid)) / size if not text.isascii() else 0.0
    common = sum(c in PARTICLES for c in solid) / size * 2 if chinese else sum(t in COMMON for t in text.lower().split()) / max(1, len(tokens))
    ends = sum(bool(_END.search(line)) for line in lines) / n
    best, cell, counts, usual = _columns(lines)
    kinds = {"list": [0, 0], "table": [0, 0], "prose": [0, 0], "junk": [0, 0]}
    bullets = pairs = tags = 0
    for i, line in enumerate(lines):
        long = _line_length(line, chinese)
        bullet, pair, tag = bool(_BULLET.match(line)), bool(_PAIR.match(line)), bool(_TAG.match(line))
        bullets += bullet
        pairs += pair
        tags += tag
        if tag or not chinese and max(map(len, line.split())) > 70:
            kind = "junk"
        elif cell and counts[i] == usual and long / (usual + 1) < 8 and not (cell in ",;" and (bullet and long < 3 or _INDEX.search(line) and usual < 3)):
            kind = "table"
        elif bullet and long < 16 or pair and long < 14 or _INDEX.search(line) and long < 8 or long <= 4.5 and len(line) <= 36 and not (long > 3.5 and _END.search(line)):
            kind = "list"
        else:
            kind = "prose"
        opening = i == 0 or i == 1 and _line_length(lines[0], chinese) <= 3
        if opening and n >= 4 and kind == "prose" and long <= 40 and len(_STOP.findall(line)) <= 1:  # one sentence over a list or table
            continue
        kinds[kind][0] += 1
        kinds[kind][1] += len(line)
    held = max(1, sum(v[0] for v in kinds.values()))
    chars = max(1, sum(v[1] for v in kinds.values()))
    # of a hundred words (or Chinese characters) the share that differ; vowels among Latin letters, where they are the text
    units = _HAN.findall(solid) if chinese else tokens
    distinct = min(1.0, len(set(units)) / min(100, max(1, len(units))))
    low = text.lower()
    vowel, consonant = sum(map(low.count, "aeiouāīūṛ")), sum(map(low.count, "bcdfghjklmnpqrstvwxz"))
    vowels = vowel / (vowel + consonant) if (vowel + consonant) * 2 > max(letters, 1) else 0.4
    singles = sum(len(t) == 1 and t.isalpha() for t in tokens) / len(tokens) if not chinese else 0.0
    return (
        float(words), size / max(1.0, words), float(max(map(len, tokens))) if not chinese else 0.0, float(n), (size - letters - digits) / size, digits / size, letters / size, ends, common,
        1 - len(set(lines)) / n, packed, foreign,
        kinds["list"][0] / held, kinds["list"][1] / chars, kinds["table"][0] / held, kinds["table"][1] / chars, kinds["prose"][0] / held, kinds["prose"][1] / chars,
        bullets / n, pairs / n, best, tags / n, words / n, len(_STOP.findall(text)) / max(1.0, words), kinds["junk"][1] / chars, singles, distinct, vowels,
    )


# What running text shows besides its lines: neither spelled out, repeated, garbled nor without vowels.
_NATURAL = "singles < 0.5 and distinct > 0.25 and vowels > 0.2 and foreign < 0.03 and repeated < 0.5"

# Labelling functions: (type, condition over the statistics). Each fires or abstains. The functions of a type rest on
# statistics of different kinds (repetition, symbols, encoding, markup, letters; lines, columns, lengths, words), so that
# none repeats another's vote: thresholds on one kind are joined in one function.
FUNCTIONS: list[tuple[str, str]] = [
    ("junk", "lines >= 4 and repeated > 0.6 or packed < 0.13 and words > 8 or packed < 0.2 and letters < 0.5 or distinct < 0.22 and words > 12"),
    ("junk", "letters < 0.25 or symbols > 0.4 and digits < 0.4 and table_chars < 0.7"),
    ("junk", "foreign > 0.03"),
    ("junk", "tags > 0.5 or junk_chars > 0.6 or longest_word > 90 and mean_word > 25"),
    ("junk", "vowels < 0.2 and lines < 4 or singles > 0.6 and words > 8"),
    ("table", "table_chars > 0.7 and table_lines > 0.6 and lines >= 3"),
    ("table", "columns > 0.75 and words_a_line < 16 and list_chars < 0.5"),
    ("list", "list_chars > 0.6 and list_lines > 0.7 and lines >= 3 and repeated < 0.5 and letters > 0.25 and foreign < 0.03"),
    ("list", "(bullets > 0.6 or pairs > 0.6) and words_a_line < 12"),
    ("list", "words_a_line < 3.5 and lines >= 4 and columns < 0.75 and repeated < 0.5"),
    ("prose", f"prose_chars > 0.6 and {_NATURAL}"),
    ("prose", f"words_a_line > 5.5 and letters > 0.7 and columns < 0.75 and {_NATURAL}"),
    ("prose", "common > 0.2 and distinct > 0.25"),
    ("prose", f"stops > 0.03 and stops < 0.4 and words_a_line > 5.5 and {_NATURAL}"),
]


def document_statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, the statistics of STATS): one row for each document with a text that is not null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [statistics(t) for t in batch["text"]]
            out = pd.DataFrame(rows, columns=STATS, dtype=float)
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    schema = "doc_id long, " + ", ".join(f"{s} double" for s in STATS)
    return documents.where("text is not null").select("doc_id", "text").mapInPandas(run, schema)


def learn(patterns: list[tuple[str, int]], rounds: int = 40) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """(share of each type, chance of each function to fire under each type, posterior of each pattern).

    Patterns are strings of 0 and 1, with how many documents show them. Starts from the belief that a function fires
    mostly under its own type; pseudo-counts keep rates off 0 and 1 where a type or function is rare, and a function is
    held to be better than chance: under other types it fires at most half as often as under its own.
    """
    own = np.array([KINDS.index(k) for k, _ in FUNCTIONS])
    fires = np.where(np.arange(len(KINDS))[:, None] == own[None, :], 0.6, 0.04)
    share = np.array([0.7, 0.1, 0.1, 0.1])
    if not patterns:
        return share, fires, {}
    votes = np.array([[c == "1" for c in p] for p, _ in patterns], float)
    weight = np.array([n for _, n in patterns], float)
    prior_yes, prior_no = fires * 20, (1 - fires) * 20
    for _ in range(rounds):
        logs = np.log(share)[None, :] + votes @ np.log(fires).T + (1 - votes) @ np.log(1 - fires).T
        post = np.exp(logs - logs.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        held = post * weight[:, None]
        mass = held.sum(0)
        share = (mass + 5) / (mass.sum() + 5 * len(KINDS))
        fires = (held.T @ votes + prior_yes) / (mass[:, None] + prior_yes + prior_no)
        best = np.maximum(fires[own, np.arange(len(own))], 0.1)
        fires = np.minimum(fires, best / 2)
        fires[own, np.arange(len(own))] = best
    # a type that no function speaks for is none; without any vote a text is prose
    spoken = votes @ (own[:, None] == np.arange(len(KINDS))[None, :]) > 0
    spoken[:, 0] = True
    post = np.where(spoken, post, 0.0)
    post /= post.sum(1, keepdims=True)
    return share, fires, {p: post[i] for i, (p, _) in enumerate(patterns)}


def text_types(documents: DataFrame, rounds: int = 40) -> DataFrame:
    """(doc_id, the statistics, kind, p_prose, p_list, p_table, p_junk) of every document whose text is not null.

    A text without visible characters is junk. Repeated doc_ids give a row each. Patterns of votes are at most 2 to the
    number of functions (16,384 rows), whatever the number of documents; they alone reach the driver and are broadcast.
    """
    spark = documents.sparkSession
    pattern = F.concat(*[F.when(F.expr(rule), "1").otherwise("0") for _, rule in FUNCTIONS])
    held = written(spark, document_statistics(documents).withColumn("votes", F.when(F.col("lines") > 0, pattern)), "stats")
    counted = [(r.votes, r.n) for r in held.where("votes is not null").groupBy("votes").agg(F.count("*").alias("n")).collect()]
    _, _, posterior = learn(sorted(counted), rounds)
    rows = [(p, KINDS[int(q.argmax())], *map(float, q)) for p, q in posterior.items()]
    types = spark.createDataFrame(rows, "votes string, kind string, p_prose double, p_list double, p_table double, p_junk double")
    return held.join(hinted(types, len(rows)), "votes", "left").drop("votes").withColumn("kind", F.coalesce("kind", F.lit("junk")))


def not_prose(documents: DataFrame) -> DataFrame:
    """(doc_id, kind) of the documents that are mainly a list, a table or junk."""
    return text_types(documents).where("kind <> 'prose'").select("doc_id", "kind").distinct()
