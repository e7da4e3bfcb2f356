"""Several values packed in one field: the dialect (delimiters and quoting) of each field by minimum description length.

Every distinct text is parsed under every candidate dialect, a set of delimiters and a kind of quote (or none). The corpus
tells what its values cost: a value is spelled as a shape (letters folded) plus its characters, or taken from a code book by
its frequency, where its entry in the book is shared among its uses. Frequencies are counted over all candidate parses of all
fields first, those of single values among them, then over the parses chosen. A field is read in the dialect in which
dialect, delimiters, quotes and values together take the fewest bits.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tantu.session import written

DELIMITERS = ";,/|、；／，｜\t "
CHAR_BITS = 6.0
STRAY_BITS = 200.0  # of a quote that a value holds as a plain character, at every use: nothing separates inside quotes
QUOTE_BITS = 1.0  # of the quotes around a value
HOT = 1e-5  # share of all values from which a value's code is broadcast: at most 1 / HOT values have it
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "「": "」", "'": "'"}  # a kind of quote by its opening
EDGE_QUOTES = "'"  # kinds that only quote where they stand at both ends of a value: apostrophes do not
FLUSH = 2_000_000  # characters of parsed texts after which a frame is handed on


def split_outside(text: str, delimiters: str, quote: str = '"') -> list[str]:
    """Pieces of text between delimiters that stand outside braces and quotes; outer spaces and enclosing quotes gone."""
    return [value for value, _ in _pieces(text, delimiters, quote)]


def _pieces(text: str, delimiters: str, quote: str) -> list[tuple[str, bool]]:
    """(value, was quoted) of a text under a dialect."""
    close = QUOTES.get(quote, "")
    ranges, at, depth, quoted = [], 0, 0, False
    for i, ch in enumerate(text):
        if quoted:
            if ch == close and (quote not in EDGE_QUOTES or not text[i + 1 :].strip() or text[i + 1 :].lstrip(" ")[:1] in delimiters or text[i + 1 : i + 2] in delimiters):
                quoted = False
        elif quote and ch == quote and (quote not in EDGE_QUOTES or not text[at:i].strip()):
            quoted = True
        elif ch == "{":
            depth += 1
        elif ch == "}":
            depth = max(0, depth - 1)
        elif depth == 0 and ch in delimiters:
            ranges.append(text[at:i])
            at = i + 1
    ranges.append(text[at:])
    values = []
    for piece in ranges:
        piece = piece.strip()
        boxed = bool(quote) and len(piece) >= 2 and piece[0] == quote and piece[-1] == close and close not in piece[1:-1]
        if boxed:
            piece = piece[1:-1].strip()
        if piece:
            values.append((piece, boxed))
    return values


def dialects(text: str) -> Iterator[tuple[str, str]]:
    """Candidate (delimiters, quote) of a text: every combination of the delimiters outside braces, with no quotes and with
    each kind of which the text holds an opening and its closing."""
    bare = text
    while (inner := re.sub(r"\{[^{}]*\}", "x", bare)) != bare:
        bare = inner
    if "{" in bare:  # an open brace shields the rest
        bare = bare[: bare.index("{")]
    quotes = ["", *(q for q, close in QUOTES.items() if q in text and close in text[text.index(q) + 1 :])]
    found = "".join(d for d in DELIMITERS if d in bare.strip())
    for quote in quotes:
        for k in range(len(found) + 1):
            for some in itertools.combinations(found, k):
                yield "".join(some), quote


def candidate_parses(texts: DataFrame) -> DataFrame:
    """(tid, text, dialect, quote, options, boxes, vals) for every dialect of each row of ``texts`` (column text).

    tid: 128 bits of the text's hashes, which stand for it where values are told apart, as texts may be long. options: how many parses of the text differ; boxes: how many of the values are quoted. Dialects that give one parse are
    one candidate, that with the fewest delimiters.
    """
    columns = ["text", "dialect", "quote", "options", "boxes", "vals"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for text in batch["text"]:
                if text is None:
                    continue
                parses: dict[tuple, tuple] = {}
                for d, q in sorted(dialects(text), key=lambda x: (len(x[0]), len(x[1]))):
                    parses.setdefault(tuple(_pieces(text, d, q)), (d, q))
                for pieces, (d, q) in parses.items():
                    rows.append((text, d, q, len(parses), sum(boxed for _, boxed in pieces), [value for value, _ in pieces]))
                    size += len(text)
                    if size >= FLUSH:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
            yield pd.DataFrame(rows, columns=columns)

    parses = texts.select("text").mapInPandas(run, "text string, dialect string, quote string, options int, boxes int, vals array<string>")
    return parses.select(F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text")).alias("tid"), *columns)


def _shape(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"[\p{L}\p{M}]+", "a"), "[0-9]+", "0")


def value_codes(values: DataFrame, parses: DataFrame, weight: Column) -> DataFrame:
    """(val, bits, share) of every one of ``values`` (val, shape): what it costs by its weighted counts over ``parses`` (vals)."""
    counted = parses.select(F.explode("vals").alias("val"), weight.alias("w")).groupBy("val").agg(F.sum("w").alias("w"))
    held = values.join(counted, "val", "left")
    every = parses.agg(F.sum(weight * F.size("vals")).alias("all")).scalar()
    shapes = held.where("w is not null").groupBy("shape").agg(F.sum("w").alias("ws"))
    stray = STRAY_BITS * F.length(F.regexp_replace("val", "[^" + "".join({*QUOTES, *QUOTES.values()} - set(EDGE_QUOTES)) + "]", ""))
    spelled = F.coalesce(-F.log2(F.col("ws") / every), F.lit(40.0)) + CHAR_BITS * F.length("val")
    coded = held.join(shapes, "shape", "left").withColumn("spelled", spelled)
    bits = F.least("spelled", -F.log2(F.col("w") / every) + F.col("spelled") / F.col("w"))
    return coded.select("val", (bits + stray).alias("bits"), F.coalesce(F.col("w") / every, F.lit(0.0)).alias("share"))


def _cheapest(parses: DataFrame, codes: DataFrame) -> DataFrame:
    """parses of the dialect with the fewest bits for each text; ties: fewer delimiters, then their order, then no quotes.

    Codes of frequent values are broadcast, 1 / HOT of them at most; only the others are joined by value.
    """
    rows = parses.select("tid", "dialect", "quote", "boxes", F.explode_outer("vals").alias("val"))
    hot = F.broadcast(codes.where(F.col("share") >= HOT).select("val", "bits"))
    rare = codes.where(F.col("share") < HOT).select("val", "bits")
    coded = rows.join(hot, "val").union(rows.join(hot, "val", "left_anti").join(rare, "val", "left").select("val", "tid", "dialect", "quote", "boxes", "bits"))
    # each delimiter kind of the dialect costs its name once, so does the quote; each value a bit for its end
    named = 2.0 * F.length("dialect") + 2.0 * F.length("quote") + QUOTE_BITS * F.col("boxes")
    scored = coded.groupBy("tid", "dialect", "quote", "boxes").agg((F.sum(F.coalesce("bits", F.lit(0.0))) + F.count("*")).alias("b"))
    best = scored.groupBy("tid").agg(F.min(F.struct(F.round(F.col("b") + named, 6).alias("b"), F.length("dialect").alias("n"), "dialect", "quote")).alias("d"))
    return parses.join(best.select("tid", "d.dialect", "d.quote"), ["tid", "dialect", "quote"])


def chosen_dialects(texts: DataFrame) -> DataFrame:
    """(text, dialect, quote, vals): the cheapest dialect of every distinct text of ``texts`` (column text) and its values.

    Null texts give no row; an empty text has no values.
    """
    spark = texts.sparkSession
    parses = written(spark, candidate_parses(texts.where("text is not null").select("text").distinct()), "parses")
    values = written(spark, parses.select(F.explode("vals").alias("val")).distinct().withColumn("shape", _shape(F.col("val"))), "values")
    first = written(spark, _cheapest(parses, written(spark, value_codes(values, parses, 1 / F.col("options")), "codes")), "first")
    second = _cheapest(parses, written(spark, value_codes(values, first, F.lit(1.0)), "codes"))
    return second.select("text", "dialect", "quote", "vals")


def unpack(df: DataFrame, keys: list[str], column: str, least: int = 2) -> DataFrame:
    """(keys, pos, val): one row for each value of ``column``, where a field holds at least ``least`` values.

    Positions count from 0 over the values of a field; empty pieces take none. Null and empty fields give no rows,
    repeated rows come out repeatedly. All fields tell what values cost, those of a single value, too.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(column).alias("text")).where("text is not null and text <> ''")
    read = chosen_dialects(rows.select("text")).where(F.size("vals") >= least)
    joined = rows.join(read.select("text", "vals"), "text")
    return joined.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], F.posexplode("vals").alias("pos", "val"))


def packed_values(spark_tables) -> DataFrame:
    """(src, row_id, member_pos, pos, val): values of the packed fields of the analysis and morph tables; distinct."""
    analysis = spark_tables("analysis_rows").select(F.lit("analysis_rows").alias("src"), F.col("row_id"), F.lit(-1).alias("member_pos"), F.col("morph_in_context").alias("text"))
    morph = spark_tables("morph_entries").select(F.lit("morph_entries").alias("src"), F.col("entry_id").alias("row_id"), F.posexplode("m").alias("member_pos", "m")).select("src", "row_id", "member_pos", F.col("m.f").alias("text"))
    keys = ["src", "row_id", "member_pos"]
    return unpack(analysis.union(morph).distinct(), keys, "text").select(*keys, "pos", "val").distinct()
