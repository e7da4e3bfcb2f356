"""Records of several sources mixed to target shares of the total tokens, by nested hash thresholds.

Every record has a place on a hash ring. Histograms of tokens by source and ring section tell in which section a source's
budget ends; only that section is divided again, until a single place is left. What lies below a source's threshold goes in
once more than the rest. Nothing is sorted, and a larger total takes all that a smaller one took.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tantu.session import hinted, written

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"  # of a public tokenizer; the path is a parameter everywhere
# The public vocabulary's own rule for splitting text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEVEL_BITS = 10  # sections of the ring by level: 1024
LEVELS = 6


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of every document; a null text has 0 tokens. The vocabulary (under 1 MB) is broadcast."""
    with open(vocabulary, "rb") as file:
        held = documents.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, held.value.splitlines())}
        encoding = tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [0 if t is None else len(encoding.encode_ordinary(t)) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "n_tokens": n})

    return documents.select("doc_id", "source", "text").mapInPandas(run, "doc_id long, source string, n_tokens long")


def budgets(sizes: dict[str, int], targets: list[tuple[str, float, int]], total: float | None = None) -> dict[str, tuple[int, float]]:
    """source -> (whole copies of everything, tokens of one more copy of a part).

    Without a total: the largest at which every source that has tokens reaches its share within its repeats. With one:
    what a source can't give within its repeats is missing from the mix.
    """
    held = [(s, share, most) for s, share, most in targets if share and share > 0 and most and most > 0 and sizes.get(s, 0) > 0]
    if total is None:
        total = min((most * sizes[s] / share for s, share, most in held), default=0.0)
    found = {}
    for source, share, most in held:
        wanted = min(share * total, float(most * sizes[source]))
        whole = int(wanted // sizes[source])
        part = wanted - whole * sizes[source]
        found[source] = (whole, part if whole < most else 0.0)
    return found


def thresholds(tokens: DataFrame, parts: dict[str, float]) -> dict[str, int]:
    """source -> place on the ring below which the records hold its part of tokens, or fall short of it by one record.

    tokens: source, place (0 to 2^60), n_tokens. Each level sums tokens by section of what is still undecided, which is
    the whole ring first and one section of a source then; a level brings at most 1024 sums a source to the driver. A
    source is decided as soon as the section where its budget ends holds a single record, or after the last level.
    """
    spark = tokens.sparkSession
    state = {s: (0, part) for s, part in parts.items()}  # start of the undecided section, tokens still wanted
    decided: dict[str, int] = {}
    for level in range(1, LEVELS + 1):
        shift = LEVEL_BITS * (LEVELS - level)
        if not state:
            break
        frame = spark.createDataFrame([(s, start >> (shift + LEVEL_BITS)) for s, (start, _) in state.items()], "source string, above long")
        inside = tokens.join(hinted(frame, len(state)), "source").where(F.shiftright("place", shift + LEVEL_BITS) == F.col("above"))
        sums = inside.groupBy("source", F.shiftright("place", shift).alias("section")).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k")).collect()
        by_source: dict[str, list[tuple[int, int, int]]] = {}
        for r in sums:
            by_source.setdefault(r.source, []).append((r.section, r.n, r.k))
        for source, (start, wanted) in list(state.items()):
            for section, n, k in sorted(by_source.get(source, [])):
                if n > wanted:
                    state[source] = (section << shift, wanted)
                    if k == 1:
                        decided[source] = state.pop(source)[0]
                    break
                wanted -= n
            else:  # all of the undecided section fits
                decided[source] = start + (1 << (shift + LEVEL_BITS))
                del state[source]
    return decided | {s: start for s, (start, _) in state.items()}


def mixed(documents: DataFrame, targets: DataFrame, total: float | None = None, vocabulary: str = VOCABULARY, seed: int = 9) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, n_tokens, copies; copies 1 or more) and its report.

    Shares are of what the sources with documents supply: where a target has none, the others' shares grow by one factor.
    Report: a row for every source of the targets or the documents: target_share, max_repeat, docs, tokens (available),
    docs_used, copies, tokens_used, share. Documents of no target source, or of a null one, are not used; a target without
    documents has zeros. A source misses its part by less than the tokens of one document. Repeated doc_ids fall on one
    place of the ring: they go in together. Of a source that is listed twice the first row in order of share counts.
    """
    spark = documents.sparkSession
    place = F.shiftright(F.xxhash64("doc_id", F.lit(seed)).bitwiseAND(F.lit((1 << 63) - 1)), 3)
    tokens = written(spark, token_counts(documents, vocabulary).withColumn("place", place), "tokens")
    listed: dict[str, tuple[float, int]] = {}
    for r in targets.where("source is not null").select("source", "target_share", "max_repeat").distinct().orderBy("source", "target_share", "max_repeat").collect():
        listed.setdefault(r.source, (r.target_share or 0.0, r.max_repeat or 0))
    wanted = spark.createDataFrame([(s, *v) for s, v in listed.items()], "source string, target_share double, max_repeat int")
    sizes_rows = tokens.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    sizes = {r.source: r.tokens for r in sizes_rows.join(hinted(wanted, len(listed)), "source").collect()}
    plan = budgets(sizes, [(s, *v) for s, v in listed.items()], total)
    ends = thresholds(tokens.where("n_tokens > 0"), {s: part for s, (_, part) in plan.items() if part > 0})
    rules = spark.createDataFrame([(s, whole, ends.get(s, 0)) for s, (whole, _) in plan.items()], "source string, whole int, until long")
    copies = F.col("whole") + F.when(F.col("place") < F.col("until"), 1).otherwise(0)
    mix = tokens.join(hinted(rules, len(plan)), "source").select("doc_id", "source", "n_tokens", copies.alias("copies")).where("copies > 0")
    used = mix.groupBy("source").agg(F.count("*").alias("docs_used"), F.sum("copies").alias("copies"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_used"))
    whole = used.agg(F.sum("tokens_used")).scalar()
    report = sizes_rows.join(wanted, "source", "full").join(used, "source", "left").select(
        "source", "target_share", "max_repeat", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("docs", "tokens", "docs_used", "copies", "tokens_used")],
        F.coalesce(F.col("tokens_used") / F.nullif(whole, F.lit(0)), F.lit(0.0)).alias("share"),
    )
    return mix, report
