import os
import random

import pytest

from tantu.llm import mixing
from tests.conftest import rows

DOC = "doc_id long, text string, source string, place string, copies string"
TARGET = "source string, target_share double, max_repeat int"
pytestmark = pytest.mark.skipif(not os.path.exists(mixing.VOCABULARY), reason="the tokenizer's vocabulary is not here")


def documents(spark, sizes, seed=1):
    rng = random.Random(seed)
    data = [(s, "word " * rng.randint(1, 60)) for s, n in sizes for _ in range(n)]
    return spark.createDataFrame([(i, t, s, "clash", "clash") for i, (s, t) in enumerate(data)], DOC)


def test_shares_are_reached_within_a_document(spark):
    docs = documents(spark, [("a", 600), ("b", 60), ("c", 300), (None, 20), ("untargeted", 20)])
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.2, 3), ("c", 0.3, 2), ("none", 0.0, 1)], TARGET)
    mix, report = mixing.mixed(docs, targets)
    by = {r.source: r for r in report.collect()}
    for source, share in (("a", 0.5), ("b", 0.2), ("c", 0.3)):
        assert abs(by[source].share - share) < 0.02
        assert by[source].target_share == share
    assert by[None].tokens_used == by["untargeted"].tokens_used == by["none"].tokens_used == 0
    copies = mix.groupBy("source").agg({"copies": "max"}).collect()
    most = {r[0]: r[1] for r in copies}
    assert most["b"] <= 3 and most["a"] == 1 and most["c"] <= 2
    # at the largest total some source is used as often as it may be
    assert any(by[s].tokens_used == by[s].tokens * m for s, m in (("a", 1), ("b", 3), ("c", 2)))


def test_a_larger_total_keeps_what_a_smaller_took(spark):
    docs = documents(spark, [("a", 300), ("b", 300)])
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], TARGET)
    before = {}
    for total in (500.0, 3000.0, 9000.0, 12_000.0):
        now = {r.doc_id: r.copies for r in mixing.mixed(docs, targets, total)[0].collect()}
        assert all(now.get(d, 0) >= c for d, c in before.items())
        before = now


def test_threshold_takes_the_records_below_it(spark):
    rng = random.Random(4)
    data = [("a", rng.randrange(1 << 60), rng.randint(1, 50)) for _ in range(500)] + [("b", 5, 10), ("b", 5, 10), ("b", 6, 10)]
    tokens = spark.createDataFrame(data, "source string, place long, n_tokens long")
    ends = mixing.thresholds(tokens, {"a": 3000.0, "b": 15.0})
    taken = sum(n for s, p, n in data if s == "a" and p < ends["a"])
    rest = min((p, n) for s, p, n in data if s == "a" and p >= ends["a"])
    assert taken <= 3000 < taken + rest[1]
    assert sum(n for s, p, n in data if s == "b" and p < ends["b"]) == 0  # two records share a place: they go in together or not at all
    assert mixing.thresholds(tokens, {}) == {}
    everything = mixing.thresholds(tokens, {"a": 1e9})["a"]
    assert all(p < everything for s, p, _ in data if s == "a")


def test_budgets():
    assert mixing.budgets({"a": 100, "b": 10}, [("a", 0.5, 1), ("b", 0.5, 2)]) == {"a": (0, 20.0), "b": (2, 0.0)}
    assert mixing.budgets({"a": 100}, [("a", 1.0, 2)], 150.0) == {"a": (1, 50.0)}
    assert mixing.budgets({"a": 100}, [("a", 1.0, 2)], 1e9) == {"a": (2, 0.0)}
    assert mixing.budgets({}, [("a", 1.0, 2)]) == {}
    assert mixing.budgets({"a": 5}, [("a", 0.0, 2), ("b", None, None)]) == {}


def test_token_counts_and_odd_documents(spark):
    docs = spark.createDataFrame([(1, None, "a", "", ""), (2, "", "a", "", ""), (3, "hello world", "a", "", ""), (3, "hello world", "a", "", ""), (4, "क " * 100_000, None, "", ""), (5, "<|endoftext|>", "a", "", "")], DOC)
    counts = mixing.token_counts(docs).collect()
    n = {r.doc_id: r.n_tokens for r in counts}
    assert n[1] == n[2] == 0 and n[3] >= 2 and n[4] > 1000 and n[5] > 1 and len(counts) == 6
    targets = spark.createDataFrame([("a", 1.0, 1), ("a", 0.5, 2), (None, 0.5, 1), ("z", None, None)], TARGET)
    mix, report = mixing.mixed(docs, targets)
    assert {r.source for r in report.collect()} == {"a", "z", None}
    assert rows(mix.select("doc_id")) <= {(1,), (2,), (3,), (5,)}


def test_empty_tables(spark):
    docs, targets = documents(spark, [("a", 5)]), spark.createDataFrame([("a", 1.0, 1)], TARGET)
    assert mixing.mixed(docs.limit(0), targets)[0].count() == 0
    mix, report = mixing.mixed(docs, targets.limit(0))
    assert mix.count() == 0 and report.count() == 1
