import os
import random
from collections import Counter

from pyspark.sql import functions as F

from tantu.llm import termcounts
from tests.conftest import rows

SCHEMA = "fld string, rec bigint, terms array<string>"


def brute(state):
    total, records = Counter(), Counter()
    for (fld, _), terms in state.items():
        terms = [t for t in terms if t]
        total.update((fld, t) for t in terms)
        records.update((fld, t) for t in set(terms))
        records[fld, None] += 1
    return {(f, t, total[f, t], n) for (f, t), n in records.items()}


def test_deltas_keep_counts_exact_through_adds_changes_deletes_and_repeats(spark):
    rng = random.Random(8)
    state, store = {}, termcounts.TermStore(spark, buckets=3)
    for round_ in range(4):
        changes = {}
        for _ in range(60):
            key = (rng.choice("ab"), rng.randrange(50))
            terms = rng.choice([None, [], ["x"], [rng.choice(["p", "q", "r", None, "", "x y"]) for _ in range(rng.randint(0, 6))]])
            changes[key] = state.get(key, []) if rng.random() < 0.3 and key in state else terms
        store.apply(spark.createDataFrame([(f, r, t) for (f, r), t in changes.items()], SCHEMA))
        for key, terms in changes.items():
            if terms is None:
                state.pop(key, None)
            else:
                state[key] = terms
        assert rows(store.counts()) == brute(state), round_
    store.compact()
    assert rows(store.counts()) == brute(state)
    store.apply(spark.createDataFrame([(f, r, None) for f, r in state], SCHEMA))
    assert store.counts().count() == 0


def test_unchanged_records_write_no_delta(spark):
    store = termcounts.TermStore(spark)
    records = spark.createDataFrame([("a", 1, ["x"]), ("a", 2, [])], SCHEMA)
    store.apply(records)
    store.apply(records)
    assert not [n for n in os.listdir(f"{store.path}/counts/gen=1") if n.startswith("bucket")]
    assert rows(store.counts()) == {("a", "x", 1, 1), ("a", None, 0, 2)}


def test_a_store_reopens_with_all_it_holds(spark):
    store = termcounts.TermStore(spark)
    store.apply(spark.createDataFrame([("a", 1, ["x", "x", "y"]), ("a", 2, ["x"])], SCHEMA))
    store.apply(spark.createDataFrame([("a", 2, ["z"])], SCHEMA))
    other = termcounts.TermStore(spark.newSession(), store.path)
    assert rows(other.counts()) == {("a", "x", 2, 1), ("a", "y", 1, 1), ("a", "z", 1, 1), ("a", None, 0, 2)}
    other.apply(spark.createDataFrame([("a", 1, None)], SCHEMA))
    again = termcounts.TermStore(spark, store.path)
    assert rows(again.counts()) == {("a", "z", 1, 1), ("a", None, 0, 1)} and [(r.rec, r.terms) for r in again.records().collect()] == [(2, ["z"])]
    # an update that ended before its mark leaves the store as it was
    os.makedirs(f"{store.path}/records/gen=3/at=0")
    assert rows(termcounts.TermStore(spark, store.path).counts()) == rows(again.counts())


def test_an_update_reads_only_the_buckets_of_its_records(spark):
    store = termcounts.TermStore(spark, span=10)
    store.apply(spark.range(1000).selectExpr("'a' as fld", "id as rec", "array('x', cast(id as string)) as terms"))
    changes = spark.createDataFrame([("a", k, ["y"]) for k in range(500, 510)], SCHEMA)
    assert store.touched(changes) == [50]
    held = store._held().where(F.col("at").isin(store.touched(changes)))
    assert len(held.inputFiles()) >= 1 and held.count() == 10 and "PartitionFilters: [" in held._jdf.queryExecution().toString() and "at#" in held._jdf.queryExecution().toString()
    store.apply(changes)
    assert {(r.term, r.total) for r in store.counts().where("term in ('x', 'y', '505', '5')").collect()} == {("x", 990), ("y", 10), ("5", 1)}


def test_marks_at_their_limits(spark):
    records = [("a", i, ["all", "pair" if i < 2 else "three" if i < 5 else "rest", "exact" if i < 10 else "x"]) for i in range(1000)]
    store = termcounts.TermStore(spark)
    store.apply(spark.createDataFrame(records, SCHEMA))
    marks = {r.term: r.mark for r in store.marks().collect()}
    assert marks == {"all": "common", "pair": "rare", "three": None, "rest": "common", "exact": None, "x": "common"}


def test_empty_store_and_empty_changes(spark):
    store = termcounts.TermStore(spark)
    assert store.counts().count() == store.records().count() == store.marks().count() == 0
    store.apply(spark.createDataFrame([], SCHEMA))
    assert store.counts().count() == 0
    store.apply(spark.createDataFrame([("a", None, ["x"])], SCHEMA))
    assert rows(store.counts()) == {("a", "x", 1, 1), ("a", None, 0, 1)}


def test_records_of_the_corpus(spark):
    units = spark.createDataFrame([(1, ["a", "a"], None, None, "clash"), (1, ["a", "a"], None, None, "clash"), (2, None, "b  c", None, "clash"), (3, None, None, None, "clash")], "unit_id long, words array<string>, w string, ingested_at timestamp, terms string")
    groups = spark.createDataFrame([(1, "l"), (1, "l"), (2, None), (3, "")], "group_id long, lemma string")
    found = termcounts.corpus_records({"work_units": units, "parse_groups": groups}.get)
    assert sorted((r.fld, r.rec, r.terms) for r in found.collect()) == [("lemma", 1, ["l"]), ("words", 1, ["a", "a"]), ("words", 2, ["b", "c"]), ("words", 3, [])]


def test_two_deliveries_count_as_one(spark):
    units = [(1, ["a", "b"], None, "2023-05-01 00:00:00"), (1, ["a"], None, "2024-05-01 00:00:00"), (2, None, "b b", "2023-01-01 00:00:00"), (3, ["c"], None, "2024-06-01 00:00:00"), (4, ["d"], None, None)]
    groups = [(1, "l", "2023-01-01 00:00:00"), (2, "m", "2024-02-01 00:00:00"), (3, "", None)]
    t = {"work_units": spark.createDataFrame(units, "unit_id long, words array<string>, w string, ingested_at string").withColumn("ingested_at", F.col("ingested_at").cast("timestamp")), "parse_groups": spark.createDataFrame(groups, "group_id long, lemma string, seen_at string").withColumn("seen_at", F.col("seen_at").cast("timestamp"))}
    found = rows(termcounts.updated_counts(t.get).select("fld", "term", "total", "records"))
    assert found == {("words", "a", 1, 1), ("words", "b", 2, 1), ("words", "c", 1, 1), ("words", "d", 1, 1), ("lemma", "l", 1, 1), ("lemma", "m", 1, 1)}
