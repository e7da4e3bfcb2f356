import math
import random

import pytest
from pyspark.sql import functions as F

from tantu.operators import build, lookup, ordered, ranking, reading, search, stores
from tests.conftest import rows


def test_first_by_and_first_match(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), (None, 5, None), ("b", None, "q")], "k string, o int, v string")
    assert rows(ordered.first_by(df, ["k"], ["o"])) == {("a", 1, "y"), (None, 5, None), ("b", None, "q")}
    tried = spark.createDataFrame([(1, "p", 0), (1, "q", 1), (2, "z", 0)], "id int, key string, no int")
    table = spark.createDataFrame([("q", "Q"), ("r", "R")], "name string, v string")
    assert rows(ordered.first_match(tried, table, ["id"], "key", "no", "name").select("id", "key", "v")) == {(1, "q", "Q")}


def test_longest_prefix_against_brute_force(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(200)]
    table = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(25)]
    want = {}
    for i, t in enumerate(texts):
        hits = [k for k in table if t.startswith(k) and 3 <= len(k) < len(t)]
        if hits:
            want[i] = max(hits, key=len)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = ordered.longest_prefix(df, spark.createDataFrame([(k,) for k in table], "k string"), ["id"], "t", "k", 3)
    assert {r.id: r.prefix for r in got.collect()} == want


def test_suffix_trim(spark):
    df = spark.createDataFrame([(1, "abcd"), (2, "abc"), (3, "xyzzy"), (4, "ab")], "id int, t string")
    table = spark.createDataFrame([("abc",), ("ab",), ("xyz",)], "k string")
    assert rows(ordered.suffix_trim(df, table, ["id"], "t", "k").select("id", "stem", "cut")) == {(1, "abc", 1), (3, "xyz", 2)}


def test_ordered_dedupe_keeps_the_place_and_takes_the_richer(spark):
    df = spark.createDataFrame([("k", "x", 0, None), ("k", "y", 1, None), ("k", "x", 2, "m"), ("k", "x", 3, "n")], "k string, i string, o int, m string")
    got = ordered.ordered_dedupe(df, ["k"], ["i"], ["o"], F.col("m").isNotNull())
    assert rows(got.select("i", "place.o", "m")) == {("x", 0, "m"), ("y", 1, None)}


def test_merge_is_ordered_and_idempotent(spark):
    old = spark.createDataFrame([("k", "a", 0), ("k", "b", 1)], "key string, v string, o int")
    new = spark.createDataFrame([("k", "c", 0), ("k", "a", 1), ("k", "c", 2), ("n", "z", 0)], "key string, v string, o int")
    merged = ordered.ordered_merge(old, new, ["key"], ["v"], ["o"])
    assert rows(merged.select("key", "v", "ord", "is_new")) == {("k", "a", 0, False), ("k", "b", 1, False), ("k", "c", 2, True), ("n", "z", 0, True)}
    again = ordered.ordered_merge(merged.select("key", "v", F.col("ord").alias("o")), new, ["key"], ["v"], ["o"])
    assert again.where("is_new").count() == 0
    stats = ordered.merge_stats(merged.withColumn("w", F.lit("w1")), new.withColumn("w", F.lit("w1")), ["key"], "w")
    assert rows(stats) == {("w1", 4, 2, 1)}


def test_every_title_has_its_natural_place(spark, tmp_path):
    from tantu.plans import corpus

    titles = [(f"w{i % 7}", f"{'Book' if i % 2 else 'book'} {i * 37 % 450}") for i in range(450)] + [("w0", None), (None, "Book 1")]
    spark.createDataFrame(titles * 2, "work_id string, title string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.work_id, r.title): r.place for r in corpus.QUERIES["natural_titles"](spark, str(tmp_path)).collect()}
    want = sorted(titles[:450], key=lambda x: int(x[1].split()[1]))
    assert got == {x: k for k, x in enumerate(want, 1)}


def forms(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "form string")


def test_surface_index_tiers(spark):
    table = spark.createDataFrame([("darma",), ("sita",), ("yoga",), ("darmakze",)], "key string")
    got = lookup.surface_index(forms(spark, "धर्म", "rāma-sītā", "yogena", "धर्मक्षेत्रे", "।", "", None, "xyz", "धर्म"), table)
    assert rows(got) == {("धर्म", "darma", "exact"), ("rāma-sītā", "sita", "member"), ("धर्मक्षेत्रे", "darmakze", "prefix")}


def test_scoped_keys_miss_is_final_only_with_a_slice(spark):
    by_work = spark.createDataFrame([("w1", "a", "ka")], "work_id string, form string, key string")
    overall = spark.createDataFrame([("a", "xa"), ("b", "xb")], "form string, key string")
    asked = spark.createDataFrame([("w1", "a"), ("w1", "b"), ("w2", "a"), ("w2", "c")], "work_id string, form string")
    assert rows(lookup.scoped_keys(asked, by_work, overall)) == {("w1", "a", "ka"), ("w2", "a", "xa")}
    assert rows(lookup.member_keys(asked, by_work, overall)) == {("w1", "a", "ka"), ("w1", "b", "xb"), ("w2", "a", "xa")}


def test_only_trusted_keys_give_analyses(spark):
    morph = spark.createDataFrame([("darma", 0, "धर्म"), ("darma", 1, "धर्मन्"), ("yoga", 0, "योग")], "slp_key string, ord_no int, l string").selectExpr("*", "'noun' as p", "'पुं' as f", "cast(null as string) as g", "cast(null as string) as x", "cast(null as array<string>) as m")
    index = spark.createDataFrame([("धर्म", "darma"), ("धर्मेण", "darma"), ("yoga", "zzz")], "form string, key string")
    got = lookup.analyses(forms(spark, "धर्म", "धर्मेण", "yoga"), index, morph)
    assert rows(got.select("form", "ord_no", "l")) == {("धर्म", 0, "धर्म"), ("धर्म", 1, "धर्मन्"), ("yoga", 0, "योग")}


def test_glosses_take_the_first_key(spark):
    table = spark.createDataFrame([("darma", "धर्म", "law"), ("avasta", "अवस्था", ""), ("dfs", "दृश्", "see")], "key string, u string, g string")
    lemmas = spark.createDataFrame([("धर्म",), ("दृश्1",), ("अवस्था",), ("none",), (None,)], "lemma string")
    assert rows(lookup.glosses(lemmas, table).select("lemma", "key")) == {("धर्म", "darma"), ("दृश्1", "dfs"), ("अवस्था", "avasta")}
    assert rows(lookup.glosses(lemmas, table, filled=True).select("lemma", "key")) == {("धर्म", "darma"), ("दृश्1", "dfs")}


def test_coverage_counts_occurrences(spark):
    tokens = spark.createDataFrame([("w", "धर्म"), ("w", "धर्म"), ("w", "x-yoga"), ("w", "।"), ("w", "zzz")], "work_id string, form string")
    keys = spark.createDataFrame([("darma",), ("yoga",)], "key string")
    index = spark.createDataFrame([("धर्म",)], "form string")
    r = lookup.coverage(tokens, index, keys).first()
    assert (r.words, r.loose_hits, r.strict_hits, r.loose_pct, r.strict_pct) == (4, 2, 3, 50.0, 75.0)


PARSES = "form string, ord_no int, l string, p string, f string, g string, x string"


def test_ranking_prefers_accusatives_and_near_lemmas(spark):
    parses = spark.createDataFrame(
        [("श्रुतम्", 0, "स्रु", "noun", "नपुं;1;एक", None, None), ("श्रुतम्", 1, "श्रुत", "part", "लट्;नपुं;1;एक", None, None), ("श्रुतम्", 2, "श्रुत", "part", "लट्;नपुं;2;एक", None, None), ("च", 0, "च", "indecl", "", None, None), ("च", 1, "क", "noun", "", None, None), ("च", 2, "च", "indecl", None, None, None)], PARSES
    )
    freq = spark.createDataFrame([("x", 1)], "lemma string, n long")
    got = ranking.ranked_groups(parses, ["form"], freq)
    shown = {(r.form, r["rank"]): (r.lemma, r.cls, r.score, tuple(r.summary), r.n) for r in got.collect()}
    assert shown["श्रुतम्", 1] == ("श्रुत", "part", 42.0 + 34.0, ("pres.", "n.", "sg.", "acc."), 1)
    assert shown["श्रुतम्", 2][0] == "स्रु" and shown["श्रुतम्", 2][2] == -90.0
    assert shown["च", 1] == ("च", "indecl", 35.0, (), 3) and ("च", 2) not in shown
    top = {r.form: (r.l, r.hidden) for r in ranking.top_parses(got, ["form"]).collect()}
    assert top == {"श्रुतम्": ("श्रुत", 1), "च": ("च", 0)}


def test_score_terms(spark):
    def score(form, l, p="noun", f="", x=None, g=None, n=0, prose=False):  # noqa: E741
        cols = [F.lit(v).cast("string") for v in (form, l, p, f, x, g)]
        return spark.range(1).select(ranking.parse_score(*cols, F.lit(n), prose).alias("s")).first().s

    assert score("राम", "राम", n=3) == 10 * math.log2(4)
    assert score("तु", "तु", "indecl") == 35 and score("तु", "अन्य", "indecl") == 0
    assert score("राम", "अन्य", g="N. of a king") == -15 and score("राम", "राम", g="N. of a king") == 0
    assert score("राम", "राम", f="पुं;(inferred)") == -30 and score("राम", "राम", p="stem") == -30
    assert score("रामम्", "राम", f="पुं;2;एक") == 42 and score("राम", "राम", f="पुं;2;एक") == 0
    assert score("राम", "राम", x="epic|stem", prose=True) == -5


def test_displayed_twins_collapse(spark):
    parses = spark.createDataFrame([("k", 0, "l", "noun", "पुं;1", "g", None), ("k", 1, "l", "noun", "पुं 1", "g", [("d",)]), ("k", 2, "l", "noun", "पुं;2", "g", None)], "slp_key string, ord_no int, l string, p string, f string, g string, m array<struct<d:string>>").withColumn("x", F.lit(None).cast("string"))
    got = ranking.dedupe_parses(parses, ["slp_key"])
    assert rows(got.select("place", "f", F.col("m").isNotNull())) == {(0, "पुं 1", True), (2, "पुं;2", False)}


def test_unique_refs(spark):
    df = spark.createDataFrame([("w", "1.2", i) for i in range(30)] + [("w", "1.3", 0)], "w string, ref string, i int")
    got = {r.i: r.dom_ref for r in reading.unique_refs(df, ["w"], ["i"]).where("ref = '1.2'").collect()}
    assert [got[i] for i in (0, 1, 2, 26, 27)] == ["1.2", "1.2a", "1.2b", "1.2z", "1.227"]


def test_paired_once(spark):
    left = spark.createDataFrame([("f", "1", 0), ("f", "1", 1), ("f", "2", 2), ("f", None, 3)], "f string, ref string, pos int")
    right = spark.createDataFrame([("f", "1", 0), ("f", "3", 1), ("f", "2", 2), ("f", "9", 5)], "f string, ref string, pos int")
    assert rows(reading.paired_once(left, right, ["f"])) == {("f", 0, 0, "ref"), ("f", 2, 2, "ref"), ("f", 1, 1, "pos"), ("f", 3, None, "left"), ("f", None, 5, "right")}


def test_occurrence_gate(spark):
    parse = lambda s="dcs", c=1.0: {"l": "x", "source": s, "confidence": c}
    schema = "work_id string, source string, edition string, refs map<string,string>, occurrence map<string,map<string,array<struct<l:string,source:string,confidence:double>>>>"
    occ = {"1.1": {"0": [parse()], "1": [parse(), parse(c=0.9)], "2": [], "3": [parse("other")], "4": [parse(c=None)]}}
    data = [("a", "dcs", "source-locked", {"1.1": "f"}, occ), ("b", "other", "source-locked", {"1.1": "f"}, occ), ("c", "dcs", None, {"1.1": "f"}, occ), ("d", "dcs", "source-locked", None, occ), ("e", "dcs", "source-locked", {}, None)]
    assert rows(reading.occurrence_parses(spark.createDataFrame(data, schema)).select("work_id", "ref", "token_index")) == {("a", "1.1", 0)}


def test_search_variants(spark):
    tokens = spark.createDataFrame([("w1", "1.1", "rāmaḥ", 0), ("w2", "2.1", "rāmaḥ", 1), ("w2", "1.9", "सीता", 0)], "work_id string, ref string, form string, i int")
    posted = search.postings(tokens, ["i"])
    works = spark.createDataFrame([("w1", "One")], "work_id string, title string")
    queries = spark.createDataFrame([("राम",), ("sītā",), ("rāmaḥ",), ("r",), ("9x",)], "query string")
    got = search.word_search(queries, posted, works)
    assert rows(got.select("query", "term", "variant", "n_works", "total", "work_id")) == {("राम", "ramah", 1, 2, 2, "w1"), ("rāmaḥ", "ramah", 0, 2, 2, "w1")}
    assert rows(search.inverted_index(posted).select("term", "total")) == {("ramah", 2), ("sita", 1)}


def test_stores(spark):
    log = spark.createDataFrame([("a", "add", 1, "x"), ("a", "remove", 3, "x"), ("b", "add", 2, "y"), ("b", "add", 2, "z")], "k string, action string, ts int, v string")
    assert rows(stores.current(log, ["k"])) == {("b", "add", 2, "z")}
    assert rows(stores.toggled(log.select("k", "ts").union(log.where("k = 'a'").select("k", "ts").limit(1)), ["k"]).select("k")) == {("a",)}
    store = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    more = spark.createDataFrame([("b", 9), ("c", 3), ("c", 4)], "k string, v int")
    assert rows(stores.imported(store, more, ["k"], True)) == {("a", 1, False), ("b", 9, False), ("c", 3, True)}
    assert rows(stores.imported(store, more, ["k"], False)) == {("a", 1, False), ("b", 2, False), ("c", 3, True)}
    texts = spark.createDataFrame([('{"v": 1, "known": {"x": {"lemma": "l", "ts": 5}}}',), ("broken",)], "json string")
    assert [r.v for r in stores.read_store(texts, "v int, known map<string, struct<lemma: string, ts: bigint>>").collect()] == [1, None]
    prefs = spark.createDataFrame([(False, False, None), (None, None, "iast"), (None, None, None)], "deva boolean, iast boolean, legacy string")
    assert [(r.deva, r.iast) for r in stores.preferences(prefs).collect()] == [(True, False), (False, True), (True, True)]
    assert rows(stores.with_titles(store.withColumnRenamed("k", "work_id"), spark.createDataFrame([("a", "T")], "work_id string, title string")).select("work_id", "title")) == {("a", "T"), ("b", "b")}


def test_edition_and_fallbacks(spark):
    schema = "row_id long, work_id string, chpatno string, slokano string, poem string, word string, sandhied_word string, morph_analysis string, morph_in_context string, english_meaning string"
    data = [(1, "w", "1", "2", "2", "b", "b", "b{अव्य}", "b{अव्य}", "x_y"), (2, "w", "1", "2.0", "1", "a", "a", "a{पुं}{1;एक}", "a{पुं}{1;एक}", None), (3, "w", "1", "2", "x", "c", "c", None, "c{अव्य}", None), (4, "w", "1", "3", "1", "d", "d", "d{अव्य}/e{अव्य}", "d{अव्य}/e{अव्य}", None), (5, "w", None, "3", "1", "", None, None, None, None)]
    df = spark.createDataFrame(data, schema)
    placed, omitted = build.occurrence_rows(df)
    assert rows(placed.select("ref", "token_index", "word", "l", "g")) == {("1.2", 0, "a", "a", None), ("1.2", 1, "b", "b", "x y")}
    assert rows(omitted.select("row_id")) == {(3,), (4,), (5,)}
    assert rows(build.edition_report(placed, omitted)) == {("w", 2, 2, 100.0, 3)}
    shards = build.morph_shards(build.analysis_entries(df))
    assert rows(shards.select("key", "ord", "l", "p", "f")) == {("b", 0, "b", "indecl", ""), ("a", 0, "a", "noun", "पुं;1;एक"), ("d", 0, "d", "indecl", ""), ("d", 1, "e", "indecl", "")}
    more = spark.createDataFrame([("yog", "x")], "key string, l string")
    base = shards.unionByName(spark.createDataFrame([("y", "yoge", 0, "योग", "noun", "पुं")], "letter string, key string, ord int, l string, p string, f string"))
    full = build.with_fallbacks(base, spark.createDataFrame([("yogena",), ("yogaxyz",), ("a",), ("zzz",)], "key string"), more.select("key"))
    assert rows(full.where("key like 'yoge%' or key like 'yoga%'").select("key", "l", "p", "f")) == {("yoge", "योग", "noun", "पुं"), ("yogena", "योग", "noun", "पुं;(inferred)"), ("yogaxyz", "योग्", "stem", "(inferred)")}


def test_occurrences_of_both_versions(spark):
    import json

    sure = {"l": "a", "source": "dcs", "confidence": 1.0}
    raw = {"1.1": {"0": sure, "1": [sure, {**sure, "confidence": 0.9}], "2": [sure, {**sure, "l": "b"}], "3": None, "4": [], "x": [sure]}}
    parse = "array<struct<l:string,p:string,f:string,g:string,r:string,source:string,confidence:double,m:array<struct<d:string,l:string,p:string,f:string>>>>"
    schema = f"shard_id long, work_id string, source string, edition string, refs map<string,string>, occurrence map<string,map<string,{parse}>>, raw_json string"
    typed = {"2.1": {"0": [("t", None, None, None, None, "dcs", 1.0, None)]}}
    data = [(1, "w", "dcs", "source-locked", {"1.1": "f"}, None, json.dumps(raw)), (2, "w", "dcs", "source-locked", {"1.2": "f"}, None, json.dumps({"built": 1, "occurrence": {"1.2": {"0": {**sure, "r": 7}}}})),
            (3, "w", "dcs", "source-locked", {"2.1": "f"}, typed, None), (4, "w", "dcs", "other", {"9": "f"}, typed, None), (5, "w", "dcs", "source-locked", {"3": "f"}, None, "{broken")]
    df = spark.createDataFrame(data, schema)
    found = {(r.ref, r.token_index): [p.l for p in r.parses] for r in reading.occurrence_parses(df).collect()}
    assert found == {("1.1", 0): ["a"], ("1.1", 2): ["a", "b"], ("1.1", None): ["a"], ("1.2", 0): ["a"], ("2.1", 0): ["t"]}
    units = spark.createDataFrame([("w", "2.1"), ("other", "1.1")], "work_id string, ref string")
    assert [r.ref for r in reading.occurrence_parses(df, units=units).collect()] == ["2.1"]


def test_an_unknown_cluster_folder_is_an_error():
    from types import SimpleNamespace

    from tantu.session import shared_dir

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared_dir(session)
