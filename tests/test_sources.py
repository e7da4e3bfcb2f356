import json

import pytest
from tantu.sources import files
from tests.conftest import rows

SENTENCES = """# sent_id = 477
1-2\ttapaḥsvādhyāya\t_\t_\t_\t_\t_\t_\t_\t_
1\ttapaḥ\ttapas\tNOUN\t_\tCase=Cpd|Number=Sing\t_\t_\t_\tUnsandhied=tapas
2\tsvādhyāya\tsvādhyāya\tNOUN\t_\tCase=Nom|Gender=Masc|Number=Sing\t_\t_\t_\tOccId=9
2.1\tempty\tx\tNOUN\t_\t_\t_\t_\t_\t_
3\t।\t।\tPUNCT\t_\t_\t_\t_\t_\t_
4\tabhūd\tbhū\tVERB\t_\tTense=Aor|Person=3|Number=Sing\t_\t_\t_\t_

# sent_id = 478
1\tabhūd\tbhū\tVERB\t_\tTense=Aor|Person=3|Number=Sing\t_\t_\t_\t_
2\tanīñja\ta\tADJ\t_\t_\t_\t_\t_\t_
3\tmānena\tmāna\tNOUN\t_\tCase=Ins\t_\t_\t_\t_
4\t,\t,\tPUNCT\t_\t_\t_\t_\t_\t_
5\tna\tna\tPART\t_\t_\t_\t_\t_\t_
6\tx\t_\tPART\t_\t_\t_\t_\t_\t_
7\tcaiva\teva\tPART\t_\t_\t_\t_\t_\t_

1\tnosentid\ta\tNOUN\t_\t_\t_\t_\t_\t_
1-3\tbroken\t_\t_\t_\t_\t_\t_\t_\t_
"""


def annotated(spark, tmp_path, text=SENTENCES):
    (tmp_path / "w").mkdir(exist_ok=True)
    (tmp_path / "w" / "a.conllu").write_text(text, encoding="utf-8")
    return files.annotated_rows(files.annotated_lines(spark, str(tmp_path / "w" / "*.conllu")))


def test_sentences_compounds_and_spans(spark, tmp_path):
    got = annotated(spark, tmp_path)
    kinds = [r.kind for r in got.orderBy("line_no").collect()]
    assert kinds.count("token") == 10 and kinds.count("range") == 2 and kinds.count("mark") == 2 and kinds.count("empty") == 1
    entries = {(r.sent_id, r.form): r for r in files.annotated_entries(got).collect()}
    assert entries["477", "tapaḥ"].l == "तपस्" and entries["477", "tapaḥ"].keys == ["tapah", "tapas"]
    assert (entries["477", "svādhyāya"].p, entries["477", "svādhyāya"].f) == ("noun", "पुं;1;एक")
    assert entries["478", "x"].l is None
    compounds = files.compound_entries(got).collect()
    assert [(r.form, r.l, r.f, [m.d for m in r.m]) for r in compounds] == [("tapaḥsvādhyāya", "स्वाध्याय", "पुं;1;एक", ["तपस्", "स्वाध्याय"])]
    spans = {(r.form, r.n) for r in files.fused_spans(got).where("sentence = 1").collect()}
    # runs end at sentences and at tokens without a lemma, go on over marks, and never end in the negation
    assert spans == {("abhūdanīñja", 2), ("abhūdanīñjamānena", 3), ("anīñjamānena", 2)}
    fused = files.fused_spans(got).where("n = 3 and sentence = 1").first()
    assert [m.d for m in fused.m] == ["अभूद्", "अनीञ्ज", "मानेन"] and fused.l == "मान"
    allowed = spark.createDataFrame([("abudaniyjamanena",)], "key string")
    assert {r.form for r in files.gated(files.fused_spans(got), allowed).collect()} == {"abhūdanīñjamānena"}


def test_keys_of_spans_are_made_once(spark, tmp_path):
    """Above the last exchange of the plan one expression makes them, in no filter, and transliterates the form once."""
    plan = files.fused_spans(annotated(spark, tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    kept = plan.split("Repartition")[0]
    assert kept.count("regexp_extract_all(") == 1 and kept.count("(?!au|") + kept.count("(?!ai|") == 1
    assert not [line for line in kept.split("\n") if "Filter" in line and "regexp_extract_all(" in line]


def test_editions_of_sentences(spark, tmp_path):
    text = SENTENCES + "\n# sent_id = 478\n1\tdup\ta\tNOUN\t_\t_\t_\t_\t_\t_\n"
    got = files.sentence_edition(annotated(spark, tmp_path, text))
    assert rows(got.where("ref = 'dcs-477'").select("token_index", "word", "r")) == {(0, "तपः", "a.conllu:477:1"), (1, "स्वाध्याय", "9"), (2, "अभूद्", "a.conllu:477:4")}
    assert got.where("ref = 'dcs-478'").count() == 6
    assert {r.ref for r in got.select("ref").distinct().collect()} == {"dcs-477", "dcs-478"}


def write(tmp_path, name, data):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(data if isinstance(data, str) else json.dumps(data, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_catalog_and_parts(spark, tmp_path):
    work = {"id": "w", "title": "T", "files": ["f"], "unitCount": 3, "titleZh": " 題 ", "translation": {"files": ["x"]}}
    catalog = {"authors": [{"key": "a", "name": "A", "lang": "pi", "works": [work]}, {"key": "b", "name": "B", "works": [{"id": "v", "title": "V", "files": []}]}]}
    got = files.read_catalog(spark, write(tmp_path, "catalog.json", catalog))
    assert rows(got.select("author_key", "work_id", "title_zh", "lang", "unit_count", "has_translation", "has_zh", "untranslated")) == {("a", "w", "題", "pi", 3, True, False, False), ("b", "v", "", "sa", None, False, False, True)}
    part = {"id": "w", "units": [{"ref": "1.1", "words": ["a", "b"]}, {"ref": "1.2", "w": "c  d"}, {"ref": "1.3"}]}
    assert [(r.ref, r.words) for r in files.read_parts(spark, write(tmp_path, "part.json", part)).orderBy("idx").collect()] == [("1.1", ["a", "b"]), ("1.2", ["c", "d"]), ("1.3", [])]


def test_shards(spark, tmp_path):
    morph = {"rama": [{"l": "राम", "p": "noun"}, {"l": "x", "m": [{"d": "a", "l": "b"}]}], "_provenance": [{"l": "no"}]}
    got = files.read_morph_shards(spark, write(tmp_path, "morph/r.json", morph))
    assert rows(got.select("slp_key", "ord_no", "l")) == {("rama", 0, "राम"), ("rama", 1, "x")}
    gloss = files.read_gloss_shards(spark, write(tmp_path, "gloss/f.json", {"F": {"u": "ॠ", "g": "x"}, "f": {"u": "ऋ", "g": "y"}}))
    assert rows(gloss.select("exact_key", "key", "u")) == {("F", "f", "ॠ"), ("f", "f", "ऋ")}
    assert rows(files.read_surface(spark, write(tmp_path, "surface/k.json", {"क": "ka"})).select("form", "key")) == {("क", "ka")}
    occ = files.read_occurrences(spark, write(tmp_path, "occ/0.json", {"1.1": {"0": [{"l": "x", "r": 5, "confidence": 1}], "1": []}}))
    assert rows(occ.selectExpr("ref", "token_index", "size(parses)", "get(parses, 0).r")) == {("1.1", 0, 1, "5"), ("1.1", 1, 0, None)}
    meta, index = write(tmp_path, "idx/_meta.json", {"v": 1, "letters": ["f"], "works": ["w0", "w1"]}), write(tmp_path, "idx/f.json", '{"fur":[1,[[1,"1.17.8"]]],"fa":[3,[[0,"1"],[1,"2"]]]}')
    assert rows(files.read_postings(spark, meta, index)) == {("fur", 1, "w1", "1.17.8"), ("fa", 3, "w0", "1"), ("fa", 3, "w1", "2")}
    assert rows(files.read_snippets(spark, write(tmp_path, "snip.json", {"v": 1, "w": ["a"], "e": [[0, "1.1", "text"], [7, "x", "y"]]}))) == {("a", "1.1", "text"), (None, "x", "y")}
    trans = {"translator": "T", "year": 1900, "units": [{"ref": "1", "text": "t"}, {"words": ["a", "b"]}, {"ref": "2", "w": "c"}, {"ref": "3"}]}
    assert rows(files.read_translations(spark, write(tmp_path, "trans.json", trans)).select("pos", "ref", "text", "year")) == {(0, "1", "t", "1900"), (1, None, "a b", "1900"), (2, "2", "c", "1900")}


def test_dictionary_verses_and_xml(spark, tmp_path):
    dump = write(tmp_path, "mw.txt", "<L>1<k1>Rama<k2>x\n<L>2<k1>a-b<k2>\nno\n<L>3<k1>yoga\n")
    assert rows(files.read_headword_keys(spark, dump)) == {("rama",), ("yoga",)}
    verses = write(tmp_path, "sloka.json", [{"spart1": "धर्म क्षेत्रे ।", "spart2": "(राम) ॥1॥"}, {"spart1": None}])
    assert rows(files.read_slokas(spark, verses)) == {("धर्म",), ("क्षेत्रे",), ("राम",)}
    xml = '<r:RDF xmlns:r="u"><m:entry><dict><hdwd xml:lang="x">a,lemma</hdwd></dict><m:infl><pofs>participle</pofs><tense>present</tense><voice>middle/passive</voice><case>nominative</case><dialect>epic</dialect><stemtype>s1</stemtype><stemtype>s2</stemtype></m:infl></m:entry></r:RDF>'
    got = files.read_xml_analyses(spark.createDataFrame([(xml,), ("<broken",), (None,)], "xml string"))
    assert rows(got.select("l", "p", "f", "x")) == {("lemma", "P", "pres part mid/pass nom", "epic|s1,s2")}


def test_sinks(spark, tmp_path):
    shards = spark.createDataFrame([("a", "ab", "x"), ("~", "~b", "y"), ("b", "ba", "z")], "letter string, key string, l string")
    files.write_morph(shards, str(tmp_path / "m"))
    assert rows(spark.read.parquet(str(tmp_path / "m")).select("letter", "key")) == {("a", "ab"), ("b", "ba")}
    coverage = spark.createDataFrame([("w", 4, 2, 3, 50.0, 75.0)], "work_id string, words long, loose_hits long, strict_hits long, loose_pct double, strict_pct double")
    files.write_resolution(coverage, str(tmp_path / "c"))
    assert [r.value for r in spark.read.text(str(tmp_path / "c")).collect()] == ["work_id|loose_pct|strict_pct|hits", "w|50.0|75.0|2/4"]
    report = spark.createDataFrame([("w", 1)], "work string, n int")
    files.write_report(report, str(tmp_path / "r"))
    files.write_report(report, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2


def test_xml_entities_cdata_and_depth(spark):
    xml = "<a><b><c><entry><dict><hdwd>x&amp;y</hdwd></dict><infl><pofs>noun</pofs><stemtype><![CDATA[s<1>]]></stemtype></infl><infl><pofs>verb</pofs></infl></entry></c></b><entry><dict><hdwd>z</hdwd></dict></entry></a>"
    got = files.read_xml_analyses(spark.createDataFrame([(xml,)], "xml string")).orderBy("infl").collect()
    assert [(r.entry, r.infl, r.l, r.p, r.x) for r in got] == [(0, 0, "x&y", "N", "s<1>"), (0, 1, "x&y", "V", "")]


def test_edition_files_and_their_index(spark, tmp_path):
    rows_ = [("w", "1.1", 0, "a", "la", "noun", "1", "g"), ("w", "1.1", 1, "b", "lb", "verb", None, None), ("w", "2.1", 0, "c", None, "noun", "", "x")]
    files.write_edition(spark.createDataFrame(rows_, "work_id string, ref string, token_index int, word string, l string, p string, f string, g string"), f"{tmp_path}/e")
    back = {(r.ref, r.token_index): r.parses for r in files.read_occurrences(spark, f"{tmp_path}/e/shards/*/*/*").collect()}
    assert set(back) == {("1.1", 0), ("1.1", 1), ("2.1", 0)} and back["1.1", 0][0].l == "la" and back["1.1", 1][0].confidence == 1.0
    index = spark.read.json(f"{tmp_path}/e/index").select("source", "edition", "refs.*").first()
    assert (index.source, index.edition, index["1.1"], index["2.1"]) == ("dcs", "source-locked", "chapter=1", "chapter=2")
    units = files.read_parts(spark, f"{tmp_path}/e/text/*/*")
    assert {(r.ref, tuple(r.words)) for r in units.collect()} == {("1.1", ("a", "b")), ("2.1", ("c",))}


def test_files_of_several_roots_in_their_order(spark, tmp_path):
    for name in ("b/x/2.txt", "b/x/1.txt", "a/y/3.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("t")
    found = files.ordered_files(spark, [f"{tmp_path}/b", f"{tmp_path}/a"], "*/*.txt", least=3)
    assert [f[-7:] for f in found] == ["x/1.txt", "x/2.txt", "y/3.txt"]
    with pytest.raises(FileNotFoundError):
        files.ordered_files(spark, [f"{tmp_path}/none"], "*")
    with pytest.raises(ValueError):
        files.ordered_files(spark, [f"{tmp_path}/a"], "*/*", least=2)
