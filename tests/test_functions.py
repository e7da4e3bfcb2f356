import itertools
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tantu.functions import feats, gloss, keys, misc, scripts, translit

# Devanagari, IAST, Harvard-Kyoto, SLP1
SCRIPTS = [("भगवद्गीता", "bhagavadgītā", "bhagavadgItA", "BagavadgItA"), ("संस्कृतम्", "saṃskṛtam", "saMskRitam", "saMskftam"), ("ऋषिः", "ṛṣiḥ", "RRiShiH", "fziH"), ("शास्त्र", "śāstra", "zAstra", "SAstra"), ("न्याय", "nyāya", "nyAya", "nyAya"), ("कार्ष्णि", "kārṣṇi", "kArShNi", "kArzRi")]
ROUND = [("dharma", "धर्म"), ("yoga", "योग"), ("kṛṣṇa", "कृष्ण"), ("jñāna", "ज्ञान"), ("aṅka", "अङ्क"), ("saṃnyāsa", "संन्यास")]
SPECIAL = ["सं", "रामः", "तेऽपि", "डँ", "लृ", "क्ष", "ऐरावत", "औषध", "ईश", "ऊह"]


def one(spark, values, expression, schema="x string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema)
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_known_transliterations(spark):
    deva, iast, hk, slp1 = zip(*SCRIPTS)
    for source, column in zip(("deva", "iast", "hk", "slp1"), (deva, iast, hk, slp1)):
        for target, want in zip(("deva", "iast", "hk", "slp1"), (deva, iast, hk, slp1)):
            assert tuple(one(spark, column, lambda x: translit.transliterate(x, source, target))) == want, (source, target)


def test_round_trips_through_every_order_of_scripts(spark):
    iast, deva = zip(*ROUND)
    assert tuple(one(spark, deva, translit.dev_to_iast)) == iast
    for order in itertools.permutations(("iast", "hk", "slp1")):

        def chain(x, order=order):
            at = "deva"
            for to in (*order, "deva"):
                x, at = translit.transliterate(x, at, to), to
            return x

        assert tuple(one(spark, deva, chain)) == deva, order


def test_signs_survive(spark):
    for scheme in ("iast", "slp1", "hk"):
        assert one(spark, SPECIAL, lambda x: translit.transliterate(translit.transliterate(x, "deva", scheme), scheme, "deva")) == SPECIAL, scheme


def test_keys_meet_across_scripts(spark):
    assert len(set(one(spark, ["भगवद्गीता", "bhagavadgītā", "BagavadgItA"], translit.slp1_key))) == 1
    assert one(spark, ["वै", "vai", "dharmakṣetre"], translit.slp1_key) == ["ve", "vai", "darmakzetre"]
    assert one(spark, ["वै", "vai", "'pi", "तेऽपि"], keys.canonical_keys) == [["ve", "vai"], ["vai", "ve"], ["pi"], ["tepi"]]
    assert one(spark, ["राम", "rāma", "Rama", "rama!"], translit.norm_sa) == ["rama"] * 4


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="कखगञटणतथशषसहािीुूृेैोौ्ंःअआइउएऐओऔऽ ‌‍a1।", max_size=12), min_size=20, max_size=20))
def test_columns_agree_with_the_plain_functions(words):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    assert one(spark, words, translit.dev_to_iast) == [scripts.dev_to_iast(w) for w in words]


def test_strip_accents(spark):
    assert one(spark, ["Ṛṣi", "é́", "ὁδός", "राम", None, "ß"], translit.strip_accents) == ["rsi", "e", "οδοσ", "राम", None, "ß"]


def test_dict_keys_order(spark):
    assert one(spark, ["दृश्1", "(च", "अवस्थातुम्", "रामः", "", None], lambda x: F.slice(keys.dict_keys(x), 1, 2)) == [["dfs", "dfsa"], ["ca"], ["avastatum", "avastatuma"], ["ramah", "rama"], [], []]
    assert one(spark, ["mokṣa"], keys.dict_keys)[0][:2] == ["mokza", "moksa"]


def test_form_and_row_keys(spark):
    assert one(spark, ["a-b", "(rāma); sītā", "“x”", None], keys.variant_keys) == [["a", "b"], ["rama", "sita"], ["x"], None]
    assert one(spark, ["rāma-sītā"], keys.form_keys)[0] == ["rama", "sita"]
    assert one(spark, ["क", "ऽक", "x1क", "abc", "", "ॐ"], keys.initial_slice) == ["k", "z", "k", None, None, "om"]


def test_parse_analysis(spark):
    got = one(spark, ["भूयः{अव्य}/भूयस्{नपुं}{1;एक}", "गम्{प्रथम}{एक;लट्}", "x", "a{b", "", None, "y{q}{r} / {z}"], feats.parse_analysis)
    assert [[tuple(e) for e in r] for r in got] == [[("भूयः", "indecl", ""), ("भूयस्", "noun", "नपुं;1;एक")], [("गम्", "verb", "प्रथम;एक;लट्")], [("x", "", "")], [], [], [], [("y", "part", "q;r")]]


def test_feature_mapping(spark):
    def mapped(upos, field):
        parsed = feats.parse_feats(F.lit(field))
        row = spark.range(1).select(feats.map_pos(F.lit(upos), parsed).alias("p"), feats.map_feats(F.lit(upos), parsed).alias("f")).first()
        return row.p, row.f

    assert mapped("NOUN", "Case=Nom|Gender=Masc|Number=Sing") == ("noun", "पुं;1;एक")
    assert mapped("VERB", "Tense=Pres|Mood=Ind|Person=3|Number=Plur|Voice=Act") == ("verb", "लट्;प्रथम;बहु;परस्मैपद")
    assert mapped("VERB", "VerbForm=Part|Tense=Fut|Case=Acc|Gender=Neut|Number=Dual") == ("part", "लृट्;नपुं;2;द्वि")
    assert mapped("VERB", "VerbForm=Conv") == ("indecl", "Conv")
    assert mapped("ADV", "_") == ("indecl", "")
    assert mapped("NOUN", "Case=Cpd|Number=Odd|Type=X|Loose") == ("noun", "Cpd;Odd;X")
    assert mapped("VERB", "Tense=Past|Mood=Ind|Formation=s") == ("verb", "s")
    assert mapped("PRON", "Case=Voc") == ("part", "सम्बोधन")


def test_compact_features_and_slots(spark):
    got = one(spark, ["पुं;1;एक", "लट्;उत्तम;एक;परस्मैपद", "लट्;लङ्;पुं;8;Cpd", "", None], feats.compact_feats)
    assert [(r["main"], r["extras"]) for r in got] == [(["m.", "sg.", "nom."], []), (["pres.", "1st", "sg.", "act."], []), (["impf.", "m.", "8"], ["Cpd"]), ([], []), ([], [])]
    assert one(spark, ["पुं;1;एक;पुं", "8", ""], feats.feat_slots)[0].gender == ["m."]
    assert one(spark, ["पुं;8", "Cpd", "एक"], feats.has_slots) == [True, False, True]


def test_samasa(spark):
    member = lambda f, p="noun": ("d", "l", p, f)
    cases = [([member("Cpd"), member("पुं;1;एक")], True), ([member("Cpd")], False), ([member("पुं"), member("पुं;1")], False), ([member("Cpd"), member("पुं;1", "verb")], False), ([member("x;Cpd"), member("एक")], False), (None, False), ([], False), ([member("Cpd")] * 8 + [member("1")], False)]
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(cases)], "i int, m array<struct<d:string,l:string,p:string,f:string>>")
    assert [r.y for r in df.select("i", feats.is_samasa(F.col("m")).alias("y")).orderBy("i").collect()] == [w for _, w in cases]


def test_glosses(spark):
    cases = {"m. a large drum; see RV. 1,2": "a large drum", "<b>x</b> [n] the sea. Then more": "x the sea", "रथ chariot q.v. rest": "chariot q.v", "a cart and so on, more; x": "a cart", "see m.pl. loud R. 12 Rice, gen. 3": "loud Rice", "12": None, "": None, "f. river, MBh. 3": "river", "N. of a king": "of a king"}
    assert one(spark, list(cases), gloss.compact_gloss) == list(cases.values())
    long = "word " * 40
    assert one(spark, [long], gloss.compact_gloss)[0] == ("word " * 17).strip() + "…"
    assert one(spark, ["m. N. of a man", "as, m. Name. of x", "a N. of", None, "n. of x", "m N. of x", "N. offers"], gloss.is_name_gloss) == [True, True, False, False, True, False, False]
    row = spark.createDataFrame([("noun", "x;PROPN", None), (" Name", "", None), ("noun", "Namely", "m N. of x"), ("noun", "namely", "x"), (None, None, None)], "p string, f string, g string")
    assert [r[0] for r in row.select(gloss.is_name_parse(F.col("p"), F.col("f"), F.col("g"))).collect()] == [True, True, True, False, False]
    assert one(spark, ["ab", "a b c", None, "q1w2e"], gloss.is_useful_gloss) == [False, True, False, True]
    assert one(spark, ["One sentence here. And more text that goes on and on", "short"], lambda x: gloss.clip_gloss(x, 30)) == ["One sentence here.", "short"]


def test_snippets(spark):
    text = "a" * 100 + "needle" + "b" * 100
    got = one(spark, [text, "needle", "none"], lambda x: gloss.snippet(x, F.lit("needle")))
    assert got == ["…" + "a" * 55 + "needle" + "b" * 65 + "…", "needle", None]


def test_affinities_and_colours(spark):
    df = spark.createDataFrame([("abcd", "abx"), ("", "a"), ("a", ""), ("xyz", "yz")], "a string, b string")
    got = df.select(misc.common_prefix(F.col("a"), F.col("b")).alias("p"), misc.common_suffix(F.col("a"), F.col("b")).alias("s"), misc.affinity(F.col("a"), F.col("b")).alias("r")).collect()
    assert [tuple(r) for r in got] == [(2, 0, 0.5), (0, 0, 1.0), (0, 0, 1.0), (0, 2, 0.0)]

    def color(s):
        h = 0
        for c in s:
            h = (h * 31 + ord(c)) % 2**32
        return h % 10

    names = ["", "a", "Socrates", "āśrama", "कृष्ण" * 9]
    assert one(spark, names, misc.hash_color) == [color(n) for n in names]


def test_times_credits_routes(spark):
    said = one(spark, [0.2, 59.4, 59.5, 89.0, 90.0, 3600.0, 86400.0 * 3], misc.rel_time, "x double")
    assert said == ["1s ago", "59s ago", "1m ago", "1m ago", "2m ago", "1h ago", "3d ago"]
    df = spark.createDataFrame([("A. B.", "1924", "PD"), (None, "1769", "PD"), ("A", None, None), (None, None, None), ("A", "", "")], "t string, y string, l string")
    assert [r[0] for r in df.select(misc.credit_line(F.col("t"), F.col("y"), F.col("l"))).collect()] == ["Trans. A. B. 1924 · PD", "1769 · PD", "Trans. A", "", "Trans. A"]
    routes = one(spark, ["", "#/about", "#/gita?ref=1.2", "#/vyasa/gita", "pali/dn", "#/pali"], misc.parse_route)
    assert [tuple(r) for r in routes] == [("home", None, None, None), ("about", None, None, None), ("work", None, "gita", "1.2"), ("work", "vyasa", "gita", None), ("pali", None, "dn", None), ("pali", None, None, None)]


def test_speakers(spark):
    assert one(spark, ["Socrates: hm", "Ion replied, yes", "He said: no", "Then Crito spoke", "the Ion: x", None, "And said: go", "Which replied: no", "soc. yes", "Cri: no", "Wise Ion: x", "King then inquired what", "IOn said"], misc.english_speaker) == ["Socrates", "Ion", None, None, None, None, None, None, "Socrates", "Cri", "Wise Ion", "King Then", None]


def test_beta_code_round_trip(spark):
    import unicodedata

    words = ["λόγος", "Ἀχιλλεύς", "μῆνις", "ᾠδή", "σοφός", "Ὅμηρος"]
    nfd = [unicodedata.normalize("NFD", w) for w in words]
    beta = one(spark, nfd, misc.to_beta)
    assert beta[:3] == ["lo/gos", "*)axilleu/s", "mh=nis"]
    back = one(spark, beta, misc.from_beta)
    assert [unicodedata.normalize("NFC", b) for b in back] == words


def test_small_maps(spark):
    assert one(spark, ["noun", "Verb ", "weird", "participle"], misc.pos_code) == ["N", "V", "W", "P"]
    assert one(spark, ["nominative/vocative", "dual", "x"], misc.feature_abbr) == ["nom/voc", "dual", "x"]
    assert one(spark, ["Book 10", "Book 9", "a1b22"], misc.natural_key)[1] < one(spark, ["Book 10"], misc.natural_key)[0]
    assert one(spark, ["epic ionic|stem", None, "|x"], misc.dialect_tags) == [["epic", "ionic"], [], []]


@pytest.mark.parametrize("n", [0, 3])
def test_frequency_term(n):
    assert math.isclose(10 * math.log2(1 + n), {0: 0.0, 3: 20.0}[n])


def test_labels_segments_runs_and_layers(spark):
    assert one(spark, ["Atman", "कxY", "", None], misc.roman_initial) == ["a", "x", None, None]
    assert one(spark, ["noun", "x"], misc.pos_label) == ["noun", "other"]
    assert one(spark, ["a;b · c d", "", None], misc.feature_segments) == [[["a", "b"], ["c", "d"]], [], []]
    names = F.array(F.lit("ion"), F.lit("crito"))
    assert one(spark, [["Ion", "CRITO.", "Ion"], ["ion"], ["Ion", "says"], ["He", "Ion"], []], lambda w: misc.speaker_run(w, names), "x array<string>") == [2, 0, 1, 0, 0]
    assert one(spark, ["zh", None, "odd"], lambda s: misc.default_layer(s, F.lit(False), F.lit(True))) == ["zh", "zh", "zh"]
    got = one(spark, ["N. of a king; x"], lambda g: gloss.view_model(F.lit("l"), F.lit("noun"), F.lit(None).cast("string"), g))[0]
    assert (got.lemma, got.features, got.sense, got.is_name) == ("l", "", "of a king", True)
