import random
import unicodedata

from pyspark.sql import functions as F

from tantu.functions.lookalike import IGNORABLE, LETTERS, SEQUENCES, SUSPECT, consistent, free_letters, skeleton
from tantu.llm import lookalikes
from tests.conftest import rows

HEAD = "head_id long, u string, iast string, g string, spelling string"
VAL = "src string, row_id long, pos int, val string, head_id string, cost string"
WORDS = [(1, "आलीदीरु", "ālīdīru"), (2, "क्षान्नु", "kṣānnu"), (3, "ओभेद्याटा", "obhedyāṭā"), (4, "सदः", "sadaḥ"), (5, None, "cipam"), (6, "", "")]


def headwords(spark, words=WORDS):
    return spark.createDataFrame([(*w, "g", "clash") for w in words], HEAD)


def values(spark, texts):
    return spark.createDataFrame([("s", i, 0, t, "clash", "clash") for i, t in enumerate(texts)], VAL)


def disguise(rng, word):
    """The word in other characters that look the same."""
    kind = rng.randrange(5)
    if kind == 0:
        at = rng.randrange(1, len(word))
        return word[:at] + rng.choice(IGNORABLE) + word[at:]
    if kind == 1:
        return unicodedata.normalize("NFD", word)
    if kind == 2:
        back = {v: k for k, v in LETTERS.items()}
        return "".join(back.get(c, c) for c in word)
    if kind == 3:
        return "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in word)
    for letter, shown in SEQUENCES.items():
        word = word.replace(letter, shown)
    return word + " "


def test_disguised_words_are_found_and_others_are_not(spark):
    rng = random.Random(5)
    texts = [disguise(rng, rng.choice([w for _, *two in WORDS for w in two if w])) for _ in range(300)]
    texts += ["Ālīdīru", "alidiru", "ālīdīrus", "āl", "क्षान्न", "obhedyata", "x", "आलीदीरु", "cipam"]
    spelled = {s: h for h, *two in WORDS for s in two if s}
    looks = {skeleton(s): h for s, h in spelled.items()}
    want = {("s", i, 0, looks[skeleton(t)]) for i, t in enumerate(texts) if skeleton(t) in looks and t not in spelled}
    found = lookalikes.canonical(values(spark, texts), headwords(spark))
    assert rows(found.select("src", "row_id", "pos", "head_id")) == want and len(want) > 200
    # a dictionary too large for the trie is joined, with the same result
    joined = lookalikes.canonical(values(spark, texts), headwords(spark), limit=3)
    assert rows(joined.select("src", "row_id", "pos", "head_id")) == want


def test_what_is_not_suspect_is_consistent():
    import re

    rng = random.Random(6)
    for _ in range(2000):
        word = disguise(rng, rng.choice(["ālīdīru", "ओभेद्याटा", "सदः", "cipam"]))
        if not re.search(JAVA(SUSPECT), word):
            assert consistent(word) == word
        assert skeleton(consistent(word)) == skeleton(word)


def test_every_character_that_changes_is_suspect():
    """Over all code points of the blocks: what skeletons or consistent forms change is looked up."""
    import re

    for start, stop in ((0x0, 0x3000), (0xA640, 0xABC0), (0xFB00, 0xFB50), (0xFF00, 0xFFF0), (0x1D400, 0x1D800)):
        for code in range(start, stop):
            for text in (f"a{chr(code)}b", f"क{chr(code)}ा"):
                even = consistent(text)
                if even != text or chr(code) in LETTERS:
                    assert re.search(JAVA(SUSPECT), text), hex(code)
                assert "".join(free_letters(text)) == skeleton(text), hex(code)


def JAVA(pattern):
    """A pattern of Java's dialect for Python: \\x{..} as the character itself."""
    import re

    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern)


def test_nuktas_styles_and_ligatures():
    import re

    trie = lookalikes.build_trie([("क\u093cाम", 1), ("ﬁn".replace("ﬁ", "fi"), 2), ("abc", 3), ("ओम", 4), ("\u0929ी", 5)])
    for token, ident in (("\u0958ाम", 1), ("ﬁn", 2), ("𝐚𝒃𝘤", 3), ("ａｂс", 3), ("अाेम", 4), ("आेम", 4), ("न\u093cी", 5), ("a\u200bb\ufeffc ", 3)):
        assert re.search(JAVA(SUSPECT), token) and lookalikes.walk(trie, token) == (0.0, [(next(w for w, i in [("क\u093cाम", 1), ("fin", 2), ("abc", 3), ("ओम", 4), ("\u0929ी", 5)] if i == ident), ident)]), token
    assert lookalikes.walk(lookalikes.build_trie([("ṛ́", 1)]), "r\u0301\u200b\u0323") == (0.0, [("ṛ́", 1)])


def test_a_large_dictionary_with_a_budget_is_walked_in_parts(spark):
    texts = ["ālidīru", "sadah", "cipam\u200b", "xxxxxxxx", "क्षान्न"]
    whole = lookalikes.canonical(values(spark, texts), headwords(spark), budget=1.0, all_rows=True)
    parts = lookalikes.canonical(values(spark, texts), headwords(spark), budget=1.0, limit=2, all_rows=True)
    assert rows(parts) == rows(whole) and sum(r.head_id is not None for r in whole.collect()) == 4


def test_walk_with_a_budget_takes_the_nearest_word():
    trie = lookalikes.build_trie([("ālīdīru", "1"), ("alida", "2"), ("sadaḥ", "3")])
    assert lookalikes.walk(trie, "ālidīru", 1.0)[1] == [("ālīdīru", "1")]
    assert lookalikes.walk(trie, "sadah", 0.5) == (0.4, [("sadaḥ", "3")])
    assert lookalikes.walk(trie, "xxxxxx", 1.0) is None
    assert lookalikes.walk(trie, "", 0.0) is None


def test_all_rows_get_a_consistent_spelling(spark):
    texts = ["kṣā​nnu", "unknown​", "plain", None, "", "​", "a" * 100_000]
    found = {r.row_id: (r.spelling, r.head_id) for r in lookalikes.canonical(values(spark, texts), headwords(spark), all_rows=True).collect()}
    assert found == {0: ("kṣānnu", 2), 1: ("unknown", None), 2: ("plain", None), 5: ("", None), 6: ("a" * 100_000, None)}


def test_an_uneven_dictionary_and_ties(spark):
    uneven = headwords(spark, [(9, "a​b", "ab"), (7, "ab­", None)])
    found = {r.row_id: r.head_id for r in lookalikes.canonical(values(spark, ["аb", "ab", "a​b"]), uneven).collect()}
    assert found == {0: 7}


def test_empty_tables_and_repeats(spark):
    assert lookalikes.canonical(values(spark, []), headwords(spark)).count() == 0
    assert lookalikes.canonical(values(spark, ["kṣā​nnu"]), headwords(spark, [])).count() == 0
    twice = values(spark, ["kṣā​nnu"]).union(values(spark, ["kṣā​nnu"]))
    assert lookalikes.canonical(twice, headwords(spark).union(headwords(spark))).count() == 2


def test_words_of_the_corpus(spark):
    units = spark.createDataFrame([(1, ["a", None, ""], None), (2, None, " b  c"), (3, None, None)], "unit_id long, words array<string>, w string")
    mw = spark.createDataFrame([(1, "x"), (2, None)], "mw_id long, u string")
    morph = spark.createDataFrame([(1, [("y",)]), (2, []), (3, None)], "entry_id long, m array<struct<l:string>>")
    t = {"work_units": units, "mw_entries": mw, "morph_entries": morph}
    assert rows(lookalikes.corpus_words(t.get).where(F.col("val") != "")) == {("work_units", 1, 0, "a"), ("work_units", 2, 0, "b"), ("work_units", 2, 1, "c"), ("mw_entries", 1, 0, "x"), ("morph_entries", 1, 0, "y")}


def test_rows_do_not_depend_on_the_size_of_the_dictionary(spark):
    """Ties, words that are even but of another script, a null id: by one trie, by a join, by tries of parts."""
    words = [(9, "ab", None), (3, "аb", "sada"), (4, "sadā", "sadi"), (5, "сор", "a:"), (6, "ओम", "क|"), (None, "none", None), (7, "काः", "sodā"), (8, "cd", "рр")]
    texts = ["ab", "аb", "ab​", "sad", "sade", "cop", "aः", "अोम", "क।", "none​", "काः", "का:", "soda", "pp", "plain", "x​y"]
    held, asked = headwords(spark, words), values(spark, texts)
    for budget in (0.0, 1.0):
        for all_rows in (False, True):
            whole = rows(lookalikes.canonical(asked, held, budget=budget, all_rows=all_rows))
            for limit in (1, 5):
                assert rows(lookalikes.canonical(asked, held, budget=budget, all_rows=all_rows, limit=limit)) == whole, (budget, all_rows, limit)
    found = {r.val: (r.head_id, r.spelling) for r in lookalikes.canonical(asked, held).collect()}
    assert found == {"ab​": (3, "аb"), "cop": (5, "сор"), "aः": (5, "a:"), "अोम": (6, "ओम"), "क।": (6, "क|"), "का:": (7, "काः"), "pp": (8, "рр")}


def test_even_texts_of_one_look_are_equal():
    import itertools
    import re

    looks = {}
    for n in (1, 2, 3):
        for text in map("".join, itertools.product("अआएऐओऔऑऍकाेैोौॉॅः:।|a", repeat=n)):
            if not re.search(JAVA(SUSPECT), text):
                assert looks.setdefault(skeleton(text), text) == text


def test_a_walk_returns_all_words_that_are_as_near():
    for order in (1, -1):
        trie = lookalikes.build_trie([("sada", 1), ("sadi", 2), ("xada", 3)][::order])
        assert sorted(lookalikes.walk(trie, "sad", 1.0)[1]) == [("sada", 1), ("sadi", 2)]
