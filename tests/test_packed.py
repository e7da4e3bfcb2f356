import random

from tantu.operators import packed
from tests.conftest import rows

SCHEMA = "id long, f string, text string, vals string, k0 string, dialect string"


def table(spark, fields):
    return spark.createDataFrame([(i, f, "clash", "clash", "clash", "clash") for i, f in enumerate(fields)], SCHEMA)


def test_split_outside_quotes_and_braces():
    assert packed.split_outside('a{x;y};"b;c" ; d', ";") == ["a{x;y}", "b;c", "d"]
    assert packed.split_outside(";;a; ;", ";") == ["a"]
    assert packed.split_outside('a "b', " ", "") == ["a", '"b']
    assert packed.split_outside("«a;b»;“c”;d", ";", "«") == ["a;b", "“c”", "d"]
    assert packed.split_outside("'a;b' ;l'x;'c'", ";", "'") == ["a;b", "l'x", "c"]
    assert packed.split_outside("", ";") == []


def test_dialects_of_odd_texts():
    assert list(packed.dialects("plain")) == [("", "")]
    assert {d for d, _ in packed.dialects("a;b,c")} == {"", ";", ",", ";,"}
    assert {q for _, q in packed.dialects('a;"b')} == {""}
    assert {q for _, q in packed.dialects('a;"b";“c”')} == {"", '"', "“"}
    assert len(list(packed.dialects("a;b,c/d|e、f；g／h，i｜j\tk l"))) == 2 ** len(packed.DELIMITERS)


def test_quotes_are_scored(spark):
    """Where quotes are used around values that hold delimiters they quote; where they are part of the values they do not."""
    rng = random.Random(8)
    names = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30)]
    fields, want = [], set()
    for i in range(300):
        values = [rng.choice(names) + (";" + rng.choice("123") if rng.random() < 0.2 else "") for _ in range(rng.randint(2, 4))]
        fields.append(";".join(f"«{v}»" if ";" in v or rng.random() < 0.1 else v for v in values))
        want |= {(i, k, v) for k, v in enumerate(values)}
    got = rows(packed.unpack(table(spark, fields), ["id"], "f"))
    assert len(got & want) > 0.98 * len(want)
    feet = [f"{a}' {b}';{b}' {a}'" for a in range(3, 9) for b in range(3, 9)]
    assert {len(v) for v in packed_by_id(packed.unpack(table(spark, feet), ["id"], "f"))} <= {2, 4}


def packed_by_id(df):
    by = {}
    for r in df.collect():
        by.setdefault(r.id, []).append(r.val)
    return by.values()


def test_mixed_delimiters_are_chosen_by_the_corpus(spark):
    rng = random.Random(3)
    tags = ["पुं", "स्त्री", "नपुं", "एक", "द्वि", "बहु", "1", "2", "3", "Cpd"]
    want, fields = set(), []
    for i in range(400):
        values = [rng.choice(tags) for _ in range(rng.randint(1, 4))]
        text = values[0]
        for v in values[1:]:
            text += rng.choice([";", ",", " ; ", "/", " ", "；", ";;"]) + (f'"{v}"' if rng.random() < 0.1 else v)
        fields.append(text + rng.choice(["", "", ";"]))
        if len(values) > 1:
            want |= {(i, k, v) for k, v in enumerate(values)}
    assert rows(packed.unpack(table(spark, fields), ["id"], "f")) == want


def test_every_combination_of_many_delimiters_is_a_candidate(spark):
    wide = "a;b,c/d|e、f；g／h，i｜j\tk l"
    found = packed.candidate_parses(spark.createDataFrame([("a/b;c,d|e f",), (wide,)], "text string")).collect()
    assert ["a", "b", "c", "d", "e f"] in [r.vals for r in found if r.text != wide]
    assert len({r.dialect for r in found if r.text != wide}) == 2**5
    assert len({r.dialect for r in found if r.text == wide}) == 2 ** len(packed.DELIMITERS)


def test_nulls_empty_long_and_repeated_fields(spark):
    long = ";".join(["पुं", "एक"] * 20_000)
    found = packed.unpack(table(spark, [None, "", "   ", ";;;", "a;b", long]), ["id"], "f")
    by = {}
    for r in found.collect():
        by.setdefault(r.id, []).append((r.pos, r.val))
    assert set(by) == {4, 5}
    assert sorted(by[4]) == [(0, "a"), (1, "b")]
    assert len(by[5]) == 40_000 and sorted(by[5])[0] == (0, "पुं")
    twice = spark.createDataFrame([(1, "a;b")] * 2, "id long, f string")
    assert packed.unpack(twice, ["id"], "f").count() == 4
    assert packed.unpack(twice.limit(0), ["id"], "f").count() == 0


def test_braces_hold_a_reading_together(spark):
    fields = ["X{a}{1;2}/Y{b}", "Z{a}{1/2} | W{b}{2,3}", "V{a}", "X{a}{1;2} ; V{a}"]
    found = rows(packed.unpack(table(spark, fields * 5), ["id"], "f").where("id < 4"))
    assert found == {(0, 0, "X{a}{1;2}"), (0, 1, "Y{b}"), (1, 0, "Z{a}{1/2}"), (1, 1, "W{b}{2,3}"), (3, 0, "X{a}{1;2}"), (3, 1, "V{a}")}
