import json

from hypothesis import given, settings
from hypothesis import strategies as st

from tantu.operators import nested
from tests.conftest import rows

values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=20)


def walk(value, path=()):
    yield path, value
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for k, v in items:
        yield from walk(v, (*path, str(k)))


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text(), values, max_size=4) | st.lists(values, max_size=4), st.booleans(), st.sampled_from([None, 1]))
def test_index_finds_what_a_parser_finds(document, ascii_only, indent):
    text = json.dumps(document, ensure_ascii=ascii_only, indent=indent)
    index = nested.Index(text.encode("utf-8", "surrogatepass"))
    assert index.valid
    found = list(index.nodes())
    want = list(walk(document))
    assert [tuple(n[2]) for n in found] == [p for p, _ in want]
    by_id = {n[0]: n for n in found}
    for (ident, parent, path, in_array, kind, raw), (_, value) in zip(found, want):
        if path:
            assert tuple(by_id[parent][2]) == tuple(path[:-1])
            assert in_array == (by_id[parent][4] == "array")
            assert raw is None if kind in ("object", "array") else json.loads(raw) == value
        assert kind == {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(value), "number")


def test_malformed_documents_have_no_index():
    for text in ("", "   ", "12", '"a"', "{", "}", '{"a": [1}', '{"a": "b}', '{"a":1}}', '{"a":1}{"b":2}', "[}", "]["):
        assert not nested.Index(text.encode()).valid, text


def parse(l="x", **more):
    return {"l": l, **more}


def test_rows_of_both_versions_and_of_odd_documents(spark):
    raw = {
        "plain": {"1.1": {"0": [parse(), parse(m=[{"d": "a"}, {"d": "b"}])], "1": None, "2": parse(m=[{"d": "c"}]), "3": [], "4": [None, parse()]}, "1.2": None},
        "enveloped": {"built": "2020", "occurrence": {"2.1": {"7": parse(m=None)}}},
    }
    typed = "map<string,map<string,array<struct<l:string,p:string,f:string,g:string,r:string,source:string,confidence:double,m:array<struct<d:string,l:string,p:string,f:string>>>>>>"
    schema = f"shard_id long, raw_json string, occurrence {typed}, path string, kind string, node_id long"
    one = {"3.1": {"0": [("x", None, None, None, None, None, None, [("a", None, None, None)]), ("y",) + (None,) * 7]}}
    data = [(1, json.dumps(raw["plain"]), None), (2, json.dumps(raw["enveloped"], indent=2), None), (3, None, one), (4, None, None), (5, "", None), (6, '{"broken": {"0": [', None), (1, json.dumps(raw["plain"]), None)]
    df = spark.createDataFrame([(*d, "clash", "clash", 9) for d in data], schema)
    want = {
        (1, "1.1", 0, 0, -1), (1, "1.1", 0, 1, -1), (1, "1.1", 0, 1, 0), (1, "1.1", 0, 1, 1), (1, "1.1", 2, 0, -1), (1, "1.1", 2, 0, 0), (1, "1.1", 4, 1, -1),
        (2, "2.1", 7, 0, -1), (3, "3.1", 0, 0, -1), (3, "3.1", 0, 0, 0), (3, "3.1", 0, 1, -1),
    }
    assert rows(nested.parse_member_rows(df)) == want
    tables = nested.occurrence_tables(df)
    parents = {(r.shard_id, r.parse_id) for r in tables["parses"].collect()}
    assert {(r.shard_id, r.ref, r.token_index, r.parse_pos, -1) for r in tables["parses"].collect()} | {(r.shard_id, r.ref, r.token_index, r.parse_pos, r.member_pos) for r in tables["members"].collect()} == want
    assert parents and rows(tables["refs"].select("shard_id", "ref")) == {(1, "1.1"), (2, "2.1"), (3, "3.1")}
    assert nested.parse_member_rows(df.limit(0)).count() == 0


def test_a_very_long_document(spark):
    big = json.dumps({"1.1": {str(i): [parse(l="क" * 50)] for i in range(20_000)}}, ensure_ascii=False)
    df = spark.createDataFrame([(1, big)], "shard_id long, raw_json string").selectExpr("*", "cast(null as map<string,map<string,array<struct<l:string>>>>) as occurrence")
    assert nested.parse_member_rows(df).count() == 20_000


def test_documents_of_any_depth_keep_every_value(spark):
    document = 1
    for k in range(60):
        document = {"k": [document, k]} if k % 2 else {"k": document}
    df = spark.createDataFrame([(1, json.dumps(document))], "id long, doc string")
    found = nested.nested_nodes(df, ["id"], "doc").collect()
    assert len(found) == len(list(walk(document))) and max(len(r.path) for r in found) == 90
    assert nested.nested_nodes(df, ["id"], "doc", deepest=3).where("size(path) > 3").count() == 0


def test_flat_tables_of_a_pattern(spark):
    docs = {"a": {"orders": [{"no": 1, "note": 'x"y', "items": [{"sku": "p", "n": 2}, {"sku": "q"}]}, {"no": 2, "items": []}]}, "b": {"orders": [{}]}, "c": {"orders": None}}
    nodes = nested.nested_nodes(spark.createDataFrame([(7, json.dumps(docs))], "id long, doc string"), ["id"], "doc")
    orders = {tuple(r.steps): r for r in nested.flat_table(nodes, ["id"], ["*", "orders", "[]"]).collect()}
    assert {k: r.fields for k, r in orders.items()} == {("a", "0"): {"no": "1", "note": 'x"y'}, ("a", "1"): {"no": "2"}, ("b", "0"): {}}
    items = nested.flat_table(nodes, ["id"], ["*", "orders", "[]", "items", "[]"]).collect()
    assert [(r.position, r.fields["sku"]) for r in sorted(items, key=lambda r: r.position)] == [(0, "p"), (1, "q")]
    assert {r.parent_id for r in items} == {orders["a", "0"].node_id}
    people = nested.flat_table(nodes, ["id"], ["*"]).collect()
    assert {r.node_id for r in people} >= {r.parent_id for r in orders.values()} and len(people) == 3
    assert nested.flat_table(nodes.limit(0), ["id"], ["*"]).count() == 0
