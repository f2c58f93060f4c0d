"""Nested records against a recursive reading of the same JSON."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.operators import nested

SCHEMA = "file_id long, declarations string, imports string, element string"


def rows(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    return {tuple(r) for r in nested.found(df).collect()}


def test_shapes(spark):
    deep = {"kind": "class", "name": "A", "children": [{"kind": "m", "name": "b", "children": {"0": {"name": "c"}, "1": None, "2": {"name": "d"}}}, None, {"name": "e", "children": json.dumps([{"name": "f"}])}]}
    out = rows(
        spark,
        [
            (1, json.dumps([deep]), json.dumps("os"), "x"),
            (1, json.dumps([deep]), json.dumps("os"), "x"),  # delivered twice
            (2, json.dumps({"declarations": [None, {"name": "a"}]}), json.dumps([None, "a", {"module": "b", "names": ["c"]}]), None),
            (3, json.dumps([deep])[:-5], None, None),
            (4, None, "", None),
            (5, json.dumps({"name": "lone"}), json.dumps({"module": {"name": "q", "line": 3}}), None),
            (6, "null", "[]", None),
        ],
    )
    d = "declaration"
    assert out == {
        (1, d, "0", ""), (1, d, "0.0", "0"), (1, d, "0.0.0", "0.0"), (1, d, "0.0.1", "0.0"), (1, d, "0.1", "0"), (1, d, "0.1.0", "0.1"), (1, "import", "0", ""),
        (2, d, "0", ""), (2, "import", "0", ""), (2, "import", "1", ""), (5, d, "0", ""), (5, "import", "0", ""),
    }


def test_tables_inline_and_link(spark):
    text = json.dumps([{"name": "a", "token": {"line": 3}, "modifiers": ["x", "y"], "children": [{"name": "b"}]}])
    df = spark.createDataFrame([(1, text, None, None)], SCHEMA)
    got = {(r.element, r.node_path): r for r in nested.tables(df).collect()}
    assert got["declaration", "0"].attributes["token.line"] == "3"
    assert got["modifiers", "0/modifiers.1"].parent_path == "0" and got["modifiers", "0/modifiers.1"].attributes["value"] == "y"
    assert got["declaration", "0.0"].parent_element == "declaration"


def test_plan_finds_recursive_and_shared():
    root = nested.Root("c", "r", frozenset({"q"}))
    plan = nested.analyse([("r", "r", "a", "object"), ("r", "a", "b", "object"), ("r", "b", "a", "object"), ("r", "r", "c", "object"), ("r", "c", "d", "object"), ("r", "r", "e", "object"), ("r", "e", "d", "object"), ("r", "c", "f", "object"), ("r", "d", "x", "bigint"), ("r", "f", "y", "string")], (root,))
    assert {("r", "a", "b"), ("r", "b", "a"), ("r", "c", "d"), ("r", "e", "d")} <= plan.tables and not any(k == "f" for _, _, k in plan.tables)
    assert plan.attributes["r", "r"] == {"c.f.y": "string"} and plan.attributes["r", "d"] == {"x": "bigint"}


AGAIN = nested.Plan(frozenset({("declaration", "children")}))


def test_the_plan_decides_the_rows(spark):
    text = json.dumps([{"kind": "c", "name": "a", "body": {"members": [{"kind": "m", "name": "b", "members": []}]}, "tags": [{"t": 1}]}])
    df = spark.createDataFrame([(1, text, '[{"name": ["x"]}]', None)], SCHEMA)
    assert {r.node_path for r in nested.found(df).collect() if r.node_kind == "declaration"} == {"0", "0.0"}  # another key, under another object
    assert {r.node_path for r in nested.found(df, nested.Plan()).collect() if r.node_kind == "declaration"} == {"0"}
    related = nested.related(df, "file_id")
    assert set(related) == {"declaration", "declaration.tags", "import", "import.name"}
    assert [tuple(r) for r in related["declaration.tags"].collect()] == [(1, "0/tags.0", "declaration", "0", 0, 1)] and dict(related["declaration.tags"].dtypes)["t"] == "bigint"
    assert {r.name for r in related["declaration"].collect()} == {"a", "b"}  # a list of that name elsewhere does not matter


def test_any_depth_and_any_list(spark):
    deep = "[" + '{"kind": "k", "children": [' * 20_000 + "]}" * 20_000 + "]"
    assert len(nested.shred_record(nested.parse_json(deep), nested.DECLARATIONS, AGAIN, False)) == 20_000
    for t in ('[1, {"a": "\\u00e9\\n"}, -1.5e3, true, null, [], {}]', ' {"a": {"b": [[]]}} ', '"x"', "0"):
        assert nested.parse_json("[" * 3000 + t + "]" * 3000)[0] is not None and nested.parse_json(t) == json.loads(t)
    for t in ("[1,]", "{'a': 1}", '{"a" 1}', "[1 2]", '{"a": 1,}', "tru", "[", "01"):
        for wrap in (0, 3000):
            try:
                nested.parse_json("[" * wrap + t + "]" * wrap)
                raise AssertionError(t)
            except ValueError:
                pass
    text = json.dumps([[{"name": "a", "children": [[{"name": "b"}], [[{"name": "c"}]]]}]])
    plan = nested.analyse([("declaration", *e) for e in nested.edges_of(json.loads(text), nested.DECLARATIONS)])
    assert [r[1] for r in nested.shred_record(json.loads(text), nested.DECLARATIONS, plan, False)] == ["0", "0.0", "0.1"]


def test_empty(spark):
    assert rows(spark, []) == set()


tree = st.recursive(st.fixed_dictionaries({"name": st.text(max_size=3)}), lambda kids: st.fixed_dictionaries({"name": st.text(max_size=3), "children": st.lists(st.one_of(st.none(), kids), max_size=3)}), max_leaves=12)


def brute(nodes, parent=""):
    out = []
    for i, n in enumerate(x for x in nodes if x is not None):
        path = f"{parent}.{i}" if parent else str(i)
        out += [(path, parent), *brute(n.get("children", []), path)]
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), tree), max_size=4))
def test_against_recursion(nodes):
    got = [(r[1], r[2]) for r in nested.shred_record(nodes, nested.DECLARATIONS, AGAIN, False)]
    assert sorted(got) == sorted(brute(nodes))


def test_deep_without_recursion():
    node = {"name": "leaf"}
    for _ in range(3000):
        node = {"name": "n", "children": [node]}
    assert len(nested.shred_record([node], nested.DECLARATIONS, AGAIN, False)) == 3001
