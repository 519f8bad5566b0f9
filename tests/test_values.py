"""The algebra of nested values: laws over random sorts and values, and cases kind by kind."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from deltaweave.functions import sorts, values
from deltaweave.functions.sorts import ANY, BOOL, DELTA, FLOAT, INTEGER, STRING, Sort, parse
from deltaweave.functions.values import SAME, act, fold, gap, join, split

NUMBER = st.integers(-100, 99)
WORD = st.text("abc", min_size=1, max_size=3)


def typed(depth: int = 2):
    """Pairs of a sort and a strategy for its values."""
    base = [(FLOAT, NUMBER.map(float)), (INTEGER, NUMBER), (DELTA, NUMBER.map(float)), (BOOL, st.booleans()), (STRING, WORD), (Sort("enum", values=("x", "y")), st.sampled_from("xy"))]
    leaf = st.sampled_from(base)
    if not depth:
        return leaf
    inner = typed(depth - 1)
    wrap = lambda kind, make: inner.map(lambda p: (Sort(kind, (p[0],)), make(p[1])))
    trees = st.dictionaries(st.sampled_from("abc"), inner, min_size=1, max_size=3).map(lambda d: (sorts.tree(**{k: p[0] for k, p in d.items()}), st.fixed_dictionaries({k: p[1] for k, p in d.items()})))
    grid = inner.filter(lambda p: p[0] in (FLOAT, INTEGER, DELTA)).map(lambda p: (Sort("array", (p[0],), values=(2, 2)), st.lists(st.lists(p[1], min_size=2, max_size=2), min_size=2, max_size=2)))
    return st.one_of(leaf, wrap("overwrite", lambda v: v), wrap("list", lambda v: st.lists(v, max_size=2)), wrap("map", lambda v: st.dictionaries(WORD, v, max_size=2)), trees, grid)


@st.composite
def sorted_values(draw, n):
    sort, made = draw(typed())
    return sort, [draw(made) for _ in range(n)]


@settings(max_examples=400, deadline=None)
@given(sorted_values(2))
def test_a_gap_leads_from_one_value_to_the_other(case):
    sort, (a, b) = case
    change = gap(sort, a, b)
    assert change is SAME if a == b else change is not SAME
    if change is not SAME:
        assert act(sort, a, change) == b
    assert sorts.check(sort, a) or sort.kind in ("const", "quote")


@settings(max_examples=400, deadline=None)
@given(sorted_values(3))
def test_a_fold_does_what_all_changes_do(case):
    """For changes that only add to numbers, at any depth."""
    sort, (a, b, c) = case
    additive = lambda s: s.kind in ("float", "integer", "delta") or (s.kind in ("tree", "array") and all(map(additive, s.args)))
    if not additive(sort):
        return
    total = fold(sort, [b, c])
    one_by_one = act(sort, act(sort, a, b), c)
    assert (a if total is SAME else act(sort, a, total)) == one_by_one


@settings(max_examples=300, deadline=None)
@given(sorted_values(1), st.integers(2, 4))
def test_parts_keep_whole_amounts(case, n):
    sort, (value,) = case
    parts = split(sort, value, n)
    assert len(parts) == n
    if sort.kind == "integer":
        assert sum(parts) == value and max(parts) - min(parts) <= 1
    if sort.kind == "delta":
        assert abs(sum(parts) - value) < 1e-9
    if sort.kind in ("float", "bool", "string", "enum"):
        assert parts == [value] * n


@settings(max_examples=400, deadline=None)
@given(typed(), typed())
def test_order_of_sorts(one, other):
    a, b = one[0], other[0]
    both = sorts.resolve(a, b)
    assert sorts.resolve(a, a) == a == sorts.resolve(a, ANY) == sorts.resolve(ANY, a)
    assert sorts.resolve(both, b) == both or a.kind != b.kind
    assert sorts.generalize(a, ANY) == a == sorts.generalize(ANY, a)


@pytest.mark.parametrize(
    "a, b, join_, meet",
    [
        ("integer", "float", "float", "float"), ("delta", "float", "delta", "delta"), ("delta", "integer", "integer", "integer"), ("string", "float", "float", "float"),
        ("enum[x,y]", "enum[y,z]", "enum[x,y,z]", "enum[x,y,z]"), ("any", "float", "float", "float"), ("maybe[integer]", "float", "maybe[float]", "float"),
        ("overwrite[integer]", "maybe[float]", "maybe[overwrite[float]]", "float"), ("list[any]", "tuple[float,float]", "tuple[float,float]", "tuple[float,float]"),
        ("array[2,float]", "array[3|4,integer]", "array[3|4,float]", "array[3|4,float]"), ("list[any]", "array[2,float]", "array[2,float]", "array[2,float]"),
        ("map[integer]", "a:float", "a:float", "a:float"), ("map[link[any,any]]", "a:float", "map[link[any,any]]", "a:float"), ("a:integer|b:string", "a:float|c:bool", "a:float|b:string|c:bool", "a:float|b:string|c:bool"),
        ("tree[integer]", "map[float]", "tree[float]", "map[float]"), ("link[any,any]", "process[a:float,b:float]", "process[a:float,b:float]", "process[a:float,b:float]"), ("tuple[integer]", "tuple[float,bool]", "tuple[float,bool]", "tuple[float,bool]"),
    ],
)
def test_pairs_of_kinds(a, b, join_, meet):
    assert sorts.resolve(parse(a), parse(b)) == parse(join_)
    assert sorts.generalize(parse(a), parse(b)) == parse(meet)


def test_changes_of_maps_and_lists():
    cells = parse("map[mass:delta|n:integer|name:string]")
    now = {"a": {"mass": 4.0, "n": 5, "name": "x"}, "b": {"mass": 1.0, "n": 1, "name": "y"}}
    assert act(cells, now, {"_remove": ["b"], "_add": {"c": {"mass": 2.0}}, "a": {"mass": 1.0}}) == {"a": {"mass": 5.0, "n": 5, "name": "x"}, "c": {"mass": 2.0}}
    after = act(cells, now, {"a": {"mass": 2.0}, "_divide": {"mother": "a", "daughters": {"a0": {"name": "z"}, "a1": None}}})
    assert after == {"b": now["b"], "a0": {"mass": 3.0, "n": 3, "name": "z"}, "a1": {"mass": 3.0, "n": 2, "name": "x"}}
    assert act(parse("list[integer]"), [1, 2, 2], {"_remove": [2], "_add": [7]}) == [1, 7] and act(parse("list[integer]"), [1], {"_remove": "all"}) == []
    assert fold(cells, [{"_remove": ["a"]}, {"a": {"mass": 1.0}}, {"_add": {"c": {}}}, {"b": {"mass": 1.0}}, {"b": {"mass": 2.0}}]) == {"_add": {"c": {}}, "_remove": ["a"], "b": {"mass": 3.0}}
    assert fold(parse("list[any]"), [[1], [2]]) == [1, 2] and fold(parse("list[any]"), [{"_remove": [1, 1]}, [3], {"_add": [2]}]) == {"_remove": [1], "_add": [2, 3]}
    assert fold(FLOAT, [1.0, -1.0]) is SAME and fold(parse("const[float]"), [1.0]) is SAME and fold(ANY, [1, None]) == 1


def test_other_kinds():
    assert act(parse("maybe[float]"), None, 2.0) == 2.0 and act(parse("maybe[float]"), 2.0, None) is None and gap(parse("maybe[float]"), 1.0, None) is None
    assert act(parse("tuple[float,string]"), [1.0, "a"], [2.0, "b"]) == [3.0, "b"] and fold(parse("tuple[float,string]"), [[1.0, None], [2.0, "b"]]) == [3.0, "b"]
    assert act(parse("tree[float]"), {"a": {"b": 1.0}}, {"a": {"b": 2.0, "c": 5.0}}) == {"a": {"b": 3.0, "c": 5.0}}
    assert act(parse("array[2|2,float]"), [[1.0, 2.0], [3.0, 4.0]], [[1.0, 0.0], [0.0, 1.0]]) == [[2.0, 2.0], [3.0, 5.0]]
    assert act(ANY, 1, 2) == 3.0 and act(ANY, {"a": 1}, {"b": 2}) == {"a": 1, "b": 2} and act(parse("const[float]"), 1.0, 9.0) == 1.0
    node = parse("process[any,mass:delta|n:integer|at:map[float]]")
    assert act(node, {"mass": 1.0, "address": "x"}, {"mass": 1.0, "address": "y"}) == {"mass": 2.0, "address": "y"}
    assert [p["mass"] for p in split(node, {"mass": 1.0, "address": "x"}, 2)] == [0.5, 0.5]
    assert join(parse("list[any]"), [1], [2]) == [1, 2] and join(parse("a:float|b:any"), {"a": 1.0, "b": 3}, {"a": None}) == {"a": 1.0, "b": 3}
    assert act(Sort("chain"), ["a", "b", "c"], {"_set": [[0, "z"]], "_remove": [1], "_add": ["d"]}) == ["z", "c", "d"] and split(Sort("chain"), ["a", "b", "c"], 2, {"2": 1}) == [["a"], ["b", "c"]]
    graph = {"vertices": {"a": 1, "b": 2, "c": 3}, "edges": [["a", "b"], ["a", "b"], ["b", "c"]]}
    assert act(Sort("graph"), graph, {"_remove_vertex": ["c"], "_remove_edge": [["a", "b"]], "_add_vertex": {"d": 4}, "_add_edge": [["d", "a"], ["x", "a"]]}) == {"vertices": {"a": 1, "b": 2, "d": 4}, "edges": [["a", "b"], ["d", "a"]]}
    assert split(Sort("graph"), graph, 2, {"b": 0}) == [{"vertices": {"a": 1, "b": 2, "c": 3}, "edges": graph["edges"]}, {"vertices": {}, "edges": []}]
    assert values.division(parse("mass:delta|name:string"), "c", {"mass": 4.0, "name": "x"}) == {"c_0": {"mass": 2.0, "name": "x"}, "c_1": {"mass": 2.0, "name": "x"}}
    with pytest.raises(TypeError):
        values.division(parse("name:string"), "c", {})
    values.behave("top", type("Top", (values.Replaced,), {"act": lambda self, sort, now, change: max(now, change)})())
    assert act(parse("a:float"), {"a": 1.0}, {"a": 1.0}) == {"a": 2.0} and act(Sort("top"), 3, 2) == 3


def test_paths():
    state = {"cells": {"x": {"v": 1, "w": [10, 20]}, "y": {"v": 2}}}
    assert values.at(state, ["cells", "*", "v"]) == {"x": 1, "y": 2} and values.at(state, ["cells", "x", "w", "1"]) == 20 and values.at(state, ["cells", "z"]) is None
    assert values.put(state, ["cells", "*", "v"], {"x": 5, "q": 9})["cells"] == {"x": {"v": 5, "w": [10, 20]}, "y": {"v": 2}}
    assert values.put(state, ["cells", "x", "w", "0"], 7)["cells"]["x"]["w"] == [7, 20] and values.put({}, ["a", "b"], 1) == {"a": {"b": 1}}
    assert values.overlaid({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert values.changed_leaves({"a": 1, "b": {"c": 2, "d": 3}, "e": 0}, {"a": 1, "b": {"c": 5, "d": 3}, "f": 9}) == {"b": {"c": 5}, "_remove": ["e"], "_add": {"f": 9}}
    assert values.changed_leaves(state, state) is SAME


def test_states_of_a_table(spark):
    rows = spark.createDataFrame([(1, '{"a": 1.0}', '{"a": 2.0}', "x"), (2, None, '{"a": 1.0}', "x"), (3, '{"a": 1.0}', '{"a": 0}', None)], "id long, s string, u string, after string")
    sort = parse("a:float")
    got = {r["id"]: r["after"] for r in values.per_state(rows, ["s", "u"], lambda s, u: act(sort, s, u) if s else SAME, "after").collect()}
    assert got == {1: '{"a": 3.0}', 2: None, 3: '{"a": 1.0}'}
    assert values.per_state(rows.limit(0), ["s"], lambda s: s, "after").count() == 0
