import pytest

from tidemill.plans import validate as v
from tidemill.plans.dataflow import CHECKOUT

FOLD = {
    "n0": {"kind": "fold", "name": "last", "over": ("arg", ["cands"]), "from": ("const", None), "acc": "last", "each": "c", "body": ("local", "c", []), "next": "n1"},
    "n1": {"kind": "op", "name": "reserve", "input": ("local", "last", []), "next": "n2"},
    "n2": {"kind": "return", "value": ("const", None)},
}
DIAMOND = {
    "a": {"kind": "if", "on": ("arg", ["x"]), "then": "b", "else": "c"},
    "b": {"kind": "op", "name": "left", "input": ("arg", ["x"]), "next": "d"},
    "c": {"kind": "op", "name": "right", "input": ("arg", ["x"]), "next": "d"},
    "d": {"kind": "merge", "name": "m", "from": {"b": ("result", "b", []), "c": ("result", "c", [])}, "next": "e"},
    "e": {"kind": "return", "value": ("local", "m", [])},
}


def changed(graph, at, **fields):
    return graph | {at: graph[at] | fields}


def test_canonical_text_of_a_fold():
    assert v.canonical_graph(FOLD, "n0") == "G{2:n0;|O2:n0;da[5:cands;]1:c;4:last;k4:null;l1:c;[]2:n1;;P2:n1;7:reserve;l4:last;[]2:n2;;R2:n2;k4:null;;}"


def test_order_of_declaration_does_not_matter():
    turned = dict(reversed(DIAMOND.items()))
    assert v.canonical_graph(turned, "a") == v.canonical_graph(DIAMOND, "a")
    bound = {"left": "1@stock", "right": "1@stock"}
    same = v.content_hash(DIAMOND, "a", bound, "i")
    assert same == v.content_hash(turned, "a", bound, "i") and len(same) == 33 and same[0] == 1
    assert same != v.content_hash(DIAMOND, "a", bound | {"left": "2@stock"}, "i") != v.content_hash(DIAMOND, "a", bound, "s")


def test_canonical_text_of_values():
    fields = 'o2;1:a;8:k4:true;;1:b;7:k3:"x";;'
    value = ("array", [("const", 1), ("object", {"b": ("const", "x"), "a": ("const", True)})])
    assert v.canonical_graph({"r": {"kind": "return", "value": value}}, "r") == f"G{{1:r;|R1:r;y2;5:k1:1;;{len(fields)}:{fields};;}}"


def test_sound_graphs():
    assert v.errors(DIAMOND, "a") == [] and v.errors(CHECKOUT, "n0") == []
    assert v.order(DIAMOND, "a") == ["a", "b", "c", "d", "e"] and v.depths(DIAMOND, "a") == (1, 1)
    assert v.errors(v.from_steps([("x", 1), ("y", 2)]), "n0") == [] and v.depths(v.from_steps([("x", 1), ("y", 2)]), "n0") == (2, 2)


@pytest.mark.parametrize(
    ("graph", "entry", "error"),
    [
        (DIAMOND, "z", "entry z does not exist"),
        (changed(DIAMOND, "b", next="q"), "a", "b: q does not exist"),
        (DIAMOND | {"f": {"kind": "fail", "reason": ("const", "x")}}, "a", "f: is never reached"),
        (changed(DIAMOND, "d", next="a"), "a", "the graph has a cycle"),
        (changed(DIAMOND, "e", value=("result", "b", [])), "a", "e: b may not be there yet"),
        (changed(DIAMOND, "e", value=("local", "nope", [])), "a", "e: nope is not known"),
        (changed(DIAMOND, "e", value=("result", "a", [])), "a", "e: a is not known"),
        (changed(DIAMOND, "d", **{"from": {"b": ("result", "b", [])}}), "a", "d: the merge must have a source for each of b, c"),
        (changed(DIAMOND, "d", **{"from": {"b": ("result", "b", []), "c": ("result", "b", [])}}), "a", "c: b may not be there yet"),
        (changed(DIAMOND, "b", kind="let", name="m", value=("arg", ["x"])), "a", "d: m is bound twice"),
        (changed(FOLD, "n0", each="last", name="x", acc="y") | {"n1": {"kind": "let", "name": "last", "value": ("const", 1), "next": "n2"}}, "n0", "n1: last is bound twice"),
        (changed(CHECKOUT, "n0", arms=[("1-URGENT", "n1"), ("1-URGENT", "n2")]), "n0", "n0: two arms have one value"),
        (changed(FOLD, "n1", input=("local", "c", [])), "n0", "n1: c is not known"),
    ],
)
def test_unsound_graphs(graph, entry, error):
    assert error in v.errors(graph, entry)


def test_unbalanced_paths():
    graph = changed(DIAMOND, "c", kind="let", name="y", value=("arg", ["x"]))
    graph = changed(graph, "d", **{"from": {"b": ("result", "b", []), "c": ("local", "y", [])}})
    assert v.errors(graph, "a") == ["paths have from 0 to 1 operations"]


def test_operations_that_must_be_reversible():
    assert v.to_compensate(CHECKOUT, "n0") == {"n1", "n2", "n6"} and v.to_compensate(DIAMOND, "a") == set()


def test_drawing():
    text = v.drawing(DIAMOND)
    assert text.startswith("flowchart TD\n") and "  a -->|then| b\n" in text and '  d{{"merge m"}}\n' in text
