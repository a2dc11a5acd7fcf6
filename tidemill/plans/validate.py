"""What must hold of a graph before it is compiled, its canonical text and hash, and a drawing of it.

Graphs are the dicts that ``dataflow.compile_graph`` takes.  They are a few nodes each
and are checked where the query is written, not on the data.
"""

from __future__ import annotations

from hashlib import sha256

from tidemill.functions.values import canonical

LOOPS = {"map": "m", "filter": "f", "fold": "d"}


def ways(node: dict) -> list[str]:
    """Nodes that may come after a node."""
    kind = node["kind"]
    if kind == "if":
        return [node["then"], node["else"]]
    if kind == "case":
        return [to for _, to in node["arms"]] + [node["default"]]
    return [] if kind in ("return", "fail") else [node["next"]]


def reached(graph: dict[str, dict], entry: str, without: str | None = None) -> set[str]:
    """Nodes on some path from the entry that avoids one node."""
    seen, left = set(), [entry]
    while left:
        at = left.pop()
        if at in graph and at not in seen and at != without:
            seen.add(at)
            left += ways(graph[at])
    return seen


def order(graph: dict[str, dict], entry: str) -> list[str] | None:
    """The reached nodes so that each comes after all that lead to it, ties by name; null if there is a cycle."""
    nodes = reached(graph, entry)
    before = dict.fromkeys(nodes, 0)
    for at in nodes:
        for to in set(ways(graph[at])) & nodes:
            before[to] += 1
    ready, out = [entry] if before.get(entry) == 0 else [], []
    while ready:
        ready.sort(reverse=True)
        at = ready.pop()
        out.append(at)
        for to in sorted(set(ways(graph[at])) & nodes):
            before[to] -= 1
            if not before[to]:
                ready.append(to)
    return out if len(out) == len(nodes) else None


def references(e: tuple) -> list[tuple[str, str]]:
    """(kind, name) of the results and locals that an expression refers to."""
    if e[0] in ("result", "local"):
        return [(e[0], e[1])]
    parts = e[1].values() if e[0] == "object" else e[1] if e[0] == "array" else ()
    return [r for p in parts for r in references(p)]


def _expressions(node: dict) -> list[tuple[tuple, set[str]]]:
    """A node's expressions, each with the names that the node itself binds in it."""
    kind = node["kind"]
    if kind in LOOPS:
        own = {node["each"]} | ({node["acc"]} if kind == "fold" else set())
        return [(node["over"], set()), (node["body"], own)] + ([(node["from"], set())] if kind == "fold" else [])
    if kind == "merge":
        return []  # each source is read where its predecessor is
    return [(node[k], set()) for k in ("input", "value", "on", "reason") if k in node]


def depths(graph: dict[str, dict], entry: str) -> tuple[int, int] | None:
    """Fewest and most operations and calls on a path to a return; null if no path returns."""
    at: dict[str, tuple[int, int]] = {entry: (0, 0)}
    ends = []
    for name in order(graph, entry) or []:
        node = graph[name]
        low, high = (x + (node["kind"] in ("op", "call")) for x in at[name])
        if node["kind"] == "return":
            ends.append((low, high))
        for to in ways(node):
            a, b = at.get(to, (low, high))
            at[to] = (min(a, low), max(b, high))
    return (min(a for a, _ in ends), max(b for _, b in ends)) if ends else None


def errors(graph: dict[str, dict], entry: str) -> list[str]:
    """What is wrong with a graph, in order; empty if nothing is."""
    found = []
    if entry not in graph:
        return [f"entry {entry} does not exist"]
    for at, node in graph.items():
        found += [f"{at}: {to} does not exist" for to in ways(node) if to not in graph]
    if found:
        return found
    nodes = reached(graph, entry)
    found += [f"{at}: is never reached" for at in graph if at not in nodes]
    if order(graph, entry) is None:
        return [*found, "the graph has a cycle"]
    binders: dict[str, str] = {}
    taken: set[str] = set()
    for at, node in graph.items():
        names = {node["name"]} if node["kind"] in ("let", "merge", *LOOPS) else set()
        binders |= dict.fromkeys(names, at)
        names |= {node[k] for k in ("each", "acc") if node["kind"] in LOOPS and k in node}  # seen in the body only
        found += [f"{at}: {name} is bound twice" for name in sorted(names & taken)]
        taken |= names
    dominated: dict[str, set[str]] = {}

    def dominates(a: str, b: str) -> bool:
        if a not in dominated:
            dominated[a] = nodes - reached(graph, entry, a)
        return a != b and b in dominated[a]

    def scoped(e: tuple, at: str, own: set[str], same: bool = False) -> None:
        for kind, name in references(e):
            home = name if kind == "result" else binders.get(name)
            if kind == "local" and name in own:
                continue
            if home is None or home not in graph or kind == "result" and graph[home]["kind"] not in ("op", "call"):
                found.append(f"{at}: {name} is not known")
            elif not (dominates(home, at) or same and home == at):
                found.append(f"{at}: {name} may not be there yet")

    for at, node in graph.items():
        for e, own in _expressions(node):
            scoped(e, at, own)
        if node["kind"] == "merge":
            into = {p for p in nodes if at in ways(graph[p])}
            if set(node["from"]) != into:
                found.append(f"{at}: the merge must have a source for each of {', '.join(sorted(into))}")
            for p, e in node["from"].items():
                if p in graph:
                    scoped(e, p, set(), same=True)
        if node["kind"] == "case" and len({v for v, _ in node["arms"]}) < len(node["arms"]):
            found.append(f"{at}: two arms have one value")
    span = depths(graph, entry)
    if span and span[0] != span[1]:
        found.append(f"paths have from {span[0]} to {span[1]} operations")
    return found


def to_compensate(graph: dict[str, dict], entry: str) -> set[str]:
    """Operations after which something else may still happen or fail, so that they must be reversible."""
    held = set()
    for at in reached(graph, entry):
        if graph[at]["kind"] in ("op", "call"):
            after = reached(graph, graph[at]["next"])
            if any(graph[x]["kind"] in ("op", "call", "fail") for x in after):
                held.add(at)
    return held


def from_steps(steps: list[tuple[str, object]]) -> dict[str, dict]:
    """A flat list of (operation, constant input) as a graph that runs them in order."""
    graph = {f"n{i}": {"kind": "op", "name": name, "input": ("const", value), "next": f"n{i + 1}"} for i, (name, value) in enumerate(steps)}
    return graph | {f"n{len(steps)}": {"kind": "return", "value": ("object", {})}}


def _lp(text: str) -> str:
    return f"{len(text.encode())}:{text};"


def _text(value) -> str:
    """Canonical JSON of a constant; numbers are spelled as Python spells them."""
    plain = lambda v: {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else [plain(x) for x in v] if isinstance(v, list) else v
    return repr(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else canonical(plain(value))


def _expr(e: tuple) -> str:
    path = lambda names: "[" + "".join(map(_lp, names)) + "]"
    kind = e[0]
    if kind == "const":
        return "k" + _lp(_text(e[1]))
    if kind == "arg":
        return "a" + path(e[1])
    if kind in ("result", "local"):
        return kind[0] + _lp(e[1]) + path(e[2])
    if kind == "object":
        return f"o{len(e[1])};" + "".join(_lp(k) + _lp(_expr(e[1][k])) for k in sorted(e[1], key=str.encode))
    return f"y{len(e[1])};" + "".join(_lp(_expr(x)) for x in e[1])


def _node(at: str, node: dict) -> str:
    kind, next_ = node["kind"], _lp(node["next"]) if "next" in node else ""
    if kind == "op":
        return "P" + _lp(at) + _lp(node["name"]) + _expr(node["input"]) + next_
    if kind == "call":
        return "W" + _lp(at) + _lp(node["child"]) + _lp(node["version"]) + _expr(node["input"]) + next_
    if kind == "let":
        return "L" + _lp(at) + _lp(node["name"]) + _expr(node["value"]) + next_
    if kind == "if":
        return "I" + _lp(at) + _expr(node["on"]) + _lp(node["then"]) + _lp(node["else"])
    if kind == "case":
        arms = sorted((_text(v), to) for v, to in node["arms"])
        return "C" + _lp(at) + _expr(node["on"]) + "[" + "".join(_lp(v) + _lp(to) for v, to in arms) + "]" + _lp(node["default"])
    if kind == "merge":
        return "M" + _lp(at) + _lp(node["name"]) + "[" + "".join(_lp(p) + _expr(node["from"][p]) for p in sorted(node["from"])) + "]" + next_
    if kind in LOOPS:
        start = _expr(node["from"]) if kind == "fold" else _expr(("const", None))
        return "O" + _lp(at) + LOOPS[kind] + _expr(node["over"]) + _lp(node["each"]) + _lp(node.get("acc", "")) + start + _expr(node["body"]) + next_
    return ("R" + _lp(at) + _expr(node["value"])) if kind == "return" else ("F" + _lp(at) + _expr(node["reason"]))


def canonical_graph(graph: dict[str, dict], entry: str) -> str:
    """One text for all spellings of a graph: nodes by name, arms by value, merge sources by predecessor."""
    return "G{" + _lp(entry) + "|" + "".join(_node(at, graph[at]) + ";" for at in sorted(graph, key=str.encode)) + "}"


def content_hash(graph: dict[str, dict], entry: str, bindings: dict[str, str], types: str) -> bytes:
    """33 bytes: the format's number, and the SHA-256 of the graph, the bindings of its operations in order of nodes, and the types."""
    names = [graph[at]["name"] for at in sorted(graph, key=str.encode) if graph[at]["kind"] == "op"]
    text = canonical_graph(graph, entry) + "".join(_lp(n) + _lp(bindings[n]) for n in names) + _lp(types)
    return b"\x01" + sha256(text.encode()).digest()


def drawing(graph: dict[str, dict]) -> str:
    """The graph as a Mermaid flow chart."""
    shape = {"op": '["{}"]', "call": '["call {}"]', "let": '(["let {}"])', "if": '{{"if"}}', "case": '{{"case"}}', "merge": '{{{{"merge {}"}}}}', "return": '(["return"])', "fail": '["fail"]'}
    lines = ["flowchart TD"]
    for at in sorted(graph, key=str.encode):
        node = graph[at]
        own = shape.get(node["kind"], '["loop"]').format(node.get("name", node.get("child", "")))
        names = {"if": ["then", "else"], "case": [_text(v) for v, _ in node.get("arms", [])] + ["default"]}.get(node["kind"], [""])
        lines.append(f"  {at}{own}")
        lines += [f"  {at} -->{f'|{name}|' if name else ''} {to}" for name, to in zip(names, ways(node))]
    return "\n".join(lines) + "\n"
