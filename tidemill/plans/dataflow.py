"""Workflow graphs as Spark expressions: a graph compiles to one Column, evaluated for all instances at once.

A graph is a dict of nodes.  ``advance`` replays it against an instance's arguments
and settled results up to the next thing that has to happen outside: a request for
an operation or call, completion, an authored failure, or a fault.  Compilation
walks each path once; every path ends in an outcome struct, so the whole graph is a
nest of CASE expressions that Spark generates code for.

Node kinds: op, call, let, if, case, merge, return, fail, map, filter, fold.
Expression kinds: ("const", v), ("arg", path), ("result", node, path), ("local",
name, path), ("object", {k: e}), ("array", [e]).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.plans.catalog import query
from tidemill.sources.fixtures import Fixtures

#: Longest reason of an authored failure, in bytes.
REASON_BYTES = 190


@dataclass
class Scope:
    """What expressions may refer to: argument columns, results by node, locals."""

    args: dict[str, Column]
    results: dict[str, Column] = field(default_factory=dict)
    local: dict[str, Column] = field(default_factory=dict)

    def bind(self, name: str, value: Column) -> Scope:
        return Scope(self.args, self.results, self.local | {name: value})


def project(value: Column, path: list[str]) -> Column:
    """A field of a field; the empty path is the whole value."""
    for name in path:
        value = value.getField(name)
    return value


def expression(e: tuple, scope: Scope) -> Column:
    kind = e[0]
    if kind == "const":
        return F.lit(e[1])
    if kind == "optional":
        return expression(e[1], scope)
    if kind == "arg":
        return project(scope.args[e[1][0]], e[1][1:])
    if kind == "result":
        return project(scope.results[e[1]], e[2])
    if kind == "local":
        return project(scope.local[e[1]], e[2])
    if kind == "object":
        return F.struct(*[expression(v, scope).alias(k) for k, v in sorted(e[1].items())])
    if kind == "array":
        return F.array(*[expression(v, scope) for v in e[1]])
    raise ValueError(f"unknown expression {kind}")


def present(e: tuple, scope: Scope) -> Column:
    """Whether what an expression refers to is there.

    A value that is missing is a fault; one that may be null by its type is marked
    ("optional", expression), and null is a value of it.
    """
    kind = e[0]
    if kind in ("const", "optional"):
        return F.lit(True)
    if kind == "object":
        parts = [present(v, scope) for v in e[1].values()]
    elif kind == "array":
        parts = [present(v, scope) for v in e[1]]
    else:
        return expression(e, scope).isNotNull()
    all_of = F.lit(True)
    for p in parts:
        all_of = all_of & p
    return all_of


def loop(node: dict, scope: Scope) -> Column:
    """map, filter and fold over an array, with the loop's own names bound in the body."""
    over = expression(node["over"], scope)
    body = lambda own: expression(node["body"], own)
    if node["kind"] == "map":
        return F.transform(over, lambda x: body(scope.bind(node["each"], x)))
    if node["kind"] == "filter":
        return F.filter(over, lambda x: body(scope.bind(node["each"], x)))
    return F.aggregate(over, expression(node["from"], scope), lambda acc, x: body(scope.bind(node["acc"], acc).bind(node["each"], x)))


def outcome(kind: str, node: str | None = None, value: Column | None = None) -> Column:
    text = value.cast("string") if value is not None else F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("kind"), F.lit(node).cast("string").alias("node"), text.alias("value"))


def compile_graph(graph: dict[str, dict], entry: str, scope: Scope, settled: dict[str, Column]) -> Column:
    """The outcome struct (kind, node, value) of a graph; ``settled`` tells which operations have results."""

    def emit(at: str, own: Scope, came_from: str) -> Column:
        node = graph[at]
        kind = node["kind"]
        if kind in ("op", "call"):
            need = outcome("need_operation" if kind == "op" else "need_call", at, expression(node["input"], own))
            return F.when(settled[at], emit(node["next"], own, at)).when(present(node["input"], own), need).otherwise(outcome("fault", at))
        if kind == "let":
            return F.when(present(node["value"], own), emit(node["next"], own.bind(node["name"], expression(node["value"], own)), at)).otherwise(outcome("fault", at))
        if kind in ("map", "filter", "fold"):
            fits = present(node["over"], own)
            if kind == "filter":  # a predicate that is neither true nor false is a fault
                fits = fits & ~F.coalesce(F.exists(expression(node["over"], own), lambda x: expression(node["body"], own.bind(node["each"], x)).isNull()), F.lit(False))
            return F.when(fits, emit(node["next"], own.bind(node["name"], loop(node, own)), at)).otherwise(outcome("fault", at))
        if kind == "if":
            on = expression(node["on"], own)
            return F.when(on.isNull(), outcome("fault", at)).when(on, emit(node["then"], own, at)).otherwise(emit(node["else"], own, at))
        if kind == "case":
            on = expression(node["on"], own)
            arms = F.when(on.isNull(), outcome("fault", at))
            for value, to in node["arms"]:
                arms = arms.when(on == F.lit(value), emit(to, own, at))
            return arms.otherwise(emit(node["default"], own, at))
        if kind == "merge":
            taken = node["from"][came_from]
            return F.when(present(taken, own), emit(node["next"], own.bind(node["name"], expression(taken, own)), at)).otherwise(outcome("fault", at))
        if kind == "return":
            return F.when(present(node["value"], own), outcome("completed", at, expression(node["value"], own))).otherwise(outcome("fault", at))
        if kind == "fail":
            reason = expression(node["reason"], own).cast("string")
            fits = reason.isNotNull() & (F.octet_length(reason) <= REASON_BYTES) & (F.length(reason) > 0)
            return F.when(fits, outcome("fail", at, reason)).otherwise(outcome("fail", at, F.lit("invalid_fail_reason")))
        raise ValueError(f"unknown node {kind}")

    return emit(entry, scope, "")


#: An order's workflow: reserve by kind, decide, then ship or fail.
CHECKOUT = {
    "n0": {"kind": "case", "on": ("arg", ["priority"]), "arms": [("1-URGENT", "n1"), ("2-HIGH", "n2")], "default": "n3"},
    "n1": {"kind": "op", "name": "reserve_fast", "input": ("arg", ["key"]), "next": "n4"},
    "n2": {"kind": "op", "name": "reserve", "input": ("arg", ["key"]), "next": "n4"},
    "n3": {"kind": "let", "name": "none", "value": ("const", "standard"), "next": "n5"},
    "n4": {"kind": "merge", "name": "picked", "from": {"n1": ("result", "n1", []), "n2": ("result", "n2", [])}, "next": "n6"},
    "n5": {"kind": "fail", "reason": ("local", "none", [])},
    "n6": {"kind": "op", "name": "decide", "input": ("local", "picked", []), "next": "n7"},
    "n7": {"kind": "if", "on": ("arg", ["rich"]), "then": "n8", "else": "n9"},
    "n8": {"kind": "return", "value": ("local", "picked", [])},
    "n9": {"kind": "fail", "reason": ("arg", ["reason"])},
}


def _instances(fx: Fixtures) -> DataFrame:
    """Arguments of every order's workflow, and the results that it has."""
    done = fx.operation.where("status = 2").groupBy("workflow_id").agg(F.max(F.when(F.col("operation_seq") == 1, F.col("part_id"))).alias("r1"), F.max(F.when(F.col("operation_seq") == 2, F.col("part_id"))).alias("r2"), F.max(F.when(F.col("operation_seq") == 3, F.col("part_id"))).alias("r3"))
    rich = F.when(F.col("owner_id") % 7 != 0, F.col("owner_id") % 2 == 0)
    return fx.workflow.select("workflow_id", F.col("script_name").alias("priority"), "owner_id", rich.alias("rich"), "terminal_reason").join(done, "workflow_id", "left")


_INSTANCES_SQL = """WITH done AS (SELECT workflow_id, max(CASE WHEN operation_seq = 1 THEN part_id END) AS r1, max(CASE WHEN operation_seq = 2 THEN part_id END) AS r2, max(CASE WHEN operation_seq = 3 THEN part_id END) AS r3 FROM {operation} WHERE status = 2 GROUP BY workflow_id),
inst AS (SELECT w.workflow_id, w.script_name AS priority, w.owner_id, CASE WHEN w.owner_id % 7 <> 0 THEN w.owner_id % 2 = 0 END AS rich, w.terminal_reason, d.r1, d.r2, d.r3 FROM {workflow} w LEFT JOIN done d ON d.workflow_id = w.workflow_id)"""


@query(
    "advance_outcome",
    _INSTANCES_SQL
    + """, picked AS (SELECT *, CASE priority WHEN '1-URGENT' THEN r1 WHEN '2-HIGH' THEN r2 END AS p, CASE priority WHEN '1-URGENT' THEN 'n1' WHEN '2-HIGH' THEN 'n2' END AS pn FROM inst)
SELECT workflow_id, CASE WHEN pn IS NULL THEN 'fail' WHEN p IS NULL THEN 'need_operation' WHEN r3 IS NULL THEN 'need_operation' WHEN rich IS NULL THEN 'fault' WHEN rich THEN 'completed' ELSE 'fail' END AS kind,
  CASE WHEN pn IS NULL THEN 'n5' WHEN p IS NULL THEN pn WHEN r3 IS NULL THEN 'n6' WHEN rich IS NULL THEN 'n7' WHEN rich THEN 'n8' ELSE 'n9' END AS node,
  CASE WHEN pn IS NULL THEN 'standard' WHEN p IS NULL THEN CAST(workflow_id AS VARCHAR) WHEN r3 IS NULL THEN CAST(p AS VARCHAR) WHEN rich IS NULL THEN NULL WHEN rich THEN CAST(p AS VARCHAR) ELSE coalesce(terminal_reason, 'invalid_fail_reason') END AS value FROM picked""",
)
def advance_outcome(fx: Fixtures) -> DataFrame:
    """What comes next for every order's workflow."""
    scope = Scope({"priority": F.col("priority"), "key": F.col("workflow_id"), "rich": F.col("rich"), "reason": F.col("terminal_reason")}, {"n1": F.col("r1"), "n2": F.col("r2"), "n6": F.col("r3")})
    settled = {"n1": F.col("r1").isNotNull(), "n2": F.col("r2").isNotNull(), "n6": F.col("r3").isNotNull()}
    rows = _instances(fx)
    return rows.select("workflow_id", compile_graph(CHECKOUT, "n0", scope, settled).alias("o")).select("workflow_id", "o.kind", "o.node", "o.value")


def _scope() -> Scope:
    return Scope({"id": F.col("workflow_id"), "priority": F.col("priority"), "who": F.struct(F.col("owner_id").alias("id"), F.col("rich").alias("rich"))}, {"n1": F.struct(F.col("r1").alias("part"))})


def _each(name: str, e: tuple, oracle: str) -> None:
    @query(f"expr_{name}", f"{_INSTANCES_SQL} SELECT workflow_id, {oracle} AS value FROM inst")
    def build(fx: Fixtures) -> DataFrame:
        return _instances(fx).select("workflow_id", expression(e, _scope()).alias("v")).select("workflow_id", F.col("v").cast("string").alias("value") if e[0] not in ("object", "array") else F.to_json("v").alias("value"))


_each("const", ("const", "fixed"), "'fixed'")
_each("project", ("arg", ["who", "id"]), "CAST(owner_id AS VARCHAR)")
_each("result", ("result", "n1", ["part"]), "CAST(r1 AS VARCHAR)")
_each("object", ("object", {"id": ("arg", ["id"]), "p": ("arg", ["priority"])}), "'{{\"id\":' || workflow_id || ',\"p\":\"' || priority || '\"}}'")
_each("array", ("array", [("arg", ["id"]), ("const", 0)]), "'[' || workflow_id || ',0]'")


def _graph_query(name: str, graph: dict[str, dict], oracle: str) -> None:
    @query(f"expr_{name}", f"{_INSTANCES_SQL} {oracle}")
    def build(fx: Fixtures) -> DataFrame:
        own = Scope({"id": F.col("workflow_id"), "priority": F.col("priority"), "rich": F.col("rich"), "reason": F.col("terminal_reason"), "part": F.col("r1")})
        return _instances(fx).select("workflow_id", compile_graph(graph, "n0", own, {}).alias("o")).select("workflow_id", "o.kind", "o.value")


_graph_query("let", {"n0": {"kind": "let", "name": "x", "value": ("arg", ["part"]), "next": "n1"}, "n1": {"kind": "return", "value": ("local", "x", [])}}, "SELECT workflow_id, CASE WHEN r1 IS NULL THEN 'fault' ELSE 'completed' END AS kind, CAST(r1 AS VARCHAR) AS value FROM inst")
_graph_query("if", {"n0": {"kind": "if", "on": ("arg", ["rich"]), "then": "n1", "else": "n2"}, "n1": {"kind": "return", "value": ("const", "rich")}, "n2": {"kind": "return", "value": ("const", "poor")}}, "SELECT workflow_id, CASE WHEN rich IS NULL THEN 'fault' ELSE 'completed' END AS kind, CASE WHEN rich THEN 'rich' WHEN NOT rich THEN 'poor' END AS value FROM inst")
_graph_query("case", {"n0": {"kind": "case", "on": ("arg", ["priority"]), "arms": [("1-URGENT", "n1"), ("2-HIGH", "n2")], "default": "n3"}, "n1": {"kind": "return", "value": ("const", "1")}, "n2": {"kind": "return", "value": ("const", "2")}, "n3": {"kind": "return", "value": ("const", "other")}}, "SELECT workflow_id, 'completed' AS kind, CASE priority WHEN '1-URGENT' THEN '1' WHEN '2-HIGH' THEN '2' ELSE 'other' END AS value FROM inst")
_graph_query("merge", {"n0": {"kind": "if", "on": ("arg", ["rich"]), "then": "n1", "else": "n2"}, "n1": {"kind": "let", "name": "a", "value": ("const", "A"), "next": "n3"}, "n2": {"kind": "let", "name": "b", "value": ("arg", ["priority"]), "next": "n3"}, "n3": {"kind": "merge", "name": "m", "from": {"n1": ("local", "a", []), "n2": ("local", "b", [])}, "next": "n4"}, "n4": {"kind": "return", "value": ("local", "m", [])}}, "SELECT workflow_id, CASE WHEN rich IS NULL THEN 'fault' ELSE 'completed' END AS kind, CASE WHEN rich THEN 'A' WHEN NOT rich THEN priority END AS value FROM inst")
_graph_query("unsettled", {"n0": {"kind": "return", "value": ("object", {"part": ("arg", ["part"]), "id": ("arg", ["id"])})}}, "SELECT workflow_id, CASE WHEN r1 IS NULL THEN 'fault' ELSE 'completed' END AS kind, CASE WHEN r1 IS NOT NULL THEN '{{' || workflow_id || ', ' || r1 || '}}' END AS value FROM inst")
_graph_query("optional", {"n0": {"kind": "let", "name": "x", "value": ("optional", ("arg", ["part"])), "next": "n1"}, "n1": {"kind": "return", "value": ("optional", ("local", "x", []))}}, "SELECT workflow_id, 'completed' AS kind, CAST(r1 AS VARCHAR) AS value FROM inst")
_graph_query("fail", {"n0": {"kind": "fail", "reason": ("arg", ["reason"])}}, "SELECT workflow_id, 'fail' AS kind, coalesce(terminal_reason, 'invalid_fail_reason') AS value FROM inst")


def _items(fx: Fixtures) -> DataFrame:
    """Orders with their items in order, as loop inputs; orders without items have an empty array."""
    items = fx.operation.groupBy("workflow_id").agg(F.array_sort(F.collect_list(F.struct("operation_seq", "part_id", (F.col("status") == 2).alias("keep")))).alias("items"))
    empty = F.expr("CAST(array() AS array<struct<operation_seq: int, part_id: bigint, keep: boolean>>)")
    return fx.workflow.select("workflow_id").join(items, "workflow_id", "left").withColumn("items", F.coalesce("items", empty))


def _loop(fx: Fixtures, node: dict) -> DataFrame:
    return _items(fx).select("workflow_id", loop(node, Scope({"items": F.col("items")})).alias("v"))


_LOOP_SQL = "SELECT w.workflow_id, coalesce(string_agg(CAST({0} AS VARCHAR), ',' ORDER BY o.operation_seq) {1}, '') AS value FROM {{workflow}} w LEFT JOIN {{operation}} o ON o.workflow_id = w.workflow_id GROUP BY w.workflow_id"


@query("loop_map", _LOOP_SQL.format("o.part_id", ""))
def loop_map(fx: Fixtures) -> DataFrame:
    rows = _loop(fx, {"kind": "map", "over": ("arg", ["items"]), "each": "c", "body": ("local", "c", ["part_id"])})
    return rows.select("workflow_id", F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("value"))


@query("loop_filter", _LOOP_SQL.format("o.operation_seq", "FILTER (WHERE o.status = 2)"))
def loop_filter(fx: Fixtures) -> DataFrame:
    """The original elements whose body holds."""
    rows = _loop(fx, {"kind": "filter", "over": ("arg", ["items"]), "each": "c", "body": ("local", "c", ["keep"])})
    return rows.select("workflow_id", F.array_join(F.transform("v", lambda x: x["operation_seq"].cast("string")), ",").alias("value"))


@query("filter_fault", "SELECT w.workflow_id, CASE WHEN count(*) FILTER (WHERE o.workflow_id IS NOT NULL AND o.result IS NULL) > 0 THEN 'fault' ELSE 'completed' END AS kind, CASE WHEN count(*) FILTER (WHERE o.workflow_id IS NOT NULL AND o.result IS NULL) = 0 THEN CAST('[' || coalesce(string_agg(CAST(o.part_id AS VARCHAR), ', ' ORDER BY o.operation_seq) FILTER (WHERE o.result % 2 = 0), '') || ']' AS VARCHAR) END AS value FROM {workflow} w LEFT JOIN {operation} o ON o.workflow_id = w.workflow_id GROUP BY w.workflow_id")
def filter_fault(fx: Fixtures) -> DataFrame:
    """The parts of a workflow with an even result; a result that is not there yet leaves the predicate open, which is a fault."""
    items = fx.operation.groupBy("workflow_id").agg(F.array_sort(F.collect_list(F.struct("operation_seq", "part_id", (F.col("result") % 2 == 0).alias("even")))).alias("items"))
    empty = F.expr("CAST(array() AS array<struct<operation_seq: int, part_id: bigint, even: boolean>>)")
    graph = {
        "n0": {"kind": "filter", "name": "kept", "over": ("arg", ["items"]), "each": "c", "body": ("local", "c", ["even"]), "next": "n1"},
        "n1": {"kind": "map", "name": "parts", "over": ("local", "kept", []), "each": "c", "body": ("local", "c", ["part_id"]), "next": "n2"},
        "n2": {"kind": "return", "value": ("local", "parts", [])},
    }
    rows = fx.workflow.select("workflow_id").join(items, "workflow_id", "left").withColumn("items", F.coalesce("items", empty))
    return rows.select("workflow_id", compile_graph(graph, "n0", Scope({"items": F.col("items")}), {}).alias("o")).select("workflow_id", "o.kind", "o.value")


@query("loop_fold", "SELECT w.workflow_id, arg_max(o.part_id, o.operation_seq) AS value FROM {workflow} w LEFT JOIN {operation} o ON o.workflow_id = w.workflow_id GROUP BY w.workflow_id")
def loop_fold(fx: Fixtures) -> DataFrame:
    """An accumulator from null to the last element; nothing to fold leaves the initial value."""
    over = _items(fx).withColumn("parts", F.transform("items", lambda x: x["part_id"]))
    node = {"kind": "fold", "over": ("arg", ["parts"]), "from": ("arg", ["none"]), "acc": "last", "each": "c", "body": ("local", "c", [])}
    return over.select("workflow_id", loop(node, Scope({"parts": F.col("parts"), "none": F.lit(None).cast("long")})).alias("value"))
