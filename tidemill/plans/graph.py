"""Plan graphs as rows: edges of many graphs at once, checked together.

A plan's own nodes are few, but plans are many; so structure checks run over an
edge table (plan, source, target).  A plan of at most ``LIMIT`` edges is packed into
one row and walked there, each edge once, so the work grows with the edges.  Larger
plans are walked by joins, a step of all of them at a time, so no task holds one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.plans.catalog import query
from tidemill.sources.fixtures import Fixtures
from tidemill.sources.scratch import written

#: Edges of a plan that is walked in one row.
LIMIT = 4096
#: Customers whose plans a task derives, so that its memory stays the same however many there are.
DEALT = 20_000


def plans(fx: Fixtures) -> DataFrame:
    """(plan, source, target): a plan for each customer, a chain of nodes 1 to n with branches.

    Plans with a number divisible by 13 loop back, those divisible by 17 have an edge
    to a node that does not exist.  Customers are dealt out before they become edges, as
    a small file of them is read by few tasks, and to more tasks the more there are.
    """
    sized = fx.customer.select(F.col("c_custkey").cast("long").alias("plan"), (3 + F.col("c_custkey") % 19).cast("long").alias("n"))
    tasks = max(int(fx.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(fx.customer.count() / DEALT))
    sized = sized.repartition(tasks, "plan")
    edge = lambda source, target: f"named_struct('source', {source}, 'target', {target})"
    also = lambda when, source, target: f"if({when}, array({edge(source, target)}), array())"
    chain = f"if(n > 1, transform(sequence(1L, greatest(n - 1, 1L)), s -> {edge('s', 's + 1')}), array())"
    edges = ", ".join([chain, also("plan % 2 = 0", "1L", "3L"), also("plan % 13 = 0", "n", "2L"), also("plan % 17 = 0", "2L", "99L")])
    return sized.select("plan", F.explode(F.expr(f"concat({edges})")).alias("edge")).select("plan", "edge.source", "edge.target")


_PLANS_SQL = """sized AS (SELECT CAST(c_custkey AS BIGINT) AS plan, CAST(3 + c_custkey % 19 AS BIGINT) AS n FROM customer),
edges AS (SELECT plan, s AS source, s + 1 AS target FROM (SELECT plan, unnest(range(1, n)) AS s FROM sized)
UNION ALL SELECT plan, 1, 3 FROM sized WHERE plan % 2 = 0 UNION ALL SELECT plan, n, 2 FROM sized WHERE plan % 13 = 0 UNION ALL SELECT plan, 2, 99 FROM sized WHERE plan % 17 = 0)"""


def closure(edges: DataFrame) -> DataFrame:
    """(plan, source, target): which nodes a node leads to, by squaring: for graphs whose paths are few, as of scripts."""
    on = ["plan", "source", "target"]
    now, seen = written(edges.select(on).distinct(), "paths"), None
    while True:
        ahead = now.select("plan", F.col("source").alias("middle"), F.col("target").alias("end"))
        longer = now.withColumnRenamed("target", "middle").join(ahead, ["plan", "middle"])
        now = written(now.unionByName(longer.select("plan", "source", F.col("end").alias("target"))).distinct(), "paths")
        sign = now.count()
        if sign == seen:
            return now
        seen = sign


def _by_source(sources: Sequence[int], targets: Sequence[int]) -> dict[int, list[int]]:
    after: dict[int, list[int]] = {}
    for source, target in zip(sources, targets, strict=True):
        after.setdefault(source, []).append(target)
    return after


def ways(sources: Sequence[int], targets: Sequence[int]) -> dict[int, tuple[int, int]] | None:
    """Longest and shortest way from node 1 to each node, itself at 0; None if there is a cycle."""
    after, before, left = _by_source(sources, targets), {}, len(sources)
    for target in targets:
        before[target] = before.get(target, 0) + 1
    ready, found = [node for node in after if node not in before], {1: (0, 0)}
    while ready:
        node = ready.pop()
        here = found.get(node)
        for target in after.get(node, ()):
            left, before[target] = left - 1, before[target] - 1
            if here:
                longest, shortest = found.get(target, here)
                found[target] = (max(longest, here[0] + 1), min(shortest, here[1] + 1) if target in found else here[1] + 1)
            if not before[target]:
                ready.append(target)
    return None if left else found


def reached(sources: Sequence[int], targets: Sequence[int]) -> set[int]:
    """Node 1 and all that it leads to."""
    after, found, ahead = _by_source(sources, targets), {1}, [1]
    while ahead:
        new = [target for target in after.get(ahead.pop(), ()) if target not in found]
        found.update(new)
        ahead += new
    return found


def _over(graph: Callable, kind: str) -> Callable[[Column, Column], Column]:
    """A function of a graph's sources and targets as one of columns; ``kind`` is the type of its results."""

    @F.arrow_udf(kind)
    def run(sources: pa.Array, targets: pa.Array) -> pa.Array:
        s, t, at = sources.flatten().to_numpy().tolist(), targets.flatten().to_numpy().tolist(), [0]
        for n in sources.value_lengths().to_pylist():
            at.append(at[-1] + n)
        return graph(((s[a:b], t[a:b]) for a, b in zip(at, at[1:])))

    return run


def _all_ways(graphs) -> pa.Array:
    at, nodes, longest, shortest = [0], [], [], []
    for sources, targets in graphs:
        found = ways(sources, targets) or {}
        nodes += found.keys()
        longest += (way[0] for way in found.values())
        shortest += (way[1] for way in found.values())
        at.append(len(nodes))
    rows = pa.StructArray.from_arrays([pa.array(nodes, pa.int64()), pa.array(longest, pa.int32()), pa.array(shortest, pa.int32())], ["node", "longest", "shortest"])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), rows)


def _split(edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(plan, sources, targets) of the plans of at most ``limit`` edges, and the edges of the others, if there are any; an edge without an end leads nowhere."""
    edges = edges.select("plan", "source", "target").dropna()
    large = written(edges.groupBy("plan").count().where(F.col("count") > limit).select("plan"), "large")
    rest = None
    if not large.isEmpty():
        rest = written(edges.join(large, "plan", "left_semi").distinct(), "large-edges")
        edges = edges.join(large, "plan", "left_anti")
    packed = edges.groupBy("plan").agg(F.collect_list(F.struct("source", "target")).alias("edges"))
    return packed.select("plan", F.col("edges.source").alias("sources"), F.col("edges.target").alias("targets")), rest


def _left_in_cycles(edges: DataFrame) -> DataFrame:
    """Edges that are left when those without a predecessor are taken away again and again: none, if there is no cycle."""
    n = edges.count()
    while True:
        edges = written(edges.join(edges.select("plan", F.col("target").alias("source")).distinct(), ["plan", "source"], "left_semi"), "uncut")
        now = edges.count()
        if now in (0, n):
            return edges
        n = now


def _steps(edges: DataFrame, again: bool) -> DataFrame:
    """(plan, node, hops): nodes by the number of steps from node 1, itself at 0; with ``again`` for each way's length, else for the shortest."""
    level = edges.select("plan", F.lit(1).cast("long").alias("node"), F.lit(0).alias("hops")).distinct()
    found, hops = level, 0
    while True:
        hops += 1
        level = level.join(edges.withColumnRenamed("source", "node"), ["plan", "node"]).select("plan", F.col("target").alias("node"), F.lit(hops).alias("hops")).distinct()
        level = written(level if again else level.join(found, ["plan", "node"], "left_anti"), "steps")
        if level.isEmpty():
            return found
        found = found.unionByName(level)


def cyclic(edges: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(plan): plans with a node that leads back to itself."""
    packed, rest = _split(edges, limit)
    looped = _over(lambda graphs: pa.array([ways(*graph) is None for graph in graphs], pa.bool_()), "boolean")
    found = packed.where(looped("sources", "targets")).select("plan")
    return found if rest is None else found.unionByName(_left_in_cycles(rest).select("plan").distinct())


def from_entry(edges: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(plan, node, longest, shortest): the ways from node 1 to every node of the acyclic plans, itself at 0."""
    packed, rest = _split(edges, limit)
    walked = _over(_all_ways, "array<struct<node: bigint, longest: int, shortest: int>>")
    found = packed.select("plan", F.explode(walked("sources", "targets")).alias("way")).select("plan", "way.node", "way.longest", "way.shortest")
    if rest is None:
        return found
    sound = written(rest.join(_left_in_cycles(rest).select("plan").distinct(), "plan", "left_anti"), "sound")
    return found.unionByName(_steps(sound, True).groupBy("plan", "node").agg(F.max("hops").alias("longest"), F.min("hops").alias("shortest")))


def from_first(edges: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(plan, n): how many nodes node 1 leads to, itself included, in the plans with an edge from it."""
    packed, rest = _split(edges, limit)
    counted = _over(lambda graphs: pa.array([len(reached(*graph)) for graph in graphs], pa.int64()), "bigint")
    found = packed.where(F.array_contains("sources", F.lit(1).cast("long"))).select("plan", counted("sources", "targets").alias("n"))
    if rest is None:
        return found
    begun = rest.join(rest.where("source = 1").select("plan").distinct(), "plan", "left_semi")
    return found.unionByName(_steps(begun, False).groupBy("plan").agg(F.count(F.lit(1)).alias("n")))


@query("graph_dangling", f"WITH {_PLANS_SQL} SELECT e.plan, e.source, e.target FROM edges e JOIN sized s ON s.plan = e.plan WHERE e.target > s.n")
def graph_dangling(fx: Fixtures) -> DataFrame:
    """Edges to nodes that a plan does not have; merged, as Spark takes the nodes for few and would broadcast them all."""
    edges = plans(fx)
    nodes = edges.select("plan", F.col("source").alias("target")).unionByName(fx.customer.select(F.col("c_custkey").cast("long").alias("plan"), (3 + F.col("c_custkey") % 19).cast("long").alias("target")))
    return edges.join(nodes.hint("merge"), ["plan", "target"], "left_anti").select("plan", "source", "target")


@query("graph_duplicate", f"WITH {_PLANS_SQL} SELECT plan, source, count(*) AS n FROM edges GROUP BY plan, source HAVING count(*) > 1")
def graph_branches(fx: Fixtures) -> DataFrame:
    """Nodes with more than one way out."""
    return plans(fx).groupBy("plan", "source").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(
    "graph_cycle",
    f"WITH RECURSIVE {_PLANS_SQL}, w AS (SELECT plan, source, target FROM edges UNION SELECT w.plan, w.source, e.target FROM w JOIN edges e ON e.plan = w.plan AND e.source = w.target) SELECT DISTINCT plan FROM w WHERE source = target",
)
def graph_cycle(fx: Fixtures) -> DataFrame:
    """Plans in which some node leads back to itself."""
    return cyclic(plans(fx))


_ACYCLIC_SQL = f"""WITH RECURSIVE {_PLANS_SQL}, c AS (SELECT plan, source, target FROM edges UNION SELECT c.plan, c.source, e.target FROM c JOIN edges e ON e.plan = c.plan AND e.source = c.target), sound AS (SELECT plan FROM sized WHERE plan NOT IN (SELECT plan FROM c WHERE source = target)),
w AS (SELECT plan, CAST(1 AS BIGINT) AS node, 0 AS depth FROM sound UNION SELECT w.plan, e.target, w.depth + 1 FROM w JOIN edges e ON e.plan = w.plan AND e.source = w.node)"""


@query("graph_depth", f"{_ACYCLIC_SQL} SELECT plan, CAST(max(depth) AS INT) AS longest, CAST(min(CASE WHEN node = 3 THEN depth END) AS INT) AS to_third FROM w GROUP BY plan")
def graph_depth(fx: Fixtures) -> DataFrame:
    """Longest path of each acyclic plan, and the shortest way to its third node."""
    found = from_entry(plans(fx))
    return found.groupBy("plan").agg(F.max("longest").alias("longest"), F.min(F.when(F.col("node") == 3, F.col("shortest"))).alias("to_third"))


@query("graph_reach", f"WITH RECURSIVE {_PLANS_SQL}, w AS (SELECT plan, CAST(1 AS BIGINT) AS node FROM edges WHERE source = 1 AND source <> 2 UNION SELECT e.plan, e.target FROM w JOIN edges e ON e.plan = w.plan AND e.source = w.node WHERE e.source <> 2) SELECT plan, count(*) AS reached FROM w GROUP BY plan")
def graph_dominated(fx: Fixtures) -> DataFrame:
    """How many nodes are reached without passing node 2: what it does not dominate."""
    return from_first(plans(fx).where("source <> 2")).select("plan", F.col("n").alias("reached"))


@query(
    "call_cycle",
    "WITH RECURSIVE calls AS (SELECT DISTINCT p.script_name AS caller, h.script_name AS callee FROM {call} c JOIN {workflow} p ON p.workflow_id = c.workflow_id JOIN {workflow} h ON h.workflow_id = c.child_id), w AS (SELECT caller AS origin, callee AS reached FROM calls UNION SELECT w.origin, c.callee FROM w JOIN calls c ON c.caller = w.reached) SELECT origin AS script_name FROM w WHERE origin = reached",
)
def call_cycle(fx: Fixtures) -> DataFrame:
    """Scripts that may come to call themselves, through any others."""
    names = fx.workflow.select("workflow_id", "script_name")
    calls = fx.call.select("workflow_id", "child_id").join(names, "workflow_id").select("child_id", F.col("script_name").alias("source"))
    calls = calls.join(names.select(F.col("workflow_id").alias("child_id"), F.col("script_name").alias("target")), "child_id")
    found = closure(calls.select(F.lit(0).alias("plan"), "source", "target").distinct())
    return found.where("source = target").select(F.col("source").alias("script_name")).distinct()


@query("graph_order", f"{_ACYCLIC_SQL} SELECT plan, node, CAST(row_number() OVER (PARTITION BY plan ORDER BY max(depth), node) AS INT) AS place FROM w GROUP BY plan, node")
def graph_order(fx: Fixtures) -> DataFrame:
    """A topological order of each acyclic plan: by the longest way to a node, ties by its number."""
    far = from_entry(plans(fx))
    return far.select("plan", "node", F.row_number().over(Window.partitionBy("plan").orderBy("longest", "node")).alias("place"))
