"""Operator analytics: search, call trees, merged timelines, stuck verdicts, stalled plans, event tapes."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone, tzinfo
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.plans.catalog import query
from tidemill.sources.fixtures import HOUR, NOW_US, SECOND, Fixtures
from tidemill.sources.scratch import written

#: Fixed names of the lifecycle's codes.
STATES = {1: "forward", 2: "reversing", 3: "blocked_resolution", 4: "completed", 5: "reversed", 6: "resolved_exception", 7: "failed"}
TERMINAL = (4, 5, 6, 7)
MAX_DEPTH = 10
_STATE_SQL = "CASE {0} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in STATES.items()) + " END"


def state_name(state: Column) -> Column:
    """Name of a state's code; null for a code that does not exist."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair]), state)


def iso(us: Column) -> Column:
    """Microseconds since 1970 as text with six decimals and a Z."""
    return F.concat(F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def _iso_sql(us: str) -> str:
    return f"strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S.%fZ')"


def assert_utc(spark: SparkSession) -> None:
    """Times are rendered with a Z, so a session whose clock is not UTC is refused."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    offset = datetime.fromtimestamp(NOW_US // SECOND, timezone.utc if zone in ("UTC", "Z", "GMT") else _zone(zone)).utcoffset()
    if offset:
        raise ValueError(f"the session's clock is {offset} from UTC: set spark.sql.session.timeZone to UTC")


def _zone(name: str) -> tzinfo:
    """A zone by its name or as +hh:mm."""
    fixed = re.fullmatch(r"(?:UTC|GMT)?([+-])(\d\d?):?(\d\d)?", name)
    if fixed:
        minutes = int(fixed[2]) * 60 + int(fixed[3] or 0)
        return timezone(timedelta(minutes=-minutes if fixed[1] == "-" else minutes))
    return ZoneInfo(name)


def search(fx: Fixtures, script: str, since_us: int, until_us: int, state: str | int | None = None, version: str | None = None) -> DataFrame:
    """Workflows of a script in an inclusive range of creation times, newest first; both bounds are mandatory."""
    if not script or since_us is None or until_us is None:
        raise ValueError("a search needs a script and both bounds")
    assert_utc(fx.spark)
    keep = (F.col("script_name") == script) & F.col("created_us").between(since_us, until_us)
    if state is not None:
        code = int(state) if str(state).isdigit() else {v: k for k, v in STATES.items()}.get(state)
        if code not in STATES:
            raise ValueError(f"unknown state {state}")
        keep &= F.col("state") == code
    rows = fx.workflow.where(keep).join(fx.plan.select("workflow_id", "plan_version"), "workflow_id", "left")
    if version is not None:
        rows = rows.where(F.col("plan_version") == version)
    rows = rows.select("workflow_id", "script_name", "state", state_name(F.col("state")).alias("state_name"), "execution_direction", "current_disposition", "plan_version", iso(F.col("created_us")).alias("created"), iso(F.col("next_attempt_us")).alias("next_attempt"), "terminal_reason", "parent_id", "root_id")
    return rows.orderBy(F.desc("created"), "workflow_id")


_SINCE, _UNTIL = NOW_US - 20_000 * HOUR, NOW_US + 20_000 * HOUR
_SEARCH_SQL = f"""SELECT w.workflow_id, w.script_name, w.state, {_STATE_SQL.format("w.state")} AS state_name, w.execution_direction, w.current_disposition, p.plan_version, {_iso_sql("w.created_us")} AS created, {_iso_sql("w.next_attempt_us")} AS next_attempt, w.terminal_reason, w.parent_id, w.root_id
FROM {{workflow}} w LEFT JOIN {{plan}} p ON p.workflow_id = w.workflow_id WHERE w.script_name = '1-URGENT' AND w.created_us BETWEEN {_SINCE} AND {_UNTIL}"""


@query("list_workflows", _SEARCH_SQL + " ORDER BY created DESC, w.workflow_id")
def list_workflows(fx: Fixtures) -> DataFrame:
    return search(fx, "1-URGENT", _SINCE, _UNTIL)


@query("list_by_state", _SEARCH_SQL + " AND w.state = 3")
def list_by_state(fx: Fixtures) -> DataFrame:
    return search(fx, "1-URGENT", _SINCE, _UNTIL, state="blocked_resolution")


@query("list_by_version", _SEARCH_SQL + " AND p.plan_version = '1.1.0'")
def list_by_version(fx: Fixtures) -> DataFrame:
    return search(fx, "1-URGENT", _SINCE, _UNTIL, version="1.1.0")


def descend(fx: Fixtures, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(root, workflow_id, depth, path, truncated, cycle): every workflow under every root.

    One join per level; it ends where no call goes deeper, at max_depth, or where a
    path meets itself.
    """
    w = fx.workflow.select("workflow_id", "parent_id")
    edges = w.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("caller"), F.col("workflow_id").alias("child"))
    level = w.where("parent_id IS NULL").select(F.col("workflow_id").alias("root"), "workflow_id", F.lit(0).alias("depth"), F.array("workflow_id").alias("path"), F.lit(False).alias("cycle"))
    found = level
    for depth in range(1, max_depth + 1):
        level = level.where("NOT cycle").join(edges, F.col("workflow_id") == F.col("caller")).select("root", F.col("child").alias("workflow_id"), F.lit(depth).alias("depth"), F.concat("path", F.array("child")).alias("path"), F.array_contains("path", F.col("child")).alias("cycle"))
        if max_depth > 3:
            level = written(level, "call-levels")
            if level.isEmpty():
                break
        found = found.unionByName(level)
    parents = edges.select(F.col("caller").alias("workflow_id")).distinct().withColumn("_more", F.lit(True))
    return found.join(parents, "workflow_id", "left").select("root", "workflow_id", "depth", "path", (F.coalesce("_more", F.lit(False)) & (F.col("depth") == max_depth)).alias("truncated"), "cycle")


_TREE = """WITH RECURSIVE nodes AS (
  SELECT workflow_id AS root, workflow_id, CAST(0 AS INT) AS depth, [workflow_id] AS path FROM {{workflow}} WHERE parent_id IS NULL
  UNION ALL
  SELECT n.root, w.workflow_id, CAST(n.depth + 1 AS INT), list_append(n.path, w.workflow_id) FROM nodes n JOIN {{workflow}} w ON w.parent_id = n.workflow_id WHERE n.depth < {depth}
)"""


@query("tree", _TREE.format(depth=2) + " SELECT root, workflow_id, depth, array_to_string(path, '/') AS path, false AS truncated FROM nodes")
def tree(fx: Fixtures) -> DataFrame:
    return descend(fx, 2).select("root", "workflow_id", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"), "truncated")


@query(
    "tree_truncated",
    _TREE.format(depth=1) + " SELECT root, n.workflow_id, depth, depth = 1 AND EXISTS (SELECT 1 FROM {workflow} w WHERE w.parent_id = n.workflow_id) AS truncated FROM nodes n",
)
def tree_truncated(fx: Fixtures) -> DataFrame:
    return descend(fx, 1).select("root", "workflow_id", "depth", "truncated")


@query(
    "timeline",
    _TREE.format(depth=2)
    + " SELECT n.root, e.event_us, e.workflow_id, e.kind, n.depth, w.script_name, CAST(row_number() OVER (PARTITION BY n.root ORDER BY e.event_us, e.workflow_id, e.event_id) AS INT) AS place FROM nodes n JOIN {event} e ON e.workflow_id = n.workflow_id JOIN {workflow} w ON w.workflow_id = n.workflow_id",
)
def timeline(fx: Fixtures) -> DataFrame:
    """Events of a whole tree in one order, each with its node's depth and script."""
    nodes = descend(fx, 2).select("root", "workflow_id", "depth").join(fx.workflow.select("workflow_id", "script_name"), "workflow_id")
    merged = nodes.join(fx.event, "workflow_id")
    place = F.row_number().over(Window.partitionBy("root").orderBy("event_us", "workflow_id", "event_id"))
    return merged.select("root", "event_us", "workflow_id", "kind", "depth", "script_name", place.alias("place"))


def attention(rows: DataFrame, status: Column) -> DataFrame:
    """Operations or checkpoints that may hold a workflow up."""
    return rows.where(status | (F.col("reconcile_attempts") > 0) | F.col("reconcile_first_us").isNotNull() | (F.col("redispatch_count") > 0) | F.col("redispatch_first_us").isNotNull())


_CARRIERS = "reconcile_attempts > 0 OR reconcile_first_us IS NOT NULL OR redispatch_count > 0 OR redispatch_first_us IS NOT NULL"


@query(
    "attention_rows",
    f"""SELECT workflow_id, 'operation' AS kind, operation_seq AS seq, reconcile_attempts, redispatch_count FROM {{operation}} WHERE status = 1 OR {_CARRIERS}
UNION ALL SELECT workflow_id, 'checkpoint', seq, reconcile_attempts, redispatch_count FROM {{checkpoint}} WHERE reversal_state <> 1 OR {_CARRIERS}""",
)
def attention_rows(fx: Fixtures) -> DataFrame:
    ops = attention(fx.operation, F.col("status") == 1).select("workflow_id", F.lit("operation").alias("kind"), F.col("operation_seq").alias("seq"), "reconcile_attempts", "redispatch_count")
    cps = attention(fx.checkpoint, F.col("reversal_state") != 1).select("workflow_id", F.lit("checkpoint").alias("kind"), "seq", "reconcile_attempts", "redispatch_count")
    return ops.unionByName(cps)


def _own_verdicts(fx: Fixtures, now_us: int) -> DataFrame:
    """Each workflow's verdict by itself, and the first child in call order that is not terminal."""
    flags = [((F.col("redispatch_count") > 0) | F.col("redispatch_first_us").isNotNull()).alias("redispatch"), ((F.col("reconcile_attempts") > 0) | F.col("reconcile_first_us").isNotNull()).alias("reconcile")]
    carriers = fx.operation.select("workflow_id", *flags).unionByName(fx.checkpoint.select("workflow_id", *flags)).where("redispatch OR reconcile")
    carriers = carriers.groupBy("workflow_id").agg(F.max("redispatch").alias("redispatch"), F.max("reconcile").alias("reconcile"))
    child_state = fx.workflow.select(F.col("workflow_id").alias("child_id"), F.col("state").alias("child_state"))
    open_child = fx.call.select("workflow_id", "operation_seq", "child_id").join(child_state, "child_id").where(~F.col("child_state").isin(*TERMINAL))
    first = open_child.groupBy("workflow_id").agg(F.min_by("child_id", F.struct("operation_seq", "child_id")).alias("next_id"))
    df = fx.workflow.join(carriers, "workflow_id", "left").join(first, "workflow_id", "left")
    verdict = (
        F.when(F.col("state").isin(*TERMINAL), "terminal")
        .when(F.col("state") == 3, "blocked_resolution")
        .when(F.col("lease_owner").isNotNull() & (F.col("lease_expires_us") > now_us), "running_under_lease")
        .when(F.col("next_id").isNotNull(), "waiting_on_child")
        .when(F.coalesce("redispatch", F.lit(False)), "redispatch_pending")
        .when(F.coalesce("reconcile", F.lit(False)), "reconcile_pending")
        .when(F.col("next_attempt_us") > now_us, "scheduled_retry")
        .otherwise("claimable_now")
    )
    return df.select("workflow_id", "script_name", "state", verdict.alias("verdict"), F.when(verdict == "waiting_on_child", F.col("next_id")).alias("next_id"))


def verdicts(fx: Fixtures, now_us: int = NOW_US, paths: bool = True) -> DataFrame:
    """Why each workflow does not move, and the path to the descendant that it waits for.

    Waiting workflows follow their first open child, hop by hop, to the deepest one;
    a path that would meet itself ends.  Each hop is one join on rows written once,
    and hops go on until none is left, however deep calls are.
    """
    own = _own_verdicts(fx, now_us)
    if not paths:
        return own.select("workflow_id", "script_name", state_name(F.col("state")).alias("state_name"), "verdict")
    own = written(own, "verdicts")
    ahead = own.select(F.col("workflow_id").alias("at"), F.col("verdict").alias("at_verdict"), F.col("next_id").alias("at_next"))
    level = own.select("workflow_id", "next_id", F.array("workflow_id").alias("path"), F.col("verdict").alias("end_verdict"), F.lit(0).alias("hop"))
    found = level.drop("next_id")
    while True:
        level = level.join(ahead, F.col("next_id") == F.col("at")).where(~F.array_contains("path", F.col("at")))
        level = level.select("workflow_id", F.col("at_next").alias("next_id"), F.concat("path", F.array("at")).alias("path"), F.col("at_verdict").alias("end_verdict"), (F.col("hop") + 1).alias("hop"))
        level = written(level, "verdict-hops")
        if level.isEmpty():
            break
        found = found.unionByName(level.drop("next_id"))
    last = found.groupBy("workflow_id").agg(F.max_by(F.struct("path", "end_verdict"), "hop").alias("last"))
    rows = own.join(last, "workflow_id")
    return rows.select("workflow_id", "script_name", state_name(F.col("state")).alias("state_name"), "verdict", "last.path", "last.end_verdict")


_VERDICT_SQL = f"""WITH RECURSIVE carry AS (
  SELECT workflow_id, bool_or(redispatch_count > 0 OR redispatch_first_us IS NOT NULL) AS redispatch, bool_or(reconcile_attempts > 0 OR reconcile_first_us IS NOT NULL) AS reconcile
  FROM (SELECT workflow_id, redispatch_count, redispatch_first_us, reconcile_attempts, reconcile_first_us FROM {{operation}} UNION ALL SELECT workflow_id, redispatch_count, redispatch_first_us, reconcile_attempts, reconcile_first_us FROM {{checkpoint}}) GROUP BY workflow_id
), child AS (
  SELECT c.workflow_id, arg_min(c.child_id, (c.operation_seq, c.child_id)) AS next_id FROM {{call}} c JOIN {{workflow}} w ON w.workflow_id = c.child_id WHERE w.state < 4 GROUP BY c.workflow_id
), own AS (
  SELECT w.workflow_id, w.script_name, w.state, n.next_id, CASE WHEN w.state >= 4 THEN 'terminal' WHEN w.state = 3 THEN 'blocked_resolution' WHEN w.lease_owner IS NOT NULL AND w.lease_expires_us > {NOW_US} THEN 'running_under_lease'
    WHEN n.next_id IS NOT NULL THEN 'waiting_on_child' WHEN c.redispatch THEN 'redispatch_pending' WHEN c.reconcile THEN 'reconcile_pending' WHEN w.next_attempt_us > {NOW_US} THEN 'scheduled_retry' ELSE 'claimable_now' END AS verdict
  FROM {{workflow}} w LEFT JOIN carry c ON c.workflow_id = w.workflow_id LEFT JOIN child n ON n.workflow_id = w.workflow_id
), walk AS (
  SELECT workflow_id, [workflow_id] AS path, verdict, next_id FROM own
  UNION ALL
  SELECT k.workflow_id, list_append(k.path, o.workflow_id), o.verdict, o.next_id FROM walk k JOIN own o ON o.workflow_id = k.next_id WHERE k.verdict = 'waiting_on_child' AND NOT list_contains(k.path, o.workflow_id)
), longest AS (
  SELECT workflow_id, arg_max(path, len(path)) AS path, arg_max(verdict, len(path)) AS end_verdict FROM walk GROUP BY workflow_id
)"""


@query("stuck", _VERDICT_SQL + f" SELECT o.workflow_id, o.script_name, {_STATE_SQL.format('o.state')} AS state_name, o.verdict FROM own o WHERE o.state < 4")
def stuck(fx: Fixtures) -> DataFrame:
    """The verdict on every workflow that is not terminal."""
    return verdicts(fx, paths=False).where("verdict <> 'terminal'")


@query("stuck_path", _VERDICT_SQL + " SELECT o.workflow_id, o.verdict, array_to_string(l.path, '/') AS path, l.end_verdict FROM own o JOIN longest l ON l.workflow_id = o.workflow_id")
def stuck_path(fx: Fixtures) -> DataFrame:
    return verdicts(fx).select("workflow_id", "verdict", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"), "end_verdict")


#: Fixed: the event and the reason that mean a workflow waits for a revision that no worker has.
STALL_KIND, STALL_REASON = "operation_dispatch_deferred", "revision_unavailable"

_STALLED_SQL = f"""SELECT w.workflow_id, w.script_name, p.plan_version, p.content_hash, p.plan_length, w.state, w.execution_direction, {_iso_sql("w.current_event_us")} AS current_event, {_iso_sql("w.next_attempt_us")} AS next_attempt, e.reason
FROM {{pointed_workflow}} w, {{plan}} p, {{reasoned_event}} e
WHERE p.workflow_id = w.workflow_id AND e.workflow_id = w.workflow_id AND e.event_us = w.current_event_us AND (w.state = 1 OR w.state = 2) AND w.lease_owner IS NULL AND e.kind LIKE 'operation_dispatch_deferred' AND e.reason LIKE 'revision_unavailable'"""


@query("stalled", _STALLED_SQL)
def stalled(fx: Fixtures) -> DataFrame:
    """Workflows that wait without a lease since their plan's revision was not to be had: their own pointer names the event that says so."""
    events = fx.reasoned_event.where((F.col("kind") == STALL_KIND) & (F.col("reason") == STALL_REASON)).select("workflow_id", F.col("event_us").alias("current_event_us"), "reason")
    waiting = fx.pointed_workflow.where(F.col("state").isin(1, 2) & F.col("lease_owner").isNull())
    rows = waiting.join(fx.plan, "workflow_id").join(events, ["workflow_id", "current_event_us"])
    return rows.select("workflow_id", "script_name", "plan_version", "content_hash", "plan_length", "state", "execution_direction", iso(F.col("current_event_us")).alias("current_event"), iso(F.col("next_attempt_us")).alias("next_attempt"), "reason")


@query("stalled_report", f"SELECT workflow_id, script_name, CAST(count(*) OVER () AS BIGINT) AS n, json_object('workflow_id', workflow_id, 'script_name', script_name, 'plan_version', plan_version, 'state', state, 'reason', reason)::VARCHAR AS item FROM ({_STALLED_SQL})")
def stalled_report(fx: Fixtures) -> DataFrame:
    """The stalled workflows as items of one report, each with the report's length; the report may be of any length."""
    rows = written(stalled(fx), "stalled")
    item = F.to_json(F.struct("workflow_id", "script_name", "plan_version", "state", "reason"))
    return rows.select("workflow_id", "script_name", F.lit(rows.count()).cast("long").alias("n"), item.alias("item")).orderBy("workflow_id")


@query("health_bounds", f"SELECT CAST({NOW_US} - 86400000000 AS BIGINT) AS since_us, CAST({NOW_US} + 1000000 AS BIGINT) AS until_us, {_iso_sql(str(NOW_US))} AS now, count(*) AS n FROM {{workflow}} WHERE created_us BETWEEN {NOW_US} - 86400000000 AND {NOW_US} + 1000000")
def health_bounds(fx: Fixtures, now_us: int = NOW_US) -> DataFrame:
    """Default bounds of a search, floored to seconds, and what falls between them."""
    floor = lambda us: us // SECOND * SECOND
    since, until = floor(now_us - 24 * HOUR), floor(now_us + SECOND)
    return fx.workflow.where(F.col("created_us").between(since, until)).agg(F.lit(since).cast("long").alias("since_us"), F.lit(until).cast("long").alias("until_us"), iso(F.lit(now_us)).alias("now"), F.count(F.lit(1)).alias("n"))


#: Fixed: audit kinds and the machine's events; kinds without an event are left out.
TAPE = {"operation_requested": "DISPATCH", "operation_settled": "SETTLED", "workflow_completed": "SETTLED_FINAL", "operation_failed": "REJECTED", "compensation_settled": "COMPENSATED", "compensation_blocked": "COMP_REJECTED", "participant_route_404": "ROUTE_404", "participant_route_unknown": "EXHAUSTED", "failed": "ALL_COMPENSATED"}
_TAPE_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TAPE.items()) + " END"


def tapes(fx: Fixtures) -> DataFrame:
    """(workflow_id, event_us, event_id, kind, event): a settlement just before completion is final."""
    following = F.lead("kind").over(Window.partitionBy("workflow_id").orderBy("event_us", "event_id"))
    mapped = F.element_at(F.create_map(*[F.lit(x) for pair in TAPE.items() for x in pair]), F.col("kind"))
    event = F.when((mapped == "SETTLED") & (following == "workflow_completed"), "SETTLED_FINAL").otherwise(mapped)
    return fx.event.withColumn("event", event).where("event IS NOT NULL").select("workflow_id", "event_us", "event_id", "kind", "event", F.get_json_object("payload", "$.k").alias("reason"))


_TAPES_SQL = f"""SELECT workflow_id, event_us, event_id, kind, CASE WHEN kind = 'operation_settled' AND following = 'workflow_completed' THEN 'SETTLED_FINAL' ELSE {_TAPE_SQL} END AS event, json_extract_string(payload, '$.k') AS reason
FROM (SELECT *, lead(kind) OVER (PARTITION BY workflow_id ORDER BY event_us, event_id) AS following FROM {{event}}) WHERE {_TAPE_SQL} IS NOT NULL"""


@query("event_tape", _TAPES_SQL)
def event_tape(fx: Fixtures) -> DataFrame:
    return tapes(fx)


#: Fixed: the machine over tape events, state -> event -> state; other events leave the state as it is.
MACHINE = {"idle": {"DISPATCH": "waiting"}, "waiting": {"SETTLED": "idle", "SETTLED_FINAL": "completed", "REJECTED": "reversing", "EXHAUSTED": "blocked"}, "reversing": {"COMPENSATED": "reversing", "COMP_REJECTED": "blocked", "ALL_COMPENSATED": "failed"}}


@query(
    "scenario_fold",
    f"""WITH tape AS (SELECT workflow_id, event, event_us, event_id FROM ({_TAPES_SQL})), listed AS (SELECT workflow_id, list(event ORDER BY event_us, event_id) AS events FROM tape GROUP BY workflow_id)
SELECT workflow_id, CAST(len(events) AS INT) AS n, list_reduce(list_prepend('idle', events), lambda s, e: CASE """
    + " ".join(f"WHEN s = '{s}' AND e = '{e}' THEN '{t}'" for s, arms in MACHINE.items() for e, t in arms.items())
    + " ELSE s END) AS final_state FROM listed",
)
def scenario_fold(fx: Fixtures) -> DataFrame:
    """Each tape's final state: an ordered fold of its events through the machine."""
    listed = tapes(fx).groupBy("workflow_id").agg(F.array_sort(F.collect_list(F.struct("event_us", "event_id", "event"))).alias("events"))

    def step(state: Column, x: Column) -> Column:
        arms = [(s, e, t) for s, own in MACHINE.items() for e, t in own.items()]
        to = F.when((state == arms[0][0]) & (x["event"] == arms[0][1]), arms[0][2])
        for s, e, t in arms[1:]:
            to = to.when((state == s) & (x["event"] == e), t)
        return to.otherwise(state)

    return listed.select("workflow_id", F.size("events").alias("n"), F.aggregate("events", F.lit("idle"), step).alias("final_state"))


@query(
    "inspect_nested",
    """WITH ops AS (SELECT workflow_id, string_agg(operation_seq || ':' || operation_name || ':' || status, ',' ORDER BY operation_seq) AS operations FROM {operation} GROUP BY workflow_id),
kids AS (SELECT workflow_id, string_agg(CAST(child_id AS VARCHAR), ',' ORDER BY operation_seq, child_id) AS children FROM {call} GROUP BY workflow_id)
SELECT w.workflow_id, w.state, coalesce(o.operations, '') AS operations, coalesce(k.children, '') AS children FROM {workflow} w LEFT JOIN ops o ON o.workflow_id = w.workflow_id LEFT JOIN kids k ON k.workflow_id = w.workflow_id""",
)
def inspect_nested(fx: Fixtures) -> DataFrame:
    """Each workflow with its operations and children in order, rendered."""
    ops = fx.operation.groupBy("workflow_id").agg(F.array_sort(F.collect_list(F.struct("operation_seq", "operation_name", "status"))).alias("ops"))
    kids = fx.call.groupBy("workflow_id").agg(F.array_sort(F.collect_list(F.struct("operation_seq", "child_id"))).alias("kids"))
    df = fx.workflow.join(ops, "workflow_id", "left").join(kids, "workflow_id", "left")
    text = F.array_join(F.transform("ops", lambda x: F.concat_ws(":", x["operation_seq"].cast("string"), x["operation_name"], x["status"].cast("string"))), ",")
    return df.select("workflow_id", "state", F.coalesce(text, F.lit("")).alias("operations"), F.coalesce(F.array_join(F.transform("kids", lambda x: x["child_id"].cast("string")), ","), F.lit("")).alias("children"))


def inspect(fx: Fixtures, max_depth: int) -> DataFrame:
    """(workflow_id, document): each root as a nested document of itself and what it called, as JSON text.

    A node has its operations, calls, checkpoints and events in order, and its
    children's documents in the order of the calls.  Below max_depth a child is a
    truncated stub, and one that is its own ancestor a stub that says so.  Documents
    are put together from the deepest level up, one join a level.
    """
    item = lambda template, *columns: F.format_string(template, *columns)
    listed = lambda rows, name, place, text: rows.groupBy("workflow_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*place, text.alias("text")))), lambda x: x["text"]), ",").alias(name))
    calls = written(fx.call.select("workflow_id", "operation_seq", "child_id", "child_status"), "document-calls")
    parts = {
        "operations": listed(fx.operation, "operations", ["operation_seq"], item('{"seq":%d,"name":"%s","status":%d}', "operation_seq", "operation_name", "status")),
        "calls": listed(calls, "calls", ["operation_seq", "child_id"], item('{"seq":%d,"child":%d,"status":%d}', "operation_seq", "child_id", "child_status")),
        "checkpoints": listed(fx.checkpoint, "checkpoints", ["seq"], item('{"seq":%d,"state":%d}', "seq", "reversal_state")),
        "events": listed(fx.event, "events", ["event_us", "event_id"], item('{"at":%d,"kind":"%s"}', "event_us", "kind")),
    }
    own = fx.workflow.select("workflow_id", "script_name", state_name(F.col("state")).alias("state_name"))
    for rows in parts.values():
        own = own.join(rows, "workflow_id", "left")
    head = item('{"workflow_id":%d,"script_name":"%s","state_name":"%s"', "workflow_id", "script_name", "state_name")
    own = own.select("workflow_id", F.concat(head, *[F.concat(F.lit(f',"{n}":['), F.coalesce(n, F.lit("")), F.lit("]")) for n in parts]).alias("own"))
    own = written(own, "documents")
    nodes = written(descend(fx, max_depth).select("root", "workflow_id", "depth", "path", "cycle"), "document-nodes")
    calls = calls.select(F.col("workflow_id").alias("caller"), "operation_seq", "child_id")
    below = None  # (path of the caller, place of the call, document) of the level below
    for depth in range(max_depth, -1, -1):
        level = nodes.where((F.col("depth") == depth) & ~F.col("cycle")).select("root", "workflow_id", "path")
        called = level.join(calls, F.col("workflow_id") == F.col("caller")).select("path", "operation_seq", "child_id", F.array_contains("path", F.col("child_id")).alias("met"))
        stub = F.when(F.col("met"), item('{"child_workflow_id":%d,"cycle_detected":true}', "child_id"))
        if below is None:
            texts = called.withColumn("text", F.coalesce(stub, item('{"child_workflow_id":%d,"truncated":true}', "child_id")))
        else:
            texts = called.join(below, [called.path.eqNullSafe(below.up), called.child_id == below.id], "left").withColumn("text", F.coalesce(stub, F.col("document")))
        children = texts.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("operation_seq", "child_id", "text"))), lambda x: x["text"]), ",").alias("children"))
        done = level.join(own, "workflow_id").join(children, "path", "left")
        document = F.concat("own", F.lit(',"children":['), F.coalesce("children", F.lit("")), F.lit("]}"))
        below = written(done.select(F.slice("path", 1, F.size("path") - 1).alias("up"), F.col("workflow_id").alias("id"), document.alias("document")), "document-level")
    return below.select(F.col("id").alias("workflow_id"), "document")


_DOCUMENT_SQL = f"""WITH ops AS (SELECT workflow_id, string_agg('{{{{"seq":' || operation_seq || ',"name":"' || operation_name || '","status":' || status || '}}}}', ',' ORDER BY operation_seq) AS t FROM {{operation}} GROUP BY workflow_id),
kids AS (SELECT workflow_id, string_agg('{{{{"seq":' || operation_seq || ',"child":' || child_id || ',"status":' || child_status || '}}}}', ',' ORDER BY operation_seq, child_id) AS t, string_agg('{{{{"child_workflow_id":' || child_id || ',"truncated":true}}}}', ',' ORDER BY operation_seq, child_id) AS stubs FROM {{call}} GROUP BY workflow_id),
cps AS (SELECT workflow_id, string_agg('{{{{"seq":' || seq || ',"state":' || reversal_state || '}}}}', ',' ORDER BY seq) AS t FROM {{checkpoint}} GROUP BY workflow_id),
evs AS (SELECT workflow_id, string_agg('{{{{"at":' || event_us || ',"kind":"' || kind || '"}}}}', ',' ORDER BY event_us, event_id) AS t FROM {{event}} GROUP BY workflow_id),
own AS (SELECT w.workflow_id, w.parent_id, '{{{{"workflow_id":' || w.workflow_id || ',"script_name":"' || w.script_name || '","state_name":"' || {_STATE_SQL.format("w.state")} || '","operations":[' || coalesce(o.t, '') || '],"calls":[' || coalesce(k.t, '') || '],"checkpoints":[' || coalesce(c.t, '') || '],"events":[' || coalesce(e.t, '') || ']' AS head, coalesce(k.stubs, '') AS stubs
  FROM {{workflow}} w LEFT JOIN ops o ON o.workflow_id = w.workflow_id LEFT JOIN kids k ON k.workflow_id = w.workflow_id LEFT JOIN cps c ON c.workflow_id = w.workflow_id LEFT JOIN evs e ON e.workflow_id = w.workflow_id),
second AS (SELECT k.workflow_id AS caller, string_agg(o.head || ',"children":[' || o.stubs || ']}}}}', ',' ORDER BY k.operation_seq, k.child_id) AS t FROM {{call}} k JOIN own o ON o.workflow_id = k.child_id GROUP BY k.workflow_id)
SELECT o.workflow_id, o.head || ',"children":[' || coalesce(s.t, '') || ']}}}}' AS document FROM own o LEFT JOIN second s ON s.caller = o.workflow_id WHERE o.parent_id IS NULL"""


@query("inspect_document", _DOCUMENT_SQL)
def inspect_document(fx: Fixtures) -> DataFrame:
    """Every root's document, one level of calls deep."""
    return inspect(fx, 1)
