"""Point reads, ordered child scans, claims, sinks and registry joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.analytics import iso
from tidemill.operators.commands import active_tops
from tidemill.plans.catalog import query
from tidemill.sources.fixtures import NOW_US, SECOND, Fixtures

KEY = 1234


@query("point_workflow", f"SELECT workflow_id, script_name, state, lower(hex(workflow_id)) AS id_hex, strftime(make_timestamp(created_us), '%Y-%m-%dT%H:%M:%S.%fZ') AS created FROM {{workflow}} WHERE workflow_id = {KEY}")
def point_workflow(fx: Fixtures) -> DataFrame:
    """One workflow by id; the predicate reaches the scan."""
    return fx.workflow.where(F.col("workflow_id") == KEY).select("workflow_id", "script_name", "state", F.lower(F.hex("workflow_id")).alias("id_hex"), iso(F.col("created_us")).alias("created"))


@query("point_plan_args", f"SELECT w.workflow_id, p.plan_version, p.content_hash, p.plan_length, decode(encode('{{{{\"owner\":' || w.owner_id || '}}}}')) AS args FROM {{workflow}} w LEFT JOIN {{plan}} p ON p.workflow_id = w.workflow_id")
def point_plan_args(fx: Fixtures) -> DataFrame:
    """Plan pin and arguments; arguments are stored as UTF-8 bytes."""
    rows = fx.workflow.withColumn("blob", F.encode(F.to_json(F.struct(F.col("owner_id").alias("owner"))), "UTF-8"))
    return rows.join(fx.plan, "workflow_id", "left").select("workflow_id", "plan_version", "content_hash", "plan_length", F.decode("blob", "UTF-8").alias("args"))


@query("children_ordered", "SELECT workflow_id, 'call' AS kind, operation_seq AS seq, CAST(child_id AS VARCHAR) AS ref FROM {call} UNION ALL SELECT workflow_id, 'operation', operation_seq, operation_name FROM {operation} UNION ALL SELECT workflow_id, 'checkpoint', seq, operation_name FROM {checkpoint} UNION ALL SELECT workflow_id, 'event', CAST(row_number() OVER (PARTITION BY workflow_id ORDER BY event_us, event_id) AS INT), kind FROM {event}")
def children_ordered(fx: Fixtures) -> DataFrame:
    """Calls, operations, checkpoints and events of every workflow, each in its order."""
    calls = fx.call.select("workflow_id", F.lit("call").alias("kind"), F.col("operation_seq").alias("seq"), F.col("child_id").cast("string").alias("ref"))
    ops = fx.operation.select("workflow_id", F.lit("operation").alias("kind"), F.col("operation_seq").alias("seq"), F.col("operation_name").alias("ref"))
    cps = fx.checkpoint.select("workflow_id", F.lit("checkpoint").alias("kind"), "seq", F.col("operation_name").alias("ref"))
    place = F.row_number().over(Window.partitionBy("workflow_id").orderBy("event_us", "event_id"))
    events = fx.event.select("workflow_id", F.lit("event").alias("kind"), place.alias("seq"), F.col("kind").alias("ref"))
    return calls.unionByName(ops).unionByName(cps).unionByName(events).orderBy("workflow_id", "kind", "seq")


@query("skeleton", "SELECT workflow_id, script_name, state, parent_id FROM {workflow}")
def skeleton(fx: Fixtures) -> DataFrame:
    return fx.workflow.select("workflow_id", "script_name", "state", "parent_id")


@query("child_edges", "SELECT workflow_id, operation_seq, child_id FROM {call} ORDER BY workflow_id, operation_seq")
def child_edges(fx: Fixtures) -> DataFrame:
    return fx.call.select("workflow_id", "operation_seq", "child_id").orderBy("workflow_id", "operation_seq")


def _asked(fx: Fixtures) -> DataFrame:
    """Keys that are asked for: one operation of every workflow, and five workflows that do not exist."""
    return fx.command.select("workflow_id", "seq")


_ASKED = "(SELECT workflow_id, seq FROM {command})"


@query("read_plan", f"SELECT k.workflow_id, CASE WHEN p.workflow_id IS NULL THEN 'not_found' ELSE 'found' END AS outcome, p.plan_version, p.plan_length FROM {_ASKED} k LEFT JOIN (SELECT p.* FROM {{plan}} p JOIN {{workflow}} w ON w.workflow_id = p.workflow_id) p ON p.workflow_id = k.workflow_id")
def read_plan(fx: Fixtures) -> DataFrame:
    pins = fx.plan.join(fx.workflow.select("workflow_id"), "workflow_id").withColumn("hit", F.lit(True))
    return _asked(fx).join(pins, "workflow_id", "left").select("workflow_id", F.when(F.col("hit"), "found").otherwise("not_found").alias("outcome"), "plan_version", "plan_length")


@query("read_result", f"SELECT k.workflow_id, k.seq, CASE WHEN o.status IS NULL THEN 'not_found' WHEN o.status = 2 THEN 'succeeded' ELSE 'requested' END AS outcome, o.result FROM {_ASKED} k LEFT JOIN {{operation}} o ON o.workflow_id = k.workflow_id AND o.operation_seq = k.seq")
def read_result(fx: Fixtures) -> DataFrame:
    ops = fx.operation.select("workflow_id", F.col("operation_seq").alias("seq"), "status", "result")
    outcome = F.when(F.col("status").isNull(), "not_found").when(F.col("status") == 2, "succeeded").otherwise("requested")
    return _asked(fx).join(ops, ["workflow_id", "seq"], "left").select("workflow_id", "seq", outcome.alias("outcome"), "result")


@query("read_request", f"SELECT k.workflow_id, k.seq, CASE WHEN o.status IS NULL THEN 'not_found' ELSE 'found' END AS outcome, o.operation_name, o.schema_version, o.input_hash FROM {_ASKED} k LEFT JOIN {{operation}} o ON o.workflow_id = k.workflow_id AND o.operation_seq = k.seq")
def read_request(fx: Fixtures) -> DataFrame:
    ops = fx.operation.select("workflow_id", F.col("operation_seq").alias("seq"), "operation_name", "schema_version", "input_hash")
    return _asked(fx).join(ops, ["workflow_id", "seq"], "left").select("workflow_id", "seq", F.when(F.col("input_hash").isNull(), "not_found").otherwise("found").alias("outcome"), "operation_name", "schema_version", "input_hash")


@query("read_snapshot", f"SELECT k.workflow_id, CASE WHEN w.workflow_id IS NULL THEN 'not_found' ELSE 'found' END AS outcome, w.state, w.fencing_token, coalesce(w.lease_owner IS NOT NULL AND w.lease_expires_us >= {NOW_US}, false) AS leased FROM {_ASKED} k LEFT JOIN {{workflow}} w ON w.workflow_id = k.workflow_id")
def read_snapshot(fx: Fixtures) -> DataFrame:
    rows = _asked(fx).join(fx.workflow, "workflow_id", "left")
    leased = F.coalesce(F.col("lease_owner").isNotNull() & (F.col("lease_expires_us") >= NOW_US), F.lit(False))
    return rows.select("workflow_id", F.when(F.col("script_name").isNull(), "not_found").otherwise("found").alias("outcome"), "state", "fencing_token", leased.alias("leased"))


@query("read_call", f"SELECT k.workflow_id, k.seq, CASE WHEN c.child_id IS NULL OR w.workflow_id IS NULL THEN 'not_found' ELSE 'found' END AS outcome, c.child_id, w.state AS child_state, w.return_json AS child_return FROM {_ASKED} k LEFT JOIN {{call}} c ON c.workflow_id = k.workflow_id AND c.operation_seq = k.seq LEFT JOIN {{workflow}} w ON w.workflow_id = c.child_id")
def read_call(fx: Fixtures) -> DataFrame:
    """What the child itself says, not the hint that its caller holds."""
    calls = fx.call.select("workflow_id", F.col("operation_seq").alias("seq"), "child_id")
    truth = fx.workflow.select(F.col("workflow_id").alias("child_id"), F.col("state").alias("child_state"), F.col("return_json").alias("child_return"))
    rows = _asked(fx).join(calls, ["workflow_id", "seq"], "left").join(truth, "child_id", "left")
    return rows.select("workflow_id", "seq", F.when(F.col("child_state").isNull(), "not_found").otherwise("found").alias("outcome"), "child_id", "child_state", "child_return")


def due(now_us: int = NOW_US) -> Column:
    """In a running state, due, and without a lease that is still live; a lease that expires now is live."""
    return F.col("state").isin(1, 2) & (F.col("next_attempt_us") <= now_us) & (F.col("lease_owner").isNull() | (F.col("lease_expires_us") < now_us))


_DUE = f"state IN (1, 2) AND next_attempt_us <= {NOW_US} AND (lease_owner IS NULL OR lease_expires_us < {NOW_US})"


@query("claimable", f"SELECT workflow_id, script_name FROM {{workflow}} WHERE {_DUE}")
def claimable(fx: Fixtures) -> DataFrame:
    return fx.workflow.where(due()).select("workflow_id", "script_name")


@query("claim_next", f"SELECT workflow_id, script_name, fencing_token + 1 AS fencing_token, CAST({NOW_US + 30 * SECOND} AS BIGINT) AS lease_expires_us FROM (SELECT *, row_number() OVER (PARTITION BY script_name ORDER BY next_attempt_us, workflow_id) AS n FROM {{workflow}} WHERE {_DUE}) WHERE n = 1")
def claim_next(fx: Fixtures) -> DataFrame:
    """The first due workflow of every script, with its token rotated: a top-1 that combines before it shuffles."""
    first = fx.workflow.where(due()).groupBy("script_name").agg(F.min(F.struct("next_attempt_us", "workflow_id", "fencing_token")).alias("f"))
    return first.select("f.workflow_id", "script_name", (F.col("f.fencing_token") + 1).alias("fencing_token"), F.lit(NOW_US + 30 * SECOND).cast("long").alias("lease_expires_us"))


@query("lease_live", f"SELECT workflow_id, lease_expires_us > {NOW_US} AS live_for_viewer, lease_expires_us >= {NOW_US} AS live_for_claim FROM {{workflow}} WHERE lease_owner IS NOT NULL")
def lease_live(fx: Fixtures) -> DataFrame:
    """Two readings of a lease that ends right now; neither is unified into the other."""
    return fx.workflow.where("lease_owner IS NOT NULL").select("workflow_id", (F.col("lease_expires_us") > NOW_US).alias("live_for_viewer"), (F.col("lease_expires_us") >= NOW_US).alias("live_for_claim"))


@query("clock_read", f"SELECT strftime(make_timestamp({NOW_US}), '%Y-%m-%d %H:%M:%S.%f') AS now, strftime(make_timestamp({NOW_US + 30 * SECOND}), '%Y-%m-%d %H:%M:%S.%f') AS lease_until")
def clock_read(fx: Fixtures) -> DataFrame:
    text = lambda us: F.date_format(F.timestamp_micros(F.lit(us)), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return fx.spark.range(1).select(text(NOW_US).alias("now"), text(NOW_US + 30 * SECOND).alias("lease_until"))


@query("reverse_head", "WITH top AS (SELECT workflow_id, seq, operation_name, reverse_id, row_number() OVER (PARTITION BY workflow_id ORDER BY seq DESC) AS n FROM {checkpoint} WHERE reversal_state = 1) SELECT w.workflow_id, CASE WHEN t.seq IS NULL THEN 'none_active' WHEN t.reverse_id IS NULL THEN 'pending' ELSE 'dispatched' END AS outcome, t.seq, t.operation_name, t.reverse_id, CASE WHEN t.seq IS NOT NULL AND t.reverse_id IS NULL THEN o.call_kind END AS call_kind FROM {workflow} w LEFT JOIN top t ON t.workflow_id = w.workflow_id AND t.n = 1 LEFT JOIN {operation} o ON o.workflow_id = w.workflow_id AND o.operation_seq = t.seq")
def reverse_head(fx: Fixtures) -> DataFrame:
    """The highest active checkpoint of every workflow, and whether its reversal was asked for."""
    head = fx.checkpoint.where("reversal_state = 1").groupBy("workflow_id").agg(F.max(F.struct("seq", "operation_name", "reverse_id")).alias("h")).select("workflow_id", "h.*")
    kinds = fx.operation.select("workflow_id", F.col("operation_seq").alias("seq"), "call_kind")
    rows = fx.workflow.select("workflow_id").join(head, "workflow_id", "left").join(kinds, ["workflow_id", "seq"], "left")
    pending = F.col("seq").isNotNull() & F.col("reverse_id").isNull()
    outcome = F.when(F.col("seq").isNull(), "none_active").when(pending, "pending").otherwise("dispatched")
    return rows.select("workflow_id", outcome.alias("outcome"), "seq", "operation_name", "reverse_id", F.when(pending, F.col("call_kind")).alias("call_kind"))


@query("active_tops", "SELECT workflow_id, max(seq) AS top_seq FROM {checkpoint} WHERE reversal_state = 1 GROUP BY workflow_id")
def top_active(fx: Fixtures) -> DataFrame:
    return active_tops(fx).select("workflow_id", "top_seq")


@query("child_notify", "SELECT c.child_id, c.workflow_id, CAST(CASE WHEN h.state = 4 THEN 2 ELSE 3 END AS INT) AS child_status, c.last_inspected_us IS NULL OR h.current_event_us > c.last_inspected_us AS applied, least(p.next_attempt_us, h.current_event_us) AS next_attempt_us FROM {call} c JOIN {workflow} h ON h.workflow_id = c.child_id JOIN {workflow} p ON p.workflow_id = c.workflow_id WHERE h.state IN (4, 5, 6, 7)")
def child_notify(fx: Fixtures) -> DataFrame:
    """A child that ended leaves a hint, only forward in time, and wakes its caller earlier, never later."""
    child = fx.workflow.where("state >= 4").select(F.col("workflow_id").alias("child_id"), F.col("state").alias("s"), F.col("current_event_us").alias("at_us"))
    rows = fx.call.join(child, "child_id").join(fx.workflow.select("workflow_id", "next_attempt_us"), "workflow_id")
    return rows.select("child_id", "workflow_id", F.when(F.col("s") == 4, 2).otherwise(3).alias("child_status"), (F.col("last_inspected_us").isNull() | (F.col("at_us") > F.col("last_inspected_us"))).alias("applied"), F.least("next_attempt_us", "at_us").alias("next_attempt_us"))


_OFFERED = "(SELECT workflow_id + CASE WHEN workflow_id % 2 = 0 THEN 10000000 ELSE 0 END AS workflow_id, CASE WHEN workflow_id % 17 = 3 THEN 'other' ELSE script_name END AS script_name, created_us, 'owner=' || (owner_id + CASE WHEN workflow_id % 7 = 5 THEN 1 ELSE 0 END) AS args FROM {workflow} UNION ALL SELECT workflow_id + 10000000, script_name, created_us + 1, 'owner=0' FROM {workflow})"


@query(
    "unique_create",
    f"""SELECT n.workflow_id, n.created_us, CASE WHEN w.workflow_id IS NULL THEN CASE WHEN n.k = 1 THEN 'created' ELSE 'exists' END WHEN p.workflow_id IS NULL OR w.script_name <> n.script_name THEN 'plan_conflict'
  WHEN w.owner_id % 13 <> 0 AND 'owner=' || w.owner_id = n.args THEN 'exists' ELSE 'workflow_conflict' END AS outcome
FROM (SELECT *, row_number() OVER (PARTITION BY workflow_id ORDER BY created_us) AS k FROM {_OFFERED}) n LEFT JOIN {{workflow}} w ON w.workflow_id = n.workflow_id LEFT JOIN {{plan}} p ON p.workflow_id = n.workflow_id""",
)
def unique_create(fx: Fixtures) -> DataFrame:
    """Creation of what is not there yet; of several offers of one id in a batch the first wins, the others are told so.

    What is there must have a pinned plan of the same script (else plan_conflict),
    and the same arguments, byte for byte (else workflow_conflict).
    """
    w = fx.workflow.select("workflow_id", "script_name", "created_us", "owner_id")
    far = F.when(F.col("workflow_id") % 2 == 0, 10_000_000).otherwise(0)
    script = F.when(F.col("workflow_id") % 17 == 3, "other").otherwise(F.col("script_name"))
    args = F.concat(F.lit("owner="), F.col("owner_id") + F.when(F.col("workflow_id") % 7 == 5, 1).otherwise(0))
    offered = w.select((F.col("workflow_id") + far).alias("workflow_id"), script.alias("script_name"), "created_us", args.alias("args"))
    offered = offered.unionByName(w.select((F.col("workflow_id") + 10_000_000).alias("workflow_id"), "script_name", (F.col("created_us") + 1).alias("created_us"), F.lit("owner=0").alias("args")))
    first = F.row_number().over(Window.partitionBy("workflow_id").orderBy("created_us")) == 1
    held_args = F.when(F.col("owner_id") % 13 != 0, F.encode(F.concat(F.lit("owner="), "owner_id"), "UTF-8"))  # some have none
    held = w.select("workflow_id", F.col("script_name").alias("held"), held_args.alias("held_args"))
    pins = fx.plan.select("workflow_id", F.lit(True).alias("pinned"))
    rows = offered.withColumn("first", first).join(held, "workflow_id", "left").join(pins, "workflow_id", "left")
    outcome = (
        F.when(F.col("held").isNull() & F.col("first"), "created")
        .when(F.col("held").isNull(), "exists")
        .when(F.col("pinned").isNull() | ~F.col("held").eqNullSafe(F.col("script_name")), "plan_conflict")
        .when(F.col("held_args").isNull() | ~F.col("held_args").eqNullSafe(F.encode("args", "UTF-8")), "workflow_conflict")
        .otherwise("exists")
    )
    return rows.select("workflow_id", "created_us", outcome.alias("outcome"))


@query("append_events", "SELECT workflow_id, event_us, kind, lag(kind) OVER w IS NULL OR lag(kind) OVER w <> kind AS appended, coalesce(event_us > lag(event_us) OVER w, true) AS later FROM {event} WINDOW w AS (PARTITION BY workflow_id ORDER BY event_us, event_id)")
def append_events(fx: Fixtures) -> DataFrame:
    """Which events an audit log takes: not the same kind twice in a row, and only later ones."""
    w = Window.partitionBy("workflow_id").orderBy("event_us", "event_id")
    before = F.lag("kind").over(w)
    return fx.event.select("workflow_id", "event_us", "kind", (before.isNull() | (before != F.col("kind"))).alias("appended"), F.coalesce(F.col("event_us") > F.lag("event_us").over(w), F.lit(True)).alias("later"))


@query("latest_event", "SELECT workflow_id, arg_max(kind, (event_us, event_id)) AS kind, max(event_us) AS event_us, count(*) AS n FROM {event} GROUP BY workflow_id")
def latest_event(fx: Fixtures) -> DataFrame:
    return fx.event.groupBy("workflow_id").agg(F.max_by("kind", F.struct("event_us", "event_id")).alias("kind"), F.max("event_us").alias("event_us"), F.count(F.lit(1)).alias("n"))


@query("elapsed", f"SELECT operation_id, CAST(floor(({NOW_US} - coalesce(redispatch_last_us, redispatch_first_us)) / 1000) AS BIGINT) AS elapsed_ms, floor(({NOW_US} - coalesce(redispatch_last_us, redispatch_first_us)) / 1000) >= 60000 AS escalates FROM {{operation}} WHERE redispatch_first_us IS NOT NULL")
def elapsed(fx: Fixtures) -> DataFrame:
    """Milliseconds since the anchor of a timer, and whether it escalates."""
    ms = F.floor((F.lit(NOW_US) - F.coalesce("redispatch_last_us", "redispatch_first_us")) / 1000).cast("long")
    return fx.operation.where("redispatch_first_us IS NOT NULL").select("operation_id", ms.alias("elapsed_ms"), (ms >= 60_000).alias("escalates"))


#: Fixed: causes by number, with from-state, target, and the direction they need (0: either).
CAUSES = (
    ("forward_complete", 1, 4, 0),
    ("operation_failure", 1, 2, 0),
    ("forward_indeterminate", 1, 3, 0),
    ("cancellation", 1, 2, 0),
    ("unwind_complete", 2, 5, 0),
    ("reverse_blocked", 2, 3, 0),
    ("resolve_forward_success", 3, 1, 1),
    ("resolve_forward_failed", 3, 2, 1),
    ("resolve_reversal_continue", 3, 2, 2),
    ("resolve_accept_exception", 3, 6, 0),
)
#: Fixed: the disposition that a cause declares; the others keep the current one.
DECLARED = {"forward_complete": 1, "operation_failure": 2, "forward_indeterminate": 4, "cancellation": 3, "resolve_forward_success": 0, "resolve_forward_failed": 2}
#: Fixed: directions that each state may have.
DIRECTIONS = {1: (1,), 2: (2,), 3: (1, 2), 4: (1,), 5: (2,), 6: (1, 2), 7: (2,)}


def transition(state: Column, direction: Column, cause: Column) -> Column:
    """Target state, or null where the move is not legal from a position that exists."""
    sound = F.lit(False)
    for s, ds in DIRECTIONS.items():
        sound = sound | ((state == s) & direction.isin(*ds))
    to = F.lit(None).cast("int")
    for name, start, end, needs in CAUSES:
        fits = (cause == name) & (state == start)
        to = F.when(fits & (direction == needs) if needs else fits, F.lit(end)).otherwise(to)
    return F.when(sound, to)


_CAUSE_ROWS = ", ".join(f"('{n}', {a}, {b}, {d}, {DECLARED.get(n, 'NULL')})" for n, a, b, d in CAUSES)


@query(
    "transition_table",
    f"""WITH cause(name, start, target, needs, declares) AS (VALUES {_CAUSE_ROWS}), position AS (SELECT CAST(s AS INT) AS state, CAST(d AS INT) AS direction, CASE WHEN s IN (1, 4) THEN d = 1 WHEN s IN (2, 5, 7) THEN d = 2 ELSE true END AS sound FROM range(1, 8) a(s), range(1, 3) b(d)), moved AS (
SELECT state, direction, name AS cause, CASE WHEN sound AND state = start AND needs IN (0, direction) THEN CAST(target AS INT) END AS to_state, declares FROM position, cause)
SELECT state, direction, cause, to_state, CAST(CASE WHEN to_state IN (1, 4) THEN 1 WHEN to_state IN (2, 5, 7) THEN 2 WHEN to_state IS NOT NULL THEN direction END AS INT) AS to_direction, CAST(CASE WHEN to_state IS NOT NULL THEN declares END AS INT) AS declares FROM moved""",
)
def transition_table(fx: Fixtures) -> DataFrame:
    """All 140 combinations of state, direction and cause, with where they lead."""
    causes = F.array(*[F.lit(c[0]) for c in CAUSES])
    rows = fx.spark.range(7 * 2 * len(CAUSES)).select((F.col("id") % 7 + 1).cast("int").alias("state"), (F.floor(F.col("id") / 7) % 2 + 1).cast("int").alias("direction"), F.element_at(causes, (F.floor(F.col("id") / 14) + 1).cast("int")).alias("cause"))
    rows = rows.withColumn("to_state", transition(F.col("state"), F.col("direction"), F.col("cause")))
    to_direction = F.when(F.col("to_state").isin(1, 4), 1).when(F.col("to_state").isin(2, 5, 7), 2).when(F.col("to_state").isNotNull(), F.col("direction"))
    declared = F.element_at(F.create_map(*[F.lit(x) for pair in DECLARED.items() for x in pair]), F.col("cause"))
    return rows.select("state", "direction", "cause", "to_state", to_direction.cast("int").alias("to_direction"), F.when(F.col("to_state").isNotNull(), declared).cast("int").alias("declares"))


@query("disposition_check", "SELECT state, execution_direction, current_disposition, count(*) AS n FROM {workflow} GROUP BY ALL")
def disposition_check(fx: Fixtures) -> DataFrame:
    return fx.workflow.groupBy("state", "execution_direction", "current_disposition").agg(F.count(F.lit(1)).alias("n"))


@query(
    "backfill_terminal",
    """SELECT w.workflow_id, CAST(CASE WHEN EXISTS (SELECT 1 FROM {event} e WHERE e.workflow_id = w.workflow_id AND e.kind = 'operation_failed') THEN 5 ELSE 7 END AS INT) AS state,
CASE WHEN EXISTS (SELECT 1 FROM {event} e WHERE e.workflow_id = w.workflow_id AND e.kind = 'operation_failed')
  THEN coalesce((SELECT arg_max(json_extract_string(e.payload, '$.k'), (e.event_us, e.event_id)) FROM {event} e WHERE e.workflow_id = w.workflow_id AND e.kind = 'operation_requested'), 'legacy_reversal')
  ELSE coalesce((SELECT arg_max(json_extract_string(e.payload, '$.k'), (e.event_us, e.event_id)) FROM {event} e WHERE e.workflow_id = w.workflow_id AND e.kind = 'workflow_completed'), 'legacy_empty_reversal') END AS terminal_reason
FROM {workflow} w WHERE w.state = 5""",
)
def backfill_terminal(fx: Fixtures) -> DataFrame:
    """Reversed workflows split by whether an event of a kind exists, each with the latest reason or a default."""
    ended = fx.workflow.where("state = 5").select("workflow_id")
    proof = fx.event.where("kind = 'operation_failed'").select("workflow_id")

    def reason(kind: str) -> DataFrame:
        own = fx.event.where(F.col("kind") == kind)
        return own.groupBy("workflow_id").agg(F.max_by(F.get_json_object("payload", "$.k"), F.struct("event_us", "event_id")).alias("reason"))

    unwound = ended.join(proof, "workflow_id", "left_semi").join(reason("operation_requested"), "workflow_id", "left").select("workflow_id", F.lit(5).alias("state"), F.coalesce("reason", F.lit("legacy_reversal")).alias("terminal_reason"))
    empty = ended.join(proof, "workflow_id", "left_anti").join(reason("workflow_completed"), "workflow_id", "left").select("workflow_id", F.lit(7).alias("state"), F.coalesce("reason", F.lit("legacy_empty_reversal")).alias("terminal_reason"))
    return unwound.unionByName(empty)


#: Fixed: revisions of a manifest; one version of each name is active.
REGISTRY = (("1-URGENT", "1.0.0", False), ("1-URGENT", "1.1.0", True), ("2-HIGH", "1.0.0", True), ("3-MEDIUM", "1.2.0", True))
_REGISTRY_ROWS = ", ".join(f"('{n}', '{v}', {str(a).lower()})" for n, v, a in REGISTRY)


@query("registry_resolve", f"WITH r(name, version, active) AS (VALUES {_REGISTRY_ROWS}) SELECT p.workflow_id, p.plan_version, a.version AS active_version, e.name IS NOT NULL AS pinned_known, coalesce(e.active, false) AS pinned_active FROM {{plan}} p JOIN {{workflow}} w ON w.workflow_id = p.workflow_id LEFT JOIN r a ON a.name = w.script_name AND a.active LEFT JOIN r e ON e.name = w.script_name AND e.version = p.plan_version")
def registry_resolve(fx: Fixtures) -> DataFrame:
    """Active revision by name, and exact revision by name and version; the registry is a short literal table."""
    registry = fx.spark.createDataFrame(list(REGISTRY), "name string, version string, active boolean")
    active = F.broadcast(registry.where("active").select(F.col("name").alias("script_name"), F.col("version").alias("active_version")))
    exact = F.broadcast(registry.select(F.col("name").alias("script_name"), F.col("version").alias("plan_version"), "active", F.lit(True).alias("known")))
    rows = fx.plan.join(fx.workflow.select("workflow_id", "script_name"), "workflow_id").join(active, "script_name", "left").join(exact, ["script_name", "plan_version"], "left")
    no = F.lit(False)
    return rows.select("workflow_id", "plan_version", "active_version", F.coalesce("known", no).alias("pinned_known"), F.coalesce("active", no).alias("pinned_active"))


#: Fixed: operations' participants by name modulo, and their compensations.
BINDINGS = ((0, "stock", "release"), (1, "drive", None), (2, "ledger", "refund"))
_BINDING_ROWS = ", ".join(f"({k}, '{p}', {f"'{c}'" if c else 'NULL'})" for k, p, c in BINDINGS)


@query("binding_resolve", f"WITH b(k, participant, compensation) AS (VALUES {_BINDING_ROWS}) SELECT o.operation_id, o.operation_name, b.participant, b.compensation, b.compensation IS NOT NULL AS compensable FROM {{operation}} o LEFT JOIN b ON b.k = o.part_id % 4")
def binding_resolve(fx: Fixtures) -> DataFrame:
    bindings = F.broadcast(fx.spark.createDataFrame(list(BINDINGS), "k long, participant string, compensation string"))
    rows = fx.operation.withColumn("k", F.col("part_id") % 4).join(bindings, "k", "left")
    return rows.select("operation_id", "operation_name", "participant", "compensation", F.col("compensation").isNotNull().alias("compensable"))


#: Fixed: what a drive's outcome means to a shell and to an HTTP caller.
OUTCOMES = (("completed", 0, 200), ("pending", 9, 202), ("refused", 10, 503), ("pending_restart", 11, 503), ("active", 4, 409), ("blocked", 3, 409), ("error", 10, 500))
_OUTCOME_ROWS = ", ".join(f"('{n}', {e}, {h})" for n, e, h in OUTCOMES)


@query("outcome_codes", f"WITH t(outcome, exit_code, http_status) AS (VALUES {_OUTCOME_ROWS}) SELECT w.workflow_id, t.outcome, CAST(t.exit_code AS INT) AS exit_code, CAST(t.http_status AS INT) AS http_status FROM {{workflow}} w JOIN t ON t.outcome = CASE WHEN w.state >= 4 THEN 'completed' WHEN w.state = 3 THEN 'blocked' WHEN w.lease_expires_us > {NOW_US} THEN 'active' ELSE 'pending' END")
def outcome_codes(fx: Fixtures) -> DataFrame:
    table = F.broadcast(fx.spark.createDataFrame(list(OUTCOMES), "outcome string, exit_code int, http_status int"))
    outcome = F.when(F.col("state") >= 4, "completed").when(F.col("state") == 3, "blocked").when(F.col("lease_expires_us") > NOW_US, "active").otherwise("pending")
    return fx.workflow.select("workflow_id", outcome.alias("outcome")).join(table, "outcome").select("workflow_id", "outcome", "exit_code", "http_status")
