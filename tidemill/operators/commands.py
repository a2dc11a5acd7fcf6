"""State transitions at set scale: a command per workflow, joined to its state, gets one outcome.

Each procedure is an ordered list of (condition, outcome): the first condition that
holds decides, which is what makes replays, fences and time checks come out in the
right order.  The order differs between procedures and is part of their meaning.
An outcome's effects are given per column; the DuckDB text of ``command_sql`` is written
apart from both.  All joins are equi-joins on the workflow and its sequence numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators import command_sql
from tidemill.plans.catalog import register
from tidemill.sources.fixtures import NOW_US, SECOND, Fixtures
from tidemill.sources.scratch import written

#: Budgets in milliseconds, and attempts.
RECONCILE_MS, RECONCILE_ATTEMPTS, REDISPATCH_MS = 1_800_000, 2, 60_000
REASON = "3"
#: What the commands bring along, where the fixture has no column for it: a lease's end, a reason and a disposition.
LEASE_US, FAIL_REASON, DISPOSITION = NOW_US + 60 * SECOND, "declined", 2

MISSING = ("w_state IS NULL", "not_found")
SKEW = ("event_us <= w_event_us", "event_time_skew")


def fence(states: str, more: str = "") -> tuple[str, str]:
    """The caller must hold the lease with the current token, in one of the states."""
    return (f"w_owner IS NULL OR w_owner <> executor OR w_token <> token OR w_state NOT IN ({states}){more}", "fence_lost")


_RANGE = ("p_length IS NOT NULL AND (seq < 1 OR seq > p_length)", "plan_violation")
_BEFORE = ("p_length IS NOT NULL AND seq > 1 AND (before_status IS NULL OR before_status <> 2)", "plan_violation")
_NO_OP = ("o_id IS NULL", "operation_not_found")
_OTHER_OP = ("o_id <> operation_id", "operation_conflict")
_NOT_OPEN = ("o_status <> 1", "operation_not_requested")
_NO_CP = ("c_state IS NULL", "checkpoint_not_found")
_UNASKED = ("c_reverse_id IS NULL", "not_requested")
_OTHER_REV = ("c_reverse_id <> reverse_id", "reverse_id_mismatch")
_ORDER = ("seq <> top_seq", "out_of_order")
_SPENT = f"waited_ms >= {RECONCILE_MS} AND attempts_before + 1 >= {RECONCILE_ATTEMPTS}"
_CP_SPENT = f"c_waited_ms >= {RECONCILE_MS} AND c_attempts + 1 >= {RECONCILE_ATTEMPTS}"
_NO_CALL = ("o_id IS NULL OR o_call_kind <> 2", "not_call_checkpoint")

#: Procedure -> (rules in order, outcome otherwise).
RULES: dict[str, tuple[list[tuple[str, str]], str]] = {
    "op_request": ([MISSING, fence("1"), _RANGE, _BEFORE, ("o_id IS NOT NULL AND NOT (o_id <=> operation_id AND o_name <=> arg_name AND o_schema <=> arg_schema AND o_hash <=> arg_hash)", "operation_conflict"), ("o_id IS NOT NULL", "exists"), SKEW], "requested"),
    "op_settle": ([MISSING, _RANGE, ("p_length IS NOT NULL AND cp_seq <> seq", "plan_violation"), ("p_length IS NOT NULL AND is_final AND seq <> p_length", "plan_violation"), _NO_OP, _OTHER_OP, ("o_status = 2", "already_settled"), fence("1"), SKEW], "settled"),
    "op_fail": ([MISSING, _NO_OP, _OTHER_OP, ("w_state = 3", "already_blocked"), fence("1"), SKEW], "blocked"),
    "dispatch_defer": ([MISSING, fence("1, 2")], "deferred"),
    "reconcile_defer": ([MISSING, fence("1"), _NO_OP, _OTHER_OP, _NOT_OPEN, (f"{_SPENT} AND event_us <= w_event_us", "event_time_skew"), (_SPENT, "blocked")], "deferred"),
    "pending_defer": ([MISSING, fence("1"), _NO_OP, _OTHER_OP, _NOT_OPEN, (f"pending_ms >= {REDISPATCH_MS}", "redispatch")], "defer"),
    "begin_reversal": ([MISSING, ("w_trigger IS NOT NULL AND w_trigger <> operation_id", "trigger_mismatch"), ("w_trigger IS NOT NULL", "already_begun"), _NO_OP, _OTHER_OP, ("o_status <> 1", "operation_not_failed"), fence("1"), SKEW, ("top_seq IS NULL", "failed")], "reversing"),
    "authored_fail": ([MISSING, ("w_trigger IS NOT NULL AND w_trigger <> operation_id", "trigger_mismatch"), ("w_trigger IS NOT NULL", "already_begun"), fence("1"), SKEW, ("top_seq IS NULL", "failed")], "reversing"),
    "reverse_request": ([MISSING, _NO_CP, ("c_state <> 1", "checkpoint_inactive"), ("c_reverse_id IS NOT NULL AND NOT (c_reverse_id <=> reverse_id AND c_reverse_name <=> arg_reverse_name)", "binding_conflict"), ("c_reverse_id IS NOT NULL", "already_requested"), fence("2"), _ORDER, SKEW], "requested"),
    "reverse_settle": ([MISSING, _NO_CP, _UNASKED, _OTHER_REV, ("c_state = 2", "already_reversed"), ("c_state <> 1", "checkpoint_not_settleable"), fence("2"), _ORDER, SKEW, ("next_seq IS NULL", "reversed")], "reversing"),
    "reverse_block": ([MISSING, _NO_CP, _UNASKED, _OTHER_REV, ("c_state = 3", "already_blocked"), ("c_state <> 1", "checkpoint_not_blockable"), fence("2"), _ORDER, SKEW], "blocked"),
    "reverse_reconcile": ([MISSING, _NO_CP, _UNASKED, _OTHER_REV, ("c_state = 3", "already_blocked"), ("c_state <> 1", "checkpoint_not_active"), fence("2"), _ORDER, (f"{_CP_SPENT} AND event_us <= w_event_us", "event_time_skew"), (_CP_SPENT, "blocked")], "deferred"),
    "reverse_pending": ([MISSING, _NO_CP, _UNASKED, _OTHER_REV, ("c_state = 3", "already_blocked"), ("c_state <> 1", "checkpoint_not_active"), fence("2"), _ORDER, (f"c_pending_ms >= {REDISPATCH_MS}", "redispatch")], "defer"),
    "heartbeat": ([MISSING, fence("1, 2", f" OR w_expires < {NOW_US}")], "extended"),
    "release": ([MISSING, fence("1, 2")], "released"),
    "claim_by_id": ([MISSING, (f"w_state NOT IN (1, 2) OR w_next_us > {NOW_US} OR (w_owner IS NOT NULL AND NOT coalesce(w_expires < {NOW_US}, false))", "not_claimable")], "claimed"),
    "call_submit_guard": ([MISSING, fence("1"), _RANGE, _BEFORE, ("o_id IS NOT NULL AND NOT coalesce(o_id = operation_id AND o_call_kind = 2 AND o_hash <=> arg_hash AND call_child = arg_child AND call_script <=> script_name, false)", "call_conflict"), ("o_id IS NOT NULL", "already_submitted"), ("coalesce(w_depth, 0) + 1 > max_depth", "call_rejected"), ("in_ancestry > 0", "call_rejected"), SKEW], "submitted"),
    "child_reopen": ([MISSING, _NO_CP, _NO_CALL, ("call_child IS NULL", "call_sidecar_not_found"), ("child_state IS NULL", "child_not_found"), ("child_state IN (2, 3, 5, 6)", "already_reopened"), ("child_state <> 4", "child_state_inconsistent"), fence("2"), ("top_seq IS NULL OR seq <> top_seq", "out_of_order"), ("child_top_seq IS NULL", "child_no_active_checkpoint"), ("event_us <= w_event_us OR event_us <= child_event_us", "event_time_skew")], "reopened"),
    "child_settle": ([MISSING, _NO_CP, _NO_CALL, ("c_state = 2", "already_reversed"), ("c_state <> 1", "checkpoint_not_settleable"), fence("2"), _ORDER, ("call_child IS NULL", "call_sidecar_not_found"), ("child_state IS NULL", "child_not_found"), ("child_state IN (2, 3)", "child_not_terminal"), ("child_state NOT IN (5, 6)", "child_not_compensated"), SKEW, ("next_seq IS NULL", "reversed")], "reversing"),
    "call_hint": ([("call_child IS NULL", "not_found")], "refreshed"),
}

#: What the workflow's row holds after a command that leaves it alone.
KEPT = {"state": "w_state", "direction": "w_direction", "disposition": "w_disposition", "owner": "w_owner", "expires_us": "w_expires", "token": "w_token", "next_us": "w_next_us", "event_us": "w_event_us", "trigger_id": "w_trigger", "terminal_reason": "w_reason", "return_json": "w_return"}
#: Other results, null unless a command writes or reports them: of its operation, checkpoint and child, and where the workflow goes on.
TOLD = {"position": "string", "detail": "string", "result": "bigint", "op_status": "int", "attempts": "int", "redispatches": "int", "cp_state": "int", "cp_reverse_id": "bigint", "child_id": "bigint", "child_state": "int", "child_token": "bigint", "child_depth": "int", "child_root": "bigint", "child_event": "string", "hint_us": "bigint"}

_FREE = {"owner": "NULL", "expires_us": "NULL"}
_NOW = {"event_us": "event_us"}
_LATER = {**_FREE, "next_us": "next_us", "event_us": "CASE WHEN event_kind IS NULL THEN w_event_us ELSE event_us END"}
_IF_LATER = {"event_us": "greatest(event_us, w_event_us)"}
_TURN = {"direction": "2", "disposition": "2", "trigger_id": "operation_id", "terminal_reason": f"'{FAIL_REASON}'", **_NOW}
_FAILED = {"state": "7", "event_kind": "'failed'", "position": "'failed'", **_TURN, **_FREE}
_REVERSING = {"state": "2", "event_kind": "'reversal_begun'", "position": "concat('reverse:', top_seq)", **_TURN}
_UNDONE = {"event_kind": "'compensation_settled'", "cp_state": "2", **_NOW}
_CHILD = {"child_id": "call_child", "child_state": "child_state"}
_UNKNOWN = {"state": "3", "disposition": "4", "event_kind": "'participant_route_unknown'", "position": "concat('blocked:', seq)", **_FREE, **_NOW}
_IF = "CASE WHEN event_us > w_event_us THEN '{}' END"

#: Procedure, outcome -> what it writes; ``event_kind`` is the event that is appended, if any.
EFFECTS: dict[tuple[str, str], dict[str, str]] = {
    ("op_request", "plan_violation"): {"detail": "CASE WHEN seq < 1 OR seq > p_length THEN 'seq_out_of_range' ELSE 'predecessor_incomplete' END"},
    ("op_request", "requested"): {"event_kind": "'operation_requested'", "op_status": "1", **_NOW},
    ("op_settle", "plan_violation"): {"detail": "CASE WHEN seq < 1 OR seq > p_length THEN 'seq_out_of_range' WHEN cp_seq <> seq THEN 'checkpoint_mismatch' ELSE 'finality_early' END"},
    ("op_settle", "already_settled"): {"result": "o_result", "op_status": "2"},
    ("op_settle", "settled"): {
        "state": "CASE WHEN is_final THEN 4 ELSE w_state END",
        "disposition": "CASE WHEN is_final THEN 1 ELSE w_disposition END",
        "owner": "CASE WHEN is_final THEN NULL ELSE w_owner END",
        "expires_us": "CASE WHEN is_final THEN NULL ELSE w_expires END",
        "return_json": "CASE WHEN is_final THEN arg_return ELSE w_return END",
        "event_kind": "CASE WHEN is_final THEN 'workflow_completed' ELSE 'operation_settled' END",
        "result": "arg_result", "op_status": "2", "cp_state": "1", **_NOW,
    },
    ("op_fail", "blocked"): {"state": "3", "disposition": "2", "event_kind": "'operation_failed'", **_FREE, **_NOW},
    ("dispatch_defer", "deferred"): {"event_kind": f"CASE WHEN last_kind = 'operation_dispatch_deferred' AND last_reason <=> '{REASON}' THEN NULL WHEN event_us <= w_event_us THEN NULL ELSE 'operation_dispatch_deferred' END", **_LATER},
    ("reconcile_defer", "blocked"): {**_UNKNOWN, "direction": "1", "attempts": "attempts_before + 1"},
    ("reconcile_defer", "deferred"): {"event_kind": _IF.format("participant_route_404"), "attempts": "attempts_before + 1", **_LATER},
    ("pending_defer", "redispatch"): {"event_kind": _IF.format("pending_redispatch"), "redispatches": "redispatched + 1", **_IF_LATER},
    ("pending_defer", "defer"): {"event_kind": _IF.format("pending_deferred"), "redispatches": "redispatched", **_LATER},
    ("begin_reversal", "failed"): _FAILED,
    ("begin_reversal", "reversing"): _REVERSING,
    ("authored_fail", "failed"): _FAILED,
    ("authored_fail", "reversing"): _REVERSING,
    ("reverse_request", "requested"): {"event_kind": "'compensation_requested'", "cp_reverse_id": "reverse_id", "position": "concat('reverse:dispatched:', seq)", **_NOW},
    ("reverse_request", "already_requested"): {"cp_reverse_id": "c_reverse_id"},
    ("reverse_settle", "reversed"): {"state": "5", "position": "'reversed'", **_UNDONE, **_FREE},
    ("reverse_settle", "reversing"): {"position": "concat('reverse:', next_seq)", **_UNDONE},
    ("reverse_block", "blocked"): {"state": "3", "disposition": str(DISPOSITION), "event_kind": "'compensation_blocked'", "cp_state": "3", "position": "concat('blocked:', seq)", **_FREE, **_NOW},
    ("reverse_reconcile", "blocked"): {**_UNKNOWN, "cp_state": "3", "attempts": "c_attempts + 1"},
    ("reverse_reconcile", "deferred"): {"event_kind": _IF.format("participant_route_404"), "attempts": "c_attempts + 1", **_LATER},
    ("reverse_pending", "redispatch"): {"event_kind": _IF.format("pending_redispatch"), "redispatches": "c_redispatched + 1", **_IF_LATER},
    ("reverse_pending", "defer"): {"event_kind": _IF.format("pending_deferred"), "redispatches": "c_redispatched", **_LATER},
    ("heartbeat", "extended"): {"expires_us": str(LEASE_US)},
    ("release", "released"): {**_FREE, "next_us": "next_us"},
    ("claim_by_id", "claimed"): {"owner": "executor", "expires_us": str(LEASE_US), "token": "w_token + 1"},
    ("call_submit_guard", "plan_violation"): {"detail": "CASE WHEN seq < 1 OR seq > p_length THEN 'seq_out_of_range' ELSE 'predecessor_incomplete' END"},
    ("call_submit_guard", "call_rejected"): {"detail": "CASE WHEN coalesce(w_depth, 0) + 1 > max_depth THEN 'max_call_depth_exceeded' ELSE 'call_cycle' END"},
    ("call_submit_guard", "already_submitted"): {"child_id": "call_child"},
    ("call_submit_guard", "submitted"): {"event_kind": "'call_submitted'", "op_status": "1", "child_id": "operation_id", "child_state": "1", "child_token": "0", "child_depth": "coalesce(w_depth, 0) + 1", "child_root": "coalesce(w_root, workflow_id)", "child_event": "'created'", **_NOW},
    ("child_reopen", "already_reopened"): _CHILD,
    ("child_reopen", "child_state_inconsistent"): _CHILD,
    ("child_reopen", "reopened"): {"event_kind": "'compensation_requested'", "child_id": "call_child", "child_state": "2", "child_token": "child_token_before + 1", "child_event": "'compensation_requested_by_parent'", "position": "concat('child:reverse:', child_top_seq)", **_NOW},
    ("child_settle", "child_not_terminal"): _CHILD,
    ("child_settle", "child_not_compensated"): _CHILD,
    ("child_settle", "reversed"): {"state": "5", "position": "'reversed'", **_CHILD, **_UNDONE, **_FREE},
    ("child_settle", "reversing"): {"position": "concat('reverse:', next_seq)", **_CHILD, **_UNDONE},
    ("call_hint", "refreshed"): {"hint_us": "CASE WHEN call_seen IS NULL OR event_us > call_seen THEN event_us ELSE call_seen END"},
}

#: What each procedure needs besides the workflow, so that no join is made in vain.
NEEDS: dict[str, set[str]] = {
    "op_request": {"plan", "before", "op"},
    "op_settle": {"plan", "op"},
    "op_fail": {"op"},
    "dispatch_defer": {"last"},
    "reconcile_defer": {"op"},
    "pending_defer": {"op"},
    "begin_reversal": {"op", "top"},
    "authored_fail": {"top"},
    "reverse_request": {"cp", "top"},
    "reverse_settle": {"cp", "top"},
    "reverse_block": {"cp", "top"},
    "reverse_reconcile": {"cp", "top"},
    "reverse_pending": {"cp", "top"},
    "heartbeat": set(),
    "release": set(),
    "claim_by_id": set(),
    "call_submit_guard": {"plan", "before", "op", "call", "ancestry"},
    "child_reopen": {"cp", "op", "call", "top"},
    "child_settle": {"cp", "op", "call", "top"},
    "call_hint": {"call"},
}


def _ms(since: Column) -> Column:
    return F.floor((F.lit(NOW_US) - since) / 1000).cast("long")


def _at(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Commands with the rows of their place, if any; the place is a range of one, so that rows are dealt by workflow alone and no step deals them again."""
    rows = rows.withColumnsRenamed({"workflow_id": "_of", "seq": "_at"})
    return df.join(rows, (F.col("workflow_id") == F.col("_of")) & F.col("_at").between(F.col("seq"), F.col("seq")), "left").drop("_of", "_at")


def _at_or_after(df: DataFrame, ops: DataFrame) -> DataFrame:
    """Commands with the operation of their place and the status of the one before it, from one row, so that operations are dealt once.

    An operation brings along the status before its own; where none follows it, it is
    also found by a command of the next place, which has no operation but one before.
    """
    ops = ops.withColumnsRenamed({"workflow_id": "_of", "seq": "_at"})
    kept = [c for c in ops.columns if c not in ("_of", "_at")]
    along, here = Window.partitionBy("_of").orderBy("_at"), F.col("_at") == F.col("seq")
    before = F.when(F.lag("_at").over(along) == F.col("_at") - 1, F.lag("o_status").over(along))
    to = F.when(F.lead("_at").over(along) == F.col("_at") + 1, F.col("_at")).otherwise(F.col("_at") + 1)
    ops = ops.withColumns({"_before": before, "_to": to})
    df = df.join(ops, (F.col("workflow_id") == F.col("_of")) & F.col("seq").between(F.col("_at"), F.col("_to")), "left")
    df = df.withColumn("before_status", F.when(here, F.col("_before")).otherwise(F.col("o_status")))
    return df.withColumns({c: F.when(here, F.col(c)) for c in kept}).drop("_of", "_at", "_to", "_before")


def context(fx: Fixtures, needs: set[str]) -> DataFrame:
    """Commands with the state that their procedure looks at; what is missing is null."""
    dealt = fx.dealt("lineitem", "l_orderkey")
    w = fx.workflow.select("workflow_id", F.col("state").alias("w_state"), F.col("lease_owner").alias("w_owner"), F.col("lease_expires_us").alias("w_expires"), F.col("fencing_token").alias("w_token"), F.col("current_event_us").alias("w_event_us"), F.col("next_attempt_us").alias("w_next_us"), F.col("trigger_id").alias("w_trigger"), F.col("call_depth").alias("w_depth"), F.col("root_id").alias("w_root"), F.col("execution_direction").alias("w_direction"), F.col("current_disposition").alias("w_disposition"), F.col("terminal_reason").alias("w_reason"), F.col("return_json").alias("w_return"))
    df = fx.command.join(w, "workflow_id", "left")
    odd = lambda n, k: F.col("workflow_id") % n == k
    df = df.withColumns({"cp_seq": F.col("seq") + F.when(odd(19, 7), 1).otherwise(0), "max_depth": F.when(odd(2, 0), 16).otherwise(2), "arg_result": F.col("operation_id") * 7, "arg_return": F.lit('{"done":true}')})
    if "plan" in needs:
        df = df.join(fx.plan.select("workflow_id", F.col("plan_length").alias("p_length")), "workflow_id", "left")
    if "op" in needs:
        ops = dealt.operation.select("workflow_id", F.col("operation_seq").alias("seq"), F.col("operation_id").alias("o_id"), F.col("status").alias("o_status"), F.col("call_kind").alias("o_call_kind"), F.col("operation_name").alias("o_name"), F.col("schema_version").alias("o_schema"), F.col("input_hash").alias("o_hash"), F.col("result").alias("o_result"), F.col("reconcile_attempts").alias("attempts_before"), F.col("redispatch_count").alias("redispatched"), _ms(F.coalesce("reconcile_first_us", F.lit(NOW_US))).alias("waited_ms"), _ms(F.coalesce("redispatch_last_us", "redispatch_first_us", F.lit(NOW_US))).alias("pending_ms"))
        df = _at_or_after(df, ops) if "before" in needs else _at(df, ops)
        # Callers mostly ask for what is there; some bring another name, version or hash.
        df = df.withColumns({"arg_name": F.when(odd(29, 3), "other").otherwise(F.col("o_name")), "arg_schema": F.col("o_schema") + F.when(odd(31, 4), 1).otherwise(0), "arg_hash": F.when(~odd(37, 5), F.col("o_hash"))})
    if "cp" in needs:
        cps = dealt.checkpoint.select("workflow_id", "seq", F.col("reversal_state").alias("c_state"), F.col("reverse_id").alias("c_reverse_id"), F.concat(F.lit("undo_"), "operation_name").alias("c_reverse_name"), F.col("reconcile_attempts").alias("c_attempts"), F.col("redispatch_count").alias("c_redispatched"), _ms(F.coalesce("reconcile_first_us", F.lit(NOW_US))).alias("c_waited_ms"), _ms(F.coalesce("redispatch_last_us", "redispatch_first_us", F.lit(NOW_US))).alias("c_pending_ms"))
        df = _at(df, cps)
        df = df.withColumn("arg_reverse_name", F.when(odd(31, 6), "undo_other").otherwise(F.col("c_reverse_name")))
    if "top" in needs:
        tops = active_tops(dealt)
        df = df.join(tops.select("workflow_id", "top_seq", "next_seq"), "workflow_id", "left")
    if "last" in needs:
        last = fx.event.groupBy("workflow_id").agg(F.max_by("kind", F.struct("event_us", "event_id")).alias("last_kind"), F.max_by(F.get_json_object("payload", "$.k"), F.struct("event_us", "event_id")).alias("last_reason"))
        df = df.join(last, "workflow_id", "left")
    if "call" in needs:
        calls = fx.call.select("workflow_id", F.col("operation_seq").alias("seq"), F.col("child_id").alias("call_child"), F.col("child_script").alias("call_script"), F.col("last_inspected_us").alias("call_seen"))
        if "top" in needs:
            # The child belongs to its call: most commands have none, and joined by it they would all meet in one task.
            child = fx.workflow.select(F.col("workflow_id").alias("call_child"), F.col("state").alias("child_state"), F.col("current_event_us").alias("child_event_us"), F.col("fencing_token").alias("child_token_before"))
            calls = calls.join(child, "call_child", "left").join(tops.select(F.col("workflow_id").alias("call_child"), F.col("top_seq").alias("child_top_seq")), "call_child", "left")
        df = _at(df, calls).withColumn("arg_child", F.col("call_child") + F.when(odd(23, 2), 1).otherwise(0))
    if "ancestry" in needs:
        df = df.join(_in_ancestry(fx), "workflow_id", "left").withColumn("in_ancestry", F.coalesce("in_ancestry", F.lit(0)))
    return df


def active_tops(fx: Fixtures) -> DataFrame:
    """(workflow_id, top_seq, next_seq): the two highest active checkpoints."""
    down = Window.partitionBy("workflow_id").orderBy(F.desc("seq"))
    ranked = fx.checkpoint.where("reversal_state = 1").select("workflow_id", F.col("seq").alias("top_seq"), F.lead("seq").over(down).alias("next_seq"), F.row_number().over(down).alias("n"))
    return ranked.where("n = 1").drop("n")


def ancestors(workflow: DataFrame) -> DataFrame:
    """(workflow_id, at, hops): every workflow with itself and all its ancestors, up to the root.

    A level a step, each written, until no chain goes on; a chain that would meet
    its own start ends there.
    """
    up = workflow.select(F.col("workflow_id").alias("at"), "parent_id").where("parent_id IS NOT NULL")
    level = workflow.select("workflow_id", F.col("workflow_id").alias("at"), F.lit(0).alias("hops"))
    found, hops = level, 0
    while True:
        hops += 1
        level = level.join(up, "at").where("parent_id <> workflow_id").select("workflow_id", F.col("parent_id").alias("at"), F.lit(hops).alias("hops"))
        level = written(level, "ancestors")
        if level.isEmpty():
            return found
        found = found.unionByName(level)


def _in_ancestry(fx: Fixtures, child_version: str = "1.0.0") -> DataFrame:
    """How many of a workflow and its ancestors are pinned to the script and version that it would call, as far up as its depth limit."""
    called = fx.workflow.select("workflow_id", F.col("script_name").alias("called"))
    pins = fx.workflow.select(F.col("workflow_id").alias("at"), "script_name").join(fx.plan.where(F.col("plan_version") == child_version).select(F.col("workflow_id").alias("at")), "at")
    met = ancestors(fx.workflow.select("workflow_id", "parent_id")).join(pins, "at").join(called, "workflow_id")
    met = met.where((F.col("script_name") == F.col("called")) & (F.col("hops") <= F.when(F.col("workflow_id") % 2 == 0, 16).otherwise(2)))
    return met.groupBy("workflow_id").agg(F.count(F.lit(1)).alias("in_ancestry"))


def decide(df: DataFrame, procedure: str) -> DataFrame:
    """The outcome of each command, the event it appends, and what the rows that it concerns hold afterwards."""
    rules, otherwise = RULES[procedure]
    outcome = F.when(F.expr(rules[0][0]), rules[0][1])
    for condition, name in rules[1:]:
        outcome = outcome.when(F.expr(condition), name)
    df = df.withColumn("outcome", outcome.otherwise(otherwise))
    own = {name: effect for (p, name), effect in EFFECTS.items() if p == procedure}

    def after(column: str, kept: Column) -> Column:
        for name, effect in own.items():
            if column in effect:
                kept = F.when(F.col("outcome") == name, F.expr(effect[column])).otherwise(kept)
        return kept

    df = df.withColumn("event_kind", after("event_kind", F.lit(None).cast("string")))
    types = {"state": "int", "direction": "int", "disposition": "int", "terminal_reason": "string", "return_json": "string"}
    rows = [after(c, F.col(kept)).cast(types.get(c, "bigint")).alias(f"new_{c}") for c, kept in KEPT.items()]
    told = [after(c, F.lit(None)).cast(kind).alias(c) for c, kind in TOLD.items()]
    last = F.greatest("w_event_us", "child_event_us") if procedure == "child_reopen" else F.col("w_event_us")
    defer = F.when(F.col("outcome") == "event_time_skew", last + 5 * SECOND)
    return df.select("workflow_id", "outcome", "event_kind", defer.cast("long").alias("defer_until_us"), *rows, *told)


for _name in RULES:
    register(_name, (lambda fx, name=_name: decide(context(fx, NEEDS[name]), name)), command_sql.oracle(_name))
