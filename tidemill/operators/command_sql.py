"""DuckDB SQL of the commands, written from the procedures' own order of checks and updates, column by column.

Nothing here is shared with the Spark side but names of columns: a slip in either
shows as a difference.
"""

from __future__ import annotations

from tidemill.sources.fixtures import NOW_US, SECOND

_LEASE = NOW_US + 60 * SECOND

_CONTEXT = f"""WITH RECURSIVE up AS (
  SELECT workflow_id, workflow_id AS at, parent_id, 0 AS hops FROM {{workflow}}
  UNION ALL
  SELECT u.workflow_id, w.workflow_id, w.parent_id, u.hops + 1 FROM up u JOIN {{workflow}} w ON w.workflow_id = u.parent_id
), ancestry AS (
  SELECT u.workflow_id, count(*) AS n FROM up u JOIN {{workflow}} me ON me.workflow_id = u.workflow_id JOIN {{workflow}} a ON a.workflow_id = u.at JOIN {{plan}} p ON p.workflow_id = u.at
  WHERE a.script_name = me.script_name AND p.plan_version = '1.0.0' AND u.hops <= CASE WHEN u.workflow_id % 2 = 0 THEN 16 ELSE 2 END GROUP BY u.workflow_id
), active AS (
  SELECT workflow_id, max(seq) AS top_seq, max(seq) FILTER (WHERE seq < m) AS next_seq
  FROM (SELECT workflow_id, seq, max(seq) OVER (PARTITION BY workflow_id) AS m FROM {{checkpoint}} WHERE reversal_state = 1) GROUP BY workflow_id
), latest AS (
  SELECT workflow_id, arg_max(kind, (event_us, event_id)) AS last_kind, arg_max(json_extract_string(payload, '$.k'), (event_us, event_id)) AS last_reason FROM {{event}} GROUP BY workflow_id
), x AS (
  SELECT m.*, m.seq + CASE WHEN m.workflow_id % 19 = 7 THEN 1 ELSE 0 END AS cp_seq, CASE WHEN m.workflow_id % 2 = 0 THEN 16 ELSE 2 END AS max_depth,
    w.workflow_id IS NULL AS missing, w.state, w.execution_direction AS direction, w.current_disposition AS disposition, w.lease_owner, w.lease_expires_us, w.fencing_token, w.current_event_us AS at_us, w.next_attempt_us, w.trigger_id, w.terminal_reason, w.return_json, w.call_depth, w.root_id,
    p.plan_length, o.operation_id AS op, o.status AS op_state, o.call_kind, o.result AS op_result, o.operation_name AS op_name, o.schema_version AS op_schema, o.input_hash AS op_hash,
    CASE WHEN m.workflow_id % 29 = 3 THEN 'other' ELSE o.operation_name END AS asked_name, o.schema_version + CASE WHEN m.workflow_id % 31 = 4 THEN 1 ELSE 0 END AS asked_schema, CASE WHEN m.workflow_id % 37 = 5 THEN NULL ELSE o.input_hash END AS asked_hash,
    o.reconcile_attempts AS tries, ({NOW_US} - coalesce(o.reconcile_first_us, {NOW_US})) // 1000 AS unknown_ms, o.redispatch_count AS sent, ({NOW_US} - coalesce(o.redispatch_last_us, o.redispatch_first_us, {NOW_US})) // 1000 AS silent_ms,
    b.status AS earlier, c.reversal_state AS undo, c.reverse_id AS undo_id, CASE WHEN m.workflow_id % 31 = 6 THEN 'undo_other' ELSE 'undo_' || c.operation_name END AS asked_undo, 'undo_' || c.operation_name AS undo_name,
    c.reconcile_attempts AS undo_tries, ({NOW_US} - coalesce(c.reconcile_first_us, {NOW_US})) // 1000 AS undo_unknown_ms, c.redispatch_count AS undo_sent, ({NOW_US} - coalesce(c.redispatch_last_us, c.redispatch_first_us, {NOW_US})) // 1000 AS undo_silent_ms,
    t.top_seq, t.next_seq, l.last_kind, l.last_reason, k.child_id AS child, k.child_script, k.last_inspected_us AS seen_us, k.child_id + CASE WHEN m.workflow_id % 23 = 2 THEN 1 ELSE 0 END AS asked_child,
    h.state AS kid_state, h.current_event_us AS kid_us, h.fencing_token AS kid_token, ht.top_seq AS kid_top, coalesce(a.n, 0) AS above,
    coalesce(w.lease_owner = m.executor AND w.fencing_token = m.token, false) AS holds, m.event_us <= w.current_event_us AS too_early
  FROM {{command}} m LEFT JOIN {{workflow}} w ON w.workflow_id = m.workflow_id LEFT JOIN {{plan}} p ON p.workflow_id = m.workflow_id
  LEFT JOIN {{operation}} o ON o.workflow_id = m.workflow_id AND o.operation_seq = m.seq LEFT JOIN {{operation}} b ON b.workflow_id = m.workflow_id AND b.operation_seq = m.seq - 1
  LEFT JOIN {{checkpoint}} c ON c.workflow_id = m.workflow_id AND c.seq = m.seq LEFT JOIN active t ON t.workflow_id = m.workflow_id
  LEFT JOIN latest l ON l.workflow_id = m.workflow_id LEFT JOIN {{call}} k ON k.workflow_id = m.workflow_id AND k.operation_seq = m.seq
  LEFT JOIN {{workflow}} h ON h.workflow_id = k.child_id LEFT JOIN active ht ON ht.workflow_id = k.child_id LEFT JOIN ancestry a ON a.workflow_id = m.workflow_id
)"""

#: Procedure -> its outcome.
OUTCOME = {
    "op_request": """CASE WHEN missing THEN 'not_found' WHEN NOT (holds AND state = 1) THEN 'fence_lost'
  WHEN plan_length IS NOT NULL AND seq NOT BETWEEN 1 AND plan_length THEN 'plan_violation'
  WHEN plan_length IS NOT NULL AND seq > 1 AND earlier IS DISTINCT FROM 2 THEN 'plan_violation'
  WHEN op IS NULL AND too_early THEN 'event_time_skew' WHEN op IS NULL THEN 'requested'
  WHEN op IS NOT DISTINCT FROM operation_id AND op_name IS NOT DISTINCT FROM asked_name AND op_schema IS NOT DISTINCT FROM asked_schema AND op_hash IS NOT DISTINCT FROM asked_hash THEN 'exists'
  ELSE 'operation_conflict' END""",
    "op_settle": """CASE WHEN missing THEN 'not_found'
  WHEN plan_length IS NOT NULL AND (seq NOT BETWEEN 1 AND plan_length OR cp_seq <> seq OR (is_final AND seq <> plan_length)) THEN 'plan_violation'
  WHEN op IS NULL THEN 'operation_not_found' WHEN op IS DISTINCT FROM operation_id THEN 'operation_conflict' WHEN op_state = 2 THEN 'already_settled'
  WHEN NOT (holds AND state = 1) THEN 'fence_lost' WHEN too_early THEN 'event_time_skew' ELSE 'settled' END""",
    "op_fail": """CASE WHEN missing THEN 'not_found' WHEN op IS NULL THEN 'operation_not_found' WHEN op IS DISTINCT FROM operation_id THEN 'operation_conflict'
  WHEN state = 3 THEN 'already_blocked' WHEN NOT (holds AND state = 1) THEN 'fence_lost' WHEN too_early THEN 'event_time_skew' ELSE 'blocked' END""",
    "dispatch_defer": "CASE WHEN missing THEN 'not_found' WHEN holds AND state IN (1, 2) THEN 'deferred' ELSE 'fence_lost' END",
    "reconcile_defer": """CASE WHEN missing THEN 'not_found' WHEN NOT (holds AND state = 1) THEN 'fence_lost' WHEN op IS NULL THEN 'operation_not_found'
  WHEN op IS DISTINCT FROM operation_id THEN 'operation_conflict' WHEN op_state <> 1 THEN 'operation_not_requested'
  WHEN unknown_ms < 1800000 OR tries + 1 < 2 THEN 'deferred' WHEN too_early THEN 'event_time_skew' ELSE 'blocked' END""",
    "pending_defer": """CASE WHEN missing THEN 'not_found' WHEN NOT (holds AND state = 1) THEN 'fence_lost' WHEN op IS NULL THEN 'operation_not_found'
  WHEN op IS DISTINCT FROM operation_id THEN 'operation_conflict' WHEN op_state <> 1 THEN 'operation_not_requested' WHEN silent_ms < 60000 THEN 'defer' ELSE 'redispatch' END""",
    "begin_reversal": """CASE WHEN missing THEN 'not_found' WHEN trigger_id = operation_id THEN 'already_begun' WHEN trigger_id IS NOT NULL THEN 'trigger_mismatch'
  WHEN op IS NULL THEN 'operation_not_found' WHEN op IS DISTINCT FROM operation_id THEN 'operation_conflict' WHEN op_state <> 1 THEN 'operation_not_failed'
  WHEN NOT (holds AND state = 1) THEN 'fence_lost' WHEN too_early THEN 'event_time_skew' WHEN top_seq IS NOT NULL THEN 'reversing' ELSE 'failed' END""",
    "authored_fail": """CASE WHEN missing THEN 'not_found' WHEN trigger_id = operation_id THEN 'already_begun' WHEN trigger_id IS NOT NULL THEN 'trigger_mismatch'
  WHEN NOT (holds AND state = 1) THEN 'fence_lost' WHEN too_early THEN 'event_time_skew' WHEN top_seq IS NOT NULL THEN 'reversing' ELSE 'failed' END""",
    "reverse_request": """CASE WHEN missing THEN 'not_found' WHEN undo IS NULL THEN 'checkpoint_not_found' WHEN undo > 1 THEN 'checkpoint_inactive'
  WHEN undo_id = reverse_id AND undo_name = asked_undo THEN 'already_requested' WHEN undo_id IS NOT NULL THEN 'binding_conflict'
  WHEN NOT (holds AND state = 2) THEN 'fence_lost' WHEN seq <> top_seq THEN 'out_of_order' WHEN too_early THEN 'event_time_skew' ELSE 'requested' END""",
    "reverse_settle": """CASE WHEN missing THEN 'not_found' WHEN undo IS NULL THEN 'checkpoint_not_found' WHEN undo_id IS NULL THEN 'not_requested' WHEN undo_id <> reverse_id THEN 'reverse_id_mismatch'
  WHEN undo = 2 THEN 'already_reversed' WHEN undo = 3 THEN 'checkpoint_not_settleable' WHEN NOT (holds AND state = 2) THEN 'fence_lost' WHEN seq <> top_seq THEN 'out_of_order'
  WHEN too_early THEN 'event_time_skew' WHEN next_seq IS NOT NULL THEN 'reversing' ELSE 'reversed' END""",
    "reverse_block": """CASE WHEN missing THEN 'not_found' WHEN undo IS NULL THEN 'checkpoint_not_found' WHEN undo_id IS NULL THEN 'not_requested' WHEN undo_id <> reverse_id THEN 'reverse_id_mismatch'
  WHEN undo = 3 THEN 'already_blocked' WHEN undo = 2 THEN 'checkpoint_not_blockable' WHEN NOT (holds AND state = 2) THEN 'fence_lost' WHEN seq <> top_seq THEN 'out_of_order'
  WHEN too_early THEN 'event_time_skew' ELSE 'blocked' END""",
    "reverse_reconcile": """CASE WHEN missing THEN 'not_found' WHEN undo IS NULL THEN 'checkpoint_not_found' WHEN undo_id IS NULL THEN 'not_requested' WHEN undo_id <> reverse_id THEN 'reverse_id_mismatch'
  WHEN undo = 3 THEN 'already_blocked' WHEN undo = 2 THEN 'checkpoint_not_active' WHEN NOT (holds AND state = 2) THEN 'fence_lost' WHEN seq <> top_seq THEN 'out_of_order'
  WHEN undo_unknown_ms < 1800000 OR undo_tries + 1 < 2 THEN 'deferred' WHEN too_early THEN 'event_time_skew' ELSE 'blocked' END""",
    "reverse_pending": """CASE WHEN missing THEN 'not_found' WHEN undo IS NULL THEN 'checkpoint_not_found' WHEN undo_id IS NULL THEN 'not_requested' WHEN undo_id <> reverse_id THEN 'reverse_id_mismatch'
  WHEN undo = 3 THEN 'already_blocked' WHEN undo = 2 THEN 'checkpoint_not_active' WHEN NOT (holds AND state = 2) THEN 'fence_lost' WHEN seq <> top_seq THEN 'out_of_order'
  WHEN undo_silent_ms < 60000 THEN 'defer' ELSE 'redispatch' END""",
    "heartbeat": f"CASE WHEN missing THEN 'not_found' WHEN holds AND state IN (1, 2) AND coalesce(lease_expires_us >= {NOW_US}, true) THEN 'extended' ELSE 'fence_lost' END",
    "release": "CASE WHEN missing THEN 'not_found' WHEN holds AND state IN (1, 2) THEN 'released' ELSE 'fence_lost' END",
    "claim_by_id": f"CASE WHEN missing THEN 'not_found' WHEN state IN (1, 2) AND next_attempt_us <= {NOW_US} AND (lease_owner IS NULL OR coalesce(lease_expires_us < {NOW_US}, false)) THEN 'claimed' ELSE 'not_claimable' END",
    "call_submit_guard": """CASE WHEN missing THEN 'not_found' WHEN NOT (holds AND state = 1) THEN 'fence_lost'
  WHEN plan_length IS NOT NULL AND seq NOT BETWEEN 1 AND plan_length THEN 'plan_violation' WHEN plan_length IS NOT NULL AND seq > 1 AND earlier IS DISTINCT FROM 2 THEN 'plan_violation'
  WHEN op = operation_id AND call_kind = 2 AND op_hash IS NOT DISTINCT FROM asked_hash AND child = asked_child AND child_script IS NOT DISTINCT FROM script_name THEN 'already_submitted'
  WHEN op IS NOT NULL THEN 'call_conflict' WHEN call_depth >= max_depth OR above > 0 THEN 'call_rejected' WHEN too_early THEN 'event_time_skew' ELSE 'submitted' END""",
    "child_reopen": """CASE WHEN missing THEN 'not_found' WHEN undo IS NULL THEN 'checkpoint_not_found' WHEN call_kind IS DISTINCT FROM 2 THEN 'not_call_checkpoint' WHEN child IS NULL THEN 'call_sidecar_not_found'
  WHEN kid_state IS NULL THEN 'child_not_found' WHEN kid_state IN (1, 7) THEN 'child_state_inconsistent' WHEN kid_state <> 4 THEN 'already_reopened' WHEN NOT (holds AND state = 2) THEN 'fence_lost'
  WHEN seq IS DISTINCT FROM top_seq THEN 'out_of_order' WHEN kid_top IS NULL THEN 'child_no_active_checkpoint' WHEN too_early OR event_us <= kid_us THEN 'event_time_skew' ELSE 'reopened' END""",
    "child_settle": """CASE WHEN missing THEN 'not_found' WHEN undo IS NULL THEN 'checkpoint_not_found' WHEN call_kind IS DISTINCT FROM 2 THEN 'not_call_checkpoint' WHEN undo = 2 THEN 'already_reversed' WHEN undo = 3 THEN 'checkpoint_not_settleable'
  WHEN NOT (holds AND state = 2) THEN 'fence_lost' WHEN seq <> top_seq THEN 'out_of_order' WHEN child IS NULL THEN 'call_sidecar_not_found' WHEN kid_state IS NULL THEN 'child_not_found'
  WHEN kid_state IN (2, 3) THEN 'child_not_terminal' WHEN kid_state IN (1, 4, 7) THEN 'child_not_compensated' WHEN too_early THEN 'event_time_skew' WHEN next_seq IS NOT NULL THEN 'reversing' ELSE 'reversed' END""",
    "call_hint": "CASE WHEN child IS NULL THEN 'not_found' ELSE 'refreshed' END",
}

_RANGE_DETAIL = "CASE WHEN outcome = 'plan_violation' THEN CASE WHEN seq BETWEEN 1 AND plan_length THEN 'predecessor_incomplete' ELSE 'seq_out_of_range' END END"
_BEGUN = {
    "state": "CASE outcome WHEN 'failed' THEN 7 WHEN 'reversing' THEN 2 ELSE state END",
    "direction": "CASE WHEN outcome IN ('failed', 'reversing') THEN 2 ELSE direction END",
    "disposition": "CASE WHEN outcome IN ('failed', 'reversing') THEN 2 ELSE disposition END",
    "owner": "CASE WHEN outcome <> 'failed' THEN lease_owner END",
    "expires_us": "CASE WHEN outcome <> 'failed' THEN lease_expires_us END",
    "event_us": "CASE WHEN outcome IN ('failed', 'reversing') THEN event_us ELSE at_us END",
    "trigger_id": "CASE WHEN outcome IN ('failed', 'reversing') THEN operation_id ELSE trigger_id END",
    "terminal_reason": "CASE WHEN outcome IN ('failed', 'reversing') THEN 'declined' ELSE terminal_reason END",
    "event_kind": "CASE outcome WHEN 'failed' THEN 'failed' WHEN 'reversing' THEN 'reversal_begun' END",
    "position": "CASE outcome WHEN 'failed' THEN 'failed' WHEN 'reversing' THEN 'reverse:' || top_seq END",
}
_SETTLED_BACK = {
    "state": "CASE WHEN outcome = 'reversed' THEN 5 ELSE state END",
    "owner": "CASE WHEN outcome <> 'reversed' THEN lease_owner END",
    "expires_us": "CASE WHEN outcome <> 'reversed' THEN lease_expires_us END",
    "event_us": "CASE WHEN outcome IN ('reversed', 'reversing') THEN event_us ELSE at_us END",
    "event_kind": "CASE WHEN outcome IN ('reversed', 'reversing') THEN 'compensation_settled' END",
    "position": "CASE outcome WHEN 'reversed' THEN 'reversed' WHEN 'reversing' THEN 'reverse:' || next_seq END",
    "cp_state": "CASE WHEN outcome IN ('reversed', 'reversing') THEN 2 END",
}


def _unknown(tries: str, forward: bool) -> dict[str, str]:
    return {
        "state": "CASE WHEN outcome = 'blocked' THEN 3 ELSE state END",
        "direction": "CASE WHEN outcome = 'blocked' THEN 1 ELSE direction END" if forward else "direction",
        "disposition": "CASE WHEN outcome = 'blocked' THEN 4 ELSE disposition END",
        "owner": "CASE WHEN outcome NOT IN ('blocked', 'deferred') THEN lease_owner END",
        "expires_us": "CASE WHEN outcome NOT IN ('blocked', 'deferred') THEN lease_expires_us END",
        "next_us": "CASE WHEN outcome = 'deferred' THEN next_us ELSE next_attempt_us END",
        "event_us": "CASE WHEN outcome = 'blocked' OR outcome = 'deferred' AND NOT too_early THEN event_us ELSE at_us END",
        "event_kind": "CASE WHEN outcome = 'blocked' THEN 'participant_route_unknown' WHEN outcome = 'deferred' AND NOT too_early THEN 'participant_route_404' END",
        "position": "CASE WHEN outcome = 'blocked' THEN 'blocked:' || seq END",
        "attempts": f"CASE WHEN outcome IN ('blocked', 'deferred') THEN {tries} + 1 END",
        "cp_state": "NULL" if forward else "CASE WHEN outcome = 'blocked' THEN 3 END",
    }


def _silent(sent: str) -> dict[str, str]:
    return {
        "owner": "CASE WHEN outcome <> 'defer' THEN lease_owner END",
        "expires_us": "CASE WHEN outcome <> 'defer' THEN lease_expires_us END",
        "next_us": "CASE WHEN outcome = 'defer' THEN next_us ELSE next_attempt_us END",
        "event_us": "CASE WHEN outcome IN ('defer', 'redispatch') AND NOT too_early THEN event_us ELSE at_us END",
        "event_kind": "CASE WHEN too_early THEN NULL WHEN outcome = 'defer' THEN 'pending_deferred' WHEN outcome = 'redispatch' THEN 'pending_redispatch' END",
        "redispatches": f"CASE outcome WHEN 'defer' THEN {sent} WHEN 'redispatch' THEN {sent} + 1 END",
    }


#: Procedure -> what a column holds afterwards, where it is not what the workflow had (or null, for the columns of other rows).
CHANGED: dict[str, dict[str, str]] = {
    "op_request": {
        "event_us": "CASE WHEN outcome = 'requested' THEN event_us ELSE at_us END",
        "event_kind": "CASE WHEN outcome = 'requested' THEN 'operation_requested' END",
        "op_status": "CASE WHEN outcome = 'requested' THEN 1 END",
        "detail": _RANGE_DETAIL,
    },
    "op_settle": {
        "state": "CASE WHEN outcome = 'settled' AND is_final THEN 4 ELSE state END",
        "disposition": "CASE WHEN outcome = 'settled' AND is_final THEN 1 ELSE disposition END",
        "owner": "CASE WHEN NOT (outcome = 'settled' AND is_final) THEN lease_owner END",
        "expires_us": "CASE WHEN NOT (outcome = 'settled' AND is_final) THEN lease_expires_us END",
        "return_json": """CASE WHEN outcome = 'settled' AND is_final THEN '{{"done":true}}' ELSE return_json END""",
        "event_us": "CASE WHEN outcome = 'settled' THEN event_us ELSE at_us END",
        "event_kind": "CASE WHEN outcome <> 'settled' THEN NULL WHEN is_final THEN 'workflow_completed' ELSE 'operation_settled' END",
        "result": "CASE outcome WHEN 'settled' THEN operation_id * 7 WHEN 'already_settled' THEN op_result END",
        "op_status": "CASE WHEN outcome IN ('settled', 'already_settled') THEN 2 END",
        "cp_state": "CASE WHEN outcome = 'settled' THEN 1 END",
        "detail": "CASE WHEN outcome = 'plan_violation' THEN CASE WHEN seq NOT BETWEEN 1 AND plan_length THEN 'seq_out_of_range' WHEN cp_seq = seq THEN 'finality_early' ELSE 'checkpoint_mismatch' END END",
    },
    "op_fail": {
        "state": "CASE WHEN outcome = 'blocked' THEN 3 ELSE state END",
        "disposition": "CASE WHEN outcome = 'blocked' THEN 2 ELSE disposition END",
        "owner": "CASE WHEN outcome <> 'blocked' THEN lease_owner END",
        "expires_us": "CASE WHEN outcome <> 'blocked' THEN lease_expires_us END",
        "event_us": "CASE WHEN outcome = 'blocked' THEN event_us ELSE at_us END",
        "event_kind": "CASE WHEN outcome = 'blocked' THEN 'operation_failed' END",
    },
    "dispatch_defer": {
        "owner": "CASE WHEN outcome <> 'deferred' THEN lease_owner END",
        "expires_us": "CASE WHEN outcome <> 'deferred' THEN lease_expires_us END",
        "next_us": "CASE WHEN outcome = 'deferred' THEN next_us ELSE next_attempt_us END",
        "event_us": "CASE WHEN outcome = 'deferred' AND NOT too_early AND NOT coalesce(last_kind = 'operation_dispatch_deferred' AND last_reason = '3', false) THEN event_us ELSE at_us END",
        "event_kind": "CASE WHEN outcome = 'deferred' AND NOT too_early AND NOT coalesce(last_kind = 'operation_dispatch_deferred' AND last_reason = '3', false) THEN 'operation_dispatch_deferred' END",
    },
    "reconcile_defer": _unknown("tries", True),
    "pending_defer": _silent("sent"),
    "begin_reversal": _BEGUN,
    "authored_fail": _BEGUN,
    "reverse_request": {
        "event_us": "CASE WHEN outcome = 'requested' THEN event_us ELSE at_us END",
        "event_kind": "CASE WHEN outcome = 'requested' THEN 'compensation_requested' END",
        "position": "CASE WHEN outcome = 'requested' THEN 'reverse:dispatched:' || seq END",
        "cp_reverse_id": "CASE WHEN outcome IN ('requested', 'already_requested') THEN reverse_id END",
    },
    "reverse_settle": _SETTLED_BACK,
    "reverse_block": {
        "state": "CASE WHEN outcome = 'blocked' THEN 3 ELSE state END",
        "disposition": "CASE WHEN outcome = 'blocked' THEN 2 ELSE disposition END",
        "owner": "CASE WHEN outcome <> 'blocked' THEN lease_owner END",
        "expires_us": "CASE WHEN outcome <> 'blocked' THEN lease_expires_us END",
        "event_us": "CASE WHEN outcome = 'blocked' THEN event_us ELSE at_us END",
        "event_kind": "CASE WHEN outcome = 'blocked' THEN 'compensation_blocked' END",
        "position": "CASE WHEN outcome = 'blocked' THEN 'blocked:' || seq END",
        "cp_state": "CASE WHEN outcome = 'blocked' THEN 3 END",
    },
    "reverse_reconcile": _unknown("undo_tries", False),
    "reverse_pending": _silent("undo_sent"),
    "heartbeat": {"expires_us": f"CASE WHEN outcome = 'extended' THEN {_LEASE} ELSE lease_expires_us END"},
    "release": {
        "owner": "CASE WHEN outcome <> 'released' THEN lease_owner END",
        "expires_us": "CASE WHEN outcome <> 'released' THEN lease_expires_us END",
        "next_us": "CASE WHEN outcome = 'released' THEN next_us ELSE next_attempt_us END",
    },
    "claim_by_id": {
        "owner": "CASE WHEN outcome = 'claimed' THEN executor ELSE lease_owner END",
        "expires_us": f"CASE WHEN outcome = 'claimed' THEN {_LEASE} ELSE lease_expires_us END",
        "token": "fencing_token + CASE WHEN outcome = 'claimed' THEN 1 ELSE 0 END",
    },
    "call_submit_guard": {
        "event_us": "CASE WHEN outcome = 'submitted' THEN event_us ELSE at_us END",
        "event_kind": "CASE WHEN outcome = 'submitted' THEN 'call_submitted' END",
        "op_status": "CASE WHEN outcome = 'submitted' THEN 1 END",
        "detail": f"CASE WHEN outcome = 'call_rejected' THEN CASE WHEN call_depth >= max_depth THEN 'max_call_depth_exceeded' ELSE 'call_cycle' END ELSE {_RANGE_DETAIL} END",
        "child_id": "CASE outcome WHEN 'submitted' THEN operation_id WHEN 'already_submitted' THEN child END",
        "child_state": "CASE WHEN outcome = 'submitted' THEN 1 END",
        "child_token": "CASE WHEN outcome = 'submitted' THEN 0 END",
        "child_depth": "CASE WHEN outcome = 'submitted' THEN call_depth + 1 END",
        "child_root": "CASE WHEN outcome <> 'submitted' THEN NULL WHEN root_id IS NULL THEN workflow_id ELSE root_id END",
        "child_event": "CASE WHEN outcome = 'submitted' THEN 'created' END",
    },
    "child_reopen": {
        "event_us": "CASE WHEN outcome = 'reopened' THEN event_us ELSE at_us END",
        "event_kind": "CASE WHEN outcome = 'reopened' THEN 'compensation_requested' END",
        "position": "CASE WHEN outcome = 'reopened' THEN 'child:reverse:' || kid_top END",
        "child_id": "CASE WHEN outcome IN ('reopened', 'already_reopened', 'child_state_inconsistent') THEN child END",
        "child_state": "CASE WHEN outcome = 'reopened' THEN 2 WHEN outcome IN ('already_reopened', 'child_state_inconsistent') THEN kid_state END",
        "child_token": "CASE WHEN outcome = 'reopened' THEN kid_token + 1 END",
        "child_event": "CASE WHEN outcome = 'reopened' THEN 'compensation_requested_by_parent' END",
    },
    "child_settle": {
        **_SETTLED_BACK,
        "child_id": "CASE WHEN outcome IN ('reversed', 'reversing', 'child_not_terminal', 'child_not_compensated') THEN child END",
        "child_state": "CASE WHEN outcome IN ('reversed', 'reversing', 'child_not_terminal', 'child_not_compensated') THEN kid_state END",
    },
    "call_hint": {"hint_us": "CASE WHEN outcome <> 'refreshed' THEN NULL WHEN seen_us IS NULL THEN event_us ELSE greatest(event_us, seen_us) END"},
}

_WORKFLOW = {"state": ("INT", "state"), "direction": ("INT", "direction"), "disposition": ("INT", "disposition"), "owner": ("BIGINT", "lease_owner"), "expires_us": ("BIGINT", "lease_expires_us"), "token": ("BIGINT", "fencing_token"), "next_us": ("BIGINT", "next_attempt_us"), "event_us": ("BIGINT", "at_us"), "trigger_id": ("BIGINT", "trigger_id"), "terminal_reason": ("VARCHAR", "terminal_reason"), "return_json": ("VARCHAR", "return_json")}
_OTHERS = {"event_kind": "VARCHAR", "position": "VARCHAR", "detail": "VARCHAR", "result": "BIGINT", "op_status": "INT", "attempts": "INT", "redispatches": "INT", "cp_state": "INT", "cp_reverse_id": "BIGINT", "child_id": "BIGINT", "child_state": "INT", "child_token": "BIGINT", "child_depth": "INT", "child_root": "BIGINT", "child_event": "VARCHAR", "hint_us": "BIGINT"}


def oracle(procedure: str) -> str:
    """The SQL of one procedure over all commands."""
    changed = CHANGED[procedure]
    rows = [f"CAST({changed.get(c, kept)} AS {kind}) AS new_{c}" for c, (kind, kept) in _WORKFLOW.items()]
    rows += [f"CAST({changed.get(c, 'NULL')} AS {kind}) AS {c}" for c, kind in _OTHERS.items()]
    last = "greatest(at_us, kid_us)" if procedure == "child_reopen" else "at_us"
    return f"""{_CONTEXT}, decided AS (SELECT *, {OUTCOME[procedure]} AS outcome FROM x)
SELECT workflow_id, outcome, CAST(CASE WHEN outcome = 'event_time_skew' THEN {last} + 5000000 END AS BIGINT) AS defer_until_us, {", ".join(rows)} FROM decided"""
