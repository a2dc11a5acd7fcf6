"""Invariants of the control tables as set-level checks: the rows that break each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.plans.catalog import register
from tidemill.sources.fixtures import Fixtures

#: Name -> (view, condition that a sound row meets).  They run on a copy of the fixture that has unsound rows.
CHECKS: dict[str, tuple[str, str]] = {
    "state_code": ("dirty_workflow", "state BETWEEN 1 AND 7"),
    "direction_code": ("dirty_workflow", "execution_direction IN (1, 2)"),
    "state_disposition": ("dirty_workflow", "(state = 1 AND current_disposition = 0) OR (state IN (2, 5, 7) AND current_disposition IN (2, 3)) OR (state IN (3, 6) AND current_disposition IN (2, 3, 4)) OR (state = 4 AND current_disposition = 1)"),
    "state_direction": ("dirty_workflow", "(state IN (1, 4) AND execution_direction = 1) OR (state IN (2, 5, 7) AND execution_direction = 2) OR (state IN (3, 6) AND execution_direction IN (1, 2))"),
    "lease_pair": ("dirty_workflow", "(lease_owner IS NULL) = (lease_expires_us IS NULL)"),
    "return_document": ("dirty_workflow", "(state = 4) = (return_json IS NOT NULL)"),
    "ancestry": ("dirty_workflow", "(parent_id IS NULL AND root_id IS NULL AND call_depth = 0) OR (parent_id IS NOT NULL AND root_id IS NOT NULL AND call_depth >= 1)"),
}


def broken(rows: DataFrame, condition: str, key: str = "workflow_id") -> DataFrame:
    """Keys of rows that do not meet a condition; an unknown condition is not met."""
    return rows.where(~F.coalesce(F.expr(condition), F.lit(False))).select(key)


#: The same checks in DuckDB SQL, by what is unsound and written apart from the conditions above.
_UNSOUND = {
    "state_code": "state IS NULL OR state NOT IN (1, 2, 3, 4, 5, 6, 7)",
    "direction_code": "execution_direction IS NULL OR execution_direction < 1 OR execution_direction > 2",
    "state_disposition": "NOT coalesce(list_contains(CASE state WHEN 1 THEN [0] WHEN 2 THEN [2, 3] WHEN 3 THEN [2, 3, 4] WHEN 4 THEN [1] WHEN 5 THEN [2, 3] WHEN 6 THEN [2, 3, 4] WHEN 7 THEN [2, 3] END, current_disposition), false)",
    "state_direction": "NOT coalesce(list_contains(CASE state WHEN 1 THEN [1] WHEN 2 THEN [2] WHEN 3 THEN [1, 2] WHEN 4 THEN [1] WHEN 5 THEN [2] WHEN 6 THEN [1, 2] WHEN 7 THEN [2] END, execution_direction), false)",
    "lease_pair": "(lease_owner IS NULL AND lease_expires_us IS NOT NULL) OR (lease_owner IS NOT NULL AND lease_expires_us IS NULL)",
    "return_document": "(state = 4 AND return_json IS NULL) OR (state IS DISTINCT FROM 4 AND return_json IS NOT NULL) OR state IS NULL",
    "ancestry": "CASE WHEN parent_id IS NULL THEN root_id IS NOT NULL OR call_depth IS DISTINCT FROM 0 ELSE root_id IS NULL OR call_depth IS NULL OR call_depth < 1 END",
}

for _name, (_view, _sound) in CHECKS.items():
    register(f"inv_{_name}", (lambda fx, view=_view, sound=_sound: broken(getattr(fx, view), sound)), f"SELECT workflow_id FROM {{{_view}}} WHERE {_UNSOUND[_name]}")


def _operation_result(fx: Fixtures) -> DataFrame:
    return broken(fx.dirty_operation, "(status = 1) = (result IS NULL)", "operation_id")


def _unique_operation(fx: Fixtures) -> DataFrame:
    return fx.dirty_operation.groupBy("operation_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("operation_id", "n")


def _unique_child(fx: Fixtures) -> DataFrame:
    return fx.dirty_call.groupBy("child_id").agg(F.countDistinct("workflow_id").alias("n")).where("n <> 1").select("child_id", "n")


def _orphans(fx: Fixtures) -> DataFrame:
    """Events whose workflow does not exist or has ended unsoundly."""
    sound = fx.dirty_workflow.where("state BETWEEN 1 AND 7").select("workflow_id")
    return fx.event.join(sound, "workflow_id", "left_anti").select("workflow_id", "event_us")


def _event_order(fx: Fixtures) -> DataFrame:
    """Log rows of a work item that are not strictly later than the row before."""
    before = F.lag("event_us").over(Window.partitionBy("item_key").orderBy("seq"))
    return fx.dirty_history.withColumn("before_us", before).where("event_us <= before_us").select("item_key", "seq")


def _history_pairs(fx: Fixtures) -> DataFrame:
    """Log rows whose kind of event, status and lease do not go together."""
    return broken(fx.dirty_history, "(event_type IN (10, 11) AND status = 1 AND lease_expires_us IS NOT NULL) OR (event_type = 20 AND status = 2) OR (event_type = 40 AND status = 3)", "item_key")


def _contiguous(fx: Fixtures) -> DataFrame:
    """Operations whose predecessor is missing or has not settled."""
    w = Window.partitionBy("workflow_id").orderBy("operation_seq")
    rows = fx.operation.withColumn("before_status", F.lag("status").over(w)).withColumn("before_seq", F.lag("operation_seq").over(w))
    return rows.where("operation_seq > 1 AND (before_seq IS NULL OR before_seq <> operation_seq - 1 OR before_status <> 2)").select("workflow_id", "operation_seq")


register("inv_operation_result", _operation_result, "SELECT operation_id FROM {dirty_operation} WHERE CASE status WHEN 1 THEN result IS NOT NULL ELSE result IS NULL OR status IS NULL END")
register("inv_unique_operation", _unique_operation, "SELECT DISTINCT operation_id, n FROM (SELECT operation_id, count(*) OVER (PARTITION BY operation_id) AS n FROM {dirty_operation}) WHERE n >= 2")
register("inv_unique_child", _unique_child, "SELECT child_id, len(list(DISTINCT workflow_id)) AS n FROM {dirty_call} GROUP BY child_id HAVING min(workflow_id) < max(workflow_id)")
register("inv_event_owner", _orphans, "SELECT e.workflow_id, e.event_us FROM {event} e WHERE NOT EXISTS (SELECT 1 FROM {dirty_workflow} w WHERE w.workflow_id = e.workflow_id AND w.state BETWEEN 1 AND 7)")
register("inv_event_order", _event_order, "SELECT h.item_key, h.seq FROM {dirty_history} h JOIN {dirty_history} b ON b.item_key = h.item_key AND b.seq = h.seq - 1 WHERE NOT h.event_us > b.event_us")
register("inv_contiguous", _contiguous, "SELECT o.workflow_id, o.operation_seq FROM {operation} o LEFT JOIN {operation} b ON b.workflow_id = o.workflow_id AND b.operation_seq = o.operation_seq - 1 WHERE o.operation_seq > 1 AND (b.status IS NULL OR b.status <> 2)")
register("inv_history_pairs", _history_pairs, "SELECT item_key FROM {dirty_history} WHERE CASE event_type WHEN 10 THEN status <> 1 OR lease_expires_us IS NULL WHEN 11 THEN status <> 1 OR lease_expires_us IS NULL WHEN 20 THEN status <> 2 WHEN 40 THEN status <> 3 ELSE true END")
