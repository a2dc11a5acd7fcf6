"""Workflow tables derived from the driver's parquet tables.

Each view is one SQL text that Spark and DuckDB both take, so that queries and
their oracles start from the same rows.  Times are microseconds since 1970 (``_us``)
and every computed column is cast.  ``US(x)`` stands for the engine's conversion of
a timestamp without zone.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: The clock of all queries: 1995-06-17 00:00:00, never the machine's.
NOW_US = 803_347_200_000_000
SECOND, HOUR = 1_000_000, 3_600_000_000

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS: dict[str, str] = {
    "workflow": f"""
SELECT workflow_id, script_name, owner_id, state,
  CAST(CASE WHEN state IN (1, 4) THEN 1 WHEN state IN (2, 5, 7) THEN 2 ELSE 1 + workflow_id % 2 END AS INT) AS execution_direction,
  CAST(CASE state WHEN 1 THEN 0 WHEN 2 THEN 2 + workflow_id % 2 WHEN 3 THEN 2 + workflow_id % 3 WHEN 4 THEN 1 WHEN 5 THEN 2 WHEN 6 THEN 4 ELSE 2 END AS INT) AS current_disposition,
  CAST(1 + workflow_id % 5 AS BIGINT) AS fencing_token,
  CASE WHEN state IN (1, 2) AND workflow_id % 3 = 0 THEN owner_id END AS lease_owner,
  CASE WHEN state IN (1, 2) AND workflow_id % 3 = 0 THEN CAST({NOW_US} + (owner_id % 5 - 2) * 30 * {SECOND} AS BIGINT) END AS lease_expires_us,
  CAST(created_us + (workflow_id % 97) * {HOUR} AS BIGINT) AS next_attempt_us,
  CAST(created_us + (workflow_id % 11) * {SECOND} AS BIGINT) AS current_event_us,
  created_us, created_at,
  CAST(CASE WHEN r > 0 THEN workflow_id - r + floor((r - 1) / 3) END AS BIGINT) AS parent_id,
  CAST(CASE WHEN r > 0 THEN workflow_id - r END AS BIGINT) AS root_id,
  CAST(CASE WHEN r = 0 THEN 0 WHEN r <= 3 THEN 1 ELSE 2 END AS INT) AS call_depth,
  CAST(CASE WHEN r > 0 THEN (r - 1) % 3 + 1 END AS INT) AS call_seq,
  CASE WHEN state IN (2, 5, 6, 7) THEN CAST(workflow_id * 100 + 1 AS BIGINT) END AS trigger_id,
  CASE state WHEN 5 THEN 'declined' WHEN 6 THEN 'accepted' WHEN 7 THEN 'refused' END AS terminal_reason,
  CASE WHEN state = 4 THEN '{{{{"ok":true}}}}' END AS return_json
FROM (
  SELECT CAST(o_orderkey AS BIGINT) AS workflow_id, o_orderpriority AS script_name, CAST(o_custkey AS BIGINT) AS owner_id,
    CAST(CASE o_orderstatus WHEN 'F' THEN 4 WHEN 'O' THEN CASE WHEN o_custkey % 5 = 0 THEN 3 ELSE 1 END
      ELSE CASE o_custkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 5 WHEN 2 THEN 6 ELSE 7 END END AS INT) AS state,
    CAST(US(o_orderdate) AS BIGINT) AS created_us, o_orderdate AS created_at, CAST(o_orderkey % 10 AS BIGINT) AS r
  FROM {{orders}}
) AS o""",
    "operation": """
SELECT workflow_id, operation_seq, CAST(workflow_id * 100 + operation_seq AS BIGINT) AS operation_id, operation_name,
  CAST(1 + part_id % 2 AS INT) AS schema_version, md5(CAST(part_id AS STRING)) AS input_hash,
  CAST(CASE WHEN operation_seq % 4 = 0 THEN 2 ELSE 1 END AS INT) AS call_kind, status,
  CASE WHEN status = 2 THEN part_id END AS result, return_flag, part_id,
  CAST(CASE WHEN quantity > 45 THEN quantity - 45 ELSE 0 END AS INT) AS reconcile_attempts,
  CASE WHEN quantity > 45 THEN ship_us END AS reconcile_first_us,
  CAST(CASE WHEN discount >= 0.095 THEN 1 ELSE 0 END AS INT) AS redispatch_count,
  CASE WHEN discount >= 0.085 THEN ship_us END AS redispatch_first_us,
  CASE WHEN discount >= 0.095 THEN CAST(ship_us + 30000000 AS BIGINT) END AS redispatch_last_us
FROM (
  SELECT CAST(l_orderkey AS BIGINT) AS workflow_id, 'part' || CAST(l_partkey % 50 AS STRING) AS operation_name, CAST(l_partkey AS BIGINT) AS part_id,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS INT) AS operation_seq,
    CAST(CASE WHEN l_linestatus = 'F' THEN 2 ELSE 1 END AS INT) AS status, l_returnflag AS return_flag,
    CAST(floor(l_quantity) AS INT) AS quantity, l_discount AS discount, CAST(US(l_shipdate) AS BIGINT) AS ship_us
  FROM {lineitem}
) AS l""",
    "plan": """
SELECT w.workflow_id, '1.' || CAST(w.owner_id % 3 AS STRING) || '.0' AS plan_version,
  md5(w.script_name || '1.' || CAST(w.owner_id % 3 AS STRING)) AS content_hash, n.plan_length
FROM {workflow} AS w JOIN (SELECT workflow_id, CAST(count(*) AS INT) AS plan_length FROM {operation} GROUP BY workflow_id) AS n ON n.workflow_id = w.workflow_id
WHERE w.workflow_id % 11 <> 0""",
    "checkpoint": """
SELECT workflow_id, operation_seq AS seq, operation_name, operation_id,
  CAST(CASE return_flag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS INT) AS reversal_state,
  CASE WHEN part_id % 3 <> 0 THEN CAST(operation_id * 10 + 1 AS BIGINT) END AS reverse_id,
  reconcile_attempts, reconcile_first_us, redispatch_count, redispatch_first_us, redispatch_last_us
FROM {operation} WHERE status = 2""",
    "call": """
SELECT w.parent_id AS workflow_id, w.call_seq AS operation_seq, w.workflow_id AS child_id, w.script_name AS child_script, p.plan_version AS child_version, p.content_hash AS child_hash,
  CAST(CASE WHEN w.state = 4 THEN 2 WHEN w.state IN (5, 6, 7) THEN 3 WHEN w.state = 3 THEN 4 ELSE 1 END AS INT) AS child_status,
  CASE WHEN w.workflow_id % 3 > 0 THEN CAST(w.created_us + (w.workflow_id % 7) * 1000000 AS BIGINT) END AS last_inspected_us
FROM {workflow} AS w LEFT JOIN {plan} AS p ON p.workflow_id = w.workflow_id WHERE w.parent_id IS NOT NULL""",
    "event": """
SELECT CAST(user_id AS BIGINT) AS workflow_id, CAST(US(ts) AS BIGINT) AS event_us, props AS payload, event_id,
  CASE event_type WHEN 'click' THEN 'operation_requested' WHEN 'view' THEN 'operation_settled' WHEN 'purchase' THEN 'workflow_completed'
    WHEN 'error' THEN 'operation_failed' ELSE 'operation_dispatch_deferred' END AS kind
FROM {events}""",
    "command": f"""
SELECT w.workflow_id, CAST(CASE WHEN w.workflow_id % 5 = 1 THEN w.owner_id + 1 ELSE w.owner_id END AS BIGINT) AS executor,
  CAST(w.fencing_token + CASE WHEN w.workflow_id % 7 = 3 THEN 1 ELSE 0 END AS BIGINT) AS token,
  CAST(1 + w.workflow_id % 6 AS INT) AS seq,
  CAST(w.workflow_id * 100 + 1 + w.workflow_id % 6 + CASE WHEN w.workflow_id % 13 = 5 THEN 50 ELSE 0 END AS BIGINT) AS operation_id,
  CAST((w.workflow_id * 100 + 1 + w.workflow_id % 6) * 10 + CASE WHEN w.workflow_id % 17 = 4 THEN 2 ELSE 1 END AS BIGINT) AS reverse_id,
  CAST(w.current_event_us + (w.workflow_id % 8 - 1) * {SECOND} AS BIGINT) AS event_us,
  CAST(w.workflow_id % 4 = 0 AS BOOLEAN) AS is_final, CAST({NOW_US} + 5 * {SECOND} AS BIGINT) AS next_us, w.script_name
FROM {{workflow}} AS w
UNION ALL
SELECT CAST(-1 - region.r_regionkey AS BIGINT), CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(1 AS INT), CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST({NOW_US} AS BIGINT), false, CAST({NOW_US} AS BIGINT), 'none'
FROM {{region}} AS region""",
    "ledger_history": f"""
SELECT item_key, seq, event_us, event_type, status, lease_owner,
  CASE WHEN status = 1 THEN CAST(event_us + (30 + item_key % 90) * {SECOND} AS BIGINT) END AS lease_expires_us,
  CAST(item_key * 1000 + CASE WHEN event_type = 10 THEN seq ELSE 1 END AS BIGINT) AS lease_token, payload
FROM (
  SELECT CAST(user_id AS BIGINT) AS item_key, seq, event_us, payload, lease_owner,
    CAST(CASE WHEN seq = n AND user_id % 3 = 0 THEN 20 WHEN seq = n AND user_id % 3 = 1 THEN 40 WHEN seq = 1 OR seq % 5 = 0 THEN 10 ELSE 11 END AS INT) AS event_type,
    CAST(CASE WHEN seq = n AND user_id % 3 = 0 THEN 2 WHEN seq = n AND user_id % 3 = 1 THEN 3 ELSE 1 END AS INT) AS status
  FROM (
    SELECT user_id, CAST(US(ts) AS BIGINT) AS event_us, props AS payload, CAST(user_id % 10 AS BIGINT) AS lease_owner,
      CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS seq, CAST(count(*) OVER (PARTITION BY user_id) AS INT) AS n
    FROM {{events}}
  ) AS e
) AS h""",
    "work_item": """
SELECT item_key, event_us AS current_event_us, CASE WHEN status = 1 THEN lease_token END AS current_token, CASE WHEN status > 1 THEN lease_token END AS terminal_token
FROM (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY seq DESC) AS latest FROM {ledger_history}) AS h WHERE latest = 1""",
    "ledger_command": f"""
SELECT c.item_key, CAST(c.current_event_us + (c.item_key % 4 * 40 - 40) * {SECOND} AS BIGINT) AS event_us,
  CAST(CASE WHEN c.item_key % 5 = 0 THEN 0 ELSE coalesce(c.current_token, c.terminal_token) END AS BIGINT) AS token
FROM {{work_item}} AS c
UNION ALL
SELECT CAST(-1 - r_regionkey AS BIGINT), CAST({NOW_US} AS BIGINT), CAST(0 AS BIGINT) FROM {{region}} AS r""",
    "pointed_workflow": """
SELECT w.workflow_id, w.script_name, w.state, w.execution_direction, w.lease_owner, w.next_attempt_us, CAST(coalesce(e.last_us, w.current_event_us) AS BIGINT) AS current_event_us
FROM {workflow} AS w LEFT JOIN (SELECT workflow_id, max(event_us) AS last_us FROM {event} GROUP BY workflow_id) AS e ON e.workflow_id = w.workflow_id""",
    "reasoned_event": """
SELECT workflow_id, event_us, event_id, kind, CASE WHEN event_id % 3 = 0 THEN 'route_unavailable' ELSE 'revision_unavailable' END AS reason FROM {event}""",
    "dirty_workflow": """
SELECT workflow_id, CAST(CASE WHEN workflow_id % 101 = 0 THEN 9 ELSE state END AS INT) AS state,
  CAST(CASE WHEN workflow_id % 103 = 0 THEN 3 ELSE execution_direction END AS INT) AS execution_direction,
  CAST(CASE WHEN workflow_id % 107 = 0 THEN 0 ELSE current_disposition END AS INT) AS current_disposition,
  CASE WHEN workflow_id % 109 = 0 THEN NULL ELSE lease_owner END AS lease_owner, lease_expires_us,
  CASE WHEN workflow_id % 113 = 0 THEN NULL ELSE return_json END AS return_json, parent_id,
  CASE WHEN workflow_id % 127 = 0 THEN NULL ELSE root_id END AS root_id, call_depth
FROM {workflow}""",
    "dirty_operation": """
SELECT workflow_id, operation_seq, CAST(CASE WHEN operation_id % 31 = 0 THEN operation_id + 1 ELSE operation_id END AS BIGINT) AS operation_id, status,
  CASE WHEN operation_id % 37 <> 0 THEN result WHEN status = 1 THEN part_id END AS result
FROM {operation}""",
    "dirty_call": """
SELECT workflow_id, CAST(CASE WHEN child_id % 70 = 3 THEN child_id + 1 ELSE child_id END AS BIGINT) AS child_id FROM {call}""",
    "dirty_history": """
SELECT item_key, seq, CAST(CASE WHEN item_key % 7 = 3 AND seq % 4 = 0 THEN event_us - 3600000000000 WHEN item_key % 5 = 2 AND seq > 2 THEN 0 ELSE event_us END AS BIGINT) AS event_us,
  CAST(CASE WHEN item_key % 23 = 0 THEN 20 ELSE event_type END AS INT) AS event_type, CAST(CASE WHEN item_key % 29 = 0 THEN 2 ELSE status END AS INT) AS status,
  CASE WHEN item_key % 31 <> 0 THEN lease_expires_us END AS lease_expires_us
FROM {ledger_history}""",
}


def _for(engine: str, text: str) -> str:
    us = (lambda m: f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {m[1]})") if engine == "spark" else (lambda m: f"epoch_us({m[1]})")
    return re.sub(r"US\((\w+)\)", us, text)


def _inputs(text: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}", text))]


class Fixtures:
    """The tables and views of one data folder, as attributes; each is read or derived when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            text = _for("spark", VIEWS[name])
            df = self.spark.sql(text, **{n: getattr(self, n) for n in _inputs(text)})
        elif name in TABLES:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        else:
            raise AttributeError(name)
        self.__dict__[name] = df
        return df

    def dealt(self, table: str, key: str) -> Fixtures:
        """The same folder with a table dealt by its key first: views that rename the key are then known to be dealt by it, and are not dealt again to be joined by it."""
        other = Fixtures(self.spark, self.sf_dir)
        other.__dict__[table] = getattr(self, table).repartition(key)
        return other


def oracle(sql: str) -> str:
    """DuckDB SQL with the views that ``sql`` names as {view} in front of it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for n in _inputs(text):
            if n in VIEWS and n not in needed:
                need(VIEWS[n])
                needed.append(n)

    need(sql)
    plain = lambda text: re.sub(r"(?<!\{)\{(\w+)\}", r"\1", _for("duckdb", text)).replace("{{", "{").replace("}}", "}")
    views = ", ".join(f"{n} AS ({plain(VIEWS[n])})" for n in needed)
    body = plain(sql).strip()
    if not views:
        return body
    if re.match(r"WITH RECURSIVE\b", body):
        return f"WITH RECURSIVE {views}, {body[len('WITH RECURSIVE') :].strip()}"
    if re.match(r"WITH\b", body):
        return f"WITH {views}, {body[4:].strip()}"
    return f"WITH {views} {body}"
