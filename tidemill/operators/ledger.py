"""The idempotency ledger: grants, replays and settlements over a log of lease events.

A work item is its latest log row.  Commands join the item and its head row on the
item's key; outcomes are ordered rules as in ``commands``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.plans.catalog import query
from tidemill.sources.fixtures import Fixtures


def heads(fx: Fixtures) -> DataFrame:
    """Commands with their item and its head row; null where there is no item."""
    item = fx.work_item
    head = fx.ledger_history.select("item_key", F.col("event_us").alias("current_event_us"), "status", "lease_owner", "lease_expires_us", "payload")
    own = item.join(head, ["item_key", "current_event_us"], "left").withColumn("known", F.lit(True))
    command = fx.ledger_command.select("item_key", F.col("event_us").alias("at_us"), "token")
    return command.join(own, "item_key", "left")


_HEADS_SQL = """heads AS (
  SELECT m.item_key, m.event_us AS at_us, m.token, i.item_key IS NOT NULL AS known, i.current_event_us, i.current_token, i.terminal_token, h.status, h.lease_owner, h.lease_expires_us, h.payload
  FROM {ledger_command} m LEFT JOIN {work_item} i ON i.item_key = m.item_key LEFT JOIN {ledger_history} h ON h.item_key = i.item_key AND h.event_us = i.current_event_us
)"""


@query(
    "ledger_start",
    "WITH asked AS (SELECT item_key, event_us, 0 AS copy FROM {ledger_command} UNION ALL SELECT item_key, event_us, 1 FROM {ledger_command} WHERE item_key % 2 = 0) SELECT m.item_key, m.event_us, m.copy, CASE WHEN i.item_key IS NULL AND row_number() OVER (PARTITION BY m.item_key ORDER BY m.event_us, m.copy) = 1 THEN 'granted' ELSE 'exists' END AS outcome FROM asked m LEFT JOIN {work_item} i ON i.item_key = m.item_key",
)
def start(fx: Fixtures) -> DataFrame:
    """Granted for keys without an item, to the first that asks in a batch; exists for the others, the losers of a race among them."""
    asked = fx.ledger_command.select("item_key", "event_us", F.lit(0).alias("copy"))
    asked = asked.unionByName(asked.where("item_key % 2 = 0").withColumn("copy", F.lit(1)))  # every other key is asked for twice
    first = F.row_number().over(Window.partitionBy("item_key").orderBy("event_us", "copy")) == 1
    rows = asked.withColumn("first", first).join(fx.work_item.select("item_key", F.lit(True).alias("held")), "item_key", "left")
    return rows.select("item_key", "event_us", "copy", F.when(F.col("held").isNull() & F.col("first"), "granted").otherwise("exists").alias("outcome"))


@query(
    "ledger_resume",
    f"""WITH {_HEADS_SQL}, claims AS (SELECT item_key, count(*) AS n FROM {{ledger_history}} WHERE event_type = 10 GROUP BY item_key), decided AS (
  SELECT h.*, coalesce(c.n, 0) AS n, CASE WHEN current_event_us IS NULL THEN 'not_found' WHEN status IN (2, 3) THEN 'terminal' WHEN NOT (at_us > lease_expires_us) THEN 'active' WHEN at_us <= current_event_us THEN 'event_time_conflict' ELSE 'granted' END AS outcome
  FROM heads h LEFT JOIN claims c ON c.item_key = h.item_key)
SELECT item_key, outcome, CASE WHEN outcome = 'granted' THEN CAST(n AS BIGINT) END AS recovery_attempt, CASE WHEN outcome = 'active' THEN lease_expires_us END AS lease_expires_us FROM decided""",
)
def resume(fx: Fixtures) -> DataFrame:
    """Terminal items replay; a lease that has not expired is active; an expired one is granted anew with its attempt number."""
    claims = fx.ledger_history.where("event_type = 10").groupBy("item_key").agg(F.count(F.lit(1)).alias("n"))
    df = heads(fx).join(claims, "item_key", "left")
    outcome = (
        F.when(F.col("current_event_us").isNull(), "not_found")
        .when(F.col("status").isin(2, 3), "terminal")
        .when(~(F.col("at_us") > F.col("lease_expires_us")), "active")
        .when(F.col("at_us") <= F.col("current_event_us"), "event_time_conflict")
        .otherwise("granted")
    )
    df = df.withColumn("outcome", outcome)
    return df.select("item_key", "outcome", F.when(F.col("outcome") == "granted", F.coalesce("n", F.lit(0))).alias("recovery_attempt"), F.when(F.col("outcome") == "active", F.col("lease_expires_us")).alias("lease_expires_us"))


def _settle_sql(new_status: int) -> str:
    return f"""WITH {_HEADS_SQL}
SELECT item_key, CASE WHEN current_event_us IS NULL THEN 'not_found' WHEN status = 1 AND token IS NOT DISTINCT FROM current_token THEN 'settled' WHEN status > 1 AND token IS NOT DISTINCT FROM terminal_token THEN 'settled' ELSE 'token_stale' END AS outcome,
  CAST(CASE WHEN status = 1 AND token IS NOT DISTINCT FROM current_token THEN {new_status} WHEN status > 1 AND token IS NOT DISTINCT FROM terminal_token THEN status END AS INT) AS settled_status FROM heads"""


def _settle(fx: Fixtures, new_status: int) -> DataFrame:
    """The holder of the current token settles; the one who settled gets its own result again; others are stale."""
    df = heads(fx)
    holder = (F.col("status") == 1) & F.col("token").eqNullSafe(F.col("current_token"))
    writer = (F.col("status") > 1) & F.col("token").eqNullSafe(F.col("terminal_token"))
    outcome = F.when(F.col("current_event_us").isNull(), "not_found").when(holder | writer, "settled").otherwise("token_stale")
    return df.select("item_key", outcome.alias("outcome"), F.when(holder, F.lit(new_status)).when(writer, F.col("status")).cast("int").alias("settled_status"))


@query("ledger_complete", _settle_sql(2))
def complete(fx: Fixtures) -> DataFrame:
    return _settle(fx, 2)


@query("ledger_fail", _settle_sql(3))
def fail(fx: Fixtures) -> DataFrame:
    return _settle(fx, 3)


@query(
    "ledger_extend",
    f"""WITH {_HEADS_SQL} SELECT item_key, CASE WHEN current_event_us IS NULL THEN 'not_found' WHEN status IN (2, 3) AND token IS NOT DISTINCT FROM terminal_token THEN 'terminal' WHEN status IN (2, 3) THEN 'token_stale'
  WHEN token IS DISTINCT FROM current_token THEN 'token_stale' WHEN at_us <= current_event_us THEN 'event_time_conflict' ELSE 'extended' END AS outcome FROM heads""",
)
def extend(fx: Fixtures) -> DataFrame:
    terminal = F.col("status").isin(2, 3)
    outcome = (
        F.when(F.col("current_event_us").isNull(), "not_found")
        .when(terminal & F.col("token").eqNullSafe(F.col("terminal_token")), "terminal")
        .when(terminal | ~F.col("token").eqNullSafe(F.col("current_token")), "token_stale")
        .when(F.col("at_us") <= F.col("current_event_us"), "event_time_conflict")
        .otherwise("extended")
    )
    return heads(fx).select("item_key", outcome.alias("outcome"))


@query(
    "ledger_inspect",
    f"""WITH {_HEADS_SQL} SELECT item_key, CASE WHEN NOT known THEN 'not_found' WHEN status IS NULL THEN 'dangling_head' WHEN status = 1 THEN 'working' ELSE 'terminal' END AS outcome,
  CASE status WHEN 2 THEN 'done' WHEN 3 THEN 'failed' END AS state, CASE WHEN status = 1 THEN lease_owner END AS lease_owner, CASE WHEN status = 1 THEN lease_expires_us END AS lease_expires_us, CASE WHEN status > 1 THEN payload END AS payload FROM heads""",
)
def inspect(fx: Fixtures) -> DataFrame:
    """The item's head as its caller sees it; an item that points at no log row is flagged."""
    working = F.col("status") == 1
    return heads(fx).select(
        "item_key",
        F.when(F.col("known").isNull(), "not_found").when(F.col("status").isNull(), "dangling_head").when(working, "working").otherwise("terminal").alias("outcome"),
        F.when(F.col("status") == 2, "done").when(F.col("status") == 3, "failed").alias("state"),
        F.when(working, F.col("lease_owner")).alias("lease_owner"),
        F.when(working, F.col("lease_expires_us")).alias("lease_expires_us"),
        F.when(F.col("status") > 1, F.col("payload")).alias("payload"),
    )


@query(
    "ledger_history",
    """SELECT item_key, seq, CASE event_type WHEN 10 THEN 'claimed' WHEN 11 THEN 'extended' WHEN 20 THEN 'completed' ELSE 'failed' END AS event, status, lower(hex(CAST(lease_owner AS BIGINT))) AS lease_owner, lease_expires_us FROM {ledger_history} ORDER BY item_key, seq""",
)
def history(fx: Fixtures) -> DataFrame:
    """Decoded log rows, oldest first; rows without a lease have no expiry."""
    names = F.create_map(*[F.lit(x) for pair in ((10, "claimed"), (11, "extended"), (20, "completed"), (40, "failed")) for x in pair])
    return fx.ledger_history.select("item_key", "seq", F.element_at(names, F.col("event_type")).alias("event"), "status", F.lower(F.hex("lease_owner")).alias("lease_owner"), "lease_expires_us").orderBy("item_key", "seq")


@query(
    "ledger_replay",
    "SELECT item_key, max(event_us) AS current_event_us, arg_max(status, seq) AS status, arg_max(CASE WHEN status = 1 THEN lease_token ELSE -1 END, seq) AS holder, CAST(count(*) AS BIGINT) AS n_events FROM {ledger_history} GROUP BY item_key",
)
def replay(fx: Fixtures) -> DataFrame:
    """The projection as a fold of the log: the latest row of each key wins."""
    latest = F.max_by(F.struct("event_us", "status", F.when(F.col("status") == 1, F.col("lease_token")).otherwise(-1).alias("holder")), "seq")
    return fx.ledger_history.groupBy("item_key").agg(latest.alias("head"), F.count(F.lit(1)).alias("n_events")).select("item_key", F.col("head.event_us").alias("current_event_us"), "head.status", "head.holder", "n_events")


@query(
    "recovery_attempts",
    "SELECT item_key, seq, CAST(coalesce(sum(CASE WHEN event_type = 10 THEN 1 ELSE 0 END) OVER (PARTITION BY item_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS attempt FROM {ledger_history}",
)
def recovery_attempts(fx: Fixtures) -> DataFrame:
    """How many claims came before each log row."""
    before = Window.partitionBy("item_key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return fx.ledger_history.select("item_key", "seq", F.coalesce(F.sum(F.when(F.col("event_type") == 10, 1).otherwise(0)).over(before), F.lit(0)).alias("attempt"))
