"""Timers over a stream of workflow updates: a workflow comes out once its next attempt is due.

State per workflow is its latest next attempt; its timer is the stream's event time,
so a workflow is due when the watermark passes its next attempt, not when some
machine's clock does.  A later update moves the timer, one without next attempt
stops it, and one that is older than what is known changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

UPDATE = "workflow_id long, updated timestamp, next_attempt_us long"
STATE = "updated_us long, due_us long"
RESULT = "workflow_id long, due_us long"


def due(updates: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """RESULT rows of a stream of UPDATE rows that may come ``delay`` late."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            _, at = held.get
            held.remove()
            yield pd.DataFrame({"workflow_id": [key[0]], "due_us": [at]})
            return
        last = pd.concat(batches).sort_values("updated", kind="stable").iloc[-1]
        updated = last["updated"].value // 1000
        if held.exists and held.get[0] > updated:
            held.setTimeoutTimestamp(max(held.get[1] // 1000, held.getCurrentWatermarkMs() + 1))
            return
        if pd.isna(last["next_attempt_us"]):
            if held.exists:
                held.remove()
            return
        at = int(last["next_attempt_us"])
        held.update((updated, at))
        held.setTimeoutTimestamp(max(at // 1000, held.getCurrentWatermarkMs() + 1))

    return updates.withWatermark("updated", delay).groupBy("workflow_id").applyInPandasWithState(step, RESULT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
