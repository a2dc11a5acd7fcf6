"""The ledger as a stream: lease events fold into each item's current state, late ones are set aside.

State per item is a few values, checkpointed by Spark.  An event must be strictly
later than the state's; one that is not is rejected, with the time from which a
retry would be taken.  The batch counterpart is ``ledger.replay``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Microseconds after the state's time from which a rejected event may be tried again.
RETRY_US = 5_000_000
#: Result rows in a batch.
ROWS = 10_000

EVENT = "item_key long, event_us long, event_type int, status int, lease_token long"
STATE = "event_us long, status int, holder long, n_events long"
RESULT = "item_key long, event_us long, accepted boolean, reason string, status int, holder long, n_events long, retry_us long"


def decide(state: tuple[int, int, int, int] | None, event_us: int, event_type: int, status: int, token: int) -> tuple[tuple[int, int, int, int] | None, str | None]:
    """The next state, and why an event is rejected if it is.

    Terminal items take no more events; claims rotate the holder, every other event
    must come from the holder.
    """
    if state is None:
        return ((event_us, status, token, 1), None) if event_type == 10 else (None, "not_found")
    at, was, holder, n = state
    if was != 1:
        return state, "terminal"
    if event_us <= at:
        return state, "event_time_skew"
    if event_type != 10 and token != holder:
        return state, "token_stale"
    return (event_us, status, token if status == 1 else -1, n + 1), None


def fold(events: DataFrame) -> DataFrame:
    """RESULT rows, one an event, for a stream of EVENT rows."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = tuple(held.get) if held.exists else None
        # An item's events of a micro-batch come in several Arrow batches; they are put in order together, four longs each.
        mine = pd.concat(batches).sort_values("event_us", kind="stable")
        for lo in range(0, len(mine), ROWS):
            out = []
            for e in mine.iloc[lo : lo + ROWS].itertuples(index=False):
                state, reason = decide(state, int(e.event_us), int(e.event_type), int(e.status), int(e.lease_token))
                at, status, holder, n = state or (0, 0, -1, 0)
                out.append((key[0], int(e.event_us), reason is None, reason, status, holder, n, at + RETRY_US if reason == "event_time_skew" else None))
            frame = pd.DataFrame(out, columns=["item_key", "event_us", "accepted", "reason", "status", "holder", "n_events", "retry_us"])
            frame["retry_us"] = frame["retry_us"].astype("Int64")
            yield frame
        if state is not None:
            held.update(state)

    return events.groupBy("item_key").applyInPandasWithState(step, RESULT, STATE, "append", GroupStateTimeout.NoTimeout)
