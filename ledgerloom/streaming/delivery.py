"""The outbox as a keyed state machine over a stream of delivery results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.functions.scalars import BACKOFF_BASE, BACKOFF_CAP, MOST_ATTEMPTS
from ledgerloom.vocab import RETRYABLE_STATUSES

STATE = "attempts int, outcome string"
OUTPUT = "name string, attempts int, outcome string, wait_seconds bigint"


def step(attempts: int, status: int, most: int = MOST_ATTEMPTS, base: int = BACKOFF_BASE, cap: int = BACKOFF_CAP) -> tuple[int, str, int | None]:
    """(attempts, outcome, seconds to wait) after a delivery's status: the batch transition for one item."""
    if 200 <= status <= 299:
        return attempts, "delivered", None
    attempts += 1
    if (status in RETRYABLE_STATUSES or status >= 500) and attempts < most:
        return attempts, "retrying", min(cap, base * 2 ** max(0, attempts - 1))
    return attempts, "quarantined", None


def deliveries(results: DataFrame) -> DataFrame:
    """A stream (name, ord, status) of tries as a stream of each item's state after every batch; ended items take no further tries."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts, outcome = state.get if state.exists else (0, "pending")
        wait = None
        for status in pd.concat(list(frames)).sort_values("ord")["status"]:
            if outcome in ("delivered", "quarantined"):
                break
            attempts, outcome, wait = step(int(attempts), int(status))
        state.update((attempts, outcome))
        yield pd.DataFrame({"name": [key[0]], "attempts": [attempts], "outcome": [outcome], "wait_seconds": pd.array([wait], dtype="Int64")})

    return results.groupBy("name").applyInPandasWithState(run, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)
