"""The frontier online: leases and ends of requests as state per (job, URL)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "job_id long, url string, status string, retry_count long"
STATE = "status string, retry_count long, lease_expires_at double, next_fetch_at double"


def move(state: tuple, kind: str, at: float, lease_seconds: float, max_retries: int) -> tuple:
    """(status, retry_count, lease_expires_at, next_fetch_at) after an event; one that does not fit the status changes nothing."""
    status, retries, lease, due = state
    if status == "in_progress" and lease < at:
        status = "queued"
    if kind == "enqueue" and status == "none":
        return "queued", 0, 0.0, 0.0
    if kind == "lease" and status == "queued" and due <= at:
        return "in_progress", retries, at + lease_seconds, due
    if status == "in_progress" and kind in ("fetched", "gone"):
        return ("fetched" if kind == "fetched" else "error"), retries, lease, due
    if status == "in_progress" and kind == "failed":
        if retries < max_retries:
            return "queued", retries + 1, lease, at + min(2.0 * 2.0**retries, 300.0)
        return "error", retries, lease, due
    return status, retries, lease, due


def leases(events: DataFrame, lease_seconds: float = 300.0, max_retries: int = 2) -> DataFrame:
    """Status of each request after every micro-batch of events (job_id, url, at, id, kind: enqueue, lease, fetched, failed or gone).

    An expired lease is given back when the next event of its request comes. A batch of one request is sorted by time, then id.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else ("none", 0, 0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        for kind, at in zip(rows["kind"], rows["at"], strict=True):
            now = move(now, kind, at, lease_seconds, max_retries)
        state.update(now)
        yield pd.DataFrame({"job_id": [key[0]], "url": [key[1]], "status": [now[0]], "retry_count": [now[1]]})

    return events.groupBy("job_id", "url").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
