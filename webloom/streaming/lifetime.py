"""What lasts for a time: leases that end by a timer, seen keys and caches with a lifetime, as keyed state with timers.

State lies in the session's state store, which must be RocksDB's (`rocksdb` sets it for as long as a stream is started). Times
are event times, so a replay gives the same rows as the live stream: an entry ends when the watermark passes its end, whether
or not another event of its key comes. Every entry has a timer, so a store never holds more than what is alive, and what is
not yet behind the watermark. A micro-batch's events of one key are put in order in memory; the source's limit on files or
offsets a batch (`maxFilesPerTrigger`) bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .frontier import move

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started in here keep their state in RocksDB; the setting of the session comes back afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _millis(seconds: float | None) -> int | None:
    """The first whole millisecond after a time; None: none."""
    return None if seconds is None else int(seconds * 1000) + 1


def _at() -> F.Column:
    return F.unix_micros("ts") / 1_000_000


class _Timed(StatefulProcessor):
    """One timer a key, moved as its state moves. Each call to the state is a message to the store, so a timer's time is told from the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def wake(self, old: int | None, due: int | None) -> None:
        """Moves the key's only timer, in milliseconds; None: none. One that has gone off is removed by the stream."""
        if old == due:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        if due is not None:
            self.handle.registerTimer(due)

    def close(self) -> None:
        pass


class Leases(_Timed):
    """(job_id, url, status, retry_count, n_expired, version) after each batch of a request's events, and when its lease ends by time."""

    OUT = "job_id long, url string, status string, retry_count long, n_expired long, version long"

    def __init__(self, lease_seconds: float, max_retries: int) -> None:
        self.lease_seconds, self.max_retries = lease_seconds, max_retries

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("request", "status string, retry_count long, lease double, due double, n_expired long, version long")

    def _told(self, key: tuple, now: tuple, expired: int, version: int) -> Row:
        self.state.update((*now, expired, version))
        return Row(job_id=key[0], url=key[1], status=now[0], retry_count=now[1], n_expired=expired, version=version)

    def _due(self, now: tuple) -> int | None:
        return _millis(now[2]) if now[0] == "in_progress" else None

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        *now, expired, version = self.state.get() or ("none", 0, 0.0, 0.0, 0, 0)
        now = tuple(now)
        old = self._due(now)
        for at, _, kind in sorted((r.at, r.id, r.kind) for r in rows):
            expired += now[0] == "in_progress" and now[2] < at
            now = move(now, kind, at, self.lease_seconds, self.max_retries)
        self.wake(old, self._due(now))
        yield self._told(tuple(key), now, expired, version + 1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        *now, expired, version = self.state.get()
        if now[0] == "in_progress":
            yield self._told(tuple(key), ("queued", now[1], 0.0, now[3]), expired + 1, version + 1)


def leases(events: DataFrame, lease_seconds: float = 300.0, max_retries: int = 2, late: str = "1 second") -> DataFrame:
    """Leases of requests online, over events (job_id, url, ts, id, kind); a lease that nobody ends goes back to the queue by itself.

    Kinds and moves are those of frontier.move. Of several rows of a request the one with the highest `version` holds.
    """
    told = events.withWatermark("ts", late).select("job_id", "url", "ts", _at().alias("at"), "id", "kind")
    return told.groupBy("job_id", "url").transformWithState(Leases(lease_seconds, max_retries), Leases.OUT, "Update", "EventTime")


class FirstWithin(_Timed):
    """The rows that a seen key has none for, and its rows again once it was let through longer ago than its lifetime."""

    def __init__(self, ttl: float, columns: list[str]) -> None:
        self.ttl, self.columns = ttl, columns

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("seen", "at double")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.state.get()
        before = seen = held[0] if held else None
        for r in sorted(rows, key=lambda r: (r._at, r._id)):
            if seen is None or r._at - seen > self.ttl:
                seen = r._at
                yield Row(**{c: r[c] for c in self.columns})
        if seen != before:
            self.state.update((seen,))
            self.wake(None if before is None else _millis(before + self.ttl), _millis(seen + self.ttl))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.state.clear()
        yield from ()


def first_within(events: DataFrame, keys: list[str], ttl: float, id_column: str, late: str = "1 second") -> DataFrame:
    """events (ts, ...) whose keys were not let through within the last `ttl` seconds; equal times in order of `id_column`.

    A key is let through again when its last passage is over `ttl` ago (it counts from the passage, not from the last event), and
    forgotten when the watermark is past that.
    """
    columns = events.columns
    told = events.withWatermark("ts", late).select("*", _at().alias("_at"), F.col(id_column).alias("_id"))
    schema = events.schema
    return told.groupBy(*keys).transformWithState(FirstWithin(ttl, columns), schema, "Append", "EventTime")


class Cache(_Timed):
    """What a key's entries (a map from name to value and time) answer to its requests."""

    OUT = "id long, value string"

    def __init__(self, ttl: float) -> None:
        self.ttl = ttl

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "name string", "value string, at double")

    def _next(self, past: float) -> None:
        """Entries that ended before `past` go; the timer is for the next one to end."""
        ends = []
        for (name,), (_, at) in list(self.entries.iterator()):
            if at + self.ttl < past:
                self.entries.removeKey((name,))
            else:
                ends.append(at + self.ttl)
        self.wake(next(iter(list(self.handle.listTimers())), None), _millis(min(ends, default=None)))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: (r.at, r.id)):
            held = self.entries.getValue((r.name,)) if self.entries.containsKey((r.name,)) else None
            if r.value is not None:
                self.entries.updateValue((r.name,), (r.value, r.at))
            else:
                yield Row(id=r.id, value=held[0] if held is not None and r.at - held[1] <= self.ttl else None)
        self._next(timerValues.getCurrentWatermarkInMs() / 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self._next(expiredTimerInfo.getExpiryTimeInMs() / 1000)
        yield from ()


def cached(events: DataFrame, ttl: float, late: str = "1 second") -> DataFrame:
    """(id, value) for each request among events (key, name, ts, id, value): a value stores, a null asks for what was stored last.

    `value` is null where nothing was stored under (key, name) within the last `ttl` seconds. `key` deals the work, as a host
    does for its paths.
    """
    told = events.withWatermark("ts", late).select("key", "name", "ts", _at().alias("at"), "id", "value")
    return told.groupBy("key").transformWithState(Cache(ttl), Cache.OUT, "Append", "EventTime")


class LiveCache(StatefulProcessor):
    """As Cache, by the clock of the machine: entries carry the store's own lifetime, and no timers are needed."""

    def __init__(self, ttl: float) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "name string", "value string", int(self.ttl * 1000))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: r.id):
            if r.value is not None:
                self.entries.updateValue((r.name,), (r.value,))
            else:
                yield Row(id=r.id, value=self.entries.getValue((r.name,))[0] if self.entries.containsKey((r.name,)) else None)

    def close(self) -> None:
        pass


def cached_live(events: DataFrame, ttl: float) -> DataFrame:
    """(id, value) as of `cached` for events (key, name, id, value), with lifetimes in processing time."""
    return events.select("key", "name", "id", "value").groupBy("key").transformWithState(LiveCache(ttl), Cache.OUT, "Append", "ProcessingTime")
