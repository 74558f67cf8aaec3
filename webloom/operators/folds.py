"""Ordered state machines per key as summaries that compose, so that no row holds a key's events and no task must see them all.

Outcomes are (key, ts, id, ok, retire). A stretch of time of one key becomes one row: what it does to any state it may start
from. `partial` makes these rows, one for each key and bucket of `seconds`, from rows sorted within partitions that are dealt
by (key, bucket), so a key with a third of all events is spread over its buckets; `scan` takes a key's rows in order of time.
Both read their rows one after another and hold one state, whatever the size of a group.

    rate factor    f -> f doubled `ups` times and cut by a tenth `downs` times, kept between `low` and `high`, the ends of the
                   same events from 1 and from 32. All factors are powers of two times repeated tenths, and doubling is exact,
                   so a summary gives the bits that event after event gives.
    error score    s -> s + total, and up again by what the lowest point `least` would have gone below zero
    circuit        a success clears what came before. Behind it only failures matter: their number, the first few times, and
                   what follows from an open circuit stamped, or half-opened, at each of these.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .state import AIMD_DOWN, AIMD_MOST, AIMD_UP, HALF_OPEN_AFTER, OPEN_AFTER


class Rate:
    """The AIMD factor; state: a float."""

    SUMMARY, STATE, BACKWARDS = "low double, high double, ups long, downs long", "factor double", False

    @staticmethod
    def summary(events: Iterator[tuple]) -> tuple:
        low, high, ups, downs = 1.0, AIMD_MOST, 0, 0
        for _, ok, _ in events:
            if ok:
                low, high, downs = max(1.0, low * AIMD_DOWN), max(1.0, high * AIMD_DOWN), downs + 1
            else:
                low, high, ups = min(AIMD_MOST, low * AIMD_UP), min(AIMD_MOST, high * AIMD_UP), ups + 1
        return low, high, ups, downs

    @staticmethod
    def start() -> tuple:
        return (1.0,)

    @staticmethod
    def apply(state: tuple, summary: tuple) -> tuple:
        low, high, ups, downs = summary
        if low == high:
            return (low,)
        share, power = math.frexp(state[0])
        for _ in range(downs):  # in the range of the first power of two, where nothing gets too small
            share, more = math.frexp(share * AIMD_DOWN)
            power += more
        return (max(low, min(high, math.ldexp(share, power + ups))),)

    @classmethod
    def compose(cls, first: tuple, then: tuple) -> tuple:
        low, high = (cls.apply((first[k],), then)[0] for k in (0, 1))
        return low, high, first[2] + then[2], first[3] + then[3]


class Score:
    """The error score of a session, and whether it is retired."""

    SUMMARY, STATE, BACKWARDS = "total long, least long, retires boolean", "error_score long, retired boolean", False

    @staticmethod
    def summary(events: Iterator[tuple]) -> tuple:
        total, least, retires = 0, 0, False
        for _, ok, retire in events:
            total += -1 if ok else 3 if retire else 1
            least, retires = min(least, total), retires or not ok and retire
        return total, least, retires

    @staticmethod
    def start() -> tuple:
        return 0, False

    @staticmethod
    def apply(state: tuple, summary: tuple) -> tuple:
        return state[0] + summary[0] - min(0, state[0] + summary[1]), state[1] or summary[2]

    @staticmethod
    def compose(first: tuple, then: tuple) -> tuple:
        return first[0] + then[0], min(first[1], first[0] + then[1]), first[2] or then[2]


class Circuit:
    """(state, failures, opened_at) of the circuit breaker; read backwards, a stretch needs no more than its failures behind its last success.

    Of its first OPEN_AFTER failures a summary says when they were, where the stretch ends if the circuit half-opens at one (half_*), and if
    it is stamped there by a count of at least OPEN_AFTER (stamp_*; stamp_more: the count goes on from there).
    """

    SUMMARY = "cleared boolean, n long, times array<long>, half_failures array<long>, half_opened array<long>, stamp_more array<boolean>, stamp_failures array<long>, stamp_opened array<long>"
    STATE, BACKWARDS = "state string, failures long, opened_at long", True
    #: Microseconds of the unit in which times are compared, and the wait in it.
    UNIT, WAIT = 1_000_000, HALF_OPEN_AFTER

    @classmethod
    def summary(cls, events: Iterator[tuple]) -> tuple:
        times, halves, stamps = [], [], []  # of the failures seen so far, which are later than the next one; the earliest first
        n, cleared = 0, False
        for micros, ok, _ in events:
            if ok:
                cleared = True
                break
            at = micros // cls.UNIT
            n += 1
            half = (n, at)  # a count of 1 here, until a later failure is over the wait, or the count is full
            for k in range(min(OPEN_AFTER - 1, len(times))):
                if times[k] - at > cls.WAIT:
                    half = halves[k]
                    break
                if k == OPEN_AFTER - 2:
                    half = cls._stamped(OPEN_AFTER, stamps[k])
            stamp = (True, 0, at) if not times else (False, *halves[0]) if times[0] - at > cls.WAIT else cls._later(1, stamps[0])
            times, halves, stamps = [at, *times][:OPEN_AFTER], [half, *halves][:OPEN_AFTER], [stamp, *stamps][:OPEN_AFTER]
        return cls._row(cleared, n, times, halves, stamps)

    @staticmethod
    def _stamped(count: int, stamp: tuple) -> tuple:
        return count + stamp[1] if stamp[0] else stamp[1], stamp[2]

    @staticmethod
    def _later(count: int, stamp: tuple) -> tuple:
        return stamp[0], count + stamp[1] if stamp[0] else stamp[1], stamp[2]

    @staticmethod
    def _row(cleared: bool, n: int, times: list, halves: list, stamps: list) -> tuple:
        columns = [list(x) for x in zip(*halves, strict=True)] or [[], []]
        return cleared, n, times, *columns, *([list(x) for x in zip(*stamps, strict=True)] or [[], [], []])

    @staticmethod
    def _lists(row: tuple) -> tuple:
        return *row[:3], list(zip(*row[3:5], strict=True)), list(zip(*row[5:], strict=True))

    @staticmethod
    def start() -> tuple:
        return "closed", 0, None

    @classmethod
    def apply(cls, state: tuple, summary: tuple) -> tuple:
        cleared, n, times, halves, stamps = cls._lists(summary)
        name, failures, opened_at = cls.start() if cleared else state
        for k in range(min(n, OPEN_AFTER)):
            if name == "open" and times[k] - opened_at > cls.WAIT:
                return "open", *halves[k]
            failures += 1
            if failures >= OPEN_AFTER:
                return "open", *cls._stamped(failures, stamps[k])
        return name, failures, opened_at

    @classmethod
    def compose(cls, first: tuple, then: tuple) -> tuple:
        if then[0] or not first[1]:
            return (then[0] or first[0], *then[1:])
        if not then[1]:
            return first
        cleared, n, times, halves, stamps = cls._lists(first)
        _, more, more_times, more_halves, more_stamps = cls._lists(then)
        moved = [cls.apply(("open", *x), then)[1:] for x in halves]
        restamped = []
        for goes_on, failures, opened in stamps:
            if not goes_on:
                restamped.append((False, *cls.apply(("open", failures, opened), then)[1:]))
            elif more_times[0] - opened > cls.WAIT:
                restamped.append((False, *more_halves[0]))
            else:
                restamped.append(cls._later(failures + 1, more_stamps[0]))
        some = lambda a, b: [*a, *b][:OPEN_AFTER]
        return cls._row(cleared, n + more, some(times, more_times), some(moved, more_halves), some(restamped, more_stamps))


class FineCircuit(Circuit):
    """Circuit with times in microseconds."""

    UNIT, WAIT = 1, HALF_OPEN_AFTER * 1_000_000


def _names(fields: str) -> list[str]:
    return StructType.fromDDL(fields).names


def partial(outcomes: DataFrame, key: str, machine: type, seconds: int = 86_400) -> DataFrame:
    """(key, bucket, and the columns of machine.SUMMARY) of each stretch of so many seconds of a key's outcomes."""
    retire = F.coalesce("retire", F.lit(False)) if "retire" in outcomes.columns else F.lit(False)
    micros = F.unix_micros("ts")
    rows = outcomes.select(F.col(key).alias("key"), F.floor(micros / (seconds * 1_000_000)).alias("bucket"), micros.alias("micros"), "id", "ok", retire.alias("retire"))
    order = [F.desc(c) if machine.BACKWARDS else F.asc(c) for c in ("micros", "id")]
    dealt = rows.repartition("key", "bucket").sortWithinPartitions("key", "bucket", *order)
    out = StructType.fromDDL(f"bucket long, {machine.SUMMARY}")
    out = StructType([rows.schema["key"], *out.fields])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        columns = ("key", "bucket", "micros", "ok", "retire")
        events = (x for batch in batches for x in zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
        for at, group in groupby(events, itemgetter(0, 1)):
            yield *at, *machine.summary(x[2:] for x in group)

    return dealt.mapInArrow(_rows(groups, out), out)


def scan(partials: DataFrame, key: str, machine: type) -> DataFrame:
    """(key, and the columns of machine.STATE) of each key after all its summaries, taken in order of their buckets."""
    return scan_from(partials, key, machine, None)


def scan_from(partials: DataFrame, key: str, machine: type, before: DataFrame | None) -> DataFrame:
    """scan, beginning with the state of a key in `before` (key, a struct with the columns of machine.STATE in order) where it has one."""
    names, state_names = _names(machine.SUMMARY), _names(machine.STATE)
    if before is not None:
        told = [F.col(f"{before.columns[1]}.{before.schema[1].dataType.names[k]}").cast(f.dataType).alias(f"_{f.name}") for k, f in enumerate(StructType.fromDDL(machine.STATE).fields)]
        begun = before.select(F.col(key).alias("key"), F.lit(None).cast("long").alias("bucket"), *told)
        partials = partials.withColumn("_begins", F.lit(False)).unionByName(begun.withColumn("_begins", F.lit(True)), allowMissingColumns=True)
    else:
        nothing = [F.lit(None).cast(f.dataType).alias(f"_{f.name}") for f in StructType.fromDDL(machine.STATE).fields]
        partials = partials.select("*", *nothing, F.lit(False).alias("_begins"))
    dealt = partials.repartition("key").sortWithinPartitions("key", F.desc("_begins"), "bucket")
    out = StructType([partials.schema["key"], *StructType.fromDDL(machine.STATE).fields])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        columns = ("key", "_begins", *(f"_{c}" for c in state_names), *names)
        rows = (x for batch in batches for x in zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
        for at, group in groupby(rows, itemgetter(0)):
            state, n = machine.start(), 2 + len(state_names)
            for row in group:
                state = row[2:n] if row[1] else machine.apply(state, row[n:])
            yield at, *state

    return dealt.mapInArrow(_rows(groups, out), out).withColumnRenamed("key", key)


def _rows(groups: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], schema: StructType):
    """A function for mapInArrow that returns the tuples of `groups` in batches."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = groups(batches)
        while some := list(islice(rows, 4096)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), arrow, strict=True)], schema=arrow)

    return run


def fold(outcomes: DataFrame, key: str, machine: type, seconds: int = 86_400) -> DataFrame:
    """(key, and the columns of machine.STATE) of each key after all its outcomes, in order of time, then id."""
    return scan(partial(outcomes, key, machine, seconds), key, machine)
