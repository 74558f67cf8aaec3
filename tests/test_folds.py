"""Summaries of stretches against event after event, whole and cut at any place; one key with all events; domain rules in slices."""

import random

import pytest
from pyspark.sql import functions as F

from webloom.operators import domain_rules, folds, state

T0 = 1_700_000_000


def stepped(machine, events, now):
    """One event after another, as the rules say it."""
    for micros, ok, retire in events:
        if machine is folds.Rate:
            now = (max(1.0, now[0] * 0.9) if ok else min(32.0, now[0] * 2.0),)
        elif machine is folds.Score:
            now = (max(0, now[0] - 1) if ok else now[0] + (3 if retire else 1), now[1] or not ok and retire)
        else:
            name, failures, opened = now
            at = micros // machine.UNIT
            half = name == "open" and at - opened > machine.WAIT
            if ok:
                now = ("closed", 0, None)
            else:
                failures = 1 if half else failures + 1
                opens = half or failures >= 5
                now = ("open" if opens else name, failures, at if opens else opened)
    return now


def story(r, n):
    at, out = T0 * 1_000_000, []
    share = r.choice([0.0, 0.1, 0.5, 0.87, 1.0])
    for _ in range(n):
        at += int(r.choice([5, 100, 299, 301, 2000]) * 1_000_000 * r.choice([1, 1.1]))
        out.append((at, r.random() < share, r.random() < 0.1))
    return out


def summary(machine, events):
    return machine.summary(iter(events[::-1] if machine.BACKWARDS else events))


@pytest.mark.parametrize("machine", [folds.Rate, folds.Score, folds.Circuit, folds.FineCircuit])
def test_summaries_give_what_events_give(machine):
    r = random.Random(machine.__name__)
    for _ in range(1500):
        before, first, then, last = (story(r, r.randrange(12)) for _ in range(4))
        for k, part in enumerate((first, then, last), 1):
            part[:] = [(a + k * 10_000_000_000, o, x) for a, o, x in part]
        begun = stepped(machine, before, machine.start())
        assert machine.apply(begun, summary(machine, first)) == stepped(machine, first, begun)
        two = machine.compose(summary(machine, first), summary(machine, then))
        assert machine.apply(begun, two) == stepped(machine, first + then, begun)
        left = machine.compose(two, summary(machine, last))
        right = machine.compose(summary(machine, first), machine.compose(summary(machine, then), summary(machine, last)))
        want = stepped(machine, first + then + last, begun)
        assert machine.apply(begun, left) == machine.apply(begun, right) == want


@pytest.mark.parametrize("machine", [folds.Rate, folds.Circuit])
def test_close_stretches_compose(machine):
    r = random.Random(2)
    for _ in range(1500):
        whole = story(r, r.randrange(1, 25))
        cut = r.randrange(len(whole) + 1)
        two = machine.compose(summary(machine, whole[:cut]), summary(machine, whole[cut:]))
        for begun in (machine.start(), stepped(machine, [(a - 10**10, o, x) for a, o, x in story(r, 9)], machine.start())):
            assert machine.apply(begun, two) == stepped(machine, whole, begun)


def test_one_key_has_all_events(spark):
    n = 60_000
    e = spark.range(n).select(F.lit("one").alias("k"), F.timestamp_seconds(T0 + F.col("id") * 40).alias("ts"), "id", (F.hash("id") % 8 != 0).alias("ok"), (F.hash("id") % 80 == 0).alias("retire"))
    events = [((T0 + r.id * 40) * 1_000_000, r.ok, r.retire) for r in e.orderBy("id").select("id", "ok", "retire").collect()]
    for machine in (folds.Rate, folds.Score, folds.Circuit):
        parts = folds.partial(e, "k", machine)
        assert parts.count() == (T0 + (n - 1) * 40) // 86_400 - T0 // 86_400 + 1
        got = [tuple(r) for r in folds.scan(parts, "k", machine).collect()]
        assert got == [("one", *stepped(machine, events, machine.start()))]
        assert folds.fold(e.limit(0), "k", machine).count() == 0


def test_expression_folds_agree(spark):
    e = spark.range(3000).select((F.col("id") % 7).alias("k"), F.timestamp_seconds(T0 + F.col("id") * 97).alias("ts"), "id", (F.hash("id") % 3 != 0).alias("ok"), (F.hash("id") % 50 == 0).alias("retire"))
    rows = state.ordered(e, "k").select("k", state.aimd(F.col("events")).alias("f"), state.circuit(F.col("events")).alias("c"), state.session_health(F.col("events")).alias("h")).collect()
    assert {(r.k, r.f) for r in rows} == {tuple(r) for r in folds.fold(e, "k", folds.Rate, 3600).collect()}
    assert {(r.k, *r.c) for r in rows} == {tuple(r) for r in folds.fold(e, "k", folds.Circuit, 3600).collect()}
    assert {(r.k, *r.h) for r in rows} == {tuple(r) for r in folds.fold(e, "k", folds.Score, 3600).collect()}


def test_domain_rules_in_slices_and_at_once(spark):
    r = random.Random(8)
    rows, at = [], float(T0)
    for i in range(400):
        at += r.choice([1.5, 60.25, 400.0])
        ok = r.random() < 0.4
        rows.append((r.choice("abc"), at, i, ok, r.choice([None, "g1", "g2"]), r.choice([None, "e1", "e2"]), r.random() < 0.3, r.choice([None, None, True, False])))
    table = spark.createDataFrame(rows, "domain string, at double, id long, ok boolean, gear string, error string, out_of_reach boolean, needs_account boolean")
    empty = spark.createDataFrame([], "domain string, " + ", ".join(f"{k} {kind}" for k, kind in domain_rules.STATE.items()))
    once = {x.domain: x for x in domain_rules.record(empty, table).collect()}
    two = {x.domain: x for x in domain_rules.record(domain_rules.record(empty, table.filter("id < 150")), table.filter("id >= 150")).collect()}
    for d in "abc":
        s = dict(domain_rules.FRESH)
        circuit = ("closed", 0, None)
        for _, at, _, ok, gear, error, away, needs in (x for x in rows if x[0] == d):
            circuit = stepped(folds.FineCircuit, [(round(at * 1_000_000), ok, False)], circuit)
            if ok:
                s |= {"gear": gear or "", "success_count": s["success_count"] + 1, "last_success_at": at, "stale": False, "unreachable_until": 0.0}
                s["needs_account"] = s["needs_account"] if needs is None else needs
            else:
                s |= {"fail_count": s["fail_count"] + 1, "last_failed_at": at, "last_error": error or ""}
                s["stale"] = (s["success_count"] + 1) / (s["success_count"] + s["fail_count"] + 2) < 0.5
                s["unreachable_until"] = at + 86_400 if away else s["unreachable_until"]
        s |= {"circuit_state": circuit[0], "consecutive_failures": circuit[1], "circuit_opened_at": (circuit[2] or 0) / 1_000_000}
        assert once[d].asDict() == two[d].asDict() == {"domain": d, **s}
