"""What is learned of each domain: counts, confidence, circuit and reach, kept as a table and moved on by batches of outcomes.

rules: (domain, gear, needs_account, success_count, fail_count, last_success_at, last_failed_at, last_error, stale,
unreachable_until, circuit_state, circuit_opened_at, consecutive_failures); times in seconds.

The table carries all state, so a history can be taken in slice by slice: two slices give what both at once would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import folds
from .state import HALF_OPEN_AFTER, confidence

#: Below this confidence a rule is stale; seconds that a domain counts as out of reach.
CONFIDENT, UNREACHABLE_TTL = 0.5, 24 * 3600
STATE = {
    "gear": "string", "needs_account": "boolean", "success_count": "long", "fail_count": "long", "last_success_at": "double", "last_failed_at": "double", "last_error": "string",
    "stale": "boolean", "unreachable_until": "double", "circuit_state": "string", "circuit_opened_at": "double", "consecutive_failures": "long",
}
FRESH = {"gear": "", "needs_account": False, "success_count": 0, "fail_count": 0, "last_success_at": None, "last_failed_at": None, "last_error": "", "stale": False, "unreachable_until": 0.0, "circuit_state": "closed", "circuit_opened_at": 0.0, "consecutive_failures": 0}


def circuit_at(state: Column, opened_at: Column, now: Column) -> Column:
    """An open circuit lets one try through once its time is over."""
    return F.when((state == "open") & (opened_at > 0) & (now - opened_at > HALF_OPEN_AFTER), "half_open").otherwise(state)


def record(rules: DataFrame, outcomes: DataFrame, seconds: int = 86_400) -> DataFrame:
    """rules after a slice of outcomes (domain, at, id, ok, gear, error, out_of_reach, needs_account), in order of time, then id.

    What a domain's last success and last failure say, and counts, are aggregates; `stale` and `unreachable_until` follow from the
    failures behind the last success; the circuit is folded from summaries of so many seconds. No row holds a domain's outcomes.
    """
    ok, order = F.col("ok"), F.struct("at", "id")
    when = lambda test, value: F.max_by(value, F.when(test, order))
    needs = F.coalesce("needs_account", F.lit(None).cast("boolean"))
    away = ~ok & F.coalesce("out_of_reach", F.lit(False))
    told = outcomes.groupBy("domain").agg(
        F.count_if(ok).alias("_good"), F.count_if(~ok).alias("_bad"), F.max(F.when(ok, order)).alias("_last_good"), F.max(F.when(~ok, order)).alias("_last_bad"), F.max(F.when(away, order)).alias("_last_away"),
        when(ok, F.coalesce("gear", F.lit(""))).alias("_gear"), when(~ok, F.coalesce("error", F.lit(""))).alias("_error"), when(ok & needs.isNotNull(), needs).alias("_needs"),
    )
    summaries = folds.partial(outcomes.select("domain", F.timestamp_micros(F.round(F.col("at") * 1_000_000).cast("long")).alias("ts"), "id", "ok"), "domain", folds.FineCircuit, seconds)
    # where the circuit stood before is one more summary's worth of state: it goes first
    before = rules.select("domain", F.struct("circuit_state", "consecutive_failures", (F.col("circuit_opened_at") * 1_000_000).cast("long").alias("opened")).alias("_before"))
    circuits = folds.scan_from(summaries, "domain", folds.FineCircuit, before)
    old = rules.select("domain", F.struct(*(F.col(k).cast(t).alias(k) for k, t in STATE.items())).alias("_old"))
    fresh = F.struct(*(F.lit(FRESH[k]).cast(t).alias(k) for k, t in STATE.items()))
    j = told.join(circuits, "domain").join(old, "domain", "full").withColumn("a", F.coalesce("_old", fresh))
    a, some, won = F.col("a"), F.col("_good") > 0, F.col("_last_good").isNotNull() & (F.col("_last_bad").isNull() | (F.col("_last_good") > F.col("_last_bad")))
    good, bad = a["success_count"] + F.col("_good"), a["fail_count"] + F.col("_bad")
    after = F.col("_last_away").isNotNull() & (F.col("_last_good").isNull() | (F.col("_last_away") > F.col("_last_good")))
    new = {
        "gear": F.when(some, F.col("_gear")).otherwise(a["gear"]), "needs_account": F.coalesce("_needs", a["needs_account"]), "success_count": good, "fail_count": bad,
        "last_success_at": F.coalesce("_last_good.at", a["last_success_at"]), "last_failed_at": F.coalesce("_last_bad.at", a["last_failed_at"]), "last_error": F.when(F.col("_bad") > 0, F.col("_error")).otherwise(a["last_error"]),
        "stale": ~won & (confidence(good, bad) < CONFIDENT), "unreachable_until": F.when(after, F.col("_last_away.at") + UNREACHABLE_TTL).when(some, 0.0).otherwise(a["unreachable_until"]),
        "circuit_state": F.col("state"), "circuit_opened_at": F.coalesce(F.col("opened_at") / 1_000_000, F.lit(0.0)), "consecutive_failures": F.col("failures"),
    }
    changed = F.col("_good").isNotNull()
    return j.select("domain", *(F.when(changed, v).otherwise(a[k]).cast(STATE[k]).alias(k) for k, v in new.items()))


def mark_needs_account(rules: DataFrame, domains: DataFrame) -> DataFrame:
    """domains (domain) need an account from now on; unknown ones get a fresh rule."""
    j = rules.join(domains.select("domain", F.lit(True).alias("_marked")).distinct(), "domain", "full")
    new = {k: F.coalesce(F.col(k), F.lit(v).cast(STATE[k])) if v is not None else F.col(k) for k, v in FRESH.items()}
    new["needs_account"] = F.coalesce("_marked", new["needs_account"])
    return j.select("domain", *(new[k].alias(k) for k in STATE))


def with_confidence(rules: DataFrame) -> DataFrame:
    return rules.withColumn("confidence", confidence(F.col("success_count"), F.col("fail_count")))
