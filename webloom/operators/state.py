"""Per-domain state as ordered folds, seen-URL cache, retention, account and session choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the state machines.
OPEN_AFTER, HALF_OPEN_AFTER = 5, 300
AIMD_UP, AIMD_DOWN, AIMD_MOST = 2.0, 0.9, 32.0


def ordered(outcomes: DataFrame, key: str) -> DataFrame:
    """(key, events): array of (ts, id, ok, retire) in order; one key's outcomes are one row."""
    retire = F.coalesce("retire", F.lit(False)) if "retire" in outcomes.columns else F.lit(False)
    return outcomes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ts", "id", "ok", retire.alias("retire")))).alias("events"))


def aimd(events: Column, start: Column | None = None) -> Column:
    """Rate factor: doubled by a failure up to 32, times 0.9 by a success down to 1."""
    return F.aggregate(events, F.lit(1.0) if start is None else start, lambda f, e: F.when(e["ok"], F.greatest(F.lit(1.0), f * AIMD_DOWN)).otherwise(F.least(F.lit(AIMD_MOST), f * AIMD_UP)))


def circuit(events: Column, start: Column | None = None) -> Column:
    """(state, failures, opened_at): opens after 5 failures in a row; a check after 300 s half-opens it."""
    first = F.struct(F.lit("closed").alias("state"), F.lit(0).alias("failures"), F.lit(None).cast("long").alias("opened_at"))

    def step(a: Column, e: Column) -> Column:
        at = e["ts"].cast("long")
        state = F.when((a["state"] == "open") & (at - a["opened_at"] > HALF_OPEN_AFTER), "half_open").otherwise(a["state"])
        failures = F.when(state == "half_open", 1).otherwise(a["failures"] + 1)
        opens = (state == "half_open") | (failures >= OPEN_AFTER)
        fine = F.struct(F.lit("closed").alias("state"), F.lit(0).alias("failures"), F.lit(None).cast("long").alias("opened_at"))
        bad = F.struct(F.when(opens, "open").otherwise(state).alias("state"), failures.alias("failures"), F.when(opens, at).otherwise(a["opened_at"]).alias("opened_at"))
        return F.when(e["ok"], fine).otherwise(bad)

    return F.aggregate(events, first if start is None else start, step)


def session_health(events: Column, start: Column | None = None) -> Column:
    """(error_score, retired): a failure adds one, a success takes one away, not below zero; an event with `retire` adds three and retires."""
    first = F.struct(F.lit(0).alias("error_score"), F.lit(False).alias("retired"))

    def step(a: Column, e: Column) -> Column:
        worse = a["error_score"] + F.when(e["retire"], 3).otherwise(1)
        score = F.when(e["ok"], F.greatest(F.lit(0), a["error_score"] - 1)).otherwise(worse)
        return F.struct(score.alias("error_score"), (a["retired"] | (~e["ok"] & e["retire"])).alias("retired"))

    return F.aggregate(events, first if start is None else start, step)


def confidence(successes: Column, failures: Column) -> Column:
    return (successes + 1) / (successes + failures + 2)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Upsert by newest row: one row per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def cache_lookup(requests: DataFrame, seen: DataFrame, ttl: Column) -> DataFrame:
    """requests (url_id, at) with `hit`: seen, not older than ttl, with a stored document."""
    s = seen.select("url_id", F.col("crawled_at").alias("_seen"), F.col("raw_id"))
    return requests.join(s, "url_id", "left").withColumn("hit", F.coalesce((F.col("at").cast("double") - F.col("_seen").cast("double") <= ttl) & (F.col("raw_id") != ""), F.lit(False))).drop("_seen")


def retention(items: DataFrame, limit: int, size: str, order: list[str], group: str | None = None) -> DataFrame:
    """items with `drop`: from the oldest on, while what is left is over the limit."""
    parts = [F.col(group)] if group else [F.lit(0)]
    before = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy(*parts)
    return items.withColumn("drop", F.sum(size).over(total) - F.coalesce(F.sum(size).over(before), F.lit(0)) > limit)


def longest_suffix(rows: DataFrame, rules: DataFrame, domain: str = "domain") -> DataFrame:
    """rows with the rule of the longest suffix of their domain; rules is (suffix, rule) of a checked, small size."""
    parts = F.split(domain, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    pairs = rows.select(domain).distinct().select(domain, F.explode(suffixes).alias("suffix")).join(rules, "suffix")
    best = pairs.groupBy(domain).agg(F.max_by("rule", F.length("suffix")).alias("rule"))
    return rows.join(best, domain, "left")


def account_usable(status: Column, expires_at: Column, now: Column) -> Column:
    return (status == "active") & (expires_at.isNull() | (F.try_to_timestamp(expires_at) > now))


def pick_account(profiles: DataFrame, now: Column) -> DataFrame:
    """One usable profile per domain: the default one, else by account id."""
    usable = profiles.filter(account_usable(F.col("status"), F.col("expires_at"), now))
    w = Window.partitionBy("domain").orderBy(F.desc("is_default"), "account_id")
    return usable.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def merge_cookies(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Key (name, domain, path): the new jar wins, expired ones go; no or bad expiry is fresh."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy("name", "domain", "path").orderBy(F.desc("_new"))
    expiry = F.col("expires").try_cast("double")
    fresh = F.col("expires").isNull() | (F.col("expires") == "") | expiry.isNull() | (expiry == -1) | (expiry > now)
    return both.withColumn("_n", F.row_number().over(w)).filter((F.col("_n") == 1) & fresh).drop("_n", "_new")


def sticky_index(identity: Column, n: int) -> Column:
    """The same choice of n for the same identity."""
    return F.pmod(F.conv(F.substring(F.sha1(identity), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


def sampled(identity: Column, rate: float) -> Column:
    return F.conv(F.substring(F.sha1(identity), 1, 8), 16, 10).cast("double") / 4294967295.0 < rate
