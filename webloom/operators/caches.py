"""Caches with lifetimes, changed content, keyed reads and rate limits, as joins and windows over their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls

#: Lifetimes in seconds.
ROBOTS_TTL, DNS_TTL, KEYS_TTL, PROMOTION_TTL = 12 * 3600, 60, 3600, 24 * 3600


def lookup(requests: DataFrame, stored: DataFrame, ttl: float, keep: Column | None = None) -> DataFrame:
    """requests (key, at, ...) with `value` of the newest entry (key, at, value) not after the request and not older than ttl.

    `keep` says which entries are stored at all; `at` is in seconds. Both tables are sorted together, so a key with very many
    entries makes no pairs.
    """
    rows = stored.filter(keep) if keep is not None else stored
    entries = rows.select("key", "at", F.lit(0).alias("_asks"), F.struct("at", "value").alias("_entry"))
    named = [c for c in requests.columns if c not in ("key", "at")]
    asks = requests.select("key", "at", F.lit(1).alias("_asks"), F.struct(*named).alias("_row") if named else F.struct(F.lit(0)).alias("_row"))
    both = entries.unionByName(asks, allowMissingColumns=True)
    w = Window.partitionBy("key").orderBy("at", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("_last", F.last("_entry", ignorenulls=True).over(w)).filter("_asks = 1")
    value = F.when(F.col("at") - F.col("_last.at") <= ttl, F.col("_last.value"))
    return got.select("key", "at", *(F.col(f"_row.{c}").alias(c) for c in named), value.alias("value"))


def blocked_hosts(requests: DataFrame, resolved: DataFrame) -> DataFrame:
    """requests (key: host, at) with `value` true where a block was found within the last minute; other results are not kept."""
    return lookup(requests, resolved, DNS_TTL, F.col("value"))


def site_rules(requests: DataFrame, promoted: DataFrame, rules: DataFrame, now: Column) -> DataFrame:
    """requests (domain) with gear_hint: of a promotion (domain, gear_hint, at) within its day, else of the longest suffix in rules (suffix, gear_hint)."""
    from .state import longest_suffix

    fresh = promoted.filter(now - F.col("at") < PROMOTION_TTL).groupBy("domain").agg(F.max_by("gear_hint", "at").alias("_promoted"))
    known = longest_suffix(requests, rules.select("suffix", F.col("gear_hint").alias("rule")))
    return known.join(fresh, "domain", "left").withColumn("gear_hint", F.coalesce("_promoted", "rule")).drop("_promoted", "rule")


def changed(pages: DataFrame, seen: DataFrame) -> DataFrame:
    """pages (url, content_hash) with `changed`: not stored before (url_id, content_hash), stored without a hash, or with another one."""
    old = seen.select("url_id", F.nullif("content_hash", F.lit("")).alias("_old"))
    j = pages.withColumn("url_id", urls.url_id(F.col("url"))).join(old, "url_id", "left")
    return j.withColumn("changed", F.col("_old").isNull() | ~F.col("_old").eqNullSafe(F.col("content_hash"))).drop("_old", "url_id")


def recent_scrapes(seen: DataFrame, limit: int = 50) -> DataFrame:
    """The newest pages with a document (the feature)."""
    return seen.filter("raw_id <> ''").orderBy(F.desc("crawled_at"), "url").limit(limit).select("url", "raw_id", "crawled_at")


def keyed(wanted: DataFrame, table: DataFrame, key: str, error: str) -> DataFrame:
    """wanted (key) with the row of a table that has this key, or `error` where none has."""
    j = wanted.join(table.withColumn("_found", F.lit(True)), key, "left")
    return j.withColumn("error", F.when(F.col("_found").isNull(), error)).drop("_found")


def engine_counts(**tables: DataFrame) -> DataFrame:
    """(name, n): rows of each table."""
    counts = [table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, table in tables.items()]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out


def jitter_bound(base: float, factor: Column, attempt: Column) -> Column:
    """Most seconds between two requests of a domain; a live request waits rand() of it."""
    return F.lit(base) * factor * F.pow(F.lit(2.0), attempt)


def request_times(requests: DataFrame, base: float = 1.0, draw: Column | None = None) -> DataFrame:
    """requests (domain, id, at, retry_after, factor, attempt) with `start`: when each may go out, in seconds.

    A row with retry_after > 0 is no request: it holds all later ones back until then. Any other starts `draw` (1: the bound) of
    the jitter bound after the one before it started, or at once. start[k] = max(at[k], start[k-1] + interval[k]) unrolls to
    running sums and maxima, so it takes windows only and no loop.
    """
    told = F.coalesce(F.col("retry_after"), F.lit(0.0)) > 0
    order = Window.partitionBy("domain").orderBy("at", "id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = requests.withColumn("_until", F.last(F.when(told, F.col("at") + F.col("retry_after")), ignorenulls=True).over(before)).filter(~told)
    held = F.coalesce(F.col("_until") > F.col("at"), F.lit(False))
    step = jitter_bound(base, F.col("factor"), F.col("attempt")) * (F.lit(1.0) if draw is None else draw)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_held", held).withColumn("_part", F.sum(held.cast("int")).over(upto))
    part = Window.partitionBy("domain", "_part").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum(F.when(F.col("_held"), 0.0).otherwise(step)).over(part))
    free = F.when(F.col("_held"), F.col("_until")).otherwise(F.col("at")) - F.col("_sum")
    return rows.withColumn("start", F.col("_sum") + F.max(free).over(part)).drop("_until", "_held", "_part", "_sum")
