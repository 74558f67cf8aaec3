"""Crawl jobs as a table, and the crawl loop over captured pages.

jobs: (job_id, start_url, status, total, completed, created_at, updated_at).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from . import crawl

RUNNING = ("running", "crawling")
ERRORS_SHOWN = 20


def create(requests: DataFrame, now: Column, job_id: Column) -> DataFrame:
    """A running job of each request (start_url, total)."""
    return requests.select(
        job_id.alias("job_id"), "start_url", F.lit("running").alias("status"), F.coalesce("total", F.lit(0)).cast("int").alias("total"),
        F.lit(0).cast("long").alias("completed"), now.alias("created_at"), now.alias("updated_at"),
    )


def _touched(jobs: DataFrame, changes: DataFrame, now: Column, only_running: bool = False) -> DataFrame:
    """jobs with what `changes` (job_id and further columns of jobs, null: unchanged) sets."""
    names = [c for c in changes.columns if c != "job_id"]
    j = jobs.join(changes.select("job_id", F.lit(True).alias("_in"), *(F.col(c).alias(f"_{c}") for c in names)), "job_id", "left")
    given = F.coalesce(F.col("_in"), F.lit(False)) & (F.col("status").isin(*RUNNING) if only_running else F.lit(True))
    new = {c: F.when(given, F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in names}
    new["updated_at"] = F.when(given, now).otherwise(F.col("updated_at"))
    return j.select(*(new.get(c, F.col(c)).alias(c) for c in jobs.columns))


def update_progress(jobs: DataFrame, progress: DataFrame, now: Column) -> DataFrame:
    """progress: (job_id, completed)."""
    return _touched(jobs, progress.select("job_id", F.col("completed").cast("long").alias("completed")), now)


def complete(jobs: DataFrame, ended: DataFrame, now: Column) -> DataFrame:
    """ended: (job_id, status); no status means completed."""
    return _touched(jobs, ended.select("job_id", F.coalesce("status", F.lit("completed")).alias("status")), now)


def cancel(jobs: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """Only jobs that still run are cancelled; wanted: (job_id)."""
    return _touched(jobs, wanted.select("job_id", F.lit("cancelled").alias("status")), now, only_running=True)


def fail_running(jobs: DataFrame, now: Column) -> DataFrame:
    """At a restart: jobs that were running have failed."""
    left = F.col("status").isin(*RUNNING)
    return jobs.withColumn("updated_at", F.when(left, now).otherwise(F.col("updated_at"))).withColumn("status", F.when(left, "failed").otherwise(F.col("status")))


def recent(jobs: DataFrame, limit: int = 20) -> DataFrame:
    """The newest jobs (the feature)."""
    return jobs.orderBy(F.desc("updated_at"), "job_id").limit(limit).select("job_id", "start_url", "status", "completed", "total", "updated_at")


def report(jobs: DataFrame, frontier: DataFrame, documents: DataFrame) -> DataFrame:
    """(job_id, report): a header, a section per fetched page in order of time, and the first errors.

    frontier rows join documents (raw_id, body) by their raw_id, or by the id of their URL without one; pages without a document
    are left out. The report of a job is one text, as the feature demands.
    """
    f = frontier.filter("status IN ('fetched', 'error')").withColumn("raw_id", F.coalesce(F.nullif("raw_id", F.lit("")), urls.url_id(F.col("url"))))
    pages = f.filter("status = 'fetched'").join(documents, "raw_id").select("job_id", F.struct("updated_at", "url", "body").alias("p")).groupBy("job_id").agg(F.array_sort(F.collect_list("p")).alias("pages"))
    w = Window.partitionBy("job_id").orderBy("updated_at", "url")
    failed = f.filter("status = 'error'").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= ERRORS_SHOWN)
    failed = failed.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("_n", "url", "last_error"))).alias("errors"))
    any_end = f.select("job_id").distinct().withColumn("_any", F.lit(True))
    j = jobs.join(pages, "job_id", "left").join(failed, "job_id", "left").join(any_end, "job_id", "left")
    text = lambda c: F.col(c).cast("string")
    title = F.concat(F.lit("# Crawl job "), text("job_id"), F.lit("\n\n"))
    head = F.concat(title, F.lit("Start: "), "start_url", F.lit("\nStatus: "), "status", F.lit("\nPages: "), text("completed"), F.lit("/"), text("total"), F.lit("\n"))
    sections = F.transform("pages", lambda p: F.concat(F.lit("\n---\n\n## Source: "), p["url"], F.lit("\n\n"), p["body"]))
    lines = F.transform("errors", lambda e: F.concat(F.lit("- "), e["url"], F.lit(": "), F.coalesce(F.nullif(e["last_error"], F.lit("")), F.lit("error"))))
    none = F.array().cast("array<string>")
    errors = F.when(F.col("errors").isNotNull(), F.concat(F.array(F.lit("\n---\n\n## Errors\n")), lines)).otherwise(none)
    whole = F.array_join(F.concat(F.array(head), F.coalesce(sections, none), errors), "\n")
    return j.select("job_id", F.when(F.col("_any"), whole).otherwise(F.concat(title, F.lit("No pages crawled."))).alias("report"))


@dataclass(frozen=True)
class Budget:
    max_pages: int
    max_errors: int = 0
    max_links_per_page: int = 200
    max_retries: int = 2
    lease_seconds: float = 300.0


def run(start_url: str, seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], policy: crawl.CrawlPolicy, budget: Budget, cut: Callable[[DataFrame], DataFrame], now: float = 0.0) -> tuple[DataFrame, str]:
    """The crawl loop: (frontier, why it ended), in rounds instead of page by page.

    A round releases expired leases, stops at the budget, leases what is due (by priority, depth and age, as many pages as the
    budget still allows), and takes in what `fetch` says of the leased rows (url): (url, ok, error, retryable, links array).
    Fetched pages give their links in scope to the frontier, failures are tried again with a delay. When all that is left waits
    for its delay, the clock moves on to it. Only counts reach the driver; the frontier is cut once a round.
    """
    spark, start = seeds.sparkSession, urls.canonical_url(F.lit(start_url))
    first = spark.range(1).select(start.alias("url"), F.lit(100).alias("priority"), F.lit(None).cast("string").alias("parent_url"))
    more = seeds.select("url", F.lit(50).alias("priority"), start.alias("parent_url")).filter(F.col("url") != start)
    rows = first.unionByName(more).groupBy("url").agg(F.max("priority").alias("priority"), F.min("parent_url").alias("parent_url"))
    frontier = cut(rows.select(
        "url", "parent_url", "priority", F.lit(0).alias("depth"), F.lit("queued").alias("status"), F.lit(0).alias("retry_count"), F.lit(now).alias("next_fetch_at"),
        F.lit(None).cast("double").alias("lease_expires_at"), F.lit(now).alias("discovered_at"), F.lit(now).alias("updated_at"), F.lit(None).cast("string").alias("last_error"), F.lit("").alias("raw_id"),
    ))
    while True:
        frontier = crawl.release_expired(frontier, F.lit(now))
        told = frontier.agg(
            F.count_if(F.col("status").isin(*crawl.TERMINAL)).alias("terminal"), F.count_if(F.col("status") == "error").alias("error"),
            F.count_if((F.col("status") == "queued") & (F.col("next_fetch_at") <= now)).alias("due"),
            F.min(F.when(F.col("status") == "queued", F.col("next_fetch_at"))).alias("next"),
        ).first()
        if told["terminal"] >= budget.max_pages:
            return frontier, "page-limit"
        if budget.max_errors and told["error"] >= budget.max_errors:
            return frontier, "error-limit"
        if not told["due"]:
            if told["next"] is None:
                return frontier, "completed"
            now = told["next"]
            continue
        due = frontier.filter((F.col("status") == "queued") & (F.col("next_fetch_at") <= now))
        leased = due.orderBy(F.desc("priority"), "depth", "discovered_at", "url").limit(budget.max_pages - told["terminal"]) if told["due"] > budget.max_pages - told["terminal"] else due
        got = cut(leased.select("url", "depth", "retry_count").join(fetch(leased.select("url")), "url", "left").withColumn("ok", F.coalesce("ok", F.lit(False))))
        again = ~F.col("ok") & F.coalesce("retryable", F.lit(False)) & (F.col("retry_count") < budget.max_retries)
        said = got.select("url", "ok", again.alias("again"), F.col("error").alias("_error"))
        j = frontier.join(said, "url", "left")
        mine = F.col("ok").isNotNull()
        status = F.when(~mine, F.col("status")).when(F.col("ok"), "fetched").when(F.col("again"), "queued").otherwise("error")
        done = j.select(
            "url", "parent_url", "priority", "depth", status.alias("status"), (F.col("retry_count") + F.coalesce("again", F.lit(False)).cast("int")).alias("retry_count"),
            F.when(F.col("again"), F.lit(now) + crawl.retry_delay(F.col("retry_count"))).otherwise(F.col("next_fetch_at")).alias("next_fetch_at"), "lease_expires_at", "discovered_at",
            F.when(mine, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"), F.when(mine & ~F.col("ok"), F.coalesce("_error", F.lit("error"))).otherwise(F.col("last_error")).alias("last_error"),
            F.when(F.col("ok"), urls.url_id(F.col("url"))).otherwise(F.col("raw_id")).alias("raw_id"),
        )
        grown = got.filter("ok").filter(policy.should_expand(F.col("depth"))).select("url", "depth", F.explode(F.slice("links", 1, budget.max_links_per_page)).alias("link"))
        found = grown.select(policy.normalize(F.col("link")).alias("link"), (F.col("depth") + 1).alias("depth"), "url").filter("link <> ''")
        fresh = found.groupBy("link").agg(F.min(F.struct("depth", "url")).alias("by")).join(done.select(F.col("url").alias("link")), "link", "left_anti")
        fresh = fresh.select(
            F.col("link").alias("url"), F.col("by.url").alias("parent_url"), F.lit(0).alias("priority"), F.col("by.depth").alias("depth"), F.lit("queued").alias("status"), F.lit(0).alias("retry_count"),
            F.lit(now).alias("next_fetch_at"), F.lit(None).cast("double").alias("lease_expires_at"), F.lit(now).alias("discovered_at"), F.lit(now).alias("updated_at"), F.lit(None).cast("string").alias("last_error"), F.lit("").alias("raw_id"),
        )
        frontier = cut(done.unionByName(fresh))
