"""Crawl scope, link graph, budgeted breadth-first walk, frontier and jobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html, urls
from ..functions.expressions import glob_pattern, let

TERMINAL = ("fetched", "error", "skipped")


@dataclass(frozen=True)
class CrawlPolicy:
    start_url: str
    same_domain_only: bool = True
    max_depth: int = 2
    include_paths: Sequence[str] = field(default_factory=tuple)
    exclude_paths: Sequence[str] = field(default_factory=tuple)
    include_subdomains: bool = False
    ignore_query_parameters: bool = False

    def domain_allowed(self, url: Column) -> Column:
        if not self.same_domain_only:
            return F.lit(True)
        own, start = urls.domain_of(url), urls.domain_of(urls.canonical_url(F.lit(self.start_url)))
        return (own == start) | own.endswith(F.concat(F.lit("."), start)) if self.include_subdomains else own == start

    def path_allowed(self, url: Column) -> Column:
        path = F.when(urls.part(url, 3) == "", "/").otherwise(urls.part(url, 3))
        ok = F.lit(True)
        if self.include_paths:
            ok = F.lit(False)
            for g in self.include_paths:
                ok = ok | path.rlike(glob_pattern(g))
        for g in self.exclude_paths:
            ok = ok & ~path.rlike(glob_pattern(g))
        return ok

    def normalize(self, url: Column, base: Column | None = None, page: bool = True) -> Column:
        """The canonical URL, or '' outside the scope; path rules hold for pages only."""
        u = urls.canonical_url(urls.join_url(base, url) if base is not None else url)
        u = urls.drop_query(u) if self.ignore_query_parameters else u
        scoped = lambda x: F.when((x != "") & self.domain_allowed(x) & (self.path_allowed(x) if page else F.lit(True)), x).otherwise("")
        return let(u, scoped)

    def should_expand(self, depth: Column) -> Column:
        return F.lit(self.max_depth < 0) | (depth < self.max_depth)


def seeds(candidates: DataFrame, policy: CrawlPolicy, limit: int) -> DataFrame:
    """(url, pos): in scope, not the start URL, first of each, at most `limit` (the feature)."""
    named = candidates.select(policy.normalize(F.col("url")).alias("url"), "pos").filter((F.col("url") != "") & (F.col("url") != urls.canonical_url(F.lit(policy.start_url))))
    return named.groupBy("url").agg(F.min("pos").alias("pos")).orderBy("pos", "url").limit(limit)


def links(pages: DataFrame, start_domain: str = "", same_domain_only: bool = False, max_links: int | None = None) -> DataFrame:
    """(page_id, pos, url, text, title, rel, same_domain): every a[href] of a page, the first of each canonical URL.

    same_domain compares with `start_domain`, or with the page's own domain; at most `max_links` of a page, in its order.
    """
    rows = pages.select("page_id", F.col("url").alias("base"), F.posexplode(html.anchors_of("html")).alias("pos", "a"))
    rows = rows.filter((F.col("a.href") != "") & ~F.lower("a.href").rlike("^(#|mailto:|tel:|javascript:|data:)"))
    url = urls.canonical_url(urls.join_url(F.col("base"), F.col("a.href")))
    rows = rows.select("page_id", "pos", "base", url.alias("url"), F.col("a.label").alias("text"), "a.title", "a.rel").filter(F.col("url").rlike("^https?://[^/]"))
    home = F.lit(start_domain) if start_domain else urls.domain_of(F.col("base"))
    rows = rows.withColumn("same_domain", urls.domain_of(F.col("url")) == home)
    rows = rows.filter("same_domain") if same_domain_only else rows
    first = Window.partitionBy("page_id", "url").orderBy("pos")
    rows = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "base")
    if max_links is None:
        return rows
    order = Window.partitionBy("page_id").orderBy("pos")
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max_links).drop("_n")


def final_url_allowed(final_url: Column, allowed_domain: Column, include_subdomains: bool = False) -> Column:
    """The address after redirects is inside the allowed domain; an empty one allows all."""
    own, wanted = urls.domain_of(F.lower(final_url)), F.lower(F.coalesce(allowed_domain, F.lit("")))
    inside = (own == wanted) | own.endswith(F.concat(F.lit("."), wanted)) if include_subdomains else own == wanted
    return (wanted == "") | F.coalesce(inside, F.lit(False))


def reach(edges: DataFrame, starts: DataFrame, max_depth: int, cut=None) -> DataFrame:
    """(url, depth): least number of links from `starts`, level by level up to max_depth; edges are (src, dst)."""
    seen = starts.select("url", F.lit(0).alias("depth")).distinct()
    level = seen
    for depth in range(1, max_depth + 1):
        fresh = edges.join(level.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct().join(seen, "url", "left_anti")
        level = fresh.select("url", F.lit(depth).alias("depth"))
        level = cut(level) if cut else level
        seen = seen.unionByName(level)
    return seen


def stop_reason(counts: DataFrame, max_pages: int, max_errors: int) -> DataFrame:
    """counts with `stop_reason`: page-limit, error-limit or none."""
    return counts.withColumn("stop_reason", F.when(F.col("terminal") >= max_pages, "page-limit").when((F.lit(max_errors) > 0) & (F.col("error") >= max_errors), "error-limit"))


def frontier_counts(frontier: DataFrame) -> DataFrame:
    """One row per job: a count by status, `terminal`, and `total` without terminal ones counted twice."""
    names = ("queued", "in_progress", "fetched", "error", "skipped")
    counted = frontier.groupBy("job_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in names), F.count(F.lit(1)).alias("total"))
    return counted.withColumn("terminal", sum((F.col(s) for s in TERMINAL), F.lit(0)))


def lease_next(frontier: DataFrame, now: Column) -> DataFrame:
    """The next due row of each job: priority, then depth, then age, then URL."""
    due = frontier.filter((F.col("status") == "queued") & (F.coalesce("next_fetch_at", F.lit(0.0)) <= now))
    order = Window.partitionBy("job_id").orderBy(F.desc("priority"), "depth", "discovered_at", "url")
    return due.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def release_expired(frontier: DataFrame, now: Column) -> DataFrame:
    gone = (F.col("status") == "in_progress") & (F.col("lease_expires_at") < now)
    return frontier.withColumn("status", F.when(gone, "queued").otherwise(F.col("status"))).withColumn("lease_expires_at", F.when(gone, None).otherwise(F.col("lease_expires_at")))


def enqueue(frontier: DataFrame, candidates: DataFrame) -> DataFrame:
    """Insert-or-ignore by (job_id, url)."""
    first = Window.partitionBy("job_id", "url").orderBy(F.desc("priority"), "depth")
    fresh = candidates.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n").join(frontier.select("job_id", "url"), ["job_id", "url"], "left_anti")
    return frontier.unionByName(fresh.select(frontier.columns))


def retry_delay(retries: Column, base: float = 2.0, most: float = 300.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.greatest(retries, F.lit(0))), F.lit(most))


def mark_retry(frontier: DataFrame, failed: DataFrame, now: Column, max_retries: int = 2) -> DataFrame:
    """failed is (job_id, url, retryable): queued again with a delay from the old count, or in error."""
    f = frontier.join(failed, ["job_id", "url"], "left")
    again = F.col("retryable") & (F.col("retry_count") < max_retries)
    return f.select(
        *(c for c in frontier.columns if c not in ("status", "retry_count", "next_fetch_at")),
        F.when(F.col("retryable").isNull(), F.col("status")).when(again, "queued").otherwise("error").alias("status"),
        F.when(again, now + retry_delay(F.col("retry_count"))).otherwise(F.col("next_fetch_at")).alias("next_fetch_at"),
        F.when(again, F.col("retry_count") + 1).otherwise(F.col("retry_count")).alias("retry_count"),
    ).select(frontier.columns)


def result_page(frontier: DataFrame, cursor: int, limit: int) -> DataFrame:
    """A page of fetched URLs in order of time, then URL, each with the next page's cursor, null unless the page is full."""
    cursor, limit = max(0, cursor), max(1, min(limit, 100))
    page = frontier.filter("status = 'fetched'").orderBy("updated_at", "url").offset(cursor).limit(limit)
    full = F.count(F.lit(1)).over(Window.partitionBy()) == limit  # of `limit` rows
    return page.withColumn("next_cursor", F.when(full, cursor + limit))


def done_urls(frontier: DataFrame, limit: int) -> DataFrame:
    """URLs with an end, oldest first, at most `limit` of each job (the feature)."""
    return _first(frontier.filter(F.col("status").isin(*TERMINAL)), [F.col("updated_at"), F.col("url")], limit)


def queued_urls(frontier: DataFrame, limit: int = 200) -> DataFrame:
    return _first(frontier.filter("status = 'queued'"), [F.desc("priority"), F.col("depth"), F.col("discovered_at"), F.col("url")], limit)


def recent_errors(frontier: DataFrame, limit: int = 50) -> DataFrame:
    return _first(frontier.filter("status = 'error'"), [F.desc("updated_at"), F.col("url")], limit)


def _first(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    w = Window.partitionBy("job_id").orderBy(*order)
    return rows.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= limit).select("job_id", "pos", "url")


def has_pending(frontier: DataFrame) -> DataFrame:
    """(job_id, pending): a job has queued or leased rows."""
    return frontier.groupBy("job_id").agg(F.bool_or(F.col("status").isin("queued", "in_progress")).alias("pending"))


def job_report(parts: DataFrame, key: str, order: Sequence[str], source: str, body: str) -> DataFrame:
    """One markdown report per job: `## Source:` sections in order."""
    rows = parts.select(key, F.struct(*order, F.concat(F.lit("## Source: "), F.col(source).cast("string"), F.lit("\n\n"), F.coalesce(body, F.lit(""))).alias("part")).alias("row"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda x: x["part"]), "\n\n---\n\n").alias("report"))
