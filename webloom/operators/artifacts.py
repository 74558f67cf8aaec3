"""Debug artifacts as two tables: one row per artifact, one row per file of an artifact.

artifacts: (artifact_id, created_at, url, final_url, success, reason, http_status, gear_used, session_id, files, html_truncated,
html_bytes, console_count, request_failure_count, extra); files: (artifact_id, name, content binary, modified_at).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.archive import truncate_utf8
from .state import sampled

MODES = ("off", "fail", "sample", "always")
#: Files that may be read as text, and names that ids and files may have.
TEXT_FILES = ("metadata.json", "page.html", "console.json", "request_failures.json")
SAFE_ID, SAFE_FILE = "^[A-Za-z0-9][A-Za-z0-9_.-]{0,127}$", "^[A-Za-z0-9][A-Za-z0-9_.-]{0,127}$"
EXCERPT = 5000


def should_capture(success: Column, url: Column, reason: Column, mode: str = "fail", rate: float = 0.05) -> Column:
    """Off, always, failures only, or failures and a sample of the successes that is the same for the same URL and reason."""
    mode = mode.strip().lower() if mode.strip().lower() in MODES else "fail"
    if mode in ("off", "always"):
        return F.lit(mode == "always")
    if mode == "fail":
        return ~success
    key = F.concat(F.coalesce(url, F.lit("")), F.lit("|"), F.coalesce(reason, F.lit("")))
    return ~success | sampled(key, max(0.0, min(rate, 1.0)))


def artifact_id(now: Column, url: Column, reason: Column, nonce: Column) -> Column:
    """UTC stamp and ten digits of a digest; `nonce` tells captures of one second apart (uuid() for live ones)."""
    digest = F.sha1(F.concat(url, F.lit("|"), reason, F.lit("|"), nonce))
    return F.concat(F.date_format(now, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), F.substring(digest, 1, 10))


def save(captures: DataFrame, now: Column, nonce: Column, mode: str = "fail", rate: float = 0.05, html_bytes: int = 512 * 1024) -> tuple[DataFrame, DataFrame]:
    """(artifacts, files) of captures (url, final_url, success, reason, http_status, gear_used, session_id, html, screenshot, console, request_failures, extra).

    console and request_failures are arrays of JSON texts, screenshot is binary, extra a map; the html is cut at `html_bytes` bytes.
    """
    c = captures.filter(should_capture(F.col("success"), F.col("url"), F.col("reason"), mode, rate))
    c = c.withColumn("artifact_id", artifact_id(now, F.col("url"), F.col("reason"), nonce)).withColumn("created_at", now)
    count = lambda name: F.greatest(F.coalesce(F.size(name), F.lit(0)), F.lit(0))
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    listed = lambda name: F.when(count(name) > 0, F.encode(F.concat(F.lit("["), F.array_join(name, ","), F.lit("]")), "utf-8"))
    bodies = {
        "page.html": F.when(F.col("html") != "", F.encode(truncate_utf8(F.col("html"), html_bytes), "utf-8")),
        "screenshot.png": F.when(F.octet_length("screenshot") > 0, F.col("screenshot")),
        "console.json": listed("console"),
        "request_failures.json": listed("request_failures"),
    }
    made = F.filter(F.array(*(F.struct(F.lit(n).alias("name"), b.alias("content")) for n, b in bodies.items())), lambda x: x["content"].isNotNull())
    c = c.withColumn("_made", made)
    table = c.select(
        "artifact_id", "created_at", "url", F.coalesce(F.nullif("final_url", F.lit("")), "url").alias("final_url"), "success", "reason",
        F.coalesce("http_status", F.lit(0)).alias("http_status"), F.coalesce("gear_used", F.lit("")).alias("gear_used"),
        F.coalesce("session_id", F.lit("")).alias("session_id"), F.array_sort(F.transform("_made", lambda x: x["name"])).alias("files"),
        (size > html_bytes).alias("html_truncated"), size.cast("long").alias("html_bytes"), count("console").alias("console_count"),
        count("request_failures").alias("request_failure_count"), F.coalesce("extra", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("extra"),
    )
    meta = F.encode(F.to_json(F.struct(*table.columns)), "utf-8")
    files = c.select("artifact_id", F.col("created_at").alias("modified_at"), F.explode("_made").alias("f")).select("artifact_id", "f.name", "f.content", "modified_at")
    described = table.select("artifact_id", F.lit("metadata.json").alias("name"), meta.alias("content"), F.col("created_at").alias("modified_at"))
    return table, files.unionByName(described)


def blocked_pages(failures: DataFrame, now: Column) -> DataFrame:
    """(raw_id, url, crawled_at, status, reason, gear_used, metadata, body): diagnostic rows with the page's first characters.

    failures: (raw_id, url, reason, html, gear_used, metadata).
    """
    excerpt = F.substring(F.coalesce("html", F.lit("")), 1, EXCERPT)
    body = F.concat(F.lit("# BLOCKED: "), "reason", F.lit("\n\n## HTML excerpt\n\n```\n"), excerpt, F.lit("\n```"))
    return failures.select("raw_id", "url", now.alias("crawled_at"), F.lit("blocked").alias("status"), "reason", F.coalesce("gear_used", F.lit("")).alias("gear_used"), "metadata", body.alias("body"))


def entries(files: DataFrame) -> DataFrame:
    """(artifact_id, modified_at, size) of artifacts with a safe id and metadata."""
    sized = files.filter(F.col("artifact_id").rlike(SAFE_ID)).groupBy("artifact_id")
    meta = F.max(F.when(F.col("name") == "metadata.json", F.col("modified_at")))
    return sized.agg(meta.alias("modified_at"), F.sum(F.octet_length("content")).alias("size")).filter("modified_at IS NOT NULL")


def newest(artifacts: DataFrame, limit: int = 50) -> DataFrame:
    """The newest artifacts, 1 to 500 of them (the feature)."""
    return artifacts.orderBy(F.desc("created_at"), "artifact_id").limit(max(1, min(limit, 500)))


def read_text(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted (artifact_id, name) with `text`, or `error`: not text-readable, or not found."""
    got = files.select("artifact_id", "name", F.decode("content", "utf-8").alias("text"))
    j = wanted.join(got, ["artifact_id", "name"], "left")
    text_file = F.col("name").isin(*TEXT_FILES) & F.col("artifact_id").rlike(SAFE_ID)
    error = F.when(~text_file, "invalid-artifact").when(F.col("text").isNull(), "artifact-not-found")
    return j.select("artifact_id", "name", F.when(text_file, F.col("text")).alias("text"), error.alias("error"))


def read_screenshot(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted (artifact_id) with `content`, null where there is none."""
    return wanted.join(files.filter("name = 'screenshot.png'").select("artifact_id", "content"), "artifact_id", "left")


def summaries(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """artifacts without bodies, with file_count, total_bytes, declared_files, listed files and extra_keys."""
    declared = artifacts.select("artifact_id", F.array_sort(F.array_distinct(F.filter("files", lambda x: x.rlike(SAFE_FILE)))).alias("declared_files"))
    f = files.filter(F.col("name").rlike(SAFE_FILE)).join(declared, "artifact_id")
    told = F.struct(
        "name", F.octet_length("content").cast("long").alias("size"), (F.array_contains("declared_files", F.col("name")) | (F.col("name") == "metadata.json")).alias("declared"),
        F.col("name").isin(*TEXT_FILES).alias("text_readable"), "modified_at",
    )
    listed = f.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("file_count"), F.sum(F.octet_length("content")).alias("total_bytes"), F.array_sort(F.collect_list(told)).alias("listed"))
    keys = F.array_sort(F.map_keys("extra"))
    return artifacts.join(declared, "artifact_id").join(listed, "artifact_id").withColumn("extra_keys", keys).drop("extra", "files").withColumnRenamed("listed", "files")


def cleanup(items: DataFrame, now: Column, max_age_days: int = 14, max_total_bytes: int = 512 << 20) -> DataFrame:
    """entries with `reasons` to remove each: age, or max-bytes from the oldest on until the rest fits; a negative limit turns its rule off.

    Sizes are summed by day first and then inside the day in which the limit falls, so that no task holds all entries.
    """
    aged = F.lit(max_age_days >= 0) & (F.col("modified_at") < now - F.expr(f"INTERVAL {max(0, max_age_days)} DAYS"))
    rows = items.withColumn("_aged", F.coalesce(aged, F.lit(False))).withColumn("_day", F.to_date("modified_at"))
    left = F.when(F.col("_aged"), 0).otherwise(F.col("size"))
    days = rows.groupBy("_day").agg(F.sum(left).alias("_sum"))
    # one row a day
    later = Window.partitionBy(F.lit(0)).orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_newer", F.coalesce(F.sum("_sum").over(later), F.lit(0)))
    inside = Window.partitionBy("_day").orderBy(F.desc("modified_at"), F.desc("artifact_id"))
    held = F.col("_newer") + F.sum(left).over(inside)
    over = F.lit(max_total_bytes >= 0) & ~F.col("_aged") & (held > max_total_bytes)
    out = rows.join(F.broadcast(days.select("_day", "_newer")), "_day").withColumn("_over", over)
    reasons = F.array_compact(F.array(F.when(F.col("_aged"), "age"), F.when(F.col("_over"), "max-bytes")))
    return out.withColumn("reasons", reasons).drop("_aged", "_day", "_newer", "_over")
