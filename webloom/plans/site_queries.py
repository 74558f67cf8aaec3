"""Queries of artifacts, jobs, keyword tables, caches, sections, payloads and archives, with their SQL; see catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cookies, detection, html, markdown, results, tables, urls
from ..operators import access, artifacts, caches, crawl, domain_rules, jobs, keyed_store, keyword_rules, keyword_scan, networks, rules, state
from ..sources import archive, archive_source, site_index
from ..streaming import audit
from . import catalogue
from .catalogue import _HEADED, _TALKS, ANCHORS, URLS, _headed, _talks, pages, query, t
from .lineage import cut, remove_folder, shared_folder

def _now() -> Column:
    return F.lit("2024-02-01").cast("timestamp")


# --- artifacts -------------------------------------------------------------------------------------------------------------
_CAPTURED = """k AS (SELECT event_id, 'https://e.example/' || event_id AS url, event_type AS reason, event_type <> 'error' AS success, props FROM events),
 s AS (SELECT *, NOT success OR ('0x' || substr(sha1(url || '|' || reason), 1, 8))::BIGINT / 4294967295.0 < 0.25 AS taken FROM k)"""


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    page = F.concat(F.lit("<p>é"), F.repeat(F.lit("é"), (F.col("event_id") % 9).cast("int")), F.lit("</p>"))
    none = F.array().cast("array<string>")
    return e.select(
        F.concat(F.lit("https://e.example/"), F.col("event_id")).alias("url"), F.lit("").alias("final_url"), (F.col("event_type") != "error").alias("success"), F.col("event_type").alias("reason"),
        F.lit(200).alias("http_status"), F.lit("plain").alias("gear_used"), F.lit(None).cast("string").alias("session_id"), F.when(F.col("event_id") % 3 > 0, page).otherwise("").alias("html"),
        F.when(F.col("event_id") % 4 == 0, F.encode(F.lit("png"), "utf-8")).alias("screenshot"), F.when(F.col("event_id") % 5 == 0, F.array("props", "props")).otherwise(none).alias("console"),
        none.alias("request_failures"), F.create_map(F.lit("b"), F.col("event_type"), F.lit("a"), F.lit("1")).alias("extra"), "event_id", F.col("ts").cast("timestamp").alias("at"),
    )


@query(f"WITH {_CAPTURED} SELECT event_id, taken, NOT success AS failed FROM s")
def artifact_capture(spark, sf_dir):
    c = _captures(spark, sf_dir)
    given = (F.col("success"), F.col("url"), F.col("reason"))
    return c.select("event_id", artifacts.should_capture(*given, "sample", 0.25).alias("taken"), artifacts.should_capture(*given, "Fail ").alias("failed"))


_SAVED = f"""{_CAPTURED}, a AS (SELECT *, strftime(TIMESTAMP '2024-02-01', '%Y%m%dT%H%M%SZ') || '-' || substr(sha1(url || '|' || reason || '|' || event_id), 1, 10) AS artifact_id,
 CASE WHEN event_id % 3 > 0 THEN 9 + 2 * (event_id % 9) ELSE 0 END AS html_bytes FROM s WHERE taken),
 f AS (SELECT artifact_id, 'page.html' AS name, least(html_bytes, 17) AS size FROM a WHERE html_bytes > 0 UNION ALL SELECT artifact_id, 'screenshot.png', 3 FROM a WHERE event_id % 4 = 0
  UNION ALL SELECT artifact_id, 'console.json', 3 + 2 * length(props) FROM a WHERE event_id % 5 = 0)"""


def _saved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return artifacts.save(_captures(spark, sf_dir), _now(), F.col("event_id").cast("string"), "sample", 0.25, 17)


@query(f"""WITH {_SAVED}, l AS (SELECT artifact_id, string_agg(name, ',' ORDER BY name) AS files FROM f GROUP BY 1)
 SELECT a.artifact_id, url, url AS final_url, coalesce(files, '') AS files, html_bytes > 17 AS html_truncated, html_bytes, CASE WHEN event_id % 5 = 0 THEN 2 ELSE 0 END AS console_count FROM a LEFT JOIN l ON l.artifact_id = a.artifact_id""")
def artifact_save(spark, sf_dir):
    made = _saved(spark, sf_dir)[0]
    return made.select("artifact_id", "url", "final_url", F.array_join("files", ",").alias("files"), "html_truncated", "html_bytes", "console_count")


@query(f"""WITH {_SAVED} SELECT a.artifact_id, 1 + count(name) AS file_count, CAST(coalesce(sum(size), 0) AS BIGINT) AS body_bytes, coalesce(string_agg(name, ',' ORDER BY name), '') AS declared, 'a,b' AS extra_keys,
 count(*) FILTER (WHERE name <> 'screenshot.png') + 1 AS readable FROM a LEFT JOIN f ON f.artifact_id = a.artifact_id GROUP BY 1""")
def artifact_summary(spark, sf_dir):
    s = artifacts.summaries(*_saved(spark, sf_dir))
    described = F.get(F.filter("files", lambda x: x["name"] == "metadata.json"), F.lit(0))["size"]
    readable = F.size(F.filter("files", lambda x: x["text_readable"]))
    return s.select("artifact_id", "file_count", (F.col("total_bytes") - described).alias("body_bytes"), F.array_join("declared_files", ",").alias("declared"), F.array_join("extra_keys", ",").alias("extra_keys"), readable.alias("readable"))


@query(f"""WITH {_SAVED}, w AS (SELECT artifact_id, event_id, CASE event_id % 4 WHEN 0 THEN 'screenshot.png' WHEN 1 THEN 'page.html' WHEN 2 THEN 'console.json' ELSE '../x' END AS name FROM a)
 SELECT w.artifact_id, w.name, CASE WHEN w.name = 'page.html' AND f.name IS NOT NULL THEN '<p>' || repeat('é', CAST(least(1 + event_id % 9, 7) AS INT)) || CASE WHEN event_id % 9 <= 4 THEN '</p>' WHEN event_id % 9 = 5 THEN '</' ELSE '' END
   WHEN w.name = 'console.json' AND f.name IS NOT NULL THEN '[' || (SELECT any_value(props) FROM a x WHERE x.artifact_id = w.artifact_id) || ',' || (SELECT any_value(props) FROM a x WHERE x.artifact_id = w.artifact_id) || ']' END AS text,
  CASE WHEN w.name IN ('../x', 'screenshot.png') THEN 'invalid-artifact' WHEN f.name IS NULL THEN 'artifact-not-found' END AS error FROM w LEFT JOIN f ON f.artifact_id = w.artifact_id AND f.name = w.name""")
def artifact_read(spark, sf_dir):
    made, files = _saved(spark, sf_dir)
    number = F.regexp_extract("url", "([0-9]+)$", 1).cast("long") % 4
    wanted = made.select("artifact_id", F.get(F.array(*map(F.lit, ("screenshot.png", "page.html", "console.json", "../x"))), number.cast("int")).alias("name"))
    return artifacts.read_text(wanted, files)


@query(f"WITH {_CAPTURED} SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 30")
def artifact_list(spark, sf_dir):
    e = t(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("ts").alias("created_at"), F.col("event_id").alias("artifact_id"))
    return artifacts.newest(e, 30).select(F.col("artifact_id").alias("event_id"), F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query("""WITH e AS (SELECT event_id, CAST(value * 100 AS BIGINT) AS size, ts < TIMESTAMP '2024-01-15' AS aged, ts FROM events)
 SELECT event_id, array_to_string(list_filter([CASE WHEN aged THEN 'age' END, CASE WHEN NOT aged AND held > 5000000 THEN 'max-bytes' END], lambda x: x IS NOT NULL), ',') AS reasons
 FROM (SELECT *, sum(CASE WHEN aged THEN 0 ELSE size END) OVER (ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS held FROM e)""")
def artifact_cleanup(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(F.col("event_id").alias("artifact_id"), F.col("ts").cast("timestamp").alias("modified_at"), F.floor(F.col("value") * 100 + 0.5).cast("long").alias("size"))
    done = artifacts.cleanup(e, F.lit("2024-01-29").cast("timestamp"), 14, 5_000_000)
    return done.select(F.col("artifact_id").alias("event_id"), F.array_join("reasons", ",").alias("reasons"))


@query("SELECT page_id, '# BLOCKED: no text' || chr(10) || chr(10) || '## HTML excerpt' || chr(10) || chr(10) || '```' || chr(10) || substr(html, 1, 5000) || chr(10) || '```' AS body FROM pages")
def blocked_pages(spark, sf_dir):
    p = t(spark, sf_dir, "pages").select(F.col("page_id").alias("raw_id"), "url", F.lit("no text").alias("reason"), "html", F.lit("").alias("gear_used"), F.lit(None).cast("map<string,string>").alias("metadata"))
    return artifacts.blocked_pages(p, _now()).select(F.col("raw_id").alias("page_id"), "body")


# --- jobs ------------------------------------------------------------------------------------------------------------------
def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = t(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("total"))
    made = jobs.create(u.select(F.lit("https://a.example/").alias("start_url"), "total", "user_id"), F.lit(1.0), F.col("user_id"))
    ended = made.filter("job_id % 4 = 1").select("job_id", F.when(F.col("job_id") % 8 == 1, "failed").alias("status"))
    return jobs.complete(jobs.update_progress(made, made.select("job_id", (F.col("total") / 2).cast("int").alias("completed")).filter("job_id % 3 = 0"), F.lit(2.0)), ended, F.lit(3.0))


@query("""WITH j AS (SELECT user_id AS job_id, count(*) AS total FROM events GROUP BY 1),
 a AS (SELECT job_id, CASE WHEN job_id % 8 = 1 THEN 'failed' WHEN job_id % 4 = 1 THEN 'completed' ELSE 'running' END AS status, CASE WHEN job_id % 3 = 0 THEN total // 2 ELSE 0 END AS completed, CASE WHEN job_id % 4 = 1 THEN 3.0 WHEN job_id % 3 = 0 THEN 2.0 ELSE 1.0 END AS tm FROM j)
 SELECT job_id, CASE WHEN job_id % 5 = 0 AND status = 'running' THEN 'cancelled' WHEN status = 'running' THEN 'failed' ELSE status END AS status, completed, CASE WHEN job_id % 5 = 0 AND status = 'running' THEN 4.0::DOUBLE WHEN status = 'running' THEN 5.0::DOUBLE ELSE tm::DOUBLE END AS updated_at FROM a""")
def job_states(spark, sf_dir):
    j = _jobs(spark, sf_dir)
    j = jobs.cancel(j, j.filter("job_id % 5 = 0").select("job_id"), F.lit(4.0))
    return jobs.fail_running(j, F.lit(5.0)).select("job_id", "status", "completed", "updated_at")


@query("SELECT user_id AS job_id, CAST(count(*) AS INT) AS total FROM events GROUP BY 1 ORDER BY max(ts) DESC, user_id LIMIT 20")
def job_recent(spark, sf_dir):
    u = t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job_id")).agg(F.count(F.lit(1)).cast("int").alias("total"), F.max("ts").alias("updated_at"))
    return jobs.recent(u.withColumn("start_url", F.lit("")).withColumn("status", F.lit("running")).withColumn("completed", F.lit(0))).select("job_id", "total")


_ENDS = "f AS (SELECT user_id AS job_id, 'u' || event_id AS url, event_type AS kind, ts, event_id FROM events WHERE event_type IN ('view', 'error'))"


@query(f"""WITH {_ENDS}, p AS (SELECT job_id, string_agg(chr(10) || '---' || chr(10) || chr(10) || '## Source: ' || url || chr(10) || chr(10) || text, chr(10) ORDER BY ts, url) AS body FROM f JOIN documents ON doc_id = event_id WHERE kind = 'view' GROUP BY 1),
 x AS (SELECT job_id, string_agg('- ' || url || ': timeout', chr(10) ORDER BY n) AS said FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, url) AS n FROM f WHERE kind = 'error') WHERE n <= 20 GROUP BY 1)
 SELECT u.job_id, '# Crawl job ' || u.job_id || chr(10) || chr(10) || 'Start: s' || chr(10) || 'Status: completed' || chr(10) || 'Pages: 1/2' || chr(10) || coalesce(chr(10) || body, '')
  || coalesce(chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Errors' || chr(10) || chr(10) || said, '') AS report FROM (SELECT DISTINCT job_id FROM f) u LEFT JOIN p USING (job_id) LEFT JOIN x USING (job_id)""")
def job_full_report(spark, sf_dir):
    e = t(spark, sf_dir, "events").filter("event_type IN ('view', 'error')")
    f = e.select(
        F.col("user_id").alias("job_id"), F.concat(F.lit("u"), F.col("event_id")).alias("url"), F.when(F.col("event_type") == "view", "fetched").otherwise("error").alias("status"),
        F.col("event_id").cast("string").alias("raw_id"), F.col("ts").alias("updated_at"), F.lit("timeout").alias("last_error"),
    )
    docs = t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("raw_id"), F.col("text").alias("body"))
    j = f.select("job_id").distinct().select("job_id", F.lit("s").alias("start_url"), F.lit("completed").alias("status"), F.lit(1).alias("completed"), F.lit(2).alias("total"))
    return jobs.report(j, f, docs)


#: A site of pages k that link to 2k + 1, 2k + 2 and k + 7; one in eleven fails for good, one in seven once or always.
_SITE = "SELECT event_id AS k, event_id % 11 = 5 AS lost, event_id % 7 = 3 AS slow FROM events"


@query(f"""WITH RECURSIVE s AS ({_SITE}), w AS (SELECT CAST(0 AS BIGINT) AS k, 0 AS depth UNION SELECT n.k, w.depth + 1 FROM w JOIN s ON s.k = w.k AND NOT lost AND NOT slow, LATERAL (SELECT unnest([2 * w.k + 1, 2 * w.k + 2, w.k + 7]) AS k) n WHERE w.depth < 5 AND n.k % 10 <> 9),
 d AS (SELECT k, min(depth) AS depth FROM w GROUP BY 1)
 SELECT 'https://site.example/p/' || k AS url, CAST(depth AS INT) AS depth, CASE WHEN s.k IS NULL OR lost OR slow THEN 'error' ELSE 'fetched' END AS status, CASE WHEN slow THEN 2 ELSE 0 END AS retry_count FROM d LEFT JOIN s USING (k)""")
def crawl_loop(spark, sf_dir):
    k = F.col("event_id")
    address = lambda x: F.concat(F.lit("https://site.example/p/"), x.cast("string"))
    lost, slow = k % 11 == 5, k % 7 == 3
    site = t(spark, sf_dir, "events").select(
        address(k).alias("url"), (~lost & ~slow).alias("ok"), F.when(lost | slow, F.when(slow, "timeout").otherwise("gone")).alias("error"), slow.alias("retryable"),
        F.array(address(2 * k + 1), address(2 * k + 2), address(k + 7), F.lit("https://other.example/p/1")).alias("links"),
    )
    policy = crawl.CrawlPolicy("https://site.example/p/0", max_depth=5, exclude_paths=("*9",))
    no_seeds = spark.createDataFrame([], "url string")
    frontier, _ = jobs.run("https://site.example/p/0", no_seeds, lambda asked: asked.join(site, "url"), policy, jobs.Budget(max_pages=10_000), cut)
    return frontier.select("url", "depth", "status", "retry_count")


# --- keyword rules ---------------------------------------------------------------------------------------------------------
_RULE_ROWS = (
    ("a-junk", ["worthless", "it's"], [], [], False, "any", True, "global"), ("b-english", [], [" the ", " of "], [], True, "any", True, "domain:en"), ("c-dots", [], [], ["[a-z]+\\.", "[0-9]{9}"], False, "body", True, "domain:de"),
    ("d-off", ["e"], [], [], False, "any", False, "global"), ("e-title", ["the"], [], [], False, "title", True, "domain:fr"),
)


def _rules(spark: SparkSession) -> DataFrame:
    schema = "name string, exclude array<string>, include array<string>, regex array<string>, case_sensitive boolean, match_position string, enabled boolean, scope string"
    return spark.createDataFrame(_RULE_ROWS, schema).withColumn("notes", F.lit("")).withColumn("created_at", F.lit(0.0)).withColumn("updated_at", F.lit(0.0))


@query(r"""SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN NULL WHEN lang = 'en' AND NOT (contains(text, ' the ') OR contains(text, ' of ')) THEN 'include_not_matched (rule=b-english)'
 WHEN lang = 'de' AND NOT regexp_matches(CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END, '(?i)[a-z]+\.|[0-9]{9}') THEN 'regex_not_matched (rule=c-dots)'
 WHEN lang = 'fr' AND contains(lower(split_part(text, chr(10), 1)), 'the') THEN 'excluded_keyword: ''the'' (rule=e-title)'
 WHEN contains(lower(text), 'worthless') THEN 'excluded_keyword: ''worthless'' (rule=a-junk)' WHEN contains(lower(text), 'it''s') THEN 'excluded_keyword: "it''s" (rule=a-junk)' END AS reason FROM documents""")
def keyword_table_filter(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("domain"))
    return keyword_rules.filtered(d, _rules(spark)).select("doc_id", "reason")


@query("""SELECT user_id AS name, CASE WHEN user_id % 4 = 0 THEN 'domain:x' ELSE 'global' END AS scope, user_id % 6 <> 0 AS enabled, CASE WHEN user_id % 4 = 0 OR user_id % 6 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS updated_at
 FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 5 <> 0""")
def keyword_rule_changes(spark, sf_dir):
    ids = t(spark, sf_dir, "events").select(F.col("user_id").alias("name")).distinct()
    none = F.array().cast("array<string>")
    new = ids.select("name", none.alias("include"), none.alias("exclude"), none.alias("regex"), F.lit(False).alias("case_sensitive"), F.lit("any").alias("match_position"), F.lit(True).alias("enabled"), F.lit("global").alias("scope"), F.lit("").alias("notes"))
    table, _ = keyword_rules.add(new.filter("name < 50").withColumn("created_at", F.lit(1.0)).withColumn("updated_at", F.lit(1.0)), new, F.lit(1.0))
    changes = ids.select("name", F.when(F.col("name") % 4 == 0, "domain:x").alias("scope"), F.when(F.col("name") % 6 == 0, False).alias("enabled"))
    return keyword_rules.delete(keyword_rules.update(table, changes, F.lit(2.0)), ids.filter("name % 5 = 0")).select("name", "scope", "enabled", "updated_at")


@query("""WITH k AS (SELECT 'r' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS name, CASE WHEN event_id % 3 = 0 THEN 'domain:' || (['en', 'de', 'fr', 'es'])[1 + event_id % 4] ELSE 'global' END AS scope, event_id % 2 = 0 AS exact,
  chr(97 + CAST(event_id % 26 AS INT)) || chr(97 + CAST(event_id // 26 % 26 AS INT)) || chr(97 + CAST(event_id // 676 % 26 AS INT)) AS word FROM events WHERE event_id % 7 <> 0),
 l AS (SELECT doc_id, lang, string_split(text, ' ') AS words FROM documents),
 w AS (SELECT DISTINCT doc_id, lang, unnest(words[2:-2]) AS said FROM l),
 m AS (SELECT w.doc_id, k.scope, k.name, k.word FROM w JOIN k ON k.word = w.said AND k.exact UNION ALL SELECT w.doc_id, k.scope, k.name, k.word FROM w JOIN k ON k.word = lower(w.said) AND NOT k.exact),
 f AS (SELECT m.doc_id, min_by('excluded_keyword: '' ' || word || ' '' (rule=' || name || ')', (scope = 'global', name)) AS reason FROM m JOIN documents d ON d.doc_id = m.doc_id WHERE scope IN ('global', 'domain:' || d.lang) GROUP BY 1)
 SELECT d.doc_id, f.reason FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id""")
def keyword_table_scan(spark, sf_dir):
    """A rule for six of seven events: some scoped, some exact; as many rules as the table of events is large."""
    k = F.col("event_id")
    letter = lambda n: F.chr(97 + (F.floor(k / n) % 26))
    none = F.array().cast("array<string>")
    rules = t(spark, sf_dir, "events").filter(k % 7 != 0).select(
        F.concat(F.lit("r"), F.lpad(k.cast("string"), 9, "0")).alias("name"), none.alias("include"), F.array(F.concat(F.lit(" "), letter(1), letter(26), letter(676), F.lit(" "))).alias("exclude"), none.alias("regex"),
        (k % 2 == 0).alias("case_sensitive"), F.lit("any").alias("match_position"), F.lit(True).alias("enabled"),
        F.when(k % 3 == 0, F.concat(F.lit("domain:"), F.get(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (k % 4).cast("int")))).otherwise("global").alias("scope"),
    )
    d = t(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("domain"))
    return keyword_scan.filtered(d, rules).select("doc_id", "reason")


# --- caches ----------------------------------------------------------------------------------------------------------------
@query("""SELECT event_id, (SELECT max_by(v.event_id, (v.ts, v.event_id)) FROM events v WHERE v.user_id = e.user_id AND v.event_type = 'view' AND v.ts <= e.ts AND epoch(e.ts) - epoch(v.ts) <= 43200) AS value FROM events e WHERE event_type = 'click'""")
def ttl_cache(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_type", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").cast("double").alias("at"), "event_id")
    stored = e.filter("event_type = 'view'").select("key", "at", F.col("event_id").alias("value"))
    return caches.lookup(e.filter("event_type = 'click'").select("key", "at", "event_id"), stored, caches.ROBOTS_TTL).select("event_id", "value")


@query("""WITH RECURSIVE e AS (SELECT *, epoch(ts) AS at, user_id AS host, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts), event_id) AS k FROM events),
 w AS (SELECT DISTINCT host, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS event_id, CAST(0 AS DOUBLE) AS last, CAST(0 AS DOUBLE) AS until, false AS counts FROM e
  UNION ALL SELECT w.host, e.k, e.event_id, CASE WHEN e.event_type = 'error' THEN w.last WHEN w.until > e.at THEN w.until ELSE greatest(e.at, w.last + 60.0 * pow(2, e.event_id % 3)) END,
   CASE WHEN e.event_type = 'error' THEN e.at + 500.0 ELSE w.until END, e.event_type <> 'error' FROM w JOIN e ON e.host = w.host AND e.k = w.k + 1)
 SELECT event_id, round(last, 3) AS start FROM w WHERE counts""")
def request_times(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    asked = e.select(F.col("user_id").alias("domain"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").cast("double").alias("at"), F.when(F.col("event_type") == "error", 500.0).alias("retry_after"), F.lit(1.0).alias("factor"), (F.col("event_id") % 3).alias("attempt"))
    return caches.request_times(asked, 60.0).select(F.col("id").alias("event_id"), F.round("start", 3).alias("start"))


@query(f"WITH {URLS} SELECT page_id, length(canonical) % 3 <> 1 OR length(domain) % 2 = 0 AS changed FROM c")
def content_changed(spark, sf_dir):
    p = pages(spark, sf_dir)
    own, k = F.substring(F.sha1("canonical"), 1, 16), F.length("canonical") % 3
    old = p.filter(k > 0).select(urls.url_id(F.col("url")).alias("url_id"), F.when(k == 1, own).otherwise("").alias("content_hash")).distinct()
    now = p.select("page_id", "url", F.when(F.length("domain") % 2 == 1, own).otherwise("new").alias("content_hash"))
    return caches.changed(now, old).select("page_id", "changed")


@query("SELECT url FROM (SELECT 'u' || event_id AS url, ts FROM events WHERE event_type <> 'error') ORDER BY ts DESC, url LIMIT 50")
def recent_scrapes(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    seen = e.select(F.concat(F.lit("u"), F.col("event_id")).alias("url"), F.when(F.col("event_type") == "error", "").otherwise("r").alias("raw_id"), F.col("ts").alias("crawled_at"))
    return caches.recent_scrapes(seen).select("url")


@query("SELECT event_id, text, CASE WHEN doc_id IS NULL THEN 'raw-not-found' END AS error FROM events LEFT JOIN documents ON doc_id = event_id * 2")
def keyed_read(spark, sf_dir):
    wanted = t(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 2).alias("doc_id"))
    return caches.keyed(wanted, t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "raw-not-found").select("event_id", "text", "error")


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'rules', 5")
def engine_counts(spark, sf_dir):
    return caches.engine_counts(documents=t(spark, sf_dir, "documents"), pages=t(spark, sf_dir, "pages"), rules=_rules(spark))


@query(f"""WITH {URLS} SELECT page_id, CASE WHEN length(domain) % 3 = 0 AND length(domain) % 2 = 0 THEN 'promoted' WHEN ends_with(domain, 'example.com') THEN 'com' WHEN ends_with(domain, 'example.org') THEN 'org' END AS gear_hint FROM c""")
def promoted_rules(spark, sf_dir):
    p = pages(spark, sf_dir)
    promoted = p.select("domain").distinct().filter("length(domain) % 3 = 0").select("domain", F.lit("promoted").alias("gear_hint"), F.when(F.length("domain") % 2 == 0, 90_000.0).otherwise(10.0).alias("at"))
    known = spark.createDataFrame([("example.com", "com"), ("example.org", "org")], "suffix string, gear_hint string")
    return caches.site_rules(p.select("page_id", "domain"), promoted, known, F.lit(100_000.0)).select("page_id", "gear_hint")


@query("SELECT event_id, 1.5::DOUBLE * (1 + event_id % 4) * pow(2.0::DOUBLE, event_id % 5) AS bound FROM events")
def jitter_bound(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return e.select("event_id", caches.jitter_bound(1.5, (F.col("event_id") % 4 + 1).cast("double"), F.col("event_id") % 5).alias("bound"))


# --- frontier lists --------------------------------------------------------------------------------------------------------
@query("""WITH f AS (SELECT user_id AS job_id, 'https://example.com/' || event_id AS url, event_type, CAST(floor(value) AS INT) AS priority, ts FROM events)
 SELECT 'done' AS list, job_id, CAST(pos AS INT) AS pos, url FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, url) AS pos FROM f WHERE event_type NOT IN ('click', 'purchase')) WHERE pos <= 10
 UNION ALL SELECT 'queued', job_id, CAST(pos AS INT), url FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY priority DESC, ts, url) AS pos FROM f WHERE event_type = 'click') WHERE pos <= 5
 UNION ALL SELECT 'errors', job_id, CAST(pos AS INT), url FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, url) AS pos FROM f WHERE event_type = 'error') WHERE pos <= 5
 UNION ALL SELECT 'pending', job_id, max(CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END), '' FROM f GROUP BY 2""")
def frontier_lists(spark, sf_dir):
    f = catalogue._frontier(spark, sf_dir)
    named = lambda name, rows: rows.select(F.lit(name).alias("list"), "job_id", "pos", "url")
    pending = crawl.has_pending(f).select("job_id", F.col("pending").cast("int").alias("pos"), F.lit("").alias("url"))
    return named("done", crawl.done_urls(f, 10)).unionByName(named("queued", crawl.queued_urls(f, 5))).unionByName(named("errors", crawl.recent_errors(f, 5))).unionByName(named("pending", pending))


@query(f"WITH {catalogue._FRONTIER} SELECT url, 120 AS next_cursor FROM f WHERE status = 'fetched' ORDER BY ts, url LIMIT 100 OFFSET 20")
def frontier_cursor(spark, sf_dir):
    return crawl.result_page(catalogue._frontier(spark, sf_dir), 20, 1000).select("url", "next_cursor")


@query("SELECT event_id, event_type = 'view' OR user_id % 3 = 0 OR user_id % 3 = 1 AND event_type = 'click' AS inside FROM events")
def final_url_scope(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    final = F.get(F.array(F.lit("https://WWW.site.example/x"), F.lit("https://a.site.example/"), F.lit("https://other.example/")), (F.col("user_id") % 3).cast("int"))
    wanted = F.when(F.col("event_type") == "view", "").otherwise("site.example")
    deep = crawl.final_url_allowed(final, wanted, True)
    return e.select("event_id", F.when(F.col("event_type") == "click", deep).otherwise(crawl.final_url_allowed(final, wanted)).alias("inside"))


# --- links, sections, payloads ---------------------------------------------------------------------------------------------
@query(f"""WITH {ANCHORS}, f AS (SELECT page_id, regexp_replace(url, '([^/])/+$', '\\1') AS url, pos FROM l WHERE first_one)
 SELECT page_id, url, true AS same_domain, CASE WHEN n = 1 THEN 'T "a" & b' ELSE '' END AS title, CASE WHEN n = 1 THEN 'nofollow,me' ELSE '' END AS rel FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM f) WHERE n <= 4""")
def page_links_limited(spark, sf_dir):
    p = t(spark, sf_dir, "pages")
    marked = F.regexp_replace("html", r'^(.*?)<a href="', "$1<!-- <a href='/no'> --><a href=https://elsewhere.example/x>out</a><a href=mailto:me>me</a><A title='T \"a\" &amp; b' rel=\"nofollow  me\" href=\"")
    rows = crawl.links(p.withColumn("html", marked), same_domain_only=True, max_links=4)
    return rows.select("page_id", "url", "same_domain", "title", F.array_join("rel", ",").alias("rel"))


@query(f"""WITH {_TALKS}, s AS (SELECT conv_id, role, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS total,
  1 + coalesce(sum(2 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM conversations)
 SELECT conv_id, '# 📍 页面目录索引 (Total Headings: ' || any_value(total) || ', Total Length: ' || any_value(length(md)) || ' chars)' || chr(10) || chr(10) || '使用 `mode=''section'', section_id=''Section N''` 调取对应章节内容。' || chr(10) || chr(10)
  || string_agg('  - **[Section ' || n || ']** Line ' || line || ': ' || role || ' ' || turn, chr(10) ORDER BY n) AS toc FROM s JOIN k USING (conv_id) GROUP BY 1""")
def doc_toc_text(spark, sf_dir):
    return _talks(spark, sf_dir).select("conv_id", markdown.toc(F.col("md")).alias("toc"))


@query(f"""WITH s AS (SELECT conv_id, role, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations),
 w AS (SELECT conv_id, max(total) AS total, CASE WHEN conv_id % 3 = 0 AND max(total) >= 2 THEN 2 WHEN conv_id % 3 = 1 THEN min(n) FILTER (WHERE contains(role, 'ssis')) END AS n FROM s GROUP BY 1)
 SELECT w.conv_id, CASE WHEN s.n IS NULL THEN '__ERROR__:{{"errorType":"section-not-found","message":"Section ''' || CASE conv_id % 3 WHEN 0 THEN 'Section 2' WHEN 1 THEN 'ASSIS' ELSE 'nothing' END || ''' not found in document. Available count: ' || w.total
   || '","retryable":false,"suggestedAction":"call mode=''toc'' first and use an existing section id"}}'
  ELSE '--- [Section ' || s.n || ' / ' || w.total || ': ' || role || ' ' || turn || '] ---' || chr(10) || chr(10) || '## ' || role || ' ' || turn || chr(10) || text || chr(10) || chr(10) || '--- [End of Section ' || s.n || '] ---' END AS section FROM w LEFT JOIN s USING (conv_id, n)""")
def doc_section_named(spark, sf_dir):
    wanted = F.get(F.array(F.lit("Section 2"), F.lit("ASSIS"), F.lit("nothing")), (F.col("conv_id") % 3).cast("int"))
    return _talks(spark, sf_dir).select("conv_id", markdown.section(F.col("md"), wanted).alias("section"))


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, doc_id % 4 AS i, CAST(ceil(length(coalesce(text, '')) / 500.0) AS BIGINT) AS total FROM documents)
 SELECT doc_id, CASE WHEN n <= 500 THEN text WHEN i < 1 OR i > total THEN '__ERROR__:{"errorType":"chunk-not-found","message":"Chunk ' || i || ' not found. Available chunks: 1-' || total || '","retryable":false,"suggestedAction":"request a chunk_index within the available range"}'
  ELSE '--- [Chunk ' || i || '/' || total || ' (Chars ' || (i - 1) * 500 || '-' || least(i * 500, n) || ' of ' || n || ')] ---' || chr(10) || chr(10) || substr(text, (i - 1) * 500 + 1, 500) || chr(10) || chr(10)
   || '--- [End of Chunk ' || i || '/' || total || '. has_next=' || CASE WHEN i < total THEN 'true, next_chunk_index=' || (i + 1) ELSE 'false' END || '] ---' END AS chunk FROM d""")
def doc_chunk(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", markdown.chunk(F.coalesce("text", F.lit("")), (F.col("doc_id") % 4).cast("int"), 500).alias("chunk"))


@query(rf"""WITH {_HEADED}, c AS (SELECT doc_id, md, {catalogue._CLEAN} AS t FROM h), k AS (SELECT *, substr(t, 1, 600 - length(chr(10) || chr(10) || '[...truncated...]')) AS head FROM c),
 m AS (SELECT *, greatest({catalogue._last("chr(10) || chr(10)", 2)}, {catalogue._last("chr(10) || '#'", 2)}, {catalogue._last("chr(10) || '- '", 3)}) AS edge FROM k),
 o AS (SELECT *, CASE WHEN length(t) <= 600 THEN t ELSE regexp_replace(CASE WHEN edge > 330 THEN substr(head, 1, edge) ELSE head END, '\s+$', '') || chr(10) || chr(10) || '[...truncated...]' END AS fitted FROM m)
 SELECT doc_id, length(md) AS original_chars, length(fitted) AS output_chars, length(t) > 600 AS truncated, 'https://example.com/d/' || doc_id AS cited FROM o""")
def fit_result(spark, sf_dir):
    r = _headed(spark, sf_dir).select("doc_id", markdown.fit_result(F.col("md"), 600).alias("r"))
    return r.select("doc_id", "r.original_chars", "r.output_chars", "r.truncated", F.array_join(F.transform("r.citations", lambda c: c["url"]), ",").alias("cited"))


_KINDS = tuple(results.GUIDANCE)


@query(f"""SELECT event_id, k.kind, k.kind IN ({', '.join(f"'{x}'" for x in results.RETRYABLE)}) AS again, k.advice, event_type AS message FROM events JOIN (VALUES {', '.join("({}, '{}', '{}')".format(i, x, results.GUIDANCE[x].replace("'", "''")) for i, x in enumerate(_KINDS))}) AS k(i, kind, advice) ON k.i = event_id % {len(_KINDS)}""")
def error_guidance(spark, sf_dir):
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.col("event_id") % len(_KINDS)).cast("int"))
    e = t(spark, sf_dir, "events").select("event_id", results.error_payload(results.format_error(kind, F.col("event_type"), results.GUIDANCE)).alias("e"))
    return e.select("event_id", F.col("e.errorType").alias("kind"), F.col("e.retryable").alias("again"), F.col("e.suggestedAction").alias("advice"), "e.message")


@query(f"""WITH {URLS} SELECT page_id, page_id % 4 < 3 AS ok, canonical AS canonical_url, substr(sha1(canonical), 1, 16) AS raw_id, CASE WHEN page_id % 4 < 3 THEN 'body ' || page_id ELSE '' END AS text, CASE WHEN page_id % 4 = 0 THEN 'm' ELSE canonical END AS url,
 CASE page_id % 4 WHEN 0 THEN 'art' WHEN 3 THEN 'bad' ELSE '' END AS artifact_id, CASE WHEN page_id % 5 = 0 THEN 'write_only' ELSE 'enabled' END AS cache_mode, CASE page_id % 4 WHEN 0 THEN 9 WHEN 1 THEN 2 ELSE 0 END AS link_count, CASE WHEN page_id % 4 = 3 THEN 'retry' END AS advice FROM c""")
def crawl_payload(spark, sf_dir):
    k = F.col("page_id") % 4
    bad = results.format_error(F.lit("timeout"), F.lit("slow"), details={"artifact_id": F.lit("bad")})
    two = F.array(F.lit("a"), F.lit("b"))
    some = lambda c: F.when(k == 0, c)
    meta = F.struct(some(F.lit("m")).alias("url"), some(F.lit("art")).alias("artifact_id"), F.when(k < 2, two).alias("links"), some(F.lit(9)).alias("link_count"))
    result = F.when(k == 3, bad).otherwise(F.concat(F.lit(results.OK), F.lit("body "), F.col("page_id")))
    p = results.crawl_payload(F.col("url"), result, meta, F.lit("enabled"), F.col("page_id") % 5 == 0, F.lit("full"))
    names = ("ok", "canonical_url", "raw_id", "text", "url", "artifact_id", "cache_mode", "link_count")
    return t(spark, sf_dir, "pages").select("page_id", p.alias("p")).select("page_id", *(F.col(f"p.{n}").alias(n) for n in names), F.col("p.error.suggestedAction").alias("advice"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ['https://s.example/a', 'https://s.example/b'] WHEN 1 THEN ['https://s.example/d/' || doc_id, 'https://s.example/c/w_(x)'] ELSE [] END AS links FROM documents""")
def result_links(spark, sf_dir):
    text = F.concat(F.lit("[a](d/"), F.col("doc_id"), F.lit(") [t](#x) [b](/c/w_(x)) [o](https://other.example/) [a](d/"), F.col("doc_id"), F.lit("?utm_x=1)"))
    k = F.col("doc_id") % 3
    result = F.when(k == 2, results.format_error(F.lit("timeout"), text)).otherwise(F.concat(F.lit(results.OK), text))
    stored = F.when(k == 0, F.array(*map(F.lit, ("https://s.example/a", "https://other.example/x", "https://s.example/b#z", "https://s.example/a"))))
    policy = crawl.CrawlPolicy("https://s.example/")
    return t(spark, sf_dir, "documents").select("doc_id", results.page_links(result, stored, F.lit("https://s.example/x"), policy.normalize).alias("links"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '__PARSERS_EXTRACTED_NO_TEXT__' WHEN 1 THEN '# Head' || chr(10) || chr(10) || 'Text ' || doc_id WHEN 2 THEN '# Data' || chr(10) || chr(10) || 'Body ' || doc_id
 WHEN 3 THEN '# Micro' || chr(10) || chr(10) || 'Told ' || doc_id ELSE 'only words ' || doc_id END AS markdown FROM documents""")
def page_extract(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    made = F.array(
        F.lit("<html><body><nav><h1>x</h1></nav><script>var a</script></body></html>"),
        F.concat(F.lit("<html><body><nav>no</nav><main><h1>Head</h1><p>Text "), n, F.lit("</p><p style='display:none'>hidden</p></main><footer>no</footer></body></html>")),
        F.concat(F.lit("<html><head><script type='application/ld+json'>{\"headline\": \"Data\", \"articleBody\": \"Body "), n, F.lit("\"}</script></head><body><p>short</p></body></html>")),
        F.concat(F.lit("<html><body><div itemscope><span itemprop=name>Micro</span><p itemprop=description>Told "), n, F.lit("</p></div></body></html>")),
        F.concat(F.lit("only words "), n),
    )
    d = t(spark, sf_dir, "documents").select("doc_id", F.get(made, (F.col("doc_id") % 5).cast("int")).alias("html"))
    return html.extracted(d).select("doc_id", "markdown")


@query("""SELECT doc_id, h OR tb OR l OR c OR doc_id % 7 = 0 AS misses FROM (SELECT doc_id, doc_id % 2 = 0 AND doc_id % 3 > 0 AS h, doc_id % 3 = 0 AND doc_id % 5 > 0 AS tb, doc_id % 5 = 0 AND doc_id % 2 > 0 AS l, doc_id % 11 = 0 AND doc_id % 4 > 0 AS c FROM documents)""")
def structure_misses(spark, sf_dir):
    k = F.col("doc_id")
    hints = F.struct((k % 2 == 0).alias("heading"), (k % 3 == 0).alias("table"), (k % 5 == 0).alias("link"), (k % 11 == 0).alias("code"))
    parts = [F.when(k % 3 == 0, "# head"), F.when(k % 5 == 0, "a | b"), F.when(k % 2 == 0, "[x](y)"), F.when(k % 4 == 0, "```\nc\n```")]
    text = F.when(k % 7 == 0, "").otherwise(F.array_join(F.array_compact(F.array(F.lit("words"), *parts)), "\n"))
    return t(spark, sf_dir, "documents").select("doc_id", markdown.misses_structure(text, hints).alias("misses"))


# --- archive, accounts, sessions -------------------------------------------------------------------------------------------
@query("SELECT page_id, url, 'It''s: ' || page_id || ' #1' AS title, CAST(page_id AS VARCHAR) AS number, url || chr(10) AS body FROM pages")
def archive_round_trip(spark, sf_dir):
    p = t(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.lit("It's: "), F.col("page_id"), F.lit(" #1")).alias("title"))
    text = archive.document_text({"url": F.col("url"), "title": F.col("title"), "gone": F.lit(None).cast("string"), "number": F.col("page_id")}, F.col("url"))
    head = archive.frontmatter(text)
    return p.select("page_id", *(head[k].alias(k) for k in ("url", "title", "number")), archive.strip_frontmatter(text).alias("body"))


@query("""SELECT user_id AS account_id, CASE WHEN user_id % 3 = 0 THEN 'blocked' ELSE 'active' END AS status, CASE WHEN user_id % 6 = 0 THEN 'new' WHEN user_id % 2 = 0 THEN 'old' ELSE '' END AS notes FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 2 = 0 OR user_id % 3 = 0""")
def profile_marks(spark, sf_dir):
    ids = t(spark, sf_dir, "events").select(F.col("user_id").alias("account_id")).distinct()
    flags = F.array().cast("array<string>")
    old = ids.filter("account_id % 2 = 0").select(F.lit("d").alias("domain"), "account_id", F.lit("").alias("label"), F.lit("active").alias("status"), F.lit("old").alias("notes"), flags.alias("risk_flags"), F.lit(False).alias("is_default"), F.lit(1.0).alias("created_at"), F.lit(1.0).alias("updated_at"))
    marks = ids.filter("account_id % 3 = 0").select(F.lit("d").alias("domain"), "account_id", F.lit("blocked").alias("status"), F.when(F.col("account_id") % 6 == 0, "new").otherwise("").alias("notes"), F.lit(None).cast("array<string>").alias("risk_flags"))
    return access.mark_profiles(old, marks, F.lit(2.0)).select("account_id", "status", "notes")


_KEY = "substr(sha1('d' || user_id || chr(31) || '' || chr(31) || '' || chr(31) || 'anonymous'), 1, 16)"


@query(f"""SELECT user_id, CASE WHEN user_id % 3 = 1 THEN {_KEY} || '-2' ELSE {_KEY} END AS session_id, 'active' AS status, CASE WHEN user_id % 3 = 0 THEN 8 ELSE 1 END AS use_count FROM (SELECT DISTINCT user_id FROM events)""")
def session_use(spark, sf_dir):
    ids = t(spark, sf_dir, "events").select("user_id").distinct()
    who = ids.select("user_id", F.concat(F.lit("d"), F.col("user_id")).alias("domain"), F.lit("").alias("account_id"), F.lit("").alias("proxy_url"), F.lit(False).alias("storage_state_bound"))
    key = access.session_key(F.col("domain"), F.col("account_id"), F.col("proxy_url"), F.col("storage_state_bound"))
    known = who.filter("user_id % 3 < 2").select(key.alias("session_id"), "domain", "account_id", "proxy_url", "storage_state_bound", F.when(F.col("user_id") % 3 == 0, "active").otherwise("retired").alias("status"), F.lit(0).alias("error_score"), F.lit(7).alias("use_count"), F.lit(1.0).alias("created_at"), F.lit(1.0).alias("updated_at"))
    done = access.use_sessions(who.drop("user_id"), known, F.lit(2.0)).filter("status = 'active'")
    return done.join(who.select("user_id", "domain"), "domain").select("user_id", "session_id", "status", "use_count")


@query("SELECT event_id, ts FROM events")
def latest_state(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    twice = e.select("event_id", "ts").unionByName(e.select("event_id", (F.col("ts") - F.expr("INTERVAL 1 DAY")).alias("ts")))
    return state.latest(twice, ["event_id"], [F.desc("ts")])


# --- scope, frontier moves, signs of pages ---------------------------------------------------------------------------------
@query(f"""WITH {URLS} SELECT page_id, CASE WHEN domain = 'example.com' OR ends_with(domain, '.example.com') THEN canonical ELSE '' END AS near, CASE WHEN host = 'm.example.com' OR domain = 'm.example.com' THEN canonical ELSE '' END AS own FROM c""")
def crawl_scope_domain(spark, sf_dir):
    near, own = crawl.CrawlPolicy("https://example.com/", include_subdomains=True), crawl.CrawlPolicy("https://m.example.com/")
    return t(spark, sf_dir, "pages").select("page_id", near.normalize(F.col("url")).alias("near"), own.normalize(F.col("url")).alias("own"))


_MOVED = "CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'queued' WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'error' WHEN event_type = 'click' THEN 'in_progress' ELSE 'fetched' END"


@query(f"""SELECT user_id AS job_id, 'u' || event_id AS url, {_MOVED} AS status, CASE WHEN event_type = 'click' AND event_id % 2 = 0 AND event_id % 5 < 2 THEN event_id % 5 + 1 ELSE event_id % 5 END AS retry_count FROM events WHERE event_type IN ('click', 'view') AND NOT (event_type = 'click' AND event_id % 2 = 0 AND event_id % 5 >= 2)
 UNION ALL SELECT user_id, 'u' || event_id, 'error', event_id % 5 FROM events WHERE event_type = 'click' AND event_id % 2 = 0 AND event_id % 5 >= 2
 UNION ALL SELECT user_id, 'u' || event_id, 'queued', 0 FROM events WHERE event_type = 'signup'""")
def frontier_moves(spark, sf_dir):
    """Of leased rows some fail for now, some for good, some leases run out; new rows come in, known ones are ignored."""
    e = t(spark, sf_dir, "events")
    clicked, k = F.col("event_type") == "click", F.col("event_id")
    f = e.filter("event_type IN ('click', 'view')").select(
        F.col("user_id").alias("job_id"), F.concat(F.lit("u"), k).alias("url"), F.when(clicked, "in_progress").otherwise("fetched").alias("status"), F.lit(0).alias("priority"), F.lit(0).alias("depth"),
        (k % 5).alias("retry_count"), F.lit(0.0).alias("next_fetch_at"), F.when(clicked & (k % 2 == 1) & (k % 3 > 0), 50.0).otherwise(99.0).alias("lease_expires_at"), F.col("ts").alias("discovered_at"), F.col("ts").alias("updated_at"),
    )
    failed = e.filter(clicked & ((k % 2 == 0) | (k % 3 == 0))).select(F.col("user_id").alias("job_id"), F.concat(F.lit("u"), k).alias("url"), (k % 2 == 0).alias("retryable"))
    new = e.filter("event_type IN ('signup', 'view')").select(
        F.col("user_id").alias("job_id"), F.concat(F.lit("u"), k).alias("url"), F.lit("queued").alias("status"), F.lit(0).alias("priority"), F.lit(1).alias("depth"), F.lit(0).cast("long").alias("retry_count"),
        F.lit(0.0).alias("next_fetch_at"), F.lit(None).cast("double").alias("lease_expires_at"), F.col("ts").alias("discovered_at"), F.col("ts").alias("updated_at"),
    )
    moved = crawl.enqueue(crawl.mark_retry(crawl.release_expired(f, F.lit(40.0)), failed, F.lit(10.0)), new)
    return moved.select("job_id", "url", "status", "retry_count")


_SIGNS = (
    ("<html>cf-turnstile</html>", True, None, False), ("<script>recaptcha hcaptcha</script>", True, None, False), ("recaptcha hcaptcha", False, None, False), ("<script>recaptcha</script>", False, None, False),
    ("<div data-reactroot>Something went wrong</div>", False, "something went wrong", False), ("<div>something went wrong</div>", False, None, False), ("<p>Loading Error", False, "loading error", False),
    ("<form>Sign in <input type=\"password\"></form>", False, None, True), ("<input type=\"password\">", False, None, False), ("", False, None, False),
)


@query("SELECT event_id, s.challenge, s.spa, s.login OR event_type = 'view' AS login FROM events JOIN (VALUES " + ", ".join(f"({k}, {str(c).lower()}, {'NULL' if f is None else repr(f)}, {str(g).lower()})" for k, (_, c, f, g) in enumerate(_SIGNS)) + f") AS s(k, challenge, spa, login) ON s.k = event_id % {len(_SIGNS)}")
def page_signs(spark, sf_dir):
    page = F.get(F.array(*(F.lit(x[0]) for x in _SIGNS)), (F.col("event_id") % len(_SIGNS)).cast("int"))
    final = F.when(F.col("event_type") == "view", "https://a.example/Login/x").otherwise("https://a.example/logins")
    e = t(spark, sf_dir, "events")
    return e.select("event_id", detection.is_challenge(page).alias("challenge"), detection.spa_failure(page).alias("spa"), detection.is_login(page, final).alias("login"))


@query("""SELECT event_id, event_type <> 'view' AND event_id % 3 > 0 AS valid, event_id % 4 = 0 OR event_id % 3 = 2 AS bad_cookie, event_id % 5 < 2 OR event_id % 5 = 4 AND event_id % 2 = 0 AS debug FROM events""")
def session_signs(spark, sf_dir):
    k = F.col("event_id")
    page = F.get(F.array(F.lit("Please log in"), F.lit("all fine"), F.lit("akamaized.net")), (k % 3).cast("int"))
    final = F.when(F.col("event_type") == "view", "https://a.example/signin/").otherwise("https://a.example/x")
    cookie = F.when(k % 4 == 0, "a=b; _abck=1~-1~x").otherwise("_abck=ok")
    address = F.get(F.array(*map(F.lit, ("http://localhost:9222/json", "ws://me@[::1]:9/x", "http://10.0.0.1/", "ftp://localhost/", "wss://far.example/"))), (k % 5).cast("int"))
    debug = F.when(k % 2 == 0, results.allowed_debug_endpoint(address, True)).otherwise(results.allowed_debug_endpoint(address))
    debug = F.when(k % 5 == 2, results.allowed_debug_endpoint(address)).otherwise(debug)
    return t(spark, sf_dir, "events").select("event_id", results.session_valid(page, final).alias("valid"), results.sensor_cookie_invalid(page, cookie).alias("bad_cookie"), debug.alias("debug"))


@query("""SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE (event_id % 6) * 86400 + CASE event_id % 6 WHEN 2 THEN 3661.5 WHEN 3 THEN -3600 ELSE 0 END END::DOUBLE AS seconds, CASE WHEN event_id % 2 = 0 THEN ['a', event_type] ELSE [] END AS flags FROM events""")
def stored_values(spark, sf_dir):
    k = F.col("event_id")
    times = ("yesterday", "1970-01-02", "1970-01-03T01:01:01.5Z", "1970-01-04 00:00:00+01:00", "1970-01-05T00:00", "1970-01-06T00:00:00")
    given = F.get(F.array(*map(F.lit, times)), (k % 6).cast("int"))
    stored = F.when(k % 2 == 0, results.flags_json(F.array(F.lit(" a"), F.col("event_type"), F.lit(""), F.lit("a")))).otherwise("{}")
    return t(spark, sf_dir, "events").select("event_id", results.iso_seconds(given).alias("seconds"), results.flags_of_json(stored).alias("flags"))


@query("""SELECT user_id, n FROM (SELECT user_id, count(*) AS n, max(ts) AS newest FROM events GROUP BY 1) WHERE user_id NOT IN (SELECT user_id FROM (SELECT user_id, max(ts) AS newest FROM events WHERE event_type = 'view' GROUP BY 1) ORDER BY newest DESC, user_id LIMIT 30)""")
def stale_profiles(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    profiles = e.groupBy(F.col("user_id").alias("domain")).agg(F.count(F.lit(1)).alias("n"))
    newest = e.groupBy(F.col("user_id").alias("domain")).agg(F.max(F.when(F.col("event_type") == "view", F.col("ts"))).alias("last_success_at"))
    return access.stale_profiles(profiles, newest, 30).select(F.col("domain").alias("user_id"), "n")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'raw' WHEN doc_id % 3 = 1 THEN 'blocked' ELSE 'blocked' END AS said FROM documents")
def metadata_preferred(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("raw_id"))
    raw, blocked = d.filter("raw_id % 3 <> 1").withColumn("metadata", F.lit("raw")), d.filter("raw_id % 3 > 0").withColumn("metadata", F.lit("blocked"))
    return archive.prefer_blocked(raw, blocked, True).select(F.col("raw_id").alias("doc_id"), F.col("metadata").alias("said"))


@query("SELECT doc_id, ['.main', '#a b', 'p > i', 'doc' || doc_id] AS selectors FROM documents")
def rule_selectors(spark, sf_dir):
    stored = F.concat(F.lit("#a b,\n , p > i\ndoc"), F.col("doc_id"))
    return t(spark, sf_dir, "documents").select("doc_id", results.rule_selectors(F.array(F.lit(".main")), stored).alias("selectors"))


@query("""SELECT event_id, '## Visible Content Blocks' || chr(10) || '1. first ' || event_id || ' [x=1, y=2, w=3, h=4]' || CASE WHEN event_id % 2 = 0 THEN chr(10) || '3. third' ELSE chr(10) || '[...truncated...]' END AS listed FROM events""")
def visible_blocks(spark, sf_dir):
    k = F.col("event_id")
    rect = F.struct(*(F.lit(n).alias(x) for x, n in zip("xywh", (1, 2, 3, 4), strict=True)))
    block = lambda text, at: F.struct(text.alias("text"), at.alias("rect"))
    third = F.when(k % 2 == 0, "third").otherwise(F.repeat(F.lit("long "), 40))
    blocks = F.array(block(F.concat(F.lit(" first\n "), k), rect), block(F.lit(" "), rect), block(third, F.when(F.lit(False), rect)))
    return t(spark, sf_dir, "events").select("event_id", results.visible_blocks(blocks, 120).alias("listed"))


# --- what is learned of domains --------------------------------------------------------------------------------------------
@query("""WITH RECURSIVE o AS (SELECT user_id, event_type <> 'error' AS ok, event_type = 'error' AND value > 150 AS gone, epoch(ts) AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 w AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS good, CAST(0 AS BIGINT) AS bad, 'closed' AS state, CAST(0 AS DOUBLE) AS opened, CAST(0 AS BIGINT) AS failures, CAST(0 AS DOUBLE) AS far, false AS stale FROM o
  UNION ALL SELECT user_id, k, CASE WHEN ok THEN good + 1 ELSE good END, CASE WHEN ok THEN bad ELSE bad + 1 END, CASE WHEN ok THEN 'closed' WHEN half OR more >= 5 THEN 'open' ELSE state END, CASE WHEN ok THEN 0 WHEN half OR more >= 5 THEN tm ELSE opened END,
   CASE WHEN ok THEN 0 ELSE more END, CASE WHEN ok THEN 0 WHEN gone THEN tm + 86400 ELSE far END, NOT ok AND (good + 1) / (good + bad + 3) < 0.5
  FROM (SELECT w.*EXCLUDE (k), o.k, o.ok, o.tm, o.gone, w.state = 'open' AND o.tm - w.opened > 300 AS half, CASE WHEN w.state = 'open' AND o.tm - w.opened > 300 THEN 1 ELSE w.failures + 1 END AS more FROM w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1))
 SELECT w.user_id, good, bad, state, round(opened, 3) AS opened, failures, round(far, 3) AS far, stale, w.user_id % 3 = 0 AS needs, (good + 1) / (good + bad + 2.0)::DOUBLE AS confidence FROM w JOIN (SELECT user_id, max(k) AS k FROM o GROUP BY 1) m ON m.user_id = w.user_id AND m.k = w.k""")
def domain_rule_table(spark, sf_dir):
    """All events in three slices, one after the other."""
    e = t(spark, sf_dir, "events").select(
        F.col("user_id").alias("domain"), F.col("ts").cast("timestamp").cast("double").alias("at"), F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("ok"), F.lit("plain").alias("gear"),
        F.col("event_type").alias("error"), (F.col("value") > 150).alias("out_of_reach"), F.lit(None).cast("boolean").alias("needs_account"),
    )
    table = spark.createDataFrame([], "domain long, " + ", ".join(f"{k} {kind}" for k, kind in domain_rules.STATE.items()))
    starts = [r["at"] for r in e.agg(F.explode(F.percentile("at", F.array(F.lit(0.0), F.lit(0.3), F.lit(0.7)))).alias("at")).collect()]
    for low, high in zip(starts, [*starts[1:], float("inf")], strict=True):
        table = domain_rules.record(table, e.filter((F.col("at") >= low) & (F.col("at") < high)))
    table = domain_rules.with_confidence(domain_rules.mark_needs_account(table, e.filter("domain % 3 = 0").select("domain")))
    return table.select(
        F.col("domain").alias("user_id"), F.col("success_count").alias("good"), F.col("fail_count").alias("bad"), F.col("circuit_state").alias("state"), F.round("circuit_opened_at", 3).alias("opened"),
        F.col("consecutive_failures").alias("failures"), F.round("unreachable_until", 3).alias("far"), "stale", F.col("needs_account").alias("needs"), "confidence",
    )


# --- networks --------------------------------------------------------------------------------------------------------------
@query("""WITH a AS (SELECT event_id, event_id % 2 = 0 AS four, CASE WHEN event_id % 2 = 0 THEN ((10 + event_id % 3) << 24) + ((event_id * 7 % 256) << 16) + ((event_id * 13 % 256) << 8) + event_id % 256
   ELSE (CAST(x'20010db8' AS BIGINT) << 32) + ((event_id % 64) << 16) + event_id * 11 % 65536 END AS ip FROM events),
 u AS (SELECT DISTINCT user_id AS u FROM events),
 n AS (SELECT 'v' || u AS name, true AS four, ([8, 16, 20, 24, 28, 32])[1 + u % 6] AS bits, 32 AS width, ((10 + u % 3) << 24) + ((u * 7 % 256) << 16) + ((u * 13 % 256) << 8) + u % 256 AS ip FROM u
  UNION ALL SELECT 's' || u, false, ([32, 40, 48, 52, 64])[1 + u % 5], 64, (CAST(x'20010db8' AS BIGINT) << 32) + ((u % 64) << 16) + u * 11 % 65536 FROM u),
 r AS (SELECT name, four, bits, (ip >> (width - bits)) << (width - bits) AS low, ((ip >> (width - bits)) << (width - bits)) + (CAST(1 AS BIGINT) << (width - bits)) - 1 AS high FROM n),
 m AS (SELECT a.event_id, min_by(r.name, (-r.bits, r.name)) AS network FROM a JOIN r ON r.four = a.four AND a.ip BETWEEN r.low AND r.high GROUP BY 1)
 SELECT a.event_id, m.network FROM a LEFT JOIN m ON m.event_id = a.event_id""".replace("CAST(x'20010db8' AS BIGINT)", "CAST(536940984 AS BIGINT)"))
def network_narrowest(spark, sf_dir):
    """Every event's address in two networks a user, of eleven lengths."""

    def spelled(k: F.Column) -> tuple[F.Column, F.Column]:
        dotted = F.concat_ws(".", (10 + k % 3).cast("string"), (k * 7 % 256).cast("string"), (k * 13 % 256).cast("string"), (k % 256).cast("string"))
        return dotted, F.concat(F.lit("2001:DB8:"), F.hex(k % 64), F.lit(":"), F.hex(k * 11 % 65536), F.lit("::"))

    e = t(spark, sf_dir, "events").select("event_id", "user_id")
    four, six = spelled(F.col("event_id"))
    addresses = e.select("event_id", F.when(F.col("event_id") % 2 == 0, four).otherwise(F.concat(six, F.hex(F.col("event_id") % 65536))).alias("address"))
    users, u = e.select("user_id").distinct(), F.col("user_id")
    four, six = spelled(u)
    length = lambda options: F.get(F.array(*map(F.lit, options)), (u % len(options)).cast("int")).cast("string")
    held = users.select(F.concat(F.lit("v"), u).alias("name"), F.concat(four, F.lit("/"), length((8, 16, 20, 24, 28, 32))).alias("cidr")).unionByName(
        users.select(F.concat(F.lit("s"), u).alias("name"), F.concat(six, F.lit("/"), length((32, 40, 48, 52, 64))).alias("cidr"))
    )
    return networks.narrowest(addresses, held).select("event_id", "network")


# --- table functions, from SQL alone ---------------------------------------------------------------------------------------
@query("""SELECT doc_id, CAST(i AS INT) AS chunk_index, CAST(greatest(1, ceil(length(text) / 1000.0)) AS INT) AS total_chunks, substr(text, CAST((i - 1) * 1000 + 1 AS BIGINT), 1000) AS body
 FROM (SELECT doc_id, text, unnest(generate_series(1, CAST(greatest(1, ceil(length(text) / 1000.0)) AS BIGINT))) AS i FROM documents WHERE text IS NOT NULL)""")
def table_chunks(spark, sf_dir):
    tables.register(spark)
    return spark.sql("SELECT d.doc_id, c.chunk_index, c.total_chunks, c.body FROM {docs} d, LATERAL text_chunks(d.text, 1000) c", docs=t(spark, sf_dir, "documents"))


@query(f"WITH {ANCHORS} SELECT page_id, CAST(pos AS INT) AS pos, href, label FROM a")
def table_anchors(spark, sf_dir):
    tables.register(spark)
    return spark.sql("SELECT p.page_id, a.pos, a.href, a.label FROM {pages} p, LATERAL page_anchor_rows(p.html) a", pages=t(spark, sf_dir, "pages"))


@query("""SELECT doc_id, CAST(k AS INT) AS pos, CASE k WHEN 1 THEN source ELSE 'part ' || doc_id END AS label, CASE k WHEN 1 THEN '/s/' || source ELSE 'https://example.com/' || doc_id END AS ref
 FROM documents, (SELECT unnest([1, 2]) AS k) WHERE source IS NOT NULL AND (k = 1 OR doc_id % 3 <> 0)""")
def table_citations(spark, sf_dir):
    tables.register(spark)
    said = """concat('# ', source, ' ![', source, '](/i.png) [ ', source, '](/s/', source, ') and [top](#top) ', IF(doc_id % 3 = 0, '[call](tel:1)', concat('[part ', doc_id, '](https://example.com/', doc_id, ' "title")')))"""
    return spark.sql(f"SELECT d.doc_id, c.pos, c.label, c.ref FROM {{docs}} d, LATERAL markdown_citations({said}, 5) c WHERE d.source IS NOT NULL", docs=t(spark, sf_dir, "documents"))


# --- archive folders -------------------------------------------------------------------------------------------------------
def _archived(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the archive of all pages, every seventh of them blocked."""
    p = t(spark, sf_dir, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    text = archive.document_text({"url": F.col("url"), "page": F.col("page_id")}, F.col("html"))
    folder = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    archive_source.write(p.select(F.concat(F.lit("p/"), F.col("page_id")).alias("raw_id"), (F.col("page_id") % 7 == 0).alias("blocked"), text.alias("text")), folder)
    return folder


@query("SELECT page_id, page_id % 7 = 0 AS blocked, coalesce(url, '') AS url, regexp_replace(coalesce(html, ''), '^\\n+', '') || chr(10) AS body FROM pages")
def archive_source_texts(spark, sf_dir):
    """All pages through the archive's data source and back."""
    rows = archive_source.read(spark, _archived(spark, sf_dir))
    return rows.select(archive.frontmatter(F.col("text"))["page"].cast("long").alias("page_id"), "blocked", archive.frontmatter(F.col("text"))["url"].alias("url"), archive.strip_frontmatter(F.col("text")).alias("body"))


@query("SELECT page_id, coalesce(url, '') AS url, page_id % 7 = 0 AS blocked FROM pages WHERE page_id IN (SELECT event_id * 3 FROM events)")
def archive_source_keys(spark, sf_dir):
    """Heads of the documents that events ask for, opened by their ids."""
    wanted = t(spark, sf_dir, "events").select(F.concat(F.lit("p/"), F.col("event_id") * 3).alias("raw_id"))
    rows = archive_source.read_keys(wanted, _archived(spark, sf_dir), "head")
    return rows.select(F.substring("raw_id", 3, 20).cast("long").alias("page_id"), archive.frontmatter(F.col("text"))["url"].alias("url"), "blocked")


@query("SELECT page_id, page_id % 2 = 0 AS again, coalesce(url, '') || CASE WHEN page_id % 2 = 0 THEN '!' ELSE '' END AS url FROM pages UNION ALL SELECT page_id, false, coalesce(url, '') FROM pages WHERE page_id % 2 = 0")
def stream_archive(spark, sf_dir):
    """The archive as a stream that ends and goes on: each commit's documents once, those written again a second time."""
    p = t(spark, sf_dir, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def add(rows: DataFrame) -> None:
        archive_source.write(rows.select(F.col("page_id").cast("string").alias("raw_id"), F.lit(False).alias("blocked"), archive.document_text({"url": F.col("url")}, F.lit("")).alias("text")), f"{base}/archive")
        heads = archive_source.read_stream(spark, f"{base}/archive", "head").select("raw_id", archive.frontmatter(F.col("text"))["url"].alias("url"))
        audit.append_sink(heads, f"{base}/rows", f"{base}/checkpoint", "append").awaitTermination()

    add(p)
    add(p.filter("page_id % 2 = 0").withColumn("url", F.concat("url", F.lit("!"))))
    for done in ("archive", "checkpoint"):
        remove_folder(spark, f"{base}/{done}")
    return spark.read.parquet(f"{base}/rows").select(F.col("raw_id").cast("long").alias("page_id"), F.col("url").endswith("!").alias("again"), "url")


# --- keyed stores ----------------------------------------------------------------------------------------------------------
#: A user's events in ten slices; a slice whose last event is an error removes the user, others add to what is known.
_SLICED = """o AS (SELECT user_id, CAST(event_id % 10 AS INT) AS slice, count(*) AS n, max(event_id) AS last_id, max_by(event_type, event_id) = 'error' AS gone FROM events GROUP BY ALL),
 g AS (SELECT user_id, max(slice) AS slice FROM o WHERE gone GROUP BY 1),
 k AS (SELECT o.user_id, CAST(sum(o.n) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS n_slices, max(o.last_id) AS last_id FROM o LEFT JOIN g ON g.user_id = o.user_id WHERE g.slice IS NULL OR o.slice > g.slice GROUP BY 1)"""


def _stored(spark: SparkSession, sf_dir: str) -> keyed_store.KeyedStore:
    """A store of users after ten slices of events, made one generation after the fifth."""
    e = t(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    sliced = e.groupBy("user_id", (F.col("event_id") % 10).alias("slice")).agg(
        F.count(F.lit(1)).alias("n"), F.lit(1).cast("long").alias("n_slices"), F.max("event_id").alias("last_id"), F.max_by("event_type", "event_id").alias("last_type"),
    )
    slices = cut(sliced)
    add = lambda known, old, new: F.when(known, old + new).otherwise(new)
    last = lambda known, old, new: F.greatest(old, new)
    path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    store = keyed_store.KeyedStore.create(slices.select("user_id", "n", "n_slices", "last_id").limit(0), path, ["user_id"], 16)
    for k in range(10):
        store.apply(slices.filter(F.col("slice") == k), {"n": add, "n_slices": add, "last_id": last}, F.col("last_type") == "error")
        if k == 4:
            store.compact()
    return store


@query(f"WITH {_SLICED} SELECT user_id, n, n_slices, last_id FROM k")
def keyed_store_slices(spark, sf_dir):
    """What a store holds after ten slices of changes, half of them compacted."""
    return _stored(spark, sf_dir).read()


@query(f"WITH {_SLICED} SELECT user_id, n, last_id FROM k WHERE user_id IN (SELECT doc_id * 3 FROM documents)")
def keyed_store_lookup(spark, sf_dir):
    """Rows of the users that another table asks for."""
    return _stored(spark, sf_dir).lookup(t(spark, sf_dir, "documents").select((F.col("doc_id") * 3).alias("user_id"))).select("user_id", "n", "last_id")


# --- sitemaps and feeds in files -------------------------------------------------------------------------------------------
#: Fixed value: most entries of one sitemap.
SITEMAP_ENTRIES = 50_000


def _listed_files(spark: SparkSession, sf_dir: str, head: str, tail: str, entry) -> str:
    """A folder of files domain=<d>/part=<n> that list each domain's pages, so many that none has too many entries."""
    p = pages(spark, sf_dir).select("domain", F.replace(F.regexp_replace("url", "#.*", ""), F.lit("&"), F.lit("&amp;")).alias("u")).filter("domain <> ''")
    sizes = p.groupBy("domain").agg(F.ceil(2 * F.count(F.lit(1)) / SITEMAP_ENTRIES).cast("int").alias("n"))  # a hash fills no part to twice its share
    placed = p.join(sizes, "domain").select("domain", F.pmod(F.xxhash64("u"), "n").alias("part"), F.lit(1).alias("line"), entry(F.col("u")).alias("value"))
    parts = placed.select("domain", "part").distinct()
    ends = parts.select("domain", "part", F.explode(F.array(F.struct(F.lit(0).alias("line"), F.lit(head).alias("value")), F.struct(F.lit(2).alias("line"), F.lit(tail).alias("value")))).alias("e"))
    rows = placed.unionByName(ends.select("domain", "part", "e.*"))
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    rows.repartition("domain", "part").sortWithinPartitions("domain", "part", "line", "value").select("domain", "part", "value").write.partitionBy("domain", "part").text(folder)
    return folder


def _home(file: Column) -> Column:
    return F.concat(F.lit("https://"), F.regexp_extract(file, "/domain=([^/]+)/", 1), F.lit("/"))


@query(f"WITH {URLS} SELECT DISTINCT domain, 'urlset' AS kind, canonical AS url FROM c WHERE domain <> ''")
def sitemap_records(spark, sf_dir):
    """Sitemaps of all pages, read from files entry by entry."""
    folder = _listed_files(spark, sf_dir, "<?xml version='1.0'?><urlset>", "</urlset>", lambda u: F.concat(F.lit("<url><loc>"), u, F.lit("</loc><priority>0.5</priority></url>")))
    return site_index.sitemap_records(spark, folder, _home).select(urls.domain_of(F.col("doc_url")).alias("domain"), "kind", "url").distinct()


@query(f"WITH {URLS} SELECT DISTINCT domain, 'rss' AS kind, canonical AS url FROM c WHERE domain <> ''")
def feed_records(spark, sf_dir):
    """Feeds of all pages, read from files item by item."""
    folder = _listed_files(spark, sf_dir, "<rss><channel><link>https://home.example/</link>", "</channel></rss>", lambda u: F.concat(F.lit("<item><title>x</title><link>"), u, F.lit("</link></item>")))
    return site_index.feed_records(spark, folder, _home).select(urls.domain_of(F.col("doc_url")).alias("domain"), "kind", "url").distinct()


# --- readiness with its policy, cookies, mapped sites, word lists, nodes -----------------------------------------------------
@query(f"""WITH {URLS}, d AS (SELECT domain, length(domain) % 4 AS k, length(domain) % 3 = 0 AS std, min(canonical) AS url FROM c GROUP BY 1),
 o AS (SELECT *, CASE WHEN k = 2 THEN 'mark_account_profile_or_register_account_profile' WHEN std AND k <> 3 OR k = 1 THEN 'retrieve_page' ELSE 'open_browser_session' END AS tool, ends_with(domain, '.org') AS shut FROM d),
 l AS (SELECT *, tool = 'open_browser_session' OR tool = 'retrieve_page' AND NOT std AS live FROM o)
 SELECT domain, tool, url, CASE WHEN k = 2 THEN NULL WHEN tool = 'retrieve_page' AND std THEN '' WHEN k = 1 THEN 'main' ELSE 'default' END AS account_id, NOT shut AND NOT live AS policy_allowed,
 concat_ws(',', CASE WHEN shut THEN 'blocked_domain' END, CASE WHEN live THEN 'live_browser_disabled' END, CASE WHEN NOT shut AND NOT live THEN 'allowed_by_policy' END) AS policy_reasons,
 concat_ws(',', CASE WHEN k = 2 THEN 'default_account_blocked' END, CASE WHEN shut OR live THEN 'policy_denied' END) AS issues, tool = 'open_browser_session' AS approval_required FROM l""")
def readiness_policy(spark, sf_dir):
    """What to call for each site, and whether an installation without live browsers and without .org lets it."""
    d = pages(spark, sf_dir).groupBy("domain").agg(F.min("canonical").alias("url")).withColumn("k", F.length("domain") % 4)
    sites = d.filter("k > 0").select("domain", (F.col("k") == 3).alias("needs_account"), F.lit(False).alias("human_assist"), F.array(F.lit("page")).alias("modes"))
    profiles = d.filter("k IN (1, 2)").select("domain", F.when(F.col("k") == 1, "main").otherwise("default").alias("account_id"), F.when(F.col("k") == 1, "active").otherwise("blocked").alias("status"), F.lit(None).cast("string").alias("expires_at"), F.lit(True).alias("is_default"))
    targets = d.select("domain", "url", F.lit("").alias("account_id"), F.when(F.length("domain") % 3 == 0, "standard").otherwise("user_authorized").alias("access_mode"))
    ready = access.readiness(targets, sites, profiles, profiles.select("domain", "account_id"), F.current_timestamp())
    made = access.decided(ready, rules.Policy(blocked_domains=("*.org",), live_browser=False))
    return made.select("domain", "tool", "next_call.url", "next_call.account_id", "policy_allowed", F.array_join("policy_reasons", ",").alias("policy_reasons"), F.array_join("issues", ",").alias("issues"), "approval_required")


@query("""WITH k AS (SELECT event_id, event_id % 3 > 0 AS fresh, event_id % 4 AS got, CASE event_id % 3 WHEN 0 THEN '100' WHEN 1 THEN '1000000' ELSE '-1' END AS ends FROM events),
 p AS (SELECT *, '{"name":"a","value":"' || event_id || '","domain":"d.example","path":"/","expires":' || ends || '}' AS a, '{"name":"b","value":"' || event_id || '","domain":"o.example","path":"/","secure":true}' AS b,
   '{"name":"a","value":"n","domain":"d.example","path":"/"}' AS n, '{"name":"z","value":"q","domain":"d.example","path":"/"}' AS z FROM k)
 SELECT event_id, '[' || concat_ws(',', CASE WHEN fresh AND got = 0 THEN n WHEN fresh THEN a END, b, CASE WHEN NOT fresh AND got = 0 THEN n END, CASE WHEN got = 1 THEN z END) || ']' AS jar, 1 + fresh::INT + CASE WHEN got = 1 OR got = 0 AND NOT fresh THEN 1 ELSE 0 END AS n FROM p""")
def cookie_jars(spark, sf_dir):
    """Stored jars of events, moved on by new ones of several shapes, and stored again."""
    number = F.col("event_id").cast("string")
    ends = F.when(F.col("event_id") % 3 == 0, "100").when(F.col("event_id") % 3 == 1, "1000000").otherwise("-1")
    old = F.concat(F.lit('[{"name":"a","value":"'), number, F.lit('","expires":'), ends, F.lit('},{"name":"b","value":'), number, F.lit(',"domain":"o.example","secure":true},7,{"name":"","value":"y"},{"name":"c"}]'))
    new = F.get(F.array(*map(F.lit, ('[{"name":"a","value":"n","path":""}]', '{"z":"q","k":5}', "{", "[]"))), (F.col("event_id") % 4).cast("int"))
    home = F.lit("d.example")
    jar = cookies.merged_cookies(cookies.cookies_of_json(old, home), cookies.cookies_of_json(new, home), F.lit(5000.0))
    return t(spark, sf_dir, "events").select("event_id", jar.alias("j")).select("event_id", cookies.cookies_json(F.col("j")).alias("jar"), F.size("j").alias("n"))


@query(f"""WITH {URLS} SELECT page_id, page_id % 3 > 0 AS ok, CASE page_id % 3 WHEN 0 THEN '' ELSE 'map ' || page_id END AS text, canonical AS canonical_url, CASE WHEN page_id % 3 = 1 THEN 'https://final.example/' || page_id ELSE canonical END AS url,
 CASE page_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 7 END AS link_count, CASE page_id % 3 WHEN 1 THEN url ELSE '' END AS links, CASE WHEN page_id % 3 = 0 THEN CASE WHEN page_id % 2 = 0 THEN 'timeout' ELSE 'internal-error' END END AS kind, CASE WHEN page_id % 3 = 0 THEN CASE WHEN page_id % 2 = 0 THEN 'slow' ELSE 'torn ' || page_id END END AS message FROM c""")
def site_map_payload(spark, sf_dir):
    """Typed results of mapped sites: with and without the tag, with stored links or a count alone, and failures of two kinds."""
    k = F.col("page_id") % 3
    name = F.concat(F.lit("map "), F.col("page_id"))
    text = F.when(k == 1, F.concat(F.lit(results.OK), name)).when(k == 2, name).otherwise(F.concat(F.lit("torn "), F.col("page_id")))
    error = F.when(F.col("page_id") % 2 == 0, results.format_error(F.lit("timeout"), F.lit("slow"))).otherwise("")
    p = results.map_payload(F.col("url"), text, k > 0, F.when(k == 1, F.concat(F.lit("https://final.example/"), F.col("page_id"))), F.when(k == 1, F.array("url")), F.when(k == 2, 7), error)
    got = t(spark, sf_dir, "pages").select("page_id", p.alias("p"))
    return got.select("page_id", "p.ok", "p.text", "p.canonical_url", "p.url", "p.link_count", F.array_join("p.links", ",").alias("links"), F.col("p.error.errorType").alias("kind"), F.col("p.error.message").alias("message"))


@query("SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'USER' ELSE 'CUSTOM' END AS category, CASE WHEN user_id % 2 = 0 THEN 'u' || user_id || ':x' ELSE 'low:' || user_id END AS word FROM events")
def word_list(spark, sf_dir):
    """A word list in files, with categories, plain words that hold a colon, blank lines and remarks."""
    u = t(spark, sf_dir, "events").select("user_id").distinct()
    line = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("  USER:u"), F.col("user_id"), F.lit(":x "))).otherwise(F.concat(F.lit("low:"), F.col("user_id")))
    folder = f"{shared_folder(spark)}/words-{uuid.uuid4().hex}"
    u.select(F.explode(F.array(line, F.lit("   "), F.concat(F.lit("# USER:"), F.col("user_id")))).alias("value")).write.text(folder)
    return archive.load_words(spark, folder)


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 2 END + CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS node_count, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 2 END + CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END >= 3 AS truncated,
 concat_ws('|', CASE WHEN event_id % 4 > 0 THEN 'link/' || left(repeat(event_type, 50), 240) || '/-' END, CASE WHEN event_id % 4 > 0 THEN '/' || event_id || '/d' END, CASE WHEN event_id % 5 > 0 THEN 'button//-' END) AS nodes FROM events""")
def page_nodes(spark, sf_dir):
    """Nodes of pages for reading aloud: those without role and name or ignored go, long names are cut, at most three stay (the feature)."""
    number = F.col("event_id")
    node = lambda ignored, role, name, description: F.struct(ignored.alias("ignored"), F.lit(role).alias("role"), name.alias("name"), F.lit(description).alias("description"))
    own = F.array(
        node(number % 4 == 0, "link", F.repeat("event_type", 50), " "), node(F.lit(None).cast("boolean"), " ", F.lit(""), "x"), node(number % 4 == 0, None, F.concat(F.lit(" "), number.cast("string")), " d "), node(number % 5 == 0, "button", F.lit(None).cast("string"), None),
    )
    r = t(spark, sf_dir, "events").select("event_id", results.fit_nodes(own, 3).alias("r"))
    shown = F.transform("r.nodes", lambda n: F.concat_ws("/", n["role"], n["name"], F.coalesce(n["description"], F.lit("-"))))
    return r.select("event_id", "r.node_count", "r.truncated", F.array_join(shown, "|").alias("nodes"))
