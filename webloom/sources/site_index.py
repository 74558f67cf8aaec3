"""Sitemaps, robots files and feeds as DataFrame expressions over stored documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls


def index_kind(xml: Column) -> Column:
    root = F.lower(F.regexp_extract(xml, r"(?is)^\s*(?:<\?.*?\?>|<!--.*?-->|<![^>]*>|\s)*<(?:\w+:)?(\w+)", 1))
    return F.when(root.isin("sitemapindex", "urlset"), root).when(root.isin("rss", "rdf"), "rss").when(root == "feed", "atom").otherwise("unknown")


RSS_LINK = r"(?is)<link\s*>(.*?)</link\s*>"
ATOM_LINK = r"""(?is)<link\b[^>]*\bhref\s*=\s*["']([^"']*)["']"""


def _plain(x: Column) -> Column:
    """An entry's text without CDATA marks."""
    return F.trim(F.replace(F.regexp_replace(x, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1"), F.lit("&amp;"), F.lit("&")))


def index_urls(xml: Column) -> Column:
    """Raw URLs in document order, by kind; malformed documents give what can be read."""
    loc = F.regexp_extract_all(xml, F.lit(r"(?is)<(?:\w+:)?loc\s*>(.*?)</(?:\w+:)?loc\s*>"), F.lit(1))
    items = F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<item\b.*?</item>"), F.lit(0)), lambda x: F.regexp_extract(x, RSS_LINK, 1))
    entries = F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<entry\b.*?</entry>"), F.lit(0)), lambda x: F.regexp_extract(x, ATOM_LINK, 1))
    kind = index_kind(xml)
    found = F.when(kind.isin("sitemapindex", "urlset"), loc).when(kind == "rss", items).when(kind == "atom", entries).otherwise(F.array().cast("array<string>"))
    return F.filter(F.transform(found, _plain), lambda x: x != "")


def _listed(rows: DataFrame, scope) -> DataFrame:
    """(doc_url, kind, pos, url) of rows (doc_url, base_url, kind, pos, raw): canonical, joined to the base URL, first of each."""
    url = urls.canonical_url(urls.join_url(F.col("base_url"), F.col("raw")))
    rows = rows.select("doc_url", "kind", "pos", (scope(url) if scope else url).alias("url")).filter("url <> ''")
    return rows.groupBy("doc_url", "kind", "url").agg(F.min("pos").alias("pos"))


def parse_index(documents: DataFrame, scope=None) -> DataFrame:
    """(doc_url, kind, pos, url): canonical, joined to the base URL, first of each; `scope` maps a URL column to '' outside."""
    return _listed(documents.select("doc_url", "base_url", index_kind(F.col("body")).alias("kind"), F.posexplode(index_urls(F.col("body"))).alias("pos", "raw")), scope)


def _records(spark: SparkSession, path: str | Sequence[str], separator: str) -> DataFrame:
    """(file, pos, record): texts of files cut at a separator by the scan itself, so a file of any size is read in splits and no row holds it whole.

    pos = (start of the split, number within it) orders the records of a file.
    """
    rows = spark.read.option("lineSep", separator).text(path if isinstance(path, str) else list(path))
    pos = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    return rows.select(F.col("_metadata.file_path").alias("file"), pos.alias("pos"), F.regexp_replace("value", "^\ufeff", "").alias("record"))


def sitemap_records(spark: SparkSession, path: str | Sequence[str], doc_url, base_url=None, scope=None) -> DataFrame:
    """parse_index for sitemaps and sitemap indexes in files (UTF-8, .gz as well), one record an entry; pos is a struct.

    `doc_url` and `base_url` (None: doc_url) map the column of a file's path to URLs. Records end at closing tags, whatever their prefixes. A file with another root
    gives nothing, nor does an entry that the file's end cuts off. A CDATA section may not hold a closing tag.
    """
    rows = _records(spark, path, "</")
    files = rows.groupBy("file").agg(F.min_by(index_kind(F.col("record")), "pos").alias("kind"), F.max("pos").alias("last")).filter("kind IN ('sitemapindex', 'urlset')")
    loc = r"(?is)<(?:\w+:)?loc\s*>(.*)$"
    named = rows.filter(F.col("record").rlike(loc)).join(files, "file").filter("pos < last")
    file = F.col("file")
    return _listed(named.select(doc_url(file).alias("doc_url"), (base_url or doc_url)(file).alias("base_url"), "kind", "pos", _plain(F.regexp_extract("record", loc, 1)).alias("raw")).filter("raw <> ''"), scope)


def feed_records(spark: SparkSession, path: str | Sequence[str], doc_url, base_url=None, scope=None, kind: str = "rss") -> DataFrame:
    """parse_index for feeds of one kind (rss, atom) in files, one record an item; see sitemap_records."""
    if kind not in ("rss", "atom"):
        raise ValueError(f"kind is rss or atom, not {kind}")
    tag, link = ("item", RSS_LINK) if kind == "rss" else ("entry", ATOM_LINK)
    rows = _records(spark, path, f"</{tag}>")
    files = rows.groupBy("file").agg(F.min_by(index_kind(F.col("record")), "pos").alias("kind"), F.max("pos").alias("last")).filter(F.col("kind") == kind)
    item = F.regexp_extract("record", rf"(?is)<{tag}\b.*$", 0)
    named = rows.join(files, "file").filter("pos < last")
    file = F.col("file")
    return _listed(named.select(doc_url(file).alias("doc_url"), (base_url or doc_url)(file).alias("base_url"), "kind", "pos", _plain(F.regexp_extract(item, link, 1)).alias("raw")).filter("raw <> ''"), scope)


def _candidates(found: Column, base: Column, same_domain_only: bool, limit: int) -> Column:
    """URLs joined to the base and canonical, http(s) and of the base's domain only, the first of each, at most `limit` (the feature)."""
    full = F.transform(F.filter(found, lambda x: F.trim(x) != ""), lambda x: urls.canonical_url(urls.join_url(base, F.trim(x))))
    kept = F.filter(full, lambda x: x.rlike("^https?://[^/]"))
    if same_domain_only:
        home = urls.domain_of(urls.canonical_url(base))
        kept = F.filter(kept, lambda x: urls.domain_of(x) == home)
    return F.slice(F.array_distinct(kept), 1, limit)


def robots_sitemaps(text: Column, base: Column, same_domain_only: bool = True, limit: int = 20) -> Column:
    """Sitemaps that a robots file names."""
    named = F.transform(F.split(text, "\r\n?|\n"), lambda x: F.regexp_extract(x, r"(?i)^\s*sitemap\s*:\s*(.*?)\s*$", 1))
    return _candidates(named, base, same_domain_only, limit)


#: Types of feeds.
FEED_TYPES = ("application/rss+xml", "application/atom+xml", "application/rdf+xml", "application/feed+json", "text/xml", "application/xml")


def feed_links(html: Column, base: Column, same_domain_only: bool = True, limit: int = 20) -> Column:
    """Feeds that a page names: link elements that are alternates or of a feed's type, and of no other type."""

    def attribute(tag: Column, name: str) -> Column:
        value = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
        plain = F.regexp_replace(value, "^[\"']|[\"']$", "")
        for mark, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            plain = F.replace(plain, F.lit(mark), F.lit(character))
        return plain

    def names_feed(tag: Column) -> Column:
        kind = F.lower(attribute(tag, "type"))
        alternate = F.array_contains(F.split(F.lower(attribute(tag, "rel")), r"\s+"), "alternate")
        return ((kind == "") & alternate) | kind.isin(*FEED_TYPES)

    shown = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", "")
    tags = F.filter(F.regexp_extract_all(shown, F.lit(r"""(?is)<link\b(?:[^>"']|"[^"]*"|'[^']*')*>"""), F.lit(0)), names_feed)
    return _candidates(F.transform(tags, lambda x: attribute(x, "href")), base, same_domain_only, limit)


#: Agents of crawlers that collect training data.
AI_AGENTS = ("GPTBot", "ClaudeBot", "Claude-Web", "CCBot", "PerplexityBot", "Google-Extended", "Bytespider", "FacebookBot")


def robots_rules(documents: DataFrame) -> DataFrame:
    """(origin, section, agents, n, allow, path) rows of robots files (origin, body), in file order.

    A section begins with agent lines after rules or after an empty line, which also ends it; without rules it counts for
    nothing. Of the sections for `*` the first counts. A rule without a path allows everything.
    """
    line = F.posexplode(F.split("body", "\r\n?|\n")).alias("n", "line")
    rows = documents.select("origin", line).withColumn("line", F.trim(F.regexp_replace("line", "#.*$", "")))
    key, value = F.lower(F.trim(F.substring_index("line", ":", 1))), F.trim(F.regexp_replace("line", "^[^:]*:", ""))
    rows = rows.select("origin", "n", F.when(F.col("line") == "", "").when(F.col("line").contains(":"), key).alias("key"), value.alias("value"))
    rows = rows.filter(F.col("key").isin("", "user-agent", "allow", "disallow"))
    w = Window.partitionBy("origin").orderBy("n")
    # agents after anything else begin a section; an empty line ends the one before it
    starts = (F.col("key") == "user-agent") & F.coalesce(F.lag("key").over(w) != "user-agent", F.lit(True))
    rows = rows.withColumn("section", F.sum(starts.cast("int")).over(w)).withColumn("part", F.sum((F.col("key") == "").cast("int")).over(w))
    named = rows.filter("key = 'user-agent'").groupBy("origin", "section", "part").agg(F.collect_list(F.lower("value")).alias("agents"))
    rules = rows.filter("key IN ('allow', 'disallow')").select("origin", "section", "part", "n", "value", (F.col("key") == "allow").alias("said"))
    both = named.join(rules, ["origin", "section", "part"])
    return both.select("origin", "section", "agents", "n", (F.col("said") | (F.col("value") == "")).alias("allow"), F.col("value").alias("path"))


def robots_said(requests: DataFrame, rules: DataFrame, agents: Sequence[str]) -> DataFrame:
    """requests (url) for each agent, with `agent` and `allowed`: the first rule whose path begins the URL's, of the first section that names the agent, else of the first for `*`.

    An agent is named by any part of its product name; without a section or a rule all is allowed.
    """
    every = F.explode(F.array(*map(F.lit, agents))).alias("agent")
    product = F.lower(F.substring_index("agent", "/", 1))
    own = F.exists("agents", lambda a: (a != "*") & (a != "") & product.contains(a))
    kind = F.when(F.array_contains("agents", "*"), 1).when(own, 0)
    kinds = rules.select("origin", "section", "agents", every).select("origin", "agent", "section", kind.alias("kind")).filter("kind IS NOT NULL")
    chosen = kinds.groupBy("origin", "agent").agg(F.min(F.struct("kind", "section")).alias("k")).select("origin", "agent", F.col("k.section").alias("section"))
    used = rules.join(chosen.select("origin", "section").distinct(), ["origin", "section"])
    # a rule is asked for by the start of a URL of its own length, so a URL makes a row for each length that its origin's rules have
    start = F.when(F.col("path") == "*", "").otherwise(F.col("path"))
    keyed = used.groupBy("origin", "section", start.alias("start")).agg(F.min(F.struct("n", "allow")).alias("rule"))
    lengths = keyed.groupBy("origin").agg(F.array_sort(F.collect_set(F.char_length("start"))).alias("lengths"))
    path = F.regexp_replace(F.col("url"), "^[^:/?#]+://[^/?#]*|#.*$", "")
    r = requests.select("url").distinct().select("url", F.lower(urls.origin_of(F.col("url"))).alias("origin"), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)).alias("asked"))
    starts = r.join(lengths, "origin").select("url", "origin", "asked", F.explode(F.filter("lengths", lambda n: n <= F.char_length("asked"))).alias("n"))
    starts = starts.select("url", "origin", F.substring(F.col("asked"), F.lit(1), F.col("n")).alias("start"))
    first = starts.join(keyed, ["origin", "start"]).groupBy("url", "section").agg(F.min("rule").alias("rule")).select("url", "section", F.col("rule.allow").alias("_allow"))
    asked = requests.select("*", every).withColumn("_origin", F.lower(urls.origin_of(F.col("url"))))
    named = chosen.select(F.col("origin").alias("_origin"), "agent", F.col("section").alias("_section"))
    judged = asked.join(named, ["_origin", "agent"], "left").join(first.withColumnRenamed("section", "_section"), ["url", "_section"], "left")
    return judged.select(*requests.columns, "agent", F.coalesce("_allow", F.lit(True)).alias("allowed"))


def robots_allowed(requests: DataFrame, rules: DataFrame, agent: str = "*") -> DataFrame:
    """requests (url) with `allowed` for one agent; see robots_said."""
    return robots_said(requests, rules, [agent]).drop("agent")


def robots_status_allowed(requests: DataFrame, captured: DataFrame, agent: str = "*", fail_closed: bool = True) -> DataFrame:
    """As robots_allowed over captured robots files (origin, status, body): 4xx but 429 means no rules, any other failure the setting."""
    got = captured.filter("status = 200").select("origin", "body")
    failed = captured.filter("status <> 200 AND (status NOT BETWEEN 400 AND 499 OR status = 429)").select("origin", F.lit(True).alias("_failed")).distinct()
    judged = robots_allowed(requests, robots_rules(got), agent).withColumn("origin", F.lower(urls.origin_of(F.col("url"))))
    return judged.join(failed, "origin", "left").withColumn("allowed", F.when(F.col("_failed"), not fail_closed).otherwise(F.col("allowed"))).drop("_failed", "origin")


def ai_agents_disallowed(rules: DataFrame) -> DataFrame:
    """(origin, disallowed): the root is closed to one of AI_AGENTS."""
    roots = rules.select(F.concat("origin", F.lit("/")).alias("url")).distinct()
    closed = robots_said(roots, rules, AI_AGENTS).groupBy("url").agg(F.bool_or(~F.col("allowed")).alias("disallowed"))
    return closed.select(urls.origin_of(F.col("url")).alias("origin"), "disallowed")


def discover(starts: DataFrame, captured: DataFrame, scope=None, same_domain: bool = True, sitemaps: int = 20, children: int = 10, feeds: int = 20) -> DataFrame:
    """(start_url, url): pages that the captured robots file, sitemaps, child sitemaps and feeds of each start list.

    captured: (url, body), one row per URL. The counts bound what is read per start (the feature); `scope` maps a page's URL to '' outside.
    """
    docs = captured.select(urls.canonical_url(F.col("url")).alias("doc_url"), F.coalesce("body", F.lit("")).alias("body"))
    s = starts.select("start_url", urls.origin_of(F.col("start_url")).alias("_origin")).distinct()

    def first(rows: DataFrame, most: int) -> DataFrame:
        w = Window.partitionBy("start_url").orderBy("pos", "doc_url")
        return rows.groupBy("start_url", "doc_url").agg(F.min("pos").alias("pos")).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n", "pos")

    def named(listed: Column) -> Column:
        return F.posexplode(F.transform(listed, lambda x: urls.canonical_url(urls.join_url(F.concat("_origin", F.lit("/")), x)))).alias("pos", "doc_url")

    def read(queue: DataFrame) -> DataFrame:
        wanted = docs.join(queue.select("doc_url").distinct(), "doc_url", "left_semi").withColumn("base_url", F.col("doc_url"))
        rows = queue.join(parse_index(wanted), "doc_url")
        return rows.filter(urls.domain_of(F.col("url")) == urls.domain_of(F.col("start_url"))) if same_domain else rows

    robots = s.join(docs, F.concat("_origin", F.lit("/robots.txt")) == F.col("doc_url"), "left")
    known = F.array(F.lit("/sitemap.xml"), F.lit("/sitemap_index.xml"))
    listed = robots_sitemaps(F.coalesce("body", F.lit("")), F.concat("_origin", F.lit("/")), same_domain, sitemaps)
    queue = first(robots.select("start_url", named(F.concat(listed, known))), sitemaps)
    top = read(queue)
    below = top.filter("kind = 'sitemapindex'").select("start_url", F.col("url").alias("doc_url"), "pos").join(queue, ["start_url", "doc_url"], "left_anti")
    home = s.join(docs, urls.canonical_url(F.col("start_url")) == F.col("doc_url")).select("start_url", named(feed_links(F.col("body"), F.col("start_url"), same_domain, feeds)))
    found = top.unionByName(read(first(below, children))).unionByName(read(first(home, feeds))).filter("kind <> 'sitemapindex'")
    return found.select("start_url", (scope(F.col("url")) if scope else F.col("url")).alias("url")).filter("url <> ''").distinct()
