"""Tagged results and structured errors, facts about responses, schema.org JSON-LD, links of markdown."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls
from .detection import LOGIN_PATHS
from .expressions import let

#: Tags that begin a result; choose others by passing them.
OK, ERROR = "__OK__:", "__ERROR__:"
#: Errors that may pass by themselves.
RETRYABLE = ("timeout", "rate-limit", "session-expired", "domain-unreachable", "job-timeout")
#: What to do about each kind of error.
GUIDANCE = {
    "timeout": "retry with a higher timeout or a narrower request",
    "rate-limit": "wait before retrying and reduce concurrency for this domain",
    "session-expired": "refresh the account login or storage state, then retry",
    "domain-unreachable": "retry after the unreachable TTL or inspect the domain rule",
    "job-timeout": "check job status/results, then wait again if it is still running",
    "blocked-bot": "inspect artifact_id if present, then try proxy, account state, or HITL",
    "blocked-robots": "respect robots.txt; for single-page user-authorized browser retrieval, use retrieve_page(access_mode='user_authorized')",
    "empty-content": "inspect artifact_id if present; retry with bypass_l3 only for false positives",
    "blocked-ssrf": "abort unless local/internal crawling is explicitly enabled",
    "blocked-ssrf-redirect": "abort; the redirect target is blocked by SSRF protection",
    "blocked-scope": "narrow the crawl policy or start from a URL inside the allowed scope",
    "cache-miss": "fetch with cache_mode='enabled' or 'write_only' to populate cache",
    "chunk-not-found": "request a chunk_index within the available range",
    "all-fetchers-failed": "inspect artifact_id if present, then try proxy, account state, or HITL",
    "artifact-not-found": "call list_artifacts and use a current artifact_id",
    "dns-error": "check the domain or retry later if DNS is transient",
    "human-window-unavailable": "run with a visible browser session and a vault key, or preconfigure account state",
    "internal-error": "check get_engine_status and server logs",
    "invalid-artifact": "use an artifact_id from list_artifacts",
    "invalid-mode": "use one of the documented modes",
    "invalid-url": "provide a valid http or https URL",
    "job-not-found": "check the job_id from crawl_site or get_job_results",
    "map-failed": "retry map_site or crawl_url the start URL to inspect the failure",
    "raw-not-found": "call list_raw and use an existing raw_id",
    "permission-denied": "use a raw_id or artifact_id inside the storage",
    "section-not-found": "call mode='toc' first and use an existing section id",
    "keyword-filtered": "content did not match keyword rules (include/exclude/regex); adjust keywords or use a different URL",
}
#: Texts of ended sessions.
EXPIRED_TEXTS = ("session expired", "please log in", "please login", "unauthorized", "sign in to continue")
ERROR_TYPE = "struct<errorType:string,message:string,retryable:boolean,suggestedAction:string,artifact_id:string>"


def is_ok(result: Column, tag: str = OK) -> Column:
    return F.coalesce(result.startswith(tag), F.lit(False))


def unwrap_ok(result: Column, tag: str = OK) -> Column:
    return F.substring(result, len(tag) + 1, 2**31 - 1)


def format_error(kind: Column, message: Column, guidance: Mapping[str, str] | None = None, details: Mapping[str, Column] | None = None, tag: str = ERROR) -> Column:
    """The tag and a JSON object; empty details are left out, without guidance the advice is retry or abort."""
    retry = kind.isin(*RETRYABLE)
    known = F.create_map(*(F.lit(x) for pair in guidance.items() for x in pair))[kind] if guidance else F.lit(None).cast("string")
    advice = F.coalesce(known, F.when(retry, "retry").otherwise("abort"))
    extra = [F.nullif(c.cast("string"), F.lit("")).alias(name) for name, c in (details or {}).items()]
    return F.concat(F.lit(tag), F.to_json(F.struct(kind.alias("errorType"), message.alias("message"), retry.alias("retryable"), advice.alias("suggestedAction"), *extra)))


def error_payload(result: Column, tag: str = ERROR) -> Column:
    """Struct of a tagged error; text without the tag becomes an internal error, broken JSON a struct of nulls."""
    body = F.substring(result, len(tag) + 1, 2**31 - 1)
    broken = F.try_parse_json(body).isNull()
    nothing = F.from_json(F.lit("{}"), ERROR_TYPE)
    plain = F.struct(F.lit("internal-error").alias("errorType"), result.alias("message"), F.lit(False).alias("retryable"), F.lit("abort").alias("suggestedAction"), F.lit(None).cast("string").alias("artifact_id"))
    return F.when(result.startswith(tag) & broken, nothing).when(result.startswith(tag) & F.ltrim(body).startswith("{"), F.from_json(body, ERROR_TYPE)).otherwise(plain)


def retry_after(header: Column, now: Column, default: float = 2.0, most: float = 300.0) -> Column:
    """Seconds to wait: a number or an HTTP date, held between 0 and `most`; anything else is `default`."""
    h = F.trim(header)
    number = F.when(h.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), h.try_cast("double")).when(F.lower(h).isin("-inf", "-infinity"), F.lit(0.0))
    date = F.try_to_timestamp(F.regexp_replace(h, r"^[A-Za-z]+,\s*", ""), F.lit("d MMM yyyy HH:mm:ss z"))
    wait = F.coalesce(number, date.cast("double") - now.cast("double"))
    return F.when(wait.isNull() | (wait == float("inf")), F.lit(default)).otherwise(F.greatest(F.lit(0.0), F.least(wait, F.lit(most))))


def session_valid(html: Column, final_url: Column) -> Column:
    """False on a login path or when the page's head says that the session has ended."""
    path = F.regexp_replace(F.coalesce(urls.part(F.lower(final_url), 3), F.lit("")), "/+$", "")
    kicked = F.lit(False)
    for p in LOGIN_PATHS:
        kicked = kicked | (path == p) | path.startswith(p + "/")
    head = F.substring(F.lower(F.coalesce(html, F.lit(""))), 1, 5000)
    ended = F.lit(False)
    for x in EXPIRED_TEXTS:
        ended = ended | head.contains(x)
    return ~(kicked | ended)


def sensor_cookie_invalid(html: Column, cookie: Column) -> Column:
    """The `_abck` cookie is marked unverified, or a short or denying page names its vendor."""
    value = F.regexp_extract(F.coalesce(cookie, F.lit("")), r"(?i)(?:^|;)\s*_abck=([^;]*)", 1)
    page = F.coalesce(html, F.lit(""))
    head = F.substring(F.lower(page), 1, 5000)
    return value.contains("~-1~") | (head.contains("access denied") & head.contains("akamai")) | ((F.length(page) < 500) & head.contains("akamaized.net"))


def allowed_debug_endpoint(url: Column, remote: bool = False) -> Column:
    """Browser debugging endpoints: local hosts over http or ws; others only if `remote`."""
    host = F.regexp_replace(F.regexp_replace(F.lower(urls.part(url, 2)), "^.*@", ""), r":[0-9]*$", "")
    local = F.when(F.lower(urls.part(url, 2)).rlike(r"^(.*@)?\[::1\](:[0-9]*)?$"), True).otherwise(host.isin("localhost", "127.0.0.1"))
    return F.coalesce(F.lower(urls.part(url, 1)).isin("http", "https", "ws", "wss") & (local | F.lit(remote)), F.lit(False))


def _text(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _first(item: Column, names: tuple[str, ...]) -> Column:
    """The first member that is neither missing nor empty, zero or false."""
    member = lambda n: F.try_variant_get(item, f"$.{n}", "variant")
    return F.coalesce(*(F.when(~F.to_json(member(n)).isin("null", '""', "0", "false", "[]", "{}"), member(n)) for n in names))


def _strings(v: Column) -> Column:
    """The strings of an array; null for anything else."""
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), _text), lambda x: x.isNotNull()))


def json_ld(html: Column) -> Column:
    """Title and body of each schema.org object in a page's JSON-LD blocks, as markdown; '' without any.

    Broken blocks are skipped. A product without a body gives its name once more, as a heading.
    """
    pattern = r"""(?is)<script\b[^>]*\btype\s*=\s*["']?application/ld\+json\b[^>]*>(.*?)</script>"""
    none = F.array().cast("array<string>")
    is_array = lambda v: F.schema_of_variant(v).startswith("ARRAY")
    items = lambda v: F.when(is_array(v), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))

    def parts(item: Column) -> Column:
        heading = _text(_first(item, ("headline", "name", "title")))
        body = _first(item, ("articleBody", "text", "description"))
        inner = F.coalesce(*(_text(F.try_variant_get(body, f"$.{n}", "variant")) for n in ("text", "value", "description")))
        name = F.try_variant_get(item, "$.name", "variant")
        label = F.coalesce(F.get(_strings(name), F.lit(0)), _text(name))
        product = body.isNull() & F.lower(F.to_json(F.try_variant_get(item, "$.@type", "variant"))).contains("product") & (label != "")
        listed = F.coalesce(_strings(body), F.array_compact(F.array(F.coalesce(_text(body), F.when(F.schema_of_variant(body).startswith("OBJECT"), inner)))))
        return F.concat(F.array_compact(F.array(F.concat(F.lit("# "), heading))), F.coalesce(listed, none), F.array_compact(F.array(F.when(product, F.concat(F.lit("# "), label)))))

    blocks = F.filter(F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(pattern), F.lit(1)), lambda b: F.try_parse_json(F.trim(b))), lambda v: v.isNotNull())
    objects = F.filter(F.flatten(F.transform(blocks, items)), lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    return F.regexp_replace(F.array_join(F.flatten(F.transform(objects, parts)), "\n\n"), r"^\s+|\s+$", "")


def markdown_links(text: Column, base: Column, limit: int = 200) -> Column:
    """URLs of `[label](url)`, brackets nested once, joined to the base and canonical; the first of each, at most `limit` (the feature)."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[[^\]]*\]\(((?:[^\s()]|\([^\s()]*\))+)\)"), F.lit(1))
    joined = F.transform(F.filter(found, lambda x: ~x.startswith("#")), lambda x: urls.join_url(base, x))
    return F.slice(F.array_distinct(F.transform(F.filter(joined, lambda x: x.rlike("(?i)^https?://")), urls.canonical_url)), 1, limit)


def rule_selectors(listed: Column, stored: Column) -> Column:
    """Selectors of a site rule, then those of a stored rule, split at commas and lines."""
    split = F.filter(F.transform(F.split(F.coalesce(stored, F.lit("")), "[,\n]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.concat(F.coalesce(listed, F.array().cast("array<string>")), split)


def visible_blocks(blocks: Column, limit: int = 12000) -> Column:
    """Numbered list of blocks (text, rect of x, y, w, h or null) within a budget of characters; '' without blocks."""
    title = "## Visible Content Blocks"
    start = F.struct(F.array(F.lit(title)).alias("lines"), F.lit(len(title)).alias("used"), F.lit(False).alias("full"))

    def line(b: Column, i: Column) -> Column:
        text = F.regexp_replace(F.regexp_replace(F.coalesce(b["text"], F.lit("")), r"\s+", " "), "^ | $", "")
        at = [F.coalesce(b["rect"][k].cast("string"), F.lit("0")) for k in "xywh"]
        place = F.when(b["rect"].isNotNull(), F.concat(F.lit(" [x="), at[0], F.lit(", y="), at[1], F.lit(", w="), at[2], F.lit(", h="), at[3], F.lit("]"))).otherwise("")
        return F.when(text != "", F.concat((i + 1).cast("string"), F.lit(". "), text, place))

    def step(a: Column, x: Column) -> Column:
        over = a["used"] + F.length(x) + 2 > limit
        more = F.struct(F.concat(a["lines"], F.array(F.when(over, "[...truncated...]").otherwise(x))).alias("lines"), F.when(over, a["used"]).otherwise(a["used"] + F.length(x) + 1).alias("used"), over.alias("full"))
        return F.when(a["full"], a).otherwise(more)

    listed = F.filter(F.transform(blocks, line), lambda x: x.isNotNull())
    return F.when(F.coalesce(F.size(blocks), F.lit(0)) <= 0, "").otherwise(let(F.aggregate(listed, start, step), lambda a: F.array_join(a["lines"], "\n")))


def fit_nodes(nodes: Column, most: int) -> Column:
    """Accessibility nodes (ignored, role, name, description) that have a role or name, shortened, at most `most`, with count and flag."""
    clip = lambda x, n: F.substring(F.trim(F.coalesce(x, F.lit(""))), 1, n)
    kept = F.filter(nodes, lambda n: ~F.coalesce(n["ignored"], F.lit(False)) & ((clip(n["role"], 80) != "") | (clip(n["name"], 240) != "")))
    short = F.transform(F.slice(kept, 1, most), lambda n: F.struct(clip(n["role"], 80).alias("role"), clip(n["name"], 240).alias("name"), F.nullif(clip(n["description"], 240), F.lit("")).alias("description")))
    return let(short, lambda s: F.struct(F.size(s).alias("node_count"), (F.size(s) >= most).alias("truncated"), s.alias("nodes")))


def links_of_metadata(links: Column, count: Column) -> Column:
    """Struct of the stored links and their number, that of the list where none is stored."""
    own = F.coalesce(links, F.array().cast("array<string>"))
    return F.struct(own.alias("links"), F.coalesce(count, F.size(own)).alias("link_count"))


def page_links(result: Column, stored: Column, base: Column, normalize, limit: int = 200) -> Column:
    """Links of a good result: those stored with the page, or else those of its markdown; in scope, the first of each, at most `limit`.

    `normalize` maps a URL to '' outside the scope (CrawlPolicy.normalize); a failed result has none.
    """
    none = F.array().cast("array<string>")
    kept = lambda urls_: F.slice(F.array_distinct(F.filter(F.transform(urls_, lambda x: normalize(x)), lambda x: x != "")), 1, limit)
    found = F.regexp_extract_all(result, F.lit(r"\[[^\]]*\]\(((?:[^\s()]|\([^\s()]*\))+)\)"), F.lit(1))
    full = F.transform(F.filter(found, lambda x: ~x.startswith("#")), lambda x: F.when(x.rlike("^https?://"), x).otherwise(urls.join_url(base, x)))
    first = kept(F.coalesce(stored, none))
    return F.when(~is_ok(result), none).otherwise(let(first, lambda f: F.when(F.size(f) > 0, f).otherwise(kept(full))))


def crawl_payload(input_url: Column, result: Column, metadata: Column, cache_mode: Column, force_refresh: Column, mode: Column) -> Column:
    """Typed result of one crawl. metadata: struct of url, artifact_id, links and link_count of the stored page, or null."""
    canonical = urls.canonical_url(input_url)
    good, text = is_ok(result), lambda c: F.coalesce(c, F.lit(""))
    error = error_payload(result)
    stored = links_of_metadata(metadata["links"], metadata["link_count"])
    used = F.when(force_refresh & (cache_mode == "enabled"), "write_only").otherwise(cache_mode)
    own = F.coalesce(F.nullif(canonical, F.lit("")), input_url)
    return F.struct(
        good.alias("ok"), F.when(good, unwrap_ok(result)).otherwise("").alias("text"), F.when(~good, error).alias("error"),
        F.when(canonical == "", "").otherwise(urls.url_id(input_url)).alias("raw_id"),
        F.when(good, F.coalesce(F.nullif(metadata["url"], F.lit("")), own)).otherwise(own).alias("url"), canonical.alias("canonical_url"),
        F.when(good, text(metadata["artifact_id"])).otherwise(text(error["artifact_id"])).alias("artifact_id"), used.alias("cache_mode"), mode.alias("mode"),
        F.when(good, stored["links"]).otherwise(F.array().cast("array<string>")).alias("links"), F.when(good, stored["link_count"]).otherwise(0).alias("link_count"),
    )


def map_payload(start_url: Column, text: Column, ok: Column, url: Column, links: Column, link_count: Column, error: Column) -> Column:
    """Typed result of mapping a site."""
    canonical = urls.canonical_url(start_url)
    own = F.coalesce(F.nullif(canonical, F.lit("")), start_url)
    told = links_of_metadata(links, link_count)
    none = F.array().cast("array<string>")
    return F.struct(
        ok.alias("ok"), F.when(~ok, "").when(is_ok(text), unwrap_ok(text)).otherwise(text).alias("text"),
        F.when(~ok, error_payload(F.coalesce(F.nullif(error, F.lit("")), text))).alias("error"), F.when(ok, F.coalesce(F.nullif(url, F.lit("")), own)).otherwise(own).alias("url"),
        canonical.alias("canonical_url"), F.when(ok, told["links"]).otherwise(none).alias("links"), F.when(ok, told["link_count"]).otherwise(0).alias("link_count"),
    )


def iso_seconds(text: Column) -> Column:
    """Seconds of an ISO time, one without a zone in UTC; null for anything else."""
    shaped = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$")
    whole = F.regexp_replace(text, r"([T ][0-9]{2}:[0-9]{2})(?=$|Z|[+-])", "$1:00")
    zoned = F.when(text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$") & text.rlike("[T ]"), whole).otherwise(F.concat(whole, F.when(text.rlike("[T ]"), "Z").otherwise(" 00:00:00Z")))
    return F.when(shaped, F.try_to_timestamp(zoned).cast("double"))


def flags_json(flags: Column) -> Column:
    """Risk flags as stored: a JSON list of the distinct non-empty ones."""
    own = F.filter(F.transform(F.coalesce(flags, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    return F.to_json(F.array_distinct(own))


def flags_of_json(text: Column) -> Column:
    """Risk flags of a stored list; anything else is none."""
    return F.coalesce(F.when(F.ltrim(text).startswith("["), F.filter(F.from_json(text, "array<string>"), lambda x: x.isNotNull())), F.array().cast("array<string>"))
