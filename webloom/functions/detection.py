"""Response classification: challenges, blocks, failed single-page apps, login walls, empty pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import let

#: Fixed values of the classifier.
STRONG = (
    "cf-browser-verification", "cf_chl_opt", "cf-mitigated", "challenge-platform", "just a moment", "checking your browser", "attention required! | cloudflare",
    "ddos protection by", "cdn-cgi/challenge", "pxdlpixel", "_pxcaptcha", "cf-turnstile", "datadome", "geo.captcha-delivery", "kasada", "ips.js", "incap_ses",
)
WEAK = ("recaptcha", "g-recaptcha", "hcaptcha", "arkoselabs", "funcaptcha")
WEAK_CONTEXT = ("<iframe", "<script", "g-recaptcha", "cf-turnstile")
BLOCK_STATUSES = (401, 403, 425, 429, 503)
BLOCK_TEXTS = (
    "access denied", "forbidden", "rate limit", "too many requests", "unauthorized", "captcha", "are you a robot", "verify you are human",
    "access to this page has been denied", "px-captcha", "datadome", "robot check", "bot detection", "security check",
)
SPA_STRONG = ("data loading failed", "please check your network", "no content available", "加载失败", "请检查网络", "暂无内容", "重新加载", "loading error")
SPA_WEAK = ("check back later", "something went wrong", "failed to load")
SPA_MARKERS = ("data-wf-page", "data-wf-site", "data-reactroot", "__nuxt", "__next", "data-v-", "w-dyn-item")
LOGIN_PATHS = ("/login", "/signin", "/auth", "/account/login", "/sessions")


def _any(text: Column, needles: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | text.contains(needle)
    return hit


def _lower(html: Column, n: int) -> Column:
    return F.substring(F.lower(F.coalesce(html, F.lit(""))), 1, n)


def is_challenge(html: Column) -> Column:
    weak = lambda t: sum((t.contains(w).cast("int") for w in WEAK), F.lit(0)) >= 2
    return let(_lower(html, 20_000), lambda t: _any(t, STRONG) | (weak(t) & _any(t, WEAK_CONTEXT)))


def spa_failure(html: Column) -> Column:
    """The phrase that shows it, or null."""
    strong = lambda t: [F.when(t.contains(x), x) for x in SPA_STRONG]
    weak = lambda t: [F.when(t.contains(x) & _any(t, SPA_MARKERS), x) for x in SPA_WEAK]
    return let(_lower(html, 20_000), lambda t: F.coalesce(*strong(t), *weak(t)))


def visible_length(html: Column) -> Column:
    """Characters of trimmed text nodes outside scripts, styles and comments."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<(script|style|noscript)\b.*?</\1\s*>", "")
    return F.char_length(F.regexp_replace(F.regexp_replace(t, r"\s*<[^>]*>\s*", ""), r"^\s+|\s+$", ""))


def is_login(html: Column, final_url: Column) -> Column:
    path = F.regexp_extract(F.lower(F.coalesce(final_url, F.lit(""))), r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", 1)
    at_path = F.lit(False)
    for p in LOGIN_PATHS:
        at_path = at_path | (path == p) | path.startswith(f"{p}/")
    form = lambda t: _any(t, ('name="password"', 'type="password"')) & _any(t, ("login", "sign in"))
    return at_path | let(_lower(html, 5_000), form)


def verdict(html: Column, status: Column, final_url: Column, bypass_l3: Column | None = None) -> Column:
    """(verdict, reason, shortcircuit), the first rule that holds."""
    bypass = F.lit(False) if bypass_l3 is None else bypass_l3
    blank = F.trim(F.coalesce(html, F.lit(""))) == ""
    spa = spa_failure(html)
    rules = [
        (is_login(html, final_url), "blocked_login", F.lit("302→login detected"), "hitl"),
        (is_challenge(html), "blocked_cloudflare", F.lit("challenge page signature"), "jina"),
        (status.isin(*BLOCK_STATUSES), "blocked_generic", F.concat(F.lit("HTTP "), status.cast("string")), None),
        (blank, "blocked_generic", F.lit("empty body"), None),
        (let(_lower(html, 20_000), lambda t: _any(t, BLOCK_TEXTS)), "blocked_generic", F.lit("block text detected"), None),
        (~bypass & spa.isNotNull(), "spa_load_incomplete", F.concat(F.lit("SPA load failure: '"), spa, F.lit("'")), None),
        (~bypass & (visible_length(html) < 200), "empty", F.lit("no extractable content (SPA or blocked)"), None),
    ]
    chain = None
    for test, name, reason, way in rules:
        out = F.struct(F.lit(name).alias("verdict"), reason.alias("reason"), F.lit(way).cast("string").alias("shortcircuit"))
        chain = F.when(test, out) if chain is None else chain.when(test, out)
    return chain.otherwise(F.struct(F.lit("ok").alias("verdict"), F.lit("").alias("reason"), F.lit(None).cast("string").alias("shortcircuit")))


def title(html: Column, url: Column, fallback: str = "") -> Column:
    t = F.regexp_replace(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1), r"^\s+|\s+$", "")
    cut = None
    for mark in (" - ", " | ", " _ ", "—", "·"):
        out = F.trim(F.substring_index(t, mark, 1))
        cut = F.when(t.contains(mark), out) if cut is None else cut.when(t.contains(mark), out)
    cut = cut.otherwise(t)
    last = F.substring_index(F.regexp_replace(F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), "/+$", ""), "/", -1)
    last = F.regexp_replace(F.coalesce(F.try_url_decode(last), last), r"\.[^.]*$", "")
    last = F.trim(F.translate(last, "-_", "  "))
    return F.coalesce(F.when(F.char_length(cut) > 1, cut), F.when(last != "", last), F.when(F.lit(fallback) != "", F.lit(fallback)), url)
