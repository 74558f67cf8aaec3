"""Keyword rules, policy decisions, tool risk, fetch order, cache modes and error records."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.expressions import glob_pattern
from ..functions.results import RETRYABLE

#: Risk of each tool.
LOW_RISK = (
    "get_site_profile", "get_retrieval_readiness", "get_policy_decision", "list_account_profiles", "list_browser_sessions",
    "list_raw", "list_artifacts", "get_engine_status",
)
MEDIUM_RISK = (
    "retrieve_page", "crawl_url", "crawl_url_structured", "map_site", "map_site_structured", "discover_site_index",
    "discover_site_index_structured", "get_job_status", "get_job_status_structured", "get_job_errors", "get_job_errors_structured",
    "get_job_results", "get_job_results_structured", "wait_for_job", "wait_for_job_structured",
)
HIGH_RISK = (
    "crawl_site", "crawl_site_structured", "crawl_site_indexed", "crawl_site_indexed_structured", "get_raw", "get_raw_metadata",
    "get_raw_metadata_structured", "get_artifact_summary", "get_artifact_summary_structured", "get_artifact_screenshot",
)
CRITICAL_RISK = (
    "open_browser_session", "connect_browser_session", "run_browser_actions", "start_element_picker", "start_region_picker",
    "observe_browser_session", "extract_browser_session", "close_browser_session", "get_artifact", "cleanup_artifacts",
)
RISK = {"low": LOW_RISK, "medium": MEDIUM_RISK, "high": HIGH_RISK, "critical": CRITICAL_RISK}
OK_PREFIX = "__OK__:\n\n"


def tool_risk(tool: Column) -> Column:
    chain = None
    for risk, tools in RISK.items():
        chain = F.when(tool.isin(*tools), risk) if chain is None else chain.when(tool.isin(*tools), risk)
    return chain.otherwise("unknown")


def csv_values(raw: str) -> tuple[str, ...]:
    """Lower-case values of a setting, parted at commas, semicolons and lines."""
    return tuple(x for x in (v.strip().lower() for v in re.split("[,;\n]", raw or "")) if x)


def env_bool(value: str | None, default: bool) -> bool:
    """A switch of an environment; what is not set keeps its default."""
    return default if value is None else value.strip().lower() in ("1", "true", "yes", "on")


def configured_proxies(*settings: str) -> tuple[str, ...]:
    """Proxies of the settings in order, each once; their case stays."""
    return tuple(dict.fromkeys(x.strip() for raw in settings for x in re.split("[,;\n]", raw or "") if x.strip()))


def domain_matches(domain: Column, pattern: str) -> Column:
    """`x` and `*.x` stand for x and all its subdomains; any other `*` is a wildcard; case and outer dots do not matter."""
    name, pattern = F.regexp_replace(F.lower(domain), r"^\.+|\.+$", ""), pattern.lower().strip(".")
    base = pattern.removeprefix("*.")
    if "*" in base:
        return name.rlike(glob_pattern(pattern))
    return F.lit(bool(base)) & ((name == base) | name.endswith(f".{base}"))


@dataclass(frozen=True)
class Policy:
    """Settings of an installation."""

    mode: str = "permissive"
    allowed_domains: tuple[str, ...] = ()
    blocked_domains: tuple[str, ...] = ()
    max_pages: int = 500
    crawl_site: bool = True
    live_browser: bool = True
    cdp: bool = True
    artifact_bodies: bool = False


def decide(calls: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """calls with risk, allowed, reasons, approval_required and restrictions (a map of strings).

    calls: (tool, target_url, domain, access_mode, requested_pages, uses_live_browser, uses_cdp, reads_artifact_body,
    capture_artifact); columns that are missing count as empty or false.
    """
    has = set(calls.columns)
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in has else F.lit("")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in has else F.lit(False)
    pages = F.col("requested_pages") if "requested_pages" in has else F.lit(None).cast("int")
    risk = tool_risk(F.col("tool"))
    given = F.lower(F.trim(text("domain")))
    domain = F.when(given != "", given).otherwise(urls.domain_of(urls.canonical_url(text("target_url"))))

    def any_of(patterns: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for p in patterns:
            hit = hit | domain_matches(domain, p)
        return hit

    strict = F.lit(policy.mode == "strict")
    tests = [
        ((domain != "") & any_of(policy.blocked_domains), "blocked_domain"),
        ((domain != "") & F.lit(bool(policy.allowed_domains)) & ~any_of(policy.allowed_domains), "domain_not_allowed"),
        ((domain == "") & strict & risk.isin("medium", "high", "critical"), "target_domain_required"),
        ((risk == "unknown") & strict, "unknown_tool"),
        (F.col("tool").rlike("^crawl_site(_indexed)?(_structured)?$") & F.lit(not policy.crawl_site), "crawl_site_disabled"),
        (flag("uses_live_browser") & F.lit(not policy.live_browser), "live_browser_disabled"),
        (flag("uses_cdp") & F.lit(not policy.cdp), "cdp_disabled"),
        (flag("reads_artifact_body") & F.lit(not policy.artifact_bodies), "artifact_body_disabled"),
        (F.coalesce(pages > policy.max_pages, F.lit(False)), "max_pages_exceeds_hard_limit"),
    ]
    reasons = F.array_compact(F.array(*(F.when(test, name) for test, name in tests)))
    said = lambda x: str(x).lower() if isinstance(x, bool) else str(x)
    always = {
        "policy_mode": F.lit(policy.mode), "risk": risk, "target_domain": domain, "live_browser_enabled": F.lit(said(policy.live_browser)),
        "cdp_enabled": F.lit(said(policy.cdp)), "crawl_site_enabled": F.lit(said(policy.crawl_site)),
        "artifact_bodies_enabled": F.lit(said(policy.artifact_bodies)), "max_pages_hard": F.lit(said(policy.max_pages)),
    }
    some = {
        "requested_pages": pages.cast("string"), "artifact_capture": F.when(flag("capture_artifact"), "true"),
        "single_page_user_authorized": F.when(text("access_mode") == "user_authorized", "true"),
    }
    entries = [F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (always | some).items()]
    restrictions = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))
    fine = F.size(reasons) == 0
    approval = (risk == "critical") | (flag("capture_artifact") & risk.isin("high", "critical"))
    return calls.select(
        "*", risk.alias("risk"), fine.alias("allowed"), F.when(fine, F.array(F.lit("allowed_by_policy"))).otherwise(reasons).alias("reasons"),
        approval.alias("approval_required"), restrictions.alias("restrictions"),
    )


#: Ways to fetch, from the cheapest on.
GEARS = ("curl_cffi", "patchright_headless", "jina_reader", "hitl")


def gear_order(cached: Column, needs_account: Column, has_state: Column, removed: Column | None = None) -> Column:
    """Fetch order: a cached gear first; an account without stored state leaves only human help; gears in `removed` (an array) go."""
    order = F.when(needs_account & ~has_state, F.array(F.lit("hitl"))).otherwise(F.array(*map(F.lit, GEARS)))
    if removed is not None:
        order = F.filter(order, lambda g: ~F.coalesce(F.array_contains(removed, g), F.lit(False)))
    return F.when(F.coalesce(F.array_contains(order, cached), F.lit(False)), F.array_union(F.array(cached), order)).otherwise(order)


def effective_cache_mode(access: Column, extract: Column, cache: Column) -> Column:
    return F.when((cache == "enabled") & (access == "user_authorized"), "write_only").when(extract == "screenshot", "write_only").otherwise(cache)


def keyword_failures(docs: DataFrame, rules: list[dict], text: str = "text") -> Column:
    """Reason of the first rule that a text fails, or null; empty texts pass.

    A rule has name, include, exclude, regex, case_sensitive and match_position
    (any, title: the first line, or body: the rest). The rule list is an
    argument, so its size is that of the plan, not of the data.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    reasons = []
    for rule in rules:
        if not rule.get("enabled", True):
            continue
        head = F.substring_index(whole, "\n", 1)
        part = {"title": F.regexp_replace(head, r"^#+\s*", ""), "body": F.substring(whole, F.length(head) + 2, F.length(whole))}.get(rule.get("match_position", "any"), whole)
        folded = part if rule.get("case_sensitive") else F.lower(part)
        fold = (lambda w: w) if rule.get("case_sensitive") else str.lower

        def any_of(words, folded=folded, fold=fold) -> Column:
            hit = F.lit(False)
            for w in words:
                hit = hit | folded.contains(fold(w))
            return hit

        for w in rule.get("exclude", ()):
            reasons.append(F.when(folded.contains(fold(w)), F.lit(f"{rule['name']}: exclude {w}")))
        if rule.get("include"):
            reasons.append(F.when(~any_of(rule["include"]), F.lit(f"{rule['name']}: no include")))
        if rule.get("regex"):
            hit = F.lit(False)
            for r in rule["regex"]:
                hit = hit | part.rlike(r if rule.get("case_sensitive") else f"(?i){r}")
            reasons.append(F.when(~hit, F.lit(f"{rule['name']}: no regex")))
    return F.when(whole == "", None).otherwise(F.coalesce(*reasons)) if reasons else F.lit(None).cast("string")


def retryable(error: Column) -> Column:
    return error.isin(*RETRYABLE)
