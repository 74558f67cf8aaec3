"""Accounts, sessions and gears: which way a target is fetched, as joins of small keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from . import rules
from .state import account_usable

#: Extract modes from the most wanted on.
MODES = ("bundle", "visible_blocks", "fit_markdown", "page")
CONFIDENT = 0.5


def recommended_mode(modes: Column) -> Column:
    return F.coalesce(*(F.when(F.array_contains(modes, m), m) for m in MODES), F.lit("bundle"))


def status_reason(status: Column, expires_at: Column, now: Column) -> Column:
    """Why a profile can or cannot be used; null status means no profile."""
    late = F.coalesce(F.try_to_timestamp(expires_at) <= now, F.lit(False))
    return F.when(status.isNull(), "no_profile").when(status.isin("blocked", "needs_login", "expired"), status).when(late, "expired").otherwise(status)


def trusted_gear(rules: DataFrame, now: Column) -> DataFrame:
    """(domain, gear) of stored rules that are fresh, reachable and confident enough."""
    ok = ~F.coalesce(F.col("stale"), F.lit(False)) & (F.coalesce(F.col("unreachable_until"), F.lit(0)) <= now) & (F.col("confidence") >= CONFIDENT) & (F.coalesce("gear", F.lit("")) != "")
    return rules.filter(ok).select("domain", "gear")


def effective_gear(requests: DataFrame, sites: DataFrame, rules: DataFrame, now: Column) -> DataFrame:
    """requests (domain) with `gear`: the site rule's hint (domain, gear_hint), else the trusted stored one, else null."""
    hints = sites.select("domain", F.nullif(F.col("gear_hint"), F.lit("")).alias("_hint"))
    return requests.join(hints, "domain", "left").join(trusted_gear(rules, now), "domain", "left").withColumn("gear", F.coalesce("_hint", "gear")).drop("_hint")


def pick_session(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """requests with `session_id` of the active session of their identity: the fewest errors, then the newest, else null."""
    identity = ["domain", "account_id", "proxy_url", "storage_state_bound"]
    w = Window.partitionBy(*identity).orderBy("error_score", F.desc("updated_at"), "session_id")
    best = sessions.filter("status = 'active'").withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*identity, "session_id")
    return requests.join(best, identity, "left")


def session_key(domain: Column, account: Column, proxy: Column, bound: Column) -> Column:
    """The id that an identity's first session gets."""
    parts = [F.lower(domain), F.coalesce(account, F.lit("")), F.coalesce(proxy, F.lit("")), F.when(bound, "account").otherwise("anonymous")]
    return F.substring(F.sha1(F.concat_ws("\x1f", *parts)), 1, 16)


def use_sessions(requests: DataFrame, sessions: DataFrame, now: Column) -> DataFrame:
    """sessions after one request of each identity: its best active session is used once more, or a new one is made.

    sessions: (session_id, domain, account_id, proxy_url, storage_state_bound, status, error_score, use_count, created_at,
    updated_at). Where the identity's earlier sessions are retired, the new id gets the next generation's number.
    """
    identity = ["domain", "account_id", "proxy_url", "storage_state_bound"]
    wanted = requests.select(*identity).distinct()
    chosen = pick_session(wanted, sessions)
    used = chosen.filter("session_id IS NOT NULL").select("session_id", F.lit(True).alias("_used"))
    old = sessions.join(used, "session_id", "left")
    mine = F.coalesce("_used", F.lit(False))
    old = old.withColumn("use_count", F.col("use_count") + mine.cast("int")).withColumn("updated_at", F.when(mine, now).otherwise(F.col("updated_at"))).select(sessions.columns)
    generations = sessions.groupBy(*identity).agg(F.count(F.lit(1)).alias("_n"))
    new = chosen.filter("session_id IS NULL").join(generations, identity, "left")
    first = session_key(*(F.col(c) for c in identity))
    new = new.withColumn("session_id", F.when(F.col("_n") > 0, F.concat(first, F.lit("-"), F.col("_n") + 1)).otherwise(first))
    made = {"status": F.lit("active"), "error_score": F.lit(0), "use_count": F.lit(1), "created_at": now, "updated_at": now}
    return old.unionByName(new.select(*(made.get(c, F.col(c)).alias(c) for c in sessions.columns)))


def listed_profiles(profiles: DataFrame, domain: str = "") -> DataFrame:
    """Profiles by domain, the default first, then the newest."""
    own = profiles.filter(F.col("domain") == domain) if domain else profiles
    return own.orderBy("domain", F.desc("is_default"), F.desc("updated_at"), "account_id")


def mark_profiles(profiles: DataFrame, marks: DataFrame, now: Column) -> DataFrame:
    """marks: (domain, account_id, status, notes, risk_flags); empty notes and null flags keep the old ones; unknown profiles are made first."""
    none = F.array().cast("array<string>")
    new = marks.select("domain", "account_id", F.lit("").alias("label"), "notes", F.lit(None).cast("array<string>").alias("risk_flags"), F.lit(False).alias("make_default"))
    unknown = new.join(profiles, ["domain", "account_id"], "left_anti")
    known = register_profiles(profiles, unknown, now)
    m = marks.select("domain", "account_id", F.col("status").alias("_status"), F.nullif("notes", F.lit("")).alias("_notes"), F.col("risk_flags").alias("_flags"))
    j = known.join(m, ["domain", "account_id"], "left")
    given = F.col("_status").isNotNull()
    fresh = {
        "status": F.coalesce("_status", "status"), "notes": F.coalesce("_notes", "notes"), "risk_flags": F.coalesce("_flags", "risk_flags", none),
        "updated_at": F.when(given, now).otherwise(F.col("updated_at")),
    }
    return j.select(*(fresh.get(c, F.col(c)).alias(c) for c in known.columns))


def stale_profiles(profiles: DataFrame, rules: DataFrame, keep: int) -> DataFrame:
    """Profiles of domains outside the `keep` (the feature) with the newest success."""
    newest = rules.filter("last_success_at IS NOT NULL").orderBy(F.desc("last_success_at"), "domain").limit(keep).select("domain")
    return profiles.join(newest, "domain", "left_anti")


def register_profiles(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Upsert on (domain, account_id): empty notes and flags keep the old ones, `make_default` takes the mark from the domain's others.

    `new` has one row per key; a status in `old` stays, a new profile is active.
    """
    keys, n = ["domain", "account_id"], new.withColumn("_in", F.lit(True))
    o = old.withColumn("_old", F.lit(True))
    j = o.alias("o").join(n.alias("n"), keys, "full")
    c = lambda side, name: F.col(f"{side}.{name}")
    given, known = F.coalesce(F.col("_in"), F.lit(False)), F.coalesce(F.col("_old"), F.lit(False))
    taken = F.max(F.coalesce(F.col("make_default"), F.lit(False))).over(Window.partitionBy("domain"))
    kept = F.coalesce(c("o", "is_default"), F.lit(False)) & ~taken
    default = F.when(F.coalesce(F.col("make_default"), F.lit(False)), True).when(given & ~known, F.col("account_id") == "default").otherwise(kept)
    return j.select(
        *keys,
        F.when(given, c("n", "label")).otherwise(c("o", "label")).alias("label"),
        F.coalesce(c("o", "status"), F.lit("active")).alias("status"),
        F.when(given & (F.coalesce(c("n", "notes"), F.lit("")) != ""), c("n", "notes")).otherwise(F.coalesce(c("o", "notes"), F.lit(""))).alias("notes"),
        F.when(given & (F.size(F.coalesce(c("n", "risk_flags"), F.array().cast("array<string>"))) > 0), c("n", "risk_flags")).otherwise(F.coalesce(c("o", "risk_flags"), F.array().cast("array<string>"))).alias("risk_flags"),
        default.alias("is_default"),
        F.coalesce(c("o", "created_at"), now).alias("created_at"),
        F.when(given | (taken & known), now).otherwise(c("o", "updated_at")).alias("updated_at"),
    )


def readiness(targets: DataFrame, sites: DataFrame, profiles: DataFrame, vault: DataFrame, now: Column, vault_on: bool = True) -> DataFrame:
    """How each target (domain, account_id or '', access_mode) should be fetched.

    sites: (domain, needs_account, human_assist, modes); profiles: (domain, account_id, status, expires_at, is_default); vault: (domain,
    account_id) with stored browser state. The account is the given one, else the default, else the first usable, else `default`.
    Adds selected_account_id, tool, assist, extract_mode, reasons, issues.
    """
    usable = account_usable(F.col("status"), F.col("expires_at"), now)
    w = Window.partitionBy("domain").orderBy(F.desc("is_default"), "account_id")
    first = profiles.filter(usable).withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("domain", F.col("account_id").alias("_first"))
    own = profiles.select("domain", F.col("account_id").alias("selected_account_id"), F.col("status").alias("_status"), F.col("expires_at").alias("_expires"))
    held = vault.select("domain", F.col("account_id").alias("selected_account_id"), F.lit(True).alias("_held")).distinct()
    site = sites.select("domain", F.lit(True).alias("_site"), F.col("needs_account").alias("_needs"), F.col("human_assist").alias("_human"), F.col("modes").alias("_modes"))
    j = targets.join(first, "domain", "left").withColumn("selected_account_id", F.coalesce(F.nullif(F.trim("account_id"), F.lit("")), "_first", F.lit("default")))
    j = j.join(own, ["domain", "selected_account_id"], "left").join(held, ["domain", "selected_account_id"], "left").join(site, "domain", "left")
    needs = F.coalesce(F.col("_needs"), F.lit(False))
    human = needs | F.coalesce(F.col("_human"), F.lit(False))
    reason = status_reason(F.col("_status"), F.col("_expires"), now)
    fine = F.coalesce(account_usable(F.col("_status"), F.col("_expires"), now), F.lit(False))
    barred = (F.coalesce("_status", F.lit("")) == "blocked") & (F.coalesce(F.trim("account_id"), F.lit("")) == "")
    plain, stored = (F.col("access_mode") == "standard") & ~human, fine & F.coalesce(F.col("_held"), F.lit(False)) & ~human
    tool = F.when(barred, "mark_account_profile_or_register_account_profile").when(plain | stored, "retrieve_page").otherwise("open_browser_session")
    assist = F.when(barred, "required").when(plain, "off").when(stored, "auto").when(needs | ~fine, "required").otherwise("auto")
    said = F.array_compact(F.array(
        F.when(F.col("_site").isNull(), "no_site_profile"), F.when(needs, "site_needs_account"), F.when(human, "human_assist_expected"),
        F.when(F.col("_status").isNull(), "no_account_profile").when(~fine, F.concat(F.lit("account_"), reason)),
    ))
    wrong = F.array_compact(F.array(F.when(F.lit(not vault_on) & (F.col("access_mode") == "user_authorized"), "vault_off"), F.when(barred, "default_account_blocked")))
    new = {"tool": tool, "assist": assist, "extract_mode": recommended_mode(F.col("_modes")), "reasons": said, "issues": wrong}
    return j.withColumns(new).drop("_first", "_status", "_expires", "_held", "_site", "_needs", "_human", "_modes")


def decided(ready: DataFrame, policy: rules.Policy = rules.Policy(), target: str = "url") -> DataFrame:
    """Rows of `readiness` with the recommended call and what the policy says of it; a call that it denies adds the issue `policy_denied`.

    next_call: (tool, url, domain, account_id, access_mode, human_assist, extract_mode), null where the tool takes no such argument. A session
    is always authorized; a page is fetched with an account only where access is. Adds policy_allowed, policy_risk, policy_reasons, approval_required.
    """
    session, page = F.col("tool") == "open_browser_session", F.col("tool") == "retrieve_page"
    authorized = F.col("access_mode") == "user_authorized"
    url = F.coalesce(urls.canonical_url(F.col(target)), F.lit(""))
    call = F.struct(
        F.col("tool"), url.alias("url"), F.col("domain"), F.when(session | (page & authorized), F.col("selected_account_id")).when(page, "").alias("account_id"),
        F.when(session, "user_authorized").when(page, F.col("access_mode")).alias("access_mode"), F.when(page, F.col("assist")).alias("human_assist"), F.when(page, "page").alias("extract_mode"),
    )
    calls = ready.select(F.struct("*").alias("_ready"), call.alias("next_call"), "tool", url.alias("target_url"), "domain", "access_mode", (session | (page & authorized)).alias("uses_live_browser"))
    made = rules.decide(calls, policy)
    issues = F.when(F.col("allowed"), F.col("_ready.issues")).otherwise(F.concat("_ready.issues", F.array(F.lit("policy_denied"))))
    own = [issues.alias(c) if c == "issues" else F.col("_ready")[c].alias(c) for c in ready.columns]
    return made.select(*own, "next_call", F.col("allowed").alias("policy_allowed"), F.col("risk").alias("policy_risk"), F.col("reasons").alias("policy_reasons"), "approval_required")


def outcome_shares(outcomes: DataFrame, by: str) -> DataFrame:
    """(by, n, percent) of each outcome; the total is summed over the counts."""
    counts = outcomes.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 1))
