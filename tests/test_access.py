"""Results, hosts, accounts, sessions and site discovery: expected values of single operators."""

import json

import pytest
from pyspark.sql import functions as F

from webloom.functions import network, results, urls
from webloom.operators import access
from webloom.sources import site_index


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()) or [F.lit(1)]).select(column.alias("x")).collect()[0]["x"]


@pytest.fixture
def now(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return F.to_timestamp(F.lit("2026-01-01 00:00:00"))


@pytest.mark.parametrize(("ref", "expected"), [("../x", "https://e.com/a/x"), ("./y?q=../z", "https://e.com/a/b/y?q=../z"), ("/p/../q/.", "https://e.com/q/"), ("../../../up", "https://e.com/up"), ("..", "https://e.com/a/"), ("n", "https://e.com/a/b/n")])
def test_dot_segments(spark, ref, expected):
    assert one(spark, urls.join_url(F.lit("https://e.com/a/b/c"), F.col("r")), r=ref) == expected


def test_error_codec(spark):
    text = one(spark, results.format_error(F.lit("timeout"), F.lit("sløw"), {"dns-error": "check"}, {"artifact_id": F.lit("a1"), "stage": F.lit("")}))
    assert text.startswith(results.ERROR)
    assert json.loads(text[len(results.ERROR) :]) == {"errorType": "timeout", "message": "sløw", "retryable": True, "suggestedAction": "retry", "artifact_id": "a1"}
    back = one(spark, results.error_payload(F.col("t")), t=text)
    assert (back.errorType, back.retryable, back.artifact_id) == ("timeout", True, "a1")
    assert one(spark, results.error_payload(F.lit("boom"))).asDict() == {"errorType": "internal-error", "message": "boom", "retryable": False, "suggestedAction": "abort", "artifact_id": None}
    assert one(spark, results.error_payload(F.lit(results.ERROR + "{broken"))).errorType is None
    assert one(spark, results.error_payload(F.lit(results.ERROR + "[1]"))).errorType == "internal-error"
    assert one(spark, results.unwrap_ok(F.lit(results.OK + "body"))) == "body"
    assert one(spark, results.is_ok(F.lit(None).cast("string"))) is False


@pytest.mark.parametrize(
    ("header", "expected"),
    [("5", 5.0), (" 1e3 ", 300.0), ("-4", 0.0), ("nan", 2.0), ("inf", 2.0), ("-inf", 0.0), ("soon", 2.0), ("", 2.0), (None, 2.0), ("Thu, 01 Jan 2026 00:01:00 GMT", 60.0), ("Wed, 31 Dec 2025 00:00:00 GMT", 0.0), ("5d", 2.0)],
)
def test_retry_after(spark, now, header, expected):
    assert one(spark, results.retry_after(F.col("h").cast("string"), now), h=header) == expected


def test_sessions_and_endpoints(spark):
    valid = lambda html, url: one(spark, results.session_valid(F.lit(html).cast("string"), F.lit(url).cast("string")))
    assert [valid("hi", "https://a.b/home"), valid(None, None), valid("", "https://a.b/Login/"), valid("", "https://a.b/loginx"), valid("<p>Session EXPIRED", "https://a.b/")] == [True, True, False, True, False]
    bad = lambda html, cookie: one(spark, results.sensor_cookie_invalid(F.lit(html).cast("string"), F.lit(cookie).cast("string")))
    assert [bad("", "x=1; _abck=A~-1~B"), bad("", "_abck=A~0~B"), bad("Access Denied by Akamai", ""), bad("src=//x.akamaized.net", None), bad("y" * 600 + "akamaized.net", ""), bad(None, None)] == [True, False, True, True, False, False]
    ends = lambda url, **k: one(spark, results.allowed_debug_endpoint(F.lit(url).cast("string"), **k))
    assert [ends("ws://localhost:9222/x"), ends("http://[::1]:1"), ends("http://8.8.8.8"), ends("ftp://localhost"), ends(None), ends("wss://far.com", remote=True)] == [True, True, False, False, False, True]


@pytest.mark.parametrize(
    ("block", "expected"),
    [
        ('{"headline": "H", "articleBody": "B"}', "# H\n\nB"),
        ('[{"name": "N", "text": ["a", 1, "b"]}, 3, {"title": "T"}]', "# N\n\na\n\nb\n\n# T"),
        ('{"headline": "", "name": "N", "description": {"value": "v"}}', "# N\n\nv"),
        ('{"@type": "Product", "name": ["P", "Q"]}', "# P"),
        ('{"@type": ["Thing", "Product"], "name": "P"}', "# P\n\n# P"),
        ("{broken", ""),
        ("null", ""),
    ],
)
def test_json_ld(spark, block, expected):
    assert one(spark, results.json_ld(F.col("h")), h=f'<p>x</p><script type="application/ld+json">{block}</script>') == expected


def test_json_ld_without_blocks(spark):
    assert [one(spark, results.json_ld(F.lit(h).cast("string"))) for h in (None, "", "<script>1</script>")] == ["", "", ""]


def test_links_selectors_blocks(spark):
    text = "[a](/x) [b](https://o.com/w_(c)) [c](#top) [d](/x) [e](mailto:q@r.s)"
    assert one(spark, results.markdown_links(F.col("t"), F.lit("https://e.com/d/")), t=text) == ["https://e.com/x", "https://o.com/w_(c)"]
    assert one(spark, results.rule_selectors(F.array(F.lit("main")), F.lit(" .a ,\n,#b"))) == ["main", ".a", "#b"]
    assert one(spark, results.rule_selectors(F.lit(None).cast("array<string>"), F.lit(None).cast("string"))) == []
    kind = "array<struct<text:string,rect:struct<x:int,y:int,w:int,h:int>>>"
    rows = spark.createDataFrame([([(" a  b ", (1, 2, 3, 4)), ("", None), ("c", None)],), ([],), (None,)], f"blocks {kind}")
    listed = [r[0] for r in rows.select(results.visible_blocks(F.col("blocks"))).collect()]
    assert listed == ["## Visible Content Blocks\n1. a b [x=1, y=2, w=3, h=4]\n3. c", "", ""]
    assert [r[0] for r in rows.select(results.visible_blocks(F.col("blocks"), 30)).collect()][0].endswith("\n[...truncated...]")
    nodes = spark.createDataFrame([([(False, " button ", "Go", ""), (True, "x", "y", ""), (None, "", "", "z"), (None, "link", None, "d")],)], "n array<struct<ignored:boolean,role:string,name:string,description:string>>")
    got = nodes.select(results.fit_nodes(F.col("n"), 5).alias("x")).collect()[0]["x"]
    assert (got.node_count, got.truncated, [tuple(n) for n in got.nodes]) == (2, False, [("button", "Go", None), ("link", "", "d")])


def test_hosts(spark):
    hosts = ["::1", "[::1]", "fe80::1", "2606:4700::1111", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "10.0.0.1", "8.8.8.8", "e.com", "x:y", None]
    rows = spark.createDataFrame([(k, h) for k, h in enumerate(hosts)], "k int, h string")
    assert [r[0] for r in rows.orderBy("k").select(network.blocked_host(F.col("h"))).collect()] == [True, True, True, False, True, False, True, False, False, False, False]
    names = [" .Example.COM. ", "bücher.de", "a..b", "a/b", "", "x" * 64, None]
    rows = spark.createDataFrame([(k, h) for k, h in enumerate(names)], "k int, h string")
    assert [r[0] for r in rows.orderBy("k").select(network.domain_key(F.col("h"))).collect()] == ["example.com", "xn--bcher-kva.de", None, None, None, None, None]
    assert [one(spark, network.account_key(F.lit(a).cast("string"))) for a in (None, " Default", "Work.1", "../x")] == ["default", "default", "work.1", None]


def test_gears_and_sessions(spark):
    rules = spark.createDataFrame([("a.com", "g1", False, 0, 0.9), ("b.com", "g2", True, 0, 0.9), ("c.com", "g3", False, 99, 0.9), ("d.com", "g4", None, None, 0.4), ("e.com", "g5", None, None, 0.5)], "domain string, gear string, stale boolean, unreachable_until long, confidence double")
    sites = spark.createDataFrame([("a.com", "hint"), ("e.com", "")], "domain string, gear_hint string")
    asked = spark.createDataFrame([(f"{c}.com",) for c in "abcdez"], "domain string")
    got = {r.domain: r.gear for r in access.effective_gear(asked, sites, rules, F.lit(50)).collect()}
    assert got == {"a.com": "hint", "b.com": None, "c.com": None, "d.com": None, "e.com": "g5", "z.com": None}
    sessions = spark.createDataFrame([("s1", "a.com", "", "", False, "active", 1, 5), ("s2", "a.com", "", "", False, "active", 0, 1), ("s3", "a.com", "", "", False, "active", 0, 2), ("s4", "a.com", "", "", False, "retired", 0, 9)], "session_id string, domain string, account_id string, proxy_url string, storage_state_bound boolean, status string, error_score int, updated_at int")
    want = spark.createDataFrame([("a.com", "", "", False), ("a.com", "", "", True)], "domain string, account_id string, proxy_url string, storage_state_bound boolean")
    assert sorted((r.storage_state_bound, r.session_id) for r in access.pick_session(want, sessions).collect()) == [(False, "s3"), (True, None)]
    kept = spark.createDataFrame([("a.com",), ("b.com",), ("c.com",)], "domain string")
    ages = spark.createDataFrame([("a.com", 1), ("b.com", 2), ("c.com", None)], "domain string, last_success_at int")
    assert sorted(r.domain for r in access.stale_profiles(kept, ages, 1).collect()) == ["a.com", "c.com"]
    shares = access.outcome_shares(spark.createDataFrame([("ok",), ("ok",), ("bad",)], "status string"), "status")
    assert {r.status: (r.n, float(r.percent)) for r in shares.collect()} == {"ok": (2, 66.7), "bad": (1, 33.3)}


def test_register_profiles(spark, now):
    kind = "domain string, account_id string, label string, status string, notes string, risk_flags array<string>, is_default boolean, created_at timestamp, updated_at timestamp"
    t = lambda d: __import__("datetime").datetime(2025, 1, d)
    old = spark.createDataFrame([("a.com", "x", "X", "blocked", "n", ["f"], True, t(1), t(1)), ("a.com", "y", "Y", "active", "", [], False, t(2), t(2)), ("b.com", "z", "Z", "active", "", [], True, t(3), t(3))], kind)
    new = spark.createDataFrame([("a.com", "x", "X2", "", [], False), ("a.com", "y", "Y2", "m", ["g"], True), ("c.com", "default", "", "", [], False), ("c.com", "w", "", "", [], False)], "domain string, account_id string, label string, notes string, risk_flags array<string>, make_default boolean")
    got = {(r.domain, r.account_id): (r.label, r.status, r.notes, r.risk_flags, r.is_default) for r in access.register_profiles(old, new, now).collect()}
    assert got == {
        ("a.com", "x"): ("X2", "blocked", "n", ["f"], False), ("a.com", "y"): ("Y2", "active", "m", ["g"], True), ("b.com", "z"): ("Z", "active", "", [], True),
        ("c.com", "default"): ("", "active", "", [], True), ("c.com", "w"): ("", "active", "", [], False),
    }


def test_readiness(spark, now):
    sites = spark.createDataFrame([("need.com", True, False, ["page"]), ("easy.com", False, False, ["page", "visible_blocks"])], "domain string, needs_account boolean, human_assist boolean, modes array<string>")
    profiles = spark.createDataFrame([("easy.com", "u", "active", None, False), ("barred.com", "default", "blocked", None, True), ("need.com", "n", "active", "2020-01-01 00:00:00", True)], "domain string, account_id string, status string, expires_at string, is_default boolean")
    vault = spark.createDataFrame([("easy.com", "u")], "domain string, account_id string")
    targets = spark.createDataFrame([("easy.com", "", "user_authorized"), ("none.com", "", "standard"), ("barred.com", "", "user_authorized"), ("need.com", "n", "user_authorized")], "domain string, account_id string, access_mode string")
    got = {r.domain: (r.selected_account_id, r.tool, r.assist, r.extract_mode, r.reasons, r.issues) for r in access.readiness(targets, sites, profiles, vault, now).collect()}
    assert got["easy.com"] == ("u", "retrieve_page", "auto", "visible_blocks", [], [])
    assert got["none.com"] == ("default", "retrieve_page", "off", "bundle", ["no_site_profile", "no_account_profile"], [])
    assert got["barred.com"][1:3] == ("mark_account_profile_or_register_account_profile", "required")
    assert got["barred.com"][4:] == (["no_site_profile", "account_blocked"], ["default_account_blocked"])
    assert got["need.com"] == ("n", "open_browser_session", "required", "page", ["site_needs_account", "human_assist_expected", "account_expired"], [])


def test_discover(spark):
    docs = [
        ("https://e.com/robots.txt", "User-agent: *\nSitemap: /maps/index.xml\n"), ("https://e.com/maps/index.xml", "<sitemapindex><sitemap><loc>/maps/a.xml</loc></sitemap></sitemapindex>"),
        ("https://e.com/maps/a.xml", "<urlset><url><loc>https://e.com/p1</loc></url><url><loc>https://other.com/p</loc></url></urlset>"), ("https://e.com/sitemap.xml", "<urlset><url><loc>https://e.com/p2/</loc></url></urlset>"),
        ("https://e.com/", '<link rel="alternate" type="application/rss+xml" href="/feed">'), ("https://e.com/feed", "<rss><channel><item><link>/post</link></item></channel></rss>"), ("https://f.com/", None),
    ]
    captured = spark.createDataFrame(docs, "url string, body string")
    starts = spark.createDataFrame([("https://e.com/",), ("https://f.com/",)], "start_url string")
    assert sorted(tuple(r) for r in site_index.discover(starts, captured).collect()) == [("https://e.com/", f"https://e.com/{x}") for x in ("p1", "p2", "post")]
