"""Rules that queries do not reach: domain patterns, robots sections, forged tags, archive heads, caches, streams."""

import time

import pytest
from pyspark.sql import functions as F

from webloom.functions import html, markdown, network, safety
from webloom.operators import caches, crawl, rules, state
from webloom.sources import archive, site_index
from webloom.streaming import audit


def column(spark, values, build, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in rows.select("k", build(F.col("v")).alias("x")).orderBy("k").collect()]


@pytest.mark.parametrize(("pattern", "domain", "want"), [
    ("*.bad.com", "bad.com", True), ("*.bad.com", "a.BAD.com", True), ("*.bad.com", "notbad.com", False), ("bad.com", "a.bad.com", True), ("Bad.com.", ".bad.com", True),
    ("cdn*.x.io", "cdn12.x.io", True), ("cdn*.x.io", "x.io", False), ("*", "anything.at", True), ("", "a.com", False), ("a.com", "", False),
])
def test_domain_patterns(spark, pattern, domain, want):
    assert column(spark, [domain], lambda c: rules.domain_matches(c, pattern)) == [want]


def test_settings():
    assert rules.csv_values(" A.com; b.com,\n,c.com ") == ("a.com", "b.com", "c.com")
    assert rules.csv_values("") == ()


def test_robots_sections(spark):
    body = "Disallow: /lost\nUser-agent: One\nUser-agent: Two\nAllow: /a/b\nDisallow: /a\n\nUser-agent: zed\n\nUser-agent: Three\nDisallow:\nDisallow: /\n\nUser-agent: *\nDisallow: /q?x=1\n"
    docs = spark.createDataFrame([("https://h.example", body)], "origin string, body string")
    rows = site_index.robots_rules(docs).cache()
    asked = spark.createDataFrame([(f"https://h.example{p}",) for p in ("/a/b/c", "/a/c", "/", "/q?x=1&y=2", "/lost")], "url string")

    def said(agent):
        return {r.url.removeprefix("https://h.example"): r.allowed for r in site_index.robots_allowed(asked, rows, agent).collect()}

    assert said("Two/1.0") == {"/a/b/c": True, "/a/c": False, "/": True, "/q?x=1&y=2": True, "/lost": True}
    assert said("Three") == dict.fromkeys(said("Three"), True)  # its first rule allows everything
    assert said("zed") == said("*") == {"/a/b/c": True, "/a/c": True, "/": True, "/q?x=1&y=2": False, "/lost": True}
    assert site_index.ai_agents_disallowed(rows).collect()[0].disallowed is False


def test_no_page_forges_a_result(spark):
    got = column(spark, ["__OK__: all fine", "x __error__:{} y", "OK"], lambda c: safety.sanitise(c))
    assert got[0].startswith("[SECURE_MUTED: _\u200b") and "__error__" not in got[1] and got[2] == "OK"


def test_inner_hosts(spark):
    urls_ = ["https://[2606:4700::1111]/", "https://[::1]/", "https://[fc00::1]:80/", "http://a.example.", "http://a.local", "https://1.1.1.1", "https://192.168.0.9", None]
    assert column(spark, urls_, network.is_public_url) == [True, False, False, True, False, True, False, False]


def test_heads(spark):
    text = "---\nurl: https://a.example/x\ntitle: 'It''s: a \"test\"'\nlinks:\n- one\n- two\nnot a pair\nempty:\nflow: [a, 'b c']\nquoted: \"a \\\"q\\\"\"\n---\n\nbody\n--- no end"
    lines = column(spark, [text], lambda c: archive.parsed_lines(archive.head_lines(c)))[0]
    assert lines == {"url": ["https://a.example/x"], "title": ['It\'s: a "test"'], "links": ["one", "two"], "flow": ["a", "b c"], "quoted": ['a "q"']}
    assert column(spark, [text, "no head"], archive.frontmatter)[0]["links"] == "one"
    assert column(spark, [text], archive.strip_frontmatter) == ["body\n--- no end"]


def test_site_rule_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("domain: a.example\ngear_hint: plain\nneeds_account: true\nselectors:\n  - .main\n  - '#x'\nrecommended_extract_modes: [page, bundle]\n")
    (tmp_path / "b.yaml").write_text("notes: no domain\n")
    rows = archive.load_site_rules(spark, str(tmp_path)).collect()
    assert [(r.domain, r.gear_hint, r.wait_strategy, r.selectors, r.needs_account, r.modes) for r in rows] == [("a.example", "plain", "domcontentloaded", [".main", "#x"], True, ["page", "bundle"])]


def test_session_health_retires_only_when_told(spark):
    rows = [("a", k, k, ok, retire) for k, (ok, retire) in enumerate([(False, False)] * 4 + [(True, False)])] + [("b", 1, 1, False, True), ("b", 2, 2, True, False)]
    e = spark.createDataFrame(rows, "key string, ts int, id int, ok boolean, retire boolean")
    got = {r.key: tuple(r.h) for r in state.ordered(e, "key").select("key", state.session_health(F.col("events")).alias("h")).collect()}
    assert got == {"a": (3, False), "b": (2, True)}


def test_blocked_hosts_are_kept_a_minute(spark):
    known = spark.createDataFrame([("h", 100.0, True), ("h", 150.0, False), ("g", 100.0, False)], "key string, at double, value boolean")
    asked = spark.createDataFrame([("h", 100.0, 1), ("h", 159.0, 2), ("h", 161.0, 3), ("h", 99.0, 4), ("g", 101.0, 5)], "key string, at double, id int")
    assert {r.id: r.value for r in caches.blocked_hosts(asked, known).collect()} == {1: True, 2: True, 3: None, 4: None, 5: None}


def test_anchors_are_read_once():
    for page in ("<a href=x>" * 20_000, "<b>" * 20_000 + "</i>" * 20_000, "<p><a href=x>t" * 10_000):
        began = time.perf_counter()
        html.anchors(page)
        assert time.perf_counter() - began < 10


def test_links_of_a_domain(spark):
    page = "<a href=/1>one</a><a href='https://b.example/2' title=T rel='a b'>two</a><a href=/3>three</a>"
    table = spark.createDataFrame([(1, "https://a.example/", page)], "page_id long, url string, html string")
    assert [(r.url, r.title, r.rel, r.same_domain) for r in crawl.links(table, start_domain="b.example").orderBy("pos").collect()] == [
        ("https://a.example/1", "", [], False), ("https://b.example/2", "T", ["a", "b"], True), ("https://a.example/3", "", [], False)]
    assert [r.url for r in crawl.links(table, same_domain_only=True, max_links=1).collect()] == ["https://a.example/1"]


def test_sql_names(spark):
    html.register(spark)
    assert spark.sql("SELECT page_markdown('<h1>a</h1>') AS m, response_kind('[1]') AS k, size(page_anchors('<a href=x>')) AS n").first()[:] == ("# a", "json", 1)


def test_toc_without_headings(spark):
    assert column(spark, ["plain text"], markdown.toc)[0].startswith("# 📍 页面无结构化标题 (总字数: 10 字符)")


def test_stream_sessions(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:20:00"), (1, "2024-01-01 02:00:00"), (2, "2024-01-01 00:00:00"), (3, "2024-01-03 00:00:00")]
    spark.createDataFrame(rows, "user_id long, ts string").select("user_id", F.col("ts").cast("timestamp").alias("ts")).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "in"))
    audit.append_sink(audit.sessions(source), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted((r.user_id, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 1), (1, 2), (2, 1)]
