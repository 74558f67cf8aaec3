import duckdb

from webloom.functions import html
from webloom.operators import crawl
from webloom.plans import catalogue


def test_render():
    md = html.to_markdown("<nav>skip</nav><main><h1>Specs</h1><p>a <b>b</b> <a href='/api'>API</a></p><table><tr><th>x</th><th>y</th></tr><tr><td>1</td><td>35ms</td></tr></table><pre>pip install\n  x</pre><p style='display: none'>no</p><ul><li>i</li></ul></main>")
    for part in ("# Specs", "**b**", "[API](/api)", "| 1 | 35ms |", "```\npip install\n  x\n```", "- i"):
        assert part in md
    assert "skip" not in md and "no" not in md.replace("none", "")


def test_select_and_adapt():
    page = "<div id=a class='x y'><p>1</p><span><p>2</p></span></div><p data-k='v'>3</p>"
    assert html.select(page, ["#a > p"])[0] == "<p>1</p>"
    assert html.select(page, [".x p", "[data-k=v]"])[0].count("<p") == 3
    assert html.select(page, ["a:hover", ".none"]) == (page, [], ["a:hover"])
    assert html.adapt('{"a": 1}')[0] == "json" and html.adapt("<rss><item><title>T</title></item></rss>")[1].endswith("- T")
    assert html.adapt("two\nlines") == ("plain", "two\nlines")


def test_selected_as_the_page_spells_it():
    page = """<article>\n<H1 title="a&amp;b">x &amp;&am<!-- c --> <b>&quot;y</H1>\n<p>1<p>2<br/>&copy;</p><i>3</article><p>4"""
    assert html.select(page, ["article > h1"])[0] == """<H1 title="a&amp;b">x &amp;&am<!-- c --> <b>&quot;y</H1>"""
    assert html.select(page, ["p"])[0] == "<p>1</p>\n<p>2<br/>&copy;</p>\n<p>4</p>"
    assert html.select(page, ["b", "i", "br"])[0] == "<b>&quot;y</b>\n<i>3</i>\n<br/>"
    assert html.select(page, ["article"])[0] == page[: page.index("<p>4")]


def test_select_reads_the_whole_page():
    page = "<p>x</p>" * (html.MAX_CHARS // 8 + 1) + "<article><h1>late</h1></article>"
    assert html.select(page, ["article > h1"]) == ("<h1>late</h1>", ["article > h1"], [])


def test_page_selected_with_cut_references(spark, tmp_path):
    heads = ["a &amp;&amp", "&quot;b&am", "c  &copy; \n d", "<b>e</b> &"]
    spark.createDataFrame([(i, f"<body><article><h1>{h}</h1><p>x</p></article>") for i, h in enumerate(heads)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = catalogue.queries()["page_selected"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(catalogue.oracle_sql()["page_selected"]).fetchall())


def test_robust():
    assert html.to_markdown(None) == html.to_markdown("") == html.EMPTY
    assert html.to_markdown("<div>" * 10000 + "deep") == "deep"
    assert isinstance(html.to_markdown("<p>" + "<div class='x'>word</div>" * 60000), str)


def test_anchors(spark):
    page = """<a href="/d">Two <b>words</b></a><a href='/s'>one</a><A class=x HREF=/u>un</A><a href="/q?a=1&amp;b=2">A &amp; B</a><!-- <a href="/no">c</a> -->
    <script>x = '<a href="/js">j</a>'</script><ul><li><a href=/open>open</li><li>after</li></ul><a name="n">none</a><a href="">e</a><a href="#f">f</a><a href='MAILTO:a@b'>m</a><a href = " /d ">again</a>"""
    got = crawl.links(spark.createDataFrame([(1, "https://x.com/p", page), (2, "https://x.com/", None)], "page_id long, url string, html string")).orderBy("pos").collect()
    want = [("d", "Two words"), ("s", "one"), ("u", "un"), ("q?a=1&b=2", "A & B"), ("open", "open")]
    assert [(r.url, r.text) for r in got] == [(f"https://x.com/{u}", x) for u, x in want]
    assert html.anchors("<p>" * 800_000 + "<a href=/end>" + "long " * 100)[0] == {"href": "/end", "label": ("long " * 100)[:200], "title": "", "rel": []}


def test_structured_data_keeps_all_documents(spark, tmp_path):
    data = [(1, "s", "before </script> after"), (2, "s", "plain")]
    spark.createDataFrame(data, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalogue.queries()["structured_data"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.body) for r in got) == [(d, f"# {s}\n\n{x}") for d, s, x in data]
