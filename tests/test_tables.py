"""Table functions called from SQL."""

import pytest

from webloom.functions import tables


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    tables.register(spark)


def test_chunks(spark):
    got = [tuple(r) for r in spark.sql("SELECT d.i, c.* FROM VALUES (1, 'abcdé'), (2, ''), (3, NULL) AS d(i, t), LATERAL text_chunks(d.t, 2) c ORDER BY 1, 2").collect()]
    assert got == [(1, 1, 3, 0, 2, "ab"), (1, 2, 3, 2, 4, "cd"), (1, 3, 3, 4, 5, "é"), (2, 1, 1, 0, 0, "")]
    assert spark.sql("SELECT * FROM text_chunks('abc')").first().body == "abc"


def test_anchors(spark):
    page = "<p><a href=/x title=T rel='a b'>one <b>two</b></a><!-- <a href=/no>no</a> --><a href='/y?a=1&amp;b=2'></a></p>"
    got = spark.sql("SELECT pos, href, label, title, rel FROM {p} p, LATERAL page_anchor_rows(p.html) ORDER BY pos", p=spark.createDataFrame([(page,), (None,)], "html string")).collect()
    assert [(r.pos, r.href, r.label, r.title, r.rel) for r in got] == [(1, "/x", "one two", "T", ["a", "b"]), (2, "/y?a=1&b=2", "", "", [])]


def test_citations(spark):
    text = "[a  b](/x) ![i](/i.png) [t](#t) [m](mailto:x) [c](/y \"q\") [d](/z)"
    got = spark.sql("SELECT c.* FROM {p} p, LATERAL markdown_citations(p.t, 2) c ORDER BY pos", p=spark.createDataFrame([(text,), (None,)], "t string")).collect()
    assert [tuple(r) for r in got] == [(1, "a b", "/x"), (2, "c", "/y")]


@pytest.mark.parametrize("call", ["text_chunks('a', 0)", "text_chunks('a', 'x')", "markdown_citations('a', -1)"])
def test_sizes_are_checked_when_analysed(spark, call):
    with pytest.raises(Exception, match="positive constant"):
        spark.sql(f"SELECT * FROM {call}")
