"""Sitemaps and feeds read as records against the same texts parsed whole."""

import gzip

import pytest
from pyspark.sql import functions as F

from webloom.sources import site_index

MAPS = {
    "plain.xml": "<?xml version='1.0'?>\n<urlset xmlns='x'>" + "".join(f"<url><lastmod>2024</lastmod><loc> /p/{k}?a=1&amp;b={k} </loc></url>\n" for k in range(3000)) + "</urlset>",
    "prefixed.xml": "﻿<!-- <x> --><s:urlset><s:url><s:loc>/a</s:loc></s:url><s:url><S:LOC ><![CDATA[https://site.example/b]]></S:LOC ></s:url><s:url><s:loc>/a</s:loc></s:url></s:urlset>",
    "index.xml": "<sitemapindex><sitemap><loc>maps/1.xml</loc></sitemap><sitemap><loc></loc></sitemap></sitemapindex>",
    "cut.xml": "<urlset><url><loc>/whole</loc></url><url><loc>/cut-o",
    "other.xml": "<html><loc>/no</loc></html>",
    "empty.xml": "",
}
FEEDS = {
    "rss": {"a.xml": "<rss><channel><link>/home</link>" + "".join(f"<item><title>t</title><link>/i/{k}</link></item>" for k in range(2000)) + "</channel></rss>", "b.xml": "<feed><entry><link href='/e'/></entry></feed>", "c.xml": "<rss><item><link>/cut</link>"},
    "atom": {"a.xml": "<feed><link href='/self'/>" + "".join(f"<entry><link rel='alternate' href='/e/{k}'/><id>{k}</id></entry>" for k in range(2000)) + "</feed>", "b.xml": "<rss><item><link>/x</link></item></rss>"},
}


def url_of(file):
    return F.concat(F.lit("https://site.example/maps/"), F.regexp_extract(file, r"([^/]+)$", 1))


def whole(spark, texts):
    rows = [(f"https://site.example/maps/{name}", text.replace("﻿", "")) for name, text in texts.items()]
    return site_index.parse_index(spark.createDataFrame(rows, "doc_url string, body string").withColumn("base_url", F.col("doc_url")))


def listed(df):
    """(doc, kind, url) in the order of each document."""
    rows = sorted(((r.doc_url, r.kind, r.pos, r.url) for r in df.collect()), key=lambda r: (r[0], tuple(r[2]) if isinstance(r[2], tuple) else r[2]))
    return [(d, k, u) for d, k, _, u in rows]


@pytest.fixture(params=["whole", "splits"])
def split(request, spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if request.param == "splits":
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7001")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield request.param
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_sitemaps(spark, tmp_path, split):
    for name, text in MAPS.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    got = site_index.sitemap_records(spark, str(tmp_path), url_of)
    assert listed(got) == listed(whole(spark, MAPS))
    rows = site_index._records(spark, str(tmp_path), "</")
    assert (rows.rdd.getNumPartitions() > 8) == (split == "splits")
    assert rows.agg(F.max(F.length("record"))).first()[0] < 100


def test_packed_sitemaps_and_scopes(spark, tmp_path):
    with gzip.open(tmp_path / "plain.xml.gz", "wt") as f:
        f.write(MAPS["plain.xml"])
    assert site_index.sitemap_records(spark, str(tmp_path), url_of).count() == 3000
    inside = site_index.sitemap_records(spark, str(tmp_path), url_of, scope=lambda u: F.when(u.contains("/p/7?"), u).otherwise(""))
    assert [r.url for r in inside.collect()] == ["https://site.example/p/7?a=1&b=7"]
    based = site_index.sitemap_records(spark, [str(tmp_path / "plain.xml.gz")], url_of, lambda f: F.lit("https://other.example/"))
    assert based.filter("url LIKE 'https://other.example/p/%' AND doc_url LIKE 'https://site.example/%'").count() == 3000


@pytest.mark.parametrize("kind", ["rss", "atom"])
def test_feeds(spark, tmp_path, split, kind):
    for name, text in FEEDS[kind].items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    want = [r for r in listed(whole(spark, FEEDS[kind])) if r[1] == kind]
    assert len(want) == 2000 and listed(site_index.feed_records(spark, str(tmp_path), url_of, kind=kind)) == want
    with pytest.raises(ValueError, match="rss or atom"):
        site_index.feed_records(spark, str(tmp_path), url_of, kind="html")
