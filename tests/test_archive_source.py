"""The archive's data source: round trips, conditions that reach it, keys of a table, commits as a stream."""

import os

import pytest
from pyspark.sql import functions as F

from webloom.sources import archive, archive_source

IDS = ["plain", "a/b/../c", "x.BLOCKED", ".hidden", "_under", "ü 1%2F", "", "it's"]


def rows_of(df):
    return sorted((r.raw_id, r.blocked, r.text) for r in df.select("raw_id", "blocked", "text").collect())


def documents(spark, ids, blocked=False, mark=""):
    rows = [(i, blocked, f"---\ntitle: t{k}{mark}\n---\n\nbödy {i}\n") for k, i in enumerate(ids)]
    return spark.createDataFrame(rows, "raw_id string, blocked boolean, text string"), sorted(rows)


@pytest.mark.parametrize("digits", [0, 2])
def test_round_trip_of_any_id(spark, tmp_path, digits):
    folder = str(tmp_path / "a")
    docs, rows = documents(spark, IDS)
    archive_source.write(docs, folder, digits)
    assert rows_of(archive_source.read(spark, folder)) == rows
    assert rows_of(archive_source.read(spark, "file://" + folder, tasks="1")) == rows
    heads = archive_source.read(spark, folder, "head").select("raw_id", "size", archive.frontmatter(F.col("text"))["title"].alias("title"), F.col("text").contains("bödy").alias("more"))
    assert sorted((r.raw_id, r.title, r.more) for r in heads.collect()) == sorted((i, f"t{k}", False) for k, i in enumerate(IDS))
    listed = archive_source.read(spark, folder, "list").collect()
    assert {r.text for r in listed} == {None} and {(r.raw_id, r["size"]) for r in listed} == {(i, len(t.encode())) for i, _, t in rows}




def test_conditions_reach_the_source(spark, tmp_path):
    folder = str(tmp_path / "a")
    open_ones, rows = documents(spark, [f"d{k}" for k in range(40)])
    shut, blocked = documents(spark, [f"d{k}" for k in range(0, 40, 4)], True)
    archive_source.write(open_ones, folder)
    archive_source.write(shut, folder)
    want = [r for r in rows + blocked if r[0] in ("d4", "d7")]
    for condition, right in (
        (F.col("raw_id").isin("d4", "d7", "none"), want), ((F.col("raw_id") == "d4") & F.col("raw_id").isin("d4", "d7"), [r for r in want if r[0] == "d4"]),
        (F.col("blocked"), blocked), ((F.col("raw_id") == "d4") & ~F.col("blocked"), [r for r in rows if r[0] == "d4"]), (F.col("raw_id").startswith("d3"), [r for r in rows + blocked if r[0].startswith("d3")]),
        (F.col("raw_id").isNull(), []), (F.col("raw_id") == "none", []),
    ):
        assert rows_of(archive_source.read(spark, folder).filter(condition)) == sorted(right)
    read = archive_source.ArchiveReader(folder, "text", 8)
    left = list(read.pushFilters([archive_source.In(("raw_id",), ("d4", "d7")), archive_source.EqualTo(("blocked",), False), archive_source.EqualTo(("size",), 3)]))
    assert [f.attribute for f in left] == [("size",)]
    parts = read.partitions()
    assert len(parts) == 1 and len(parts[0].paths) == 2 and not parts[0].shards
    plan = archive_source.read(spark, folder).filter(F.col("raw_id").isin("d4", "d7"))._jdf.queryExecution().executedPlan().toString()
    assert ") Filter " not in plan


def test_keys_of_a_table(spark, tmp_path):
    folder = str(tmp_path / "a")
    docs, rows = documents(spark, [f"d{k}" for k in range(50)])
    archive_source.write(docs, folder, 1)
    keys = spark.createDataFrame([("d3",), ("d3",), (None,), ("gone",), ("d49",)], "raw_id string")
    assert rows_of(archive_source.read_keys(keys, folder)) == sorted(r for r in rows if r[0] in ("d3", "d49"))
    assert archive_source.read_keys(keys, str(tmp_path / "none")).count() == 0
    assert archive_source.read(spark, str(tmp_path / "none")).count() == 0


def test_stream_takes_each_commit_once(spark, tmp_path):
    folder, out, at = (str(tmp_path / n) for n in ("a", "rows", "at"))

    def run():
        archive_source.read_stream(spark, folder).writeStream.format("parquet").option("checkpointLocation", at).trigger(availableNow=True).start(out).awaitTermination()
        return rows_of(spark.read.schema(archive_source.SCHEMA).parquet(out))

    first, rows = documents(spark, ["a", "b"])
    archive_source.write(first, folder)
    assert run() == rows and run() == rows
    again, more = documents(spark, ["b", "c"], mark="x")
    archive_source.write(again, folder)
    archive_source.write(documents(spark, [])[0], folder)
    assert run() == sorted(rows + more)
    assert rows_of(archive_source.read(spark, folder)) == sorted([rows[0], *more])


def test_what_is_refused(spark, tmp_path):
    folder = str(tmp_path / "a")
    docs, _ = documents(spark, ["a"])
    archive_source.write(docs, folder)
    nameless = spark.createDataFrame([("b", False, "t"), (None, False, "t")], "raw_id string, blocked boolean, text string").coalesce(1)
    with pytest.raises(Exception, match="without raw_id"):
        archive_source.write(nameless, folder)
    with pytest.raises(Exception, match="added to"):
        docs.write.format(archive_source.FORMAT).mode("overwrite").save(folder)
    with pytest.raises(Exception, match="list, head or text"):
        archive_source.read(spark, folder, "body").collect()
    assert archive_source._commits(*archive_source.opened(folder)) == 1
    assert not [n for _, _, names in os.walk(folder) for n in names if n.startswith("_")]
