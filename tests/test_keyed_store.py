"""A store that slices of changes move on against the same changes in a dict."""

import random

import pytest
from pyspark.sql import functions as F

from webloom.operators.keyed_store import KeyedStore

SCHEMA = "k string, part int, n long, note string"


def rows_of(df):
    return sorted(((r.k, r.part, r.n, r.note) for r in df.collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


ADD = {"n": lambda known, old, new: F.when(known, old + new).otherwise(new), "note": lambda known, old, new: F.coalesce(F.nullif(new, F.lit("")), old)}


def test_slices_against_a_dict(spark, tmp_path):
    draw = random.Random(5)
    state = {(f"k{i}" if i else None, i % 3): (i, "first") for i in range(60)}
    store = KeyedStore.create(table(spark, [(*k, *v) for k, v in state.items()]), str(tmp_path / "s"), ["k", "part"], 16)
    for step in range(6):
        keys = draw.sample(range(80), 15)
        changes = [(f"k{i}" if i else None, i % 3, draw.randrange(9), draw.choice(["", "new"])) for i in keys]
        gone = {c[:2] for c in changes if c[2] == 0}
        assert store.apply(table(spark, changes), ADD if step % 2 else None, F.col("n") == 0) == (step % 3) + 1
        for k, part, n, note in changes:
            old = state.get((k, part))
            if (k, part) in gone:
                state.pop((k, part), None)
            elif old and step % 2:
                state[(k, part)] = (old[0] + n, note or old[1])
            elif step % 2:
                state[(k, part)] = (n, note or None)
            else:
                state[(k, part)] = (n, note)
        want = sorted(((*k, *v) for k, v in state.items()), key=repr)
        assert rows_of(store.read()) == want
        again = KeyedStore.open(spark, str(tmp_path / "s"))
        asked = table(spark, [(None, 0, 0, ""), ("k5", 2, 0, ""), ("k5", 2, 0, ""), ("none", 0, 0, "")])
        assert rows_of(again.lookup(asked)) == [w for w in want if w[:2] in ((None, 0), ("k5", 2))]
        if step == 2:
            assert store.due(0.0) and store.compact() == 1 and rows_of(store.read()) == want and not store.due()


def test_changes_read_and_write_their_buckets_only(spark, tmp_path):
    store = KeyedStore.create(table(spark, [(f"k{i}", 0, i, "") for i in range(2000)]), str(tmp_path / "s"), ["k"], 64)
    few = table(spark, [("k7", 0, 1, "x"), ("k8", 0, 1, "x")])
    buckets = store.buckets_of(few)
    assert 1 <= len(buckets) <= 2
    store.apply(few, ADD)
    plan = store.lookup(few)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan and all(str(b) in plan for b in buckets)
    written = {p.name for p in (tmp_path / "s" / "gen=0" / "slice=1").glob("bucket=*")}
    assert written == {f"bucket={b}" for b in buckets}
    spoilt = [p for p in (tmp_path / "s" / "gen=0" / "slice=0").glob("bucket=*/*.parquet") if int(p.parent.name[7:]) not in buckets]
    for p in spoilt:
        p.write_bytes(b"spoilt")  # a read of any other bucket fails
    for p in (tmp_path / "s" / "gen=0" / "slice=0").glob("bucket=*/.*.crc"):
        p.unlink()
    assert rows_of(store.lookup(few)) == [("k7", 0, 8, "x"), ("k8", 0, 9, "x")]
    store.apply(few, ADD)
    assert rows_of(store.lookup(few)) == [("k7", 0, 9, "x"), ("k8", 0, 10, "x")]


def test_a_slice_that_breaks_off_changes_nothing(spark, tmp_path):
    store = KeyedStore.create(table(spark, [("a", 0, 1, "")]), str(tmp_path / "s"), ["k"], 4)
    with pytest.raises(Exception, match="several changes of one key: b"):
        store.apply(table(spark, [("b", 0, 1, ""), ("b", 0, 2, "")]))
    assert rows_of(store.read()) == [("a", 0, 1, "")] and store.version() == (0, [0])
    assert store.apply(table(spark, [("b", 0, 3, "")])) == 1 and rows_of(store.read()) == [("a", 0, 1, ""), ("b", 0, 3, "")]
    assert store.apply(table(spark, [])) == 2 and len(rows_of(store.read())) == 2
    (tmp_path / "s" / "gen=1" / "slice=0").mkdir(parents=True)  # a compaction that broke off
    assert store.version()[0] == 0 and store.compact() == 1 and len(rows_of(store.read())) == 2
    with pytest.raises(ValueError, match="itself"):
        KeyedStore.create(spark.range(1).withColumn("slice", F.lit(1)), str(tmp_path / "t"), ["id"])
    with pytest.raises(Exception, match="(?i)exists"):
        KeyedStore.create(table(spark, []), str(tmp_path / "s"), ["k"])


def test_an_empty_store(spark, tmp_path):
    store = KeyedStore.create(table(spark, []), str(tmp_path / "s"), ["k"], 4)
    assert store.read().count() == 0 and store.lookup(table(spark, [("a", 0, 1, "")])).count() == 0
    store.apply(table(spark, [("a", 0, 1, "x")]), ADD)
    assert rows_of(store.read()) == [("a", 0, 1, "x")]
