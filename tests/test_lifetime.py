"""Leases, seen keys and caches that end by time: with timers in event time, and by the clock."""

import datetime
import random
import time
import uuid

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from webloom.streaming import lifetime, replay

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def run(spark, tmp_path, slices, schema, build, mode, live=0.0):
    """(rows, rows in the state store after each batch) of a stream over slices, one a batch; `live`: by the clock, with so many seconds between them."""
    base = f"{tmp_path}/{uuid.uuid4().hex}"
    for k, rows in enumerate(slices):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/in/{k}")
    got = []

    def keep(batch, batch_id):
        if batch_id == 1:
            time.sleep(live)
        got.extend(batch.collect())

    with lifetime.rocksdb(spark):
        stream = build(replay.replayed(spark, f"{base}/in", spark.read.parquet(f"{base}/in/0").schema))
        q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/c").trigger(**({"processingTime": "1 second"} if live else {"availableNow": True})).start()
        if live:  # a stream by the clock has always another batch to run
            q.awaitTermination(25)
            q.stop()
        else:
            q.awaitTermination()
    return got, [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]


LEASE = "job_id long, url string, ts timestamp, id long, kind string"


def test_lease_ends_without_another_event(spark, tmp_path):
    early = [(1, "a", at(0), 1, "enqueue"), (1, "a", at(1), 2, "lease"), (1, "b", at(0), 3, "enqueue"), (1, "b", at(2), 4, "lease"), (1, "b", at(9), 5, "fetched"), (1, "c", at(1), 6, "lease")]
    later = [(1, "z", at(100), 7, "enqueue"), (1, "y", at(100), 8, "enqueue"), (1, "y", at(101), 9, "lease"), (2, "a", at(101), 10, "enqueue")]
    end = [(1, "z", at(109), 11, "enqueue")]
    before = lifetime.PROVIDER, spark.conf.get(lifetime.PROVIDER)
    got, _ = run(spark, tmp_path, [early, later, end], LEASE, lambda s: lifetime.leases(s, 10.0), "update")
    assert spark.conf.get(before[0]) == before[1]
    last = {}
    for r in sorted(got, key=lambda r: r.version):
        last[r.job_id, r.url] = (r.status, r.retry_count, r.n_expired)
    assert last == {(1, "a"): ("queued", 0, 1), (1, "b"): ("fetched", 0, 0), (1, "c"): ("none", 0, 0), (1, "z"): ("queued", 0, 0), (1, "y"): ("in_progress", 0, 0), (2, "a"): ("queued", 0, 0)}
    assert [(r.status, r.version) for r in got if r.url == "a" and r.job_id == 1] == [("in_progress", 1), ("queued", 2)]


def test_lease_is_taken_again_after_its_time_and_fails(spark, tmp_path):
    rows = [(1, "a", at(0), 1, "enqueue"), (1, "a", at(1), 2, "lease"), (1, "a", at(50), 3, "lease"), (1, "a", at(55), 4, "failed"), (1, "a", at(55.5), 5, "lease"), (1, "a", at(58), 6, "lease")]
    got, _ = run(spark, tmp_path, [rows[:2], rows[2:]], LEASE, lambda s: lifetime.leases(s, 10.0), "update")
    # the first lease ended by its time, in the batch that shows it; the second failed, and what came before its 2 s were over was refused
    assert max((r.version, r.status, r.retry_count, r.n_expired) for r in got)[1:] == ("in_progress", 1, 1)


def seen(rows, ttl):
    last, out = {}, []
    for ts, i, key in sorted(rows):
        if key not in last or ts - last[key] > ttl:
            last[key] = ts
            out.append(i)
    return out


def test_first_within_and_bounded_state(spark, tmp_path):
    r = random.Random(4)
    rows = [(t * 1.5, i, r.choice("ab") if t < 200 else f"k{t}") for i, t in enumerate(sorted(r.randrange(400) for _ in range(600)))]
    slices = [[(at(t), i, k) for t, i, k in rows[a : a + 100]] for a in range(0, 600, 100)]
    for part in slices:
        r.shuffle(part)
    got, sizes = run(spark, tmp_path, slices, "ts timestamp, id long, key string", lambda s: lifetime.first_within(s, ["key"], 20.0, "id"), "append")
    assert sorted(x.id for x in got) == sorted(seen(rows, 20.0))
    # one value, one timer and its index for each key of the last batch or so: not for the 160 keys seen in all
    assert len({k for _, _, k in rows}) > 150 and sizes[-1] < 3 * 80


def test_cache(spark, tmp_path):
    r = random.Random(9)
    rows = [(t, i, i % 3, r.choice("pqr"), r.choice([None, None, f"v{i}"])) for i, t in enumerate(sorted(r.randrange(3000) / 4 for _ in range(500)))]
    want, held = {}, {}
    for t, i, key, name, value in rows:
        if value is not None:
            held[key, name] = (value, t)
        else:
            v, when = held.get((key, name), (None, -1e9))
            want[i] = v if t - when <= 5.0 else None
    slices = [[(key, name, at(t), i, value) for t, i, key, name, value in rows[a : a + 125]] for a in range(0, 500, 125)]
    got, sizes = run(spark, tmp_path, slices, "key long, name string, ts timestamp, id long, value string", lambda s: lifetime.cached(s, 5.0), "append")
    assert {x.id: x.value for x in got} == want and any(want.values()) and not all(want.values())
    assert max(sizes) <= 3 * 3 + 3 * 2


def test_live_cache_forgets_by_the_clock(spark, tmp_path):
    slices = [[(1, "a", 1, "x"), (1, "a", 2, None), (1, "b", 3, None)], [(1, "a", 4, None), (1, "c", 5, "y"), (1, "c", 6, None)]]
    got, _ = run(spark, tmp_path, slices, "key long, name string, id long, value string", lambda s: lifetime.cached_live(s, 0.5), "append", live=3.0)
    assert {x.id: x.value for x in got} == {2: "x", 3: None, 4: None, 6: "y"}


@pytest.mark.parametrize("slices", [1, 3])
def test_time_slices(spark, tmp_path, slices):
    events = spark.range(50).select(F.col("id"), (F.lit(1_700_000_000) + F.col("id") * 7 % 50).cast("timestamp").alias("ts"))
    replay.time_slices(events, f"{tmp_path}/s", slices)
    back = spark.read.parquet(f"{tmp_path}/s/*").withColumn("file", F.col("_metadata.file_path"))
    assert back.count() == 50
    spans = sorted((r.low, r.high) for r in back.groupBy("file").agg(F.min("ts").alias("low"), F.max("ts").alias("high")).collect())
    assert len(spans) == slices and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_large_slices_have_many_files_and_stay_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(replay, "FILE_ROWS", 100, raising=False)
    events = spark.range(2000).select(F.col("id"), (F.lit(1_700_000_000) + F.col("id") * 7 % 2000).cast("timestamp").alias("ts"))
    files = replay.time_slices(events, f"{tmp_path}/s", 4)
    assert files >= 4
    back = spark.read.parquet(f"{tmp_path}/s/*").select(F.col("_metadata.file_path").alias("file"))
    assert back.distinct().count() == 4 * files
    seen = []
    q = replay.replayed(spark, f"{tmp_path}/s", events.schema, files).writeStream.foreachBatch(lambda b, i: seen.append(b.agg(F.min("ts"), F.max("ts"), F.count("*")).first())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(seen) == 4 and sum(x[2] for x in seen) == 2000 and all(a[1] < b[0] for a, b in zip(seen, seen[1:]))


class Told:
    """A handle and a value state in one, which counts what is asked of them."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, *_):
        return self

    def __getattr__(self, name):
        def call(*given):
            self.calls += 1
            if name == "update":
                self.value = given[0]
            if name == "registerTimer":
                self.timers.add(given[0])
            if name == "deleteTimer":
                self.timers.remove(given[0])
            return {"get": self.value, "exists": self.value is not None, "listTimers": iter(sorted(self.timers))}.get(name)

        return call


def test_a_batch_of_a_request_asks_little_of_the_store():
    row = Row("at", "id", "kind")
    lease, told = lifetime.Leases(10.0, 2), Told()
    lease.init(told)
    batches = [([row(0.0, 1, "enqueue"), row(1.0, 2, "lease")], {11001}, 3), ([row(2.0, 3, "lease")], {11001}, 2), ([row(20.0, 4, "lease")], {30001}, 4), ([row(21.0, 5, "fetched")], set(), 3), ([row(22.0, 6, "lease")], set(), 2)]
    for rows, timers, most in batches:
        before = told.calls
        list(lease.handleInputRows((1, "a"), iter(rows), None))
        assert told.timers == timers and told.calls - before <= most
    assert told.value[0] == "fetched" and told.value[4:] == (1, 5)
