from __future__ import annotations

import random

from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.streaming import feeds
from tidemark.streaming.jobs import CACHE_MS, Job, job_answers, undelivered
from tidemark.streaming.leases import TTL_MS, Lease, lease_events, replay
from tidemark.streaming.runner import run_available, stream_table


def test_lease_script():
    got = replay([(1, 0, "request", "a", 0), (2, 1, "request", "b", 1), (3, 2, "request", "c", 0), (4, 3, "request", "b", 1), (5, 4, "release", "a", 0), (6, 5, "release", "x", 0), (7, 6, "renew", "c", 0), (8, 7, "renew", "b", 0)])
    assert [(s, e, a) for s, _, e, a in got] == [
        (1, "granted", "a"), (2, "queued", "b"), (3, "queued", "c"), (4, "waiting", "b"), (5, "released", "a"), (5, "promoted", "c"), (6, "ignored", "x"), (7, "renewed", "c"), (8, "refused", "b")]


def test_lease_expiry_and_stale_waiters():
    lease = Lease()
    lease.apply("request", "a", 0, 0, 1)
    lease.apply("request", "b", 10, 0, 2)
    assert lease.sweep(TTL_MS - 1) == []
    assert lease.sweep(TTL_MS) == [("expired", "a"), ("promoted", "b")]
    late = Lease()
    late.apply("request", "a", 0, 0, 1)
    late.apply("request", "b", 0, 0, 2)
    late.expires = 3 * TTL_MS
    assert late.sweep(3 * TTL_MS) == [("expired", "a"), ("stale", "b")] and late.holder is None


def _requests(n=120, seed=4):
    rng = random.Random(seed)
    return [(rng.choice("fg"), i, 10**12 + i * 1000, rng.choice(["request", "request", "release", "renew"]), rng.choice("abc"), rng.randrange(2)) for i in range(n)]


def test_lease_stream_equals_fold(spark, tmp_path):
    req = _requests()
    df = spark.createDataFrame(req, "file string, seq long, at long, kind string, agent string, priority int").withColumn("ts", F.timestamp_millis("at"))
    for k in range(3):  # three files in order of time
        df.where(f"seq >= {k * 40} AND seq < {k * 40 + 40}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = run_available(lease_events(stream_table(spark, str(tmp_path / "in"), 1)), "append").where("seq >= 0")
    want = [(f, s, at, e, a) for f in "fg" for s, at, e, a in replay([r[1:3] + r[3:5] + (r[5],) for r in req if r[0] == f])]
    assert rows(got.select("file", "seq", "at", "event", "agent")) == sorted(want, key=repr)


def test_job_queue(spark, tmp_path):
    steps = [("request", 0, "x", "queued"), ("request", 1, "x", "coalesced"), ("start", 2, "", "started"), ("request", 3, "x", "joined"), ("crash", 4, "", "requeued"), ("start", 5, "", "started"),
             ("success", 6, "x", "done"), ("request", 7, "x", "cached"), ("request", 8, "y", "queued"), ("request", 7 + CACHE_MS, "x", "coalesced"), ("start", 8 + CACHE_MS, "", "started"),
             ("crash", 9 + CACHE_MS, "", "requeued"), ("start", 10 + CACHE_MS, "", "started"), ("crash", 11 + CACHE_MS, "", "failed"), ("success", 12 + CACHE_MS, "", "ignored")]
    job = Job()
    assert [job.apply(k, at, f) for k, at, f, _ in steps] == [w for *_, w in steps]
    df = spark.createDataFrame([("j", i, at, k, "me", f) for i, (k, at, f, _) in enumerate(steps)], "job string, seq long, at long, kind string, requester string, fingerprint string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = run_available(job_answers(stream_table(spark, str(tmp_path / "in"))), "append")
    assert [r["answer"] for r in out.orderBy("seq").collect()] == [w for *_, w in steps]
    assert undelivered(out, out.where("seq < 14")).count() == 1


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    src, folder = str(tmp_path / "in"), str(tmp_path / "run")
    spark.range(3).write.mode("append").parquet(src)
    assert run_available(stream_table(spark, src), "append", folder).count() == 3
    spark.range(3, 5).write.mode("append").parquet(src)
    assert rows(run_available(stream_table(spark, src), "append", folder)) == [(i,) for i in range(5)]


def test_late_row_merges_two_sessions(spark, tmp_path):
    src = str(tmp_path / "in")
    base = 1_700_000_000_000
    call = lambda *ms: spark.createDataFrame([(base + m, "@A") for m in ms], "ts long, agent string").coalesce(1)
    call(0, 3_000_000).write.mode("append").parquet(src)
    call(1_500_000).write.mode("append").parquet(src)
    out = run_available(feeds.stream_sessions(stream_table(spark, src, 1)), "complete")
    assert [(r["handle"], r["n"]) for r in out.collect()] == [("a", 3)]


def test_tail_drops_noise_and_copies(spark):
    f = spark.createDataFrame([(1, 1_700_000_000, "commit"), (1, 1_700_000_000, "commit"), (2, 1_700_000_000, "lock_queued"), (0, 1_700_000_000, "commit"), (3, None, "commit")], "id long, timestamp long, event_type string")
    assert [r["id"] for r in feeds.tail(f, 0).collect()] == [1]


def test_wait_for():
    ticks = iter(range(100))
    assert feeds.wait_for(lambda: next(ticks) == 3, 1, 10, sleep=lambda s: None, clock=lambda: 0)
    t = [0.0]
    assert not feeds.wait_for(lambda: False, 3, 10, sleep=lambda s: t.__setitem__(0, t[0] + s), clock=lambda: t[0]) and t[0] == 9
