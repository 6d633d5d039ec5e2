"""Streams with keyed state: equal to batch over several batches and a restart, timers, one firing for each group."""

import time

from parcelspark.functions.shipping import ship
from parcelspark.operators.state import job_states
from parcelspark.streaming import keyed, limits

REQUESTS, JOBS, MEMBERS = "key string, seq long, ts_us long", "job_id long, status string, at_us long, seq long", "group_id long, member long, status string, expected long"
SECOND = limits.SECOND
DAY = 86_400


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    time.sleep(1.1)  # files are taken in order of their time, in seconds


def source(spark, folder, schema):
    ship(spark)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_several_batches_and_a_restart_decide_as_batch(spark, tmp_path):
    rows = [(f"k{i % 7 % 3}", i, 1_000_000 + i * 2_300_000) for i in range(600)]
    out = f"file://{tmp_path}/out"
    for lo in (0, 200):
        put(spark, tmp_path / "in", rows[lo : lo + 200], REQUESTS)
    keyed.limited_stream(source(spark, tmp_path / "in", REQUESTS), 5, 60, out)
    put(spark, tmp_path / "in", rows[400:], REQUESTS)
    got = keyed.limited_stream(source(spark, tmp_path / "in", REQUESTS), 5, 60, out)  # goes on after a stop
    want = limits.limited(spark.createDataFrame(rows, REQUESTS), 5, 60)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.where("limited").count() > 0 and len(list((tmp_path / "out" / "decided").glob("epoch=*"))) >= 3


def test_a_log_vanishes_without_a_request_of_its_key(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    put(spark, tmp_path / "in", [("old", 0, SECOND), ("young", 1, 9_000 * SECOND)], REQUESTS)
    put(spark, tmp_path / "in", [("new", 2, 9_500 * SECOND)], REQUESTS)
    keyed.limited_stream(source(spark, tmp_path / "in", REQUESTS), 1, 60, out, keep_seconds=3_600)
    assert {r.key for r in keyed.held_logs(spark, out).collect()} == {"young", "new"}


def test_late_requests_are_left_out(spark, tmp_path):
    """The watermark that a batch is held against is that of the batches before the last one."""
    for rows in ([("a", 0, 100 * SECOND)], [("a", 1, 150 * SECOND)], [("a", 2, 50 * SECOND), ("a", 3, 151 * SECOND)]):
        put(spark, tmp_path / "in", rows, REQUESTS)
    got = keyed.limited_stream(source(spark, tmp_path / "in", REQUESTS), 5, 60, f"file://{tmp_path}/out")
    assert {r.seq for r in got.collect()} == {0, 1, 3}


def test_entries_live_as_long_as_the_store_is_told(spark, tmp_path):
    """With a time to live by the clock, a key is let through again after it, whatever the times of its requests say."""
    out = f"file://{tmp_path}/out"
    put(spark, tmp_path / "in", [("a", 0, SECOND), ("a", 1, SECOND)], REQUESTS)
    first = keyed.limited_stream(source(spark, tmp_path / "in", REQUESTS), 1, 60, out, ttl_ms=1_000)
    assert {(r.seq, r.limited) for r in first.collect()} == {(0, False), (1, True)}
    put(spark, tmp_path / "in", [("a", 2, SECOND)], REQUESTS)
    got = keyed.limited_stream(source(spark, tmp_path / "in", REQUESTS), 1, 60, out, ttl_ms=1_000)
    assert {(r.seq, r.limited) for r in got.collect()} == {(0, False), (1, True), (2, False)}


def test_jobs_that_hang_fail_by_their_timer(spark, tmp_path):
    us = DAY * SECOND
    put(spark, tmp_path / "in", [(1, "processing", 10, 1), (2, "processing", 20, 2), (3, "pending", 30, 3)], JOBS)
    put(spark, tmp_path / "in", [(1, "completed", us // 2, 4), (4, "processing", us + 10 * SECOND, 5)], JOBS)
    got = {r.job_id: (r.status, r.by) for r in keyed.job_clock(source(spark, tmp_path / "in", JOBS), DAY, f"file://{tmp_path}/out").collect()}
    assert got == {1: ("completed", "event"), 2: ("failed", "timer"), 3: ("pending", "event"), 4: ("processing", "event")}


def test_job_histories_are_folded_as_in_batch(spark, tmp_path):
    states = ("pending", "processing", "completed", "failed", "processing")
    rows = [(i % 5, states[i % 7 % 5], 1_000_000 * (i + 1), i) for i in range(60)]
    for lo in (0, 25):
        put(spark, tmp_path / "in", rows[lo : lo + 25 if lo == 0 else 60], JOBS)
    got = keyed.job_clock(source(spark, tmp_path / "in", JOBS), DAY, f"file://{tmp_path}/out").drop("by")
    want = job_states(spark.createDataFrame(rows, JOBS))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_groups_fire_once_over_replays_and_restarts(spark, tmp_path):
    out, rows = f"file://{tmp_path}/out", [(1, 1, "completed", 2), (1, 2, "failed", 2), (2, 3, "completed", 2), (2, 4, "processing", 2)]
    put(spark, tmp_path / "in", rows, MEMBERS)
    put(spark, tmp_path / "in", rows, MEMBERS)  # the same rows again
    assert sorted(map(tuple, keyed.fired_once(source(spark, tmp_path / "in", MEMBERS), out).collect())) == [(1, 2)]
    put(spark, tmp_path / "in", [*rows, (2, 4, "cancelled", 2)], MEMBERS)
    assert sorted(map(tuple, keyed.fired_once(source(spark, tmp_path / "in", MEMBERS), out).collect())) == [(1, 2), (2, 2)]


def test_a_batch_that_runs_again_replaces_its_ledger(spark, tmp_path):
    """The last commit is taken back, as if the driver had been lost after the batch had written."""
    out = f"file://{tmp_path}/out"
    put(spark, tmp_path / "in", [(1, 1, "completed", 1)], MEMBERS)
    keyed.fired_once(source(spark, tmp_path / "in", MEMBERS), out)
    commits = tmp_path / "out" / "checkpoint" / "commits"
    for f in (*commits.glob("0"), *commits.glob(".0.crc")):
        f.unlink()
    assert sorted(map(tuple, keyed.fired_once(source(spark, tmp_path / "in", MEMBERS), out).collect())) == [(1, 1)]
