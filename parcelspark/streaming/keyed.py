"""Streams with state for each key: sliding logs that expire, jobs with a clock, groups that fire once.

State lies in Spark's RocksDB store, is changed key by key, and is checkpointed with the stream, so a batch touches its own
keys only, and a stream that is stopped or whose executors are lost goes on as if nothing had happened. Clocks are timers of
event time: they fire when the watermark passes them, without a row of their key.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from . import limits
from .limits import DECIDED, SECOND, decide

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
PARTITIONS = "spark.sql.shuffle.partitions"
ENDED = ("completed", "failed", "cancelled")


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, in no more partitions than two for each core, as each is a store
    of its own that every batch opens; a stream keeps the number it began with. Processors travel by value, as the driver's process that looks
    at their state before a stream starts doesn't have the sources that executors get."""
    modules, most = (sys.modules[__name__], limits), max(8, 2 * spark.sparkContext.defaultParallelism)
    before = {k: spark.conf.get(k) for k in (PROVIDER[0], PARTITIONS)}
    spark.conf.set(*PROVIDER)
    spark.conf.set(PARTITIONS, min(most, int(before[PARTITIONS])))
    for m in modules:
        cloudpickle.register_pickle_by_value(m)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        for m in modules:
            cloudpickle.unregister_pickle_by_value(m)


def _ordered(rows: Iterator[pd.DataFrame], *columns: str) -> list[np.ndarray]:
    """The columns of a key's rows in one micro-batch, in their order as sort keys."""
    parts = [p[list(columns)] for p in rows]
    every = (parts[0] if len(parts) == 1 else pd.concat(parts)).sort_values(list(columns[:2]), kind="stable")
    return [every[c].to_numpy() for c in columns]


class SlidingLog(StatefulProcessor):
    """State of a key: the times of its requests that were let through and may still count."""

    def __init__(self, limit: int, window_seconds: int, keep_seconds: int, ttl_ms: int | None = None):
        self.limit, self.window_seconds, self.keep_seconds, self.ttl_ms = limit, window_seconds, max(keep_seconds, window_seconds), ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.log = handle.getListState("log", "at_us long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        ts, seq = _ordered(rows, "ts_us", "seq")
        log = [x[0] for x in self.log.get()] if self.log.exists() else []
        out, log = decide(ts.tolist(), log, self.limit, self.window_seconds * SECOND)
        if log:
            self.log.put([(t,) for t in log])
            if self.ttl_ms is None:
                for t in [*self.handle.listTimers()]:
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(max(log) // 1000 + self.keep_seconds * 1000)
        yield pd.DataFrame({"key": key[0], "seq": seq, "ts_us": ts, "limited": [o[0] for o in out], "remaining": [o[1] for o in out], "reset": [o[2] for o in out]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.log.clear()
        yield from ()

    def close(self) -> None:
        pass


class JobClock(StatefulProcessor):
    """State of a block of jobs: for each its last status, when it began and ended, and the version of these. The block has
    one timer, for the first of its jobs that are processing; when it fires, those that are due have failed.

    Each access to state is a message to Spark, so it is for a block of jobs and not for each of them."""

    SCHEMA = "job_id long, version long, status string, started_us long, completed_us long, by string"
    #: Jobs of one block, which a task holds at once.
    BLOCK = 2048

    def __init__(self, timeout_seconds: int):
        self.timeout_us = timeout_seconds * SECOND

    def init(self, handle) -> None:
        self.handle = handle
        # a value of arrays goes by as one message, a list as one for each of its rows
        self.jobs = handle.getValueState("jobs", "job_id array<long>, version array<long>, status array<string>, at_us array<long>, seq array<long>, started_us array<long>, completed_us array<long>")

    def _held(self) -> dict:
        found = self.jobs.get() if self.jobs.exists() else None
        return {job: state for job, *state in zip(*found)} if found else {}

    def _due(self, state: tuple) -> int:
        return (state[2] + self.timeout_us) // 1000

    def _keep(self, held: dict) -> None:
        self.jobs.update((list(held), *map(list, zip(*held.values()))))
        for t in [*self.handle.listTimers()]:
            self.handle.deleteTimer(t)
        due = [self._due(state) for state in held.values() if state[1] == "processing"]
        if due:
            self.handle.registerTimer(min(due))

    @staticmethod
    def _rows(held: dict, changed: list, by: str) -> pd.DataFrame:
        version, status, _, _, started, completed = zip(*(held[job] for job in changed))
        whole = lambda values: pd.array(values, "Int64")
        return pd.DataFrame({"job_id": whole(changed), "version": version, "status": status, "started_us": whole(started), "completed_us": whole(completed), "by": by})

    def handleInputRows(self, key, rows, timerValues):
        held, changed = self._held(), {}
        columns = [x.tolist() for x in _ordered(rows, "at_us", "seq", "status", "job_id")]
        for at, seq, now, job in zip(*columns):
            job = None if key[0] is None else job  # jobs without a number have a block of their own
            version, status, last, last_seq, started, completed = held.get(job, (0, None, None, None, None, None))
            if now == "processing":
                started = at if started is None else min(started, at)
            elif now in ENDED:
                completed = at if completed is None else max(completed, at)
            if last is None or (at, seq) > (last, last_seq):
                status, last, last_seq = now, at, seq
            held[job] = (version + (job not in changed), status, last, last_seq, started, completed)
            changed[job] = True
        self._keep(held)
        yield self._rows(held, [*changed], "event")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held, now = self._held(), max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        failed = [job for job, state in held.items() if state[1] == "processing" and self._due(state) <= now]
        for job in failed:
            version, _, last, last_seq, started, _ = held[job]
            held[job] = (version + 1, "failed", last, last_seq, started, self._due(held[job]) * 1000)
        if failed:
            self._keep(held)
            yield self._rows(held, failed, "timer")

    def close(self) -> None:
        pass


class FireOnce(StatefulProcessor):
    """State of a block of groups: members that ended of those that haven't fired, and the groups that have. A group fires when
    all members that it should have ended, once, however often their rows come again."""

    SCHEMA = "group_id long, members long"
    #: Groups of one block; a task holds the ended members of them.
    BLOCK = 512

    def init(self, handle) -> None:
        self.ended = handle.getListState("ended", "group_id long, member long")
        self.fired = handle.getListState("fired", "group_id long")

    def handleInputRows(self, key, rows, timerValues):
        fired = {x[0] for x in self.fired.get()} if self.fired.exists() else set()
        expected, done = {}, {}
        for part in rows:
            group = [None] * len(part) if key[0] is None else part["group_id"].tolist()  # groups without a number have a block of their own
            own = {}
            for g, member, status, n in zip(group, part["member"].tolist(), part["status"].tolist(), part["expected"].tolist()):
                own.setdefault(g, int(n))
                if g not in fired and status in ENDED:
                    done.setdefault((g, member))
            expected |= own
        before = {tuple(x): None for x in self.ended.get()} if self.ended.exists() else {}
        counts = Counter(g for g, _ in before.keys() | done.keys())
        firing = {g: n for g, n in expected.items() if g not in fired and counts[g] >= n}
        if firing:
            self.fired.appendList([(g,) for g in firing])
            left = [x for x in before | done if x[0] not in firing]
            if left:
                self.ended.put(left)
            else:
                self.ended.clear()
            yield pd.DataFrame({"group_id": pd.array([*firing], "Int64"), "members": [*firing.values()]})
        elif added := [x for x in done if x not in before]:
            self.ended.appendList(added)

    def close(self) -> None:
        pass


def _blocks(rows: DataFrame, of: str, size: int) -> GroupedData:
    return rows.withColumn("block", F.floor(F.col(of) / size)).groupBy("block")


def _run(out: DataFrame, folder: str, sink: Callable[[DataFrame, int], None], by_clock: bool = False) -> None:
    w = out.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint")
    # a stream by the clock always has another batch to run, so it gets one
    w = w.trigger(once=True) if by_clock else w.trigger(availableNow=True)
    w.start().awaitTermination()


def _epochs(folder: str, name: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each micro-batch to a folder of its number: one that is run again replaces what it left."""
    return lambda rows, n: rows.write.mode("overwrite").parquet(f"{folder}/{name}/epoch={n}")


def _written(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema + ", epoch long").option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}/epoch=*")


def _timed(rows: DataFrame, us: str, late: str) -> DataFrame:
    return rows.withColumn("event_time", F.timestamp_micros(us)).withWatermark("event_time", late)


def limited_stream(requests: DataFrame, limit: int, window_seconds: int, folder: str, keep_seconds: int = 300, late: str = "0 seconds", ttl_ms: int | None = None) -> DataFrame:
    """Decisions on a stream of requests (key, seq, ts_us) over what is there now, written to `folder`, which driver and
    executors share; each key decides as in batch.

    A key's log vanishes when the watermark passes its newest request by keep_seconds (the window at least), without a
    request of the key; with ttl_ms, the store drops each entry after that time of the clock instead, for live streams
    without event time. Within a micro-batch requests are taken in order of time; a request of a later one is decided after
    those before, and one from before the watermark is left out. A task holds the times of one key in one micro-batch.
    A new run on the folder goes on where the last ended.
    """
    spark = requests.sparkSession
    rows = requests.select("key", "seq", "ts_us")
    with rocksdb(spark):
        keyed = (_timed(rows, "ts_us", late) if ttl_ms is None else rows).groupBy("key")
        out = keyed.transformWithStateInPandas(SlidingLog(limit, window_seconds, keep_seconds, ttl_ms), DECIDED, "Update", "EventTime" if ttl_ms is None else "ProcessingTime")
        _run(out, folder, _epochs(folder, "decided"), by_clock=ttl_ms is not None)
    return _written(spark, folder, "decided", DECIDED).drop("epoch")


def held_logs(spark: SparkSession, folder: str) -> DataFrame:
    """key, at_us: what the state of limited_stream() holds after its last run."""
    state = spark.read.format("statestore").option("stateVarName", "log").load(f"{folder}/checkpoint")
    return state.select("key.key", "list_element.at_us")


def job_clock(events: DataFrame, timeout_seconds: int, folder: str, late: str = "0 seconds") -> DataFrame:
    """job_id, status, started_us, completed_us, by: the state of each job after a stream of events (job_id, status, at_us,
    seq). A job that has been processing for longer than the timeout when the watermark comes by has failed, by "timer"; an
    event that comes after that counts. Events from before the watermark are left out."""
    spark = events.sparkSession
    with rocksdb(spark):
        keyed = _blocks(_timed(events.select("job_id", "status", "at_us", "seq"), "at_us", late), "job_id", JobClock.BLOCK)
        _run(keyed.transformWithStateInPandas(JobClock(timeout_seconds), JobClock.SCHEMA, "Update", "EventTime"), folder, _epochs(folder, "states"))
    last = F.max_by(F.struct("status", "started_us", "completed_us", "by"), "version")
    return _written(spark, folder, "states", JobClock.SCHEMA).groupBy("job_id").agg(last.alias("s")).select("job_id", "s.*")


def fired_once(members: DataFrame, folder: str) -> DataFrame:
    """group_id, members: groups of a stream (group_id, member, status, expected) all of whose expected members ended, each
    fired once. The ledger in `folder` is written by epoch, so a batch that is run again leaves no second row."""
    spark = members.sparkSession
    with rocksdb(spark):
        out = _blocks(members.select("group_id", "member", "status", "expected"), "group_id", FireOnce.BLOCK).transformWithStateInPandas(FireOnce(), FireOnce.SCHEMA, "Update", "None")
        _run(out, folder, _epochs(folder, "ledger"))
    return _written(spark, folder, "ledger", FireOnce.SCHEMA).drop("epoch")
