"""Rate limiting by a sliding log, in batch; keyed.py has the stream, which decides alike.

A request is let through if fewer than `limit` let-through ones of its key are younger than the window. Rejected
requests leave no trace, so each decision depends on earlier ones and a window count can't express it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules in order: exact path first, then the first prefix in this order, else the default (limit, seconds).
RULES = {"/api/v1/auth": (10, 60), "/api/v1/upload": (20, 60), "/api/v1/projects": (100, 60), "default": (60, 60)}
SECOND = 1_000_000


def decide(times: list[int], log: list[int], limit: int, window_us: int) -> tuple[list[tuple[bool, int, int]], list[int]]:
    """For times in order: (limited, remaining, reset seconds) of each, and the log after them."""
    out = []
    for now in times:
        log = [t for t in log if t > now - window_us]
        if len(log) >= limit:
            out.append((True, 0, max(int((min(log) + window_us - now) / SECOND), 1)))
        else:
            log.append(now)
            out.append((False, limit - len(log), window_us // SECOND))
    return out, log


def rule_of(path: Column, rules: dict[str, tuple[int, int]] = RULES) -> Column:
    """STRUCT(rule, max_requests, seconds)."""
    as_struct = lambda k: F.struct(F.lit(k).alias("rule"), F.lit(rules[k][0]).alias("max_requests"), F.lit(rules[k][1]).alias("seconds"))
    out = None
    for k in rules:
        out = F.when(path == k, as_struct(k)) if out is None else out.when(path == k, as_struct(k))
    for k in rules:
        if k != "default":
            out = out.when(path.startswith(k), as_struct(k))
    return out.otherwise(as_struct("default"))


def key_of(user: Column, forwarded: Column, peer: Column, rule: Column) -> Column:
    """The user, else the trusted forwarded address, else the peer's; each rule counts by itself."""
    who = F.coalesce(F.concat(F.lit("user:"), user.cast("string")), F.concat(F.lit("ip:"), forwarded), F.concat(F.lit("ip:"), peer))
    return F.concat(who, F.lit(":"), rule)


DECIDED = "key string, seq long, ts_us long, limited boolean, remaining int, reset int"


def _frame(key: str, g: pd.DataFrame, out: list) -> pd.DataFrame:
    return pd.DataFrame({"key": key, "seq": g.seq, "ts_us": g.ts_us, "limited": [o[0] for o in out], "remaining": [o[1] for o in out], "reset": [o[2] for o in out]})


def limited(requests: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """Decisions on requests (key, seq, ts_us), in order of time and seq.

    A key's requests pass through one task in sorted batches, as each decision needs the ones before; the task holds a
    batch and the log of one key, so its memory doesn't grow with a key's requests.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, log = None, []
        for b in batches:
            for k, g in b.groupby("key", sort=False):
                if k != key:
                    key, log = k, []
                out, log = decide(g.ts_us.tolist(), log, limit, window_seconds * SECOND)
                yield _frame(k, g, out)

    ordered = requests.select("key", "seq", "ts_us").repartition("key").sortWithinPartitions("key", "ts_us", "seq")
    return ordered.mapInPandas(run, DECIDED)
