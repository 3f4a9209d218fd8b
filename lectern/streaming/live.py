"""Streams: lockouts by failure log, running metrics, first-seen files."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import SETTINGS

DECISIONS = "key string, ts timestamp, outcome string, blocked boolean, recent int"


def fold(rows: Iterable[tuple], recent: list[int], limit: int, window: int) -> tuple[list[tuple], list[int]]:
    """Decide attempts (time, outcome) in order of time.  Failures strictly within the window
    count; an attempt made while blocked is not recorded, and a success clears the key.  At most
    `limit` times are ever held."""
    out = []
    for at, outcome in rows:
        recent = [t for t in recent if t > at - window]
        blocked = len(recent) >= limit
        out.append((blocked, len(recent)))
        if not blocked:
            recent = [] if outcome == "success" else [*recent, at]
    return out, recent


def timed(attempts: DataFrame) -> DataFrame:
    return attempts.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "outcome").withColumn("at", F.unix_micros("ts"))


def lockouts(attempts: DataFrame, limit: int = SETTINGS.failures, window_s: int = SETTINGS.failure_window_s) -> DataFrame:
    """Each attempt of attempts(key, ts, outcome) with whether it met a lockout.

    After a pause of a window or more nothing is held against a key, so its attempts fall into
    runs that are decided apart, in sorted partitions; only the times held are kept in memory.
    Pauses are found between slots of a window's length, which are few.  Attempts without a time
    are left out; a missing key is a key.
    """
    window = window_s * 1_000_000
    rows = timed(attempts).filter("at is not null").withColumn("h", F.xxhash64("key")).withColumn("slot", F.expr(f"at div {window}"))
    order = Window.partitionBy("h").orderBy("slot")
    slots = rows.groupBy("h", "slot").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    pauses = slots.withColumn("pause", F.coalesce((F.col("first") - F.lag("last").over(order) >= window).cast("int"), F.lit(0)))
    runs = pauses.select("h", "slot", F.sum("pause").over(order).alias("run"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            decided = []
            columns = (batch.column(c).to_pylist() for c in ("h", "run", "key", "at", "outcome"))
            for who, group in groupby(zip(*columns), key=lambda r: r[:3]):
                more, held = fold((r[3:] for r in group), held if who == last else [], limit, window)
                last = who
                decided += more
            made = [pa.array([d[0] for d in decided], pa.bool_()), pa.array([d[1] for d in decided], pa.int32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "ts", "outcome")), *made], names=["key", "ts", "outcome", "blocked", "recent"])

    dealt = rows.join(runs, ["h", "slot"]).repartition("h", "run").sortWithinPartitions("h", "run", "key", "at", "outcome")
    return dealt.mapInArrow(decide, DECISIONS)


def lockouts_stream(attempts: DataFrame, limit: int = SETTINGS.failures, window_s: int = SETTINGS.failure_window_s, late: str = "1 hour") -> DataFrame:
    """The same over a stream; a key's state is its recent failure times.  The state goes with a
    success, and once the watermark has passed the window of its last failure; rows later than
    `late` are dropped by the watermark."""
    window = window_s * 1_000_000

    def run(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(groups)).sort_values(["at", "outcome"], kind="stable")
        decided, held = fold(zip(rows["at"], rows["outcome"]), list(state.get[0]) if state.exists else [], limit, window)
        if held:
            state.update(([int(t) for t in held],))
            state.setTimeoutTimestamp(int(max(held) + window) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield rows.assign(blocked=[d[0] for d in decided], recent=[d[1] for d in decided])[["key", "ts", "outcome", "blocked", "recent"]]

    keyed = timed(attempts).filter("at is not null").withWatermark("ts", late)
    return keyed.groupBy("key").applyInPandasWithState(run, DECISIONS, "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def reset_requests(requests: DataFrame, limit: int = SETTINGS.failures, window_s: int = SETTINGS.failure_window_s) -> DataFrame:
    """Each request for a new password of requests(key, ts) with whether it met the limit.  Keys
    are a space of their own, apart from those of sign-ins, and no success clears them."""
    own = requests.select(F.concat(F.lit("reset:"), F.col("key").cast("string")).alias("key"), "ts", F.lit("failure").alias("outcome"))
    return lockouts(own, limit, window_s).drop("outcome")


def failures_in_window(attempts: DataFrame, window_s: int) -> DataFrame:
    """Failures of the key strictly within the window up to each failure, blocked or not."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    near = Window.partitionBy("key").orderBy("at").rangeBetween(1 - window_s * 1_000_000, 0)
    return attempts.filter("outcome = 'failure'").withColumn("at", at).withColumn("recent", F.count("*").over(near)).drop("at")


def status_by_window(messages: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Status counts of a stream of messages by window of created_at; later rows than `late`
    are dropped by the watermark."""
    windows = messages.withWatermark("created_at", late).groupBy(F.window("created_at", every), "status").agg(F.count("*").alias("n"))
    return windows.select(F.col("window.start").alias("start"), "status", "n")


def first_files(files: DataFrame, late: str = "1 day") -> DataFrame:
    """The first arrival of each content hash of a stream of files(arrived, file_hash)."""
    return files.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["file_hash"])
