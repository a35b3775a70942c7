"""Operators with keyed state, timers and eviction: the detector as a stream, timeouts that a record overrides, readings that go stale.

Rows of a key come in order from one trigger to the next; within a trigger they are sorted. State is kept in RocksDB."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayfold.operators import detector
from wayfold.plans.views import Tables, prompt_paths, step_flags

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started within keep their state in RocksDB, which maps, lists and timers need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def _sorted(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(list(by), kind="stable")


# The detector.

#: What the checker is told of a call when it is answered.
CALL = (
    "trial_id string, step_idx int, is_stop boolean, is_test boolean, failed boolean, changes boolean, changed array<struct<path: string, op: string>>, "
    "named array<string>, own array<struct<pattern: string, subtype: string, detail: string>>"
)
FLAG = "trial_id string, step_idx int, pattern string, subtype string, detail string"


def answered_calls(t: Tables) -> DataFrame:
    """One row for each step, as CALL: what it changed, whether it tested and failed, the files its trial's prompt names, and the flags that
    the call shows by itself. named is set on stops only."""
    flags = step_flags(t).select("trial_id", "step_idx", "is_mutating", "is_test_command", "has_error_marker")
    changed = t["deltas"].groupBy("trial_id", "step_idx").agg(F.collect_list(F.struct("path", "op")).alias("changed"))
    named = prompt_paths(t["trials"]).where(F.regexp_extract("path", r"[^/]+\z", 0).contains(".")).groupBy("trial_id").agg(F.array_sort(F.collect_set("path")).alias("named"))
    shown = detector.self_kill(t).unionByName(detector.masked_error(t)).unionByName(detector.silent_no_write(t))
    own = shown.groupBy("trial_id", "step_idx").agg(F.collect_list(F.struct("pattern", "subtype", "detail")).alias("own"))
    stop = F.col("tool").isNull() & F.col("message").isNotNull()
    rows = t["steps"].select("trial_id", "step_idx", stop.alias("is_stop")).join(flags, ["trial_id", "step_idx"]).join(changed, ["trial_id", "step_idx"], "left").join(own, ["trial_id", "step_idx"], "left").join(named, "trial_id", "left")
    return rows.select(
        "trial_id", F.col("step_idx").cast("int").alias("step_idx"), "is_stop", F.col("is_test_command").alias("is_test"), F.col("has_error_marker").alias("failed"),
        F.col("is_mutating").alias("changes"), "changed", F.when(F.col("is_stop"), F.col("named")).alias("named"), "own")


def _check(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One trial's checker: the last change and the last test, and what the last change of each path was.

    A flag depends on the calls up to its own, so those of the first calls stay as they are whatever comes after."""
    change, test, failed, paths = state.get if state.exists else (None, None, None, {})
    paths, out = dict(paths), []
    for r in _sorted(parts, "step_idx").itertuples(index=False):
        out += [(r.step_idx, f["pattern"], f["subtype"], f["detail"]) for f in (r.own if r.own is not None else ())]
        for c in r.changed if r.changed is not None else ():
            paths[c["path"]] = c["op"]
        if r.changes:
            change = int(r.step_idx)
        if r.is_test:
            test, failed = int(r.step_idx), bool(r.failed)
        if not r.is_stop:
            continue
        tested = change is not None and test is not None and test > change
        if change is not None and (not tested or failed):
            out.append((r.step_idx, "unverified_completion", "last_test_failed" if tested else "no_test", str(change)))
        for path in r.named if r.named is not None else ():
            op = paths.get(path)
            if op in (None, "delete"):
                out.append((r.step_idx, "missing_output", "never_written" if op is None else "deleted", path))
    state.update((change, test, failed, paths))
    out = pd.DataFrame(out, columns=["step_idx", "pattern", "subtype", "detail"])
    out.insert(0, "trial_id", key[0])
    yield out


def checked(calls: DataFrame) -> DataFrame:
    """The flags of a stream of CALL rows. A trial's state comes and goes with its rows, in Arrow batches of many trials."""
    return calls.groupBy("trial_id").applyInPandasWithState(_check, FLAG, "change int, test int, failed boolean, paths map<string, string>", "append", GroupStateTimeout.NoTimeout)


# Timeouts.


def _timeouts(hold_ms: int):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        answered, due = state.get if state.exists else (False, None)
        given = lambda outcome, us: pd.DataFrame({"call_id": [key[0]], "outcome": [outcome], "us": [us]})
        if state.hasTimedOut:
            state.remove()
            yield given("timed_out", (due - hold_ms) * 1000)
            return
        kinds, times = map(np.concatenate, zip(*[(p["kind"].to_numpy(), p["us"].to_numpy()) for p in parts], strict=True))
        if answered:
            return
        records, markers = times[kinds == "record"], times[kinds == "timeout"]
        if len(records):
            state.update((True, None))
            yield given("answered", int(records.min()))
        elif len(markers) or due is not None:
            # A group's timeout has to be set anew whenever it has rows.
            due = max(int(markers.min()) // 1000 + hold_ms if due is None else due, state.getCurrentWatermarkMs() + 1)
            state.update((False, due))
            state.setTimeoutTimestamp(due)

    return run


def timeouts(rows: DataFrame, hold_ms: int, late: str = "1 minute") -> DataFrame:
    """(call_id, outcome, at) of a stream of (call_id, kind, arrived), kind `record` or `timeout`.

    A marker waits `hold_ms` for the call's record, then the call is `timed_out`. A record always gives `answered`, before the marker, within the
    wait or after it; outcomes() takes it over a `timed_out` that is already out. Event time is when a row came into the log, so a late record
    is no late row."""
    rows = rows.select("call_id", "kind", F.unix_micros("arrived").alias("us"), "arrived").withWatermark("arrived", late)
    out = rows.groupBy("call_id").applyInPandasWithState(_timeouts(hold_ms), "call_id string, outcome string, us long", "answered boolean, due long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("call_id", "outcome", F.timestamp_micros("us").alias("at"))


def outcomes(emitted: DataFrame) -> DataFrame:
    """(call_id, outcome): what stands of all that timeouts() has given."""
    return emitted.groupBy("call_id").agg(F.min("outcome").alias("outcome"))


# Readings.


class _Readings(StatefulProcessor):
    def __init__(self, fresh_ms: int, horizon_ms: int):
        self.fresh_ms, self.horizon_ms = fresh_ms, horizon_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "value string, at_ms bigint, timer bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        value, read, timer = self.last.get() if self.last.exists() else (None, None, None)
        out, before = [], read
        for r in _sorted(rows, "at", "is_event").itertuples(index=False):
            at = int(r.at.value // 1_000_000)
            if not r.is_event:
                value, read = r.value, at
            else:
                out.append((r.event_id, value if read is not None and 0 <= at - read < self.fresh_ms else None))
        if read is not None and read != before:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = max(read + self.horizon_ms, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(timer)
            self.last.update((value, read, timer))
        out = pd.DataFrame(out, columns=["event_id", "value"])
        out.insert(0, "key", key[0])
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame({"key": pd.Series(dtype=object), "event_id": pd.Series(dtype="int64"), "value": pd.Series(dtype=object)})

    def close(self) -> None:
        pass


def fresh_readings(rows: DataFrame, fresh_ms: int, horizon_ms: int, late: str = "1 minute") -> DataFrame:
    """(key, event_id, value) for each event of a stream of (key, at, is_event, event_id, value): the last reading of its key, if that is
    less than `fresh_ms` old, else null. A reading of the event's own instant counts.

    State is one reading a key; it is dropped `horizon_ms` after it was read (event time), which is no less than `fresh_ms`."""
    if horizon_ms < fresh_ms:
        raise ValueError("readings would be dropped while they are fresh")
    return rows.withWatermark("at", late).groupBy("key").transformWithStateInPandas(_Readings(fresh_ms, horizon_ms), "key string, event_id bigint, value string", "Append", "EventTime")
