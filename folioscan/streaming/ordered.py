"""Keyed streams that handle rows in event-time order over all micro-batches, and leave no state behind."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folioscan.operators.state import StateRules, observations
from folioscan.streaming.limits import LIMIT_SCHEMA

#: Idle conversations are forgotten after this time.
CONVERSATION_TTL_MS = 30 * 24 * 3600 * 1000
SNAPSHOT = "version bigint, kind string, key string, value string, turn bigint"


class OrderedRateLimiter(StatefulProcessor):
    """At most `max_requests` per window that starts at its first request, whatever order the rows come in.

    Rows wait in a map by (ms, seq) until the watermark has passed them; one timer per key releases all
    that are due, in order. When nothing waits, the timer is set to the end of the window: if it fires,
    no row can fall into the window any more, and the key's state is dropped.
    """

    def __init__(self, window_ms: int, max_requests: int) -> None:
        self.window_ms, self.max_requests = window_ms, max_requests

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms bigint, seq bigint", "rows int")
        self.window = handle.getValueState("window", "start bigint, count int")

    def handleInputRows(self, key, rows, timerValues):
        for batch in rows:
            for (ms, seq), n in Counter(zip(batch["ms"].tolist(), batch["seq"].tolist())).items():
                held = self.waiting.getValue((ms, seq))[0] if self.waiting.containsKey((ms, seq)) else 0
                self.waiting.updateValue((ms, seq), (held + n,))
        self._arm()
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until = timerValues.getCurrentWatermarkInMs()
        due = sorted((at[0], at[1], n[0]) for at, n in self.waiting.iterator() if at[0] < until)
        start, count = self.window.get() if self.window.exists() else (None, 0)
        out = []
        for ms, seq, n in due:
            self.waiting.removeKey((ms, seq))
            for _ in range(n):
                if start is None or ms - start >= self.window_ms:
                    start, count = ms, 1
                    out.append((key[0], ms, seq, True))
                else:
                    out.append((key[0], ms, seq, count < self.max_requests))
                    count += count < self.max_requests
        if start is not None and start + self.window_ms <= until and not any(at[0] < start + self.window_ms for at in self.waiting.keys()):
            self.window.clear()  # every later row opens a window of its own
        elif start is not None:
            self.window.update((start, count))
        self._arm()
        if out:
            yield pd.DataFrame(out, columns=["key", "ms", "seq", "allowed"])

    def _arm(self) -> None:
        """One timer: at the earliest waiting row, else at the end of the open window."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        times = [at[0] + 1 for at in self.waiting.keys()]
        if times:
            self.handle.registerTimer(min(times))
        elif self.window.exists():
            self.handle.registerTimer(self.window.get()[0] + self.window_ms)

    def close(self) -> None:
        pass


def stream_rate_limit_in_order(events: DataFrame, window_ms: int, max_requests: int, delay: str = "10 minutes") -> DataFrame:
    """The rule of `rate_limit` on a stream of (key, ts, seq): each request is answered once the watermark has passed it."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    timed = timed.select("key", "ts", F.unix_millis("ts").alias("ms"), "seq")
    return timed.groupBy("key").transformWithStateInPandas(OrderedRateLimiter(window_ms, max_requests), LIMIT_SCHEMA, "Append", "EventTime")


class ConversationState(StatefulProcessor):
    """What a conversation states, folded as its observations come, in any order.

    A map holds the last value of each (kind, key) by turn and position. A level composition (kind
    class) is a whole: one of a newer turn replaces all members, older ones are ignored. A changed
    conversation gives a new numbered snapshot; idle ones expire.
    """

    def __init__(self, keys: list[str], ttl_ms: int) -> None:
        self.keys, self.ttl_ms = keys, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getMapState("values", "kind string, key string", "turn bigint, pos bigint, value string", self.ttl_ms)
        self.composed = handle.getValueState("composed", "turn bigint", self.ttl_ms)
        self.version = handle.getValueState("version", "version bigint", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        newest = self.composed.get()[0] if self.composed.exists() else None
        held = {tuple(at): tuple(v) for at, v in self.values.iterator()}  # a conversation's few values, read and written once
        before = dict(held)
        for batch in rows:
            for kind, name, turn, pos, value in zip(*(batch[c].tolist() for c in ("kind", "key", "turn", "pos", "value"))):
                if kind == "class":
                    if newest is not None and turn < newest:
                        continue
                    if newest is None or turn > newest:
                        held = {at: v for at, v in held.items() if at[0] != "class"}
                        newest = turn
                at = (kind, name or "")
                new = (int(turn), int(pos), value)
                if at not in held or new > held[at]:
                    held[at] = new
        for at in before.keys() - held.keys():
            self.values.removeKey(at)
        for at, v in held.items():
            if before.get(at) != v:
                self.values.updateValue(at, v)
        if newest is not None:
            self.composed.update((int(newest),))
        if held != before:
            version = self.version.get()[0] + 1 if self.version.exists() else 1
            self.version.update((version,))
            out = [(*key, version, *at, v[2], v[0]) for at, v in held.items()]
            yield pd.DataFrame(out, columns=[*self.keys, "version", "kind", "key", "value", "turn"])

    def close(self) -> None:
        pass


def stream_conversation_state(messages: DataFrame, keys: list[str], rules: StateRules = StateRules(), ttl_ms: int = CONVERSATION_TTL_MS) -> DataFrame:
    """Numbered snapshots (keys, version, kind, key, value, turn); `newest_snapshots` of a table of them is the state."""
    kinds = dict(messages.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + SNAPSHOT
    stated = observations(messages, keys, rules).withColumn("turn", F.col("turn").cast("bigint")).withColumn("pos", F.col("pos").cast("bigint"))
    return stated.groupBy(*keys).transformWithStateInPandas(ConversationState(keys, ttl_ms), schema, "Append", "ProcessingTime")


def newest_snapshots(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    last = F.max("version").over(Window.partitionBy(*keys))
    return snapshots.withColumn("_last", last).where(F.col("version") == F.col("_last")).drop("version", "_last")
