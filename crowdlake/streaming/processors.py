"""Keyed state for streams: the streaming forms of the ordered operators.

Each processor keeps a few values per key in the state store and handles the rows of a micro-batch in
time order. State is bounded by the number of keys.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from crowdlake import constants as K


def ordered_rows(rows: Iterator[pd.DataFrame], order: Sequence[str]) -> pd.DataFrame:
    chunks = list(rows)
    both = chunks[0] if len(chunks) == 1 else pd.concat(chunks, ignore_index=True)
    return both.sort_values(list(order), kind="stable", ignore_index=True)


class _Keyed(StatefulProcessor):
    """Values of one state variable, with a default for new keys."""

    def __init__(self, schema: str, default: tuple, order: Sequence[str]):
        self.schema, self.default, self.order = schema, default, list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("value", self.schema)

    def load(self) -> tuple:
        return tuple(self.state.get()) if self.state.exists() else self.default

    def close(self) -> None:
        pass


class Throttle(_Keyed):
    def __init__(self, gap: float, strict: bool, order: Sequence[str]):
        super().__init__("last DOUBLE", (None,), order)
        self.gap, self.strict = gap, strict

    def handleInputRows(self, key, rows, timerValues):
        d = ordered_rows(rows, self.order)
        (last,) = self.load()
        kept = []
        for i, t in enumerate(d[self.order[0]].tolist()):
            if last is None or (t - last > self.gap if self.strict else t - last >= self.gap):
                kept.append(i)
                last = t
        if kept:
            self.state.update((last,))
        yield d.iloc[kept]


class DedupeSeq(_Keyed):
    def __init__(self, seq: str, order: Sequence[str]):
        super().__init__("top BIGINT", (-1,), order)
        self.seq = seq

    def handleInputRows(self, key, rows, timerValues):
        d = ordered_rows(rows, self.order)
        (top,) = self.load()
        kept = []
        for i, s in enumerate(d[self.seq].tolist()):
            if pd.isna(s):
                kept.append(i)
            elif int(s) > top:
                kept.append(i)
                top = int(s)
        self.state.update((top,))
        yield d.iloc[kept]


class Lateness(StatefulProcessor):
    """Marks rows that came later than allowed (``late``) and de-duplicates the others by sequence number.

    The stream's watermark stands ``keep`` milliseconds behind the allowed one, so that late rows still arrive here; what
    is later than both Spark drops and counts. State, the highest number, goes when a key was silent for ``idle``
    milliseconds of event time.
    """

    def __init__(self, event_time: str, seq: str, keep: int, idle: int, order: Sequence[str]):
        self.event_time, self.seq, self.keep, self.idle, self.order = event_time, seq, keep, idle, list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("value", "top BIGINT, due BIGINT")

    def handleInputRows(self, key, rows, timerValues):
        d = ordered_rows(rows, self.order)
        top, due = tuple(self.state.get()) if self.state.exists() else (-1, None)
        watermark = timerValues.getCurrentWatermarkInMs()
        allowed = watermark + self.keep if watermark > 0 else 0
        kept, late, newest = [], [], None
        for i, (s, ts) in enumerate(zip(d[self.seq].tolist(), d[self.event_time].tolist())):
            ms = None if pd.isna(ts) else ts.value // 1_000_000
            is_late = ms is not None and ms < allowed
            if not is_late:
                if not pd.isna(s):
                    if int(s) <= top:
                        continue
                    top = int(s)
                newest = ms if newest is None or (ms is not None and ms > newest) else newest
            kept.append(i)
            late.append(is_late)
        if newest is not None and (due is None or newest + self.idle > due):
            if due is not None:
                self.handle.deleteTimer(due)
            due = newest + self.idle
            self.handle.registerTimer(due)
        self.state.update((int(top), due))
        yield d.iloc[kept].assign(late=pd.Series(late, index=kept, dtype=bool))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


class Presence(_Keyed):
    """Columns ``poll_ok, ready`` in; adds ``online`` and ``change``. Failed polls are dropped."""

    def __init__(self, confirm: int, order: Sequence[str]):
        super().__init__("online BOOLEAN, misses INT", (False, 0), order)
        self.confirm = confirm

    def handleInputRows(self, key, rows, timerValues):
        d = ordered_rows(rows, self.order)
        d = d[d["poll_ok"]].reset_index(drop=True)
        online, misses = self.load()
        states, changes = [], []
        for ready in d["ready"].tolist():
            change = None
            if ready:
                change, online, misses = (None if online else "online"), True, 0
            elif online:
                misses += 1
                if misses >= self.confirm:
                    change, online, misses = "offline", False, 0
            states.append(bool(online))
            changes.append(change)
        self.state.update((bool(online), int(misses)))
        yield d.assign(online=pd.Series(states, dtype=bool), change=pd.Series(changes, dtype=object))


class Sessions(_Keyed):
    """Session number per row: a new one starts at each ``is_reset`` row, which is not passed on, and,
    with ``max_gap``, after each longer gap."""

    def __init__(self, max_gap: float | None, name: str, order: Sequence[str]):
        super().__init__("number BIGINT, last DOUBLE", (0, None), order)
        self.max_gap, self.name = max_gap, name

    def handleInputRows(self, key, rows, timerValues):
        d = ordered_rows(rows, self.order)
        number, last = self.load()
        numbers = []
        resets = d["is_reset"].tolist() if "is_reset" in d else [False] * len(d)
        for t, reset in zip(d[self.order[0]].tolist(), resets):
            if reset or (self.max_gap is not None and last is not None and t - last > self.max_gap):
                number += 1
            last = t
            numbers.append(number)
        self.state.update((int(number), last))
        d = d.assign(**{self.name: pd.Series(numbers, dtype="int64")})
        yield d[~d["is_reset"]].drop(columns="is_reset") if "is_reset" in d else d


class Freshness(_Keyed):
    """Emits ``active`` for the newest row of a camera in each batch and ``stale`` once event time has
    passed it by ``ttl`` seconds."""

    def __init__(self, ttl: float, order: Sequence[str]):
        super().__init__("t DOUBLE, timer BIGINT", (None, None), order)
        self.ttl = ttl

    def handleInputRows(self, key, rows, timerValues):
        d = ordered_rows(rows, self.order)
        newest = float(d[self.order[0]].iloc[-1])
        last, timer = self.load()
        if last is not None and newest <= last:
            return
        if timer is not None:
            self.handle.deleteTimer(timer)
        due = int((newest + self.ttl) * 1000) + 1
        self.handle.registerTimer(due)
        self.state.update((newest, due))
        yield pd.DataFrame({"camera_id": [key[0]], "t": [newest], "analytics_status": ["active"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last, _ = self.load()
        self.state.update((last, None))
        yield pd.DataFrame({"camera_id": [key[0]], "t": [last], "analytics_status": ["stale"]})


def _apply(df: DataFrame, keys: Sequence[str], processor: StatefulProcessor, schema: T.StructType, time_mode: str = "None"):
    return df.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", time_mode)


def throttle_stream(df: DataFrame, keys: Sequence[str], gap: float, strict: bool = False, order=("t", "event_id")) -> DataFrame:
    return _apply(df, keys, Throttle(gap, strict, order), df.schema)


def alert_cooldown_stream(alerts: DataFrame, gap: float = K.ALERT_COOLDOWN) -> DataFrame:
    severe = alerts.where("zone in ('HIGH', 'CRITICAL')")
    return throttle_stream(severe, ["camera_id", "cell"], gap, order=("t", "frame_id"))


def notify_cooldown_stream(df: DataFrame, gap: float = K.NOTIFY_COOLDOWN) -> DataFrame:
    return throttle_stream(df, ["camera_id"], gap, strict=True)


def dedupe_stream(df: DataFrame, keys: Sequence[str] = ("camera_id",), seq: str = "seq", order=("t", "event_id")) -> DataFrame:
    # Numbers travel as text: beside nulls pandas would make them doubles, which blur above 2 ** 53.
    text = df.withColumn(seq, F.col(seq).cast("string"))
    kept = _apply(text, keys, DedupeSeq(seq, order), text.schema)
    return kept.withColumn(seq, F.col(seq).cast(df.schema[seq].dataType))


def lateness_stream(
    df: DataFrame, event_time: str, delay: str = "10 minutes", keep: str = "1 hour", idle: str = "1 day",
    keys: Sequence[str] = ("camera_id",), seq: str = "seq", order=("t", "event_id"),
) -> DataFrame:
    """De-duplicated rows and, marked ``late``, those that arrived more than ``delay`` and at most ``delay + keep``
    behind the newest event time. Rows later still are dropped and counted by Spark (``numRowsDroppedByWatermark``)."""
    ms = lambda text: int(pd.Timedelta(text).total_seconds() * 1000)
    text = df.withColumn(seq, F.col(seq).cast("string")).withWatermark(event_time, f"{ms(delay) + ms(keep)} milliseconds")
    schema = T.StructType([*text.schema, T.StructField("late", T.BooleanType())])
    marked = _apply(text, keys, Lateness(event_time, seq, ms(keep), ms(idle), order), schema, "EventTime")
    return marked.withColumn(seq, F.col(seq).cast(df.schema[seq].dataType))


def presence_stream(polls: DataFrame, confirm: int = 2) -> DataFrame:
    schema = T.StructType([*polls.schema, T.StructField("online", T.BooleanType()), T.StructField("change", T.StringType())])
    return _apply(polls, ["camera_id"], Presence(confirm, ("t", "poll_id")), schema)


def reset_sessions_stream(df: DataFrame, keys: Sequence[str] = ("camera_id",), order=("t", "event_id")) -> DataFrame:
    """Needs ``is_reset``; rows at the time of a reset should carry a larger tie-breaker than it."""
    fields = [f for f in df.schema if f.name != "is_reset"]
    return _apply(df, keys, Sessions(None, "session_id", order), T.StructType([*fields, T.StructField("session_id", T.LongType())]))


def gap_sessions_stream(df: DataFrame, max_gap: float, keys: Sequence[str] = ("camera_id",), order=("t", "event_id")) -> DataFrame:
    schema = T.StructType([*df.schema, T.StructField("run_id", T.LongType())])
    return _apply(df, keys, Sessions(max_gap, "run_id", order), schema)


def freshness_stream(updates: DataFrame, event_time: str, ttl: float = K.STALE_AFTER) -> DataFrame:
    """``updates`` must carry a watermark on ``event_time``, whose epoch seconds are in ``t``."""
    schema = "camera_id STRING, t DOUBLE, analytics_status STRING"
    d = updates.select("camera_id", "t", event_time)
    return _apply(d, ["camera_id"], Freshness(ttl, ("t",)), schema, "EventTime")
