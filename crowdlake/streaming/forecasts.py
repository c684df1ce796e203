"""Forecasts and notifications as one streaming query of chained stateful operators.

``samples -> candidates -> errors of every model -> champion and interval -> errors of what was issued ->
snapshots and surges -> notifications``. The stateless steps between are the batch operators' own expressions. Event time is
handed on from operator to operator; rows that come later than the watermark are dropped before the first of them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from crowdlake import constants as K
from crowdlake.functions import scalars as S
from crowdlake.operators import alerts, forecast
from crowdlake.streaming.processors import ordered_rows

KEYS = forecast.KEYS
#: The event time of every row, in all steps.
EVENT_TIME = "ts"
TOLERANCE = K.TOLERANCE_INTERVALS * K.SAMPLE_INTERVAL


def with_event_time(df: DataFrame, delay: str = "1 minute") -> DataFrame:
    """``df`` with its seconds ``t`` as event time and a watermark ``delay`` behind."""
    return df.withColumn(EVENT_TIME, F.timestamp_seconds("t")).withWatermark(EVENT_TIME, delay)


def _chained(df: DataFrame, keys: Sequence[str], processor: StatefulProcessor, schema: T.StructType) -> DataFrame:
    return df.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime", eventTimeColumnName=EVENT_TIME)


def _percentile(ordered: list[float], q: float) -> float:
    rank = q * (len(ordered) - 1)
    low = int(rank)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] + (ordered[high] - ordered[low]) * (rank - low)


def _total(values: list[float]) -> float:
    """A plain sum in order, as the batch windows add."""
    out = 0.0
    for v in values:
        out += v
    return out


def _ms(seconds: float) -> int:
    return int(seconds * 1000) + 1


# --- candidates ------------------------------------------------------------------------------


class Levels(StatefulProcessor):
    """Holt's level and trend, the recent level and the noise of each sample. State: the two numbers, the row number and
    the newest 40 values."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("holt", "rn BIGINT, level DOUBLE, trend DOUBLE, newest ARRAY<DOUBLE>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        d = ordered_rows(rows, ["t", "event_id"])
        rn, level, trend, newest = tuple(self.state.get()) if self.state.exists() else (0, 0.0, 0.0, [])
        newest, out = list(newest), []
        for x in d["value"].tolist():
            rn += 1
            if rn == 1:
                level = x
            else:
                if rn == 2:
                    trend = x - newest[-1]
                before = level
                level = forecast.ALPHA * x + (1 - forecast.ALPHA) * (level + forecast.DAMPING * trend)
                trend = forecast.BETA * (level - before) + (1 - forecast.BETA) * forecast.DAMPING * trend
            newest = [*newest, x][-40:]
            changes = [b - a for a, b in zip(newest, newest[1:])]
            limit = max(1.0, _percentile(sorted(map(abs, changes)), 0.9)) if changes else 1.0
            mean = _total(changes) / len(changes) if changes else 0.0
            spread = (_total([(c - mean) ** 2 for c in changes]) / len(changes)) ** 0.5 if changes else 0.0
            recent = newest[-8:]
            noise = 0.0 if spread < 1e-9 else spread / max(1.0, _total(recent) / len(recent))
            shown = 0.0 if rn == 1 else max(-limit, min(limit, trend))
            out.append((rn, level, shown, _percentile(sorted(recent), 0.5), noise))
        self.state.update((int(rn), float(level), float(trend), newest))
        found = pd.DataFrame(out, columns=["rn", "level", "trend", "recent_level", "noise"])
        yield pd.concat([d.reset_index(drop=True), found], axis=1)

    def close(self) -> None:
        pass


def candidate_stream(samples: DataFrame, interval: float = K.SAMPLE_INTERVAL) -> DataFrame:
    """Holt, recent level and ensemble from every accepted, smoothed sample (``camera_id, session_id, t, event_id,
    value`` with event time): one row per origin and horizon, as :func:`forecast.candidates` gives."""
    d = samples.select(*KEYS, "t", "event_id", F.col("value").cast("double").alias("value"), EVENT_TIME)
    extra = "rn BIGINT, level DOUBLE, trend DOUBLE, recent_level DOUBLE, noise DOUBLE"
    d = _chained(d, KEYS, Levels(), T.StructType([*d.schema, *T.StructType.fromDDL(extra)]))
    horizons = [
        F.struct(F.lit(label).alias("label"), F.lit(sec).alias("seconds"), F.lit(n).alias("steps"))
        for label, sec in K.HORIZONS
        for n in [S.horizon_steps(sec, interval)]
    ]
    d = d.withColumn("_h", F.explode(F.array(*horizons)))
    reach = forecast.DAMPING * (1.0 - F.pow(F.lit(forecast.DAMPING), F.col("_h.steps"))) / (1.0 - forecast.DAMPING)
    holt = F.greatest(F.lit(0.0), F.col("level") + F.col("trend") * reach)
    return d.select(
        *KEYS, "t", "event_id", EVENT_TIME, "rn", "value", "noise", "_h.label", "_h.seconds", "_h.steps",
        holt.alias("p_holt"), F.col("recent_level").alias("p_recent_level"), ((holt + F.col("recent_level")) / 2).alias("p_ensemble"),
    )


# --- errors known at an origin ---------------------------------------------------------------


class KnownErrors(StatefulProcessor):
    """Scores earlier predictions by the samples that arrive and adds what is known to each origin.

    Rows are origins times horizons. State per key: the open predictions by target time and horizon, and a ring of the
    newest ``rows`` errors a horizon. A prediction is met by the first sample at or after its target, at most
    ``tolerance`` seconds late; an event-time timer drops those that never are, so a silent camera leaves no state behind.
    ``predicted`` are the columns that hold predictions; the statistics of each go to ``<name>_mean, _p90, _n``.
    """

    def __init__(self, predicted: Sequence[str], names: Sequence[str], rows: int, tolerance: float = TOLERANCE):
        self.predicted, self.names, self.rows, self.tolerance = list(predicted), list(names), rows, tolerance
        self.labels = [label for label, _ in K.HORIZONS]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        numbers = ", ".join(f"v{i} DOUBLE" for i in range(len(self.predicted)))
        self.open = handle.getMapState("open", "target DOUBLE, label STRING", numbers)
        self.rings = {label: handle.getListState(f"errors_{label}", numbers) for label in self.labels}
        self.timer = handle.getValueState("timer", "due BIGINT")

    def _stats(self, ring: list[tuple]) -> list[float | int | None]:
        out: list[float | int | None] = []
        for i in range(len(self.predicted)):
            seen = [e[i] for e in ring if e[i] is not None]
            out += [_total(seen) / len(seen), _percentile(sorted(seen), 0.9)] if seen else [None, None]
            out.append(len(seen) if ring else None)
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        d = ordered_rows(rows, ["t", "event_id", "seconds"])
        before = {tuple(k): tuple(v) for k, v in self.open.iterator()}
        waiting = dict(before)
        # By horizon, in order of their targets.
        queues = {label: [] for label in self.labels}
        for target, label in sorted(waiting):
            queues[label].append(target)
        rings: dict[str, list[tuple]] = {}
        known: dict[str, list] = {}
        changed, out = set(), []
        seen_t = None
        columns = ["t", "label", "seconds", "value", *self.predicted]
        for t, label, seconds, value, *predicted in d[columns].itertuples(index=False, name=None):
            if t != seen_t:
                seen_t = t
                for name, queue in queues.items():
                    met = 0
                    while met < len(queue) and queue[met] <= t:
                        numbers = waiting.pop((queue[met], name))
                        if t - queue[met] <= self.tolerance:
                            if name not in rings:
                                rings[name] = [tuple(e) for e in self.rings[name].get()]
                            rings[name] = [*rings[name], tuple(_error(p, value) for p in numbers)][-self.rows :]
                            changed.add(name)
                            known.pop(name, None)
                        met += 1
                    del queue[:met]
            if label not in rings:
                rings[label] = [tuple(e) for e in self.rings[label].get()]
            if label not in known:
                known[label] = self._stats(rings[label])
            out.append(known[label])
            target = t + seconds
            waiting[(target, label)] = tuple(None if pd.isna(p) else float(p) for p in predicted)
            queues[label].append(target)
        for k in before.keys() - waiting.keys():
            self.open.removeKey(k)
        for k, v in waiting.items():
            if before.get(k) != v:
                self.open.updateValue(k, v)
        for name in changed:
            self.rings[name].put(rings[name])
        self._expect(min(t for t, _ in waiting) if waiting else None)
        stats = pd.DataFrame(out, columns=[f"{n}_{s}" for n in self.names for s in ("mean", "p90", "n")])
        for n in self.names:
            stats[f"{n}_n"] = stats[f"{n}_n"].astype("Int64")
            stats[[f"{n}_mean", f"{n}_p90"]] = stats[[f"{n}_mean", f"{n}_p90"]].astype("float64")
        yield pd.concat([d.reset_index(drop=True), stats], axis=1)

    def _expect(self, target: float | None) -> None:
        """One timer a key, for the prediction that goes first."""
        due = None if target is None else _ms(target + self.tolerance)
        (old,) = tuple(self.timer.get()) if self.timer.exists() else (None,)
        if due != old:
            if old is not None:
                self.handle.deleteTimer(old)
            if due is not None:
                self.handle.registerTimer(due)
            self.timer.update((due,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        left = None
        for k in [tuple(k) for k in self.open.keys()]:
            if _ms(k[0] + self.tolerance) <= now:
                self.open.removeKey(k)
            else:
                left = k[0] if left is None else min(left, k[0])
        self.timer.update((None,))
        self._expect(left)
        return iter([])

    def close(self) -> None:
        pass


def _error(predicted: float | None, observed: float) -> float | None:
    if predicted is None:
        return None
    if predicted == 0 and observed == 0:
        return 0.0
    return min(1.0, abs(predicted - observed) / max(1.0, observed))


def _with_known(df: DataFrame, predicted: Sequence[str], names: Sequence[str], rows: int) -> DataFrame:
    stats = [
        T.StructField(f"{n}_{s}", T.LongType() if s == "n" else T.DoubleType()) for n in names for s in ("mean", "p90", "n")
    ]
    return _chained(df, KEYS, KnownErrors(predicted, names, rows), T.StructType([*df.schema, *stats]))


def forecast_rows(
    candidates: DataFrame, approved: Sequence[str] = (), shadow: Sequence[str] = (), target: float = K.TARGET_ACCURACY,
    confidence_floor: bool = True,
) -> DataFrame:
    """Champion, interval and confidence of every origin and horizon of a candidate stream, with the errors of earlier
    issued forecasts (``e_issued_mean, e_issued_n``): the streaming form of :func:`forecast.backtest` up to the snapshot."""
    models = forecast.models_of(candidates)
    known = _with_known(candidates, [f"p_{m}" for m in models], [f"e_{m}" for m in models], K.CANDIDATE_ERROR_WINDOW)
    d = forecast.prediction_interval(forecast.select_model(known, approved, shadow, target), confidence_floor)
    d = d.withColumn("target_t", F.col("t") + F.col("seconds"))
    d = d.drop(*[c for c in d.columns if c[:2] in ("p_", "e_") or c.startswith("chosen_")], "predicted")
    d = d.withColumn("issued_count", F.col("people_count").cast("double"))
    return _with_known(d, ["issued_count"], ["e_issued"], K.HORIZON_ERROR_WINDOW).drop("issued_count")


# --- snapshots and surges --------------------------------------------------------------------


class Snapshots(StatefulProcessor):
    """One row per origin with its forecasts in a list. An origin's rows arrive together; nothing is kept."""

    def __init__(self, fields: Sequence[str], whole: Sequence[str]):
        self.fields, self.whole = list(fields), list(whole)

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        d = ordered_rows(rows, ["t", "event_id", "seconds"])
        listed = d[self.fields].astype(object).where(d[self.fields].notna(), None).to_dict("records")
        d = d.assign(forecasts=listed)
        per = d.groupby(["t", "event_id"], sort=True)
        yield pd.concat([per[self.whole].first().reset_index(), per["forecasts"].agg(list).reset_index(drop=True)], axis=1)

    def close(self) -> None:
        pass


def snapshot_stream(rows: DataFrame, min_samples: int = 1, target: float = K.TARGET_ACCURACY, min_validation: int = K.MIN_MODEL_SCORES) -> DataFrame:
    """One row per origin from :func:`forecast_rows`: what :func:`forecast.forecast_snapshot` gives, and the
    first surge (null if there is none)."""
    fields = [
        "seconds", "label", "people_count", "lower_count", "upper_count", "confidence_percent", "validation_samples", "model",
        "target_t", "e_issued_mean", "e_issued_n",
    ]
    whole = [*KEYS, EVENT_TIME, "rn", "value"]
    item = T.StructType([rows.schema[f] for f in fields])
    schema = T.StructType(
        [rows.schema["t"], rows.schema["event_id"], *[rows.schema[c] for c in whole], T.StructField("forecasts", T.ArrayType(item))]
    )
    d = _chained(rows, KEYS, Snapshots(fields, whole), schema)

    def judged(p: Column) -> Column:
        goal = F.when(p["label"].isin(K.SHORT_HORIZONS), F.lit(K.TARGET_ACCURACY)).otherwise(F.lit(float(target)))
        trusted = (p["validation_samples"] >= min_validation) & F.coalesce(p["confidence_percent"] >= goal, F.lit(False))
        status = F.when(trusted, "verified").when(p["confidence_percent"].isNotNull(), "below_target").otherwise("validating")
        return F.struct(
            *[p[f].alias(f) for f in fields[:7]], goal.alias("target_accuracy_percent"), trusted.alias("trusted"),
            status.alias("quality_status"), p["model"].alias("model"), p["target_t"].alias("target_t"),
        )

    d = d.withColumn("predictions", F.transform("forecasts", judged))
    good = F.size(F.filter("predictions", lambda p: p["trusted"])).cast("bigint")
    known = F.size(F.filter("predictions", lambda p: p["confidence_percent"].isNotNull()))
    quality = (
        F.when(good == F.size("predictions"), "target_met").when(good > 0, "partially_verified").when(known == 0, "validating")
    ).otherwise("needs_calibration")
    first, step = F.col("predictions")[0]["people_count"], F.greatest(F.lit(2.0), F.col("value") * 0.02)
    trend = F.when(first > F.col("value") + step, "rising").when(first < F.col("value") - step, "falling").otherwise("stable")
    zero, none = F.lit(0.0), F.lit(0).cast("bigint")
    n = F.aggregate("forecasts", none, lambda a, p: a + F.coalesce(p["e_issued_n"], none))
    m = F.aggregate("forecasts", zero, lambda a, p: a + F.coalesce(p["e_issued_mean"] * p["e_issued_n"], zero))
    accuracy = F.when(n > 0, F.bround(F.greatest(zero, 100.0 * (1.0 - m / n)), 1))
    ready = F.col("rn") >= min_samples
    models = F.array_sort(F.array_distinct(F.transform("predictions", lambda p: p["model"])))
    return d.select(
        *KEYS, "t", "event_id", EVENT_TIME, F.when(ready, "ready").otherwise("collecting").alias("status"),
        F.col("rn").alias("samples"), F.col("value").alias("stabilized_count"), F.when(ready, accuracy).alias("accuracy_percent"),
        F.when(ready, quality).otherwise("validating").alias("quality_status"), F.when(ready, trend).otherwise("unknown").alias("trend"),
        F.when(ready, good).otherwise(none).alias("trusted_predictions"),
        F.when(ready, models).otherwise(F.array().cast("array<string>")).alias("models_selected"),
        F.when(ready, F.col("predictions")).otherwise(F.slice("predictions", 1, 0)).alias("predictions"),
        _first_surge(F.col("predictions"), F.col("value")).alias("surge"),
    )


def _first_surge(predictions: Column, now: Column) -> Column:
    """The condition of :func:`forecast.surge` over a list of forecasts, nearest horizon first."""

    def growth(p: Column) -> Column:
        later = p["people_count"]
        return F.when(now > 0, (later - now) / F.greatest(F.lit(1.0), now) * 100.0).otherwise(F.when(later > 50, 100.0).otherwise(0.0))

    def sure(p: Column) -> Column:
        return F.coalesce(F.nullif(p["confidence_percent"], F.lit(0.0)), F.lit(85.0))

    hits = F.filter(
        predictions,
        lambda p: p["label"].isin(K.SHORT_HORIZONS) & (p["people_count"] > now) & (growth(p) >= 65.0) & (sure(p) >= 85.0),
    )
    listed = F.transform(
        hits,
        lambda p: F.struct(
            p["label"].alias("horizon"), p["people_count"].alias("predicted_count"),
            F.bround(growth(p), 1).alias("growth_percent"), sure(p).alias("confidence_percent"),
        ),
    )
    return F.get(listed, F.lit(0))


def surge_stream(snapshots: DataFrame) -> DataFrame:
    """Rows of :func:`forecast.surge`, from snapshots."""
    found = snapshots.where("surge is not null")
    return found.select(*KEYS, "t", "event_id", EVENT_TIME, "surge.*", F.lit("STAMPEDE").alias("severity"))


# --- notifications ---------------------------------------------------------------------------


class Notify(StatefulProcessor):
    """Joins a camera's states with its surges and lets at most one notification through in ``gap`` seconds.

    Both kinds of rows wait until the watermark has passed their time, since the choice depends on their order: then the
    state of a time meets the surge of the same sample, and the cooldown runs in order of time. State: the waiting rows and
    the time of the last notification.
    """

    SURGE = ["horizon", "predicted_count", "growth_percent", "_sure"]

    def __init__(self, schema: T.StructType, gap: float):
        self.schema, self.gap = schema, gap
        self.names = schema.fieldNames()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "kind INT, due BIGINT, row STRING")
        self.last = handle.getValueState("last", "t DOUBLE")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        for d in rows:
            texts = d["row"].tolist()
            for due, kind, text in zip(d["t"].map(_ms).tolist(), d["kind"].tolist(), texts):
                self.waiting.appendValue((int(kind), int(due), text))
                self.handle.registerTimer(int(due))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ripe = [r for r in rows if r[1] <= now]
        if not ripe:
            return
        self.waiting.put([r for r in rows if r[1] > now]) if len(ripe) < len(rows) else self.waiting.clear()
        surges, states = {}, []
        for kind, _, text in ripe:
            row = json.loads(text)
            if kind:
                surges[(row["t"], row["event_id"])] = row
            else:
                states.append(row)
        (last,) = tuple(self.last.get()) if self.last.exists() else (None,)
        out = []
        for row in sorted(states, key=lambda r: (r["t"], r["event_id"])):
            row.update({c: surges.get((row["t"], row["event_id"]), {}).get(c) for c in self.SURGE})
            if (row["horizon"] is None and row.get("risk_level") != "STAMPEDE") or (last is not None and row["t"] - last <= self.gap):
                continue
            last = row["t"]
            out.append(json.dumps(row))
        if out:
            self.last.update((float(last),))
            yield pd.DataFrame({"camera_id": [key[0]] * len(out), "row": out})

    def close(self) -> None:
        pass


def notification_stream(state: DataFrame, surges: DataFrame, dims: DataFrame, gap: float = K.NOTIFY_COOLDOWN) -> DataFrame:
    """The streaming form of :func:`alerts.notifications`, without its report limit: ``state`` and ``surges`` are streams
    with event time, the latter as :func:`surge_stream` gives; ``dims`` is a table. A notification comes out once the
    watermark has passed its time."""
    columns = [c for c in state.columns if c != EVENT_TIME]
    surge = surges.select("camera_id", EVENT_TIME, "t", "event_id", "horizon", "predicted_count", "growth_percent", F.col("confidence_percent").alias("_sure"))
    packed = lambda df, kind, names: df.select(
        "camera_id", EVENT_TIME, "t", F.lit(kind).alias("kind"), F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("row")
    )
    both = packed(state, 0, columns).unionByName(packed(surge, 1, [c for c in surge.columns if c not in ("camera_id", EVENT_TIME)]))
    full = T.StructType(
        [*[state.schema[c] for c in columns], *[surge.schema[c] for c in Notify.SURGE]]
    )
    out = both.groupBy("camera_id").transformWithStateInPandas(
        Notify(full, gap), "camera_id STRING, row STRING", "Append", "EventTime"
    )
    return alerts.described(out.select(F.from_json("row", full).alias("r")).select("r.*"), dims)
