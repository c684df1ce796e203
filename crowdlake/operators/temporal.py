"""Ordered operators per camera: throttles, sessions, de-duplication, smoothing, state machines."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from crowdlake import constants as K
from crowdlake.functions import scalars as S
from crowdlake.operators.materialize import materialize
from crowdlake.operators.scale import (
    Width,
    asof,
    chunk_for,
    chunk_width,
    join_keys,
    frame_percentile,
    home_rows,
    number_rows,
    with_previous,
    with_row_halo,
    with_running,
)

CAMERA = ["camera_id"]
ORDER = ["t", "event_id"]


def sample_interval(seconds: float) -> float:
    return min(30.0, max(15.0, float(seconds)))


# --- greedy throttle -------------------------------------------------------------------------


def _next_allowed(ts: Sequence[float], last: float | None, gap: float, strict: bool, start: int = 0) -> int:
    """Index of the first time far enough from ``last``; ``len(ts)`` if there is none."""
    if last is None:
        return start
    j = bisect_left(ts, last + gap - 1e-6, start)
    while j < len(ts) and (ts[j] - last <= gap if strict else ts[j] - last < gap):
        j += 1
    return j


# A chunk as a function from the time kept last before it to the time kept last after it: the rows that could be accepted
# first, and the row each would lead to at the end. Beyond the last of them nothing is accepted.
Exits = tuple[list[float], list[float]]


def _chunk_exits(ts: list[float], start: float, gap: float, strict: bool) -> Exits:
    """The function of one chunk.

    Only rows within ``gap`` of the chunk's start, and the one after them, can come first. Of neighbouring
    entries with one exit only the last is kept.
    """
    exits: dict[int, float] = {}
    entries, outs = [], []
    i = 0
    while i < len(ts):
        path, k = [], i
        while k not in exits:
            path.append(k)
            nxt = _next_allowed(ts, ts[k], gap, strict, k + 1)
            if nxt >= len(ts):
                exits[k] = ts[k]
                break
            k = nxt
        for p in path:
            exits[p] = exits[k]
        _extend(entries, outs, ts[i], exits[i])
        if ts[i] > start + gap:
            break
        i += 1
    return entries, outs


def _extend(entries: list[float], outs: list[float], entry: float, out: float) -> None:
    if outs and outs[-1] == out:
        entries[-1] = entry
    else:
        entries.append(entry)
        outs.append(out)


def _after(f: Exits, last: float | None, gap: float, strict: bool) -> float | None:
    """The time kept last after a chunk that was entered with ``last``."""
    k = _next_allowed(f[0], last, gap, strict)
    return f[1][k] if k < len(f[0]) else last


def _composed(parts: list[Exits], start: float, gap: float, strict: bool) -> Exits:
    """The function of neighbouring chunks together. It has no more entries than a chunk's: those within
    ``gap`` of the common start and the one after them."""
    entries: list[float] = []
    outs: list[float] = []
    for f in parts:
        through = [_after(f, out, gap, strict) for out in outs]
        mine: Exits = ([], [])
        for entry, out in zip(entries, through):
            _extend(*mine, entry, out)
        # A row of this chunk comes first only where the earlier chunks accept none.
        if not entries or entries[-1] <= start + gap:
            for entry, out in zip(*f):
                _extend(*mine, entry, out)
                if entry > start + gap:
                    break
        entries, outs = mine
    return entries, outs


#: Chunks that one task follows or composes together.
FAN = 64


def _grouped(df: DataFrame, keys: Sequence[str], fn, extra: dict[str, T.DataType]) -> DataFrame:
    schema = T.StructType([*[df.schema[k] for k in keys], *[T.StructField(n, kind) for n, kind in extra.items()]])
    return df.groupBy(*keys).applyInPandas(fn, schema)


def exit_levels(nodes: DataFrame, keys: Sequence[str], gap: float, strict: bool = False, fan: int = FAN) -> list[DataFrame]:
    """``nodes`` (keys, ``_node, _parent, _start, _entries, _exits``) and, level by level, the composed functions of
    ``fan`` neighbours, until no key has more than ``fan`` nodes. No task gets more than ``fan`` of them."""
    doubles = T.ArrayType(T.DoubleType())

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_node")
        start = float(pdf["_start"].iloc[0])
        parts = [(e.tolist(), x.tolist()) for e, x in zip(pdf["_entries"], pdf["_exits"])]
        entries, outs = _composed(parts, start, gap, strict)
        return pdf[[*keys, "_parent"]].head(1).assign(_start=start, _entries=[entries], _exits=[outs])

    levels = [nodes]
    while (levels[-1].groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > fan:
        up = _grouped(levels[-1], [*keys, "_parent"], compose, {"_start": T.DoubleType(), "_entries": doubles, "_exits": doubles})
        up = up.withColumnRenamed("_parent", "_node").withColumn("_parent", F.floor(F.col("_node") / fan))
        levels.append(materialize(up))
    return levels


def _entering(levels: list[DataFrame], keys: Sequence[str], gap: float, strict: bool) -> DataFrame:
    """``(keys, _node, _last)``: the time kept last before each node of the lowest level."""

    def follow(by: list[str]):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_node")
            first = pdf["_last"].iloc[0]
            last, seen = None if pd.isna(first) else float(first), []
            for entries, outs in zip(pdf["_entries"], pdf["_exits"]):
                seen.append(last)
                last = _after((entries.tolist(), outs.tolist()), last, gap, strict)
            return pdf[[*by, "_node"]].assign(_last=pd.Series(seen, index=pdf.index, dtype="float64"))

        return run

    # ``_node`` travels as a column of the result, not as a key of the group.
    found = {"_node": T.LongType(), "_last": T.DoubleType()}
    top = levels[-1].select(*keys, "_node", "_entries", "_exits").withColumn("_last", F.lit(None).cast("double"))
    entering = _grouped(top, keys, follow(list(keys)), found)
    for below in reversed(levels[:-1]):
        came = entering.withColumnRenamed("_node", "_parent")
        d = join_keys(below.select(*keys, "_parent", "_node", "_entries", "_exits"), came, [*keys, "_parent"], "inner")
        entering = _grouped(d, [*keys, "_parent"], follow([*keys, "_parent"]), found).drop("_parent")
    return entering


def throttle(
    df: DataFrame,
    keys: Sequence[str],
    gap: float,
    order: Sequence[str] = ORDER,
    strict: bool = False,
    width: Width = None,
    fan: int = FAN,
) -> DataFrame:
    """Keep a row if it is the first or at least ``gap`` seconds (more, if ``strict``) after the last
    *kept* row of its key. Rows without a time are dropped.

    The choice is sequential, but a chunk only needs to know when the row kept before it was. Each
    chunk, at least two gaps long, is a function of that time. The functions of ``fan`` neighbours are composed, those of
    ``fan`` such groups again, and the times are handed down the same way: a parallel prefix in as many rounds as the
    logarithm of the number of chunks. Only times travel; whole rows meet the kept times in one join.
    """
    if gap <= 0 and not strict:
        return df.where(F.col(order[0]).isNotNull())
    keys, t = list(keys), order[0]
    length = chunk_for(chunk_width(df, keys, t, width), gap)
    times = df.select(*keys, F.col(t).cast("double").alias("_t")).where("_t is not null").withColumn("_width", length)
    times = times.withColumn("_node", F.floor(F.col("_t") / F.col("_width")))
    chunks = times.groupBy(*keys, "_node").agg(
        F.sort_array(F.collect_list("_t")).alias("_ts"), (F.col("_node") * F.max("_width")).alias("_start")
    )
    doubles = T.ArrayType(T.DoubleType())
    node = [*keys, "_node"]

    # A row is a whole chunk: Arrow bounds the bytes of a batch, so a task holds some tens of megabytes of times.
    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            found = [_chunk_exits(ts.tolist(), float(start), gap, strict) for ts, start in zip(d["_ts"], d["_start"])]
            yield d.assign(_entries=[f[0] for f in found], _exits=[f[1] for f in found])

    schema = T.StructType([*chunks.schema, T.StructField("_entries", doubles), T.StructField("_exits", doubles)])
    reports = chunks.mapInPandas(report, schema)
    reports = materialize(reports.withColumn("_parent", F.floor(F.col("_node") / fan)))
    entering = _entering(exit_levels(reports.drop("_ts"), keys, gap, strict, fan), keys, gap, strict)

    def followed(ts: list[float], last: float | None) -> list[float]:
        k = _next_allowed(ts, last, gap, strict)
        kept = []
        while k < len(ts):
            kept.append(ts[k])
            k = _next_allowed(ts, ts[k], gap, strict, k + 1)
        return kept

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            lasts = [None if pd.isna(last) else float(last) for last in d["_last"]]
            yield d[keys].assign(_kept=[followed(ts.tolist(), last) for ts, last in zip(d["_ts"], lasts)])

    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("_kept", doubles)])
    kept = join_keys(reports.select(*node, "_ts"), entering, node, "inner").mapInPandas(keep, schema)
    kept = kept.select(*keys, F.explode("_kept").alias("_t"))
    # Of rows at one time the first in order is kept.
    rows = join_keys(df.withColumn("_t", F.col(t).cast("double")), kept, [*keys, "_t"], "inner")
    first = F.row_number().over(Window.partitionBy(*keys, "_t").orderBy(*order))
    return rows.withColumn("_first", first).where("_first = 1").select(*df.columns)


# --- sessions, de-duplication, gates ---------------------------------------------------------


def dedupe_seq(
    df: DataFrame, keys: Sequence[str] = CAMERA, seq: str = "seq", order: Sequence[str] = ORDER, resets: DataFrame | None = None
) -> DataFrame:
    """Drop rows whose sequence number is not above every earlier one; null numbers always pass.

    Numbers start anew at each of ``resets`` (keys and time), as after a change of feed or mode.
    """
    if resets is not None:
        sessions = sessionize_resets(df, resets, keys, order[0]).withColumnRenamed("session_id", "_session")
        return dedupe_seq(sessions, [*keys, "_session"], seq, order).drop("_session")
    d = with_running(df, keys, order, {"_top": ("max_before", F.col(seq))}, t=order[0])
    return d.where(F.col(seq).isNull() | (F.col(seq) > F.coalesce("_top", F.lit(-1)))).drop("_top")


def sessionize_resets(df: DataFrame, resets: DataFrame, keys: Sequence[str] = CAMERA, t: str = "t") -> DataFrame:
    """Number sessions by explicit resets; rows at the time of a reset belong to the new session."""
    both = df.withColumn("_reset", F.lit(0)).unionByName(
        resets.select(*keys, t).withColumn("_reset", F.lit(1)), allowMissingColumns=True
    )
    both = both.withColumn("_seq", -F.col("_reset"))
    d = with_running(both, keys, [t, "_seq"], {"session_id": ("sum", F.col("_reset"))}, t=t)
    return d.where("_reset = 0").drop("_reset", "_seq")


def sessionize_gaps(
    df: DataFrame, max_gap: float, keys: Sequence[str] = CAMERA, order: Sequence[str] = ORDER
) -> DataFrame:
    """Number runs of rows whose neighbours are at most ``max_gap`` seconds apart, from 0."""
    t = order[0]
    width = chunk_width(df, keys, t)
    d = with_previous(df, keys, order, {"_before": F.col(t)}, t, width)
    split = F.coalesce((F.col(t) - F.col("_before") > max_gap).cast("int"), F.lit(0))
    d = with_running(d, keys, order, {"run_id": ("sum", split)}, t, width)
    return d.drop("_before")


def mode_gate(updates: DataFrame, modes: DataFrame, default: str = "counting") -> DataFrame:
    """Add the operating mode in force, when it began, and the analytics status it implies.

    Modes apply to every camera, so both tables are cut into the same stretches of time: a stretch gets its own changes and
    the mode in force at its start, handed on from the stretches before. No change is copied. Only rows with status
    ``active`` may refresh analytics.
    """
    d = asof(updates, modes.select("t", "mode"), [], ["mode"])
    mode = F.coalesce("mode", F.lit(default))
    status = F.when(mode != "counting", "disabled").when(~F.col("analytics_active"), "starting").otherwise("active")
    return d.withColumn("analytics_status", status).withColumn("mode", mode).withColumnRenamed("matched_t", "mode_since")


def presence_states(polls: DataFrame, confirm: int = 2, keys: Sequence[str] = CAMERA) -> DataFrame:
    """State and change events of each camera over successful polls (``poll_ok``, ``ready``).

    Online at once; offline after ``confirm`` successive misses; failed polls change nothing.
    """
    good = polls.where("poll_ok")
    width = chunk_width(good, keys, "t")
    good = number_rows(good, keys, ["t", "poll_id"], width=width, name="_n")
    seen = F.when(F.col("ready"), F.col("_n"))
    d = with_running(good, keys, ["_n"], {"_seen": ("max_before", seen)}, width=width)
    since = F.col("_n") - F.col("_seen")
    event = (
        F.when(F.col("ready") & (F.col("_seen").isNull() | (since > confirm)), "online")
        .when(~F.col("ready") & (since == confirm), "offline")
    )
    online = F.col("ready") | F.coalesce(since < confirm, F.lit(False))
    return d.withColumn("change", event).withColumn("online", online).drop("_n", "_seen")


# --- smoothing -------------------------------------------------------------------------------


def ensure_rn(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], width: Width = None, parts: int | None = None
) -> DataFrame:
    return df if "rn" in df.columns else number_rows(df, keys, order, order[0], width, parts=parts)


def rolling_median(
    df: DataFrame, k: int, col: str = "count", out: str = "median", keys: Sequence[str] = CAMERA, order: Sequence[str] = ORDER
) -> DataFrame:
    """Median of the newest ``k`` values, fewer at the start. Leaves the row number ``rn``."""
    d = with_row_halo(ensure_rn(df, keys, order), k - 1)
    w = Window.partitionBy(*keys, "_chunk").orderBy("rn").rowsBetween(-(k - 1), 0)
    return home_rows(d.withColumn(out, frame_percentile(col, 0.5, w)))


def _decay_layout(alpha: float) -> tuple[int, int]:
    """Rows of lead-in after which older values vanish, and rows per block that cannot overflow."""
    digits = -math.log10(1.0 - alpha)
    lead = math.ceil(18 / digits)
    return lead, max(1, min(K.BLOCK_ROWS, int(240 / digits) - lead))


def ema(
    df: DataFrame,
    col: str,
    alpha: float,
    out: str,
    reset_on: Column | None = None,
    keys: Sequence[str] = CAMERA,
    order: Sequence[str] = ORDER,
    width: Width = None,
    parts: int | None = None,
) -> DataFrame:
    """Exponential average seeded with 0; rows where ``reset_on`` holds give 0 and start over.

    ``s[t] = alpha * sum((1-alpha)**(t-i) * x[i])``: a running sum of values scaled by position,
    scaled back. Values older than the lead-in weigh less than a rounding error. Chunks and blocks are dealt into
    ``parts`` partitions if given.
    """
    lead, size = _decay_layout(alpha)
    d = with_row_halo(ensure_rn(df, keys, order, width, parts), lead, size=size)
    if parts:
        d = d.repartition(parts, *keys, "_chunk")
    block = Window.partitionBy(*keys, "_chunk").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    pos = F.col("rn") - F.col("_chunk") * size + lead
    grow = F.pow(F.lit(1.0 - alpha), -pos)
    value = F.col(col) * alpha * grow
    if reset_on is None:
        return home_rows(d.withColumn(out, F.sum(value).over(block) / grow))
    reset = F.coalesce(reset_on, F.lit(False))
    d = d.withColumn("_seg", F.sum(reset.cast("int")).over(block))
    seg = Window.partitionBy(*keys, "_chunk", "_seg").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.when(reset, 0.0).otherwise(value)).over(seg)
    return home_rows(d.withColumn(out, total / grow).drop("_seg"))


def stabilize(
    df: DataFrame,
    k: int = 3,
    alpha: float = K.COUNT_ALPHA,
    scale="scale",
    bias="bias",
    keys: Sequence[str] = CAMERA,
    order: Sequence[str] = ORDER,
    out: str = "stable",
) -> DataFrame:
    """Stable count from ``density`` and ``detections``: calibrated maximum, median of ``k``,
    exponential average, never below the detections of the moment.

    With ``u = s / (1-alpha)**t`` the floored average becomes ``u[t] = max(d', u[t-1] + x')``: a
    running sum plus a running maximum.
    """
    detected = F.greatest(F.lit(0.0), F.col("detections").cast("double"))
    raw = F.greatest(S.apply_calibration("density", scale, bias), detected)
    d = ensure_rn(df.withColumn("_raw", raw), keys, order)
    lead, size = (0, K.BLOCK_ROWS) if alpha >= 1.0 else _decay_layout(alpha)
    # One halo serves both: medians cut short at its start are older than the lead-in.
    d = with_row_halo(d, lead + k - 1, size=size)
    w = Window.partitionBy(*keys, "_chunk").orderBy("rn")
    d = d.withColumn("_target", frame_percentile("_raw", 0.5, w.rowsBetween(-(k - 1), 0))).drop("_raw")
    if alpha >= 1.0:
        return home_rows(d.withColumn(out, F.greatest("_target", detected))).drop("_target")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    pos = F.col("rn") - F.col("_chunk") * size + lead
    d = d.withColumn("_grow", F.pow(F.lit(1.0 - alpha), -pos))
    weight = F.when(F.col("rn") == 1, 1.0).otherwise(alpha)
    d = d.withColumn("_sum", F.sum(F.col("_target") * weight * F.col("_grow")).over(upto))
    d = d.withColumn("_lift", F.max(detected * F.col("_grow") - F.col("_sum")).over(upto))
    value = (F.col("_sum") + F.greatest(F.lit(0.0), F.col("_lift"))) / F.col("_grow")
    return home_rows(d.withColumn(out, value)).drop("_target", "_grow", "_sum", "_lift")


# --- alert ticker ----------------------------------------------------------------------------


def alert_ticker(active: DataFrame, keys: Sequence[str] = CAMERA) -> DataFrame:
    """One alert per camera and tick from (``tick, t, pos, alert``): most severe first in list order,
    else the last listed. Hidden after 30 s of being shown without a break, dimmed after 10 s."""
    own = [*keys, "alert"]
    width = chunk_width(active, own, "t")
    d = with_previous(active, own, ["t"], {"_before": F.col("tick")}, width=width)
    fresh = F.coalesce(F.col("_before") != F.col("tick") - 1, F.lit(True))
    d = with_running(d, own, ["t"], {"_since": ("max", F.when(fresh, F.col("t")))}, width=width)
    # Words that mark the two severity classes.
    severity = (
        F.when(F.col("alert").rlike("CRITICAL|EVACUATE|STAMPEDE"), 0)
        .when(F.col("alert").rlike("HIGH|EXPANDING|OPPOSING"), 1)
        .otherwise(2)
    )
    d = d.withColumn("_sev", severity)
    rank = Window.partitionBy(*keys, "tick").orderBy(
        "_sev", F.when(F.col("_sev") == 2, -F.col("pos")).otherwise(F.col("pos"))
    )
    d = d.withColumn("_rank", F.row_number().over(rank)).where("_rank = 1")
    shown = F.col("t") - F.col("_since")
    return d.where(shown <= 30.0).select(*keys, "tick", "t", "alert", (shown > 10.0).alias("dimmed"))
