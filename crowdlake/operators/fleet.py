"""Fleet state: lookups, presence, current state, telemetry and feed health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from crowdlake import constants as K
from crowdlake.functions import scalars as S
from crowdlake.operators.materialize import materialize
from crowdlake.operators.scale import keep_latest, number_rows, with_previous, with_running

CAMERA = ["camera_id"]
# What the fields that belong to counting return to when no result is valid.
ANALYTICS = {
    "people_count": 0,
    "comp_zone": "SAFE",
    "pressure": 0.0,
    "stampede_prob": 0.0,
    "risk_index": 0.0,
    "risk_level": "SAFE",
    "confidence": 1.0,
    "primary_causes": [],
    "motion_speed": 0.0,
    "turbulence": 0.0,
    "hotspot_alert": "",
    "opposing_alert": "",
    "gps_alerts": [],
    "zone_scores": None,
}


# --- lookups ---------------------------------------------------------------------------------


def with_zone_dims(df: DataFrame, capacities: DataFrame, bounds: DataFrame) -> DataFrame:
    """Add ``capacity`` of (camera, r, c) and the camera's GPS bounds.

    ``capacities`` is keyed by (camera_idx, r, c); cameras beyond its last index use that one.
    """
    last = capacities.agg(F.max("camera_idx")).scalar()
    idx = F.least(F.regexp_extract("camera_id", "([0-9]+)$", 1).cast("int") - 1, last)
    d = df.withColumn("camera_idx", idx)
    d = d.join(capacities.select("camera_idx", "r", "c", "capacity"), ["camera_idx", "r", "c"], "left")
    gps = bounds.select("camera_id", "lat_min", "lat_max", "lon_min", "lon_max")
    return d.join(gps, "camera_id", "left").drop("camera_idx")


def resolve_paths(paths: DataFrame, cameras: DataFrame) -> DataFrame:
    """Camera and role of each stream ``path``, trying the path as given and two other spellings.

    Only distinct paths are matched; ``cameras`` holds ``camera_id, source_path, output_path``.
    """
    known = cameras.select(
        "camera_id",
        F.inline(
            F.array(
                F.struct(F.trim(F.col("source_path"), F.lit("/")).alias("key"), F.lit("source").alias("role"), F.lit(0).alias("prio")),
                F.struct(F.trim(F.col("output_path"), F.lit("/")).alias("key"), F.lit("output").alias("role"), F.lit(1).alias("prio")),
            )
        ),
    )
    # A path registered twice belongs to the output.
    known = known.where("key <> ''").groupBy("key").agg(F.max_by(F.struct("camera_id", "role"), "prio").alias("_hit"))
    path = F.trim(F.coalesce("path", F.lit("")), F.lit("/"))
    norm = S.normalize_camera_id(F.expr("substring(_p, length(substring_index(_p, '/', 1)) + 2)"))

    def respelled(name):
        return F.when(F.contains("_p", F.lit("/")), F.concat(F.substring_index("_p", "/", 1), F.lit("/"), name))

    tries = F.array(F.col("_p"), respelled(F.replace(norm, F.lit("-"), F.lit(""))), respelled(norm))
    distinct = paths.select("path").distinct().withColumn("_p", path)
    cand = distinct.select("path", F.posexplode(tries).alias("_n", "key")).join(known, "key")
    best = cand.groupBy("path").agg(F.min_by("_hit", "_n").alias("_hit"))
    return paths.join(best, "path", "left").select(
        *paths.columns, F.col("_hit.camera_id").alias("camera_id"), F.col("_hit.role").alias("role")
    )


def ready_paths(polls: DataFrame) -> DataFrame:
    """Distinct published paths per successful poll from ``items`` (name, ready, available, online)."""
    item = polls.where("ok").select("poll_id", "t", F.explode("items").alias("_i"))
    ready = F.coalesce("_i.ready", "_i.available", F.lit(False))
    online = F.coalesce(F.col("_i.online"), ready)
    name = F.trim(F.coalesce("_i.name", F.lit("")), F.lit("/"))
    return item.where(ready & online & (name != "")).select("poll_id", "t", name.alias("path")).distinct()


def missed_cameras(polls: DataFrame, ready: DataFrame, cameras: DataFrame, step: int = 100_000) -> DataFrame:
    """Cameras not published in each successful poll. ``polls(poll_id, ok)``, ``ready(poll_id, camera_id)``.

    Polls get gapless numbers; what a camera misses are the gaps between the numbers of its own polls. Only gaps are
    expanded, ``step`` numbers a row at most, so the work follows the published and the missed rows, not polls times cameras.
    """
    # Any gapless numbering serves. By hash it needs no order over all polls: 4,096 counts are added up.
    asked = polls.where("ok and poll_id is not null").select("poll_id").distinct()
    asked = asked.withColumn("_bucket", F.pmod(F.xxhash64("poll_id"), F.lit(4096)).cast("double"))
    numbered = materialize(number_rows(asked, [], ["_bucket", "poll_id"], t="_bucket", width=1.0).drop("_bucket"))
    last = numbered.agg(F.coalesce(F.max("rn"), F.lit(0))).scalar()
    everyone = cameras.select("camera_id").distinct()
    mine = ready.select("poll_id", "camera_id").distinct().join(numbered, "poll_id").join(everyone, "camera_id").select("camera_id", "rn")
    ends = everyone.select("camera_id", F.explode(F.array(F.lit(0).cast("bigint"), last + 1)).alias("rn"))
    d = with_previous(mine.unionByName(ends), CAMERA, ["rn"], {"_before": F.col("rn")}, t="rn", width=float(step))
    gaps = d.where("rn - _before > 1").select("camera_id", (F.col("_before") + 1).alias("_from"), (F.col("rn") - 1).alias("_to"))
    parts = gaps.withColumn("_from", F.explode(F.expr(f"sequence(_from, _to, {step}L)")))
    to = F.least("_to", F.col("_from") + (step - 1))
    missed = parts.select("camera_id", F.explode(F.sequence("_from", to)).alias("rn"))
    return missed.join(numbered, "rn").select("poll_id", "camera_id")


def path_changes(polls: DataFrame, ready: DataFrame) -> DataFrame:
    """Paths that appeared or vanished since the previous successful poll."""
    # Polls get ordinals; a path appears at one that does not follow one of its own, and vanishes at the next.
    numbered = number_rows(polls.where("ok").select("poll_id", "t").distinct(), [], ["t", "poll_id"])
    seen = ready.select("poll_id", "path").distinct().join(numbered.select("poll_id", "rn"), "poll_id").select("path", "rn")
    next_ = seen.select("path", (F.col("rn") + 1).alias("rn"))
    kinds = (
        seen.join(next_, ["path", "rn"], "left_anti").withColumn("_new", F.lit(True))
        .unionByName(next_.join(seen, ["path", "rn"], "left_anti").withColumn("_new", F.lit(False)))
    )

    def paths(new: bool) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("_new") == new, F.col("path"))))

    changes = kinds.groupBy("rn").agg(paths(True).alias("appeared"), paths(False).alias("vanished"))
    nothing = F.array().cast("array<string>")
    return numbered.join(changes, "rn", "left").select(
        "poll_id", "t", F.coalesce("appeared", nothing).alias("appeared"), F.coalesce("vanished", nothing).alias("vanished")
    )


# --- current state ---------------------------------------------------------------------------


def current_state(updates: DataFrame, order: Sequence[str] = ("t", "event_id"), keys: Sequence[str] = CAMERA) -> DataFrame:
    """Newest row per camera; analytics fields of inactive cameras return to their defaults."""
    cols = [c for c in updates.columns if c not in keys]
    # The newest time alone is a hash aggregate; only rows that carry it are compared as a whole.
    top = updates.groupBy(*keys).agg(F.max(order[0]).alias("_top"))
    newest = updates.join(top, list(keys)).where(F.col(order[0]) == F.col("_top"))
    latest = newest.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r")).select(*keys, "_r.*")
    return reset_analytics(latest, ~F.coalesce("analytics_active", F.lit(False))) if "analytics_active" in cols else latest


def reset_analytics(df: DataFrame, when: Column) -> DataFrame:
    """Return the counting fields of ``df`` to their defaults where ``when`` holds."""
    back = {}
    for name, default in ANALYTICS.items():
        if name in df.columns:
            value = F.array() if default == [] else F.lit(default)
            back[name] = F.when(when, value.cast(df.schema[name].dataType)).otherwise(F.col(name))
    return df.withColumns(back) if back else df


def freshness(latest: DataFrame, now, ttl: float = K.STALE_AFTER) -> DataFrame:
    """Age of each camera's newest result at ``now``; an active one older than ``ttl`` turns stale."""
    now = F.lit(now)
    age = now - F.col("t")
    stale = (F.col("analytics_status") == "active") & (age > ttl)
    d = latest.withColumn("age_s", F.bround(F.greatest(F.lit(0.0), age), 1))
    d = reset_analytics(d.withColumn("_stale", F.coalesce(stale, F.lit(False))), F.col("_stale"))
    return d.withColumn("analytics_status", F.when(F.col("_stale"), "stale").otherwise(F.col("analytics_status"))).drop("_stale")


def connection_status(
    events: DataFrame, counting: bool = True, keys: Sequence[str] = CAMERA, order: Sequence[str] = ("t", "event_id")
) -> DataFrame:
    """Connection state after each path event (``role`` source/output, ``online``, ``enabled``).

    A source that goes away takes its output with it; without an output, viewers get the raw path.
    """
    is_source = F.col("role") == "source"
    d = with_running(
        events,
        keys,
        order,
        {
            "source_online": ("last", F.when(is_source, F.col("online"))),
            "output_online": (
                "last",
                F.when(~is_source, F.col("online")).when(~F.col("online"), F.lit(False)),
            ),
        },
        t=order[0],
    )
    d = d.withColumn("source_online", F.coalesce("source_online", F.lit(False)))
    d = d.withColumn("output_online", F.coalesce("output_online", F.lit(False)))
    live = F.when(F.col("enabled"), "online").otherwise("offline")
    status = (
        F.when(F.col("online"), live)
        .when(is_source, "connecting")
        .when(F.col("source_online") & F.col("enabled"), "online")
        .otherwise("connecting")
    )
    raw = F.col("source_online") & (~F.lit(counting) | ~F.col("output_online"))
    return d.withColumn("status", status).withColumn("playback", F.when(raw, "source").otherwise("output"))


def fleet_state(latest: DataFrame, tick: str = "tick") -> DataFrame:
    """One row per tick: worst camera by (zone rank, pressure), all alert messages, all cameras.

    ``latest`` holds one row per (tick, camera): ``zone, pressure, alert`` and a summary of each.
    """
    rank = S.zone_rank("zone")
    # Ties keep the camera with the lower number.
    number = F.regexp_extract("camera_id", "([0-9]+)$", 1).cast("int")
    best = F.struct(rank, F.col("pressure"), -number)
    summary = F.struct(number.alias("n"), F.col("camera_id"), F.col("zone"), F.bround("pressure", 1).alias("pressure"))
    out = latest.groupBy(tick).agg(
        F.max_by(F.struct("camera_id", rank.alias("rank"), "pressure"), best).alias("_w"),
        F.array_sort(F.collect_list(F.when(F.col("alert").isNotNull(), F.struct(number.alias("n"), F.col("alert").alias("a"))))).alias("_a"),
        F.array_sort(F.collect_list(summary)).alias("cameras"),
    )
    zone = F.element_at(F.array(*[F.lit(x) for x in K.RISK_LABELS]), F.col("_w.rank") + 1)
    return out.select(
        tick,
        zone.alias("worst_zone"),
        F.bround("_w.pressure", 1).alias("worst_pressure"),
        F.col("_w.camera_id").alias("worst_camera"),
        F.transform("_a", lambda s: s["a"]).alias("critical_alerts"),
        "cameras",
    )


def fleet_view(state: DataFrame, location: str | None = None, category: str | None = None, online: bool | None = None) -> DataFrame:
    for name, wanted in (("location", location), ("category", category), ("online", online)):
        if wanted is not None:
            state = state.where(F.col(name) == wanted)
    return state


# --- telemetry -------------------------------------------------------------------------------


def telemetry_summary(df: DataFrame, now, keys: Sequence[str] = CAMERA, seconds: float = 10.0) -> DataFrame:
    """Means over each camera's last seconds, or over its last five rows if none are that recent."""
    recent = F.coalesce(F.lit(now) - F.col("t") <= seconds, F.lit(False))
    five = keep_latest(df, keys, 5, ["t", "event_id"]).withColumn("_hot", F.max(recent.cast("int")).over(Window.partitionBy(*keys)))
    d = df.where(recent).unionByName(five.where("_hot = 0").drop("_hot"))

    def mean(name):
        return F.coalesce(F.avg(name), F.lit(0.0))

    return d.groupBy(*keys).agg(
        (mean("latency_s") * 1000).alias("latency_ms"),
        (mean("infer_s") * 1000).alias("infer_ms"),
        mean("fps").alias("fps"),
        mean("drop_pct").alias("drop_pct"),
        F.max("reconnects").alias("max_reconnects"),
        F.count(F.lit(1)).alias("rows_used"),
    )


def feed_health(frames: DataFrame, now, keys: Sequence[str] = CAMERA, recent: int = 120) -> DataFrame:
    """Frame rate over the last frames, drop percentage and uptime from ``t, event_id, dropped``."""
    last = keep_latest(frames.where(~F.col("dropped")), keys, recent, ["t", "event_id"]).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), (F.max("t") - F.min("t")).alias("_span")
    )
    totals = frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("reads"), F.count_if("dropped").alias("drops"), F.min("t").alias("_start")
    )
    fps = F.when((F.col("_n") >= 2) & (F.col("_span") > 0), (F.col("_n") - 1) / F.col("_span")).otherwise(25.0)
    return totals.join(last, list(keys), "left").select(
        *keys,
        F.bround(fps, 1).alias("live_fps"),
        F.bround(F.col("drops") / F.greatest("reads", F.lit(1)) * 100, 2).alias("drop_rate_pct"),
        F.col("drops").alias("reconnects"),
        F.bround(F.lit(now) - F.col("_start"), 1).alias("uptime_s"),
    )
