"""Current state, fleet, telemetry and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from crowdlake.functions import scalars as S
from crowdlake.operators import alerts as L, calibration as C, fleet, risk as R, temporal as T
from crowdlake.plans.forecast_queries import SELECT, SURGE_ROWS, TABLES as FORECAST_TABLES, surges
from crowdlake.plans.registry import query, rounded, sql
from crowdlake.sources import adapters as A, sinks

# The instant the state is looked at, in seconds after the epoch of ``t``.
NOW = 25_930.0

_UPDATES = """select 'drone-' || right(drone_id, 1) as camera_id, t, event_id, analytics_active,
    cast(round_even(density_score, 0) as bigint) as people_count, density_score / 500 as confidence from stats_updates"""


def updates(spark, sf):
    return A.stats_updates(spark, sf).select(
        S.normalize_camera_id("drone_id").alias("camera_id"), "t", "event_id", "analytics_active",
        S.half_even("density_score").alias("people_count"), (F.col("density_score") / 500).alias("confidence"),
    )


@query(
    "current_camera_state",
    sql(
        """select camera_id, event_id, case when analytics_active then people_count else 0 end as people_count,
        round(case when analytics_active then confidence else 1 end, 6) as confidence from updates
        qualify row_number() over (partition by camera_id order by t desc) = 1""",
        "stats_updates",
        updates=_UPDATES,
    ),
)
def current_camera_state(spark, sf):
    d = fleet.current_state(updates(spark, sf)).select("camera_id", "event_id", "people_count", "confidence")
    return rounded(d, "confidence")


@query(
    "analytics_freshness",
    sql(
        f"""select camera_id, minute, case when age > 20 then 'stale' else 'active' end as analytics_status, round_even(age, 1) as age_s,
        case when age > 20 then 0 else people_count end as people_count
        from (select *, (minute + 1) * 60 - t as age from updates join (select camera_id, floor(t / 60) as minute, max(t) as t from updates group by 1, 2) m using (camera_id, t))""",
        "stats_updates",
        updates=_UPDATES,
    ),
)
def analytics_freshness(spark, sf):
    u = updates(spark, sf).drop("analytics_active").withColumn("minute", F.floor(F.col("t") / 60).cast("double"))
    newest = fleet.current_state(u, keys=["camera_id", "minute"]).withColumn("analytics_status", F.lit("active"))
    d = fleet.freshness(newest, (F.col("minute") + 1) * 60)
    return d.select("camera_id", "minute", "analytics_status", "age_s", "people_count")


_PATH_EVENTS = """select 'drone-' || (user_id % 8 + 1) as camera_id, event_id, (epoch_us(ts) - 1704067200000000) / 1e8 as t,
    case when event_id % 3 = 0 then 'output' else 'source' end as role, event_type <> 'error' and event_type <> 'click' as online, user_id % 8 <> 5 as enabled from events"""


@query(
    "connection_states",
    sql(
        """select camera_id, event_id, coalesce(src, false) as source_online, coalesce(outp, false) as output_online,
        case when online then case when enabled then 'online' else 'offline' end when role = 'source' then 'connecting'
          when coalesce(src, false) and enabled then 'online' else 'connecting' end as status,
        case when coalesce(src, false) and not coalesce(outp, false) then 'source' else 'output' end as playback
        from (select *, last_value(case when role = 'source' then online end ignore nulls) over w as src,
          last_value(case when role = 'output' then online when not online then false end ignore nulls) over w as outp
          from path_events window w as (partition by camera_id order by t rows unbounded preceding))""",
        path_events=_PATH_EVENTS,
    ),
)
def connection_states(spark, sf):
    ev = A.events(spark, sf).selectExpr(
        A.CAMERA, "event_id", f"{A.T} as t", "case when event_id % 3 = 0 then 'output' else 'source' end as role",
        "event_type <> 'error' and event_type <> 'click' as online", "user_id % 8 <> 5 as enabled",
    )
    return fleet.connection_status(ev).select("camera_id", "event_id", "source_online", "output_online", "status", "playback")


_TICKS = """select camera_id, tick, density / 60 as pressure, case when hotspot_ratio < 0.25 then 'SAFE' when hotspot_ratio < 0.5 then 'WATCH'
    when hotspot_ratio < 0.75 then 'HIGH' else 'CRITICAL' end as zone, cast(right(camera_id, 1) as int) as n
    from (select *, cast(floor(t / 60) as bigint) as tick from observations)
    qualify row_number() over (partition by camera_id, tick order by t desc) = 1"""


@query(
    "fleet_state_by_tick",
    sql(
        """select tick, arg_max(zone, (rk, pressure, -n)) as worst_zone, round_even(arg_max(pressure, (rk, pressure, -n)), 1) as worst_pressure,
        arg_max(camera_id, (rk, pressure, -n)) as worst_camera, count(*) as cameras,
        coalesce(string_agg(zone || ' at ' || camera_id, '; ' order by n) filter (where rk >= 2), '') as critical_alerts
        from (select *, case zone when 'SAFE' then 0 when 'WATCH' then 1 when 'HIGH' then 2 else 3 end as rk from ticks) group by 1""",
        "observations",
        ticks=_TICKS,
    ),
)
def fleet_state_by_tick(spark, sf):
    obs = A.observations(spark, sf).select(
        "camera_id", "t", "frame_id", F.floor(F.col("t") / 60).alias("tick"), (F.col("density") / 60).alias("pressure"),
        S.risk_zone("hotspot_ratio", "four_level").alias("zone"),
    )
    latest = fleet.current_state(obs, ("t", "frame_id"), ["camera_id", "tick"])
    alert = F.when(S.zone_rank("zone") >= 2, F.concat("zone", F.lit(" at "), "camera_id"))
    d = fleet.fleet_state(latest.withColumn("alert", alert))
    return d.select(
        "tick", "worst_zone", "worst_pressure", "worst_camera",
        F.size("cameras").cast("bigint").alias("cameras"), F.array_join("critical_alerts", "; ").alias("critical_alerts"),
    )


@query(
    "fleet_view_by_filter",
    sql(
        "select u.camera_id, u.event_id, k.location from updates u join cameras k on u.camera_id = k.camera_id where category = 'DRONE' and analytics_active",
        "stats_updates",
        "cameras",
        updates=_UPDATES,
    ),
)
def fleet_view_by_filter(spark, sf):
    d = updates(spark, sf).join(A.cameras(spark, sf), "camera_id").withColumn("online", F.col("analytics_active"))
    return fleet.fleet_view(d, category="DRONE", online=True).select("camera_id", "event_id", "location")


@query(
    "telemetry_summaries",
    sql(
        f"""select camera_id, round(coalesce(avg(latency_s), 0) * 1000, 6) as latency_ms, round(coalesce(avg(infer_s), 0) * 1000, 6) as infer_ms,
        round(avg(fps), 6) as fps, round(avg(drop_pct), 6) as drop_pct, max(reconnects) as max_reconnects, count(*) as rows_used
        from (select *, count(*) filter (where {NOW} - t <= 10) over (partition by camera_id) as hot,
          row_number() over (partition by camera_id order by t desc) as k from telemetry)
        where case when hot > 0 then {NOW} - t <= 10 else k <= 5 end group by 1""",
        "telemetry",
    ),
)
def telemetry_summaries(spark, sf):
    return rounded(fleet.telemetry_summary(A.telemetry(spark, sf), NOW), "latency_ms", "infer_ms", "fps", "drop_pct")


@query(
    "feed_health_reports",
    sql(
        f"""select camera_id, round_even(coalesce((n - 1) / nullif(span, 0), 25), 1) as live_fps, round_even(drops / reads * 100, 2) as drop_rate_pct,
        drops as reconnects, round_even({NOW} - start, 1) as uptime_s
        from (select camera_id, count(*) as reads, count(*) filter (where d) as drops, min(t) as start,
          count(*) filter (where not d and k <= 120) as n, max(t) filter (where not d and k <= 120) - min(t) filter (where not d and k <= 120) as span
          from (select *, event_type = 'error' as d, row_number() over (partition by camera_id, event_type = 'error' order by t desc) as k from samples) group by 1)""",
        "samples",
    ),
)
def feed_health_reports(spark, sf):
    frames = A.samples(spark, sf).select("camera_id", "t", "event_id", (F.col("event_type") == "error").alias("dropped"))
    return fleet.feed_health(frames, NOW)


_NOTES = """select u.*, g.horizon, g.predicted_count, g.growth_percent, g.sure from updates u left join surge_rows g using (camera_id, t, event_id)
    where g.horizon is not null or u.people_count >= 65"""
_NOTED = """select n.* from notes n join keep k on n.camera_id = k.camera_id and n.t = k.t order by n.t desc limit 200"""
_KEEP = """select camera_id, min(t) as t from notes group by 1 union all
    select k.camera_id, min(n.t) from keep k join notes n on n.camera_id = k.camera_id and n.t - k.t > 30 group by 1"""
_NOTIFIED = {**SELECT, "surge_rows": SURGE_ROWS, "updates": _UPDATES, "notes": _NOTES, "keep": _KEEP, "noted": _NOTED}


def _notifications(spark, sf):
    """The state of the cameras and the surges that their count histories forecast."""
    u = updates(spark, sf).withColumn("risk_index", F.col("people_count").cast("double"))
    u = u.withColumn("risk_level", S.band("risk_index", (65.0,), ("NO STAMPEDE", "STAMPEDE")))
    return L.notifications(u, surges(spark, sf), A.cameras(spark, sf))


@query(
    "surge_notifications",
    sql(
        """select 'notif-' || event_id || '-' || n.camera_id as notification_id, location, people_count,
        greatest(85, case when confidence <= 1 then round_even(confidence * 100, 1) else round_even(confidence, 1) end) as confidence_percent,
        coalesce(round_even((lat_min + lat_max) / 2, 6), 0) as gps_lat, coalesce(round_even((lon_min + lon_max) / 2, 6), 0) as gps_lon,
        'STAMPEDE WARNING: ' || coalesce('Predicted crowd surge to ' || predicted_count || ' pax (+' || cast(round_even(growth_percent, 0) as bigint)
            || '% growth) in next ' || horizon || ' [Confidence: ' || cast(round_even(sure, 0) as bigint) || '%]',
          people_count || ' pax detected at ' || n.camera_id) as message
        from noted n left join cameras k on n.camera_id = k.camera_id""",
        *FORECAST_TABLES,
        "stats_updates",
        "cameras",
        **_NOTIFIED,
    ),
)
def surge_notifications(spark, sf):
    return _notifications(spark, sf).select(
        "notification_id", "location", "people_count", "confidence_percent", "gps_lat", "gps_lon", "message"
    )


@query(
    "notification_totals",
    sql("select count(*) as total, count(*) as unread_count from noted", *FORECAST_TABLES, "stats_updates", **_NOTIFIED),
)
def notification_totals(spark, sf):
    return L.notification_counts(_notifications(spark, sf))


# --- calibration -----------------------------------------------------------------------------


def labels(spark, sf):
    return A.labels(spark, sf).withColumn("sample_no", F.col("l_orderkey") * 8 + F.col("l_linenumber"))


@query(
    "calibration_fits",
    sql(
        """select camera_id, angle, round(greatest(0, regr_slope(actual_count, predicted_count)), 6) as scale,
        round(regr_intercept(actual_count, predicted_count), 6) as bias, count(*) as samples from labels_in where actual_count >= 0 group by 1, 2 having count(*) >= 3""",
        "labels_in",
    ),
)
def calibration_fits(spark, sf):
    return rounded(C.fit_calibration(labels(spark, sf), ["camera_id", "angle"]), "scale", "bias")


@query(
    "count_accuracies",
    sql(
        """select camera_id, round(greatest(0, least(100, 100 - avg(abs(predicted_count - actual_count) / greatest(actual_count, 1)) * 100)), 6) as accuracy_percent,
        count(*) as samples from labels_in where actual_count >= 0 group by 1""",
        "labels_in",
    ),
)
def count_accuracies(spark, sf):
    return rounded(C.count_accuracy(labels(spark, sf)), "accuracy_percent")


_HELD = """select *, case when size < 5 then rn = size else rn % 5 = 0 end as held from (select *, count(*) over (partition by camera_id, angle) as size,
    row_number() over (partition by camera_id, angle order by sample_no, predicted_count, actual_count) as rn from labels_in where actual_count >= 0)"""


_PROFILES = """select f.camera_id, round(round_even(f.s, 8), 6) as scale, round(round_even(f.b, 8), 6) as bias, round_even(acc, 2) as validated_accuracy_percent,
        acc >= 90 and worst >= 90 as target_met, by_angle, f.n as sample_count
        from (select camera_id, greatest(0, regr_slope(actual_count, predicted_count)) as s, regr_intercept(actual_count, predicted_count) as b, count(*) as n
              from labels_in where actual_count >= 0 group by 1) f
        join (select camera_id, 100 - sum(e) / sum(n) * 100 as acc, min(round_even(100 - e / n * 100, 2)) as worst,
                string_agg(angle || '=' || printf('%.2f', round_even(100 - e / n * 100, 2)), ',' order by angle) as by_angle
              from (select h.camera_id, angle, count(*) as n, sum(abs(greatest(0, predicted_count * ts + tb) - actual_count) / greatest(actual_count, 1)) as e
                from held h join (select camera_id, greatest(0, regr_slope(actual_count, predicted_count)) as ts, regr_intercept(actual_count, predicted_count) as tb
                  from held where not held group by 1) t on h.camera_id = t.camera_id where held group by 1, 2) group by 1) v
        on f.camera_id = v.camera_id"""


@query("validated_calibration_profiles", sql(_PROFILES, "labels_in", held=_HELD))
def validated_calibration_profiles(spark, sf):
    d = C.validate_calibration(labels(spark, sf))
    listed = F.transform(F.array_sort(F.map_entries("accuracy_by_angle")), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.2f", e["value"])))
    d = d.select(
        "camera_id", "scale", "bias", "validated_accuracy_percent", "target_met", F.array_join(listed, ",").alias("by_angle"), "sample_count"
    )
    return rounded(d, "scale", "bias")


@query(
    "calibration_verdict",
    sql(
        """select bool_and(target_met) as approved, count(*) as profiles,
        coalesce(string_agg(camera_id, ',' order by camera_id) filter (where not target_met), '') as failed from profiles""",
        "labels_in",
        held=_HELD,
        profiles=_PROFILES,
    ),
)
def calibration_verdict(spark, sf):
    d = sinks.publish_verdict(C.validate_calibration(labels(spark, sf)))
    return d.withColumn("failed", F.array_join("failed", ","))


@query(
    "calibration_row_picks",
    sql(
        """select pick, source, event_id, round(count, 6) as count from (select *, row_number() over (order by count, source) as rk, count(*) over () as m from mid) a
        join (select unnest(range(0, 20)) as pick) on rk = case when m <= 20 then pick + 1 else cast(round_even(pick * (m - 1) / 19, 0) as bigint) + 1 end""",
        mid="""select source, event_id, count from (select *, row_number() over (partition by source order by second, event_id) as rn, count(*) over (partition by source) as n
        from (select 'v' || (user_id % 97) as source, event_id, (epoch_us(ts) - 1704067200000000) / 1e8 as second, value as count from events)) where rn = n // 2 + 1""",
    ),
)
def calibration_row_picks(spark, sf):
    hist = A.events(spark, sf).selectExpr("concat('v', user_id % 97) as source", "event_id", f"{A.T} as second", "value as count")
    d = C.pick_calibration_rows(hist, 20).select(F.col("pick").cast("bigint").alias("pick"), "source", "event_id", "count")
    return rounded(d, "count")
