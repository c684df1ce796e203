"""Ordered operators per camera: sampling, sessions, smoothing, growth, risk and alerts over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from crowdlake.functions import scalars as S
from crowdlake.operators import alerts, forecast as X, history as H, hotspots as P, risk as R, temporal as T
from crowdlake.operators.materialize import materialize
from crowdlake.operators.scale import asof, exact_percentile, keep_latest, task_parts
from crowdlake.plans.registry import query, rounded, sql
from crowdlake.plans.scalar_queries import _ALERTS, _DIMMED, _dimmed
from crowdlake.sources import adapters as A

HIST = ("samples", "resets", "sessions", "kept", "hist")
KEYS = ["camera_id", "session_id"]


def resets(spark, sf):
    return A.samples(spark, sf).where("event_id % 997 = 5").select("camera_id", "event_id", "t")


def sessions(spark, sf):
    return T.sessionize_resets(A.samples(spark, sf), resets(spark, sf))


def count_history(spark, sf):
    """Sampled, median-smoothed counts with row numbers, per camera and session."""
    return X.count_history(materialize(sessions(spark, sf).drop("event_type")))


@query(
    "sampled_count_growth",
    sql(
        """select camera_id, event_id, round(value, 6) as stable_count, round(growth, 6) as growth,
        case when growth < 0.65 then 'NO STAMPEDE' else 'STAMPEDE' end as level
        from (select *, case when n >= 3 and span > 0 then slope / m else 0 end as growth from (
          select *, count(*) over w as n, max(t) over w - min(t) over w as span, regr_slope(value, t) over w as slope,
          greatest(avg(value) over w, 1e-6) as m from hist
          window w as (partition by camera_id, session_id order by t range between 120 preceding and current row)))""",
        *HIST,
    ),
)
def sampled_count_growth(spark, sf):
    d = H.growth_rate(count_history(spark, sf), "value", 120, KEYS, "event_id")
    d = d.withColumn("level", S.risk_zone("growth")).withColumn("stable_count", F.col("value"))
    return rounded(d.select("camera_id", "event_id", "stable_count", "growth", "level"), "stable_count", "growth")


@query("throttled_samples", sql("select camera_id, session_id, event_id from hist", *HIST))
def throttled_samples(spark, sf):
    return T.throttle(materialize(sessions(spark, sf).drop("event_type")), KEYS, 15.0).select("camera_id", "session_id", "event_id")


@query("reset_sessions", sql("select camera_id, event_id, session_id from sessions", "samples", "resets", "sessions"))
def reset_sessions(spark, sf):
    return sessions(spark, sf).select("camera_id", "event_id", "session_id")


@query(
    "gap_sessions",
    sql(
        """select camera_id, event_id, cast(sum(case when t - p > 22.5 then 1 else 0 end) over (partition by camera_id order by t) as bigint) as run_id
        from (select *, lag(t) over (partition by camera_id order by t) as p from samples)""",
        "samples",
    ),
)
def gap_sessions(spark, sf):
    return T.sessionize_gaps(A.samples(spark, sf), 22.5).select("camera_id", "event_id", "run_id")


@query(
    "deduplicated_updates",
    sql(
        """select event_id, seq from (select *, max(seq) over (partition by camera_id order by t rows between unbounded preceding and 1 preceding) as top from u)
        where seq is null or seq > coalesce(top, -1)""",
        u=f"""select event_id, (epoch_us(ts) - 1704067200000000) / 1e8 as t, concat('drone-', cast(user_id % 8 + 1 as string)) as camera_id,
        case when event_id % 10 = 0 then null else cast(floor(event_id / 3) as bigint) + event_id * 7 % 50 end as seq from events""",
    ),
)
def deduplicated_updates(spark, sf):
    u = A.stats_updates(spark, sf).select(
        S.normalize_camera_id("drone_id").alias("camera_id"), "event_id", "t",
        (F.col("analytics_seq") + F.col("event_id") * 7 % 50).alias("seq"),
    )
    return T.dedupe_seq(u).select("event_id", "seq")


@query(
    "deduplicated_updates_with_resets",
    sql(
        """select event_id, seq from (select *, max(seq) over (partition by camera_id, session_id order by t rows between unbounded preceding and 1 preceding) as top
          from (select s.camera_id, s.event_id, s.t, session_id, case when event_id % 10 = 0 then null else cast(floor(event_id / 3) as bigint) + event_id * 7 % 50 end as seq
            from sessions s))
        where seq is null or seq > coalesce(top, -1)""",
        "samples",
        "resets",
        "sessions",
    ),
)
def deduplicated_updates_with_resets(spark, sf):
    u = A.stats_updates(spark, sf).select(
        S.normalize_camera_id("drone_id").alias("camera_id"), "event_id", "t",
        (F.col("analytics_seq") + F.col("event_id") * 7 % 50).alias("seq"),
    )
    resets = u.where("event_id % 997 = 5").select("camera_id", "t")
    return T.dedupe_seq(u, resets=resets).select("event_id", "seq")


@query(
    "mode_gated_updates",
    sql(
        """select u.event_id, coalesce(m.mode, 'counting') as mode,
        case when coalesce(m.mode, 'counting') <> 'counting' then 'disabled' when not u.analytics_active then 'starting' else 'active' end as analytics_status
        from stats_updates u asof left join modes m on u.t >= m.t""",
        "stats_updates",
        "modes",
    ),
)
def mode_gated_updates(spark, sf):
    u = A.stats_updates(spark, sf).withColumn("camera_id", S.normalize_camera_id("drone_id"))
    return T.mode_gate(u, A.modes(spark, sf)).select("event_id", "mode", "analytics_status")


@query(
    "presence_states",
    sql(
        """select camera_id, poll_id, ready or coalesce(n - seen < 2, false) as online,
        case when ready and (seen is null or n - seen > 2) then 'online' when not ready and n - seen = 2 then 'offline' end as change
        from (select *, max(case when ready then n end) over (partition by camera_id order by n rows between unbounded preceding and 1 preceding) as seen
          from (select *, row_number() over (partition by camera_id order by t) as n from presence where poll_ok))""",
        "presence",
    ),
)
def presence_states(spark, sf):
    return T.presence_states(A.presence(spark, sf)).select("camera_id", "poll_id", "online", "change")


@query(
    "asof_backward_tolerance",
    sql(
        """select s.event_id, case when s.t - p.t <= 60 then p.poll_id end as poll_id
        from samples s asof left join presence p on s.camera_id = p.camera_id and s.t >= p.t""",
        "samples",
        "presence",
    ),
)
def asof_backward_tolerance(spark, sf):
    right = A.presence(spark, sf).select("camera_id", "t", "poll_id")
    return asof(A.samples(spark, sf), right, ["camera_id"], ["poll_id"], "backward", 60).select("event_id", "poll_id")


@query(
    "asof_forward",
    sql(
        """select s.event_id, p.poll_id from samples s asof left join presence p
        on s.camera_id = p.camera_id and s.t <= p.t""",
        "samples",
        "presence",
    ),
)
def asof_forward(spark, sf):
    right = A.presence(spark, sf).select("camera_id", "t", "poll_id")
    return asof(A.samples(spark, sf), right, ["camera_id"], ["poll_id"], "forward").select("event_id", "poll_id")


@query(
    "rolling_median_counts",
    sql("select event_id, round(value, 6) as value from hist", *HIST),
)
def rolling_median_counts(spark, sf):
    return rounded(count_history(spark, sf).select("event_id", "value"), "value")


def _fold(values: str, step: str, order: str = "t", lead: int = 60, part: str = "camera_id") -> str:
    """A bounded fold over the last rows, oldest first, in the checking dialect."""
    return f"list_reduce(list({values}) over (partition by {part} order by {order} rows {lead} preceding), lambda s, x: {step})"


@query(
    "stabilized_counts",
    sql(
        f"""select event_id, round(s.v + 1e-9, 6) as stable from (
        select event_id, {_fold("{'v': case when rn = 1 then greatest(target, det) else 0e0 end, 'x': target, 'd': det}", "{'v': greatest(x.d, s.v + 0.65 * (x.x - s.v)), 'x': 0e0, 'd': 0e0}")} as s
        from (select *, row_number() over (partition by camera_id order by t) as rn,
          quantile_cont(raw, 0.5) over (partition by camera_id order by t rows 2 preceding) as target
          from (select s.*, greatest(0, s.count * coalesce(k.scale, 1) + coalesce(k.bias, 0), (event_id % 90)) as raw, cast(event_id % 90 as double) as det
            from samples s left join cameras k on s.camera_id = k.camera_id)))""",
        "samples",
        "cameras",
    ),
)
def stabilized_counts(spark, sf):
    from crowdlake.operators.calibration import with_calibration

    d = with_calibration(A.samples(spark, sf), A.cameras(spark, sf))
    d = d.withColumn("density", F.col("count")).withColumn("detections", F.col("event_id") % 90)
    return rounded(T.stabilize(d).select("event_id", "stable"), "stable", nudge=1e-9)


_COMPOSITE = """select *, case when density < 1 then 0 else 0.4 * (1 - exp(-density / 1200)) + 0.3 * motion / (motion + 5)
    + 0.2 * turbulence / (turbulence + 3) + 0.1 * growth_term end as risk from (
    select *, (greatest(-1, least(1, case when pd >= 1 and pp > 0 then (peak - pp) / pp else 0 end)) + 1) / 2 as growth_term from (
    select *, lag(peak) over (partition by camera_id order by t) as pp, lag(density) over (partition by camera_id order by t) as pd from observations))"""


@query(
    "peak_growth_terms",
    sql("select frame_id, round(growth_term, 6) as growth_term from composite", "observations", composite=_COMPOSITE),
)
def peak_growth_terms(spark, sf):
    return rounded(R.peak_growth(A.observations(spark, sf)).select("frame_id", "growth_term"), "growth_term")


@query(
    "composite_risk_scores",
    sql("select frame_id, round(risk, 6) as composite_risk from composite", "observations", composite=_COMPOSITE),
)
def composite_risk_scores(spark, sf):
    return rounded(R.composite_risk(A.observations(spark, sf)).select("frame_id", "composite_risk"), "composite_risk")


@query(
    "smoothed_pressure",
    sql(
        f"""select frame_id, round(s.v + 1e-9, 6) as pressure from (
        select frame_id, {_fold("{'v': case when density < 1 then 0e0 else 0.15 * risk * 100 end, 'x': risk * 100, 'e': density < 1}", "{'v': case when x.e then 0e0 else 0.85 * s.v + 0.15 * x.x end, 'x': 0e0, 'e': false}", lead=260)} as s from composite)""",
        "observations",
        composite=_COMPOSITE,
    ),
)
def smoothed_pressure(spark, sf):
    return rounded(R.pressure(A.observations(spark, sf)).select("frame_id", "pressure"), "pressure", nudge=1e-9)


@query(
    "smoothed_cell_speed",
    sql(
        f"""select frame_id, r, c, round(s.v + 1e-9, 6) as speed from (
        select frame_id, r, c, {_fold("{'v': 0.35 * score, 'x': score}", "{'v': 0.35 * x.x + 0.65 * s.v, 'x': 0e0}", lead=110, part="camera_id, r, c")} as s from zones)""",
        "zones",
    ),
)
def smoothed_cell_speed(spark, sf):
    zones = A.zones(spark, sf)
    d = T.ema(zones, "score", 0.35, "speed", None, ["camera_id", "r", "c"], ["t", "frame_id"], parts=task_parts(zones))
    return rounded(d.select("frame_id", "r", "c", "speed"), "speed", nudge=1e-9)


# History since the scene was last empty, frames with a crowd only.
_LIVE = """select * from (select *, sum(case when density < 1 then 1 else 0 end) over (partition by camera_id order by t) as seg
    from observations) where density >= 1"""


@query(
    "history_windows",
    sql(
        """select frame_id, count(*) over w as entries, round(avg(density) over w, 6) as mean_density, round(max(motion) over w, 6) as max_motion
        from live window w as (partition by camera_id, seg order by t range between 30 preceding and current row)""",
        "observations",
        live=_LIVE,
    ),
)
def history_windows(spark, sf):
    d = H.history_window(A.observations(spark, sf)).select(
        "frame_id",
        F.size("series").cast("bigint").alias("entries"),
        F.aggregate("series", F.lit(0.0), lambda a, x: a + x["density"], lambda a: a / F.size("series")).alias("mean_density"),
        F.array_max(F.transform("series", lambda x: x["motion"])).alias("max_motion"),
    )
    return rounded(d, "mean_density", "max_motion")


def _growth(col: str, seconds: int) -> str:
    return f"""case when count(*) over w >= 3 and max(t) over w > min(t) over w then regr_slope({col}, t) over w / greatest(avg({col}) over w, 1e-6) else 0 end"""


@query(
    "density_growth_rates",
    sql(
        f"""select frame_id, round({_growth("density", 10)}, 6) as growth from live
        window w as (partition by camera_id, seg order by t range between 10 preceding and current row)""",
        "observations",
        live=_LIVE,
    ),
)
def density_growth_rates(spark, sf):
    d = H.growth_rate(A.observations(spark, sf), present=F.col("density") >= 1)
    return rounded(d.select("frame_id", "growth"), "growth")


# Wider than the default eight seconds, so that the sparse samples hold three entries.
_TRENDS = f"""select *, case when score < 30 then 'STABLE' when growth >= 0.04 then 'CRITICAL' when growth >= 0.015 then 'GROWING'
    when growth <= -0.015 then 'EASING' else 'STABLE' end as trend from (select *, {_growth("score", 90)} as growth from zones
    window w as (partition by camera_id, r, c order by t range between 90 preceding and current row))"""


@query(
    "zone_trend_labels",
    sql("select frame_id, r, c, round(growth, 6) as growth, trend from trends", "zones", trends=_TRENDS),
)
def zone_trend_labels(spark, sf):
    d = P.trend_labels(A.zones(spark, sf), 90)
    return rounded(d.select("frame_id", "r", "c", "growth", "trend"), "growth")


@query(
    "zone_hotspots",
    sql(
        """select frame_id, coalesce(string_agg(cell, ', ' order by k) filter (where hot), '') as hotspots,
        coalesce(bool_or(hot and trend in ('GROWING', 'CRITICAL')), false) as expanding,
        coalesce('HOTSPOT EXPANDING: ' || string_agg(cell || ' ' || trend, ', ' order by k) filter (where hot and trend in ('GROWING', 'CRITICAL')), '') as alert_text
        from (select *, k <= 3 and score >= 30 as hot from (select *, ['A', 'B', 'C'][r + 1] || (c + 1) as cell,
          row_number() over (partition by frame_id order by score desc, r * 3 + c desc) as k from trends)) group by 1""",
        "zones",
        trends=_TRENDS,
    ),
)
def zone_hotspots(spark, sf):
    zones = A.zones(spark, sf)
    parts = task_parts(zones)
    return P.hotspots(P.trend_labels(zones, 90, parts), parts=parts).select("frame_id", "hotspots", "expanding", "alert_text")


@query(
    "hottest_cells",
    sql(
        """select frame_id, ['A', 'B', 'C'][r + 1] || (c + 1) as cell, round(score / capacity, 6) as fill
        from (select z.*, capacity, row_number() over (partition by frame_id order by score desc, z.r * 3 + z.c) as k
          from zones z join capacity p on z.r = p.r and z.c = p.c) where k = 1 and score / capacity >= 0.3""",
        "zones",
        "capacity",
    ),
)
def hottest_cells(spark, sf):
    z = A.zones(spark, sf).withColumn("capacity", S.zone_capacity("r", "c"))
    return rounded(P.hottest_cell(z).select("frame_id", "cell", "fill"), "fill")


_RISK = f"""select *, 0.4 * dt + 0.2 * mt + 0.15 * tt + 0.15 * gt + 0.1 * ot as raw from (
    select *, case when n >= 3 then (greatest(-1, least(1, g * 5)) + 1) / 2 else 0 end as gt from (
    select *, 1 - exp(-density / 1000) as dt, motion / (motion + 6) as mt, turbulence / (turbulence + 4) as tt, least(1, opposing * 2) as ot,
    {_growth("density", 10)} as g, count(*) over w as n from live
    window w as (partition by camera_id, seg order by t range between 10 preceding and current row)))"""


@query(
    "crowd_risk_index",
    sql(
        f"""select frame_id, risk_index, round(confidence, 6) as confidence, causes, risk_index >= 65 as alert,
        case when risk_index < 65 then 'NO STAMPEDE' else 'STAMPEDE' end as risk_level from (
        select frame_id, round_even(s.v * 100, 1) as risk_index,
        round_even(greatest(0.85, least(0.98, least(0.85 + 0.01 * n, 0.96) - abs(dt - mt) * 0.05)), 2) as confidence,
        concat_ws('; ', case when dt > 0.5 then 'high crowd density' end, case when mt > 0.45 then 'rapid crowd movement' end,
          case when tt > 0.45 then 'high motion turbulence' end, case when gt > 0.6 then 'rapid density increase' end,
          case when ot > 0.35 then 'opposing pedestrian flow' end) as causes
        from (select *, {_fold("{'v': 0.15 * raw, 'x': raw}", "{'v': 0.15 * x.x + 0.85 * s.v, 'x': 0e0}", lead=260)} as s from risk)
        union all select frame_id, 0, 1, '' from observations where density < 1)""",
        "observations",
        live=_LIVE,
        risk=_RISK,
    ),
)
def crowd_risk_index(spark, sf):
    d = R.risk_index(A.observations(spark, sf))
    d = d.select("frame_id", "risk_index", "confidence", F.array_join("primary_causes", "; ").alias("causes"), "alert", "risk_level")
    return rounded(d, "confidence")


@query(
    "alert_cooldowns",
    sql(
        """select a.camera_id, a.cell, a.frame_id, a.zone from alerts a join keep k on a.camera_id = k.camera_id and a.cell = k.cell and a.t = k.t""",
        "zones",
        "capacity",
        "cameras",
        dimmed=_DIMMED,
        alerts=_ALERTS,
        keep="""select camera_id, cell, min(t) as t from alerts group by 1, 2 union all
        select k.camera_id, k.cell, min(a.t) from keep k join alerts a on a.camera_id = k.camera_id and a.cell = k.cell and a.t - k.t >= 60 group by 1, 2""",
    ),
)
def alert_cooldowns(spark, sf):
    fired = alerts.cell_alerts(_dimmed(spark, sf)).select("camera_id", "cell", "frame_id", "zone", "t")
    return alerts.alert_cooldown(fired).select("camera_id", "cell", "frame_id", "zone")


@query(
    "notify_cooldowns",
    sql(
        "select s.event_id from samples s join keep k on s.camera_id = k.camera_id and s.t = k.t",
        "samples",
        keep="""select camera_id, min(t) as t from samples group by 1 union all
        select k.camera_id, min(s.t) from keep k join samples s on s.camera_id = k.camera_id and s.t - k.t > 30 group by 1""",
    ),
)
def notify_cooldowns(spark, sf):
    return alerts.notify_cooldown(A.samples(spark, sf)).select("event_id")


_TICKS = """select distinct camera_id, tick, tick * 10e0 as t,
    case event_type when 'view' then 1 when 'click' then 2 when 'purchase' then 3 when 'signup' then 4 else 5 end as pos,
    case event_type when 'view' then 'zone STABLE' when 'click' then 'HOTSPOT EXPANDING' when 'purchase' then 'WATCH level'
      when 'signup' then 'HIGH pressure' else 'STAMPEDE WARNING' end as alert
    from (select *, cast(floor(t / 10) as bigint) as tick from samples)"""


@query(
    "alert_ticker_lines",
    sql(
        """select camera_id, tick, alert, t - since > 10 as dimmed from (
        select *, row_number() over (partition by camera_id, tick order by sev, case when sev = 2 then -pos else pos end) as k from (
        select *, max(start) over (partition by camera_id, alert order by t) as since,
        case when regexp_matches(alert, 'CRITICAL|EVACUATE|STAMPEDE') then 0 when regexp_matches(alert, 'HIGH|EXPANDING|OPPOSING') then 1 else 2 end as sev from (
        select *, case when coalesce(lag(tick) over (partition by camera_id, alert order by t) <> tick - 1, true) then t end as start from ticks)))
        where k = 1 and t - since <= 30""",
        "samples",
        ticks=_TICKS,
    ),
)
def alert_ticker_lines(spark, sf):
    active = A.samples(spark, sf).withColumn("tick", F.floor(F.col("t") / 10)).selectExpr(
        "camera_id", "tick", "tick * 10e0 as t",
        "case event_type when 'view' then 1 when 'click' then 2 when 'purchase' then 3 when 'signup' then 4 else 5 end as pos",
        "case event_type when 'view' then 'zone STABLE' when 'click' then 'HOTSPOT EXPANDING' when 'purchase' then 'WATCH level' "
        "when 'signup' then 'HIGH pressure' else 'STAMPEDE WARNING' end as alert",
    ).distinct()
    return T.alert_ticker(active).select("camera_id", "tick", "alert", "dimmed")


@query(
    "latest_samples",
    sql(
        "select camera_id, event_id from samples qualify row_number() over (partition by camera_id order by t desc) <= 200",
        "samples",
    ),
)
def latest_samples(spark, sf):
    return keep_latest(A.samples(spark, sf), ["camera_id"], 200, ["t", "event_id"]).select("camera_id", "event_id")


@query(
    "count_percentiles",
    sql(
        "select camera_id, round(quantile_cont(count, 0.9), 6) as p90 from samples group by 1",
        "samples",
    ),
)
def count_percentiles(spark, sf):
    return rounded(exact_percentile(A.samples(spark, sf), ["camera_id"], "count", 0.9, "p90"), "p90")
