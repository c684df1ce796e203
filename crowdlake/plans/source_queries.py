"""Parsers, inventories and formatted sinks over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from crowdlake.operators import alerts as L, fleet
from crowdlake.plans.registry import query, rounded, sql
from crowdlake.plans.scalar_queries import _ALERTS, _DIMMED, _dimmed
from crowdlake.sources import adapters as A, feeds, readers, sinks
from crowdlake.sources.presets import PRESETS, preset_table


@query(
    "parsed_count_history",
    """select camera_id, session_id, us, round(greatest(0, value - 20), 6) as count from (
    select *, max(session_id) over (partition by camera_id) as top from (
    select concat('drone-', cast(user_id % 8 + 1 as string)) as camera_id, epoch_us(ts) as us, value,
    case when user_id % 8 = 3 then 0 else cast(floor(event_id / 4000) as int) end as session_id from events)) where session_id = top""",
)
def parsed_count_history(spark, sf):
    raw = A.events(spark, sf).selectExpr(
        "concat(replace(cast(ts as string), ' ', 'T'), 'Z') as timestamp_utc",
        A.CAMERA,
        "case when user_id % 8 = 3 then '' else cast(cast(floor(event_id / 4000) as int) as string) end as session_id",
        "cast(value - 20 as string) as observed_count",
        "event_type as extra",
    )
    d = readers.parse_count_history(raw)
    return rounded(d.select("camera_id", "session_id", F.unix_micros("ts").alias("us"), "count"), "count")


_RAW_LABELS = """select l_orderkey * 8 + l_linenumber as sample_no,
    case when l_orderkey % 50 = 7 then '  ' else ' Drone-' || cast(l_suppkey % 10 + 1 as string) || ' ' end as camera_id,
    cast(l_quantity as string) as predicted_count,
    case when l_orderkey % 50 = 9 then 'n/a' else cast(l_quantity + l_linenumber as string) end as actual_count,
    case when l_orderkey % 50 = 11 then '' else l_returnflag end as angle from lineitem"""


@query(
    "parsed_labels",
    f"""select sample_no, lower(trim(camera_id)) as camera_id, cast(predicted_count as double) as predicted_count,
    cast(actual_count as double) as actual_count, lower(trim(angle)) as angle from ({_RAW_LABELS})
    where trim(camera_id) <> '' and angle <> '' and actual_count <> 'n/a'""",
)
def parsed_labels(spark, sf):
    raw = A.table(spark, sf, "lineitem").selectExpr(*_columns(_RAW_LABELS))
    return readers.parse_labels(raw)[0]


@query(
    "quarantined_labels",
    f"""select sample_no, case when trim(camera_id) = '' then 'camera_id is required' when angle = '' then 'angle is required'
    else 'counts must be numbers' end as problem from ({_RAW_LABELS})
    where trim(camera_id) = '' or angle = '' or actual_count = 'n/a'""",
)
def quarantined_labels(spark, sf):
    raw = A.table(spark, sf, "lineitem").selectExpr(*_columns(_RAW_LABELS))
    return readers.parse_labels(raw)[1].select("sample_no", "problem")


def _columns(select: str) -> list[str]:
    """The expressions of a one-table select, split at top-level commas."""
    body = select.strip()[len("select") :].rsplit(" from ", 1)[0]
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(body):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(body[start:i].strip())
            start = i + 1
    return [*parts, body[start:].strip()]


@query(
    "stats_update_defaults",
    f"""select event_id, concat('drone-', cast(user_id % 8 + 1 as string)) as camera_id, value as density_score,
    case when event_id % 3 = 0 then value / 2 else 0e0 end as pressure, case when event_id % 4 = 0 then 'HIGH' else 'SAFE' end as risk_level,
    case when event_id % 5 = 0 then 0.5e0 else 1e0 end as confidence, event_id % 6 <> 0 as analytics_active, cast(0 as bigint) as causes
    from events""",
)
def stats_update_defaults(spark, sf):
    schema = T.StructType([*readers.STATS_SCHEMA, T.StructField("event_id", T.LongType())])
    text = F.expr(
        "concat('{\"drone_id\":\"Drone', user_id % 8 + 1, '\",\"event_id\":', event_id, ',\"density_score\":', value,"
        " if(event_id % 3 = 0, concat(',\"pressure\":', value / 2), ''), if(event_id % 4 = 0, ',\"risk_level\":\"HIGH\"', ''),"
        " if(event_id % 5 = 0, ',\"confidence\":0.5', ''), if(event_id % 6 = 0, ',\"analytics_active\":false', ''), '}')"
    )
    d = A.events(spark, sf).select(F.from_json(text, schema).alias("u")).select("u.*")
    return readers.apply_stats_defaults(d).select(
        "event_id", "camera_id", "density_score", "pressure", "risk_level", "confidence", "analytics_active",
        F.size("primary_causes").cast("bigint").alias("causes"),
    )


# Eight events make a poll; every item carries some of the three readiness fields.
_POLL_ITEMS = """select cast(floor(event_id / 8) as bigint) as poll_id, '/live/drone' || cast(user_id % 8 + 1 as string) || '/' as name,
    case when event_id % 3 <> 0 then event_type <> 'error' end as ready, event_type <> 'click' as available,
    case when event_id % 4 = 0 then event_type <> 'view' end as online, cast(floor(event_id / 8) as bigint) % 10 <> 3 as ok from events"""


def polls(spark, sf):
    items = A.events(spark, sf).selectExpr(*_columns(_POLL_ITEMS), f"{A.T} as t")
    item = F.struct("name", "ready", "available", "online")
    return items.groupBy("poll_id", "ok").agg(F.min("t").alias("t"), F.collect_list(item).alias("items"))


_READY = """select distinct poll_id, trim(name, '/') as path from items
    where ok and coalesce(ready, available, false) and coalesce(online, ready, available, false)"""


@query("ready_stream_paths", sql("select poll_id, path from ready", items=_POLL_ITEMS, ready=_READY))
def ready_stream_paths(spark, sf):
    return fleet.ready_paths(polls(spark, sf)).select("poll_id", "path")


@query(
    "missed_publishers",
    sql(
        """select p.poll_id, c.camera_id from (select distinct poll_id from items where ok) p cross join cameras c
        where not exists (select 1 from ready r where r.poll_id = p.poll_id and r.path = 'live/' || replace(c.camera_id, '-', ''))""",
        "cameras",
        items=_POLL_ITEMS,
        ready=_READY,
    ),
)
def missed_publishers(spark, sf):
    p = polls(spark, sf)
    return fleet.missed_cameras(p, _resolved(spark, sf, fleet.ready_paths(p)).where("role = 'source'"), A.cameras(spark, sf))


def _camera_paths(spark, sf):
    return A.cameras(spark, sf).select(
        "camera_id",
        F.concat(F.lit("live/"), F.replace("camera_id", F.lit("-"), F.lit(""))).alias("source_path"),
        F.concat(F.lit("/analyzed/"), "camera_id").alias("output_path"),
    )


def _resolved(spark, sf, paths):
    return fleet.resolve_paths(paths, _camera_paths(spark, sf))


@query(
    "resolved_stream_paths",
    sql(
        """select event_id, path, case when n <= 7 and event_id % 6 < 5 then 'drone-' || n end as camera_id,
        case when n <= 7 then case when event_id % 6 < 3 then 'source' when event_id % 6 < 5 then 'output' end end as role from raw""",
        raw="""select event_id, user_id % 8 + 1 as n, case event_id % 6 when 0 then '/live/drone' when 1 then 'live/Drone-' when 2 then 'live/drone-'
        when 3 then 'analyzed/drone' when 4 then '/analyzed/drone-' else 'other/drone' end || cast(user_id % 8 + 1 as string) as path from events""",
    ),
)
def resolved_stream_paths(spark, sf):
    raw = A.events(spark, sf).selectExpr(
        "event_id",
        "concat(case event_id % 6 when 0 then '/live/drone' when 1 then 'live/Drone-' when 2 then 'live/drone-' "
        "when 3 then 'analyzed/drone' when 4 then '/analyzed/drone-' else 'other/drone' end, cast(user_id % 8 + 1 as string)) as path",
    )
    return _resolved(spark, sf, raw)


@query(
    "stream_path_changes",
    sql(
        """select poll_id, coalesce(list_aggregate(list_sort(list_filter(cur, lambda x: not list_contains(prev, x))), 'string_agg', ','), '') as appeared,
        coalesce(list_aggregate(list_sort(list_filter(prev, lambda x: not list_contains(cur, x))), 'string_agg', ','), '') as vanished
        from (select *, coalesce(lag(cur) over (order by poll_id), []) as prev from (
          select p.poll_id, coalesce(list(r.path) filter (where r.path is not null), []) as cur
          from (select distinct poll_id from items where ok) p left join ready r on p.poll_id = r.poll_id group by 1))""",
        items=_POLL_ITEMS,
        ready=_READY,
    ),
)
def stream_path_changes(spark, sf):
    p = polls(spark, sf)
    d = fleet.path_changes(p, fleet.ready_paths(p))
    return d.select("poll_id", F.array_join("appeared", ",").alias("appeared"), F.array_join("vanished", ",").alias("vanished"))


@query(
    "formatted_crowd_log",
    sql(
        """select camera_id, frame_id, case when hotspot_ratio < 0.65 then 'NO STAMPEDE' else 'STAMPEDE' end as zone,
        printf('%.4f', hotspot_ratio) as risk_score, printf('%.2f', density) as density_score, printf('%.6f', peak) as peak_density,
        printf('%.4f', hotspot_ratio) as hotspot_ratio, printf('%.4f', motion) as inference_time_s, printf('%.4f', turbulence) as frame_age_s,
        8 + frame_id % 3 as stride from observations""",
        "observations",
    ),
)
def formatted_crowd_log(spark, sf):
    d = A.observations(spark, sf).selectExpr(
        "camera_id", "frame_id", "case when hotspot_ratio < 0.65 then 'NO STAMPEDE' else 'STAMPEDE' end as zone",
        "hotspot_ratio as risk_score", "density as density_score", "peak as peak_density", "hotspot_ratio",
        "motion as inference_time_s", "turbulence as frame_age_s", "8 + frame_id % 3 as stride",
    )
    return sinks.crowd_log(d)


@query(
    "telemetry_round_trip",
    sql(
        """select event_id, camera_id, round(latency_s, 6) as latency_s, round(infer_s, 6) as infer_s, reconnects, round(drop_pct, 2) as drop_pct,
        cast(fps as double) as fps from telemetry""",
        "telemetry",
    ),
)
def telemetry_round_trip(spark, sf):
    src = A.telemetry(spark, sf)
    text = sinks.telemetry_text(src.drop("t").withColumn("t", F.col("event_id")))
    back = readers.parse_telemetry(text.select(*[F.col(c).cast("string").alias(c) for c in text.columns]))
    return back.select(F.col("t").cast("bigint").alias("event_id"), "camera_id", "latency_s", "infer_s", "reconnects", "drop_pct", "fps")


@query(
    "alert_geojson_features",
    sql(
        """select frame_id, cell, to_json({'type': 'Feature', 'geometry': {'type': 'Point', 'coordinates': [gps_lon, gps_lat]},
        'properties': {'zone': zone, 'cell': cell, 'density': density}}) as feature
        from alerts where gps_lat <> 0 order by t desc, frame_id desc, cell desc limit 1000""",
        "zones",
        "capacity",
        "cameras",
        dimmed=_DIMMED,
        alerts=_ALERTS,
    ),
)
def alert_geojson_features(spark, sf):
    fired = L.cell_alerts(_dimmed(spark, sf)).withColumn("occupancy_pct", F.lit(None).cast("double"))
    doc = sinks.alerts_geojson(fired.select("frame_id", "t", "cell", "zone", "density", "occupancy_pct", "gps_lat", "gps_lon"))
    shape = "type STRING, features ARRAY<STRUCT<type STRING, geometry STRUCT<type STRING, coordinates ARRAY<DOUBLE>>, properties STRUCT<zone STRING, cell STRING, density BIGINT>>>"
    # Read the document back: one row per feature, with the alert it belongs to.
    parsed = doc.select(F.posexplode(F.from_json("document", shape)["features"]).alias("_n", "f"))
    ids = sinks.keep_latest(fired.where("gps_lat <> 0").select("frame_id", "t", "cell"), [], 1000, ["t", "frame_id", "cell"])
    ids = ids.agg(F.array_sort(F.collect_list(F.struct("t", "frame_id", "cell"))).alias("a")).select(F.posexplode("a").alias("_n", "i"))
    return parsed.join(ids, "_n").select("i.frame_id", "i.cell", F.to_json("f").alias("feature"))


@query(
    "alert_log_lines",
    sql(
        "select frame_id, cell, to_json({'camera_id': camera_id, 'frame_id': frame_id, 'cell': cell, 'zone': zone, 'density': density, 'timestamp': density * 2}) as line from alerts",
        "zones",
        "capacity",
        "cameras",
        dimmed=_DIMMED,
        alerts=_ALERTS,
    ),
)
def alert_log_lines(spark, sf):
    fired = L.cell_alerts(_dimmed(spark, sf)).select("camera_id", "frame_id", "cell", "zone", "density")
    return sinks.alert_log(fired, at=F.col("density") * 2).select("frame_id", "cell", "line")


_FEED_LINES = """select case page_id % 6 when 0 then url when 1 then replace(url, 'http://', 'rtsp://user:pw@') when 2 then '# ' || url
    when 3 then ['dji_mini3', ' DJI_Air3', 'parrot_anafi', 'hikvision ', 'not_a_preset'][cast(page_id % 5 + 1 as int)]
    when 4 then cast(page_id % 4 as string) else '  ' end as value from pages"""
_PRESET_ROWS = ", ".join(f"('{n}', '{a}')" for n, a in PRESETS)
_INVENTORY = f"""select feed, case when address is not null then 'PRESET' when scheme in ('rtsp', 'rtsps') then 'RTSP' when scheme in ('rtmp', 'rtmps') then 'RTMP'
      when scheme in ('http', 'https') then 'HTTP' when regexp_full_match(feed, '[0-9]+') then 'WEBCAM' else 'FILE' end as kind,
    case when scheme <> '' then split_part(split_part(list_last(string_split(split_part(rest, '/', 1), '@')), ':', 1), '?', 1) end as host,
    case when scheme <> '' then coalesce(try_cast(split_part(list_last(string_split(split_part(rest, '/', 1), '@')), ':', 2) as int),
      case scheme when 'rtsp' then 554 when 'rtsps' then 322 when 'http' then 80 when 'https' then 443 else 1935 end) end as port,
    case when contains(full_address, '@') then split_part(full_address, '://', 1) || '://*:*@' || list_last(string_split(full_address, '@')) else full_address end as masked,
    scheme <> '' or regexp_full_match(feed, '[0-9]+') as live, case when address is not null then upper(split_part(lower(feed), '_', 1)) end as brand
    from (select *, case when contains(full_address, '://') then lower(split_part(full_address, '://', 1)) else '' end as scheme, lower(split_part(full_address, '://', 2)) as rest
      from (select feed, address, coalesce(address, feed) as full_address
        from (select distinct trim(value) as feed from lines where trim(value) <> '' and trim(value) not like '#%')
        left join (select * from (values {_PRESET_ROWS}) p(name, address)) on lower(feed) = name))"""


def _inventory(spark, sf):
    lines = A.table(spark, sf, "pages").selectExpr(
        "case page_id % 6 when 0 then url when 1 then replace(url, 'http://', 'rtsp://user:pw@') when 2 then concat('# ', url) "
        "when 3 then element_at(array('dji_mini3', ' DJI_Air3', 'parrot_anafi', 'hikvision ', 'not_a_preset'), cast(page_id % 5 + 1 as int)) "
        "when 4 then cast(page_id % 4 as string) else '  ' end as value"
    )
    return feeds.feed_inventory(lines, preset_table(spark))


@query("feed_inventory", sql("select * from inventory", lines=_FEED_LINES, inventory=_INVENTORY))
def feed_inventory(spark, sf):
    return _inventory(spark, sf)


@query(
    "feed_brand_rollup",
    sql("select brand, count(*) as feeds from inventory where brand is not null group by 1", lines=_FEED_LINES, inventory=_INVENTORY),
)
def feed_brand_rollup(spark, sf):
    return feeds.brand_rollup(_inventory(spark, sf))


@query(
    "alert_outbox_messages",
    sql(
        """select frame_id, cell, concat_ws(chr(10), zone || ' STAMPEDE WARNING ALERT', 'Device: ' || camera_id || ' | Location: unknown (' || cell || ')',
        'Risk Level: ' || zone || ' (Index: ' || printf('%.1f', occ) || '/100)', 'Current Crowd: ~' || density || ' people',
        'Action: check ' || cell, case when gps_lat <> 0 then 'GPS: ' || gps_lat || 'N, ' || gps_lon || 'E' end,
        case when gps_lat <> 0 then 'Maps: https://maps.google.com/?q=' || gps_lat || ',' || gps_lon end) as body
        from (select *, cast(cast(floor(pct) as bigint) as double) as occ from alerts)""",
        "zones",
        "capacity",
        "cameras",
        dimmed=_DIMMED,
        alerts=_ALERTS,
    ),
)
def alert_outbox_messages(spark, sf):
    fired = L.cell_alerts(_dimmed(spark, sf)).withColumn("message", F.concat(F.lit("check "), "cell"))
    fill = F.floor(F.col("score") / F.greatest("capacity", F.lit(1.0)) * 100)
    fired = fired.withColumn("occupancy_pct", F.least(fill, F.lit(500)).cast("double"))
    return L.alert_outbox(fired).select("frame_id", "cell", "body")


@query(
    "recorded_count_history",
    sql(
        """select source as source_video, 1767225600000000 + cast(s * 15000000 as bigint) as us, cast(round_even(count, 0) as bigint) as raw_count,
        cast(round_even(quantile_cont(count, 0.5) over (partition by source order by s rows 4 preceding), 0) as bigint) as count
        from (select i.source, i.s, v.count from (select source, unnest(range(0, cast(ceil((max(t) - 0.05) / 15) as bigint))) as s from videos group by 1) i
          asof join videos v on v.source = i.source and i.s * 15e0 >= v.t)""",
        "samples",
        videos="select camera_id as source, count * 3 as count, t - min(t) over (partition by camera_id) as t from samples",
    ),
)
def recorded_count_history(spark, sf):
    s = A.samples(spark, sf)
    start = s.groupBy("camera_id").agg(F.min("t").alias("_t0"))
    videos = s.join(start, "camera_id").select(
        F.col("camera_id").alias("source"), (F.col("count") * 3).alias("count"), (F.col("t") - F.col("_t0")).alias("t")
    )
    d = readers.history_from_frames(videos)
    return d.select("source_video", F.unix_micros("ts").alias("us"), "raw_count", "count")


@query(
    "unioned_histories",
    sql("select event_id, camera_id, count, case when event_id % 2 = 0 then event_type end as event_type from samples", "samples"),
)
def unioned_histories(spark, sf):
    s = A.samples(spark, sf).drop("t")
    even, odd = s.where("event_id % 2 = 0"), s.where("event_id % 2 = 1").drop("event_type").select("count", "event_id", "camera_id")
    return readers.union_histories([even, odd])
