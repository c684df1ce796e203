"""Column expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from crowdlake.functions import register_sql_functions, scalars as S
from crowdlake.operators import alerts, calibration as C, fleet
from crowdlake.plans.registry import query, rounded, sql
from crowdlake.sources import adapters as A

_BAND4 = "case when {0} < 0.25 then 'SAFE' when {0} < 0.5 then 'WATCH' when {0} < 0.75 then 'HIGH' else 'CRITICAL' end"


@query(
    "risk_zone_labels",
    sql(
        f"""select frame_id, case when hotspot_ratio < 0.65 then 'NO STAMPEDE' else 'STAMPEDE' end as zone2,
        {_BAND4.format("hotspot_ratio")} as zone4,
        case when hotspot_ratio * 100 < 65 then 'STABLE' else 'STAMPEDE RISK' end as crowd_state,
        case when hotspot_ratio < 0.65 then 'NORMAL' else 'STAMPEDE WARNING' end as alert_level,
        case when opposing < 0.25 then 'GREEN' when opposing < 0.5 then 'YELLOW' when opposing < 0.75 then 'ORANGE' else 'RED' end as pressure_band,
        case when hotspot_ratio < 0.4 then 'LOW' when hotspot_ratio < 0.7 then 'MEDIUM' else 'HIGH' end as component_band
        from observations""",
        "observations",
    ),
)
def risk_zone_labels(spark, sf):
    x = F.col("hotspot_ratio")
    return A.observations(spark, sf).select(
        "frame_id",
        S.risk_zone(x).alias("zone2"),
        S.risk_zone(x, "four_level").alias("zone4"),
        S.crowd_state(x * 100).alias("crowd_state"),
        S.alert_level(S.risk_zone(x)).alias("alert_level"),
        S.band("opposing", (0.25, 0.5, 0.75), ("GREEN", "YELLOW", "ORANGE", "RED")).alias("pressure_band"),
        S.band(x, (0.4, 0.7), ("LOW", "MEDIUM", "HIGH")).alias("component_band"),
    )


@query(
    "normalized_camera_ids",
    sql(
        """select event_id, case when l like 'drone%' and not contains(l, '-') then 'drone-' || l[6:]
        when l like 'cctv%' and not contains(l, '-') then 'cctv-' || l[5:] else l end as camera_id
        from (select event_id, lower(trim(raw)) as l from (select event_id, case event_id % 4 when 0 then ' Drone' when 1 then 'drone-'
          when 2 then 'CCTV' else 'cam' end || cast(user_id % 8 + 1 as string) || ' ' as raw from events))"""
    ),
)
def normalized_camera_ids(spark, sf):
    raw = "concat(case event_id % 4 when 0 then ' Drone' when 1 then 'drone-' when 2 then 'CCTV' else 'cam' end, cast(user_id % 8 + 1 as string), ' ')"
    return A.events(spark, sf).selectExpr("event_id", f"{raw} as raw").select("event_id", S.normalize_camera_id("raw").alias("camera_id"))


@query(
    "zone_occupancy",
    sql(
        """select z.camera_id, z.frame_id, ['A', 'B', 'C'][z.r + 1] || (z.c + 1) as cell,
        round(greatest(0, least(5, z.score / greatest(capacity, 1))) * 100, 6) as occupancy
        from zones z join capacity k on z.r = k.r and z.c = k.c""",
        "zones",
        "capacity",
    ),
)
def zone_occupancy(spark, sf):
    z = A.zones(spark, sf)
    pct = S.occupancy_pct("score", S.zone_capacity("r", "c"))
    return rounded(z.select("camera_id", "frame_id", S.cell_label("r", "c").alias("cell"), pct.alias("occupancy")), "occupancy")


@query(
    "altitude_corrected_density",
    sql(
        """select frame_id, round(case when alt > 5 then (50e0 / greatest(ppm, 0.01)) ** 2 else 1 end, 6) as multiplier,
        round(case when alt < 5 then density else density / greatest((ppm / 50e0) ** 2, 0.05) end, 6) as corrected
        from (select *, 512 / greatest(2 * alt * tan(radians(40e0)), 0.1) as ppm from (select *, cast(frame_id % 60 as double) as alt from observations))""",
        "observations",
    ),
)
def altitude_corrected_density(spark, sf):
    alt = F.expr("cast(frame_id % 60 as double)")
    d = A.observations(spark, sf).select(
        "frame_id", S.altitude_multiplier(alt).alias("multiplier"), S.altitude_corrected("density", alt).alias("corrected")
    )
    return rounded(d, "multiplier", "corrected")


@query(
    "saturating_terms",
    sql(
        """select frame_id, round(1 - exp(-density / 1200), 6) as density_term, round(motion / (motion + 5), 6) as motion_term,
        round(turbulence / (turbulence + 3), 6) as turbulence_term from observations""",
        "observations",
    ),
)
def saturating_terms(spark, sf):
    d = A.observations(spark, sf).select(
        "frame_id",
        S.sat_exp("density", 1200.0).alias("density_term"),
        S.sat_ratio("motion", 5.0).alias("motion_term"),
        S.sat_ratio("turbulence", 3.0).alias("turbulence_term"),
    )
    return rounded(d, "density_term", "motion_term", "turbulence_term")


@query(
    "zone_gps_centroids",
    sql(
        """select z.frame_id, z.r, z.c, coalesce(round_even(lat_max - (z.r + 0.5) / 3 * (lat_max - lat_min), 6), 0) as lat,
        coalesce(round_even(lon_min + (z.c + 0.5) / 3 * (lon_max - lon_min), 6), 0) as lon
        from zones z left join cameras k on z.camera_id = k.camera_id""",
        "zones",
        "cameras",
    ),
)
def zone_gps_centroids(spark, sf):
    d = A.zones(spark, sf).join(A.cameras(spark, sf), "camera_id", "left")
    return d.select(
        "frame_id", "r", "c",
        S.cell_latitude("lat_min", "lat_max", "r").alias("lat"),
        S.cell_longitude("lat_min", "lat_max", "lon_min", "lon_max", "c").alias("lon"),
    )


@query(
    "calibrated_counts",
    sql(
        """select s.event_id, s.camera_id, round(coalesce(k.scale, 1.5), 6) as scale, round(coalesce(k.bias, 2), 6) as bias,
        round(greatest(0, s.count * coalesce(k.scale, 1.5) + coalesce(k.bias, 2)), 6) as calibrated
        from samples s left join cameras k on s.camera_id = k.camera_id""",
        "samples",
        "cameras",
    ),
)
def calibrated_counts(spark, sf):
    cams = A.cameras(spark, sf).select("camera_id", "scale", "bias")
    default = cams.agg(F.max(F.lit("default")).alias("camera_id"), F.max(F.lit(1.5)).alias("scale"), F.max(F.lit(2.0)).alias("bias"))
    d = C.with_calibration(A.samples(spark, sf), cams.unionByName(default))
    d = d.withColumn("calibrated", S.apply_calibration("count", "scale", "bias"))
    return rounded(d.select("event_id", "camera_id", "scale", "bias", "calibrated"), "scale", "bias", "calibrated")


@query(
    "confidence_percentages",
    sql(
        """select frame_id, greatest(85e0, case when c <= 1 then round_even(c * 100, 1) else round_even(c, 1) end) as confidence
        from (select frame_id, case when frame_id % 2 = 0 then hotspot_ratio else hotspot_ratio * 100 end as c from observations)""",
        "observations",
    ),
)
def confidence_percentages(spark, sf):
    c = F.expr("case when frame_id % 2 = 0 then hotspot_ratio else hotspot_ratio * 100 end")
    return A.observations(spark, sf).select("frame_id", S.confidence_pct(c).alias("confidence"))


@query(
    "primary_cause_lists",
    sql(
        """select frame_id, concat_ws('; ', case when hotspot_ratio > 0.5 then 'high crowd density' end,
        case when motion / 10 > 0.45 then 'rapid crowd movement' end, case when turbulence / 8 > 0.45 then 'high motion turbulence' end,
        case when hotspot_ratio > 0.6 then 'rapid density increase' end, case when opposing > 0.35 then 'opposing pedestrian flow' end) as causes
        from observations""",
        "observations",
    ),
)
def primary_cause_lists(spark, sf):
    causes = S.primary_causes("hotspot_ratio", F.col("motion") / 10, F.col("turbulence") / 8, "hotspot_ratio", "opposing")
    return A.observations(spark, sf).select("frame_id", F.array_join(causes, "; ").alias("causes"))


@query(
    "sql_function_calls",
    sql(
        f"""select z.frame_id, z.r, z.c, ['A', 'B', 'C'][z.r + 1] || (z.c + 1) as cell,
        {_BAND4.format("z.score / capacity")} as zone, round(greatest(0, least(5, z.score / capacity)) * 100, 6) as occupancy,
        round(1 - exp(-z.score / 1200), 6) as term, case when z.score / capacity < 0.65 then 'NO STAMPEDE' else 'STAMPEDE' end as label,
        z.camera_id from zones z join capacity k on z.r = k.r and z.c = k.c""",
        "zones",
        "capacity",
    ),
)
def sql_function_calls(spark, sf):
    register_sql_functions(spark)
    return A.zones(spark, sf).selectExpr(
        "frame_id", "r", "c", "cell_label(r, c) as cell",
        "risk_zone4(score / zone_capacity(r, c)) as zone",
        "round(occupancy_pct(score, zone_capacity(r, c)), 6) as occupancy",
        "round(sat_exp(score, 1200D), 6) as term",
        "risk_zone(score / zone_capacity(r, c)) as label",
        "normalize_camera_id(replace(camera_id, '-', '')) as camera_id",
    )


_DIMMED = """select z.*, capacity * (1 + least(cast(regexp_extract(z.camera_id, '[0-9]+$') as int) - 1, 4) / 10e0) as capacity,
    k.lat_min, k.lat_max, k.lon_min, k.lon_max from zones z join capacity c on z.r = c.r and z.c = c.c left join cameras k on z.camera_id = k.camera_id"""


def _dimmed(spark, sf):
    """Zones with capacities that grow with the camera index up to index 4, and GPS bounds."""
    cams = A.table(spark, sf, "region").selectExpr("r_regionkey as camera_idx")
    caps = cams.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(8)))).selectExpr(
        "camera_idx", "cast(floor(k / 3) as int) as r", "cast(k % 3 as int) as c"
    )
    caps = caps.withColumn("capacity", S.zone_capacity("r", "c") * (1 + F.col("camera_idx") / 10.0))
    return fleet.with_zone_dims(A.zones(spark, sf), caps, A.cameras(spark, sf))


@query(
    "zones_with_dims",
    sql(
        "select frame_id, r, c, round(capacity, 6) as capacity, round(lat_min, 6) as lat_min, round(lon_max, 6) as lon_max from dimmed",
        "zones",
        "capacity",
        "cameras",
        dimmed=_DIMMED,
    ),
)
def zones_with_dims(spark, sf):
    d = _dimmed(spark, sf).select("frame_id", "r", "c", "capacity", "lat_min", "lon_max")
    return rounded(d, "capacity", "lat_min", "lon_max")


_ALERTS = f"""select camera_id, frame_id, t, r, c, zone, ['A', 'B', 'C'][r + 1] || (c + 1) as cell,
    cast(round_even(score, 0) as bigint) as density, round_even(pct, 1) as occupancy_pct,
    coalesce(round_even(lat_max - (r + 0.5) / 3 * (lat_max - lat_min), 6), 0) as gps_lat,
    coalesce(round_even(lon_min + (c + 0.5) / 3 * (lon_max - lon_min), 6), 0) as gps_lon, pct, score
    from (select *, {_BAND4.format("score / greatest(capacity, 1)")} as zone, greatest(0, least(5, score / greatest(capacity, 1))) * 100 as pct from dimmed)
    where zone in ('HIGH', 'CRITICAL')"""


@query(
    "zone_gps_alerts",
    sql(
        """select camera_id, frame_id, cell, zone, density, gps_lat, gps_lon,
        '[' || zone || '] ' || camera_id || ' Zone ' || cell || ' (' || cast(floor(pct) as bigint) || '% capacity) — GPS: '
        || case when gps_lat <> 0 then gps_lat || 'N ' || gps_lon || 'E' else 'GPS pending' end
        || ' — estimated ' || cast(floor(score) as bigint) || ' people' as message from alerts""",
        "zones",
        "capacity",
        "cameras",
        dimmed=_DIMMED,
        alerts=_ALERTS,
    ),
)
def zone_gps_alerts(spark, sf):
    return alerts.cell_alerts(_dimmed(spark, sf)).select(
        "camera_id", "frame_id", "cell", "zone", "density", "gps_lat", "gps_lon", "message"
    )
