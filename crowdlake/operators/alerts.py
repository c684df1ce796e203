"""Cell alerts, cooldowns, notifications and the message outbox."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crowdlake import constants as K
from crowdlake.functions import scalars as S
from crowdlake.operators.materialize import materialize
from crowdlake.operators.scale import keep_latest
from crowdlake.operators.temporal import throttle

DISPATCHED = ("HIGH", "CRITICAL")


def cell_alerts(zones: DataFrame) -> DataFrame:
    """GPS-tagged alerts of cells whose fill is HIGH or CRITICAL.

    Needs ``score, capacity, lat_min, lat_max, lon_min, lon_max``; unknown bounds give 0, 0.
    """
    fill = F.col("score") / F.greatest(F.col("capacity").cast("double"), F.lit(1.0))
    pct = S.occupancy_pct("score", "capacity")
    bounds = ("lat_min", "lat_max")
    d = (
        zones.withColumn("zone", S.risk_zone(fill, "four_level"))
        .where(F.col("zone").isin(*DISPATCHED))
        .withColumn("cell", S.cell_label("r", "c"))
        .withColumn("gps_lat", S.cell_latitude(*bounds, "r"))
        .withColumn("gps_lon", S.cell_longitude(*bounds, "lon_min", "lon_max", "c"))
        .withColumn("density", S.half_even("score"))
        .withColumn("occupancy_pct", F.bround(pct, 1))
    )
    gps = F.when(F.col("gps_lat") != 0.0, F.concat("gps_lat", F.lit("N "), "gps_lon", F.lit("E"))).otherwise(
        "GPS pending"
    )
    share = F.when(pct > 0, F.concat(F.lit(" ("), F.floor(pct).cast("string"), F.lit("% capacity)"))).otherwise("")
    message = F.concat(
        F.lit("["), "zone", F.lit("] "), "camera_id", F.lit(" Zone "), "cell", share,
        F.lit(" — GPS: "), gps, F.lit(" — estimated "), F.floor("score").cast("string"), F.lit(" people"),
    )
    return d.withColumn("message", message)


def alert_cooldown(alerts: DataFrame, gap: float = K.ALERT_COOLDOWN) -> DataFrame:
    """Alerts to dispatch: HIGH and CRITICAL, at most one per cell and ``gap`` seconds."""
    # Severe alerts are few next to the cells they come from, and the throttle reads them three times.
    severe = materialize(alerts.where(F.col("zone").isin(*DISPATCHED)))
    return throttle(severe, ["camera_id", "cell"], gap, ["t", "frame_id"])


def notify_cooldown(df: DataFrame, gap: float = K.NOTIFY_COOLDOWN, order=("t", "event_id")) -> DataFrame:
    return throttle(df, ["camera_id"], gap, order, strict=True)


def notifications(state: DataFrame, surges: DataFrame, dims: DataFrame, limit: int = 200) -> DataFrame:
    """Newest surge notifications: a forecast surge or a STAMPEDE label, cooled down per camera.

    ``state`` holds ``camera_id, t, event_id, people_count, risk_index, risk_level, confidence`` and, where
    known, ``primary_causes``; ``surges`` one row per surging (camera_id, t, event_id), as ``surge`` gives
    them; ``dims`` camera location and GPS bounds. The rows are what :func:`alert_outbox` takes.
    """
    at = ["camera_id", "t", "event_id"]
    sure = F.col("confidence_percent") if "confidence_percent" in surges.columns else F.lit(85.0)
    d = state.join(surges.select(*at, "horizon", "predicted_count", "growth_percent", sure.alias("_sure")), at, "left")
    d = d.where(F.col("horizon").isNotNull() | (F.col("risk_level") == "STAMPEDE"))
    d = notify_cooldown(materialize(d))
    return described(keep_latest(d, [], limit, ["t", "event_id"]), dims)


def described(d: DataFrame, dims: DataFrame) -> DataFrame:
    """Place, texts and counts of chosen states with their surge (``horizon, predicted_count, growth_percent, _sure``)."""
    have = d.columns
    place = dims.select(
        "camera_id",
        "location",
        F.bround((F.col("lat_min") + F.col("lat_max")) / 2, 6).alias("gps_lat"),
        F.bround((F.col("lon_min") + F.col("lon_max")) / 2, 6).alias("gps_lon"),
    )
    d = d.join(place, "camera_id", "left")
    # The texts of a notification.
    surge_text = F.concat(
        F.lit("Predicted crowd surge to "), "predicted_count", F.lit(" pax (+"), S.half_even("growth_percent"),
        F.lit("% growth) in next "), "horizon", F.lit(" [Confidence: "), S.half_even("_sure"), F.lit("%]"),
    )
    plain_text = F.concat(F.col("people_count"), F.lit(" pax detected at "), F.col("camera_id"))
    causes = F.col("primary_causes") if "primary_causes" in have else F.array().cast("array<string>")
    lat, lon = F.coalesce("gps_lat", F.lit(0.0)), F.coalesce("gps_lon", F.lit(0.0))
    return d.select(
        F.concat(F.lit("notif-"), "event_id", F.lit("-"), "camera_id").alias("notification_id"),
        "camera_id",
        "t",
        "event_id",
        "location",
        F.lit("STAMPEDE").alias("severity"),
        F.lit("STAMPEDE").alias("risk_level"),
        "risk_index",
        "people_count",
        S.confidence_pct("confidence").alias("confidence_percent"),
        "horizon",
        "predicted_count",
        "growth_percent",
        causes.alias("primary_causes"),
        lat.alias("gps_lat"),
        lon.alias("gps_lon"),
        F.format_string("https://maps.google.com/?q=%.6f,%.6f", lat, lon).alias("maps_url"),
        F.concat(F.lit("STAMPEDE WARNING: "), F.coalesce(surge_text, plain_text)).alias("message"),
        F.lit(True).alias("unread"),
    )


def notification_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if("unread").alias("unread_count"))


def alert_outbox(alerts: DataFrame) -> DataFrame:
    """One multi-line message per cell alert or notification, absent parts left out.

    Reads ``camera_id`` and, where present, ``zone`` (else ``risk_level``), ``cell`` (else "Sector 1"),
    ``occupancy_pct`` (else ``risk_index``), ``density`` (else ``people_count``), ``location, horizon,
    predicted_count, growth_percent, confidence_percent, primary_causes, message, gps_lat, gps_lon``.
    """
    have = set(alerts.columns)

    def opt(name, default=None):
        return F.col(name) if name in have else F.lit(default)

    def first(name, other, default):
        return F.coalesce(opt(name), opt(other), F.lit(default))

    zone, cell = first("zone", "risk_level", "?"), opt("cell", "Sector 1")
    index, crowd = first("occupancy_pct", "risk_index", 0.0).cast("double"), first("density", "people_count", 0)

    predicted = opt("predicted_count")
    lat, lon = opt("gps_lat", 0.0), opt("gps_lon", 0.0)
    causes = F.col("primary_causes") if "primary_causes" in have else F.lit(None).cast("array<string>")
    located = lat != 0.0
    lines = [
        # The lines of a message.
        F.concat(zone, F.lit(" STAMPEDE WARNING ALERT")),
        F.concat(F.lit("Device: "), "camera_id", F.lit(" | Location: "),
                 F.coalesce(opt("location"), F.lit("unknown")), F.lit(" ("), cell, F.lit(")")),
        F.concat(F.lit("Risk Level: "), zone, F.lit(" (Index: "), F.format_string("%.1f", index), F.lit("/100)")),
        F.concat(F.lit("Current Crowd: ~"), crowd, F.lit(" people")),
        F.when(
            predicted.isNotNull(),
            F.concat(F.lit("Forecast ("), opt("horizon", "5m"), F.lit("): "), crowd, F.lit(" -> "), predicted,
                     F.lit(" pax (+"), S.half_even(opt("growth_percent", 0.0)), F.lit("% growth)")),
        ),
        F.when(predicted.isNotNull(), F.concat(F.lit("Prediction Confidence: "), opt("confidence_percent", 85.0), F.lit("%"))),
        F.when(F.size(causes) > 0, F.concat(F.lit("Primary Drivers: "), F.array_join(causes, ", "))),
        F.concat(F.lit("Action: "), opt("message")),
        F.when(located, F.concat(F.lit("GPS: "), lat, F.lit("N, "), lon, F.lit("E"))),
        F.when(located, F.concat(F.lit("Maps: https://maps.google.com/?q="), lat, F.lit(","), lon)),
    ]
    return alerts.withColumn("body", F.concat_ws("\n", *lines))
