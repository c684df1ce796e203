"""Sinks and the formatted tables they write."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crowdlake.constants import HORIZONS
from crowdlake.operators.scale import keep_latest


def crowd_log(df: DataFrame) -> DataFrame:
    """Per-frame log with fixed decimals."""

    def fixed(name, digits):
        return F.format_string(f"%.{digits}f", F.col(name).cast("double")).alias(name)

    return df.select(
        "camera_id",
        "frame_id",
        "zone",
        fixed("risk_score", 4),
        fixed("density_score", 2),
        fixed("peak_density", 6),
        fixed("hotspot_ratio", 4),
        fixed("inference_time_s", 4),
        fixed("frame_age_s", 4),
        "stride",
    )


def write_crowd_log(df: DataFrame, path: str, mode: str = "append") -> None:
    crowd_log(df).write.mode(mode).option("header", True).csv(path)


def telemetry_text(df: DataFrame) -> DataFrame:
    """Telemetry as written: fixed decimals, blanks for nulls."""

    def fixed(name, digits):
        text = F.format_string(f"%.{digits}f", F.col(name).cast("double"))
        return F.when(F.col(name).isNull(), "").otherwise(text).alias(name)

    return df.select(
        "t", "camera_id", fixed("latency_s", 6), fixed("infer_s", 6), "reconnects", fixed("drop_pct", 2), fixed("fps", 2)
    )


def write_telemetry(df: DataFrame, path: str, mode: str = "append") -> None:
    telemetry_text(df).write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def alert_log(alerts: DataFrame, at: Column | None = None) -> DataFrame:
    """One JSON ``line`` per alert with its dispatch time, now unless ``at`` is given."""
    columns = [F.col(c) for c in alerts.columns]
    stamped = F.struct(*columns, (F.current_timestamp() if at is None else at).alias("timestamp"))
    return alerts.withColumn("line", F.to_json(stamped))


def write_alert_log(alerts: DataFrame, path: str, mode: str = "append") -> None:
    alert_log(alerts).select("line").write.mode(mode).text(path)


def alert_features(alerts: DataFrame) -> DataFrame:
    """One GeoJSON feature per located alert, as text."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("gps_lon", "gps_lat").alias("coordinates")).alias("geometry"),
        F.struct("zone", "cell", "density", "occupancy_pct").alias("properties"),
    )
    return alerts.where("gps_lat <> 0").withColumn("feature", F.to_json(feature))


def alerts_geojson(alerts: DataFrame, limit: int = 1000) -> DataFrame:
    """One document with the newest ``limit`` located alerts, oldest first."""
    newest = keep_latest(alert_features(alerts), [], limit, ["t", "frame_id", "cell"])
    items = F.array_sort(F.collect_list(F.struct("t", "frame_id", "cell", "feature")))
    texts = F.array_join(F.transform(items, lambda s: s["feature"]), ",")
    return newest.agg(
        F.concat(F.lit('{"type":"FeatureCollection","features":['), texts, F.lit("]}")).alias("document"),
        F.count(F.lit(1)).alias("features"),
    )


def publish_verdict(profiles: DataFrame) -> DataFrame:
    """One row: whether every profile met its target, how many there are and which did not."""
    failed = F.when(~F.col("target_met"), F.col("camera_id"))
    return profiles.agg(
        F.bool_and("target_met").alias("approved"),
        F.count(F.lit(1)).alias("profiles"),
        F.array_sort(F.collect_set(failed)).alias("failed"),
    )


def _hadoop(spark: SparkSession, path: str):
    """The path as Hadoop's object and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _rename(spark: SparkSession, old: str, new: str) -> None:
    source, fs = _hadoop(spark, old)
    if not fs.rename(source, _hadoop(spark, new)[0]):
        raise OSError(f"cannot rename {old} to {new}")


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return fs.exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop(spark, path)
    fs.delete(p, True)


def publish_profiles(profiles: DataFrame, path: str) -> bool:
    """Replace the active profiles if every one met its target; else write them to ``<path>.rejected``
    and leave the active ones alone. An empty table is an error.

    The new profiles are written beside the active ones and take their place by renaming: a failure at any moment
    leaves a whole version for :func:`read_profiles`, which looks at ``<path>.previous`` if the crash came between the
    two renames.
    """
    spark = profiles.sparkSession
    verdict = profiles.agg(F.bool_and("target_met")).first()[0]
    if verdict is None:
        raise ValueError("there are no calibration profiles")
    target = path if verdict else f"{path}.rejected"
    staged, previous = f"{path}.staged-{uuid.uuid4().hex}", f"{target}.previous"
    try:
        profiles.write.json(staged)
        if _exists(spark, target):
            _delete(spark, previous)
            _rename(spark, target, previous)
        _rename(spark, staged, target)
    except BaseException:
        _delete(spark, staged)
        raise
    return bool(verdict)


def read_profiles(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The active profiles: the newest version that was published as a whole."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path if _exists(spark, f"{path}/_SUCCESS") else f"{path}.previous")


def forecast_wide(forecasts: DataFrame) -> DataFrame:
    """Forecasts with seven columns per horizon, one row per camera, session and time."""
    parts = {
        "predicted": "people_count",
        "lower": "lower_count",
        "upper": "upper_count",
        "model": "model",
        "target_time": "target_t",
        "accuracy": "confidence_percent",
        "trusted": "trusted",
    }
    aggs = [F.first(col, ignorenulls=True).alias(name) for name, col in parts.items()]
    wide = forecasts.groupBy("camera_id", "session_id", "t").pivot("label", [h for h, _ in HORIZONS]).agg(*aggs)
    names = [F.col(f"{h}_{p}").alias(f"{p}_{h}") for h, _ in HORIZONS for p in parts]
    return wide.select("camera_id", "session_id", "t", *names)
