"""Readers. Text files arrive as strings, are matched by column name and cast by the parsers below,
which also accept string tables from elsewhere."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from crowdlake.constants import CHUNK_SECONDS
from crowdlake.functions import scalars as S
from crowdlake.operators.frames import unpack_frames
from crowdlake.operators.materialize import materialize
from crowdlake.operators.scale import asof, number_rows
from crowdlake.operators.temporal import rolling_median

HISTORY_COLUMNS = ["timestamp_utc", "camera_id", "session_id", "raw_observed_count", "observed_count"]
LABEL_COLUMNS = ["camera_id", "predicted_count", "actual_count", "angle"]

STATS_SCHEMA = T.StructType(
    [
        T.StructField("drone_id", T.StringType()),
        T.StructField("density_score", T.DoubleType()),
        T.StructField("comp_zone", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("pressure", T.DoubleType()),
        T.StructField("stampede_prob", T.DoubleType()),
        T.StructField("risk_index", T.DoubleType()),
        T.StructField("risk_level", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("primary_causes", T.ArrayType(T.StringType())),
        T.StructField("motion_speed", T.DoubleType()),
        T.StructField("turbulence", T.DoubleType()),
        T.StructField("hotspot_alert", T.StringType()),
        T.StructField("opposing_alert", T.StringType()),
        T.StructField("gps_alerts", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
        T.StructField("zone_scores", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("analytics_active", T.BooleanType()),
        T.StructField("analytics_seq", T.LongType()),
        T.StructField("t", T.DoubleType()),
    ]
)

# What absent fields of an update stand for.
STATS_DEFAULTS = {
    "pressure": 0.0,
    "stampede_prob": 0.0,
    "risk_index": 0.0,
    "risk_level": "SAFE",
    "confidence": 1.0,
    "motion_speed": 0.0,
    "turbulence": 0.0,
    "hotspot_alert": "",
    "opposing_alert": "",
    "analytics_active": True,
}


def union_histories(tables: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; columns a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def read_csv_by_name(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """String columns of CSV files whose headers may differ between paths."""
    return union_histories([spark.read.option("header", True).csv(p) for p in paths])


def parse_count_history(raw: DataFrame) -> DataFrame:
    """Typed count history of each camera's highest session. Unknown columns are dropped, and so are rows
    without a readable time and count."""
    for name in HISTORY_COLUMNS:
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast("string"))
    d = raw.select(
        F.try_to_timestamp("timestamp_utc").alias("ts"),
        "camera_id",
        F.coalesce(F.expr("try_cast(session_id as int)"), F.lit(0)).alias("session_id"),
        F.expr("try_cast(raw_observed_count as double)").alias("raw_count"),
        F.expr("try_cast(observed_count as double)").alias("count"),
    ).where("ts is not null and count is not null and not isnan(count)")
    d = d.withColumn("count", F.greatest(F.lit(0.0), F.col("count")))
    newest = d.groupBy("camera_id").agg(F.max("session_id").alias("session_id"))
    return d.join(newest, ["camera_id", "session_id"])


def read_count_history(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return parse_count_history(read_csv_by_name(spark, paths))


def parse_labels(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable labels, quarantined rows). A byte-order mark before the first header is ignored."""
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    missing = sorted(set(LABEL_COLUMNS) - set(raw.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    d = raw.withColumn("camera_id", F.lower(F.trim("camera_id"))).withColumn("angle", F.lower(F.trim("angle")))
    for name in ("predicted_count", "actual_count"):
        d = d.withColumn(name, F.expr(f"try_cast({name} as double)"))
    problem = (
        F.when(F.coalesce("camera_id", F.lit("")) == "", "camera_id is required")
        .when(F.coalesce("angle", F.lit("")) == "", "angle is required")
        .when(F.col("predicted_count").isNull() | F.col("actual_count").isNull(), "counts must be numbers")
    )
    d = d.withColumn("problem", problem)
    return d.where("problem is null").drop("problem"), d.where("problem is not null")


def read_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_labels(spark.read.option("header", True).csv(path))


def read_frames(spark: SparkSession, path: str, kind: str = "density") -> DataFrame:
    """Frame table from Parquet; packed density maps are unpacked to cells."""
    df = spark.read.parquet(path)
    if kind == "density" and isinstance(df.schema["d"].dataType, T.ArrayType):
        return unpack_frames(df)
    return df


def apply_stats_defaults(df: DataFrame) -> DataFrame:
    """Fill absent fields of updates and normalize the camera id."""
    filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in STATS_DEFAULTS.items() if c in df.columns}
    for name in ("primary_causes", "gps_alerts"):
        if name in df.columns:
            empty = F.array().cast(df.schema[name].dataType)
            filled[name] = F.coalesce(F.col(name), empty)
    return df.withColumns(filled).withColumn("camera_id", S.normalize_camera_id("drone_id"))


def read_stats_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Updates as a stream of JSON files with typed defaults."""
    raw = spark.readStream.schema(STATS_SCHEMA).option("maxFilesPerTrigger", max_files).json(path)
    return apply_stats_defaults(raw)


def parse_telemetry(raw: DataFrame) -> DataFrame:
    """Typed telemetry; blank cells are null."""
    types = {"latency_s": "double", "infer_s": "double", "reconnects": "bigint", "drop_pct": "double", "fps": "double", "t": "double"}
    casts = {c: F.expr(f"try_cast(nullif(trim({c}), '') as {k})") for c, k in types.items()}
    return raw.withColumns(casts)


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    return parse_telemetry(spark.read.option("header", True).option("nullValue", "").csv(path))


def history_from_frames(counts: DataFrame, interval: float = 15.0, k: int = 5) -> DataFrame:
    """Count history of recorded sources (``source, t, count``): one sample per ``interval`` of each
    source, taken from the newest frame at that instant and median-smoothed."""
    length = counts.groupBy("source").agg(F.max("t").alias("_end"))
    steps = F.ceil((F.col("_end") - 0.05) / interval).cast("int")
    instants = length.where(steps > 0).select(
        "source", F.explode(F.sequence(F.lit(0), steps - 1)).alias("sample_no")
    ).withColumn("t", F.col("sample_no") * F.lit(float(interval)))
    d = asof(instants, counts.select("source", "t", "count"), ["source"], ["count"]).where("count is not null")
    d = number_rows(materialize(d), ["source"], ["t", "sample_no"], width=CHUNK_SECONDS)
    d = rolling_median(d, k, "count", "_median", ["source"], ["t", "sample_no"])
    return d.select(
        F.timestamp_add("MICROSECOND", (F.col("t") * 1e6).cast("bigint"), F.lit("2026-01-01 00:00:00+00:00").cast("timestamp")).alias("ts"),
        F.concat(F.lit("video:"), "source").alias("camera_id"),
        F.lit(0).alias("session_id"),
        S.half_even("count").alias("raw_count"),
        S.half_even("_median").alias("count"),
        F.col("source").alias("source_video"),
        F.bround("t", 3).alias("video_second"),
    )
