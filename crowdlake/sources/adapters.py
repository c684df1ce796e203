"""Canonical telemetry tables derived from the given Parquet tables.

Each adapter is a list of SQL expressions; a camera sees a sample about every 21 seconds at the
smallest scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Microseconds since 2024-01-01 of a zone-less timestamp, whatever the session time zone.
US = "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))"
T = f"{US} / 1e8"
CAMERA = "concat('drone-', cast(user_id % 8 + 1 as string)) as camera_id"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events")


def samples(spark, sf_dir):
    return events(spark, sf_dir).selectExpr(CAMERA, "event_id", f"{T} as t", "value as count", "event_type")


def observations(spark, sf_dir):
    return events(spark, sf_dir).selectExpr(
        CAMERA,
        "event_id as frame_id",
        f"{T} as t",
        "case when event_type = 'error' and event_id % 3 = 0 then 0e0 else value * 6 end as density",
        "value / 10 as peak",
        "(event_id % 100) / 100e0 as hotspot_ratio",
        "(event_id * 37 % 100) / 10e0 as motion",
        "(event_id * 53 % 80) / 10e0 as turbulence",
        "(event_id * 17 % 50) / 100e0 as opposing",
    )


def zones(spark, sf_dir):
    cells = events(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(8))))
    return cells.selectExpr(
        CAMERA,
        "event_id as frame_id",
        f"{T} as t",
        "cast(floor(k / 3) as int) as r",
        "cast(k % 3 as int) as c",
        "value * ((event_id * (k + 7)) % 11) / 3e0 as score",
    )


def detections(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('drone-', cast(l_suppkey % 8 + 1 as string)) as camera_id",
        "l_orderkey as frame_id",
        "l_linenumber as det_id",
        "l_quantity * 12e0 as x1",
        "(l_partkey % 70) * 5e0 as y1",
        "l_quantity * 12e0 + 20e0 as x2",
        "(l_partkey % 70) * 5e0 + 30e0 as y2",
        "l_discount * 8 as conf",
        "cast(l_partkey % 9 as int) as cls",
    )


def density_cells(spark, sf_dir):
    cells = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return cells.selectExpr(
        "concat('drone-', cast(vec_id % 8 + 1 as string)) as camera_id",
        "vec_id as frame_id",
        "cast(floor(pos / 8) as int) as row",
        "cast(pos % 8 as int) as col",
        "cast(v as double) * 40 as d",
    )


def packed_density(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").selectExpr(
        "concat('drone-', cast(vec_id % 8 + 1 as string)) as camera_id",
        "vec_id as frame_id",
        "8 as h",
        "8 as w",
        "transform(embedding, v -> cast(v as double) * 40) as d",
    )


def flow_cells(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id",
        "posexplode(transform(embedding, (v, i) -> struct(v as a, element_at(embedding, (i + 1) % 64 + 1) as b)))"
        " as (pos, e)",
    )
    return vectors.selectExpr(
        "concat('drone-', cast(floor(vec_id / 16) % 8 + 1 as int)) as camera_id",
        "cast(floor(vec_id / 16) as bigint) as frame_id",
        "cast(vec_id % 16 as int) as row",
        "cast(pos as int) as col",
        "cast(e.a as double) * 8 as fx",
        "cast(e.b as double) * 8 as fy",
    )


def labels(spark, sf_dir):
    return (
        table(spark, sf_dir, "lineitem")
        .selectExpr(
            "concat('drone-', cast(l_suppkey % 10 + 1 as string)) as camera_id",
            "l_orderkey",
            "l_linenumber",
            "l_quantity * 10 as predicted_count",
            "cast(floor(l_quantity * 12 + 4 + (l_linenumber - 3) * l_discount * 100) as double) as actual_count",
            "lower(l_returnflag) as angle",
        )
    )


def presence(spark, sf_dir):
    return events(spark, sf_dir).selectExpr(
        "event_id as poll_id",
        f"{T} as t",
        CAMERA,
        "event_type <> 'signup' as poll_ok",
        "event_type <> 'error' and event_type <> 'click' as ready",
    )


def modes(spark, sf_dir):
    return (
        events(spark, sf_dir)
        .where("event_type in ('signup', 'purchase')")
        .selectExpr(
            "event_id", f"{T} as t", "case when event_type = 'signup' then 'viewing' else 'counting' end as mode"
        )
    )


def telemetry(spark, sf_dir):
    return events(spark, sf_dir).selectExpr(
        CAMERA,
        "event_id",
        f"{T} as t",
        "case when event_type = 'error' then null else value / 100 end as latency_s",
        "value / 250 as infer_s",
        "event_id % 4 as reconnects",
        "(event_id * 13 % 200) / 10e0 as drop_pct",
        "10 + event_id % 25 as fps",
    )


def stats_updates(spark, sf_dir):
    return events(spark, sf_dir).selectExpr(
        "concat(case when event_id % 2 = 0 then 'drone' else 'Drone-' end, cast(user_id % 8 + 1 as string)) as drone_id",
        f"{T} as t",
        "event_id",
        "case when event_id % 10 = 0 then null else cast(floor(event_id / 3) as bigint) end as analytics_seq",
        "value as density_score",
        "event_type <> 'click' as analytics_active",
    )


def cameras(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return (
        nation.join(region, nation.n_regionkey == region.r_regionkey)
        .selectExpr(
            # drone-8 has samples but no row here.
            "concat('drone-', cast(n_nationkey + if(n_nationkey < 7, 1, 2) as string)) as camera_id",
            "r_name as location",
            "case when n_nationkey % 2 = 0 then 'DRONE' else 'CCTV' end as category",
            "20e0 + n_nationkey as altitude_m",
            "0.9e0 + n_nationkey * 0.03e0 as scale",
            "n_nationkey - 3e0 as bias",
            "16.98e0 + n_nationkey * 0.001e0 as lat_min",
            "16.983e0 + n_nationkey * 0.001e0 as lat_max",
            "81.73e0 as lon_min",
            "81.7325e0 as lon_max",
        )
    )
