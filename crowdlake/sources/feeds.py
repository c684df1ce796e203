"""Feed inventory from lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Default ports by scheme.
DEFAULT_PORTS = {"rtsp": 554, "rtsps": 322, "http": 80, "https": 443, "rtmp": 1935}


def read_feed_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def feed_inventory(lines: DataFrame, presets: DataFrame) -> DataFrame:
    """One row per distinct feed in ``value``: address, kind, host, port, masked address and brand.

    Blank lines and comments are dropped; a preset name stands for its address.
    """
    feed = F.trim(F.col("value"))
    d = lines.select(feed.alias("feed")).where((F.col("feed") != "") & ~F.startswith("feed", F.lit("#"))).distinct()
    d = d.join(presets.select(F.lower("name").alias("_name"), "address"), F.lower("feed") == F.col("_name"), "left")
    d = d.withColumn("address", F.coalesce("address", "feed"))
    low = F.lower("address")
    scheme = F.regexp_extract(low, "^([a-z]+)://", 1)
    kind = (
        F.when(F.col("_name").isNotNull(), "PRESET")
        .when(scheme.isin("rtsp", "rtsps"), "RTSP")
        .when(scheme.isin("rtmp", "rtmps"), "RTMP")
        .when(scheme.isin("http", "https"), "HTTP")
        .when(F.col("feed").rlike("^[0-9]+$"), "WEBCAM")
        .otherwise("FILE")
    )
    url = r"^(rtsps?|https?|rtmps?)://(?:[^@\n]+@)?([^/:\n]+)(?::([0-9]+))?"
    port = F.regexp_extract(low, url, 3)
    default = F.lit(554)
    for name, number in DEFAULT_PORTS.items():
        default = F.when(scheme == name, F.lit(number)).otherwise(default)
    networked = low.rlike(url)
    live = scheme.isin("rtsp", "rtsps", "http", "https", "rtmp", "rtmps", "srt", "srts") | (kind == "WEBCAM")
    masked = F.when(
        F.contains("address", F.lit("@")) & F.contains("address", F.lit("://")),
        F.regexp_replace("address", "^([^:]+://)[^@]*@", "$1*:*@"),
    ).otherwise(F.col("address"))
    return d.select(
        "feed",
        kind.alias("kind"),
        F.when(networked, F.regexp_extract(low, url, 2)).alias("host"),
        F.when(networked, F.when(port != "", port.cast("int")).otherwise(default)).alias("port"),
        masked.alias("masked"),
        live.alias("live"),
        F.when(F.col("_name").isNotNull(), F.upper(F.substring_index("_name", "_", 1))).alias("brand"),
    )


def brand_rollup(inventory: DataFrame) -> DataFrame:
    return inventory.where("brand is not null").groupBy("brand").agg(F.count(F.lit(1)).alias("feeds"))
