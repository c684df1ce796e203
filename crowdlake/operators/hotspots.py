"""Grid-cell trends and hotspots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from crowdlake import constants as K
from crowdlake.functions import scalars as S
from crowdlake.operators.frames import FRAME
from crowdlake.operators.history import growth_rate
from crowdlake.operators.scale import task_parts


def trend_labels(zones: DataFrame, seconds: float = 8.0, parts: int | None = None) -> DataFrame:
    """Growth of each cell over the last seconds and its label; quiet cells are STABLE."""
    parts = parts or task_parts(zones)
    d = growth_rate(zones, "score", seconds, ["camera_id", "r", "c"], parts=parts).drop("growth_n")
    g = F.col("growth")
    label = (
        F.when(F.col("score") < K.MIN_HOTSPOT, "STABLE")
        .when(g >= K.CRITICAL_CUT, "CRITICAL")
        .when(g >= K.GROWING_CUT, "GROWING")
        .when(g <= -K.GROWING_CUT, "EASING")
        .otherwise("STABLE")
    )
    return d.withColumn("trend", label)


def hotspots(labelled: DataFrame, n: int = 3, parts: int | None = None) -> DataFrame:
    """Per frame: its densest ``n`` cells of at least 30 and the expanding alert they raise. Frames are dealt into
    ``parts`` partitions if given."""
    if parts:
        labelled = labelled.select(*FRAME, "t", "r", "c", "score", "trend").repartition(parts, *FRAME)
    cell = F.col("r") * 3 + F.col("c")
    rank = Window.partitionBy(*FRAME).orderBy(F.col("score").desc(), cell.desc())
    top = labelled.withColumn("_rank", F.row_number().over(rank))
    hot = (F.col("_rank") <= n) & (F.col("score") >= K.MIN_HOTSPOT)
    growing = hot & F.col("trend").isin("GROWING", "CRITICAL")
    name = S.cell_label("r", "c")

    def listed(cond, text):
        items = F.array_sort(F.collect_list(F.when(cond, F.struct(F.col("_rank"), text.alias("x")))))
        return F.array_join(F.transform(items, lambda s: s["x"]), ", ")

    out = top.groupBy(*FRAME, "t").agg(
        listed(hot, name).alias("hotspots"),
        F.coalesce(F.bool_or(growing), F.lit(False)).alias("expanding"),
        listed(growing, F.concat(name, F.lit(" "), F.col("trend"))).alias("_parts"),
    )
    text = F.when(F.col("_parts") == "", "").otherwise(F.concat(F.lit("HOTSPOT EXPANDING: "), "_parts"))
    return out.withColumn("alert_text", text).drop("_parts")


def hottest_cell(zones: DataFrame) -> DataFrame:
    """The frame's densest cell (first on ties) when it is at least 30 % full. Needs ``capacity``."""
    cell = F.col("r") * 3 + F.col("c")
    best = zones.groupBy(*FRAME).agg(
        F.max_by(F.struct("r", "c", "score", "capacity"), F.struct(F.col("score"), -cell)).alias("_b")
    )
    share = F.col("_b.score") / F.greatest(F.col("_b.capacity").cast("double"), F.lit(1.0))
    return best.where(share >= 0.30).select(
        *FRAME, S.cell_label("_b.r", "_b.c").alias("cell"), F.col("_b.score").alias("score"), share.alias("fill")
    )
