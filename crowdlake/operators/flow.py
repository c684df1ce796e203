"""Motion vectors in long form: (camera_id, frame_id, row, col, fx, fy). Frames bound every group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from crowdlake import constants as K
from crowdlake.functions import scalars as S
from crowdlake.operators.frames import FRAME, fill_grid


def compensate_flow(df: DataFrame) -> DataFrame:
    """Subtract the frame's median vector and add the magnitude ``mag``."""
    w = Window.partitionBy(*FRAME)
    d = df.withColumn("_mx", F.percentile("fx", F.lit(0.5)).over(w)).withColumn(
        "_my", F.percentile("fy", F.lit(0.5)).over(w)
    )
    d = d.withColumn("fx", F.col("fx") - F.col("_mx")).withColumn("fy", F.col("fy") - F.col("_my"))
    return d.withColumn("mag", F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy"))).drop("_mx", "_my")


def motion_metrics(compensated: DataFrame, floor: float = K.MOTION_FLOOR) -> DataFrame:
    """Median speed and turbulence (population deviation) of the moving vectors."""
    active = F.when(F.col("mag") > floor, F.col("mag"))
    return compensated.groupBy(*FRAME).agg(
        F.coalesce(F.percentile(active, F.lit(0.5)), F.lit(0.0)).alias("speed"),
        F.coalesce(F.stddev_pop(active), F.lit(0.0)).alias("turbulence"),
    )


def speed_grid(compensated: DataFrame, h: int, w: int, floor: float = K.MOTION_FLOOR) -> DataFrame:
    """Median speed per cell; zero where fewer than 8 % of its vectors move."""
    zone = S.tail_thirds("row", h) * 3 + S.tail_thirds("col", w)
    moving = F.col("mag") > floor
    cells = compensated.groupBy(*FRAME, zone.alias("_z")).agg(
        F.when(F.count_if(moving) / F.count(F.lit(1)) < K.MIN_ACTIVE_RATIO, 0.0)
        .otherwise(F.percentile(F.when(moving, F.col("mag")), F.lit(0.5)))
        .alias("speed")
    )
    return fill_grid(cells, {"speed": F.lit(0.0)})


def gate_motion(zones: DataFrame) -> DataFrame:
    """Zero a cell's speed below five people and all motion of an empty frame.

    Needs ``score, cell_speed, density, motion, turbulence``.
    """
    empty = F.col("density") < K.MIN_CROWD
    return (
        zones.withColumn("cell_speed", F.when(empty | (F.col("score") < 5.0), 0.0).otherwise(F.col("cell_speed")))
        .withColumn("motion", F.when(empty, 0.0).otherwise(F.col("motion")))
        .withColumn("turbulence", F.when(empty, 0.0).otherwise(F.col("turbulence")))
    )


def opposing_cells(compensated: DataFrame, h: int, w: int, zones: DataFrame | None = None) -> DataFrame:
    """Opposing-flow score and danger flag of each cell: minority share on the worse axis."""
    zone = S.tail_thirds("row", h) * 3 + S.tail_thirds("col", w)
    moving = F.col("mag") > K.OPPOSING_FLOOR
    n = F.count_if(moving)

    def minority(axis):
        return F.least(F.count_if(moving & (F.col(axis) > 0)), F.count_if(moving & (F.col(axis) < 0)))

    enough = (n >= 10) & (n / F.count(F.lit(1)) >= K.MIN_ACTIVE_RATIO)
    score = F.when(enough, F.greatest(minority("fx"), minority("fy")) / n).otherwise(0.0)
    cells = compensated.groupBy(*FRAME, zone.alias("_z")).agg(score.alias("opposing"))
    out = fill_grid(cells, {"opposing": F.lit(0.0)})
    if zones is not None:
        out = out.join(zones.select(*FRAME, "r", "c", "score"), FRAME + ["r", "c"], "left")
        crowded = F.coalesce(F.col("score") >= K.MIN_HOTSPOT, F.lit(True))
        out = out.withColumn("opposing", F.when(crowded, F.col("opposing")).otherwise(0.0)).drop("score")
    return out.withColumn("danger", F.col("opposing") >= K.OPPOSING_DANGER)


def opposing_flow(compensated: DataFrame, h: int, w: int, zones: DataFrame | None = None) -> DataFrame:
    """Frame summary: worst score, danger flag and alert text listing dangerous cells."""
    cells = opposing_cells(compensated, h, w, zones)
    listed = F.array_join(
        F.array_sort(F.collect_list(F.when(F.col("danger"), S.cell_label("r", "c")))), ", "
    )
    out = cells.groupBy(*FRAME).agg(
        F.max("opposing").alias("max_score"), F.bool_or("danger").alias("any_dangerous"), listed.alias("_cells")
    )
    text = F.when(F.col("_cells") == "", "").otherwise(F.concat(F.lit("OPPOSING FLOW DETECTED: "), "_cells"))
    return out.withColumn("alert_text", text).drop("_cells")
