"""Density maps in long form: one row per (camera_id, frame_id, row, col) with density ``d``.

A frame is one image: its cells are bounded by the map resolution, so frames are the unit of
parallelism here and per-frame windows are safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from crowdlake.constants import MIN_CROWD
from crowdlake.functions import scalars as S

FRAME = ["camera_id", "frame_id"]
CELL = FRAME + ["row", "col"]


def unpack_frames(df: DataFrame) -> DataFrame:
    """Packed maps (``h``, ``w``, ``d ARRAY``) to one row per cell."""
    return df.select(*FRAME, "w", F.posexplode("d").alias("_pos", "d")).select(
        *FRAME,
        F.floor(F.col("_pos") / F.col("w")).cast("int").alias("row"),
        (F.col("_pos") % F.col("w")).cast("int").alias("col"),
        "d",
    )


def clean_density(df: DataFrame, ratio: float = 0.015) -> DataFrame:
    """Clip negatives and zero cells below a peak-relative speckle threshold."""
    d = df.withColumn("d", F.greatest(F.col("d"), F.lit(0.0)))
    if ratio <= 0:
        return d
    peak = F.max("d").over(Window.partitionBy(*FRAME))
    threshold = F.greatest(F.lit(0.002), F.least(peak * ratio, F.lit(0.05)))
    return d.withColumn("d", F.when((peak > 0) & (F.col("d") < threshold), 0.0).otherwise(F.col("d")))


def mask_graphics(df: DataFrame, h) -> DataFrame:
    """Zero density under saturated graphics in the top and bottom margins. Needs ``hue, sat, val``."""
    hue, row = F.col("hue"), F.col("row")
    h = S._c(h)
    # Saturation, brightness and hue bands of broadcast graphics.
    bright = (F.col("sat") > 95) & (F.col("val") > 135)
    hues = (hue < 12) | (hue > 168) | ((hue > 24) & (hue < 42)) | ((hue > 42) & (hue < 88)) | ((hue > 88) & (hue < 105))
    margin = F.floor(h * 0.15)
    # A map too low for a margin is masked everywhere.
    edge = (margin <= 0) | (row < margin) | (row >= h - margin)
    return df.withColumn("d", F.when(bright & hues & edge, 0.0).otherwise(F.col("d")))


def blend_density(a: DataFrame, b: DataFrame, wa: float = 0.5, wb: float = 0.5) -> DataFrame:
    """Weighted sum of two maps of the same size, weights normalized."""
    total = max(wa + wb, 1e-6)
    both = a.select(*CELL, (F.col("d") * (wa / total)).alias("d")).unionByName(
        b.select(*CELL, (F.col("d") * (wb / total)).alias("d"))
    )
    return both.groupBy(*CELL).agg(F.sum("d").alias("d"))


def flip_average(a: DataFrame, mirrored: DataFrame, w) -> DataFrame:
    """Average a map with one computed on the mirrored image."""
    return blend_density(a, mirrored.withColumn("col", (S._c(w) - 1 - F.col("col")).cast("int")))


def _bilinear_targets(pos: Column, size: Column, new_size: int) -> Column:
    """Target positions a source position contributes to, with bilinear weights."""
    step = size / new_size
    lo = F.greatest(F.lit(0), F.floor((pos - 0.5) / step - 0.5).cast("int"))
    hi = F.least(F.lit(new_size - 1), F.ceil((pos + 1.5) / step - 0.5).cast("int"))

    def weigh(k):
        centre = F.greatest(F.lit(0.0), F.least((k + 0.5) * step - 0.5, size - 1.0))
        return F.struct(k.alias("k"), F.greatest(F.lit(0.0), 1.0 - F.abs(centre - pos)).alias("wt"))

    return F.filter(F.transform(F.sequence(lo, hi), weigh), lambda s: s["wt"] > 0)


def resize_density(df: DataFrame, size: tuple[int, int], new_size: tuple[int, int]) -> DataFrame:
    """Bilinear resize scaled by the area ratio, so the head-count is kept.

    Every source cell is scattered to the targets it touches; partial sums combine before the
    exchange.
    """
    (h, w), (nh, nw) = size, new_size
    rows = df.withColumn("_r", F.explode(_bilinear_targets(F.col("row"), F.lit(float(h)), nh)))
    both = rows.withColumn("_q", F.explode(_bilinear_targets(F.col("col"), F.lit(float(w)), nw)))
    area = (h * w) / (nh * nw)
    return (
        both.select(
            *FRAME,
            F.col("_r.k").alias("row"),
            F.col("_q.k").alias("col"),
            (F.col("d") * F.col("_r.wt") * F.col("_q.wt")).alias("d"),
        )
        .groupBy(*CELL)
        .agg((F.sum("d") * area).alias("d"))
    )


def normalize_density(df: DataFrame) -> DataFrame:
    """Spatial distribution: cells divided by the map's sum."""
    total = F.sum("d").over(Window.partitionBy(*FRAME))
    return df.withColumn("d", F.col("d") / (total + 1e-6))


def frame_metrics(df: DataFrame) -> DataFrame:
    """Count, peak, hotspot ratio and pressure risk of each map."""
    d = df.withColumn("d", F.greatest(F.col("d"), F.lit(0.0)))
    p90 = F.percentile(F.when(F.col("d") > 0, F.col("d")), F.lit(0.9)).over(Window.partitionBy(*FRAME))
    stats = (
        d.withColumn("_p90", p90)
        .groupBy(*FRAME)
        .agg(
            F.sum("d").alias("density"),
            F.max("d").alias("peak"),
            F.avg(F.when(F.col("d") >= F.col("_p90"), 1.0).otherwise(0.0)).alias("_ratio"),
        )
    )
    crowd = F.col("density") >= MIN_CROWD
    risk = (
        0.55 * S.sat_exp("density", 1200.0)
        + 0.25 * S.sat_ratio("peak", 300.0)
        + 0.20 * F.least(F.lit(1.0), F.col("_ratio") * 4.0)
    )
    return stats.select(
        *FRAME,
        "density",
        "peak",
        F.when(crowd, F.col("_ratio")).otherwise(0.0).alias("hotspot_ratio"),
        F.when(crowd, risk).otherwise(0.0).alias("frame_risk"),
    )


def fill_grid(per_cell: DataFrame, defaults: dict[str, Column], keys=None) -> DataFrame:
    """All nine cells of every frame from rows of occupied ones (``_z`` 0..8, null for none)."""
    keys = keys or FRAME
    cells = [
        F.struct(
            F.lit(k // 3).alias("r"),
            F.lit(k % 3).alias("c"),
            *[F.coalesce(F.max(F.when(F.col("_z") == k, F.col(n))), empty).alias(n) for n, empty in defaults.items()],
        )
        for k in range(9)
    ]
    return per_cell.groupBy(*keys).agg(F.array(*cells).alias("_cells")).select(*keys, F.inline("_cells"))


def zone_scores(df: DataFrame, h: int, w: int) -> DataFrame:
    """3x3 sums and area-normalized sums over exact integer thirds."""
    zone = S.equal_thirds("row", h) * 3 + S.equal_thirds("col", w)
    sums = df.groupBy(*FRAME, zone.alias("_z")).agg(F.sum("d").alias("score"))
    rows = [(k + 1) * h // 3 - k * h // 3 for k in range(3)]
    cols = [(k + 1) * w // 3 - k * w // 3 for k in range(3)]
    area = F.element_at(F.array(*[F.lit(float(max(1, a * b))) for a in rows for b in cols]), F.col("r") * 3 + F.col("c") + 1)
    return fill_grid(sums, {"score": F.lit(0.0)}).withColumn("score_per_area", F.col("score") / area)
