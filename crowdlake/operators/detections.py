"""Detection boxes: filters, grid counts, pseudo-density, zone allocation and vehicles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from crowdlake.functions import scalars as S
from crowdlake.operators.frames import CELL, FRAME
from crowdlake.operators.scale import spread, task_parts


def qualifies(cls: int = 0, min_conf: float = 0.30) -> Column:
    return (F.col("cls") == cls) & (F.col("conf") >= min_conf)


def filter_detections(df: DataFrame, cls: int = 0, min_conf: float = 0.30) -> DataFrame:
    return df.where(qualifies(cls, min_conf))


def with_frames(df: DataFrame, frames: DataFrame) -> DataFrame:
    """Add a row without a box for each of ``frames`` that ``df`` has none of, so that its counts are zero.

    For frames that come as a table of their own. Where unfiltered boxes are at hand, the operators below count the
    qualifying ones of all (``where``), and no frame is lost in the first place.
    """
    missing = frames.select(*FRAME).distinct().join(df.select(*FRAME).distinct(), FRAME, "left_anti")
    return df.unionByName(missing, allowMissingColumns=True)


def all_zones(zones: DataFrame, frames: DataFrame, value: str) -> DataFrame:
    """Nine zones for each of ``frames``; zones that a frame lacks have a zero ``value``."""
    cells = F.array(*[F.struct(F.lit(i // 3).alias("r"), F.lit(i % 3).alias("c")) for i in range(9)])
    grid = frames.select(*FRAME).distinct().select(*FRAME, F.inline(cells))
    return grid.join(zones, [*FRAME, "r", "c"], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def _centres(df: DataFrame, rows: int, cols: int, frame_h: int, frame_w: int, where: Column | None = None) -> DataFrame:
    """Add the grid cell of each box, null for invalid boxes and those that ``where`` does not hold for."""
    cx = (F.col("x1") + F.col("x2")) * 0.5
    cy = (F.col("y1") + F.col("y2")) * 0.5
    ok = _finite(cx) & _finite(cy)
    if where is not None:
        ok &= F.coalesce(where, F.lit(False))

    def index(x, extent, parts):
        return F.when(ok, S.clamp(F.floor(x * (parts / extent)), 0, parts - 1)).cast("int")

    return df.withColumn("_gr", index(cy, frame_h, rows)).withColumn("_gc", index(cx, frame_w, cols))


def detection_zones(df: DataFrame, frame_h: int, frame_w: int, where: Column | None = None) -> DataFrame:
    """Centres of the boxes that ``where`` holds for counted into the 3x3 grid; frames without a valid one give zeros."""
    d = _centres(df, 3, 3, frame_h, frame_w, where).select(*FRAME, (F.col("_gr") * 3 + F.col("_gc")).alias("_z"))
    # Dealt by frame first: no task groups more frames than its share, before the exchange or after it.
    d = d.repartition(task_parts(df), *FRAME)
    cells = [F.struct(F.lit(k // 3).alias("r"), F.lit(k % 3).alias("c"), F.count_if(F.col("_z") == k).alias("people")) for k in range(9)]
    return d.groupBy(*FRAME).agg(F.array(*cells).alias("_cells")).select(*FRAME, F.inline("_cells"))


def detections_to_density(
    df: DataFrame, map_h: int, map_w: int, frame_h: int, frame_w: int, sigma: float = 2.0, where: Column | None = None
) -> DataFrame:
    """Gaussian pseudo-density whose sum is the number of valid boxes.

    Boxes are binned first, then blurred along columns and rows in turn. Partitioning by frame once
    serves all four aggregations. With ``where`` only boxes it holds for have mass, and a frame without any keeps one
    empty cell.
    """
    radius = (round(sigma * 8 + 1) | 1) // 2
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    taps = F.array(*[F.struct(F.lit(k - radius).alias("o"), F.lit(wt).alias("wt")) for k, wt in enumerate(kernel)])
    d = _centres(df, map_h, map_w, frame_h, frame_w, where)
    if where is None:
        d = d.where("_gr is not null")
    d = d.select(*FRAME, F.coalesce("_gr", F.lit(0)).alias("row"), F.coalesce("_gc", F.lit(0)).alias("col"), F.col("_gr").isNotNull().alias("_box"))
    d = spread(d, *FRAME)
    d = d.groupBy(*CELL).agg(F.count_if("_box").cast("double").alias("d"))
    # Mass that stays inside the map is known before blurring, so cells are scaled while few.
    inside = d.withColumn("_kept", F.col("d") * _kept_mass("row", map_h, kernel) * _kept_mass("col", map_w, kernel))
    frame = Window.partitionBy(*FRAME)
    d = inside.withColumn("d", F.col("d") * F.coalesce(F.try_divide(F.sum("d").over(frame), F.sum("_kept").over(frame)), F.lit(0.0))).drop("_kept")
    if where is not None:
        taps = F.when(F.col("d") > 0, taps).otherwise(F.array(F.struct(F.lit(0).alias("o"), F.lit(1.0).alias("wt"))))
    for axis, extent in (("col", map_w), ("row", map_h)):
        d = (
            d.withColumn("_k", F.explode(taps))
            .withColumn(axis, F.col(axis) + F.col("_k.o"))
            .where(F.col(axis).between(0, extent - 1))
            .groupBy(*CELL)
            .agg(F.sum(F.col("d") * F.col("_k.wt")).alias("d"))
        )
    return d


def _kept_mass(axis: str, extent: int, kernel: list[float]) -> Column:
    """Kernel mass that falls inside ``0..extent-1`` around each position."""
    radius = len(kernel) // 2
    kept = [sum(wt for k, wt in enumerate(kernel) if 0 <= pos + k - radius < extent) for pos in range(extent)]
    return F.element_at(F.array(*[F.lit(v) for v in kept]), F.col(axis) + 1)


def allocate_zones(df: DataFrame) -> DataFrame:
    """Integer people per cell that sum to the rounded ``total``; detections are always kept.

    Needs ``r, c, density, detected, total`` with the frame's total on each of its rows. What is left
    after the detections follows density by largest remainder; ties go to the higher cell.

    Many frames are best dealt by frame before (``task_parts``): the windows keep that partitioning.
    """
    cell = F.col("r") * 3 + F.col("c")
    frame = Window.partitionBy(*FRAME)
    in_order = frame.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = (
        df.withColumn("_cell", cell)
        .withColumn("_w", F.greatest(F.col("density"), F.lit(0.0)))
        .withColumn("_det", S.half_even(F.greatest(F.col("detected").cast("double"), F.lit(0.0))))
        .withColumn("_wsum", F.sum("_w").over(in_order))
        .withColumn("_dsum", F.sum("_det").over(in_order))
        .withColumn("_cells", F.count(F.lit(1)).over(in_order))
    )
    wanted = F.greatest(F.lit(0).cast("bigint"), S.half_even("total"))
    d = d.withColumn("_rest", F.greatest(wanted, F.col("_dsum")) - F.col("_dsum"))
    share = F.when(F.col("_wsum") > 0, F.col("_w") / F.col("_wsum")).otherwise(1.0 / F.col("_cells"))
    d = d.withColumn("_exact", share * F.col("_rest")).withColumn("_extra", F.floor("_exact"))
    d = d.withColumn("_left", F.col("_rest") - F.sum("_extra").over(in_order))
    rank = F.row_number().over(frame.orderBy((F.col("_exact") - F.col("_extra")).desc(), F.col("_cell").desc()))
    d = d.withColumn("_rank", rank)
    people = F.col("_det") + F.col("_extra") + F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0)
    return d.withColumn("people", people.cast("bigint")).drop(
        "_cell", "_w", "_det", "_wsum", "_dsum", "_cells", "_rest", "_exact", "_extra", "_left", "_rank"
    )


def _box_cells(df: DataFrame, frame_h: int, frame_w: int) -> DataFrame:
    def index(pos, size, extent):
        return S.clamp(F.floor((F.col(pos) + F.col(size) / 2) / extent * 3), 0, 2).cast("int")

    return df.select(*FRAME, index("y", "h", frame_h).alias("r"), index("x", "w", frame_w).alias("c"))


def fuse_closeup(
    zones: DataFrame, faces: DataFrame, pedestrians: DataFrame, face_size, pedestrian_size
) -> DataFrame:
    """Cell = max(density score, faces in it, one if a pedestrian is in it); total likewise.

    Box tables hold ``x, y, w, h`` in images of (height, width) ``face_size`` / ``pedestrian_size``.
    """
    boxes = _box_cells(faces, *face_size).withColumn("_face", F.lit(1)).unionByName(
        _box_cells(pedestrians, *pedestrian_size).withColumn("_face", F.lit(0))
    )
    near = boxes.groupBy(*FRAME, "r", "c").agg(
        F.greatest(F.sum("_face"), F.max(1 - F.col("_face"))).cast("double").alias("_near")
    )
    fused = zones.join(near, FRAME + ["r", "c"], "left").withColumn(
        "score", F.greatest(F.col("score"), F.coalesce("_near", F.lit(0.0)))
    )
    total = F.sum("score").over(Window.partitionBy(*FRAME))
    return fused.withColumn("total", F.greatest(F.col("total"), total)).drop("_near")


def classify_blobs(df: DataFrame, frame_h: int, frame_w: int) -> DataFrame:
    """Vehicle label of contour blobs (``area, bw, bh``) by area and aspect; others are dropped."""
    lo, hi = int(frame_w * frame_h * 0.0002), int(frame_w * frame_h * 0.06)
    aspect = F.when(F.col("bh") > 0, F.col("bw") / F.col("bh")).otherwise(1.0)
    label = (
        F.when(F.col("area") > lo * 6, F.when(aspect > 1.6, "truck").otherwise("bus"))
        .when(aspect > 0.6, "car")
        .otherwise("bike")
    )
    return df.where(F.col("area").between(lo, hi)).withColumn("label", label)


def vehicle_counts(df: DataFrame, capacity: float = 150.0, keep: int | None = None) -> DataFrame:
    """Vehicles per frame by class from ``label``; ``keep`` bounds the listed detections."""
    label = F.col("label")
    out = df.groupBy(*FRAME).agg(
        F.count("label").alias("total_vehicles"),
        F.count_if(label == "car").alias("cars"),
        F.count_if(label == "truck").alias("trucks"),
        F.count_if(label == "bus").alias("buses"),
        F.count_if(label.isin("motorcycle", "bicycle", "bike")).alias("bikes"),
        F.count_if(label == "uav").alias("uavs"),
    )
    total = F.col("total_vehicles")
    listed = total if keep is None else F.least(total, F.lit(keep).cast("bigint"))
    return out.withColumn("listed", listed).withColumn(
        "occupancy_rate", F.least(F.lit(100.0), F.bround(total / capacity * 100, 1))
    )


def listed_detections(df: DataFrame, keep: int = 50) -> DataFrame:
    """The first ``keep`` labelled detections of each frame, in detection order."""
    rank = F.row_number().over(Window.partitionBy(*FRAME).orderBy("det_id"))
    return df.where("label is not null").withColumn("_n", rank).where(F.col("_n") <= keep).drop("_n")


def best_vehicle_source(model: DataFrame, blobs: DataFrame) -> DataFrame:
    """Model counts per frame, replaced by blob counts when the model has under three and blobs more."""
    cols = [c for c in model.columns if c not in FRAME]
    packed = F.struct(*cols)
    both = model.select(*FRAME, F.lit("model").alias("source"), packed.alias("_v")).unionByName(
        blobs.select(*FRAME, F.lit("blobs").alias("source"), packed.alias("_v"))
    )
    pair = both.groupBy(*FRAME).agg(
        F.max_by("_v", F.when(F.col("source") == "model", 1)).alias("_m"),
        F.max_by("_v", F.when(F.col("source") == "blobs", 1)).alias("_b"),
    )
    m, b = F.col("_m.total_vehicles"), F.col("_b.total_vehicles")
    use_blobs = F.col("_m").isNull() | ((m < 3) & F.coalesce(b > m, F.lit(False)))
    chosen = F.when(use_blobs, F.col("_b")).otherwise(F.col("_m"))
    return pair.select(
        *FRAME, F.when(use_blobs, "blobs").otherwise("model").alias("source"), chosen.alias("_v")
    ).select(*FRAME, "source", "_v.*")
