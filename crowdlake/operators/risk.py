"""Composite risk, smoothed pressure and the crowd-risk index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from crowdlake import constants as K
from crowdlake.functions import scalars as S
from crowdlake.operators.history import growth_rate
from crowdlake.operators.scale import Width, chunk_width, with_running
from crowdlake.operators.temporal import CAMERA, ema

ORDER = ["t", "frame_id"]


def peak_growth(
    df: DataFrame, keys: Sequence[str] = CAMERA, order: Sequence[str] = ORDER, width: Width = None
) -> DataFrame:
    """Relative change of the peak against the previous frame, in [0, 1] with 0.5 = unchanged.

    An empty previous frame, or none, counts as unchanged. Also numbers the rows (``rn``).
    """
    before = F.struct(F.col("peak"), F.col("density"))
    d = with_running(
        df, keys, order, {"rn": ("sum", F.lit(1).cast("bigint")), "_last": ("last_before", before)}, order[0], width
    )
    known = (F.col("_last.density") >= K.MIN_CROWD) & (F.col("_last.peak") > 0)
    change = F.when(known, (F.col("peak") - F.col("_last.peak")) / F.col("_last.peak")).otherwise(0.0)
    return d.withColumn("growth_term", (S.clamp(change, -1.0, 1.0) + 1.0) / 2.0).drop("_last")


def composite_risk(df: DataFrame, keys: Sequence[str] = CAMERA, order: Sequence[str] = ORDER) -> DataFrame:
    d = peak_growth(df, keys, order)
    risk = (
        0.4 * S.sat_exp("density", 1200.0)
        + 0.3 * S.sat_ratio("motion", 5.0)
        + 0.2 * S.sat_ratio("turbulence", 3.0)
        + 0.1 * F.col("growth_term")
    )
    return d.withColumn("composite_risk", F.when(F.col("density") < K.MIN_CROWD, 0.0).otherwise(risk))


def pressure(df: DataFrame, keys: Sequence[str] = CAMERA, order: Sequence[str] = ORDER) -> DataFrame:
    """Composite risk and its smoothed percentage, which drops to 0 when the scene empties."""
    d = composite_risk(df, keys, order).withColumn("_pct", F.col("composite_risk") * 100.0)
    return ema(d, "_pct", K.PRESSURE_ALPHA, "pressure", F.col("density") < K.MIN_CROWD, keys, order).drop("_pct", "rn")


def risk_index(df: DataFrame, keys: Sequence[str] = CAMERA, order: Sequence[str] = ORDER) -> DataFrame:
    """Index 0-100 with label, causes and confidence; its average runs over frames with a crowd."""
    present = F.col("density") >= K.MIN_CROWD
    width = chunk_width(df, keys, order[0])
    d = growth_rate(df, "density", 10.0, keys, order[-1], present, width=width)
    d = (
        d.withColumn("density_term", S.sat_exp("density", 1000.0))
        .withColumn("motion_term", S.sat_ratio("motion", 6.0))
        .withColumn("turbulence_term", S.sat_ratio("turbulence", 4.0))
        .withColumn(
            "growth_term",
            F.when(F.col("growth_n") >= 3, (S.clamp(F.col("growth") * 5.0, -1.0, 1.0) + 1.0) / 2.0).otherwise(0.0),
        )
        .withColumn("opposing_term", S.clamp(F.col("opposing") * 2.0, 0.0, 1.0))
    )
    raw = (
        0.40 * F.col("density_term")
        + 0.20 * F.col("motion_term")
        + 0.15 * F.col("turbulence_term")
        + 0.15 * F.col("growth_term")
        + 0.10 * F.col("opposing_term")
    )
    d = ema(d.withColumn("_raw", S.clamp(raw, 0.0, 1.0)), "_raw", K.PRESSURE_ALPHA, "_smooth", None, keys, order, width)
    spread = F.abs(F.col("density_term") - F.col("motion_term")) * 0.05
    sure = F.least(0.85 + 0.01 * F.col("growth_n"), F.lit(0.96)) - spread
    d = (
        d.withColumn("risk_index", F.bround(F.col("_smooth") * 100.0, 1))
        .withColumn("confidence", F.bround(S.clamp(sure, 0.85, 0.98), 2))
        .withColumn(
            "primary_causes",
            S.primary_causes("density_term", "motion_term", "turbulence_term", "growth_term", "opposing_term"),
        )
        .drop("rn", "_raw", "_smooth", "growth", "growth_n")
    )
    empty = df.where(~present).select(
        "*",
        *[F.lit(0.0).alias(c) for c in ("density_term", "motion_term", "turbulence_term", "growth_term", "opposing_term")],
        F.lit(0.0).alias("risk_index"),
        F.lit(1.0).alias("confidence"),
        F.array().cast("array<string>").alias("primary_causes"),
    )
    d = d.unionByName(empty)
    level = S.band("risk_index", (K.INDEX_CUT,), K.TWO_LEVEL_LABELS)
    return d.withColumn("risk_level", level).withColumn("alert", F.col("risk_index") >= K.INDEX_CUT)
