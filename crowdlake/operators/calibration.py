"""Count calibration from verified labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from crowdlake.functions import scalars as S
from crowdlake.operators.materialize import materialize
from crowdlake.operators.scale import number_rows


def _usable() -> Column:
    def ok(name):
        x = F.col(name)
        return x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x != float("inf"))

    return ok("predicted_count") & ok("actual_count")


def _fit(cond: Column) -> tuple[Column, Column, Column]:
    """Least-squares scale (not below 0), bias and sample count over rows where ``cond`` holds.

    Equal predictions have no unique line; then the one of least norm is used.
    """
    x, y = F.when(cond, F.col("predicted_count")), F.when(cond, F.col("actual_count"))
    mx, my = F.avg(x), F.avg(y)
    flat = F.max(x) == F.min(x)
    scale = F.when(flat, mx * my / (mx * mx + 1.0)).otherwise(F.regr_slope(y, x))
    bias = F.when(flat, my / (mx * mx + 1.0)).otherwise(F.regr_intercept(y, x))
    return F.greatest(F.lit(0.0), scale), bias, F.count(x)


def fit_calibration(labels: DataFrame, by: Sequence[str] = ("camera_id",)) -> DataFrame:
    """``scale`` and ``bias`` per group with at least three usable samples."""
    scale, bias, n = _fit(_usable())
    out = labels.groupBy(*by).agg(scale.alias("scale"), bias.alias("bias"), n.alias("samples"))
    return out.where("samples >= 3")


def pct_error(predicted, actual) -> Column:
    return F.abs(S._c(predicted) - S._c(actual)) / F.greatest(S._c(actual), F.lit(1.0))


def accuracy_of(mean_error: Column) -> Column:
    return F.when(mean_error * 100.0 < 1e-10, 100.0).otherwise(S.clamp(100.0 - mean_error * 100.0, 0.0, 100.0))


def count_accuracy(df: DataFrame, by: Sequence[str] = ("camera_id",)) -> DataFrame:
    """Bounded accuracy from the mean absolute percentage error; empty scenes divide by one."""
    return df.where(F.col("actual_count") >= 0).groupBy(*by).agg(
        accuracy_of(F.avg(pct_error("predicted_count", "actual_count"))).alias("accuracy_percent"),
        F.count(F.lit(1)).alias("samples"),
    )


def validate_calibration(
    labels: DataFrame,
    target: float = 90.0,
    order: Sequence[str] = ("sample_no", "predicted_count", "actual_count"),
) -> DataFrame:
    """Calibration profile per camera, validated on every fifth sample of each angle (its last one if
    it has under five). Cameras with under 10 samples or 3 training samples are left out."""
    by_angle = ["camera_id", "angle"]
    d = number_rows(labels.where(_usable()), by_angle, list(order), t=order[0])
    sizes = d.groupBy(*by_angle).agg(F.count(F.lit(1)).alias("_size"))
    d = d.join(sizes, by_angle)
    held = F.when(F.col("_size") < 5, F.col("rn") == F.col("_size")).otherwise(F.col("rn") % 5 == 0)
    d = materialize(d.withColumn("_held", held))
    ts, tb, tn = _fit(~F.col("_held"))
    s, b, n = _fit(F.lit(True))
    fits = d.groupBy("camera_id").agg(
        ts.alias("_ts"), tb.alias("_tb"), tn.alias("_tn"), s.alias("_s"), b.alias("_b"), n.alias("sample_count")
    )
    fits = fits.where("sample_count >= 10 and _tn >= 3")
    checked = d.where("_held").join(fits.select("camera_id", "_ts", "_tb"), "camera_id")
    estimate = S.apply_calibration("predicted_count", "_ts", "_tb")
    # Sums per angle are enough for both the angle's and the camera's accuracy.
    angles = checked.groupBy(*by_angle).agg(
        F.sum(pct_error(estimate, "actual_count")).alias("_e"), F.count(F.lit(1)).alias("_n")
    )
    angles = angles.withColumn("_acc", F.bround(accuracy_of(F.col("_e") / F.col("_n")), 2))
    per_camera = angles.groupBy("camera_id").agg(
        accuracy_of(F.sum("_e") / F.sum("_n")).alias("_overall"),
        F.min("_acc").alias("_worst"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("angle", "_acc")))).alias("accuracy_by_angle"),
    )
    return fits.join(per_camera, "camera_id").select(
        "camera_id",
        F.bround("_s", 8).alias("scale"),
        F.bround("_b", 8).alias("bias"),
        F.bround("_overall", 2).alias("validated_accuracy_percent"),
        F.lit(float(target)).alias("target_accuracy_percent"),
        ((F.col("_overall") >= target) & (F.col("_worst") >= target)).alias("target_met"),
        "accuracy_by_angle",
        "sample_count",
    )


def with_calibration(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """Add the camera's ``scale`` and ``bias``, else those of ``default``, else 1 and 0."""
    own = profiles.select(F.lower("camera_id").alias("_k"), F.col("scale").alias("_s"), F.col("bias").alias("_b"))
    # At most one row carries the default profile, so it travels as a scalar.
    fallback = profiles.where(F.lower("camera_id") == "default").agg(F.max(F.struct("scale", "bias"))).scalar()
    d = df.join(own, F.lower(F.trim("camera_id")) == F.col("_k"), "left").withColumn("_d", fallback)
    found = F.col("_k").isNotNull()
    return (
        d.withColumn("scale", F.coalesce(F.when(found, F.col("_s")).otherwise(F.col("_d.scale")), F.lit(1.0)))
        .withColumn("bias", F.coalesce(F.when(found, F.col("_b")).otherwise(F.col("_d.bias")), F.lit(0.0)))
        .drop("_k", "_s", "_b", "_d")
    )


def pick_calibration_rows(hist: DataFrame, n: int = 60) -> DataFrame:
    """Middle row of every source by time, then ``n`` rows evenly spaced by count.

    ``hist`` holds ``source, second, count`` and an ``event_id`` for ties.
    """
    d = number_rows(hist, ["source"], ["second", "event_id"], t="second")
    sizes = hist.groupBy("source").agg(F.count(F.lit(1)).alias("_size"))
    middle = d.join(sizes, "source").where(F.col("rn") == F.floor(F.col("_size") / 2) + 1).drop("rn", "_size")
    # One row per source is left.
    middle = materialize(middle)
    ranked = number_rows(middle, [], ["count", "source"], t="count", name="rank")
    m = middle.agg(F.count(F.lit(1)).alias("m"))
    spread = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: S.half_even(i * (F.col("m") - 1) / F.lit(float(max(1, n - 1)))) + 1,
    )
    all_rows = F.sequence(F.lit(1).cast("bigint"), F.greatest("m", F.lit(1)).cast("bigint"))
    picks = m.select(F.posexplode(F.when(F.col("m") <= n, all_rows).otherwise(spread)).alias("pick", "rank"))
    return ranked.join(picks, "rank").drop("rank")
