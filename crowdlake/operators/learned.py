"""Learned forecaster: windows to supervised examples, one regression per horizon, approval gate."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from crowdlake import constants as K
from crowdlake.functions import scalars as S
from crowdlake.operators.materialize import materialize
from crowdlake.operators.scale import asof, home_rows, number_rows, with_row_halo
from crowdlake.operators.temporal import sessionize_gaps

WINDOW = 20
RUN = ["camera_id", "session_id", "run_id"]


def _encoded(values: Column) -> dict[str, Column]:
    """Centre, scale and features of a window of counts (oldest first)."""
    logs = F.transform(values, lambda v: F.log1p(F.greatest(v, F.lit(0.0))))
    n = F.size(logs)
    mean = F.aggregate(logs, F.lit(0.0), lambda a, v: a + v) / n
    spread = F.sqrt(F.aggregate(logs, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n)
    return {"logs": logs, "centre": F.element_at(logs, -1), "scale": F.greatest(F.lit(0.05), spread)}


def _with_windows(d: DataFrame, w, window: int) -> DataFrame:
    d = d.withColumn("_values", F.collect_list("value").over(w.rowsBetween(-(window - 1), 0)))
    d = d.where(F.size("_values") == window)
    enc = _encoded(F.col("_values"))
    d = d.withColumn("_logs", enc["logs"]).withColumn("centre", enc["centre"]).withColumn("scale", enc["scale"])
    relative = F.transform("_logs", lambda v: (v - F.col("centre")) / F.col("scale"))
    return d.withColumn("features", F.concat(relative, F.array(F.col("centre") / 10.0))).drop("_values", "_logs")


def runs(hist: DataFrame, interval: float = K.SAMPLE_INTERVAL) -> DataFrame:
    """Histories cut at gaps over 1.5 intervals, with the row number ``pos`` in each run and its length."""
    keys = ["camera_id", "session_id"]
    d = sessionize_gaps(hist, interval * K.TOLERANCE_INTERVALS, keys)
    d = number_rows(d, RUN, ["t", "event_id"], name="pos", width=K.CHUNK_SECONDS)
    return d.join(d.groupBy(*RUN).agg(F.count(F.lit(1)).alias("run_rows")), RUN)


def training_set(
    hist: DataFrame, window: int = WINDOW, interval: float = K.SAMPLE_INTERVAL, horizons: Sequence[tuple[str, int]] = tuple(K.HORIZONS)
) -> DataFrame:
    """One row per usable example: ``features``, ``targets`` (null where masked), ``centre``, ``scale``
    and whether it is held out. The last fifth of every run validates; training targets end before it."""
    steps = [S.horizon_steps(sec, interval) for _, sec in horizons]
    d = with_row_halo(runs(hist, interval), window - 1, after=max(steps), rn="pos")
    w = Window.partitionBy(*RUN, "_chunk").orderBy("pos")
    d = d.withColumn("_ahead", F.array(*[F.lead("value", s).over(w) for s in steps]))
    d = home_rows(_with_windows(d, w, window))
    split = F.greatest(F.lit(window + 1), F.floor(F.col("run_rows") * 0.8))
    d = d.withColumn("split", split)
    held = F.col("pos") >= F.col("split")
    d = d.withColumn("held_out", held).where(F.col("pos") < F.col("run_rows"))
    limit = F.when(F.col("held_out"), F.col("run_rows")).otherwise(F.col("split"))
    targets = [
        F.when(
            F.col("pos") + s <= limit, (F.log1p(F.get(F.col("_ahead"), F.lit(i))) - F.col("centre")) / F.col("scale")
        )
        for i, s in enumerate(steps)
    ]
    d = d.withColumn("targets", F.array(*targets)).drop("_ahead")
    return d.where(F.size(F.array_compact("targets")) > 0)


def decode(normalized: Column, centre: Column, scale: Column) -> Column:
    logged = F.greatest(F.lit(0.0), F.least(F.lit(20.0), centre + normalized * scale))
    return F.greatest(F.lit(0.0), F.expm1(logged))


def gram(examples: DataFrame, horizons: Sequence[tuple[str, int]] = tuple(K.HORIZONS)) -> DataFrame:
    """Sums of products of (1, features, target) over the unmasked training examples of every horizon:
    ``(horizon, entry, total)`` with ``entry`` counting the square matrix row by row.

    One pass serves all horizons. Tasks add up their batches, so the exchange holds one matrix a task and horizon.
    """
    train = examples.where("not held_out").select("features", "targets")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if not len(b):
                continue
            x = np.array(b["features"].tolist(), float)
            y = np.array([[np.nan if v is None else v for v in row] for row in b["targets"]], float)
            ones = np.ones((len(x), 1))
            mine = []
            for i in range(y.shape[1]):
                seen = ~np.isnan(y[:, i])
                z = np.hstack([ones, x, y[:, i : i + 1]])[seen]
                mine.append((z.T @ z).ravel())
            total = np.array(mine) if total is None else total + np.array(mine)
        if total is not None:
            h, e = np.indices(total.shape)
            yield pd.DataFrame({"horizon": h.ravel() + 1, "entry": e.ravel(), "total": total.ravel()})

    parts = train.mapInPandas(partial, "horizon int, entry int, total double")
    return parts.groupBy("horizon", "entry").agg(F.sum("total").alias("total"))


def _eliminated(matrix: Column, size: int) -> Column:
    """Gauss-Jordan elimination of an augmented matrix as a fold over its pivots. The matrices are positive definite
    but for constant features, whose pivots are 0 and whose weights become 0."""

    def pivot(m: Column, k: Column) -> Column:
        row = F.get(m, k)
        lead = F.get(row, k)
        unit = F.transform(row, lambda v: F.when(lead > 1e-12, v / lead).otherwise(0.0))
        return F.transform(
            m, lambda r, i: F.when(i == k, unit).otherwise(F.zip_with(r, unit, lambda a, b: a - F.get(r, k) * b))
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), matrix, pivot)


def fit_learned(
    examples: DataFrame, horizons: Sequence[tuple[str, int]] = tuple(K.HORIZONS), penalty: float = 0.05, window: int = WINDOW
) -> DataFrame:
    """One regression per horizon on its unmasked training examples: ``label, weights, intercept,
    training_samples``; horizons without examples are left out.

    A ridge on standardized features: the penalty adds that share to every feature's variance. All horizons
    are solved from one pass over the examples.
    """
    size, side = window + 1, window + 3
    sums = F.transform(F.array_sort(F.collect_list(F.struct("entry", "total"))), lambda e: e["total"])
    d = gram(examples, horizons).groupBy("horizon").agg(sums.alias("g")).withColumn("n", F.get("g", F.lit(0))).where("n > 0")
    at = lambda r, c: F.get(F.col("g"), r * side + c) / F.col("n")
    index = F.sequence(F.lit(1), F.lit(size))
    cov = lambda r, c: at(r, c) - at(F.lit(0), r) * at(F.lit(0), c)
    y = F.lit(size + 1)
    rows = F.transform(
        index,
        lambda r: F.concat(
            F.transform(index, lambda c: cov(r, c) * F.when(r == c, 1.0 + penalty).otherwise(1.0)), F.array(cov(r, y))
        ),
    )
    solved = F.transform(_eliminated(rows, size), lambda r: F.get(r, F.lit(size)))
    d = d.withColumn("weights", solved).withColumn("_means", F.transform(index, lambda r: at(F.lit(0), r)))
    products = F.zip_with("weights", "_means", lambda a, b: a * b)
    labels = F.array(*[F.lit(label) for label, _ in horizons])
    return d.select(
        F.element_at(labels, F.col("horizon")).alias("label"),
        "weights",
        (at(F.lit(0), y) - F.aggregate(products, F.lit(0.0), lambda a, v: a + v)).alias("intercept"),
        F.col("n").cast("bigint").alias("training_samples"),
    )


def _apply(models: DataFrame, horizons) -> list[Column]:
    """Predicted counts per horizon as expressions: a dot product with each model's weights.

    The few numbers of the models (one row per horizon) become literals.
    """
    fitted = {r["label"]: r for r in models.collect()}
    out = []
    for label, _ in horizons:
        model = fitted.get(label)
        if model is None or model["weights"] is None:
            out.append(F.lit(None).cast("double"))
            continue
        out.append(_predicted(F.array(*[F.lit(float(c)) for c in model["weights"]]), F.lit(float(model["intercept"]))))
    return out


def _predicted(weights: Column, intercept: Column) -> Column:
    dot = F.aggregate(F.zip_with("features", weights, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return decode(dot + intercept, F.col("centre"), F.col("scale"))


def score_learned(
    examples: DataFrame, models: DataFrame, horizons: Sequence[tuple[str, int]] = tuple(K.HORIZONS)
) -> DataFrame:
    """Held-out accuracy (null without held-out examples) and example counts: one row per horizon, always."""
    stats = []
    for i, ((label, _), pred) in enumerate(zip(horizons, _apply(models, horizons), strict=True)):
        target = F.get(F.col("targets"), F.lit(i))
        actual = decode(target, F.col("centre"), F.col("scale"))
        error = F.least(F.lit(1.0), F.abs(pred - actual) / F.greatest(F.lit(1.0), actual))
        held = F.col("held_out") & target.isNotNull()
        stats.append(
            F.struct(
                F.lit(label).alias("label"),
                (100.0 * (1.0 - F.avg(F.when(held, error)))).alias("accuracy_percent"),
                F.count_if(held).alias("validation_samples"),
                F.count_if(~F.col("held_out") & target.isNotNull()).alias("training_samples"),
            )
        )
    # A global aggregate has a row even of no examples.
    return examples.agg(F.array(*stats).alias("m")).select(F.inline("m"))


def approve_model(metrics: DataFrame, target: float = K.TARGET_ACCURACY, min_validation: int = 30) -> DataFrame:
    """One row: approved if every horizon with enough held-out examples meets the target and at least
    one has enough; otherwise the model runs in the shadow."""
    enough = (F.col("validation_samples") >= min_validation) & F.col("accuracy_percent").isNotNull()
    fits = F.bool_and(F.when(enough, F.col("accuracy_percent") >= target))
    return metrics.agg(
        F.coalesce(fits, F.lit(False)).alias("approved"),
        F.count_if(enough).alias("evaluated_horizons"),
    ).withColumn("status", F.when(F.col("approved"), "active").otherwise("shadow validation"))


def approved_horizons(metrics: DataFrame, target: float = K.TARGET_ACCURACY) -> DataFrame:
    return metrics.where(
        (F.col("accuracy_percent") >= target) & (F.col("training_samples") >= 64) & (F.col("validation_samples") >= 30)
    ).select("label")


def learned_predictions(
    hist: DataFrame,
    models: DataFrame,
    window: int = WINDOW,
    keys: Sequence[str] = ("camera_id", "session_id"),
    horizons: Sequence[tuple[str, int]] = tuple(K.HORIZONS),
) -> DataFrame:
    """``(keys, rn, preds)`` for every origin with a full window, as a forecast candidate."""
    d = with_row_halo(hist, window - 1)
    d = _with_windows(d, Window.partitionBy(*keys, "_chunk").orderBy("rn"), window)
    return home_rows(d).withColumn("preds", F.array(*_apply(models, horizons))).select(*keys, "rn", "preds")


# --- versions --------------------------------------------------------------------------------


def model_version(
    hist: DataFrame,
    version: int,
    valid_from: float,
    window: int = WINDOW,
    interval: float = K.SAMPLE_INTERVAL,
    horizons: Sequence[tuple[str, int]] = tuple(K.HORIZONS),
    target: float = K.TARGET_ACCURACY,
    min_validation: int = 30,
) -> DataFrame:
    """Registry rows of a model fitted and validated on the samples before ``valid_from``, from when it is in force: one per
    horizon with its validation, its weights (null without examples) and whether the version as a whole is approved."""
    examples = materialize(training_set(hist.where(F.col("t") < valid_from), window, interval, horizons))
    models = materialize(fit_learned(examples, horizons, window=window))
    metrics = materialize(score_learned(examples, models, horizons))
    approved = approve_model(metrics, target, min_validation).select("approved").scalar()
    return metrics.join(models.select("label", "weights", "intercept"), "label", "left").select(
        F.lit(version).alias("version"), F.lit(float(valid_from)).alias("valid_from"), "label", "weights", "intercept",
        "accuracy_percent", "training_samples", "validation_samples", approved.alias("approved"),
    )


def registered_predictions(
    hist: DataFrame,
    registry: DataFrame,
    window: int = WINDOW,
    keys: Sequence[str] = ("camera_id", "session_id"),
    horizons: Sequence[tuple[str, int]] = tuple(K.HORIZONS),
) -> DataFrame:
    """``(keys, rn, preds, votes)`` by the version in force at each origin, as a forecast candidate. Only an approved version
    votes in the ensemble. Origins before the first version have no predictions."""
    item = F.struct("label", F.struct("weights", "intercept").alias("m"))
    versions = registry.groupBy(F.col("valid_from").alias("t"), "version").agg(
        F.map_from_entries(F.collect_list(item)).alias("models"), F.bool_or("approved").alias("votes")
    )
    d = with_row_halo(hist, window - 1)
    d = home_rows(_with_windows(d, Window.partitionBy(*keys, "_chunk").orderBy("rn"), window))
    d = asof(d, versions, [], ["models", "votes"])
    preds = []
    for label, _ in horizons:
        m = F.try_element_at("models", F.lit(label))
        preds.append(F.when(m["weights"].isNotNull(), _predicted(m["weights"], m["intercept"])))
    return d.select(*keys, "rn", F.array(*preds).alias("preds"), F.coalesce("votes", F.lit(False)).alias("votes"))
