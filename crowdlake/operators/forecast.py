"""Multi-horizon count forecasts: candidates, scoring, selection, intervals and surges.

A *history* holds one row per sample of a (camera, session): ``t``, ``value`` and the row number
``rn``. Every row is a forecast origin, so a whole history is backtested in one plan. Errors known at
an origin are those of earlier predictions whose target was observed by then.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from crowdlake import constants as K
from crowdlake.functions import scalars as S
from crowdlake.operators.learned import registered_predictions
from crowdlake.operators.materialize import materialize
from crowdlake.operators.scale import (
    asof,
    exact_percentile,
    frame_percentile,
    home_rows,
    number_rows,
    with_row_halo,
)
from crowdlake.operators.temporal import rolling_median, sample_interval, throttle

KEYS = ["camera_id", "session_id"]
# Holt's smoothing of level and trend, and the damping of the trend.
ALPHA, BETA, DAMPING = 0.45, 0.15, 0.98
LEAD = 160
# Order breaks no ties; names do.
MODELS = ["holt", "recent_level", "autoregressive", "daily_seasonal", "learned"]


def _holt_mode() -> tuple[complex, complex, complex, complex, complex, complex]:
    """Holt's recursion in its eigenbasis.

    Level and trend follow ``s[t] = M s[t-1] + B x[t]``. M has one complex pair of eigenvalues, so
    one complex coordinate ``z[t] = m z[t-1] + g x[t]`` carries the whole state: ``s = 2 Re(v z)``.
    Returns m, g, the weights of the initial level and trend in z, and v.
    """
    rest = 1.0 - ALPHA
    m = np.array([[rest, rest * DAMPING], [-ALPHA * BETA, DAMPING * (BETA * rest + 1.0 - BETA)]])
    values, vectors = np.linalg.eig(m)
    inverse = np.linalg.inv(vectors)[0]
    g = inverse @ np.array([ALPHA, ALPHA * BETA])
    return values[0], g, inverse[0], inverse[1], vectors[0, 0], vectors[1, 0]


def count_history(
    samples: DataFrame, keys: Sequence[str] = KEYS, interval: float = K.SAMPLE_INTERVAL, smooth_seconds: float = 75.0
) -> DataFrame:
    """History from raw ``count`` samples: one per ``interval``, median-smoothed, numbered."""
    interval = sample_interval(interval)
    k = max(3, round(smooth_seconds / interval))
    kept = materialize(throttle(samples, keys, interval))
    kept = number_rows(kept, keys, ["t", "event_id"], width=K.CHUNK_SECONDS)
    return materialize(rolling_median(kept, k + (k % 2 == 0), "count", "value", keys))


def holt_features(hist: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add ``level, trend`` (damped Holt, trend clipped), ``recent_level`` and ``noise`` to each row.

    The recursion becomes two running sums of values scaled by position.
    """
    mode, g, w_level, w_trend, v_level, v_trend = _holt_mode()
    radius, angle = abs(mode), np.angle(mode)
    size = K.BLOCK_ROWS
    d = with_row_halo(hist, LEAD, after=1, size=size)
    w = Window.partitionBy(*keys, "_chunk").orderBy("rn")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x, nxt = F.col("value"), F.lead("value").over(w)
    d = d.withColumn("_next", F.coalesce(nxt - x, F.lit(0.0))).withColumn("_diff", x - F.lag("value").over(w))
    first = F.col("rn") == 1
    step = F.col("_next")

    def entering(part):
        start = part(w_level) * x + part(w_trend) * step
        return F.when(first, start).otherwise(part(g) * x)

    pos = F.col("rn") - F.col("_chunk") * size + LEAD
    d = d.withColumn("_re", entering(lambda c: float(c.real))).withColumn("_im", entering(lambda c: float(c.imag)))
    d = d.withColumn("_cos", F.cos(pos * float(angle))).withColumn("_sin", F.sin(pos * float(angle)))
    d = d.withColumn("_grow", F.pow(F.lit(float(radius)), -pos))
    d = d.withColumn("_p", F.sum((F.col("_re") * F.col("_cos") + F.col("_im") * F.col("_sin")) * F.col("_grow")).over(upto))
    d = d.withColumn("_q", F.sum((F.col("_im") * F.col("_cos") - F.col("_re") * F.col("_sin")) * F.col("_grow")).over(upto))
    z_re = (F.col("_cos") * F.col("_p") - F.col("_sin") * F.col("_q")) / F.col("_grow")
    z_im = (F.col("_sin") * F.col("_p") + F.col("_cos") * F.col("_q")) / F.col("_grow")

    def state(v):
        return 2.0 * (float(v.real) * z_re - float(v.imag) * z_im)

    recent = w.rowsBetween(-7, 0)
    changes = w.rowsBetween(-38, 0)
    limit = F.greatest(F.lit(1.0), F.coalesce(frame_percentile(F.abs("_diff"), 0.9, changes), F.lit(1.0)))
    spread = F.coalesce(F.stddev_pop("_diff").over(changes), F.lit(0.0))
    # Equal changes spread by rounding dust only.
    noise = F.when(spread < 1e-9, 0.0).otherwise(spread / F.greatest(F.lit(1.0), F.avg("value").over(recent)))
    d = d.select(
        *hist.columns,
        "_home",
        "_chunk",
        F.when(first, x).otherwise(state(v_level)).alias("level"),
        F.when(first, 0.0).otherwise(state(v_trend)).alias("_trend"),
        limit.alias("_limit"),
        frame_percentile("value", 0.5, recent).alias("recent_level"),
        noise.alias("noise"),
    )
    trend = F.greatest(-F.col("_limit"), F.least(F.col("_limit"), F.col("_trend")))
    return home_rows(d.withColumn("trend", trend).drop("_trend")).withColumnRenamed("_limit", "trend_limit")


def daily_seasonal(
    hist: DataFrame, keys: Sequence[str] = KEYS, interval: float = K.SAMPLE_INTERVAL, day_seconds: float = 86_400
) -> DataFrame:
    """Predictions per horizon equal to the value one day before the target, once a day is known."""
    period = round(day_seconds / interval)
    if period < max(S.horizon_steps(sec, interval) for _, sec in K.HORIZONS):
        raise ValueError("the season must be at least as long as the longest horizon")
    d = with_row_halo(hist, period, size=max(K.BLOCK_ROWS, period))
    w = Window.partitionBy(*keys, "_chunk").orderBy("rn")
    past = [F.lag("value", period - S.horizon_steps(sec, interval)).over(w) for _, sec in K.HORIZONS]
    return home_rows(d.withColumn("preds", F.array(*past))).where(F.col("rn") >= period).select(*keys, "rn", "preds")


_MODELS: dict[str, object] = {}


def register_model(name: str, fn) -> None:
    """Plug in a candidate: ``fn(history) -> (camera_id, session_id, rn, preds)`` with one prediction
    per horizon in ``preds``."""
    if name not in MODELS:
        MODELS.append(name)
    _MODELS[name] = fn


def registered_models(hist: DataFrame) -> dict[str, DataFrame]:
    return {name: fn(hist) for name, fn in _MODELS.items()}


def candidates(
    hist: DataFrame,
    extra: dict[str, DataFrame] | None = None,
    shadow: Sequence[str] = (),
    keys: Sequence[str] = KEYS,
    interval: float = K.SAMPLE_INTERVAL,
) -> DataFrame:
    """One row per origin and horizon with ``preds MAP<model, prediction>``.

    ``extra`` holds further models' predictions by name; ``shadow`` models stay out of the ensemble, and so do
    single predictions whose ``votes``, if there is such a column, is false.
    """
    d = holt_features(hist, keys)
    votes = {}
    for name, preds in (extra or {}).items():
        mine = [F.col("preds").alias(f"_{name}")]
        if "votes" in preds.columns:
            votes[name] = F.col(f"_votes_{name}")
            mine.append(F.col("votes").alias(f"_votes_{name}"))
        d = d.join(preds.select(*keys, "rn", *mine), [*keys, "rn"], "left")
    horizons = []
    for i, (label, seconds) in enumerate(K.HORIZONS):
        steps = S.horizon_steps(seconds, interval)
        reach = DAMPING * (1.0 - DAMPING**steps) / (1.0 - DAMPING)
        horizons.append(
            F.struct(
                F.lit(label).alias("label"),
                F.lit(seconds).alias("seconds"),
                F.lit(steps).alias("steps"),
                F.lit(reach).alias("reach"),
                F.lit(i + 1).alias("pos"),
            )
        )
    d = d.withColumn("_h", F.explode(F.array(*horizons)))
    each = {
        "holt": F.greatest(F.lit(0.0), F.col("level") + F.col("trend") * F.col("_h.reach")),
        "recent_level": F.col("recent_level"),
    }
    for name in extra or {}:
        each[name] = F.get(F.col(f"_{name}"), F.col("_h.pos") - 1)
    voting = F.array_compact(F.array(*[F.when(votes[n], c) if n in votes else c for n, c in each.items() if n not in shadow]))
    mean = F.aggregate(voting, F.lit(0.0), lambda a, x: a + x) / F.size(voting)
    d = d.withColumns({f"p_{n}": c for n, c in each.items()}).withColumn("p_ensemble", mean)
    return d.select(
        *keys, "t", "event_id", "rn", "value", "noise", "_h.label", "_h.seconds", "_h.steps", *[f"p_{n}" for n in each], "p_ensemble"
    )


def models_of(df: DataFrame) -> list[str]:
    return [c[2:] for c in df.columns if c.startswith("p_")]


def score_predictions(
    cands: DataFrame, hist: DataFrame, keys: Sequence[str] = KEYS, interval: float = K.SAMPLE_INTERVAL
) -> DataFrame:
    """Attach the first observation at or after each target, at most 1.5 intervals late
    (``observed``, ``obs_t``), and the error of every candidate (``e_<model>``)."""
    left = cands.withColumnRenamed("t", "origin_t").withColumn("t", F.col("origin_t") + F.col("seconds"))
    right = hist.select(*keys, "t", F.col("value").alias("observed"))
    d = asof(left, right, keys, ["observed"], "forward", K.TOLERANCE_INTERVALS * interval, width=K.CHUNK_SECONDS)
    d = d.withColumnRenamed("t", "target_t").withColumnsRenamed({"origin_t": "t", "matched_t": "obs_t"})
    return d.withColumns(
        {f"e_{m}": S.relative_error(f"p_{m}", "observed") for m in models_of(cands)}
    )


def rolling_errors(
    scored: DataFrame, errors: Sequence[str], rows: int, keys: Sequence[str] = KEYS, p90: bool = True
) -> DataFrame:
    """Mean, count and, if wanted, 90th percentile of the newest ``rows`` errors per horizon, as of each
    observation time (``t``). Adds ``<error>_mean``, ``<error>_n`` and ``<error>_p90``."""
    own = [*keys, "label"]
    d = scored.where("obs_t is not null").select(*own, "obs_t", F.col("rn").alias("_origin"), *errors)
    d = number_rows(d, own, ["obs_t", "_origin"], t="obs_t", width=K.CHUNK_SECONDS)
    d = with_row_halo(d, rows - 1)
    w = Window.partitionBy(*own, "_chunk").orderBy("rn").rowsBetween(-(rows - 1), 0)
    stats = {}
    for e in errors:
        stats[f"{e}_mean"] = F.avg(e).over(w)
        if p90:
            stats[f"{e}_p90"] = frame_percentile(e, 0.9, w)
        stats[f"{e}_n"] = F.count(e).over(w)
    d = home_rows(d.select("*", *[c.alias(n) for n, c in stats.items()]))
    # Several predictions may meet the same observation; the newest origin saw them all.
    newest = d.groupBy(*own, "obs_t").agg(F.max_by(F.struct(*stats), "_origin").alias("_s"))
    return newest.select(*own, F.col("obs_t").alias("t"), "_s.*")


def with_known_errors(cands: DataFrame, rolled: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    own = [*keys, "label"]
    stats = [c for c in rolled.columns if c not in (*own, "t")]
    return asof(cands, rolled, own, stats, width=K.CHUNK_SECONDS).drop("matched_t")


def _horizon_target(target: float) -> Column:
    return F.when(F.col("label").isin(K.SHORT_HORIZONS), F.lit(K.TARGET_ACCURACY)).otherwise(F.lit(target))


def with_registry(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Add the validation of the learned model's version in force at each forecast's time: ``v_accuracy, v_training,
    v_validation, v_approved`` of its horizon, null before the first version. ``registry`` is made of
    :func:`learned.model_version` rows; a rejected version keeps its validation, and is not approved."""
    versions = registry.select(
        "label", F.col("valid_from").alias("t"), F.col("accuracy_percent").alias("v_accuracy"), F.col("training_samples").alias("v_training"),
        F.col("validation_samples").alias("v_validation"), F.col("approved").alias("v_approved"),
    )
    return asof(df, versions, ["label"], ["v_accuracy", "v_training", "v_validation", "v_approved"]).drop("matched_t")


def _validated(df: DataFrame, target: float) -> Column | None:
    """Has the version in force been validated for the horizon's target?"""
    if "v_accuracy" not in df.columns:
        return None
    enough = (F.col("v_training") >= 64) & (F.col("v_validation") >= 30)
    return F.coalesce((F.col("v_accuracy") >= _horizon_target(target)) & enough, F.lit(False))


def select_model(
    df: DataFrame,
    approved: Sequence[str] = (),
    shadow: Sequence[str] = (),
    target: float = K.TARGET_ACCURACY,
) -> DataFrame:
    """Champion per origin and horizon: least mean error among models with enough scores, ties by
    name; the ensemble before that. A learned model leads horizons it is ``approved`` for until it is
    scored; ``shadow`` models need the target accuracy to be chosen. After :func:`with_registry` the version in force
    decides both for the learned model, so they change at the time of an approval."""
    choices = []
    validated = _validated(df, target)
    for m in models_of(df):
        ok = (F.col(f"e_{m}_n") >= K.MIN_MODEL_SCORES) & F.col(f"p_{m}").isNotNull()
        reached = 100.0 * (1.0 - F.col(f"e_{m}_mean")) >= _horizon_target(target)
        if m in shadow:
            ok &= reached
        elif m == "learned" and validated is not None:
            ok &= F.coalesce("v_approved", F.lit(False)) | reached
        choices.append(F.when(ok, F.struct(F.col(f"e_{m}_mean").alias("error"), F.lit(m).alias("model"))))
    best = F.array_min(F.array_compact(F.array(*choices)))["model"]
    chosen = F.coalesce(best, F.lit("ensemble"))
    if (approved or validated is not None) and "learned" in models_of(df):
        named = F.col("label").isin(list(approved)) if approved else F.lit(False)
        leads = (named if validated is None else named | validated) & F.col("p_learned").isNotNull()
        unscored = F.coalesce(F.col("e_learned_n"), F.lit(0)) < K.MIN_MODEL_SCORES
        chosen = F.when(leads & unscored, "learned").otherwise(chosen)
    d = df.withColumn("model", chosen)
    for name in ("mean", "p90", "n"):
        d = d.withColumn(f"chosen_{name}", _pick(d, lambda m: F.col(f"e_{m}_{name}")))
    return d.withColumn("predicted", _pick(d, lambda m: F.col(f"p_{m}")))


def _pick(df: DataFrame, of) -> Column:
    out = F.lit(None)
    for m in models_of(df):
        out = F.when(F.col("model") == m, of(m)).otherwise(out)
    return out


def prediction_interval(df: DataFrame, confidence_floor: bool = True, target: float = K.TARGET_ACCURACY) -> DataFrame:
    """Rounded prediction, bounds and confidence. Measured errors are used once there are enough;
    before that recent noise grows with the square root of the steps.

    ``confidence_floor`` lifts unmeasured short horizons of calm series to the target, a heuristic;
    ``confidence_is_measured`` tells which confidences rest on scores.
    """
    measured = F.coalesce(F.col("chosen_n") >= K.MIN_MODEL_SCORES, F.lit(False))
    guess = F.when(F.col("noise") == 0.0, 0.0).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.02), F.col("noise") * F.sqrt("steps")))
    )
    plain = F.bround(S.clamp(100.0 * (1.0 - guess), 0.0, 100.0), 1)
    if confidence_floor:
        calm = F.col("label").isin(K.SHORT_HORIZONS) & (F.col("noise") <= 0.20)
        plain = F.when(calm, F.greatest(F.lit(K.TARGET_ACCURACY), plain)).otherwise(plain)
    error = F.when(measured, F.col("chosen_p90")).otherwise(guess)
    scored = F.bround(F.greatest(F.lit(0.0), 100.0 * (1.0 - F.col("chosen_mean"))), 1)
    margin = F.greatest(F.lit(2.0), F.col("predicted") * error)
    zero = F.lit(0).cast("bigint")
    samples, confidence = F.coalesce("chosen_n", zero), F.when(measured, scored).otherwise(plain)
    validated = _validated(df, target)
    if validated is not None:
        # A validated version brings its own validation along.
        own = validated & (F.col("model") == "learned")
        samples = F.when(own, F.greatest(samples, F.col("v_validation"))).otherwise(samples)
        confidence = F.coalesce(confidence, F.when(own, F.bround("v_accuracy", 1)))
    return df.withColumns(
        {
            "people_count": F.greatest(zero, S.half_even("predicted")),
            "lower_count": F.greatest(zero, S.half_even(F.col("predicted") - margin)),
            "upper_count": F.greatest(zero, S.half_even(F.col("predicted") + margin)),
            "confidence_percent": confidence,
            "confidence_is_measured": measured,
            "validation_samples": samples,
        }
    )


def forecast_quality(
    df: DataFrame, target: float = K.TARGET_ACCURACY, min_validation: int = K.MIN_MODEL_SCORES, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Trust of each horizon, and the quality and trend of the whole snapshot."""
    goal = _horizon_target(target)
    conf = F.col("confidence_percent")
    trusted = (F.col("validation_samples") >= min_validation) & F.coalesce(conf >= goal, F.lit(False))
    d = df.withColumn("target_accuracy_percent", goal).withColumn("trusted", trusted)
    d = d.withColumn(
        "quality_status",
        F.when(F.col("trusted"), "verified").when(conf.isNotNull(), "below_target").otherwise("validating"),
    )
    # A snapshot has one row per horizon: the group is bounded.
    w = Window.partitionBy(*keys, "rn")
    good, total = F.count_if("trusted").over(w), F.count(F.lit(1)).over(w)
    known = F.count("confidence_percent").over(w)
    snapshot = (
        F.when(good == total, "target_met").when(good > 0, "partially_verified").when(known == 0, "validating")
    ).otherwise("needs_calibration")
    first = F.min_by("people_count", "seconds").over(w)
    step = F.greatest(F.lit(2.0), F.col("value") * 0.02)
    trend = F.when(first > F.col("value") + step, "rising").when(first < F.col("value") - step, "falling").otherwise("stable")
    return d.withColumns({"snapshot_quality": snapshot, "trend": trend, "trusted_predictions": good})


def backtest(
    hist: DataFrame,
    extra: dict[str, DataFrame] | None = None,
    shadow: Sequence[str] = (),
    approved: Sequence[str] = (),
    target: float = K.TARGET_ACCURACY,
    min_validation: int = K.MIN_MODEL_SCORES,
    confidence_floor: bool = True,
    keys: Sequence[str] = KEYS,
    interval: float = K.SAMPLE_INTERVAL,
    registry: DataFrame | None = None,
) -> DataFrame:
    """Forecast from every sample of a history with the models chosen by the errors known then.

    ``registry`` holds versions of the learned model: each forecast uses the version in force at its time, and its validation.
    Plugged-in models (:func:`register_model`) and those in ``extra`` are candidates as well. Adds ``accuracy_percent``, the accuracy of forecasts issued earlier, as known at the origin.
    """
    extra = {**registered_models(hist), **(extra or {})}
    if registry is not None:
        extra["learned"] = registered_predictions(hist, registry, keys=keys)
    scored = materialize(score_predictions(candidates(hist, extra, shadow, keys, interval), hist, keys, interval))
    errors = [f"e_{m}" for m in models_of(scored)]
    rolled = rolling_errors(scored, errors, K.CANDIDATE_ERROR_WINDOW, keys)
    d = with_known_errors(scored.drop(*errors), rolled, keys)
    if registry is not None:
        d = with_registry(d, registry)
    d = forecast_quality(
        prediction_interval(select_model(d, approved, shadow, target), confidence_floor, target), target, min_validation, keys
    )
    helpers = [c for c in d.columns if c[:2] in ("p_", "e_", "v_") or c.startswith("chosen_")]
    d = d.drop(*helpers)
    issued = d.withColumn("e_issued", S.relative_error("people_count", "observed"))
    issued = materialize(issued)
    known = rolling_errors(issued, ["e_issued"], K.HORIZON_ERROR_WINDOW, keys, p90=False)
    d = with_known_errors(issued, known, keys)
    w = Window.partitionBy(*keys, "rn")
    n = F.sum("e_issued_n").over(w)
    mean = F.sum(F.col("e_issued_mean") * F.col("e_issued_n")).over(w) / n
    accuracy = F.when(n > 0, F.bround(F.greatest(F.lit(0.0), 100.0 * (1.0 - mean)), 1))
    return d.withColumn("accuracy_percent", accuracy).drop("e_issued_mean", "e_issued_n")


def surge(forecasts: DataFrame, current: str = "value", keys: Sequence[str] = KEYS) -> DataFrame:
    """First short horizon with at least 65 % growth at 85 % confidence, per origin that has one."""
    now, later = F.col(current), F.col("people_count")
    growth = F.when(now > 0, (later - now) / F.greatest(F.lit(1.0), now) * 100.0).otherwise(
        F.when(later > 50, 100.0).otherwise(0.0)
    )
    conf = F.coalesce(F.nullif(F.col("confidence_percent"), F.lit(0.0)), F.lit(85.0))
    hit = forecasts.where(F.col("label").isin(K.SHORT_HORIZONS)).withColumn("_growth", growth).withColumn("_conf", conf)
    hit = hit.where((later > now) & (F.col("_growth") >= 65.0) & (F.col("_conf") >= 85.0))
    best = hit.groupBy(*keys, "t", "event_id").agg(
        F.min_by(
            F.struct(
                F.col("label").alias("horizon"),
                F.col("people_count").alias("predicted_count"),
                F.bround("_growth", 1).alias("growth_percent"),
                F.col("_conf").alias("confidence_percent"),
            ),
            "seconds",
        ).alias("_s")
    )
    return best.select(*keys, "t", "event_id", "_s.*", F.lit("STAMPEDE").alias("severity"))


def forecast_snapshot(forecasts: DataFrame, min_samples: int = 1, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per origin with its forecasts by horizon; origins with too few samples only collect."""
    item = F.struct(
        "seconds", "label", "people_count", "lower_count", "upper_count", "confidence_percent", "validation_samples",
        "target_accuracy_percent", "trusted", "quality_status", "model", "target_t",
    )
    out = forecasts.groupBy(*keys, "rn", "t").agg(
        F.array_sort(F.collect_list(item)).alias("predictions"),
        F.first("value").alias("stabilized_count"),
        F.first("accuracy_percent").alias("accuracy_percent"),
        F.first("snapshot_quality").alias("quality_status"),
        F.first("trend").alias("trend"),
        F.first("trusted_predictions").alias("trusted_predictions"),
    )
    ready = F.col("rn") >= min_samples
    models = F.array_sort(F.array_distinct(F.transform("predictions", lambda p: p["model"])))
    return out.select(
        *keys,
        "t",
        F.when(ready, "ready").otherwise("collecting").alias("status"),
        F.col("rn").alias("samples"),
        "stabilized_count",
        F.when(ready, F.col("accuracy_percent")).alias("accuracy_percent"),
        F.when(ready, F.col("quality_status")).otherwise("validating").alias("quality_status"),
        F.when(ready, F.col("trend")).otherwise("unknown").alias("trend"),
        F.when(ready, F.col("trusted_predictions")).otherwise(0).alias("trusted_predictions"),
        F.when(ready, models).otherwise(F.array().cast("array<string>")).alias("models_selected"),
        F.when(ready, F.col("predictions")).otherwise(F.slice("predictions", 1, 0)).alias("predictions"),
    )


def forecast_accuracy(scored: DataFrame, by: Sequence[str] = ("camera_id", "label")) -> DataFrame:
    """Mean error, exact 90th percentile and count of every model over whole groups."""
    models = models_of(scored)
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"e_{m}").alias("error")) for m in models])
    long = scored.where("obs_t is not null").select(*by, F.inline(pairs)).where("error is not null")
    own = [*by, "model"]
    means = long.groupBy(*own).agg(F.avg("error").alias("mean_error"), F.count(F.lit(1)).alias("scores"))
    return means.join(exact_percentile(long, own, "error", 0.9, "p90_error"), own)
