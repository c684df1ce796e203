"""Forecasters without a SQL check, against brute force on small histories."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdlake.constants import HORIZONS
from crowdlake.operators import autoregressive as AR, forecast as X, learned as N, materialize as M
from crowdlake.operators.scale import number_rows
from crowdlake.streaming import jobs

STEPS = [max(1, round(s / 15)) for _, s in HORIZONS]
SHORT = {"15s", "30s", "1m", "5m", "15m"}


def series(n, seed=4):
    rnd, level, out = random.Random(seed), 80.0, []
    for i in range(n):
        level = max(0.0, level + rnd.gauss(0, 4) + 6 * math.sin(i / 9))
        out.append(level)
    return out


def history(spark, values, times=None):
    times = times or [15.0 * i for i in range(len(values))]
    rows = [("a", 0, i, float(t), float(v)) for i, (t, v) in enumerate(zip(times, values))]
    df = spark.createDataFrame(rows, "camera_id STRING, session_id INT, event_id BIGINT, t DOUBLE, value DOUBLE")
    return number_rows(df, X.KEYS, ["t", "event_id"])


def brute_ar(values):
    n = len(values)
    lags = min(24, max(6, n // 5))
    if n < max(36, 3 * lags):
        return None
    s = np.array(values[-1000:])
    centre, scale = s.mean(), max(1.0, s.std())
    z = list((s - centre) / scale)
    rows = [[1.0] + z[i - lags : i] for i in range(lags, len(z))]
    # Ridge as least squares with extra rows; the intercept is not penalized.
    extra = [[0.0] + [math.sqrt(0.05) * (i == j) for j in range(lags)] for i in range(lags)]
    coef = np.linalg.lstsq(np.array(rows + extra), np.array(z[lags:] + [0.0] * lags), rcond=None)[0]
    top, path, out = max(50.0, max(s[-100:]) * 3 + 25), z[-lags:], []
    for _ in range(max(STEPS)):
        y = (coef[0] + sum(c * v for c, v in zip(coef[1:], path[-lags:]))) * scale + centre
        y = min(top, max(0.0, y))
        out.append(y)
        path.append((y - centre) / scale)
    return [out[k - 1] for k in STEPS]


def brute_holt(values):
    level, trend = values[0], values[1] - values[0] if len(values) > 1 else 0.0
    for v in values[1:]:
        before = level
        level = 0.45 * v + 0.55 * (level + 0.98 * trend)
        trend = 0.15 * (level - before) + 0.85 * 0.98 * trend
    diffs = np.abs(np.diff(values[-40:]))
    limit = max(1.0, float(np.percentile(diffs, 90))) if len(diffs) else 1.0
    trend = min(limit, max(-limit, trend))
    return [max(0.0, level + trend * 0.98 * (1 - 0.98**k) / 0.02) for k in STEPS]


def brute_backtest(values, times):
    """One pass in time order: score what is due, predict, choose, issue."""
    pending, errors, issued, out = [], {}, {}, {}
    error = lambda p, o: 0.0 if p == o == 0 else min(1.0, abs(p - o) / max(1.0, o))
    for n in range(1, len(values) + 1):
        seen, now, t = values[:n], values[n - 1], times[n - 1]
        waiting = []
        for target, i, model, p in pending:
            if target > t:
                waiting.append((target, i, model, p))
            elif t - target <= 22.5:
                errors.setdefault((i, model), []).append(error(p, now)) if model else issued.setdefault(i, []).append(error(p, now))
        pending = waiting
        cands = {"holt": brute_holt(seen), "recent_level": [float(np.median(seen[-8:]))] * 9}
        ar = brute_ar(seen)
        if ar:
            cands["autoregressive"] = ar
        cands["ensemble"] = list(np.mean(list(cands.values()), axis=0))
        past = [e for i in issued for e in issued[i][-500:]]
        accuracy = round(max(0.0, 100 * (1 - float(np.mean(past)))), 1) if past else None
        for i, (label, seconds) in enumerate(HORIZONS):
            known = {m: errors.get((i, m), [])[-100:] for m in cands}
            ranked = sorted((float(np.mean(e)), m) for m, e in known.items() if len(e) >= 8)
            model = ranked[0][1] if ranked else "ensemble"
            p, e = cands[model][i], known[model]
            if len(e) >= 8:
                rel, conf = float(np.percentile(e, 90)), round(max(0.0, 100 * (1 - float(np.mean(e)))), 1)
            else:
                diffs = np.diff(seen[-40:])
                noise = float(np.std(diffs)) / max(1.0, float(np.mean(seen[-8:]))) if len(diffs) else 0.0
                noise = 0.0 if noise < 1e-9 else noise
                rel = 0.0 if noise == 0 else min(1.0, max(0.02, noise * math.sqrt(STEPS[i])))
                conf = round(max(0.0, min(100.0, 100 * (1 - rel))), 1)
                if label in SHORT and noise <= 0.2:
                    conf = max(85.0, conf)
            margin = max(2.0, p * rel)
            out[n, label] = (model, max(0, round(p)), max(0, round(p - margin)), max(0, round(p + margin)), conf, accuracy)
            pending.append((t + seconds, i, None, max(0, round(p))))
            pending += [(t + seconds, i, m, c[i]) for m, c in cands.items()]
    return out


def test_autoregression(spark):
    values = series(160)
    got = {r["rn"]: r["preds"] for r in AR.ar_ridge(history(spark, values)).collect()}
    assert min(got) == 36 and len(got) == 125
    for n in (36, 41, 77, 120, 160):
        assert np.allclose(got[n], brute_ar(values[:n]), rtol=1e-7, atol=1e-6)


def test_autoregression_follows_each_origin_over_long_histories(spark, capsys):
    """Thousands of rows, a jump and a flat stretch: the moving sums stay as good as sums of their own."""
    values = [*series(2600, seed=4), *[7.0] * 1300, *[v + 900.0 for v in series(2200, seed=5)]]
    df = AR.ar_ridge(history(spark, values))
    got = {r["rn"]: r["preds"] for r in df.collect()}
    assert len(got) == len(values) - 35
    for n in (36, 999, 1000, 1001, 2601, 3300, 3890, 3905, 4000, 4001, 4444, 5999, 6100):
        assert np.allclose(got[n], brute_ar(values[:n]), rtol=1e-6, atol=1e-4), n
    # Rows sent to tasks: the history and the lead-in of its second block.
    halo = AR.with_row_halo(history(spark, values), AR.SERIES - 1, size=AR.ORIGINS_PER_BLOCK)
    assert halo.count() <= 1.3 * len(values)


def test_autoregression_is_the_same_for_all_blocks(spark, monkeypatch):
    hist = history(spark, series(140))
    before = {r["rn"]: r["preds"] for r in AR.ar_ridge(hist).collect()}
    monkeypatch.setattr(AR, "ORIGINS_PER_BLOCK", 17)
    after = {r["rn"]: r["preds"] for r in AR.ar_ridge(hist).collect()}
    assert before.keys() == after.keys() and all(np.allclose(before[k], after[k]) for k in before)


def test_backtest_with_all_models(spark):
    values = series(110, seed=9)
    rnd = random.Random(2)
    times = np.cumsum([15 + rnd.choice([0, 0, 0.4, 3, 40]) for _ in values]).tolist()
    hist = history(spark, values, times)
    got = X.backtest(hist, {"autoregressive": AR.ar_ridge(hist)}).collect()
    want = brute_backtest(values, times)
    assert len(got) == len(want) == 990
    models = set()
    for r in got:
        model, people, low, high, conf, accuracy = want[r["rn"], r["label"]]
        models.add(model)
        assert r["model"] == model
        assert (r["people_count"], r["lower_count"], r["upper_count"]) == (people, low, high)
        assert abs(r["confidence_percent"] - conf) < 0.11
        assert (r["accuracy_percent"] is None) == (accuracy is None)
        assert accuracy is None or abs(r["accuracy_percent"] - accuracy) < 0.11
    assert len(models) > 1


def test_seasonal_candidate_appears_after_a_day(spark):
    values = series(760, seed=1)
    got = {r["rn"]: r["preds"] for r in X.daily_seasonal(history(spark, values), day_seconds=10_800).collect()}
    assert min(got) == 720
    for n in (720, 745, 760):
        assert got[n] == [values[n - 720 + k - 1] for k in STEPS]
    with pytest.raises(ValueError):
        X.daily_seasonal(history(spark, values), day_seconds=3600)


def test_learned_examples_and_accuracy(spark):
    values = series(400, seed=6)
    examples = M.materialize(N.training_set(history(spark, values)))
    rows = {r["pos"]: r for r in examples.collect()}
    split = max(21, int(400 * 0.8))
    want = [n for n in range(20, 400) if any(n + k <= (400 if n >= split else split) for k in STEPS)]
    assert sorted(rows) == want
    for n in (20, 100, split - 1, split, 399):
        logs = np.log1p(values[n - 20 : n])
        centre, scale = logs[-1], max(0.05, logs.std())
        r = rows[n]
        assert np.allclose(r["features"], [*((logs - centre) / scale), centre / 10])
        assert r["held_out"] == (n >= split)
        for k, y in zip(STEPS, r["targets"]):
            limit = 400 if n >= split else split
            assert (y is None) == (n + k > limit)
            assert y is None or math.isclose(y, (math.log1p(values[n + k - 1]) - centre) / scale, rel_tol=1e-9, abs_tol=1e-9)
    models = N.fit_learned(examples)
    metrics = {r["label"]: r for r in N.score_learned(examples, models).collect()}
    fitted = {r["label"]: r for r in models.collect()}
    assert list(metrics) == [label for label, _ in HORIZONS]
    for i, (label, _) in enumerate(HORIZONS):
        train = [r for r in rows.values() if not r["held_out"] and r["targets"][i] is not None]
        assert metrics[label]["training_samples"] == len(train) and (label in fitted) == bool(train)
        if train:
            # The normal equations of the ridge: a constant feature, the newest value's, has weight 0.
            x, y = np.array([r["features"] for r in train]), np.array([r["targets"][i] for r in train])
            cov, far = np.cov(x.T, bias=True), x - x.mean(axis=0)
            cov += 0.05 * np.diag(np.diag(cov))
            moving = np.diag(cov) > 1e-12
            want = np.zeros(21)
            want[moving] = np.linalg.solve(cov[np.ix_(moving, moving)], (far.T @ (y - y.mean()) / len(y))[moving])
            assert np.allclose(fitted[label]["weights"], want, atol=1e-8) and not moving[19]
            assert math.isclose(fitted[label]["intercept"], y.mean() - want @ x.mean(axis=0), abs_tol=1e-8)
        held = [r for r in rows.values() if r["held_out"] and r["targets"][i] is not None]
        if label not in fitted or not held:
            assert metrics[label]["accuracy_percent"] is None
            continue
        errors = []
        for r in held:
            z = float(np.dot(fitted[label]["weights"], r["features"]) + fitted[label]["intercept"])
            predicted, actual = (max(0.0, math.expm1(min(20.0, max(0.0, r["centre"] + y * r["scale"])))) for y in (z, r["targets"][i]))
            errors.append(min(1.0, abs(predicted - actual) / max(1.0, actual)))
        assert metrics[label]["validation_samples"] == len(held)
        assert math.isclose(metrics[label]["accuracy_percent"], 100 * (1 - np.mean(errors)), rel_tol=1e-9)
    preds = N.learned_predictions(history(spark, values), models)
    assert preds.count() == 381 and len(preds.first()["preds"]) == 9


def test_versions_of_the_learned_model_hold_from_their_approval(spark):
    """Two versions: a rejected one, and one approved later. Predictions, champion, validation and trust change at their times."""
    values = series(320, seed=8)
    hist = history(spark, values).withColumn("t", F.col("rn") * 15.0)
    first, second = 100 * 15.0, 200 * 15.0
    fitted = M.materialize(N.model_version(hist, 1, second))
    assert fitted.count() == 9 and {r["valid_from"] for r in fitted.collect()} == {second}
    weights = {r["label"]: r for r in fitted.collect()}
    rows = []
    for version, t, accuracy, approved in ((1, first, 40.0, False), (2, second, 91.23, True)):
        for label, _ in HORIZONS:
            w = weights[label]
            rows.append((version, t, label, w["weights"], w["intercept"], accuracy, 500, 77, approved))
    registry = spark.createDataFrame(
        rows, "version INT, valid_from DOUBLE, label STRING, weights ARRAY<DOUBLE>, intercept DOUBLE, accuracy_percent DOUBLE,"
        "training_samples BIGINT, validation_samples BIGINT, approved BOOLEAN",
    )
    # One version alone gives what its models give.
    alone = {r["rn"]: r for r in N.registered_predictions(hist, registry.where("version = 2")).collect()}
    plain = {r["rn"]: r["preds"] for r in N.learned_predictions(hist, fitted).collect()}
    for rn in (199, 200, 320):
        want = plain[rn] if rn * 15.0 >= second else [None] * 9
        assert all((a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9)) for a, b in zip(alone[rn]["preds"], want))
        assert alone[rn]["votes"] == (rn * 15.0 >= second)
    got = X.backtest(hist, registry=registry).select("rn", "label", "model", "validation_samples", "trusted", "confidence_percent").collect()
    by = {(r["rn"], r["label"]): r for r in got}
    for label, _ in HORIZONS:
        if weights[label]["weights"] is None:
            continue
        assert all(by[rn, label]["model"] != "learned" for rn in range(1, 100))
        if label in ("30m", "60m"):
            # Not scored eight times by then: the approval alone makes it the champion.
            assert by[199, label]["model"] != "learned" and by[200, label]["model"] == "learned"
            assert by[200, label]["validation_samples"] == 77
    later = [r for r in got if r["rn"] >= 200 and r["model"] == "learned"]
    assert later and all(r["validation_samples"] >= 77 for r in later)
    assert all(r["trusted"] == (r["confidence_percent"] >= 85) for r in later)


def test_shared_folder_comes_from_the_session(spark):
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert folder and M.checkpoint_dir(spark) == folder
    assert f"{folder}/crowdlake-" in M.materialize(spark.range(5)).inputFiles()[0]


def test_late_and_stale_updates(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [("a", 1, 10.0, 1), ("a", 2, 20.0, 2)], [("a", 3, 21.0, 2), ("a", 4, 22.0, 3)]
    for part in rows:
        df = spark.createDataFrame(part, "camera_id STRING, event_id INT, t DOUBLE, seq BIGINT").withColumn("ts", F.timestamp_seconds("t"))
        df.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = jobs.with_lateness(stream, "ts", "1 minute").writeStream.format("memory").queryName("m_late").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["event_id"] for r in spark.table("m_late").collect()) == [1, 2, 4]
