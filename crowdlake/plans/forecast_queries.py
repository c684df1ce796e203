"""Forecast candidates, scoring, selection and learned models over the sampled histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from crowdlake.functions import scalars as S
from crowdlake.operators import alerts as L, autoregressive as AR, forecast as X, learned as N
from crowdlake.operators.materialize import materialize
from crowdlake.operators.scale import number_rows
from crowdlake.plans.registry import query, rounded, sql
from crowdlake.plans.temporal_queries import HIST, count_history
from crowdlake.sources import adapters as A, sinks

_W = "partition by camera_id, session_id order by rn"
_FEATURES = f"""select *, s.l as level, case when rn = 1 then 0 else greatest(-lim, least(lim, s.b)) end as trend from (
    select *, quantile_cont(value, 0.5) over ({_W} rows 7 preceding) as recent_level,
      greatest(1, coalesce(quantile_cont(abs(diff), 0.9) over ({_W} rows 38 preceding), 1)) as lim,
      case when coalesce(stddev_pop(diff) over ({_W} rows 38 preceding), 0) < 1e-9 then 0 else stddev_pop(diff) over ({_W} rows 38 preceding) end
        / greatest(1, avg(value) over ({_W} rows 7 preceding)) as noise,
      list_reduce(list({{'l': case when rn = 1 then value else 0e0 end, 'b': case when rn = 1 then coalesce(nxt - value, 0e0) else 0e0 end, 'x': value}}) over ({_W} rows unbounded preceding),
        lambda s, x: {{'l': 0.45e0 * x.x + 0.55e0 * (s.l + 0.98e0 * s.b), 'b': 0.15e0 * (0.45e0 * x.x + 0.55e0 * (s.l + 0.98e0 * s.b) - s.l) + 0.85e0 * 0.98e0 * s.b, 'x': 0e0}}) as s
    from (select *, value - lag(value) over ({_W}) as diff, lead(value) over ({_W}) as nxt from hist))"""
_CANDS = """select f.*, label, seconds, steps, greatest(0, level + trend * 0.98e0 * (1 - 0.98e0 ** steps) / 0.02e0) as p_holt,
    recent_level as p_recent_level, (greatest(0, level + trend * 0.98e0 * (1 - 0.98e0 ** steps) / 0.02e0) + recent_level) / 2 as p_ensemble
    from features f cross join horizons"""


def _err(p: str) -> str:
    return f"case when observed is null then null when {p} = 0 and observed = 0 then 0e0 else least(1, abs({p} - observed) / greatest(1, observed)) end"


_SCORED = f"""select *, {_err("p_holt")} as e_holt, {_err("p_recent_level")} as e_recent_level, {_err("p_ensemble")} as e_ensemble from (
    select c.*, case when o.t - (c.t + c.seconds) <= 22.5 then o.value end as observed, case when o.t - (c.t + c.seconds) <= 22.5 then o.t end as obs_t
    from cands c asof left join hist o on c.camera_id = o.camera_id and c.session_id = o.session_id and c.t + c.seconds <= o.t)"""


def _rolled(source: str, errors: list[str], rows: int) -> str:
    stats = ", ".join(f"avg({e}) over w as {e}_mean, quantile_cont({e}, 0.9) over w as {e}_p90, count({e}) over w as {e}_n" for e in errors)
    return f"""select * from (select camera_id, session_id, label, obs_t as t, rn, {stats} from {source} where obs_t is not null
        window w as (partition by camera_id, session_id, label order by obs_t, rn rows {rows - 1} preceding))
        qualify row_number() over (partition by camera_id, session_id, label, t order by rn desc) = 1"""


_MODELS = ["ensemble", "holt", "recent_level"]
_KNOWN = f"""select c.*, {", ".join(f"r.e_{m}_{s}" for m in _MODELS for s in ("mean", "p90", "n"))}
    from scored c asof left join rolled r on c.camera_id = r.camera_id and c.session_id = r.session_id and c.label = r.label and c.t >= r.t"""
_LIST = ", ".join(f"case when e_{m}_n >= 8 then {{'e': e_{m}_mean, 'm': '{m}'}} end" for m in _MODELS)


def _choose(prefix: str, suffix: str) -> str:
    return "case model " + " ".join(f"when '{m}' then {prefix}_{m}{suffix}" for m in _MODELS) + " end"


_CHOSEN = f"""select *, {_choose("p", "")} as predicted, {_choose("e", "_mean")} as c_mean, {_choose("e", "_p90")} as c_p90, {_choose("e", "_n")} as c_n
    from (select *, coalesce(list_min(list_filter([{_LIST}], lambda x: x is not null)).m, 'ensemble') as model from known)"""
_SHORT = "label in ('15s', '30s', '1m', '5m', '15m')"
_INTERVALS = f"""select *, cast(greatest(0, round_even(predicted, 0)) as bigint) as people_count,
    cast(greatest(0, round_even(predicted - greatest(2, predicted * err), 0)) as bigint) as lower_count,
    cast(greatest(0, round_even(predicted + greatest(2, predicted * err), 0)) as bigint) as upper_count,
    case when measured then round_even(greatest(0, 100 * (1 - c_mean)), 1) when {_SHORT} and noise <= 0.2 then greatest(85, round_even(100 * (1 - guess), 1))
      else round_even(100 * (1 - guess), 1) end as confidence_percent, coalesce(c_n, 0) as validation_samples
    from (select *, case when measured then c_p90 else guess end as err from (select *, coalesce(c_n >= 8, false) as measured,
      case when noise = 0 then 0 else least(1, greatest(0.02, noise * sqrt(steps))) end as guess from chosen))"""
_QUALITY = """select *, case when good = 9 then 'target_met' when good > 0 then 'partially_verified' else 'needs_calibration' end as snapshot_quality,
    case when first_count > value + greatest(2, value * 0.02) then 'rising' when first_count < value - greatest(2, value * 0.02) then 'falling' else 'stable' end as trend_label
    from (select *, count(*) filter (where trusted) over o as good, min(case when label = '15s' then people_count end) over o as first_count
      from (select *, validation_samples >= 8 and confidence_percent >= 85 as trusted from intervals)
      window o as (partition by camera_id, session_id, rn))"""
_ISSUED = f"select *, {_err('people_count')} as e_issued from quality"
_FINAL = """select *, case when n > 0 then round_even(greatest(0, 100 * (1 - m / n)), 1) end as accuracy_percent from (
    select *, sum(e_issued_n) over o as n, sum(e_issued_mean * e_issued_n) over o as m
    from (select i.*, k.e_issued_mean, k.e_issued_n from issued i asof left join iroll k
      on i.camera_id = k.camera_id and i.session_id = k.session_id and i.label = k.label and i.t >= k.t)
    window o as (partition by camera_id, session_id, rn))"""

CHAIN = {"features": _FEATURES, "cands": _CANDS, "scored": _SCORED}
SELECT = {**CHAIN, "rolled": _rolled("scored", [f"e_{m}" for m in _MODELS], 100), "known": _KNOWN, "chosen": _CHOSEN, "intervals": _INTERVALS}
FULL = {**SELECT, "quality": _QUALITY, "issued": _ISSUED, "iroll": _rolled("issued", ["e_issued"], 500), "final": _FINAL}
TABLES = (*HIST, "horizons")
ID = ["camera_id", "session_id", "event_id"]


@query(
    "holt_forecasts",
    sql("select event_id, label, round(p_holt, 6) as holt, round(p_ensemble, 6) as ensemble, round(noise, 6) as noise from cands", *TABLES, features=_FEATURES, cands=_CANDS),
)
def holt_forecasts(spark, sf):
    d = X.candidates(count_history(spark, sf))
    d = d.select("event_id", "label", F.col("p_holt").alias("holt"), F.col("p_ensemble").alias("ensemble"), "noise")
    return rounded(d, "holt", "ensemble", "noise")


@query(
    "recent_level_and_noise",
    sql("select event_id, round(recent_level, 6) as recent_level, round(noise, 6) as noise, round(lim, 6) as trend_limit from features", *HIST, features=_FEATURES),
)
def recent_level_and_noise(spark, sf):
    d = X.holt_features(count_history(spark, sf)).select("event_id", "recent_level", "noise", "trend_limit")
    return rounded(d, "recent_level", "noise", "trend_limit")


@query(
    "daily_seasonal_forecasts",
    sql(
        """select h.camera_id, h.rn, label, round(p.value, 6) as predicted from allrows h cross join horizons z
        join allrows p on p.camera_id = h.camera_id and p.rn = h.rn - 720 + z.steps where h.rn >= 720""",
        "samples",
        "horizons",
        allrows="select camera_id, count as value, row_number() over (partition by camera_id order by t) as rn from samples",
    ),
)
def daily_seasonal_forecasts(spark, sf):
    s = A.samples(spark, sf).select("camera_id", F.lit(0).alias("session_id"), "t", "event_id", F.col("count").alias("value"))
    d = X.daily_seasonal(number_rows(s, X.KEYS, ["t", "event_id"]), day_seconds=10_800)
    labels = F.array(*[F.lit(h) for h, _ in X.K.HORIZONS])
    d = d.select("camera_id", "rn", F.inline(F.arrays_zip(labels.alias("label"), F.col("preds").alias("predicted"))))
    return rounded(d, "predicted")


@query("autoregressive_forecasts")
def autoregressive_forecasts(spark, sf):
    d = AR.ar_ridge(count_history(spark, sf))
    return d.select("camera_id", "session_id", "rn", *[F.col("preds")[i].alias(f"predicted_{h}") for i, (h, _) in enumerate(X.K.HORIZONS)])


def _scored(spark, sf):
    hist = count_history(spark, sf)
    return materialize(X.score_predictions(X.candidates(hist), hist))


@query(
    "scored_predictions",
    sql(
        "select event_id, label, round(observed, 6) as observed, round(e_holt, 6) as e_holt, round(e_recent_level, 6) as e_recent_level, round(e_ensemble, 6) as e_ensemble from scored",
        *TABLES,
        **CHAIN,
    ),
)
def scored_predictions(spark, sf):
    d = _scored(spark, sf).select("event_id", "label", "observed", "e_holt", "e_recent_level", "e_ensemble")
    return rounded(d, "observed", "e_holt", "e_recent_level", "e_ensemble")


@query(
    "forecast_model_accuracy",
    sql(
        """select camera_id, label, model, round(avg(e), 6) as mean_error, round(quantile_cont(e, 0.9), 6) as p90_error, count(*) as scores
        from (select camera_id, label, unnest(['holt', 'recent_level', 'ensemble']) as model, unnest([e_holt, e_recent_level, e_ensemble]) as e from scored where observed is not null)
        group by 1, 2, 3""",
        *TABLES,
        **CHAIN,
    ),
)
def forecast_model_accuracy(spark, sf):
    return rounded(X.forecast_accuracy(_scored(spark, sf)), "mean_error", "p90_error")


@query(
    "rolling_prediction_errors",
    sql(
        """select camera_id, session_id, label, obs_event, round(e_holt_mean, 6) as mean_error, round(e_holt_p90, 6) as p90_error, e_holt_n as scores
        from (select r.*, h.event_id as obs_event from rolled r join hist h on r.camera_id = h.camera_id and r.session_id = h.session_id and r.t = h.t)""",
        *TABLES,
        **{k: SELECT[k] for k in ("features", "cands", "scored", "rolled")},
    ),
)
def rolling_prediction_errors(spark, sf):
    hist = count_history(spark, sf)
    rolled = X.rolling_errors(materialize(X.score_predictions(X.candidates(hist), hist)), ["e_holt"], 100)
    d = rolled.join(hist.select(*X.KEYS, "t", F.col("event_id").alias("obs_event")), [*X.KEYS, "t"])
    d = d.select(
        *X.KEYS, "label", "obs_event", F.col("e_holt_mean").alias("mean_error"), F.col("e_holt_p90").alias("p90_error"), F.col("e_holt_n").alias("scores")
    )
    return rounded(d, "mean_error", "p90_error")


def _selected(spark, sf):
    scored = _scored(spark, sf)
    errors = [f"e_{m}" for m in X.models_of(scored)]
    return X.select_model(X.with_known_errors(scored.drop(*errors), X.rolling_errors(scored, errors, 100)))


@query(
    "champion_models",
    sql("select event_id, label, model, round(predicted, 6) as predicted from chosen", *TABLES, **{k: v for k, v in SELECT.items() if k != "intervals"}),
)
def champion_models(spark, sf):
    return rounded(_selected(spark, sf).select("event_id", "label", "model", "predicted"), "predicted")


@query(
    "forecast_intervals",
    sql("select event_id, label, people_count, lower_count, upper_count, confidence_percent, validation_samples from intervals", *TABLES, **SELECT),
)
def forecast_intervals(spark, sf):
    d = X.prediction_interval(_selected(spark, sf))
    return d.select("event_id", "label", "people_count", "lower_count", "upper_count", "confidence_percent", "validation_samples")


@query(
    "rolling_origin_backtest",
    sql(
        """select event_id, label, model, people_count, lower_count, upper_count, confidence_percent, trusted, snapshot_quality, trend_label as trend,
        accuracy_percent from final""",
        *TABLES,
        **FULL,
    ),
)
def rolling_origin_backtest(spark, sf):
    return X.backtest(count_history(spark, sf)).select(
        "event_id", "label", "model", "people_count", "lower_count", "upper_count", "confidence_percent", "trusted",
        "snapshot_quality", "trend", "accuracy_percent",
    )


@query("backtest_all_models")
def backtest_all_models(spark, sf):
    """Backtest with the autoregressive and the seasonal candidate as well."""
    hist = count_history(spark, sf)
    extra = {"autoregressive": AR.ar_ridge(hist), "daily_seasonal": X.daily_seasonal(hist, day_seconds=10_800)}
    return X.backtest(hist, extra).groupBy("camera_id", "label", "model").agg(
        F.count(F.lit(1)).alias("forecasts"), F.round(F.avg("e_issued"), 6).alias("mean_error")
    )


@query(
    "forecast_surges",
    sql(
        """select event_id, arg_min(label, seconds) as horizon, arg_min(people_count, seconds) as predicted_count, round_even(arg_min(g, seconds), 1) as growth_percent
        from (select *, case when value > 0 then (people_count - value) / greatest(1, value) * 100 when people_count > 50 then 100 else 0 end as g,
          case when confidence_percent = 0 then 85 else confidence_percent end as c from intervals)
        where label in ('15s', '30s', '1m', '5m', '15m') and people_count > value and g >= 65 and c >= 85 group by 1""",
        *TABLES,
        **SELECT,
    ),
)
def forecast_surges(spark, sf):
    d = X.surge(X.prediction_interval(_selected(spark, sf)))
    return d.select("event_id", "horizon", "predicted_count", "growth_percent")


def surges(spark, sf):
    """Surges of the forecasts from every sample of the histories."""
    return X.surge(materialize(X.prediction_interval(_selected(spark, sf))))


SURGE_ROWS = """select camera_id, session_id, event_id, any_value(t) as t, cast(round_even(any_value(value), 0) as bigint) as people_count,
        arg_min(label, seconds) as horizon, arg_min(people_count, seconds) as predicted_count, round_even(arg_min(g, seconds), 1) as growth_percent, arg_min(c, seconds) as sure
        from (select *, case when value > 0 then (people_count - value) / greatest(1, value) * 100 when people_count > 50 then 100 else 0 end as g,
          case when confidence_percent = 0 then 85 else confidence_percent end as c from intervals)
        where label in ('15s', '30s', '1m', '5m', '15m') and people_count > value and g >= 65 and c >= 85 group by 1, 2, 3"""
_SURGE_STATE = """select h.camera_id, h.event_id, h.t, cast(round_even(h.value, 0) as bigint) as people_count, round_even(h.value, 0) as risk_index,
        g.horizon, g.predicted_count, g.growth_percent, g.sure from hist h left join surge_rows g using (camera_id, session_id, event_id)
        where g.horizon is not null or h.value >= 65"""
_SURGE_KEEP = """select camera_id, min(t) as t from surge_state group by 1 union all
        select k.camera_id, min(n.t) from surge_keep k join surge_state n on n.camera_id = k.camera_id and n.t - k.t > 30 group by 1"""


@query(
    "surge_outbox_messages",
    sql(
        """select n.event_id, concat_ws(chr(10), 'STAMPEDE STAMPEDE WARNING ALERT',
        'Device: ' || n.camera_id || ' | Location: ' || coalesce(location, 'unknown') || ' (Sector 1)',
        'Risk Level: STAMPEDE (Index: ' || printf('%.1f', risk_index) || '/100)', 'Current Crowd: ~' || people_count || ' people',
        case when predicted_count is not null then 'Forecast (' || horizon || '): ' || people_count || ' -> ' || predicted_count || ' pax (+'
          || cast(round_even(growth_percent, 0) as bigint) || '% growth)' end,
        case when predicted_count is not null then 'Prediction Confidence: 90.0%' end,
        'Action: STAMPEDE WARNING: ' || coalesce('Predicted crowd surge to ' || predicted_count || ' pax (+' || cast(round_even(growth_percent, 0) as bigint)
            || '% growth) in next ' || horizon || ' [Confidence: ' || cast(round_even(sure, 0) as bigint) || '%]',
          people_count || ' pax detected at ' || n.camera_id),
        case when lat_min is not null then 'GPS: ' || round_even((lat_min + lat_max) / 2, 6) || 'N, ' || round_even((lon_min + lon_max) / 2, 6) || 'E' end,
        case when lat_min is not null then 'Maps: https://maps.google.com/?q=' || round_even((lat_min + lat_max) / 2, 6) || ',' || round_even((lon_min + lon_max) / 2, 6) end) as body
        from surge_state n join surge_keep k on n.camera_id = k.camera_id and n.t = k.t left join cameras c on n.camera_id = c.camera_id
        order by n.t desc, n.event_id desc limit 200""",
        *TABLES,
        "cameras",
        **SELECT,
        surge_rows=SURGE_ROWS,
        surge_state=_SURGE_STATE,
        surge_keep=_SURGE_KEEP,
    ),
)
def surge_outbox_messages(spark, sf):
    """Forecast surges and high counts become notifications, and these become messages; the newest 200."""
    state = count_history(spark, sf).select(
        "camera_id", "t", "event_id", S.half_even("value").alias("people_count"), F.bround("value").alias("risk_index"),
        S.band("value", (65.0,), ("NO STAMPEDE", "STAMPEDE")).alias("risk_level"), F.lit(0.9).alias("confidence"),
    )
    notes = L.notifications(state, surges(spark, sf), A.cameras(spark, sf))
    return L.alert_outbox(notes).select("event_id", "body")


@query(
    "forecast_snapshots",
    sql(
        """select camera_id, session_id, rn as samples, case when rn >= 3 then 'ready' else 'collecting' end as status,
        case when rn >= 3 then any_value(snapshot_quality) else 'validating' end as quality_status,
        case when rn >= 3 then any_value(trend_label) else 'unknown' end as trend,
        case when rn >= 3 then string_agg(label || '=' || people_count, ',' order by seconds) else '' end as predictions,
        case when rn >= 3 then string_agg(distinct model, ',' order by model) else '' end as models_selected from quality group by 1, 2, 3""",
        *TABLES,
        **{k: FULL[k] for k in (*SELECT, "quality")},
    ),
)
def forecast_snapshots(spark, sf):
    d = X.forecast_snapshot(X.backtest(count_history(spark, sf)), min_samples=3)
    listed = F.transform("predictions", lambda p: F.concat(p["label"], F.lit("="), p["people_count"]))
    return d.select(
        "camera_id", "session_id", "samples", "status", "quality_status", "trend",
        F.array_join(listed, ",").alias("predictions"), F.array_join("models_selected", ",").alias("models_selected"),
    )


_PARTS = {
    "predicted": "max(people_count)", "lower": "max(lower_count)", "upper": "max(upper_count)", "model": "max(model)",
    "target_time": "max(t + seconds)", "accuracy": "max(confidence_percent)", "trusted": "bool_or(trusted)",
}
_WIDE = ", ".join(f"{how} filter (where label = '{h}') as {part}_{h}" for h, _ in X.K.HORIZONS for part, how in _PARTS.items())


@query("wide_forecasts", sql(f"select event_id, {_WIDE} from quality group by 1", *TABLES, **{k: FULL[k] for k in (*SELECT, "quality")}))
def wide_forecasts(spark, sf):
    hist = count_history(spark, sf)
    wide = sinks.forecast_wide(X.backtest(hist))
    d = wide.join(hist.select(*X.KEYS, "t", "event_id"), [*X.KEYS, "t"])
    return d.select("event_id", *[f"{part}_{h}" for h, _ in X.K.HORIZONS for part in _PARTS])


# Samples are sparse at small scale: a minute's interval gives runs long enough for windows.
_STEPS = {"15s": 1, "30s": 1, "1m": 1, "5m": 5, "15m": 15, "30m": 30, "60m": 60, "120m": 120, "180m": 180}
_RUNS = """select *, row_number() over (partition by camera_id, session_id, run_id order by t) as pos,
    count(*) over (partition by camera_id, session_id, run_id) as len
    from (select *, sum(case when t - p > 90 then 1 else 0 end) over (partition by camera_id, session_id order by t) as run_id
      from (select *, lag(t) over (partition by camera_id, session_id order by t) as p from hist))"""
_TARGETS = ", ".join(
    f"case when pos + {s} <= lim then (ln(1 + lead(value, {s}) over w) - centre) / scale end as y_{h}" for h, s in _STEPS.items()
)
_EXAMPLES = f"""select * from (select *, {_TARGETS} from (
    select *, pos >= split as held_out, case when pos >= split then len else split end as lim from (
    select *, greatest(21, floor(len * 0.8e0)) as split, list_last(logs) as centre, greatest(0.05, list_stddev_pop(logs)) as scale from (
    select *, list(ln(1 + greatest(value, 0))) over (partition by camera_id, session_id, run_id order by pos rows 19 preceding) as logs from runs)))
    window w as (partition by camera_id, session_id, run_id order by pos))
    where len(logs) = 20 and pos < len and coalesce({", ".join(f"y_{h}" for h in _STEPS)}) is not null"""


def _examples(spark, sf):
    return materialize(N.training_set(count_history(spark, sf), interval=60.0))


@query(
    "learned_training_set",
    sql(
        """select event_id, held_out, round(centre, 6) as centre, round(scale, 6) as scale, round((logs[1] - centre) / scale, 6) as oldest,
        round(y_15s, 6) as y_15s, round(y_5m, 6) as y_5m, round(y_30m, 6) as y_30m from examples""",
        *HIST,
        runs=_RUNS,
        examples=_EXAMPLES,
    ),
)
def learned_training_set(spark, sf):
    d = _examples(spark, sf).select(
        "event_id", "held_out", "centre", "scale", F.col("features")[0].alias("oldest"),
        F.col("targets")[0].alias("y_15s"), F.col("targets")[3].alias("y_5m"), F.col("targets")[5].alias("y_30m"),
    )
    return rounded(d, "centre", "scale", "oldest", "y_15s", "y_5m", "y_30m")


_H = list(_STEPS)
# One matrix of sums per horizon, eliminated one pivot a step.
_PAIRS = f"""select unnest({_H}) as label, unnest([{", ".join(f"y_{h}" for h in _H)}]) as y, held_out, centre, scale,
    list_concat([1e0], list_transform(logs, lambda v: (v - centre) / scale), [centre / 10]) as x from examples"""
_GRAM = """select label, i, j, sum(x[i] * case when j = 23 then y else x[j] end) as s from pairs, range(1, 23) a(i), range(1, 24) b(j)
    where y is not null and not held_out group by all"""
_COV = """select g.label, g.i, g.j, n.s as n, (g.s / n.s - a.s * b.s / n.s / n.s) * case when g.i = g.j then 1.05e0 else 1e0 end as v, a.s / n.s as mean
    from gram g join gram n on n.label = g.label and n.i = 1 and n.j = 1 join gram a on a.label = g.label and a.i = 1 and a.j = g.i
    join gram b on b.label = g.label and b.i = 1 and b.j = g.j where g.i > 1 and g.j > 1"""
_SOLVED = """select label, 0 as k, list(r order by i) as m from (select label, i, list(v order by j) as r from cov group by 1, 2) group by 1
    union all select label, k + 1, list_transform(m, lambda r, i: case when i = k + 1 then u else list_transform(r, lambda a, j: a - r[k + 1] * u[j]) end)
    from (select *, list_transform(m[k + 1], lambda v: case when m[k + 1][k + 1] > 1e-12 then v / m[k + 1][k + 1] else 0e0 end) as u from solved where k < 21)"""
_LEARNED = """select label, list_transform(m, lambda r: r[22]) as w,
    (select s from gram g where g.label = solved.label and i = 1 and j = 23) / (select s from gram g where g.label = solved.label and i = 1 and j = 1)
    - list_inner_product(list_transform(m, lambda r: r[22]), (select list(mean order by i) from (select distinct i, mean from cov c where c.label = solved.label))) as b
    from solved where k = 21"""
_LEARNED_METRICS = """select label, 100 * (1 - avg(least(1, abs(p - y) / greatest(1, y))) filter (where held_out and y is not null)) as accuracy_percent,
    count(y) filter (where held_out) as validation_samples, count(y) filter (where not held_out) as training_samples from (
    select q.label, held_out, case when y is not null then greatest(0, exp(greatest(0, least(20, centre + scale * y))) - 1) end as y,
      greatest(0, exp(greatest(0, least(20, centre + scale * (b + list_inner_product(x[2:], w))))) - 1) as p
    from (select unnest({H}) as label) q left join pairs using (label) left join learned using (label)) group by 1""".replace("{H}", str(_H))
_METRICS = {"runs": _RUNS, "examples": _EXAMPLES, "pairs": _PAIRS, "gram": _GRAM, "cov": _COV, "solved": _SOLVED, "learned": _LEARNED, "metrics": _LEARNED_METRICS}


def _metrics(spark, sf):
    examples = _examples(spark, sf)
    return N.score_learned(examples, N.fit_learned(examples))


@query(
    "learned_model_accuracy",
    sql("select label, round(accuracy_percent, 4) as accuracy_percent, validation_samples, training_samples from metrics", *HIST, **_METRICS),
)
def learned_model_accuracy(spark, sf):
    """Fit on the training examples, then accuracy per horizon on the held-out ones."""
    return rounded(_metrics(spark, sf), "accuracy_percent", digits=4)


@query(
    "model_approval",
    sql(
        """select coalesce(bool_and(accuracy_percent >= 85) filter (where validation_samples >= 30), false) as approved,
        count(*) filter (where validation_samples >= 30) as evaluated_horizons,
        case when coalesce(bool_and(accuracy_percent >= 85) filter (where validation_samples >= 30), false) then 'active' else 'shadow validation' end as status
        from metrics""",
        *HIST,
        **_METRICS,
    ),
)
def model_approval(spark, sf):
    return N.approve_model(_metrics(spark, sf))


@query(
    "approved_horizons",
    sql("select label from metrics where accuracy_percent >= 85 and training_samples >= 64 and validation_samples >= 30", *HIST, **_METRICS),
)
def approved_horizons(spark, sf):
    return N.approved_horizons(_metrics(spark, sf))


# The version trained in the middle of the time that the data spans.
_NOON = 13_000.0


@query(
    "model_registry",
    sql(
        """select 1 as version, label, round(accuracy_percent, 4) as accuracy_percent, training_samples, validation_samples,
        (select coalesce(bool_and(accuracy_percent >= 85) filter (where validation_samples >= 30), false) from metrics) as approved from metrics""",
        *HIST,
        known_hist=f"select * from hist where t < {_NOON}",
        **{**_METRICS, "runs": _RUNS.replace("from hist", "from known_hist")},
    ),
)
def model_registry(spark, sf):
    d = N.model_version(count_history(spark, sf), 1, _NOON, interval=60.0)
    return rounded(d.select("version", "label", "accuracy_percent", "training_samples", "validation_samples", "approved"), "accuracy_percent", digits=4)
