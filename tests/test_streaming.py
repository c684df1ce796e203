"""Streams over a finite set of files give what the batch operators give on the same rows."""

import math
import re

import pytest
from pyspark.sql import functions as F

from crowdlake.functions import scalars as S
from crowdlake.operators import fleet, materialize as M, temporal as T
from crowdlake.sources import adapters as A, readers
from crowdlake.streaming import jobs, processors as P


@pytest.fixture(scope="module")
def sliced(spark, sf, tmp_path_factory):
    """Write a table as files of consecutive time slices, one micro-batch each."""

    def write(df, name, slices=3):
        path = str(tmp_path_factory.mktemp(name))
        width = 26_000 / slices
        for i in range(slices):
            df.where(F.floor(F.col("t") / width) == i).coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)

    return write


def drain(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.table(name)


def same(a, b, cols):
    left = sorted(map(tuple, a.select(*cols).collect()), key=str)
    right = sorted(map(tuple, b.select(*cols).collect()), key=str)
    assert left and left == right


def test_throttle(spark, sf, sliced):
    s = A.samples(spark, sf)
    got = drain(spark, P.throttle_stream(sliced(s, "throttle"), ["camera_id"], 15.0), "m_throttle")
    same(got, T.throttle(s, ["camera_id"], 15.0), ["camera_id", "event_id"])


def test_notify_cooldown_is_strict(spark, sf, sliced):
    s = A.samples(spark, sf)
    got = drain(spark, P.notify_cooldown_stream(sliced(s, "notify")), "m_notify")
    same(got, T.throttle(s, ["camera_id"], 30.0, strict=True), ["camera_id", "event_id"])


def test_dedupe(spark, sf, sliced):
    u = A.stats_updates(spark, sf).select(
        S.normalize_camera_id("drone_id").alias("camera_id"), "event_id", "t", F.col("analytics_seq").alias("seq")
    )
    got = drain(spark, P.dedupe_stream(sliced(u, "dedupe")), "m_dedupe")
    same(got, T.dedupe_seq(u), ["event_id", "seq"])


def test_presence(spark, sf, sliced):
    p = A.presence(spark, sf)
    got = drain(spark, P.presence_stream(sliced(p, "presence")), "m_presence")
    same(got, T.presence_states(p), ["camera_id", "poll_id", "online", "change"])


def test_gap_and_reset_sessions(spark, sf, sliced):
    s = A.samples(spark, sf)
    got = drain(spark, P.gap_sessions_stream(sliced(s, "gaps"), 22.5), "m_gaps")
    same(got, T.sessionize_gaps(s, 22.5), ["event_id", "run_id"])
    resets = s.where("event_id % 97 = 5")
    marked = s.withColumn("is_reset", F.lit(False)).unionByName(
        resets.withColumn("is_reset", F.lit(True)).withColumn("event_id", F.col("event_id") * 0 - 1)
    )
    got = drain(spark, P.reset_sessions_stream(sliced(marked, "resets")), "m_resets")
    same(got, T.sessionize_resets(s, resets), ["event_id", "session_id"])


def test_alert_cooldown(spark, sf, sliced):
    z = A.zones(spark, sf).select(
        "camera_id", "t", "frame_id", S.cell_label("r", "c").alias("cell"), S.risk_zone(F.col("score") / 400, "four_level").alias("zone")
    )
    from crowdlake.operators.alerts import alert_cooldown

    got = drain(spark, P.alert_cooldown_stream(sliced(z, "alerts")), "m_alerts")
    same(got, alert_cooldown(z), ["camera_id", "cell", "frame_id"])


def test_freshness_timer(spark, sf, sliced):
    s = A.samples(spark, sf).where("camera_id <> 'drone-2' or t < 9000").withColumn("ts", F.timestamp_seconds("t"))
    stream = sliced(s.select("camera_id", "t", "ts"), "fresh").withWatermark("ts", "1 second")
    got = drain(spark, P.freshness_stream(stream, "ts"), "m_fresh")
    last = s.where("camera_id = 'drone-2'").agg(F.max("t")).first()[0]
    stale = got.where("camera_id = 'drone-2' and analytics_status = 'stale'").collect()
    assert [round(r["t"], 6) for r in stale][-1] == round(last, 6)
    assert got.where("analytics_status = 'active'").count() >= 8


def test_current_state(spark, sf, sliced, tmp_path):
    u = A.stats_updates(spark, sf).select(
        S.normalize_camera_id("drone_id").alias("camera_id"), "t", "event_id", "analytics_active", S.half_even("density_score").alias("people_count")
    )
    path = str(tmp_path / "state")
    q = jobs.current_state_stream(sliced(u, "state"), path, str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    same(jobs.read_state(spark, path), fleet.current_state(u), ["camera_id", "event_id", "people_count"])


def test_a_batch_writes_only_the_buckets_it_touches(spark, tmp_path):
    path, src, cp = str(tmp_path / "state"), str(tmp_path / "in"), str(tmp_path / "cp")
    schema = "camera_id string, t double, event_id long, people_count long"
    spark.range(1_000_000).selectExpr("concat('cam-', id) as camera_id", "10D as t", "id as event_id", "id % 9 as people_count").write.parquet(src)
    stream = lambda: spark.readStream.schema(schema).parquet(src)
    for i in range(6):
        q = jobs.current_state_stream(stream(), path, cp, versions=3).trigger(availableNow=True).start()
        q.awaitTermination(300)
        written = [p.name for p in (tmp_path / "state/data" / f"v={i}").iterdir() if p.name.startswith("_bucket=")]
        assert len(written) == (64 if i == 0 else 1)
        more = [("cam-77", 20.0 + i, 5_000_000 + i, 100 + i)]
        spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(src)
    now = jobs.read_state(spark, path)
    assert now.count() == 1_000_000 and now.where("camera_id = 'cam-77'").first()["people_count"] == 104
    # Earlier whole versions are there, their buckets too; older ones have gone.
    assert jobs.read_state(spark, path, before=5).where("camera_id = 'cam-77'").first()["people_count"] == 103
    assert jobs.read_state(spark, path, before=3) is None
    assert sorted(p.name for p in (tmp_path / "state/data").iterdir()) == ["v=0", "v=3", "v=4", "v=5"]
    # A failed batch leaves no manifest, and its files are overwritten when it runs again.
    (tmp_path / "state/data/v=6/_bucket=1").mkdir(parents=True)
    assert jobs.read_state(spark, path).count() == 1_000_000


def test_mode_gate(spark, sf, sliced, tmp_path):
    u = A.stats_updates(spark, sf).withColumn("camera_id", S.normalize_camera_id("drone_id"))
    modes = A.modes(spark, sf)
    modes.write.parquet(str(tmp_path / "modes"))
    out = str(tmp_path / "gated")
    q = jobs.gated_updates(sliced(u, "gate"), str(tmp_path / "modes"), out, str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    same(spark.read.parquet(out), T.mode_gate(u, modes), ["event_id", "mode", "analytics_status"])


def test_forecast_stream(spark, sf, sliced, tmp_path):
    from crowdlake.operators import forecast as X
    from crowdlake.operators.scale import number_rows

    s = A.samples(spark, sf).select("camera_id", F.lit(0).alias("session_id"), "t", "event_id", F.col("count").alias("value"))
    path = str(tmp_path / "fc")
    q = jobs.forecast_stream(sliced(s, "fc"), path, str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = spark.read.parquet(f"{path}/forecasts").where("batch_id = 2")
    hist = number_rows(s, X.KEYS, ["t", "event_id"])
    newest = hist.groupBy(*X.KEYS).agg(F.max("rn").alias("rn"))
    want = X.candidates(hist).join(newest, [*X.KEYS, "rn"])
    cols = ["camera_id", "label", F.round("p_ensemble", 4)]
    same(got, want, cols)


def test_forecast_stream_has_all_models_of_the_batch_form(spark, tmp_path):
    from crowdlake.operators import autoregressive as AR, forecast as X

    # A long history, then silence for days, then one sample.
    schema = "camera_id string, session_id int, t double, event_id long, value double, rn long"
    row = lambda i, t: ("c", 0, t, i, 50.0 + 20 * math.sin(i / 40) + i % 7, i)
    rows = [row(i, 15.0 * i) for i in range(1, 6001)]
    late = [row(6001, 15.0 * 6000 + 10 * 86_400)]
    for name, part in (("0", rows), ("1", late)):
        spark.createDataFrame(part, schema).drop("rn").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("camera_id string, session_id int, t double, event_id long, value double").parquet(f"{tmp_path}/in")
        q = jobs.forecast_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp", shadow=()).trigger(availableNow=True).start()
        q.awaitTermination(300)
    hist = spark.createDataFrame(rows + late, schema)
    extra = {"daily_seasonal": X.daily_seasonal(hist), "autoregressive": AR.ar_ridge(hist.withColumn("o", F.col("rn") == 6001), origin="o")}
    want = X.candidates(hist, {**extra, **X.registered_models(hist)}).where("rn = 6001")
    got = spark.read.parquet(f"{tmp_path}/out/forecasts").where("batch_id = 1")
    assert got.where("p_daily_seasonal is not null and p_autoregressive is not null").count() == got.count() == want.count() > 0
    same(got, want, ["camera_id", "label", "rn", *[F.round(c, 6) for c in want.columns if c.startswith("p_")]])


def test_stats_stream_defaults(spark, sf, tmp_path):
    lines = A.events(spark, sf).selectExpr("to_json(struct(concat('Drone', user_id % 8 + 1) as drone_id, value as density_score)) as value")
    lines.coalesce(1).write.text(str(tmp_path / "json"))
    got = drain(spark, readers.read_stats_stream(spark, str(tmp_path / "json")), "m_stats")
    row = got.select("camera_id", "risk_level", "confidence", "primary_causes", "analytics_active").first()
    assert row[0].startswith("drone-") and tuple(row[1:]) == ("SAFE", 1.0, [], True)
    assert got.count() == A.events(spark, sf).count()


def test_session_summary(spark, sf, sliced):
    s = A.samples(spark, sf).withColumn("ts", F.timestamp_seconds("t"))
    got = drain(spark, jobs.session_summary(sliced(s, "sw"), "ts", "90 seconds", "0 seconds"), "m_sw")
    want = T.sessionize_gaps(s, 90.0).groupBy("camera_id", "run_id").agg(F.count(F.lit(1)).alias("samples"), F.max("t").alias("last"))
    # Sessions still open at the watermark are not emitted.
    closed = want.where(F.col("last") < s.agg(F.max("t")).first()[0] - 400)
    assert got.count() >= closed.count() > 0


def test_large_sequence_numbers_stay_apart_beside_nulls(spark, tmp_path):
    big = 9007199254740992
    rows = [("a", 1.0, 1, big), ("a", 2.0, 2, None), ("a", 3.0, 3, big + 1), ("a", 4.0, 4, big + 1)]
    df = spark.createDataFrame(rows, "camera_id STRING, t DOUBLE, event_id INT, seq BIGINT")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = P.dedupe_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r["event_id"], r["seq"]) for r in got.collect()) == [(1, big), (2, None), (3, big + 1)]
    assert sorted(r["event_id"] for r in T.dedupe_seq(df).collect()) == [1, 2, 3]


def test_frames_are_read_and_unpacked(spark, sf, tmp_path):
    A.packed_density(spark, sf).limit(3).write.parquet(f"{tmp_path}/packed")
    cells = readers.read_frames(spark, f"{tmp_path}/packed")
    assert cells.count() == 3 * 64 and {"row", "col", "d"} <= set(cells.columns)
    cells.write.parquet(f"{tmp_path}/cells")
    assert readers.read_frames(spark, f"{tmp_path}/cells").count() == 3 * 64


@pytest.fixture
def two_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def counts_of_two_cameras():
    """A busy camera, and one that surges, falls silent past every tolerance and comes back."""
    rows = []
    for i in range(120):
        rows.append(("a", 0, 1000 + 15.0 * i, i, 40 + 12 * math.sin(i / 6) + i * 7 % 5))
    for i in range(100):
        t = 1000 + 15.0 * i + (700.0 if i >= 60 else 0.0) + (4.0 if i % 9 == 3 else 0.0)
        rows.append(("b", 0, t, 1000 + i, 3.0 * 1.35 ** min(i % 30, 14) + i % 3))
    return rows


def test_forecasts_selection_surges_and_snapshots(spark, tmp_path, two_partitions):
    from crowdlake.operators import forecast as X
    from crowdlake.operators.scale import number_rows
    from crowdlake.streaming import forecasts as FS

    schema = "camera_id string, session_id int, t double, event_id long, value double"
    samples = spark.createDataFrame(counts_of_two_cameras(), schema)
    path = str(tmp_path / "in")
    for i in range(3):
        samples.where(F.floor((F.col("t") - 1000) / 800) == i).coalesce(1).write.mode("append").parquet(path)
    stream = FS.with_event_time(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
    snaps = FS.snapshot_stream(FS.forecast_rows(FS.candidate_stream(stream)), min_samples=3)
    got = drain(spark, snaps, "m_snaps").collect()

    hist = number_rows(samples, X.KEYS, ["t", "event_id"])
    back = M.materialize(X.backtest(hist))
    want = {(r["camera_id"], r["t"]): r for r in X.forecast_snapshot(back, min_samples=3).collect()}
    assert len(got) == len(want) == 220
    fields = ["seconds", "label", "people_count", "lower_count", "upper_count", "confidence_percent", "validation_samples", "model", "trusted", "quality_status", "target_t"]
    for r in got:
        w = want[(r["camera_id"], r["t"])]
        for c in ("status", "samples", "quality_status", "trend", "trusted_predictions", "models_selected", "accuracy_percent"):
            assert r[c] == w[c], (c, r, w)
        assert [[p[f] for f in fields] for p in r["predictions"]] == [[p[f] for f in fields] for p in w["predictions"]]
    assert {p["model"] for r in got for p in r["predictions"]} == {"ensemble", "holt", "recent_level"}
    assert any(p["trusted"] for r in got for p in r["predictions"])
    surges = {(r["camera_id"], r["t"]): tuple(r)[4:8] for r in X.surge(back).collect()}
    assert surges and surges == {(r["camera_id"], r["t"]): tuple(r["surge"]) for r in got if r["surge"]}


def test_open_predictions_go_when_a_camera_is_silent(spark, tmp_path, two_partitions):
    from crowdlake.streaming import forecasts as FS

    schema = "camera_id string, session_id int, t double, event_id long, value double"
    path = str(tmp_path / "in")
    rows = [[("quiet", 0, 15.0 + 15.0 * i, i, 5.0) for i in range(20)], [("other", 0, 30_000.0, 900, 5.0)], [("other", 0, 30_015.0, 901, 5.0)]]
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    stream = FS.with_event_time(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
    out = FS.forecast_rows(FS.candidate_stream(stream))
    cp = str(tmp_path / "cp")
    q = out.writeStream.format("noop").option("checkpointLocation", cp).trigger(availableNow=True).start()
    q.awaitTermination(300)
    found = []
    for operator in range(3):
        reader = spark.read.format("statestore").option("operatorId", operator)
        if "open" in {v for r in spark.read.format("state-metadata").load(cp).collect() if r["operatorId"] == operator for v in re.findall(r'"stateName":"(\w+)"', r["operatorProperties"])}:
            found.append({r["camera_id"] for r in reader.option("stateVarName", "open").load(cp).select("key.camera_id").collect()})
    assert found == [{"other"}, {"other"}]


def test_notifications(spark, tmp_path, two_partitions):
    from crowdlake.operators import alerts as L, forecast as X
    from crowdlake.operators.scale import number_rows
    from crowdlake.streaming import forecasts as FS

    schema = "camera_id string, session_id int, t double, event_id long, value double"
    samples = spark.createDataFrame(counts_of_two_cameras(), schema)
    state = lambda d, *more: d.select(
        "camera_id", "t", "event_id", S.half_even("value").alias("people_count"), F.bround("value").alias("risk_index"),
        S.band("value", (65.0,), ("NO STAMPEDE", "STAMPEDE")).alias("risk_level"), F.lit(0.9).alias("confidence"), *more,
    )
    dims = spark.createDataFrame([("b", "Gate", 16.0, 16.5, 81.0, 81.5)], "camera_id string, location string, lat_min double, lat_max double, lon_min double, lon_max double")
    path = str(tmp_path / "in")
    for i in range(3):
        samples.where(F.floor((F.col("t") - 1000) / 800) == i).coalesce(1).write.mode("append").parquet(path)
    # A last row of another camera moves the watermark past all others.
    spark.createDataFrame([("z", 0, 9000.0, 9999, 1.0)], schema).coalesce(1).write.mode("append").parquet(path)
    stream = FS.with_event_time(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
    surges = FS.surge_stream(FS.snapshot_stream(FS.forecast_rows(FS.candidate_stream(stream))))
    got = drain(spark, FS.notification_stream(state(stream, FS.EVENT_TIME), surges, dims), "m_notes")

    hist = number_rows(samples, X.KEYS, ["t", "event_id"])
    want = L.notifications(state(samples), X.surge(X.backtest(hist)), dims, limit=100_000)
    assert want.where("horizon is null").count() and want.where("horizon is not null").count()
    same(got, want, want.columns)


def test_late_rows_go_to_a_side_table(spark, tmp_path, two_partitions):
    schema = "camera_id string, event_id int, t double, seq bigint"
    parts = [
        [("a", 1, 20_000.0, 1), ("b", 2, 20_010.0, 1)],
        [("a", 3, 30_000.0, 5)],
        # In time by 60 s; late by 90 s and by 500 s, one of them with a new number; older than all that is kept.
        [("a", 4, 29_945.0, 6), ("a", 5, 29_910.0, 99), ("b", 6, 29_500.0, 2), ("a", 7, 10_000.0, 7), ("a", 8, 30_001.0, 6), ("a", 9, 30_002.0, 7)],
        [("c", 10, 200_000.0, 1)],
        [("c", 11, 200_001.0, 2)],
    ]
    path, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    for part in parts:
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds("t")).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(f"{schema}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    q = jobs.write_with_lateness(stream, "ts", out, cp, "1 minute", "1 hour", idle="1 hour").trigger(availableNow=True).start()
    q.awaitTermination(300)
    rows = jobs.read_with_lateness(spark, out)
    assert sorted(r["event_id"] for r in rows.where("late").collect()) == [5, 6]
    # The late number 99 has not moved the camera's own on.
    assert sorted(r["event_id"] for r in rows.where("not late").collect()) == [1, 2, 3, 4, 9, 10, 11]
    assert {tuple(r) for r in jobs.late_counts(spark, out).where("late > 0").collect()} == {(2, 2, 2)}
    dropped = sum(int(s["numRowsDroppedByWatermark"]) for p in q.recentProgress for s in p["stateOperators"])
    assert dropped == 1
    state = spark.read.format("statestore").option("stateVarName", "value").load(cp)
    assert {r[0] for r in state.select("key.camera_id").collect()} == {"c"}  # the silent ones have expired
