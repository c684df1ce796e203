"""Chunked operators equal plain ones whatever the chunks, on keys of very uneven size."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import Window, functions as F

import __spark_entry__ as entry
from crowdlake.operators import fleet, forecast as X, history as H, scale, temporal as T
from crowdlake.operators.detections import allocate_zones


@pytest.fixture(scope="module")
def hot(spark):
    """Three cameras; one holds most rows, many of them in one short burst."""
    rnd = random.Random(11)
    rows = []
    for i in range(3000):
        camera = "hot" if rnd.random() < 0.8 else rnd.choice(["a", "b"])
        t = rnd.uniform(5000, 5030) if camera == "hot" and rnd.random() < 0.5 else rnd.uniform(0, 20_000)
        rows.append((camera, i, t, rnd.uniform(0, 100), rnd.randrange(10)))
    return spark.createDataFrame(rows, "camera_id STRING, event_id INT, t DOUBLE, count DOUBLE, tag INT").cache()


@pytest.fixture
def tiny_chunks(monkeypatch):
    monkeypatch.setattr(scale, "CHUNK_ROWS", 20)


def values(df, *cols):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


def whole():
    """The plain window of a whole camera."""
    return Window.partitionBy("camera_id").orderBy("t", "event_id")


def test_chunk_length_follows_the_densest_minute(spark, hot, tiny_chunks):
    length = hot.limit(1).select(scale.chunk_width(hot, ["camera_id"], "t")).first()[0]
    assert length == 1.0
    sizes = scale.chunk_width(hot, ["camera_id"], "t", 7.0)
    assert hot.limit(1).select(sizes).first()[0] == 7.0


def test_running_values(hot, tiny_chunks):
    odd = F.when(F.col("tag") % 2 == 1, F.col("tag"))
    got = scale.with_running(
        hot, ["camera_id"], ["t", "event_id"], {"s": ("sum", F.col("tag")), "m": ("max", F.col("count")), "l": ("last", odd)}
    )
    want = hot.select(
        "*",
        F.sum("tag").over(whole()).alias("s"),
        F.max("count").over(whole()).alias("m"),
        F.last(odd, ignorenulls=True).over(whole().rowsBetween(Window.unboundedPreceding, 0)).alias("l"),
    ).fillna({"l": -1})
    cols = ["event_id", "s", "m", "l"]
    assert values(got.fillna({"l": -1}), *cols) == values(want, *cols)


def test_previous_row_and_numbers(hot, tiny_chunks):
    got = scale.with_previous(hot, ["camera_id"], ["t", "event_id"], {"p": F.col("event_id")})
    want = hot.withColumn("p", F.lag("event_id").over(whole()))
    assert values(got.fillna(-1), "event_id", "p") == values(want.fillna(-1), "event_id", "p")
    numbered = scale.number_rows(hot, ["camera_id"], ["t", "event_id"])
    assert values(numbered, "event_id", "rn") == values(hot.withColumn("rn", F.row_number().over(whole())), "event_id", "rn")


@pytest.mark.parametrize("direction,tolerance", [("backward", None), ("forward", None), ("backward", 25.0), ("forward", 25.0)])
def test_asof(hot, tiny_chunks, direction, tolerance):
    left, right = hot.where("tag < 5"), hot.where("tag >= 7").select("camera_id", "t", F.col("event_id").alias("hit"))
    got = {r["event_id"]: r["hit"] for r in scale.asof(left, right, ["camera_id"], ["hit"], direction, tolerance).collect()}
    by_camera = {}
    for r in right.collect():
        by_camera.setdefault(r["camera_id"], []).append((r["t"], r["hit"]))
    for r in left.collect():
        past = [(t, h) for t, h in by_camera[r["camera_id"]] if (t <= r["t"] if direction == "backward" else t >= r["t"])]
        if tolerance is not None:
            past = [(t, h) for t, h in past if abs(t - r["t"]) <= tolerance]
        want = (max(past) if direction == "backward" else min(past))[1] if past else None
        assert got[r["event_id"]] == want


def test_growth_is_the_same_for_all_chunk_lengths(hot):
    wide = H.growth_rate(hot, "count", 30, id_col="event_id", width=50_000.0)
    for width in (1.0, 17.0, 400.0):
        narrow = H.growth_rate(hot, "count", 30, id_col="event_id", width=width)
        assert values(narrow, "event_id", "growth", "growth_n") == values(wide, "event_id", "growth", "growth_n")


def test_smoothing_is_the_same_for_all_blocks(hot, monkeypatch):
    counted = hot.withColumn("density", F.col("count")).withColumn("detections", F.col("tag") * 9)

    def run():
        results = (
            T.ema(hot, "count", 0.35, "s", F.col("tag") == 0),
            T.rolling_median(hot, 5, "count", "s"),
            T.stabilize(counted, 3, 0.65, F.lit(1.0), F.lit(0.0), out="s"),
        )
        return np.array([[r["s"] for r in d.orderBy("event_id").collect()] for d in results])

    before = run()
    monkeypatch.setattr(T.K, "BLOCK_ROWS", 30)
    assert np.allclose(run(), before, rtol=0, atol=1e-9)


def test_stabilizer_follows_its_recursion(hot):
    df = hot.withColumn("density", F.col("count")).withColumn("detections", F.col("tag") * 9)
    got = {r["event_id"]: r["stable"] for r in T.stabilize(df, 3, 0.65, F.lit(1.1), F.lit(2.0)).collect()}
    series = {}
    for r in df.orderBy("t", "event_id").collect():
        series.setdefault(r["camera_id"], []).append(r)
    for rows in series.values():
        raw, value = [], None
        for r in rows:
            raw.append(max(0.0, r["density"] * 1.1 + 2.0, float(r["detections"])))
            target = float(np.median(raw[-3:]))
            value = target if value is None else value + 0.65 * (target - value)
            value = max(value, float(r["detections"]))
            assert abs(got[r["event_id"]] - value) < 1e-7


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.integers(0, 4000), min_size=1, max_size=150),
    st.sampled_from([5.0, 15.0, 40.0]),
    st.sampled_from([10.0, 45.0, 333.0]),
    st.booleans(),
)
def test_throttle_composition(ticks, gap, width, strict):
    """Following chunk reports leads to the same rows as one pass."""
    ts = sorted(t / 4 for t in ticks)
    last, want = None, []
    for t in ts:
        if last is None or (t - last > gap if strict else t - last >= gap):
            want.append(t)
            last = t
    got, last = [], None
    for chunk in sorted({t // width for t in ts}):
        mine = [t for t in ts if t // width == chunk]
        entries, exits = T._chunk_exits(mine, chunk * width, gap, strict)
        k = T._next_allowed(mine, last, gap, strict)
        kept = []
        while k < len(mine):
            kept.append(mine[k])
            k = T._next_allowed(mine, mine[k], gap, strict, k + 1)
        got += kept
        e = T._next_allowed(entries, last, gap, strict)
        last = exits[e] if e < len(entries) else last
        if kept:
            assert last == kept[-1]
    assert got == want


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.integers(0, 4000), min_size=1, max_size=150),
    st.sampled_from([5.0, 15.0, 40.0]),
    st.sampled_from([90.0, 200.0]),
    st.booleans(),
    st.integers(1, 5),
)
def test_composed_exits(ticks, gap, width, strict, fan):
    """The function of neighbouring chunks leads from any earlier time where the chunks lead one by one."""
    ts = sorted(t / 4 for t in ticks)
    chunks = sorted({t // width for t in ts})
    parts = [T._chunk_exits([t for t in ts if t // width == c], c * width, gap, strict) for c in chunks]
    for i in range(0, len(parts), fan):
        start, group = chunks[i] * width, parts[i : i + fan]
        f = T._composed(group, start, gap, strict)
        own = [t for t in ts if start <= t <= start + gap]
        assert len(f[0]) <= len(own) + 1 and f[0] == sorted(f[0])
        for last in [None, *[start - d / 4 for d in range(1, 200, 7)]]:
            want = last
            for part in group:
                want = T._after(part, want, gap, strict)
            assert T._after(f, last, gap, strict) == want


def test_throttle_sends_a_block_of_a_hot_key_at_most(spark):
    """Ten million rows of one key: no task gets more than ``fan`` chunk functions, at any level."""
    df = spark.range(10_000_000).selectExpr("'hot' as camera_id", "id as event_id", "id * 0.01D + id % 3 * 0.001D as t")
    sizes = []
    plain = T._grouped

    def watched(d, keys, fn, extra):
        if "_ts" not in d.columns:
            sizes.append(d.groupBy(*keys).count().agg(F.max("count")).first()[0])
        return plain(d, keys, fn, extra)

    T._grouped = watched
    try:
        got = [r["t"] for r in T.throttle(df, ["camera_id"], 15.0, width=60.0, fan=16).select("t").orderBy("t").collect()]
    finally:
        T._grouped = plain
    assert len(sizes) == 5 and max(sizes) <= 16  # composed twice, followed three times
    assert all(15.0 <= b - a <= 15.02 for a, b in zip(got, got[1:])) and got[0] == 0.0 and got[-1] > 99_980


def test_throttle_with_null_keys_ties_and_missing_times(spark):
    rows = [(None, 1, 0.0), (None, 0, 0.0), ("a", 2, 5.0), ("a", 3, None), (None, 4, 20.0), ("a", 5, 6.0), ("a", 5, 6.0)]
    df = spark.createDataFrame(rows, "camera_id STRING, event_id INT, t DOUBLE")
    kept = lambda gap, **kw: sorted(r["event_id"] for r in T.throttle(df, ["camera_id"], gap, **kw).collect())
    assert kept(15.0) == [0, 2, 4] and kept(1.0, strict=True) == [0, 2, 4] and kept(1.0) == [0, 2, 4, 5]
    assert kept(0.0) == [0, 1, 2, 4, 5, 5] and kept(0.0, strict=True) == [0, 2, 4, 5]
    assert T.throttle(df.where("false"), ["camera_id"], 15.0).count() == 0


def test_missed_cameras_expand_gaps_only(spark, capsys):
    polls = spark.range(40).selectExpr("id as poll_id", "id % 9 <> 4 as ok")
    cameras = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "camera_id STRING")
    ready = polls.where("ok").selectExpr("poll_id", "explode(array('a', 'z', if(poll_id % 4 = 0, 'b', 'a'))) as camera_id")
    want = {(p, c) for p in range(40) if p % 9 != 4 for c in "abc" if not (c == "a" or (c == "b" and p % 4 == 0))}
    for step in (3, 100_000):
        got = [tuple(r) for r in fleet.missed_cameras(polls, ready, cameras, step).collect()]
        assert len(got) == len(want) and set(got) == want
    fleet.missed_cameras(polls, ready, cameras).explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert fleet.missed_cameras(polls.where("false"), ready, cameras).count() == 0


def test_throttle_on_a_hot_key(hot, tiny_chunks):
    got = {r["event_id"] for r in T.throttle(hot, ["camera_id"], 15.0).collect()}
    want, last = set(), {}
    for r in hot.orderBy("t", "event_id").collect():
        if r["camera_id"] not in last or r["t"] - last[r["camera_id"]] >= 15.0:
            want.add(r["event_id"])
            last[r["camera_id"]] = r["t"]
    assert got == want


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_exact_percentile(spark, q):
    rnd = random.Random(7)
    rows = [("hot", 5.0)] * 4000 + [("hot", rnd.gauss(0, 10)) for _ in range(6000)] + [("small", float(i * i)) for i in range(9)] + [("one", 3.0)]
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE")
    got = {r["k"]: r["p"] for r in scale.exact_percentile(df, ["k"], "v", q, "p").collect()}
    for k in ("hot", "small", "one"):
        assert abs(got[k] - np.percentile([v for n, v in rows if n == k], q * 100)) < 1e-9


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 6)), min_size=9, max_size=9), st.floats(0, 200))
def test_allocation_keeps_sum_and_detections(spark, cells, total):
    df = spark.createDataFrame(
        [("a", 1, i // 3, i % 3, float(d), n, total) for i, (d, n) in enumerate(cells)],
        "camera_id STRING, frame_id INT, r INT, c INT, density DOUBLE, detected INT, total DOUBLE",
    )
    out = allocate_zones(df).collect()
    assert sum(r["people"] for r in out) == max(round(total), sum(n for _, n in cells))
    assert all(r["people"] >= r["detected"] for r in out)


def test_newest_rows_beyond_the_group_limit(hot):
    got = scale.keep_latest(hot, ["camera_id"], 1500, ["t", "event_id"])
    rank = F.row_number().over(Window.partitionBy("camera_id").orderBy(F.desc("t"), F.desc("event_id")))
    assert values(got, "event_id") == values(hot.withColumn("r", rank).where("r <= 1500"), "event_id")


def test_holt_is_the_same_for_all_blocks(hot, monkeypatch):
    hist = scale.number_rows(hot.withColumn("session_id", F.lit(0)).withColumn("value", F.col("count")), X.KEYS, ["t", "event_id"])
    before = values(X.holt_features(hist), "event_id", "level", "trend", "noise", "recent_level")
    monkeypatch.setattr(X.K, "BLOCK_ROWS", 50)
    assert values(X.holt_features(hist), "event_id", "level", "trend", "noise", "recent_level") == before


HEAVY = ("backtest", "champion", "forecast", "learned", "rolling", "snapshots", "approv", "model")


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not any(h in n for h in HEAVY)))
def test_plans_have_no_nested_loops(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_scans_prune_columns_and_push_filters(spark, sf):
    plan = entry.queries()["person_detections"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "l_shipdate" not in plan
    plan = entry.queries()["calibration_fits"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_shipdate" not in plan
    plan = entry.queries()["mode_gated_updates"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "In(event_type, [purchase,signup])" in plan


def test_telemetry_summary_averages_every_recent_row(spark):
    from crowdlake.operators import fleet

    rows = [("a", i, 90.0 + i / 200, float(i), 1.0, 0, 0.0, 10.0) for i in range(2000)]
    rows += [("b", i, float(i), float(i), 1.0, i, 0.0, 10.0) for i in range(8)] + [("b", 99, None, 5.0, 1.0, 0, 0.0, 1.0)]
    names = "camera_id STRING, event_id INT, t DOUBLE, latency_s DOUBLE, infer_s DOUBLE, reconnects INT, drop_pct DOUBLE, fps DOUBLE"
    got = {r["camera_id"]: r for r in fleet.telemetry_summary(spark.createDataFrame(rows, names), 100.0).collect()}
    assert got["a"]["rows_used"] == 2000 and got["a"]["latency_ms"] == 999.5 * 1000
    assert got["b"]["rows_used"] == 5 and got["b"]["latency_ms"] == 5000


def test_halo_copies_stay_few_beside_a_dense_key(spark, tiny_chunks):
    rows = [("dense", i, i / 100.0) for i in range(20_000)] + [("thin", i, float(i)) for i in range(200)] + [("thin", -1, None)]
    df = spark.createDataFrame(rows, "camera_id STRING, event_id INT, t DOUBLE")
    copies = scale.with_time_halo(df, scale.chunk_width(df, ["camera_id"], "t"), before=120.0)
    assert copies.count() <= 2 * len(rows)
    assert scale.home_rows(copies).count() == len(rows)  # the row without a time stays


def test_null_keys_are_one_key(spark, tiny_chunks):
    rows = [(None, i, float(i * 40)) for i in range(6)] + [("a", i, float(i * 40)) for i in range(3)] + [("a", -1, None)]
    df = spark.createDataFrame(rows, "camera_id STRING, event_id INT, t DOUBLE")
    got = scale.number_rows(df, ["camera_id"], ["t", "event_id"], width=60.0).collect()
    assert sorted(r["rn"] for r in got if r["camera_id"] is None) == [1, 2, 3, 4, 5, 6]
    assert sorted((r["event_id"], r["rn"]) for r in got if r["camera_id"]) == [(-1, 1), (0, 2), (1, 3), (2, 4)]


def test_newest_rows_of_a_hot_key(spark):
    df = spark.range(5000).selectExpr("if(id % 100 = 0, 'b', 'a') as k", "cast(id as double) as t", "id as event_id")
    for n in (1, 3, 1500):
        got = scale.keep_latest(df, ["k"], n, ["t", "event_id"]).groupBy("k").agg(F.count("*").alias("n"), F.min("t").alias("low")).collect()
        assert {r["k"]: r["n"] for r in got} == {"a": min(n, 4950), "b": min(n, 50)}


def test_an_inactive_camera_loses_every_counting_field(spark):
    from crowdlake.operators import fleet

    row = ("a", 1.0, 1, False, 9, "HIGH", 2.0, 0.5, 80.0, "STAMPEDE", 0.4, ["x"], 3.0, 4.0, "h", "o", [{"k": "v"}], [[1.0]])
    schema = """camera_id STRING, t DOUBLE, event_id INT, analytics_active BOOLEAN, people_count INT, comp_zone STRING, pressure DOUBLE,
        stampede_prob DOUBLE, risk_index DOUBLE, risk_level STRING, confidence DOUBLE, primary_causes ARRAY<STRING>, motion_speed DOUBLE,
        turbulence DOUBLE, hotspot_alert STRING, opposing_alert STRING, gps_alerts ARRAY<MAP<STRING, STRING>>, zone_scores ARRAY<ARRAY<DOUBLE>>"""
    got = fleet.current_state(spark.createDataFrame([row], schema)).first().asDict()
    assert {k: got[k] for k in fleet.ANALYTICS} == fleet.ANALYTICS
    aged = spark.createDataFrame([row], schema).withColumn("analytics_status", F.lit("active"))
    got = fleet.freshness(aged, 1000.0).first().asDict()
    assert {k: got[k] for k in fleet.ANALYTICS} == fleet.ANALYTICS and got["analytics_status"] == "stale"


def test_path_changes_follow_each_path(spark):
    from crowdlake.operators import fleet

    polls = spark.createDataFrame([(i, float(i), i != 2) for i in range(5)], "poll_id INT, t DOUBLE, ok BOOLEAN")
    ready = spark.createDataFrame([(0, "a"), (0, "b"), (1, "b"), (3, "b"), (3, "a"), (3, "a")], "poll_id INT, path STRING")
    got = [(r["poll_id"], r["appeared"], r["vanished"]) for r in fleet.path_changes(polls, ready).orderBy("poll_id").collect()]
    assert got == [(0, ["a", "b"], []), (1, [], ["a"]), (3, ["a"], []), (4, [], ["a", "b"])]
    cameras = spark.createDataFrame([("a",), ("c",), ("c",)], "camera_id STRING")
    missed = fleet.missed_cameras(polls, ready.withColumnRenamed("path", "camera_id"), cameras).collect()
    assert sorted(map(tuple, missed)) == [(0, "c"), (1, "a"), (1, "c"), (3, "c"), (4, "a"), (4, "c")]


# --- work and memory of the growth and zone queries ------------------------------------------


def growth_by_hand(rows, seconds):
    """{id: (growth, entries)} of rows (key, id, t, y): the history of each row, one by one."""
    out = {}
    for key, i, t, _ in rows:
        seen = [(u, y) for k, _, u, y in rows if k == key and (u is None if t is None else u is not None and t - seconds <= u <= t)]
        known = [(u, y) for u, y in seen if y is not None]
        if t is None or len(seen) < 3 or max(u for u, _ in seen) == min(u for u, _ in seen):
            out[i] = (0.0, len(seen))
            continue
        u, y = np.array([u for u, _ in known]), np.array([y for _, y in known])
        sxx = ((u - u.mean()) ** 2).sum() if known else 0.0
        slope = ((u - u.mean()) * (y - y.mean())).sum() / sxx if sxx else None
        out[i] = (None if slope is None else slope / max(y.mean(), 1e-6), len(seen))
    return out


def test_growth_equals_each_rows_own_history(spark):
    rnd = random.Random(5)
    # Ties, entries exactly a history apart, times before zero, gaps, null values and null times.
    rows = [(rnd.choice("ab"), i, rnd.choice([rnd.uniform(-40, 200), float(rnd.randrange(-4, 20) * 10)]), rnd.choice([rnd.uniform(0, 50), rnd.uniform(0, 50), None])) for i in range(400)]
    rows += [("a", 1000 + i, None, 2.0) for i in range(3)] + [("c", 2000, 0.0, 3.0), ("c", 2001, 20.0, 4.0), ("c", 2002, 20.0, 9.0), (None, 2003, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "camera_id STRING, event_id INT, t DOUBLE, y DOUBLE")
    want = growth_by_hand(rows, 20)
    for parts in (None, 3):
        got = {r["event_id"]: (r["growth"], r["growth_n"]) for r in H.growth_rate(df, "y", 20, id_col="event_id", parts=parts).collect()}
        assert len(got) == len(rows) and {i: n for i, (_, n) in got.items()} == {i: n for i, (_, n) in want.items()}
        for i, (g, _) in want.items():
            assert got[i][0] == g if g is None else abs(got[i][0] - g) < 1e-9 * max(1.0, abs(g)), i


def test_growth_never_goes_over_a_history_again(hot):
    """Frames that slide are computed anew for each row: the square of the rows in a history."""
    for d in (H.growth_rate(hot, "count", 30, id_col="event_id"), H.growth_rate(hot, "count", 30, id_col="event_id", present=F.col("tag") > 0)):
        plan = d._jdf.queryExecution().optimizedPlan().toString().lower()
        frames = plan.count("specifiedwindowframe(")
        assert frames and frames == plan.count("frame, unboundedpreceding$(), currentrow$())")


@pytest.fixture(scope="module")
def small_tables(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("zones"))
    spark.range(300).selectExpr(
        "id as event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 97) as ts", "id % 13 as user_id",
        "'click' as event_type", "cast(id % 50 as double) as value", "'' as props",
    ).write.parquet(f"{top}/events.parquet")
    spark.range(3000).selectExpr(
        "cast(id / 4 as bigint) as l_orderkey", "id % 4 as l_linenumber", "id % 70 as l_partkey", "id % 9 as l_suppkey",
        "cast(id % 50 as double) as l_quantity", "0.05e0 as l_discount",
    ).write.parquet(f"{top}/lineitem.parquet")
    return top


@pytest.mark.parametrize("name", ["zone_trend_labels", "allocated_zone_people", "smoothed_cell_speed", "detection_zone_counts"])
def test_tasks_hold_a_bounded_number_of_rows(spark, small_tables, monkeypatch, name):
    """Adaptive execution merges by compressed bytes; narrow rows by the million then meet in one task."""
    query = entry.queries()[name]
    plain = sorted(map(tuple, query(spark, small_tables).collect()))
    monkeypatch.setattr(scale, "TASK_ROWS", 100)
    dealt = query(spark, small_tables)
    assert dealt.rdd.getNumPartitions() >= 27
    assert sorted(map(tuple, dealt.collect())) == plain
