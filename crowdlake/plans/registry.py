"""Registry of queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

_T = "(epoch_us(ts) - 1704067200000000) / 1e8"
_CAM = "concat('drone-', cast(user_id % 8 + 1 as string))"

# The canonical tables in the checking dialect, by name; each may use earlier ones.
TABLES = {
    "samples": f"select {_CAM} as camera_id, event_id, {_T} as t, value as count, event_type from events",
    "observations": f"""select {_CAM} as camera_id, event_id as frame_id, {_T} as t,
        case when event_type = 'error' and event_id % 3 = 0 then 0e0 else value * 6 end as density,
        value / 10 as peak, (event_id % 100) / 100e0 as hotspot_ratio,
        (event_id * 37 % 100) / 10e0 as motion, (event_id * 53 % 80) / 10e0 as turbulence,
        (event_id * 17 % 50) / 100e0 as opposing from events""",
    "zones": f"""select {_CAM} as camera_id, event_id as frame_id, {_T} as t,
        cast(floor(k / 3) as int) as r, cast(k % 3 as int) as c,
        value * ((event_id * (k + 7)) % 11) / 3e0 as score from events cross join (select unnest(range(0, 9)) as k)""",
    "detections": """select concat('drone-', cast(l_suppkey % 8 + 1 as string)) as camera_id, l_orderkey as frame_id,
        l_linenumber as det_id, l_quantity * 12e0 as x1, (l_partkey % 70) * 5e0 as y1,
        l_quantity * 12e0 + 20e0 as x2, (l_partkey % 70) * 5e0 + 30e0 as y2,
        l_discount * 8 as conf, cast(l_partkey % 9 as int) as cls from lineitem""",
    "emb": "select vec_id, i - 1 as pos, embedding[i] as v from (select vec_id, embedding, unnest(range(1, 65)) as i from embeddings)",
    "density_cells": """select concat('drone-', cast(vec_id % 8 + 1 as string)) as camera_id, vec_id as frame_id,
        cast(floor(pos / 8) as int) as row, cast(pos % 8 as int) as col, cast(v as double) * 40 as d from emb""",
    "flow_cells": """select concat('drone-', cast(cast(floor(a.vec_id / 16) % 8 + 1 as int) as string)) as camera_id,
        cast(floor(a.vec_id / 16) as bigint) as frame_id, cast(a.vec_id % 16 as int) as row, cast(a.pos as int) as col,
        cast(a.v as double) * 8 as fx, cast(b.v as double) * 8 as fy
        from emb a join emb b on a.vec_id = b.vec_id and b.pos = (a.pos + 1) % 64""",
    "labels_in": """select concat('drone-', cast(l_suppkey % 10 + 1 as string)) as camera_id,
        l_orderkey * 8 + l_linenumber as sample_no, l_quantity * 10 as predicted_count,
        cast(floor(l_quantity * 12 + 4 + (l_linenumber - 3) * l_discount * 100) as double) as actual_count,
        lower(l_returnflag) as angle from lineitem""",
    "presence": f"""select event_id as poll_id, {_T} as t, {_CAM} as camera_id, event_type <> 'signup' as poll_ok,
        event_type <> 'error' and event_type <> 'click' as ready from events""",
    "modes": f"""select event_id, {_T} as t, case when event_type = 'signup' then 'viewing' else 'counting' end as mode
        from events where event_type in ('signup', 'purchase')""",
    "telemetry": f"""select {_CAM} as camera_id, event_id, {_T} as t,
        case when event_type = 'error' then null else value / 100 end as latency_s, value / 250 as infer_s,
        event_id % 4 as reconnects, (event_id * 13 % 200) / 10e0 as drop_pct, 10 + event_id % 25 as fps from events""",
    "stats_updates": f"""select concat(case when event_id % 2 = 0 then 'drone' else 'Drone-' end, cast(user_id % 8 + 1 as string)) as drone_id,
        {_T} as t, event_id, case when event_id % 10 = 0 then null else cast(floor(event_id / 3) as bigint) end as analytics_seq,
        value as density_score, event_type <> 'click' as analytics_active from events""",
    "cameras": """select concat('drone-', cast(n_nationkey + case when n_nationkey < 7 then 1 else 2 end as string)) as camera_id, r_name as location,
        case when n_nationkey % 2 = 0 then 'DRONE' else 'CCTV' end as category, 20e0 + n_nationkey as altitude_m,
        0.9e0 + n_nationkey * 0.03e0 as scale, n_nationkey - 3e0 as bias,
        16.98e0 + n_nationkey * 0.001e0 as lat_min, 16.983e0 + n_nationkey * 0.001e0 as lat_max,
        81.73e0 as lon_min, 81.7325e0 as lon_max
        from nation join region on n_regionkey = r_regionkey""",
    "cells": "select cast(k // 3 as int) as r, cast(k % 3 as int) as c from (select unnest(range(0, 9)) as k)",
    "capacity": """select cast(k // 3 as int) as r, cast(k % 3 as int) as c,
        [300e0, 400e0, 300e0, 350e0, 500e0, 350e0, 300e0, 400e0, 300e0][k + 1] as capacity from (select unnest(range(0, 9)) as k)""",
    "resets": "select camera_id, event_id, t from samples where event_id % 997 = 5",
    # Greedy 15 s throttle per camera and session, one step per iteration.
    "sessions": """select s.*, (select count(*) from resets r where r.camera_id = s.camera_id and r.t <= s.t) as session_id
        from samples s""",
    "kept": """select camera_id, session_id, min(t) as t from sessions group by 1, 2
        union all select k.camera_id, k.session_id, min(s.t) from kept k join sessions s
        on s.camera_id = k.camera_id and s.session_id = k.session_id and s.t - k.t >= 15 group by 1, 2""",
    "hist": """select s.camera_id, s.session_id, s.event_id, s.t, s.count,
        row_number() over w as rn,
        quantile_cont(s.count, 0.5) over (partition by s.camera_id, s.session_id order by s.t rows 4 preceding) as value
        from sessions s join kept k on s.camera_id = k.camera_id and s.session_id = k.session_id and s.t = k.t
        window w as (partition by s.camera_id, s.session_id order by s.t)""",
    "horizons": """select * from (values ('15s', 15, 1), ('30s', 30, 2), ('1m', 60, 4), ('5m', 300, 20), ('15m', 900, 60),
        ('30m', 1800, 120), ('60m', 3600, 240), ('120m', 7200, 480), ('180m', 10800, 720)) h(label, seconds, steps)""",
}


def sql(body: str, *tables: str, **extra: str) -> str:
    """``body`` preceded by the named canonical tables and ``extra`` ones, in order."""
    parts = [f"{name} as ({TABLES[name]})" for name in tables] + [f"{name} as ({text})" for name, text in extra.items()]
    return f"with recursive {', '.join(parts)} {body}" if parts else body


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def rounded(df, *names: str, digits: int = 6, nudge: float = 0.0):
    """Round computed doubles, so results agree across engines. ``nudge`` moves values that are
    exact in decimals off the rounding ties; the check adds the same."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.round(F.col(n) + nudge if nudge else F.col(n), digits) for n in names})
