"""Density maps, detections and motion fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from crowdlake.functions import scalars as S
from crowdlake.operators import detections as D, flow as V, frames as M
from crowdlake.operators.scale import task_parts
from crowdlake.plans.registry import query, rounded, sql
from crowdlake.sources import adapters as A

CELLS = ("emb", "density_cells")

_FRAME_METRICS = """
select camera_id, frame_id, round(density, 6) as density, round(peak, 6) as peak,
  round(case when density >= 1 then ratio else 0 end, 6) as hotspot_ratio,
  round(case when density >= 1 then 0.55 * (1 - exp(-density / 1200)) + 0.25 * peak / (peak + 300)
    + 0.2 * least(1, 4 * ratio) else 0e0 end, 6) as frame_risk
from (select camera_id, frame_id, sum(d) as density, max(d) as peak,
        avg(case when d >= p90 then 1e0 else 0e0 end) as ratio
      from (select camera_id, frame_id, d, quantile_cont(d, 0.9) filter (where d > 0) over (partition by camera_id, frame_id) as p90
            from (select camera_id, frame_id, greatest(d, 0e0) as d from density_cells)) group by 1, 2)
"""


@query("unpacked_density_frames", sql("select camera_id, frame_id, row, col, round(d, 6) as d from density_cells", *CELLS))
def unpacked_density_frames(spark, sf):
    return rounded(M.unpack_frames(A.packed_density(spark, sf)), "d")


@query(
    "cleaned_density",
    sql(
        """select camera_id, frame_id, row, col, round(case when d < thr then 0e0 else d end, 6) as d from (
        select *, greatest(0.002, least(max(d) over (partition by camera_id, frame_id) * 0.015, 0.05)) as thr
        from (select camera_id, frame_id, row, col, greatest(d, 0e0) as d from density_cells))""",
        *CELLS,
    ),
)
def cleaned_density(spark, sf):
    return rounded(M.clean_density(A.density_cells(spark, sf)), "d")


@query(
    "graphics_masked_density",
    sql(
        """select camera_id, frame_id, row, col, round(case when sat > 95 and val > 135
        and (hue < 12 or hue > 168 or (hue > 24 and hue < 42) or (hue > 42 and hue < 88) or (hue > 88 and hue < 105))
        and (row < 1 or row >= 7) then 0e0 else d end, 6) as d from (
        select *, (frame_id * 31 + row * 17 + col * 7) % 180 as hue, (frame_id * 13 + row * 5 + col * 29) % 256 as sat,
        (frame_id * 7 + row * 41 + col * 3) % 256 as val from density_cells)""",
        *CELLS,
    ),
)
def graphics_masked_density(spark, sf):
    d = A.density_cells(spark, sf).selectExpr(
        "*",
        "(frame_id * 31 + row * 17 + col * 7) % 180 as hue",
        "(frame_id * 13 + row * 5 + col * 29) % 256 as sat",
        "(frame_id * 7 + row * 41 + col * 3) % 256 as val",
    )
    return rounded(M.mask_graphics(d, 8), "d").drop("hue", "sat", "val")


@query(
    "blended_density",
    sql(
        """select a.camera_id, a.frame_id, a.row, a.col, round(a.d * 0.6 / 0.8 + b.d * 0.2 / 0.8, 6) as d
        from density_cells a join density_cells b on a.camera_id = b.camera_id and a.frame_id = b.frame_id
        and a.row = b.col and a.col = b.row""",
        *CELLS,
    ),
)
def blended_density(spark, sf):
    d = A.density_cells(spark, sf)
    other = d.select("camera_id", "frame_id", F.col("col").alias("row"), F.col("row").alias("col"), "d")
    return rounded(M.blend_density(d, other, 0.6, 0.2), "d")


@query(
    "flip_averaged_density",
    sql(
        """select a.camera_id, a.frame_id, a.row, a.col, round((a.d + b.d) / 2, 6) as d
        from density_cells a join density_cells b on a.camera_id = b.camera_id and a.frame_id = b.frame_id
        and a.row = b.row and b.col = 7 - a.col""",
        *CELLS,
    ),
)
def flip_averaged_density(spark, sf):
    d = A.density_cells(spark, sf)
    return rounded(M.flip_average(d, d, 8), "d")


@query(
    "resized_density",
    sql(
        """select camera_id, frame_id, nr as row, nc as col,
        round(sum(d * greatest(0, 1 - abs(sr - row)) * greatest(0, 1 - abs(sc - col))) * 64e0 / 60e0, 6) as d
        from density_cells,
        (select unnest(range(0, 6))::int as nr), (select unnest(range(0, 10))::int as nc),
        lateral (select greatest(0, least((nr + 0.5e0) * 8 / 6 - 0.5e0, 7)) as sr, greatest(0, least((nc + 0.5e0) * 8 / 10 - 0.5e0, 7)) as sc)
        group by 1, 2, 3, 4""",
        *CELLS,
    ),
)
def resized_density(spark, sf):
    return rounded(M.resize_density(A.density_cells(spark, sf), (8, 8), (6, 10)), "d")


@query(
    "normalized_density",
    sql(
        """select camera_id, frame_id, row, col, round(d / (sum(d) over (partition by camera_id, frame_id) + 1e-6), 6) as d
        from (select * replace (greatest(d, 0e0) as d) from density_cells)""",
        *CELLS,
    ),
)
def normalized_density(spark, sf):
    d = A.density_cells(spark, sf).withColumn("d", F.greatest("d", F.lit(0.0)))
    return rounded(M.normalize_density(d), "d")


@query("frame_pressure_metrics", sql(_FRAME_METRICS, *CELLS))
def frame_pressure_metrics(spark, sf):
    return rounded(M.frame_metrics(A.density_cells(spark, sf)), "density", "peak", "hotspot_ratio", "frame_risk")


@query(
    "zone_density_scores",
    sql(
        """select camera_id, frame_id, r, c, round(sum(d), 6) as score,
        round(sum(d) / max((hi_r - lo_r) * (hi_c - lo_c)), 6) as score_per_area
        from density_cells join (select *, r * 8 // 3 as lo_r, (r + 1) * 8 // 3 as hi_r, c * 8 // 3 as lo_c, (c + 1) * 8 // 3 as hi_c from cells) z
        on row >= lo_r and row < hi_r and col >= lo_c and col < hi_c group by 1, 2, 3, 4""",
        *CELLS,
        "cells",
    ),
)
def zone_density_scores(spark, sf):
    return rounded(M.zone_scores(A.density_cells(spark, sf), 8, 8), "score", "score_per_area")


@query(
    "person_detections",
    sql("select camera_id, frame_id, det_id, cls, round(conf, 6) as conf from detections where cls = 0 and conf >= 0.3", "detections"),
)
def person_detections(spark, sf):
    d = D.filter_detections(A.detections(spark, sf))
    return rounded(d.select("camera_id", "frame_id", "det_id", "cls", "conf"), "conf")


@query(
    "detection_zone_counts",
    sql(
        """select f.camera_id, f.frame_id, z.r, z.c, count(d.frame_id) as people
        from (select distinct camera_id, frame_id from detections) f cross join cells z
        left join people d on d.camera_id = f.camera_id and d.frame_id = f.frame_id and d.r = z.r and d.c = z.c
        group by 1, 2, 3, 4""",
        "detections",
        "cells",
        people="""select camera_id, frame_id,
        cast(least(2, greatest(0, floor((y1 + y2) * 0.5e0 * (3 / 360e0)))) as int) as r,
        cast(least(2, greatest(0, floor((x1 + x2) * 0.5e0 * (3 / 640e0)))) as int) as c
        from detections where cls = 0 and conf >= 0.3""",
    ),
)
def detection_zone_counts(spark, sf):
    return D.detection_zones(A.detections(spark, sf), 360, 640, where=D.qualifies())


@query(
    "detection_density_zones",
    sql(
        """select f.camera_id, f.frame_id, z.r, z.c, round(coalesce(sum(m.d), 0), 6) as people
        from (select distinct camera_id, frame_id from detections) f cross join cells z
        left join blurred m on m.camera_id = f.camera_id and m.frame_id = f.frame_id
        and m.row >= z.r * 12 // 3 and m.row < (z.r + 1) * 12 // 3 and m.col >= z.c * 20 // 3 and m.col < (z.c + 1) * 20 // 3
        group by 1, 2, 3, 4""",
        "detections",
        "cells",
        binned="""select camera_id, frame_id, count(*) as n,
        least(11, greatest(0, floor((y1 + y2) * 0.5e0 * (12 / 360e0)))) as gr,
        least(19, greatest(0, floor((x1 + x2) * 0.5e0 * (20 / 640e0)))) as gc
        from detections where cls = 0 and conf >= 0.3 group by camera_id, frame_id, gr, gc""",
        raw="""select camera_id, frame_id, row, col, sum(n * exp(-((row - gr) ** 2 + (col - gc) ** 2) / 8e0)) as d
        from binned, (select unnest(range(0, 12)) as row), (select unnest(range(0, 20)) as col)
        where abs(row - gr) <= 8 and abs(col - gc) <= 8 group by 1, 2, 3, 4""",
        blurred="""select r.camera_id, r.frame_id, row, col, d * n / sum(d) over (partition by r.camera_id, r.frame_id) as d
        from raw r join (select camera_id, frame_id, sum(n) as n from binned group by 1, 2) b
        on r.camera_id = b.camera_id and r.frame_id = b.frame_id""",
    ),
)
def detection_density_zones(spark, sf):
    dense = D.detections_to_density(A.detections(spark, sf), 12, 20, 360, 640, where=D.qualifies())
    zones = M.zone_scores(dense, 12, 20).select("camera_id", "frame_id", "r", "c", F.col("score").alias("people"))
    return rounded(zones, "people")


_ALLOC_IN = """select camera_id, frame_id, r, c, floor(score) as density, (frame_id + r * 5 + c) % 4 as detected,
    floor(sum(floor(score)) over (partition by camera_id, frame_id)) * 0.7e0 + 0.5e0 as total from zones"""


@query(
    "allocated_zone_people",
    sql(
        """select camera_id, frame_id, r, c, cast(det + extra + case when rk <= rest - sum(extra) over f then 1 else 0 end as bigint) as people
        from (select *, row_number() over (partition by camera_id, frame_id order by exact - extra desc, r * 3 + c desc) as rk
          from (select *, floor(exact) as extra from (select *, case when wsum > 0 then density / wsum else 1e0 / 9 end * rest as exact
            from (select *, greatest(greatest(0, round_even(total, 0)), dsum) - dsum as rest
              from (select *, detected as det, sum(detected) over (partition by camera_id, frame_id) as dsum,
                sum(density) over (partition by camera_id, frame_id) as wsum from alloc)))))
        window f as (partition by camera_id, frame_id)""",
        "zones",
        alloc=_ALLOC_IN,
    ),
)
def allocated_zone_people(spark, sf):
    zones = A.zones(spark, sf)
    # Dealt by frame once, for the frame's sum and for the allocation.
    z = zones.select("camera_id", "frame_id", "r", "c", "score").repartition(task_parts(zones), "camera_id", "frame_id").selectExpr(
        "camera_id",
        "frame_id",
        "r",
        "c",
        "cast(floor(score) as double) as density",
        "(frame_id + r * 5 + c) % 4 as detected",
        "sum(cast(floor(score) as double)) over (partition by camera_id, frame_id) * 0.7e0 + 0.5e0 as total",
    )
    return D.allocate_zones(z).select("camera_id", "frame_id", "r", "c", "people")


@query(
    "closeup_fused_zones",
    sql(
        """select camera_id, frame_id, r, c, round(score, 6) as score,
        round(greatest(total, sum(score) over (partition by camera_id, frame_id)), 6) as total
        from (select z.camera_id, z.frame_id, z.r, z.c, 0.4e0 as total,
          greatest(z.score, coalesce(f.n, 0), case when p.n > 0 then 1 else 0 end) as score
          from (select camera_id, frame_id, r, c, 0.05e0 * ((frame_id + r + c) % 40) as score
                from (select distinct camera_id, frame_id from detections) cross join cells) z
          left join (select camera_id, frame_id, r, c, count(*) as n from boxes where cls < 4 group by 1, 2, 3, 4) f
            on z.camera_id = f.camera_id and z.frame_id = f.frame_id and z.r = f.r and z.c = f.c
          left join (select camera_id, frame_id, r, c, count(*) as n from boxes where cls >= 4 group by 1, 2, 3, 4) p
            on z.camera_id = p.camera_id and z.frame_id = p.frame_id and z.r = p.r and z.c = p.c)""",
        "detections",
        "cells",
        boxes="""select *, cast(least(2, greatest(0, floor((y1 + 15e0) / 360 * 3))) as int) as r,
        cast(least(2, greatest(0, floor((x1 + 10e0) / 640 * 3))) as int) as c from detections""",
    ),
)
def closeup_fused_zones(spark, sf):
    d = A.detections(spark, sf)
    boxes = d.select("camera_id", "frame_id", "cls", F.col("x1").alias("x"), F.col("y1").alias("y"), F.lit(20.0).alias("w"), F.lit(30.0).alias("h"))
    cell = F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k")
    zones = d.select("camera_id", "frame_id").distinct().select("*", cell).selectExpr(
        "camera_id", "frame_id", "cast(floor(k / 3) as int) as r", "cast(k % 3 as int) as c", "0.4e0 as total",
        "0.05e0 * ((frame_id + floor(k / 3) + k % 3) % 40) as score",
    )
    fused = D.fuse_closeup(zones, boxes.where("cls < 4"), boxes.where("cls >= 4"), (360, 640), (360, 640))
    return rounded(fused, "score", "total")


@query(
    "vehicle_frame_counts",
    sql(
        """select camera_id, frame_id, count(label) as total_vehicles, count(*) filter (where label = 'car') as cars,
        count(*) filter (where label = 'truck') as trucks, count(*) filter (where label = 'bus') as buses,
        count(*) filter (where label in ('motorcycle', 'bicycle')) as bikes, count(*) filter (where label = 'uav') as uavs,
        count(label) as listed, least(100e0, round_even(count(label) / 150e0 * 100, 1)) as occupancy_rate
        from (select *, case when conf >= 0.2 then case cls when 1 then 'bicycle' when 2 then 'car' when 3 then 'motorcycle'
          when 4 then 'uav' when 5 then 'bus' when 7 then 'truck' end end as label from detections) group by 1, 2""",
        "detections",
    ),
)
def vehicle_frame_counts(spark, sf):
    # Boxes below the confidence have no label: they keep their frame and count nothing.
    label = F.when(F.col("conf") >= 0.2, S.vehicle_label("cls"))
    return D.vehicle_counts(A.detections(spark, sf).withColumn("label", label))


_BLOBS = """select *, case when area > 276 then case when aspect > 1.6 then 'truck' else 'bus' end
    when aspect > 0.6 then 'car' else 'bike' end as label
    from (select camera_id, frame_id, det_id, area, case when bh > 0 then bw / bh else 1 end as aspect
      from (select *, cast((frame_id * 31 + det_id * 977) % 20000 as double) as area,
        cast(1 + (frame_id + det_id * 5) % 30 as double) as bw, cast((frame_id * 3 + det_id) % 25 as double) as bh from detections))
    where area between 46 and 13824"""


def _blobs(spark, sf):
    raw = A.detections(spark, sf).selectExpr(
        "camera_id", "frame_id", "det_id",
        "cast((frame_id * 31 + det_id * 977) % 20000 as double) as area",
        "cast(1 + (frame_id + det_id * 5) % 30 as double) as bw",
        "cast((frame_id * 3 + det_id) % 25 as double) as bh",
    )
    return D.classify_blobs(raw, 360, 640)


@query("classified_vehicle_blobs", sql("select camera_id, frame_id, det_id, label from blobs", "detections", blobs=_BLOBS))
def classified_vehicle_blobs(spark, sf):
    return D.listed_detections(_blobs(spark, sf)).select("camera_id", "frame_id", "det_id", "label")


@query(
    "best_vehicle_counts",
    sql(
        """select camera_id, frame_id, case when b then 'blobs' else 'model' end as source,
        case when b then bn else mn end as total_vehicles, case when b then bc else mc end as cars
        from (select coalesce(m.camera_id, k.camera_id) as camera_id, coalesce(m.frame_id, k.frame_id) as frame_id,
          m.n as mn, m.cars as mc, k.n as bn, k.cars as bc, m.n is null or (m.n < 3 and coalesce(k.n > m.n, false)) as b
          from (select camera_id, frame_id, count(*) filter (where cls in (1, 2, 3, 4, 5, 7)) as n, count(*) filter (where cls = 2) as cars
                from detections group by 1, 2) m
          full join (select camera_id, frame_id, count(*) as n, count(*) filter (where label = 'car') as cars from blobs group by 1, 2) k
          on m.camera_id = k.camera_id and m.frame_id = k.frame_id)""",
        "detections",
        blobs=_BLOBS,
    ),
)
def best_vehicle_counts(spark, sf):
    model = D.vehicle_counts(A.detections(spark, sf).withColumn("label", S.vehicle_label("cls")))
    best = D.best_vehicle_source(model, D.vehicle_counts(_blobs(spark, sf), 100.0, 50))
    return best.select("camera_id", "frame_id", "source", "total_vehicles", "cars")


FLOW = ("emb", "flow_cells")
_COMP = """select camera_id, frame_id, row, col, fx - mx as fx, fy - my as fy, sqrt((fx - mx) * (fx - mx) + (fy - my) * (fy - my)) as mag
    from (select *, quantile_cont(fx, 0.5) over (partition by camera_id, frame_id) as mx,
      quantile_cont(fy, 0.5) over (partition by camera_id, frame_id) as my from flow_cells)"""
_THIRDS = "select *, cast(least(row // 5, 2) as int) as r, cast(least(col // 21, 2) as int) as c from comp"


@query(
    "compensated_flow",
    sql("select camera_id, frame_id, row, col, round(fx, 6) as fx, round(fy, 6) as fy, round(mag, 6) as mag from comp", *FLOW, comp=_COMP),
)
def compensated_flow(spark, sf):
    return rounded(V.compensate_flow(A.flow_cells(spark, sf)), "fx", "fy", "mag")


@query(
    "motion_speed_turbulence",
    sql(
        """select camera_id, frame_id, round(coalesce(quantile_cont(mag, 0.5) filter (where mag > 0.5), 0), 6) as speed,
        round(coalesce(stddev_pop(mag) filter (where mag > 0.5), 0), 6) as turbulence from comp group by 1, 2""",
        *FLOW,
        comp=_COMP,
    ),
)
def motion_speed_turbulence(spark, sf):
    return rounded(V.motion_metrics(V.compensate_flow(A.flow_cells(spark, sf))), "speed", "turbulence")


@query(
    "zone_speed_grid",
    sql(
        """select f.camera_id, f.frame_id, z.r, z.c, round(coalesce(g.speed, 0), 6) as speed
        from (select distinct camera_id, frame_id from comp) f cross join cells z
        left join (select camera_id, frame_id, r, c, case when count(*) filter (where mag > 0.5) / count(*) < 0.08 then 0
          else quantile_cont(mag, 0.5) filter (where mag > 0.5) end as speed from thirds group by 1, 2, 3, 4) g
        on f.camera_id = g.camera_id and f.frame_id = g.frame_id and z.r = g.r and z.c = g.c""",
        *FLOW,
        "cells",
        comp=_COMP,
        thirds=_THIRDS,
    ),
)
def zone_speed_grid(spark, sf):
    grid = V.speed_grid(V.compensate_flow(A.flow_cells(spark, sf)), 16, 64)
    return rounded(grid, "speed")


@query(
    "opposing_flow_alerts",
    sql(
        """select camera_id, frame_id, round(max(opp), 6) as max_score, bool_or(opp >= 0.35) as any_dangerous,
        case when bool_or(opp >= 0.35) then 'OPPOSING FLOW DETECTED: ' || string_agg(['A', 'B', 'C'][r + 1] || (c + 1), ', ' order by r, c) filter (where opp >= 0.35) else '' end as alert_text
        from (select f.camera_id, f.frame_id, z.r, z.c,
            case when 20 + (f.frame_id * 7 + z.r * 3 + z.c) % 30 < 30 then 0 else coalesce(g.opp, 0) end as opp
          from (select distinct camera_id, frame_id from comp) f cross join cells z
          left join (select camera_id, frame_id, r, c,
              case when n < 10 or n / tot < 0.08 then 0 else greatest(least(px, nx), least(py, ny)) / n end as opp
            from (select camera_id, frame_id, r, c, count(*) as tot, count(*) filter (where mag > 0.3) as n,
              count(*) filter (where mag > 0.3 and fx > 0) as px, count(*) filter (where mag > 0.3 and fx < 0) as nx,
              count(*) filter (where mag > 0.3 and fy > 0) as py, count(*) filter (where mag > 0.3 and fy < 0) as ny
              from thirds group by 1, 2, 3, 4)) g
          on f.camera_id = g.camera_id and f.frame_id = g.frame_id and z.r = g.r and z.c = g.c) group by 1, 2""",
        *FLOW,
        "cells",
        comp=_COMP,
        thirds=_THIRDS,
    ),
)
def opposing_flow_alerts(spark, sf):
    flow = A.flow_cells(spark, sf)
    cell = F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k")
    zones = flow.select("camera_id", "frame_id").distinct().select("*", cell).selectExpr(
        "camera_id", "frame_id", "cast(floor(k / 3) as int) as r", "cast(k % 3 as int) as c",
        "cast(20 + (frame_id * 7 + floor(k / 3) * 3 + k % 3) % 30 as double) as score",
    )
    return rounded(V.opposing_flow(V.compensate_flow(flow), 16, 64, zones), "max_score")


@query(
    "gated_zone_motion",
    sql(
        """select o.camera_id, o.frame_id, z.r, z.c, round(case when density < 1 or score < 5 then 0 else motion end, 6) as cell_speed,
        round(case when density < 1 then 0 else motion end, 6) as motion, round(case when density < 1 then 0 else turbulence end, 6) as turbulence
        from observations o join zones z on o.frame_id = z.frame_id""",
        "observations",
        "zones",
    ),
)
def gated_zone_motion(spark, sf):
    obs = A.observations(spark, sf).select("frame_id", "density", "motion", "turbulence")
    z = A.zones(spark, sf).join(obs, "frame_id").withColumn("cell_speed", F.col("motion"))
    out = V.gate_motion(z).select("camera_id", "frame_id", "r", "c", "cell_speed", "motion", "turbulence")
    return rounded(out, "cell_speed", "motion", "turbulence")
