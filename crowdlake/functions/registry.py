"""SQL names for the scalar functions. They are SQL functions, inlined by the optimizer."""

from __future__ import annotations

from pyspark.sql import SparkSession

from crowdlake import constants as K

_CELLS = ", ".join(f"{float(v)}D" for row in K.ZONE_CAPACITY for v in row)

SQL_FUNCTIONS = {
    "risk_zone": (
        "x DOUBLE",
        "STRING",
        f"CASE WHEN x < {K.TWO_LEVEL_CUT} THEN '{K.TWO_LEVEL_LABELS[0]}' ELSE '{K.TWO_LEVEL_LABELS[1]}' END",
    ),
    "risk_zone4": (
        "x DOUBLE",
        "STRING",
        "CASE WHEN x < 0.25 THEN 'SAFE' WHEN x < 0.5 THEN 'WATCH' WHEN x < 0.75 THEN 'HIGH' ELSE 'CRITICAL' END",
    ),
    "sat_exp": ("x DOUBLE, k DOUBLE", "DOUBLE", "1D - exp(-x / k)"),
    "sat_ratio": ("x DOUBLE, k DOUBLE", "DOUBLE", "x / (x + k)"),
    "occupancy_pct": (
        "score DOUBLE, cap DOUBLE",
        "DOUBLE",
        "greatest(0D, least(5D, score / greatest(cap, 1D))) * 100D",
    ),
    "zone_capacity": ("r INT, c INT", "DOUBLE", f"element_at(array({_CELLS}), r * 3 + c + 1)"),
    "cell_label": ("r INT, c INT", "STRING", "concat(element_at(array('A', 'B', 'C'), r + 1), CAST(c + 1 AS STRING))"),
    "normalize_camera_id": (
        "x STRING",
        "STRING",
        "CASE WHEN contains(x, '-') THEN trim(lower(x)) "
        "ELSE regexp_replace(trim(lower(coalesce(x, ''))), '^(drone|cctv)', '$1-') END",
    ),
}


def register_sql_functions(spark: SparkSession) -> None:
    for name, (params, returns, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")
