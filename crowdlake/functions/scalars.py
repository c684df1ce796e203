"""Column expressions: every function maps columns to a column and stays inside codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from crowdlake import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def half_even(x) -> Column:
    """Whole number, ties to even, as BIGINT."""
    return F.bround(_c(x), 0).cast("bigint")


def clamp(x, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), _c(x)))


def band(x, cuts: Sequence[float], labels: Sequence[str]) -> Column:
    """First label whose cut lies above ``x``; the last label otherwise."""
    out = F.when(_c(x) < cuts[0], labels[0])
    for cut, label in zip(cuts[1:], labels[1:]):
        out = out.when(_c(x) < cut, label)
    return out.otherwise(labels[-1])


def risk_zone(x, scheme: str = "two_level", cuts: Sequence[float] | None = None) -> Column:
    if scheme == "two_level":
        return band(x, cuts or (K.TWO_LEVEL_CUT,), K.TWO_LEVEL_LABELS)
    if scheme == "four_level":
        return band(x, cuts or K.RISK_CUTS, K.RISK_LABELS)
    raise ValueError(f"unknown scheme {scheme!r}")


def crowd_state(pressure) -> Column:
    return band(pressure, (K.INDEX_CUT,), ("STABLE", "STAMPEDE RISK"))


def alert_level(zone) -> Column:
    return F.when(_c(zone).isin("NO STAMPEDE", "SAFE"), "NORMAL").otherwise("STAMPEDE WARNING")


def zone_rank(zone) -> Column:
    """0..3 for the four severity labels, 0 for anything else."""
    z = _c(zone)
    out = F.lit(0)
    for rank, label in enumerate(K.RISK_LABELS):
        out = F.when(z == label, F.lit(rank)).otherwise(out)
    return out


def normalize_camera_id(x) -> Column:
    """``Drone7`` -> ``drone-7``; ids that already carry a dash are only lowered and trimmed."""
    low = F.trim(F.lower(F.coalesce(_c(x), F.lit(""))))
    bare = ~F.contains(low, F.lit("-"))
    out = low
    for kind in ("cctv", "drone"):
        out = F.when(
            bare & F.startswith(low, F.lit(kind)), F.concat(F.lit(kind + "-"), F.substr(low, F.lit(len(kind) + 1)))
        ).otherwise(out)
    return out


def cell_label(r, c) -> Column:
    letters = F.array(*[F.lit(x) for x in "ABC"])
    return F.concat(F.element_at(letters, (_c(r) + 1).cast("int")), (_c(c) + 1).cast("string"))


def pixels_per_metre(altitude, hfov=K.SENSOR_HFOV, width=K.INFER_WIDTH) -> Column:
    ground = 2.0 * _c(altitude) * F.tan(F.radians(_c(hfov) / 2.0))
    return _c(width) / F.greatest(ground, F.lit(0.1))


def altitude_multiplier(altitude, hfov=K.SENSOR_HFOV, width=K.INFER_WIDTH, base=K.BASELINE_PX_PER_M) -> Column:
    """Factor for density maps; 1 at or below five metres."""
    ppm = F.greatest(pixels_per_metre(altitude, hfov, width), F.lit(0.01))
    return F.when(_c(altitude) > 5.0, F.pow(_c(base) / ppm, F.lit(2.0))).otherwise(1.0)


def altitude_corrected(density, altitude, hfov=K.SENSOR_HFOV, width=K.INFER_WIDTH, base=K.BASELINE_PX_PER_M) -> Column:
    """Scalar form: divide by the squared resolution ratio, the divisor floored at 0.05."""
    scale = F.pow(pixels_per_metre(altitude, hfov, width) / _c(base), F.lit(2.0))
    return F.when(_c(altitude) < 5.0, _c(density)).otherwise(_c(density) / F.greatest(scale, F.lit(0.05)))


def occupancy_pct(score, capacity) -> Column:
    return clamp(_c(score) / F.greatest(_c(capacity).cast("double"), F.lit(1.0)), 0.0, 5.0) * 100.0


def sat_exp(x, k) -> Column:
    return 1.0 - F.exp(-_c(x) / _c(k))


def sat_ratio(x, k) -> Column:
    return _c(x) / (_c(x) + _c(k))


def cell_latitude(lat_min, lat_max, r) -> Column:
    known = ~((_c(lat_min) == 0.0) & (_c(lat_max) == 0.0))
    lat = _c(lat_max) - (_c(r) + 0.5) / 3.0 * (_c(lat_max) - _c(lat_min))
    return F.coalesce(F.when(known, F.bround(lat, 6)), F.lit(0.0))


def cell_longitude(lat_min, lat_max, lon_min, lon_max, c) -> Column:
    known = ~((_c(lat_min) == 0.0) & (_c(lat_max) == 0.0))
    lon = _c(lon_min) + (_c(c) + 0.5) / 3.0 * (_c(lon_max) - _c(lon_min))
    return F.coalesce(F.when(known, F.bround(lon, 6)), F.lit(0.0))


def apply_calibration(count, scale, bias) -> Column:
    return F.greatest(F.lit(0.0), _c(count) * _c(scale) + _c(bias))


def zone_capacity(r, c) -> Column:
    """Safe head-count of a grid cell from the configured grid."""
    flat = F.array(*[F.lit(float(v)) for row in K.ZONE_CAPACITY for v in row])
    return F.element_at(flat, (_c(r) * 3 + _c(c) + 1).cast("int"))


def confidence_pct(conf, floor: float = 85.0) -> Column:
    """Fractions become percent; never below ``floor``."""
    pct = F.when(_c(conf) <= 1.0, F.bround(_c(conf) * 100.0, 1)).otherwise(F.bround(_c(conf), 1))
    return F.greatest(pct, F.lit(floor))


def primary_causes(density, motion, turbulence, growth, opposing) -> Column:
    """Names of the terms above their cut-offs, in fixed order."""
    # Cut-off and text per term.
    causes = [
        (density, 0.50, "high crowd density"),
        (motion, 0.45, "rapid crowd movement"),
        (turbulence, 0.45, "high motion turbulence"),
        (growth, 0.60, "rapid density increase"),
        (opposing, 0.35, "opposing pedestrian flow"),
    ]
    return F.array_compact(F.array(*[F.when(_c(x) > cut, F.lit(text)) for x, cut, text in causes]))


def vehicle_label(cls) -> Column:
    out = F.lit(None).cast("string")
    for key, label in K.VEHICLE_CLASSES.items():
        out = F.when(_c(cls) == key, F.lit(label)).otherwise(out)
    return out


def equal_thirds(pos, extent, parts: int = 3) -> Column:
    """Cell index of a position when edges lie at ``k * extent // parts``."""
    return F.floor((parts * _c(pos) + parts - 1) / _c(extent)).cast("int")


def tail_thirds(pos, extent) -> Column:
    """Cell index when cells are ``extent // 3`` wide and the last takes the remainder."""
    return F.least(F.floor(_c(pos) / F.floor(_c(extent) / 3)), F.lit(2)).cast("int")


def relative_error(predicted, observed) -> Column:
    """Error bounded by 1; null where either side is unknown."""
    p, o = _c(predicted), _c(observed)
    error = F.when((p == 0) & (o == 0), 0.0).otherwise(F.least(F.lit(1.0), F.abs(p - o) / F.greatest(F.lit(1.0), o)))
    # least() skips nulls, so unknown sides are kept apart.
    return F.when(p.isNotNull() & o.isNotNull(), error)


def horizon_steps(seconds: float, interval: float = K.SAMPLE_INTERVAL) -> int:
    return max(1, round(seconds / interval))
