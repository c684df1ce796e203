"""Ordered computation per key without ever placing a whole key in one task.

A camera's timeline is cut into chunks of time, shortened until the busiest holds about a million
rows, or into chunks of an exact number of rows. Three building blocks cover every ordered operator
of the library:

* a *halo*: rows a neighbouring chunk needs for its frames are copied into it, windows run
  per (key, chunk) and only home rows are kept;
* a *running* value: per-chunk totals, one row per chunk, are accumulated over the chunks of
  a key and added to the value accumulated inside the chunk;
* *row numbers*, a running count, which allow chunks of an exact number of rows.

Only chunk totals are ever ordered per whole key; they grow with elapsed time, not with rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from crowdlake.constants import BLOCK_ROWS, CHUNK_ROWS, CHUNK_SECONDS, SMALL_TASK_ROWS, TASK_ROWS


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


# A chunk length: seconds, a column made by ``chunk_width``, or None for the automatic choice.
Width = float | Column | None


def chunk_width(df: DataFrame, keys: Sequence[str], t: str, width: Width = None) -> Column:
    """Chunk length: ``width`` if given, else the longest for which the busiest minute of any key
    would fill a chunk with at most ``CHUNK_ROWS`` rows, between a second and ``CHUNK_SECONDS``.

    The automatic choice is a scalar subquery over per-minute counts: no extra job, no collected rows.
    Pass ``width`` where the rate of rows is bounded anyway, as after a throttle. Operators made of
    several steps choose once, on their input, and pass the choice on.
    """
    if isinstance(width, Column):
        return width
    if width is not None:
        return F.lit(float(width))
    probe = 60.0
    busiest = df.groupBy(*keys, F.floor(F.col(t) / probe).alias("_minute")).agg(F.count(F.lit(1)).alias("_n"))
    fitting = F.floor(F.lit(probe * CHUNK_ROWS) / F.max("_n"))
    length = F.greatest(F.lit(1.0), F.least(F.lit(CHUNK_SECONDS), fitting))
    return busiest.agg(F.coalesce(length, F.lit(CHUNK_SECONDS)).alias("w")).scalar()


def chunk_of(t: str, width: Column) -> Column:
    return F.floor(F.col(t) / width)


def with_time_halo(
    df: DataFrame, width: Column, t: str = "t", before: float = 0.0, after: float = 0.0
) -> DataFrame:
    """Add ``_chunk`` and ``_home``; a row is copied to each chunk whose frames reach it.

    ``before``/``after`` are the seconds a frame looks back/ahead. Extra copies are harmless, so
    the reach is widened slightly against rounding. A chunk is never shorter than twice the reach: however
    dense one key is, a row is copied about one and a half times. Rows with a null time share a chunk.
    """
    slack = 1e-3
    width = chunk_for(width, before + after)
    lo = F.coalesce(F.floor((F.col(t) - (after + slack if after else 0.0)) / width), F.lit(TIMELESS))
    hi = F.coalesce(F.floor((F.col(t) + (before + slack if before else 0.0)) / width), F.lit(TIMELESS))
    home = F.coalesce(chunk_of(t, width), F.lit(TIMELESS))
    return df.withColumn("_home", home).withColumn("_chunk", F.explode(F.sequence(lo, hi)))


# The chunk of rows without a time.
TIMELESS = -(1 << 62)


def chunk_for(width: Column, reach: float) -> Column:
    """``width``, but at least twice the seconds that a frame reaches."""
    return F.greatest(width, F.lit(2.0 * reach)) if reach else width


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on ``keys``, where null equals null; the keys are the left ones."""
    theirs = right.select(*[F.col(k).alias(f"_right_{k}") if k in keys else F.col(k) for k in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(theirs, on, how).drop(*[f"_right_{k}" for k in keys])


def home_rows(df: DataFrame) -> DataFrame:
    return df.where("_home = _chunk").drop("_home", "_chunk")


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, tuple[str, Column]],
    t: str = "t",
    width: Width = None,
    parts: int | None = None,
) -> DataFrame:
    """Running values per key in ``order``: ``values`` maps an output name to (kind, expression).

    Kinds are ``sum``, ``max`` and ``last`` (newest non-null); ``max_before`` and ``last_before`` leave
    out the current row. Chunks are dealt into ``parts`` partitions if given.
    """
    d = df.withColumn("_chunk", chunk_of(t, chunk_width(df, keys, t, width)))
    for name, (_, expr) in values.items():
        d = d.withColumn(f"_in_{name}", expr)
    kinds = {name: kind.removesuffix("_before") for name, (kind, _) in values.items()}

    stamp = F.struct(*_cols(order))
    totals = []
    for name, kind in kinds.items():
        v = F.col(f"_in_{name}")
        total = F.max_by(v, F.when(v.isNotNull(), stamp)) if kind == "last" else getattr(F, kind)(v)
        totals.append(total.alias(f"_tot_{name}"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = d.groupBy(*keys, "_chunk").agg(*totals)
    carry = carry.select(
        *keys, "_chunk", *[_over(k, F.col(f"_tot_{n}"), earlier).alias(f"_carry_{n}") for n, k in kinds.items()]
    )

    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    local = []
    if parts:
        d = d.repartition(parts, *keys, "_chunk")
    for name, (kind, _) in values.items():
        frame = inside.rowsBetween(Window.unboundedPreceding, -1 if kind.endswith("_before") else 0)
        local.append(_over(kinds[name], F.col(f"_in_{name}"), frame).alias(f"_loc_{name}"))
    d = join_keys(d.select("*", *local), carry, [*keys, "_chunk"])

    out = {}
    for name, kind in kinds.items():
        a, b = F.col(f"_loc_{name}"), F.col(f"_carry_{name}")
        if kind == "sum":
            out[name] = F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        else:
            out[name] = F.greatest(a, b) if kind == "max" else F.coalesce(a, b)
    kept = [c for c in df.columns if c not in out]
    return d.select(*kept, *[c.alias(n) for n, c in out.items()])


def _over(kind: str, value: Column, window) -> Column:
    agg = F.last(value, ignorenulls=True) if kind == "last" else getattr(F, kind)(value)
    return agg.over(window)


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    t: str = "t",
    width: Width = None,
) -> DataFrame:
    """Values of the preceding row of the key (``lag``), nulls included."""
    packed = F.struct(*[e.alias(n) for n, e in values.items()])
    d = with_running(df, keys, order, {"_prev": ("last_before", packed)}, t, width)
    return d.select("*", *[F.col("_prev")[n].alias(n) for n in values]).drop("_prev")


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    t: str = "t",
    width: Width = None,
    name: str = "rn",
    parts: int | None = None,
) -> DataFrame:
    """1-based row number per key."""
    return with_running(df, keys, order, {name: ("sum", F.lit(1))}, t, width, parts).withColumn(
        name, F.col(name).cast("bigint")
    )


def with_row_halo(df: DataFrame, before: int, after: int = 0, size: int = BLOCK_ROWS, rn: str = "rn") -> DataFrame:
    """Like :func:`with_time_halo` for frames of an exact number of rows."""
    pos = F.col(rn) - 1
    lo = F.greatest(F.floor((pos - after) / size), F.lit(0).cast("bigint"))
    hi = F.floor((pos + before) / size)
    return df.withColumn("_home", F.floor(pos / size)).withColumn("_chunk", F.explode(F.sequence(lo, hi)))


def chunk_window(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, "_chunk").orderBy(*order)


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    direction: str = "backward",
    tolerance: float | None = None,
    t: str = "t",
    width: Width = None,
) -> DataFrame:
    """Attach to each left row the nearest right row at or before (``backward``) / at or after
    (``forward``) its time, within ``tolerance`` seconds. Adds ``values`` and ``matched_t``.

    One exchange of the union of both sides; no range join. Without tolerance a backward match is
    a running *last* over chunks.
    """
    packed = [F.col(v) for v in values]
    r = right.select(
        *keys, F.col(t).alias(t), F.struct(F.col(t).alias("_rt"), *packed).alias("_match")
    )
    sides = left.withColumn("_side", F.lit(0)).unionByName(
        r.withColumn("_side", F.lit(1)), allowMissingColumns=True
    )
    forward = direction == "forward"
    if tolerance is None:
        if forward:
            sides = sides.withColumn("_key_t", -F.col(t)).withColumn("_seq", -F.col("_side"))
        else:
            sides = sides.withColumn("_key_t", F.col(t)).withColumn("_seq", -F.col("_side"))
        out = with_running(
            sides, keys, ["_key_t", "_seq"], {"_hit": ("last", F.col("_match"))}, t="_key_t", width=width
        ).drop("_key_t", "_seq")
    else:
        tol = float(tolerance)
        reach = {"after": tol} if forward else {"before": tol}
        length = chunk_width(sides, keys, t, width)
        halo = with_time_halo(sides.where("_side = 1"), length, t, **reach)
        core = with_time_halo(sides.where("_side = 0"), chunk_for(length, tol), t)
        both = core.unionByName(halo)
        order = [t, "_side"] if forward else [t, F.desc("_side")]
        w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
        if forward:
            hit = F.first("_match", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
        else:
            hit = F.last("_match", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        out = both.withColumn("_hit", hit).drop("_home", "_chunk")
        gap = F.abs(F.col("_hit._rt") - F.col(t))
        out = out.withColumn("_hit", F.when(gap <= tol, F.col("_hit")))
    out = out.where("_side = 0")
    return out.select(
        *[c for c in left.columns],
        *[F.col("_hit")[v].alias(v) for v in values],
        F.col("_hit._rt").alias("matched_t"),
    )


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Partition by ``cols`` into the configured number of shuffle partitions, for steps whose cost lies
    in computing: adaptive execution merges partitions by bytes alone."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def task_parts(df: DataFrame) -> int:
    """Partitions into which the rows of ``df`` should be dealt where each task sorts or groups its rows in memory.

    The configured number, fewer for a small table and more once a task would get over ``TASK_ROWS`` rows. Adaptive
    execution merges by compressed bytes, and 64 MB of narrow rows can be several million. Counts ``df`` in a job of its own.
    """
    rows = df.count()
    configured = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, math.ceil(rows / TASK_ROWS), min(configured, math.ceil(rows / SMALL_TASK_ROWS)))


def frame_percentile(value: Column | str, q: float, window) -> Column:
    """Linear-interpolated percentile of the non-null values in a short row frame."""
    ordered = F.sort_array(F.collect_list(value).over(window))

    def interpolate(a):
        rank = F.lit(q) * (F.size(a) - 1)
        lo, hi = F.floor(rank).cast("int"), F.ceil(rank).cast("int")
        low = F.get(a, lo)
        return low + (F.get(a, hi) - low) * (rank - lo)

    # One-element transform: the frame is collected and sorted once.
    return F.get(F.transform(F.array(ordered), interpolate), F.lit(0))


def exact_percentile(
    df: DataFrame, keys: Sequence[str], value: str, q: float, name: str = "pct", accuracy: int = 10_000
) -> DataFrame:
    """Linear-interpolated percentile per key for groups of any size.

    A mergeable sketch brackets the wanted rank; values below the bracket are only counted and the
    few inside it are reduced to distinct values before they are ordered.
    """
    v = F.col(value).cast("double")
    d = df.where(v.isNotNull()).select(*keys, v.alias("_v"))
    eps = 3.0 / accuracy
    bracket = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", F.array(F.lit(max(0.0, q - eps)), F.lit(min(1.0, q + eps))), accuracy).alias("_b"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
    )
    bracket = bracket.select(
        *keys,
        "_n",
        F.when(F.lit(q - eps <= 0), F.col("_min")).otherwise(F.col("_b")[0]).alias("_lo"),
        F.when(F.lit(q + eps >= 1), F.col("_max")).otherwise(F.col("_b")[1]).alias("_hi"),
    )
    # A rank may fall one row outside the bracket: keep the neighbours on both sides of it.
    j = d.join(bracket, list(keys))
    slot = F.when(F.col("_v") < F.col("_lo"), F.lit(0)).when(F.col("_v") <= F.col("_hi"), F.lit(1)).otherwise(F.lit(2))
    counts = (
        j.withColumn("_slot", slot)
        .withColumn("_dv", F.when(F.col("_slot") == 1, F.col("_v")))
        .groupBy(*keys, "_slot", "_dv")
        .agg(
            F.count(F.lit(1)).alias("_c"),
            *[F.min("_v").alias("_first"), F.max("_v").alias("_last"), F.max("_n").alias("_n")],
            *[F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi")],
        )
    )
    # Even the few values inside are ordered in 256 slices of the bracket.
    span = F.col("_hi") - F.col("_lo")
    slice_no = F.when(span > 0, F.floor((F.col("_dv") - F.col("_lo")) / span * 255)).otherwise(F.lit(0))
    counts = counts.withColumn(
        "_slice", F.when(F.col("_slot") == 0, -1).when(F.col("_slot") == 2, 256).otherwise(slice_no).cast("double")
    )
    ranked = with_running(counts, keys, ["_slot", "_dv"], {"_end": ("sum", F.col("_c"))}, "_slice", 1.0)
    ranked = ranked.withColumn("_start", F.col("_end") - F.col("_c"))
    rank = F.lit(q) * (F.col("_n") - 1)
    lo_rank, hi_rank = F.floor(rank), F.ceil(rank)

    def at(r: Column) -> Column:
        return F.max(F.when((r >= F.col("_start")) & (r < F.col("_end")), F.when(F.col("_slot") == 0, F.col("_last")).otherwise(F.col("_first"))))

    out = ranked.groupBy(*keys).agg(at(lo_rank).alias("_a"), at(hi_rank).alias("_z"), F.max(rank - lo_rank).alias("_f"))
    return out.select(*keys, (F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_f")).alias(name))


def keep_latest(df: DataFrame, keys: Sequence[str], n: int, order: Sequence[str]) -> DataFrame:
    """Newest ``n`` rows per key, by ``order`` descending.

    A first ranking is spread over as many salts as there are shuffle partitions, so that a hot key's rows
    are never ranked in one task; at most ``n`` of each salt are ranked again.
    """
    newest = [F.col(c).desc() for c in order]
    if not keys:
        return df.orderBy(*newest).limit(n)
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = Window.partitionBy(*keys, "_part").orderBy(*newest)
    df = (
        df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(salts)))
        .withColumn("_r", F.row_number().over(first))
        .where(F.col("_r") <= n)
        .drop("_part", "_r")
    )
    final = Window.partitionBy(*keys).orderBy(*newest)
    return df.withColumn("_r", F.row_number().over(final)).where(F.col("_r") <= n).drop("_r")
