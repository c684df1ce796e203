"""Sliding history per camera: windows in seconds that restart when the scene empties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from crowdlake.constants import MIN_CROWD
from crowdlake.operators.scale import TIMELESS, Width, chunk_width, home_rows, with_time_halo

CAMERA = ["camera_id"]


def _present(
    df: DataFrame, keys: Sequence[str], seconds: float, id_col: str, present: Column | None, width: Width, parts: int | None = None
):
    """Rows with a crowd, halo included, and the columns within which histories run."""
    if int(seconds) != seconds:
        raise ValueError("history windows are whole seconds")
    d = with_time_halo(df, chunk_width(df, keys, "t", width), before=seconds)
    group = [*keys, "_chunk"]
    # Dealt by chunk once, before any row is copied within its chunk.
    d = d.repartition(parts, *group) if parts else d.repartition(*group)
    if present is not None:
        w = Window.partitionBy(*group).orderBy("t", id_col).rowsBetween(Window.unboundedPreceding, 0)
        d = d.withColumn("_seg", F.sum(F.when(present, 0).otherwise(1)).over(w)).where(present)
        group.append("_seg")
    return d, group


def history_window(
    df: DataFrame,
    seconds: float = 30.0,
    maxlen: int = 150,
    fields: Sequence[str] = ("density", "motion", "turbulence"),
    keys: Sequence[str] = CAMERA,
    id_col: str = "frame_id",
) -> DataFrame:
    """Series of ``fields`` over each row's history: entries of the last ``seconds``, at most
    ``maxlen``, since the scene was last empty."""
    d, group = _present(df, keys, seconds, id_col, F.col("density") >= MIN_CROWD, None)
    w = Window.partitionBy(*group).orderBy("t").rangeBetween(-int(seconds), 0)
    entry = F.struct("t", *fields)
    series = F.array_sort(F.collect_list(entry).over(w))
    d = d.withColumn("series", F.slice(series, F.greatest(F.size(series) - maxlen + 1, F.lit(1)), maxlen))
    return home_rows(d).drop("_seg")


def growth_rate(
    df: DataFrame,
    col: str = "density",
    seconds: float = 10.0,
    keys: Sequence[str] = CAMERA,
    id_col: str = "frame_id",
    present: Column | None = None,
    out: str = "growth",
    width: Width = None,
    parts: int | None = None,
) -> DataFrame:
    """Least-squares slope of ``col`` on time over its mean, per second; 0 below three entries.

    Adds ``out`` and ``out_n``. With ``present``, history restarts at rows where it fails and those rows are left out.
    Chunks are dealt into ``parts`` partitions if given.

    A chunk is cut into blocks a little shorter than the history. A row's history is then its own block up to the row
    and the end of the blocks before: one running set of moments forwards, one backwards, merged without subtraction.
    The work grows with the rows, however many of them a history holds.
    """
    chunk = F.least(chunk_width(df, keys, "t", width), F.lit(5.0 * seconds))
    d, group = _present(df, keys, seconds, id_col, present, chunk, parts)
    step = 0.999 * seconds
    own = F.coalesce(F.floor(F.col("t") / step), F.lit(TIMELESS))
    reached = F.coalesce(F.floor((F.col("t") + (seconds + 1e-3)) / step), F.lit(TIMELESS))
    d = d.withColumn("_own", own).withColumn("_block", F.explode(F.sequence(own, reached)))
    group = [*group, "_block"]
    home = F.col("_own") == F.col("_block")
    d = d.withColumn("_from", F.when(home, F.col("t") - seconds).otherwise(F.col("t")))
    # Time from the block's start keeps the sums of squares small.
    d = d.withColumn("_dt", F.col("t") - F.col("_block") * step).withColumn("_y", F.col(col).cast("double"))

    def moments(side: Column, w) -> Column:
        x, y = F.when(side & F.col("_y").isNotNull(), F.col("_dt")), F.when(side, F.col("_y"))
        sums = {"rows": F.count(F.when(side, 1)), "since": F.min(F.when(side, F.col("t"))), "k": F.count(x), "x": F.sum(x), "y": F.sum(y)}
        sums |= {"xx": F.regr_sxx(y, x), "xy": F.regr_sxy(y, x)}
        zero = {"rows", "since"}
        return F.struct(*[(v.over(w) if n in zero else F.coalesce(v.over(w), F.lit(0))).alias(n) for n, v in sums.items()])

    whole = (Window.unboundedPreceding, Window.currentRow)
    upto = Window.partitionBy(*group).orderBy("t").rangeBetween(*whole)
    back = Window.partitionBy(*group).orderBy(F.col("_from").desc()).rangeBetween(*whole)
    # Backwards first: copies are needed no longer then.
    d = d.withColumn("_b", moments(~home, back)).where(home).withColumn("_a", moments(F.lit(True), upto))
    a, b = (lambda n: F.col("_a")[n]), (lambda n: F.col("_b")[n])
    k = a("k") + b("k")
    both = (a("k") > 0) & (b("k") > 0)
    apart = a("k").cast("double") * b("k") / k

    def merged(product: str, u: str, v: str) -> Column:
        between = (a(u) / a("k") - b(u) / b("k")) * (a(v) / a("k") - b(v) / b("k")) * apart
        return a(product) + b(product) + F.when(both, between).otherwise(0.0)

    xx = merged("xx", "x", "x")
    slope = F.when(xx != 0, merged("xy", "x", "y") / F.nullif(xx, F.lit(0.0)))
    mean = F.greatest(F.when(k > 0, (a("y") + b("y")) / k), F.lit(1e-6))
    n = a("rows") + b("rows")
    rate = F.when((n >= 3) & (F.col("t") > F.least(a("since"), b("since"))), slope / mean).otherwise(0.0)
    d = d.withColumn(out, rate).withColumn(f"{out}_n", n)
    return home_rows(d.drop("_a", "_b", "_own", "_block", "_from", "_dt", "_y", "_seg"))
