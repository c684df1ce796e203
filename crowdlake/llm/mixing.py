"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Documents of a source are shuffled by a hash. Copy ``e`` of a document has the virtual finish time
``(e * source_size + cumulative size) / target``: at any virtual time all sources have got words in
proportion to their targets. The copies are range-sorted by finish time and cut at the total budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdlake.llm.common import WORD
from crowdlake.operators.materialize import materialize

#: What :func:`mix` adds.
ADDED = ["size", "source_size", "target", "copies", "taken"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_copies: int = 3) -> DataFrame:
    """Targets of sources, from one row per source (source, source_size).

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes. A target
    stops at ``max_copies`` times its source's size; the excess is shared again by weight. That fixed point
    is ``min(cap, level * weight)``: with the sources sorted by cap / weight, those are capped whose ratio
    is at most the level that the others would get. One row per source: the two global windows are small.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(place) - 1) % len(weights))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.col("capped_before")) / F.col("weight_left")
    return (
        sizes.withColumns({"weight": w, "cap": (max_copies * F.col("source_size")).cast("double")})
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumns({
            "capped_before": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "weight_left": F.sum("weight").over(rest),
        })
        .withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(Window.partitionBy()))
        .withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
        .select("source", "source_size", "target")
    )


def mix(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (1, 2, 3),
    max_copies: int = 3,
    digits: int = 3,
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with size (words), source_size, target (words), copies and taken (``copies * size``).

    No row is dropped: ``copies`` may be 0. Copies of one finish time are taken together or not at all.
    Null text has size 0; a null source is a source of its own; null ids are allowed. Documents of size 0
    take no words and get copies by the same rule. Fully repeated rows are interchangeable. Reruns agree,
    since the shuffle is a hash of id and text. Columns named like the added ones are replaced; others may have any name.

    A source's running size is a two-level sum over hash buckets (``digits`` hex digits: 4,096), so a hot source is spread
    over as many tasks; only one number, the finish time of the cut, goes through the driver.
    """
    kept = [c for c in docs.columns if c.lower() not in ADDED and (keep_text or c != text)]
    return _timed(docs, kept, id, text, source, weights, max_copies, digits).select("row.*", *ADDED)


def _timed(
    docs: DataFrame, kept: list[str], id: str, text: str, source: str, weights: tuple[float, ...], max_copies: int, digits: int
) -> DataFrame:
    """The columns ``kept`` of ``docs`` as one column ``row``, which no name can clash with, and what :func:`mix` adds."""
    spark = docs.sparkSession
    shuffled = F.md5(F.concat(F.coalesce(F.col(id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))))
    rows = docs.select(F.struct(*kept).alias("row"), word_count(F.col(text)).alias("size"), shuffled.alias("order"), F.col(source).alias("source"))
    # A key that is never null: one exchange of the rows then serves both the join and the running sum.
    key = F.concat(F.lit("s"), F.col("source").cast("string"))
    rows = materialize(rows.withColumns({"key": F.coalesce(key, F.lit("null")), "bucket": F.substring("order", 1, digits)}))

    sums = rows.groupBy("key", "source", "bucket").agg(F.sum("size").alias("bucket_size"))
    goals = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_copies)
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("key", F.col("source").alias("of"), "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("start"))
    starts = materialize(
        starts.join(goals, F.col("of").eqNullSafe(F.col("source"))).select("key", "bucket", "start", "source_size", "target")
    )
    run = Window.partitionBy("key", "bucket").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, 0)
    timed = rows.drop("source").join(starts, ["key", "bucket"]).withColumn("served", F.col("start") + F.sum("size").over(run))
    finish = [
        F.when(F.col("target") > 0, (F.col("source_size") * e + F.col("served")) / F.col("target")).otherwise(float(e))
        for e in range(max_copies)
    ]

    # Range-sort all copies; where the running total passes the budget is the cut.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    copies = timed.select("size", F.explode(F.array(*finish)).alias("finish"))
    sorted_copies = materialize(copies.repartitionByRange(n, "finish").withColumn("part", F.spark_partition_id()))
    parts = sorted_copies.groupBy("part").agg(F.sum("size").alias("part_size"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("part_start", F.coalesce(F.sum("part_size").over(upto), F.lit(0))).drop("part_size")
    budget = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("budget"))
    total = F.col("part_start") + F.sum("size").over(Window.partitionBy("part").orderBy("finish"))
    cut = (
        sorted_copies.join(parts, "part").join(F.broadcast(budget))  # one row
        .withColumn("total", total)
        .where("total <= budget").agg(F.max("finish")).first()[0]
    )
    taken = sum((F.when(f <= F.lit(cut), 1).otherwise(0) for f in finish), F.lit(0)) if cut is not None else F.lit(0)
    return (
        timed.withColumn("copies", taken.cast("int"))
        .withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
        .select("row", *ADDED)
    )


def mixed(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1, 2, 3),
    max_copies: int = 3, digits: int = 3,
) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``, whatever their names."""
    timed = _timed(docs, docs.columns, id, text, source, weights, max_copies, digits)
    return timed.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")
