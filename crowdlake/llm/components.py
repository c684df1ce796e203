"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdlake.operators.materialize import materialize


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star round; ``links`` are distinct (u, v) with u > v."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    to_low = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to_low.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(u, v)`` links in, ``(node, root)`` out for every linked node that is not the least of its component.

    Each round is written to the shared folder, so lineage stays short and a lost executor costs one round.
    Groups are only ever reduced to their least member; no neighbour list is built. The driver sees two
    numbers a round. Null ends and self links are ignored.
    """
    links = materialize(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    sign = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    last = sign(links)
    while last[0]:
        links = materialize(_stars(links))
        now = sign(links)
        if now == last:
            break
        last = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
