"""SimHash near-duplicates: fingerprints linked through one-wildcard segment variants.

A 64-bit fingerprint is cut into three segments. Of two fingerprints that differ in at most four bits, one
segment differs in at most one bit: the segment is equal, or equal with one bit deleted. Each fingerprint is
indexed under its three segments and under every segment with one bit deleted; equal keys meet, and the
whole fingerprints are compared. Under a deletion key only fingerprints with unlike deleted bits meet, so a
pair is looked at once for a segment. Keys with very many fingerprints are searched in blocks that return
spanning links instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdlake.llm.common import small_batches
from crowdlake.llm.components import components
from crowdlake.operators.materialize import materialize

SHINGLE = 4
SEED = 42
#: Widths of the segments, lowest bits first.
SEGMENTS = (22, 21, 21)
LINK = 4
#: Crowded keys that tasks hold at once, some tens of megabytes.
SMALL = 300_000


def fingerprint_of(text: str | None) -> int:
    """SimHash over the shingles of one whole text, as a signed 64-bit number; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(words) - SHINGLE + 1)
    stops = ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[:last].tolist(), stops.tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, last, 65536):
        bits = np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view(np.int64)[0])


def _column():
    @F.pandas_udf("long")
    def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([fingerprint_of(x) for x in part], dtype="int64")

    return fingerprint


def with_fingerprint(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint (long) of each whole text; null and empty texts have 0."""
    small_batches(docs.sparkSession)
    return docs.withColumn(into, _column()(F.col(text)))


def _keys(fp: Column) -> Column:
    """Index entries of a fingerprint: (key, bit). ``bit`` is the deleted bit, or null for a whole segment."""
    entries, low = [], 0
    for s, width in enumerate(SEGMENTS):
        segment = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))
        entries.append(F.struct((segment + F.lit((65 + s) << 32)).alias("key"), F.lit(None).cast("int").alias("bit")))
        for p in range(width):
            kept = segment.bitwiseAND(F.lit((1 << width) - 1 - (1 << p)))
            bit = F.shiftrightunsigned(fp, low + p).bitwiseAND(F.lit(1)).cast("int")
            entries.append(F.struct((kept + F.lit((low + p) << 32)).alias("key"), bit.alias("bit")))
        low += width
    return F.array(*entries)


def _spanning(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever links of at most LINK bits connect, by breadth-first search."""
    rest, ends, starts = prints.copy(), [], []
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count(rest ^ x) <= LINK
            if near.any():
                found = rest[near]
                rest = rest[~near]
                ends.append(found)
                starts.append(np.full(len(found), x))
                todo.extend(found)
    none = np.empty(0, prints.dtype)
    return np.concatenate([none, *ends]), np.concatenate([none, *starts])


def _block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    u, v = _spanning(np.unique(pdf["fp"].to_numpy(np.int64).view(np.uint64)))
    return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})


def links(prints: DataFrame, dense: int = 64, block: int = 4096) -> DataFrame:
    """Links (u, v) between the distinct fingerprints ``fp`` that connect all pairs within LINK bits.

    Keys of at most ``dense`` fingerprints give every pair. Members of a key with more are dealt into blocks
    of about ``block`` and each pair of blocks gives the links of a spanning forest: no connection is lost,
    and a key with n members gives no more than about n links for each of its blocks.

    Index entries are never broadcast: before it ran, Spark sizes them like the fingerprints they are expanded from.
    """
    keyed = prints.select("fp", F.inline(_keys(F.col("fp"))))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n"))
    crowded = materialize(counts.where(F.col("n") > dense))
    crowded = F.broadcast(crowded) if crowded.count() <= SMALL else crowded.hint("merge")
    sparse = keyed.join(crowded.select("key"), "key", "left_anti")
    left = sparse.where("bit is null or bit = 0").select("key", F.col("fp").alias("u"), F.col("bit").isNull().alias("whole"))
    right = sparse.where("bit is null or bit = 1").select("key", F.col("fp").alias("v"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= LINK
    pairs = left.join(right.hint("merge"), "key").where(near & (~F.col("whole") | (F.col("u") < F.col("v")))).select("u", "v")

    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least("mine", b).alias("a"), F.greatest("mine", b).alias("b")))
    dealt = (
        keyed.drop("bit").join(crowded, "key").withColumn("blocks", blocks).withColumn("mine", mine)
        .select("key", "fp", F.inline(met))
    )
    forest = dealt.groupBy("key", "a", "b").applyInPandas(_block_links, "u long, v long")
    return pairs.unionByName(forest)


def classes(prints: DataFrame) -> DataFrame:
    """``(fp, component_id, root)`` from rows (fp, id): the least id among all fingerprints reachable over links.

    Null ids are never the least; a component of null ids only has a null component_id. The root is one
    fingerprint of the component.
    """
    known = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(known))
    member = known.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return member.join(least, "root").select("fp", "component_id", "root")


def grouped(printed: DataFrame, id: str = "doc_id", root: str | None = None) -> DataFrame:
    """Rows with a long ``fingerprint``: that as 16 hex digits, and component_id, the least ``id`` of the group.

    No row is dropped; rows with a null id get a group like any other. ``root`` names a column for one
    fingerprint of the group, which tells groups apart that have no id.
    """
    printed = materialize(printed)
    found = classes(printed.select(F.col("fingerprint").alias("fp"), F.col(id).alias("id"))).withColumnRenamed("fp", "fingerprint")
    found = found.withColumnRenamed("root", root) if root else found.drop("root")
    # No broadcast of the rows: they may take much less space in files than in memory.
    return printed.hint("merge").join(found, "fingerprint").select(
        *[c for c in printed.columns if c != "fingerprint"], F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id", *([root] if root else []),
    )


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with fingerprint (16 hex digits) and component_id, the least ``id`` of the near-duplicate group.

    Texts without a word share fingerprint zero and so a group. Columns named like the added ones are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("fingerprint", "component_id")])
    return grouped(with_fingerprint(docs, text), id)


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each near-duplicate group, that of the least id, with the columns of ``docs``.

    Repeated rows of that id leave one; a group of null ids leaves one. Columns may have any name.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id).alias("id"), F.xxhash64(*docs.columns).alias("hash"), F.col(text).alias("text"))
    lone = F.when(F.col("component_id").isNull(), F.col("root"))
    ranked = Window.partitionBy("component_id", lone).orderBy(F.col("id").asc_nulls_last(), "hash")
    return (
        grouped(with_fingerprint(rows, "text").drop("text"), "id", "root")
        .where(F.col("component_id").isNull() | (F.col("id") == F.col("component_id")))
        .withColumn("rank", F.row_number().over(ranked))
        .where("rank = 1")
        .select("row.*")
    )
