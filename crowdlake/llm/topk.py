"""Exact top-k inner products by aggregation without random access.

Vectors are dealt into blocks. Within a block every component is a sorted list; queries read their lists from
the end that helps most, keep for each vector a lower and an upper bound of the score, and stop when no vector
outside the best can still qualify. The survivors' scores are resolved, and the blocks' best rows are
merged. Equal vectors are one entry with the smallest ids that could ever be returned.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdlake.operators.materialize import materialize


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, or null if the vector or a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(scale * x.cast("double")).cast("long")))


class SortedLists:
    """The block's vectors (n x d) as one sorted list a component, known by each vector's place in it."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        order = np.argsort(vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(vectors, order, axis=0)
        self.place = np.empty(vectors.shape, np.int32)
        np.put_along_axis(self.place, order, np.arange(len(vectors), dtype=np.int32)[:, None], axis=0)

    def best(self, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the rows, with exact scores, that may be among the block's ``k`` best or tie with them.

        All queries read their lists to the same depth, from the high end for a positive component and from
        the low end for a negative one. What a vector's lists have shown is summed; the rest lies between
        the list's far end and the value at the depth. The depth doubles until no other row can qualify.
        """
        n, d = self.vectors.shape
        queries = np.pad(queries, ((0, 0), (0, max(0, d - queries.shape[1]))))[:, :d]
        largest = float(max(np.abs(self.vectors).max(initial=0), 1)) * float(max(np.abs(queries).max(initial=0), 1)) * max(d, 1)
        kind = np.float64 if largest < 2**52 else np.int64  # whole numbers either way
        vectors, weights = self.vectors.astype(kind), queries.T.astype(kind)
        up, down = np.maximum(weights, 0), np.minimum(weights, 0)
        out: list = [None] * len(queries)
        open_, depth = np.arange(len(queries)), max(32, n // 8)
        while len(open_):
            if depth >= n or n <= 4 * k:
                for q in open_:
                    out[q] = self._resolved(np.arange(n), queries[q], k)
                break
            high, low = (self.place >= n - depth).astype(kind), (self.place < depth).astype(kind)
            u, w = up[:, open_], down[:, open_]
            at_high, at_low = self.values[n - depth][:, None], self.values[depth - 1][:, None]
            first, last = self.values[0][:, None], self.values[-1][:, None]
            shown = (vectors * high) @ u + (vectors * low) @ w
            lower = shown + (1 - high) @ (u * first) + (1 - low) @ (w * last)
            upper = shown + (1 - high) @ (u * at_high) + (1 - low) @ (w * at_low)
            bar = np.partition(lower, n - k, axis=0)[n - k]
            left = upper >= bar
            done = left.sum(axis=0) <= 4 * k
            for i in np.flatnonzero(done):
                out[open_[i]] = self._resolved(np.flatnonzero(left[:, i]), queries[open_[i]], k)
            open_ = open_[~done]
            depth *= 2
        return out

    def _resolved(self, rows: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        scores = self.vectors[rows] @ query
        if len(rows) > k:
            keep = scores >= np.partition(scores, len(rows) - k)[len(rows) - k]
            rows, scores = rows[keep], scores[keep]
        return rows, scores


def _search(k: int, together: int = 256):
    def of_block(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(entries) and len(queries):
            lists, ids = SortedLists(_matrix(entries["q"])), entries["ids"].tolist()
            asked, names = _matrix(queries["q"]), queries["vec_id"].tolist()
            for i in range(0, len(asked), together):
                found = lists.best(asked[i : i + together], k + 1)
                for query_id, (rows, scores) in zip(names[i : i + together], found, strict=True):
                    hits = [(-s, v) for r, s in zip(rows.tolist(), scores.tolist(), strict=True) for v in ids[r] if v != query_id]
                    for s, v in sorted(hits)[:k]:
                        out["query_id"].append(query_id)
                        out["vec_id"].append(v)
                        out["score"].append(-s)
        return pd.DataFrame(out).astype("int64")

    return of_block


def _matrix(vectors: pd.Series) -> np.ndarray:
    width = max(map(len, vectors))
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def search(
    vectors: DataFrame, queries: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding", entries: int = 4096, batch: int = 1024
) -> DataFrame:
    """The ``k`` rows of highest integer inner product for each row where ``queries`` holds.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller id. A query's own id is no
    candidate. Rows whose id is null, or whose vector is null or has null or non-finite components, take no
    part; fully repeated rows count once. Missing trailing components count as zero. Queries with fewer
    than ``k`` candidates return all of them; an empty table returns none.

    The query set meets all rows in blocks: about ``entries`` vectors and ``batch`` queries a task.
    """
    rows = vectors.select(F.col(id).alias("vec_id"), quantized(F.col(vector)).alias("q"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = materialize(rows.where("vec_id is not null and q is not null"))
    few = Window.partitionBy("q").orderBy("vec_id")
    one = (
        rows.select("vec_id", "q").distinct()
        .withColumn("place", F.row_number().over(few)).where(F.col("place") <= k + 1)
        .groupBy("q").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    asked = rows.where("asks").select("vec_id", "q").distinct()
    n_blocks = max(1, math.ceil(rows.count() / entries))
    n_batches = max(1, math.ceil(asked.count() / batch))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = one.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(n_blocks)).cast("int")).withColumn("batch", every(n_batches))
    asked = asked.withColumn("batch", F.pmod(F.xxhash64("vec_id"), F.lit(n_batches)).cast("int")).withColumn("block", every(n_blocks))
    near = one.groupBy("block", "batch").cogroup(asked.groupBy("block", "batch")).applyInPandas(
        _search(k), "query_id long, vec_id long, score long"
    )
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
