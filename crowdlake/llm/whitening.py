"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows are a tall matrix X. From a unit vector v the alternating products u = Xv and Xᵀu, each made
orthogonal to all earlier vectors of its kind, give X = U B Vᵀ with a small bidiagonal B. Its singular value
decomposition yields the components (V times the right vectors) and the deviations (singular values over sqrt(n)).

A left vector u has an entry for every row, but is always X p for a short p. So p is kept instead, tasks make u from
their own rows, and one pass over the table serves both products of a step. Each task returns one sum per dimension.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdlake.operators.materialize import materialize

#: Squares below this share of the largest are rounding: products of doubles are not exact.
DUST = 1e-13
#: What :func:`whitened` adds.
ADDED = ["component", "n", "deviation", "whitened", "explained", "identity_error"]


def quantized(vector: Column, scale: int = 1024, shift: int = 100_000) -> Column:
    """``floor(scale * c) + shift`` of each component, or null if the vector or a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(scale * x.cast("double")).cast("long") + F.lit(shift).cast("long")))


def _matrix(vectors: pd.Series, d: int) -> np.ndarray:
    """The batch's vectors as rows, exact whole numbers."""
    return np.concatenate(vectors.to_numpy()).reshape(len(vectors), d) if len(vectors) else np.zeros((0, d), np.int64)


def _summed(rows: DataFrame, of_batch, size: int) -> np.ndarray:
    """The sum over all batches of ``of_batch(x)``, a float vector of ``size`` numbers. Tasks add their batches;
    Spark adds the tasks', one number at a time."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for b in batches:
            total += of_batch(b["x"])
        yield pd.DataFrame({"i": np.arange(size, dtype=np.int64), "v": total})

    sums = rows.select("x").mapInPandas(partial, "i long, v double").groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(size)
    for r in sums.collect():
        out[r.i] = r.v
    return out


class Bidiagonal:
    """The steps so far: right vectors V, short forms P of the left ones (u = X p), XᵀX P, and B."""

    def __init__(self, d: int):
        self.v: list[np.ndarray] = []
        self.p: list[np.ndarray] = []
        self.z: list[np.ndarray] = []
        self.alpha: list[float] = []
        self.beta: list[float] = []
        self.d = d

    def step(self, product, random: np.random.Generator) -> None:
        """One more column; ``product(q)`` is XᵀXq, both products in one pass."""
        v = self._next(random)
        if self.v:
            # The part of Xv along the last left vector is beta by construction; all parts are taken out anyway.
            z = product(v)
            q, w = self._freed(v.copy(), z.copy())
        else:
            q = v.copy()
            w = product(q)
        square = float(q @ w)
        alpha = np.sqrt(square) if square > DUST * max([*self.alpha, 0.0]) ** 2 else 0.0
        self.v.append(v)
        self.alpha.append(alpha)
        self.p.append(q / alpha if alpha else np.zeros(self.d))
        self.z.append(w / alpha if alpha else np.zeros(self.d))

    def _freed(self, q: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Xq without its parts along the earlier left vectors; ``w`` is XᵀXq. Twice is enough."""
        for _ in range(2):
            for p, z in zip(self.p, self.z, strict=True):
                part = float(p @ w)
                q, w = q - part * p, w - part * z
        return q, w

    def _next(self, random: np.random.Generator) -> np.ndarray:
        """Xᵀu less its parts along all right vectors, of length 1; where nothing is left, a new direction (beta 0)."""
        if not self.v:
            v = random.standard_normal(self.d)
            return v / np.linalg.norm(v)
        w = self._orthogonal(self.z[-1])
        beta = float(np.linalg.norm(w))
        if beta <= DUST * max([*self.alpha, 1e-300]):
            beta, w = 0.0, self._orthogonal(random.standard_normal(self.d))
        self.beta.append(beta)
        w = self._orthogonal(w / np.linalg.norm(w))
        return w / np.linalg.norm(w)

    def _orthogonal(self, w: np.ndarray) -> np.ndarray:
        basis = np.array(self.v)
        for _ in range(2):
            w = w - basis.T @ (basis @ w)
        return w

    def decomposed(self) -> tuple[np.ndarray, np.ndarray]:
        """Singular values of X, falling, and the right vectors as rows."""
        b = np.diag(self.alpha) + np.diag(self.beta, 1)
        _, s, right = np.linalg.svd(b)
        return s, right @ np.array(self.v)


def whitened(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = 8, steps: int | None = None) -> DataFrame:
    """One row for each vector and component: the id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries take no part, and neither do those of another length than
    the most frequent one (the longer of two equally frequent). Entries become x = floor(1024 c) + 100000. ``whitened`` is the
    centred x projected on the unit component and divided by its standard deviation, with divisor n; components are numbered
    from 1 by falling variance, of either sign. Components without variance (a constant table, fewer rows than components),
    or with less than ``DUST`` of the trace, are left out. ``deviation``, the sum of (n x - S)^2, is exact, and null where it passes 64 bits. ``explained`` is the share of the trace, ``identity_error`` the largest
    deviation of whitened's covariance from the identity. Null ids are kept, repeated rows count each time. An empty table
    gives no rows. Other columns are not carried.

    ``steps`` bidiagonalisation steps (default: as many as dimensions, which finds repeated variances too) take one pass each.
    The driver holds some vectors of one number per dimension; no row and no left vector reaches it.
    """
    spark = vectors.sparkSession
    x = vectors.select(F.col(id).alias("id"), quantized(F.col(vector)).alias("x")).where("x is not null")
    x = materialize(x)
    lengths = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    type_ = vectors.select(id).schema[0].dataType.simpleString()
    if lengths is None or lengths["d"] == 0:
        return spark.createDataFrame([], f"{id} {type_}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    d, n = lengths["d"], lengths["count"]
    x = x.where(F.size("x") == d)
    each = x.select(F.posexplode("x").alias("i", "v"))
    # Spark's whole numbers are exact: no sum of 64-bit numbers is rounded.
    sums = {r.i: int(r.s) for r in each.groupBy("i").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s")).collect()}
    total = [sums[i] for i in range(d)]
    # n * x stays within 64 bits up to about 10^13 rows.
    whole = np.array(total, dtype=np.int64)

    def centred(column: pd.Series) -> np.ndarray:
        return (_matrix(column, d) * n - whole) / n

    def product(q: np.ndarray) -> np.ndarray:
        def of_batch(column: pd.Series) -> np.ndarray:
            rows = centred(column)
            return rows.T @ (rows @ q)

        return _summed(x, of_batch, d)

    work = Bidiagonal(d)
    random = np.random.default_rng(11)
    for _ in range(min(steps or d, d)):
        work.step(product, random)
    singular, right = work.decomposed()
    trace = float(_summed(x, lambda column: np.array([(centred(column) ** 2).sum()]), 1)[0]) / n
    variance = singular**2 / n
    k = int(min(components, (variance > DUST * trace).sum())) if trace > 0 else 0
    axes, variance = right[:k], variance[:k]
    share = variance / trace if k else variance

    def projected(column: pd.Series) -> np.ndarray:
        return centred(column) @ axes.T / np.sqrt(variance)

    def moments(column: pd.Series) -> np.ndarray:
        w = projected(column)
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    sums_ = _summed(x, moments, k + k * k)
    mean = sums_[:k] / n
    covariance = sums_[k:].reshape(k, k) / n - np.outer(mean, mean)
    error = float(np.abs(covariance - np.eye(k)).max()) if k else 0.0

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not k or not len(b):
                continue
            far = _matrix(b["x"], d) * n - whole
            if d * float(np.abs(far.astype(float)).max()) ** 2 < 2.0**62:
                deviation = (far * far).sum(axis=1).tolist()
            else:
                exact = [sum(v * v for v in row) for row in far.tolist()]
                deviation = [v if v < 2**63 else None for v in exact]
            yield pd.DataFrame({
                "id": b["id"], "deviation": pd.array(deviation, dtype="Int64"), "w": list(projected(b["x"])),
            })

    out = x.select("id", "x").mapInPandas(rows, f"id {type_}, deviation long, w array<double>")
    shares = F.array(*[F.lit(float(s)) for s in share]) if k else F.array().cast("array<double>")
    return out.select("id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        F.col("id").alias(id),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
