"""Ridge autoregression: the one forecaster whose per-origin solve has no built-in form.

A history is cut into blocks of some thousand origins, each with the 1000 rows before it, so one camera's origins
run on many tasks and little is read twice. The normal equations of all origins of a block come from running sums of
lagged products: a window that moves on by a row gains a product and loses one. They are solved as one batch, and the
recursion advances all origins at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from crowdlake import constants as K
from crowdlake.functions import scalars as S
from crowdlake.operators.scale import spread, with_row_halo

SERIES, CAP, PENALTY = 1000, 5760, 0.05
#: With 999 rows of lead-in a block reads a quarter more than its own rows.
ORIGINS_PER_BLOCK = 4000
#: Origins solved together: their matrices take some 10 MB.
TOGETHER = 2000


def _running(x: np.ndarray) -> np.ndarray:
    return np.concatenate(([0.0], np.cumsum(x)))


class _Sums:
    """Running sums of a block's values and of their products ``lags`` apart, about the block's mean."""

    def __init__(self, values: np.ndarray):
        self.shift = float(values.mean())
        self.v = values - self.shift
        self.single = _running(self.v)
        self.products: list[np.ndarray] = []

    def product(self, k: int) -> np.ndarray:
        while len(self.products) <= k:
            n = len(self.products)
            self.products.append(_running(self.v[: len(self.v) - n] * self.v[n:]) if n < len(self.v) else np.zeros(1))
        return self.products[k]

    def moments(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean (about the shift) and scale of ``values[start:end]``."""
        n = ends - starts
        mean = (self.single[ends] - self.single[starts]) / n
        square = self.product(0)
        variance = (square[ends] - square[starts]) / n - mean * mean
        return mean, np.maximum(1.0, np.sqrt(np.maximum(variance, 0.0)))

    def coefficients(self, starts: np.ndarray, ends: np.ndarray, lags: int, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Intercept and weights (oldest lag first) of each origin's ridge, from the normalized series."""
        m, n = len(starts), (ends - starts - lags).astype(float)
        low, high = starts, ends - lags
        sums = np.stack([self.single[high + p] - self.single[low + p] for p in range(lags + 1)], axis=1)
        gram = np.empty((m, lags + 2, lags + 2))
        for p in range(lags + 1):
            for q in range(p, lags + 1):
                total = self.product(q - p)
                raw = total[high + p] - total[low + p]
                z = (raw - mean * (sums[:, p] + sums[:, q]) + n * mean * mean) / (scale * scale)
                gram[:, p + 1, q + 1] = gram[:, q + 1, p + 1] = z
        gram[:, 0, 0] = n
        gram[:, 0, 1:] = gram[:, 1:, 0] = (sums - n[:, None] * mean[:, None]) / scale[:, None]
        penalty = np.eye(lags + 1) * PENALTY
        penalty[0, 0] = 0.0
        return np.linalg.solve(gram[:, :-1, :-1] + penalty, gram[:, :-1, -1:])[:, :, 0]


def _newest_max(values: np.ndarray, ends: np.ndarray, rows: int = 100) -> np.ndarray:
    padded = np.concatenate((np.full(rows - 1, -np.inf), values))
    return np.lib.stride_tricks.sliding_window_view(padded, rows).max(axis=1)[ends - 1]


def predict_origins(values: np.ndarray, lengths: list[int], ends: list[int], steps: list[int]) -> dict[int, np.ndarray]:
    """Predictions at ``steps`` from each origin: ``values[:end]`` is known there and the whole history
    has ``length`` samples. Origins with too short a history are left out."""
    groups: dict[int, list] = {}
    for i, n in enumerate(lengths):
        n = min(n, CAP)
        lags = min(24, max(6, n // 5))
        if n >= max(36, lags * 3):
            groups.setdefault(lags, []).append(i)
    out: dict[int, np.ndarray] = {}
    if not groups:
        return out
    sums, at = _Sums(values), np.array(ends)
    tops = np.maximum(50.0, _newest_max(values, at) * 3.0 + 25.0)
    for lags, members in groups.items():
        for k in range(0, len(members), TOGETHER):
            own = np.array(members[k : k + TOGETHER])
            end, start = at[own], np.maximum(0, at[own] - SERIES)
            mean, scale = sums.moments(start, end)
            coef = sums.coefficients(start, end, lags, mean, scale)
            centre, top = mean + sums.shift, tops[own]
            path = np.empty((len(own), lags + max(steps)))
            path[:, :lags] = (values[end[:, None] - lags + np.arange(lags)] - centre[:, None]) / scale[:, None]
            for j in range(max(steps)):
                z = coef[:, 0] + np.einsum("ij,ij->i", path[:, j : j + lags], coef[:, 1:])
                path[:, lags + j] = (np.clip(z * scale + centre, 0.0, top) - centre) / scale
            picked = path[:, [lags + s - 1 for s in steps]] * scale[:, None] + centre[:, None]
            out.update(zip(own.tolist(), picked, strict=True))
    return out


def ar_ridge(
    hist: DataFrame, keys: Sequence[str] = ("camera_id", "session_id"), interval: float = K.SAMPLE_INTERVAL, origin: str | None = None
) -> DataFrame:
    """``(keys, rn, preds)`` for origins with enough history; one prediction per horizon.

    ``origin`` names a boolean column that marks the origins to predict from; without it all rows are.
    """
    keys = list(keys)
    steps = [S.horizon_steps(sec, interval) for _, sec in K.HORIZONS]
    schema = T.StructType(
        [*[hist.schema[k] for k in keys], T.StructField("rn", T.LongType()), T.StructField("preds", T.ArrayType(T.DoubleType()))]
    )

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        origins = np.flatnonzero(((pdf["_home"] == pdf["_chunk"]) & pdf["_origin"]).to_numpy())
        rn = pdf["rn"].to_numpy()
        found = predict_origins(pdf["value"].to_numpy(), rn[origins].tolist(), (origins + 1).tolist(), steps)
        done = sorted(found)
        out = pdf.iloc[origins[done]][[*keys, "rn"]]
        return out.assign(preds=pd.Series([found[i].tolist() for i in done], index=out.index, dtype=object))

    marked = F.coalesce(F.col(origin), F.lit(False)) if origin else F.lit(True)
    halo = with_row_halo(hist.select(*keys, "rn", "value", marked.alias("_origin")), SERIES - 1, size=ORIGINS_PER_BLOCK)
    return spread(halo, *keys, "_chunk").groupBy(*keys, "_chunk").applyInPandas(solve, schema)
