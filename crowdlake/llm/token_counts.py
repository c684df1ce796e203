"""Token counts with a whole-token shortcut.

Before any text is read, each vocabulary string is tried: which of them, standing as a pre-token, come out as
the one token that they are? A pre-token in that set counts one. Only the others are merged, once for each
distinct pre-token that a worker meets.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdlake.llm.common import small_batches
from crowdlake.llm.pieces import SEGMENT, Pieces, pieces, segments

ADDED = ["n_bytes", "n_tokens", "over_limit"]


def whole_tokens(vocabulary: Pieces) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and are merged into themselves."""
    return frozenset(p for p in vocabulary.id if SEGMENT.fullmatch(p) and vocabulary.merged(p) == [p])


class Counter:
    """Counts tokens of texts; remembers up to ``remember`` counts of pre-tokens that aren't whole tokens."""

    def __init__(self, path: str, remember: int = 1_000_000):
        self.vocabulary, self.remember = pieces(path), remember
        self.whole = dict.fromkeys(whole_tokens(self.vocabulary), 1)
        self.known = dict(self.whole)

    def merged(self, segment: str) -> int:
        v = self.vocabulary
        if len(segment) > 64:  # a long run: cut it where no piece joins two neighbours
            return sum(len(v.ids_of(p)) for part in _runs(v, segment) for p in _long(v, part))
        return sum(len(v.ids_of(p)) for p in v.merged(segment))

    def count(self, text: str | None) -> int:
        parts = segments(text or "")
        known = self.known
        try:
            return sum(map(known.__getitem__, parts))
        except KeyError:
            pass
        if len(known) > self.remember + len(self.whole):
            known = self.known = dict(self.whole)
        for p in parts:
            if p not in known:
                known[p] = self.merged(p)
        return sum(map(known.__getitem__, parts))


def _runs(v: Pieces, segment: str) -> list[str]:
    """``segment`` cut around characters that no piece has."""
    out, start = [], 0
    for i, c in enumerate(segment):
        if c not in v.chars:
            out += [segment[start:i], c] if i > start else [c]
            start = i + 1
    return out + [segment[start:]] if start < len(segment) else out


def _long(v: Pieces, text: str) -> list[str]:
    """What :meth:`Pieces.merged` gives, in n log n steps, for long runs."""
    n = len(text)
    part, after, before = list(text), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (s := v.score.get(part[i] + part[j])) is not None:
            heapq.heappush(heap, (-s, i, part[i], part[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if part[i] != left or j >= n or part[j] != right:
            continue
        part[i], part[j], after[i] = left + right, "", after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [p for p in part if p]


@functools.cache
def _counter(path: str) -> Counter:
    return Counter(path)


def with_counts(docs: DataFrame, path: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens of each whole text and over_limit (n_tokens > ``limit``).

    Null texts count as empty: no byte, no token. No begin, end or special tokens; their strings in a text
    are ordinary text. Columns named like the added ones are replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ADDED])

    @F.pandas_udf("long")
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(path)
        for part in texts:
            yield pd.Series([counter.count(t) for t in part], dtype="int64")

    return docs.withColumns(
        {"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "n_tokens": tokens(F.col(text))}
    ).withColumn("over_limit", F.col("n_tokens") > limit)
