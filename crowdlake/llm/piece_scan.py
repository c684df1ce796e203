"""Piece encoding and decoding as a max-plus scan over chunks.

A sequence of pieces is the encoding of its text exactly if each two neighbours, taken alone, are encoded as
themselves; that sequence is unique. So encoding is a best path: a piece is an edge, two neighbours weigh 0 if
they are compatible and minus infinity otherwise, and the state between them is the last piece. A giant text
is cut into chunks at any character. A chunk's transfer matrix holds, for each piece that may lie across its
left border, the weight of reaching each piece that may lie across its right border. Matrices multiply in the
max-plus sense; a two-level scan over them fixes the pieces across all borders, and then every chunk traces
its own path back.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdlake.llm.common import small_batches
from crowdlake.llm.pieces import SEGMENT, SPACE, Pieces, pieces, segments
from crowdlake.operators.materialize import materialize

#: The state before the first character; other states are 64 * (characters before the border) + characters after it.
START = -1
Matrix = dict[int, dict[int, float]]


def combined(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product: best weight over the states in between."""
    out: Matrix = {}
    for i, row in a.items():
        best: dict[int, float] = {}
        for j, x in row.items():
            for k, y in b.get(j, {}).items():
                if x + y > best.get(k, -np.inf):
                    best[k] = x + y
        if best:
            out[i] = best
    return out


def traced(matrices: list[Matrix], entry: int, exit: int) -> list[tuple[int, int]]:
    """Entry and exit state of each matrix on the best path from ``entry`` to ``exit``."""
    reach = [{entry: 0.0}]
    for m in matrices:
        reach.append(combined({0: reach[-1]}, m).get(0, {}))
    states, at = [exit], exit
    for m, before in zip(reversed(matrices), reversed(reach[:-1]), strict=True):
        at = max((j for j in before if at in m.get(j, {})), key=lambda j: before[j] + m[j][at])
        states.append(at)
    states.reverse()
    return list(zip(states, states[1:], strict=False))


class Encoder:
    """Encodes with one vocabulary.

    Remembers the newest ``remember`` to twice as many segments, and as many compatible pairs at most.
    """

    def __init__(self, path: str, remember: int = 300_000):
        self.v: Pieces = pieces(path)
        self.remember = remember
        self.dtype = np.uint16 if len(self.v.text) <= 65536 else np.uint32
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.bytes = {p: np.array([i], self.dtype).tobytes() for p, i in self.v.id.items()}
        self.reach: dict[str, int] = {}  # the longest piece by its first three characters
        for p in self.v.id:
            if len(p) > 2:
                self.reach[p[:3]] = max(len(p), self.reach.get(p[:3], 0))

    def fits(self, left: str, right: str) -> bool:
        key = (left, right)
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= self.remember:
                self.pairs.clear()
            ok = self.pairs[key] = self.v.merged(left + right) == [left, right]
        return ok

    def forward(self, text: str, first: int) -> list[int]:
        """For each end the start of its last piece on the only path of weight 0, or -1.

        ``first``: where the piece that ends the entry state ends; 0 if the path starts at the text.
        """
        v, fits = self.v, self.fits
        start = [-1] * (len(text) + 1)
        start[first] = 0
        for end in range(first + 1, len(text) + 1):
            if text[end - 1] not in v.chars:
                start[end] = end - 1 if start[end - 1] >= 0 else -1
                continue
            for at in range(max(first, end - v.longest), end):
                if start[at] < 0:
                    continue
                piece = text[at:end]
                if end - at > 1 and piece not in v.id:
                    continue
                if at == 0 or fits(text[start[at] : at], piece):
                    start[end] = at
                    break
        return start

    def trace(self, text: str, start: list[int], end: int, first: int) -> list[str]:
        out = []
        while end > first:
            out.append(text[start[end] : end])
            end = start[end]
        return out[::-1]

    def segment(self, text: str) -> bytes:
        """Ids of a segment that starts at a cut. As the path is unique, the longest fitting piece is tried first."""
        known, reach, pairs, n = self.bytes, self.reach, self.pairs, len(text)
        out: list[str] = []
        at, last, dead = 0, "", set()
        while at < n:
            end = min(n, at + reach.get(text[at : at + 3], 2))
            while end > at:
                piece = text[at:end]
                if (piece in known or end == at + 1) and end not in dead:
                    ok = pairs.get((last, piece)) if last else True
                    if ok or (ok is None and self.fits(last, piece)):
                        break
                end -= 1
            if end > at:
                out.append(piece)
                at, last = end, piece
            else:  # nothing leads on from here
                dead.add(at)
                at -= len(out.pop())
                last = out[-1] if out else ""
        return b"".join([known[p] if p in known else np.array(self.v.ids_of(p), self.dtype).tobytes() for p in out])

    def segments_ids(self, parts: list[str]) -> bytes:
        known = self.known
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            pass
        if len(known) >= self.remember:
            self.old, self.known = known, {}
            known = self.known
        old = self.old
        for p in parts:
            if p not in known:
                known[p] = old[p] if p in old else self.segment(p)
        return b"".join(map(known.__getitem__, parts))

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.segments_ids(segments(text or "")), self.dtype)

    # A chunk is characters p..q of ``w``, which has up to ``longest`` characters of context on either side.

    def _cut(self, w: str, at: int) -> bool:
        """Does no piece cross position ``at``, inside ``w``?"""
        return "\n" in (w[at - 1], w[at]) or (w[at] == SPACE != w[at - 1])

    def _next_cut(self, w: str, at: int) -> int:
        """The first cut from ``at`` on, or the end of ``w``."""
        while at < len(w) and not self._cut(w, at):
            at += 1
        return at

    def _across(self, w: str, p: int) -> Iterator[tuple[int, int]]:
        """Pieces that hold the character before ``p``."""
        for s in range(max(0, p - self.v.longest), p):
            for e in range(p, min(len(w), s + self.v.longest) + 1):
                if e - s == 1 or w[s:e] in self.v.id:
                    yield s, e

    def _exits(self, w: str, base: int, start: list[int], q: int, last: bool) -> list[int]:
        """Exit states among the paths of ``start``, whose text begins at ``base``."""
        ends = [q] if last else range(q, min(base + len(start) - 1, q + self.v.longest) + 1)
        return [64 * (q - base - start[e - base]) + e - q for e in ends if start[e - base] >= 0 and base + start[e - base] < q]

    def matrix(self, w: str, p: int, q: int, first: bool, last: bool) -> Matrix:
        if last:
            w = w[:q]
        cuts = (i for i in range(q - 1, p - 1, -1) if i > 0 and self._cut(w, i))
        cut = next(cuts, -1)  # the last one from which the way to the right border is the same for all entries
        tail: list[int] = []
        if cut >= 0:
            part = w[cut : min(self._next_cut(w, cut + 1), q + self.v.longest)]
            tail = self._exits(w, cut, self.forward(part, 0), q, last)
        out: Matrix = {}
        for s, e in [(p, p)] if first else self._across(w, p):
            state = START if first else 64 * (p - s) + e - p
            if e >= q:
                exits = [64 * (q - s) + e - q] if e == q or not last else []
            else:
                stop = self._next_cut(w, e + first)
                start = self.forward(w[s : min(stop, q + self.v.longest)], e - s)
                if 0 <= stop <= cut:
                    exits = tail if start[stop - s] >= 0 else []
                else:
                    exits = self._exits(w, s, start, q, last)
            if exits:
                out[state] = dict.fromkeys(exits, 0.0)
        return out

    def path(self, w: str, p: int, q: int, entry: int, exit: int) -> np.ndarray:
        """Ids of the pieces after the one across the left border, up to the one across the right border."""
        s, e = (p, p) if entry == START else (p - entry // 64, p + entry % 64)
        to = q + exit % 64
        if e >= to:
            return np.empty(0, self.dtype)
        stop = min(self._next_cut(w, e + (entry == START)), to)
        ids = [i for x in self.trace(w[s:stop], self.forward(w[s:stop], e - s), stop - s, e - s) for i in self.v.ids_of(x)]
        rest = self.segments_ids(SEGMENT.findall(w[stop : to])) if stop < to else b""
        return np.concatenate([np.array(ids, self.dtype), np.frombuffer(rest, self.dtype)])


def windows(text: str, size: int, context: int) -> Iterator[tuple[int, str, int, int, bool, bool]]:
    """Chunks of the escaped text: number, characters with context, borders in them, is it the first, the last."""
    text = SPACE + text.replace(" ", SPACE)
    for c, p in enumerate(range(0, len(text), size)):
        q, low = min(p + size, len(text)), max(0, p - context)
        yield c, text[low : q + context], p - low, q - low, p == 0, q == len(text)


@functools.cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _array(parts: list[np.ndarray]) -> pd.Series:
    return pd.Series([x.astype(np.int32) for x in parts], dtype=object)


def _plain(df: pd.DataFrame) -> pd.DataFrame:
    """With texts as objects, which become one Arrow array whatever their number."""
    return df.astype({c: object for c in ("key", "w", "matrix") if c in df})


def _packed(m: Matrix) -> str:
    return ";".join(f"{i},{j},{x!r}" for i, row in m.items() for j, x in row.items())


def _unpacked(text: str) -> Matrix:
    m: Matrix = {}
    for entry in filter(None, text.split(";")):
        i, j, x = entry.split(",")
        m.setdefault(int(i), {})[int(j)] = float(x)
    return m


def _split(path: str, size: int, rows: int = 64):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, context = ["chunk", "w", "p", "q", "first", "last"], pieces(path).longest
        for batch in batches:
            for key, text in zip(batch["key"], batch["text"], strict=True):
                ready = []
                for x in windows(text, size, context):
                    ready.append(x)
                    if len(ready) == rows or x[-1]:
                        yield _plain(pd.DataFrame(ready, columns=names).assign(key=key))
                        ready = []

    return run


def _matrices(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(path)
        for b in batches:
            rows = zip(b["w"], b["p"], b["q"], b["first"], b["last"], strict=True)
            yield _plain(b[["key", "chunk"]].assign(matrix=[_packed(encoder.matrix(*r)) for r in rows]))

    return run


def _product(pdf: pd.DataFrame) -> pd.DataFrame:
    ms = [_unpacked(m) for m in pdf.sort_values("chunk")["matrix"]]
    return _plain(pdf[["key", "block"]].head(1).assign(matrix=_packed(functools.reduce(combined, ms))))


def _block_path(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("block")
    ms = [_unpacked(m) for m in pdf["matrix"]]
    ends = functools.reduce(combined, ms)[START]
    states = traced(ms, START, max(ends, key=ends.get))
    return _plain(pdf[["key", "block"]].assign(entry=[s[0] for s in states], exit=[s[1] for s in states]))


def _chunk_path(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("chunk")
    states = traced([_unpacked(m) for m in pdf["matrix"]], int(pdf["entry"].iloc[0]), int(pdf["exit"].iloc[0]))
    return _plain(pdf[["key", "chunk"]].assign(entry=[s[0] for s in states], exit=[s[1] for s in states]))


def _paths(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(path)
        for b in batches:
            rows = zip(b["w"], b["p"], b["q"], b["entry"], b["exit"], strict=True)
            yield _plain(b[["key", "chunk"]].assign(ids=_array([encoder.path(*r) for r in rows]).to_numpy()))

    return run


def scanned(texts: DataFrame, path: str, size: int, block: int = 64) -> DataFrame:
    """``(key, tokens)`` of rows (key, text) with distinct keys, by the scan over chunks of ``size`` characters.

    Nothing but chunks, their small matrices and two borders' states goes between tasks. Products are formed
    for ``block`` chunks and then over the blocks of a text.
    """
    chunks = texts.mapInPandas(_split(path, size), "key string, chunk int, w string, p int, q int, first boolean, last boolean")
    chunks = materialize(chunks.repartition("key", "chunk"))
    number = F.floor(F.col("chunk") / block).cast("int")
    matrices = materialize(chunks.mapInPandas(_matrices(path), "key string, chunk int, matrix string").withColumn("block", number))
    products = matrices.groupBy("key", "block").applyInPandas(_product, "key string, block int, matrix string")
    borders = products.groupBy("key").applyInPandas(_block_path, "key string, block int, entry int, exit int")
    inner = (
        matrices.join(borders, ["key", "block"])
        .groupBy("key", "block").applyInPandas(_chunk_path, "key string, chunk int, entry int, exit int")
    )
    ids = chunks.join(inner, ["key", "chunk"]).mapInPandas(_paths(path), "key string, chunk int, ids array<int>")
    in_order = F.sort_array(F.collect_list(F.struct("chunk", "ids")))
    return ids.groupBy("key").agg(in_order.alias("parts")).select("key", F.flatten("parts.ids").alias("tokens"))


def encode(docs: DataFrame, path: str, text: str = "text", into: str = "tokens", size: int = 65536) -> DataFrame:
    """``docs`` with the piece ids of each whole text in ``into``, as the vocabulary's own library gives them.

    Null and empty texts have no pieces. Texts of more than ``size`` characters go through the scan, once for
    each distinct text; shorter ones are one chunk. Rows, also repeated ones, stay as they are.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(*[c for c in docs.columns if c.lower() == into.lower()])
    giant = F.coalesce(F.length(text), F.lit(0)) > size

    @F.pandas_udf("array<int>")
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(path)
        for part in texts:
            yield _array([encoder.encode(t) for t in part])

    short = docs.where(~giant).withColumn(into, tokens(F.col(text)))
    long = docs.where(giant).select(F.struct(*docs.columns).alias("row"), F.sha2(text, 256).alias("key"), F.col(text).alias("text"))
    found = scanned(long.select("key", "text").dropDuplicates(["key"]), path, size)
    long = long.drop("text").join(found, "key").select("row.*", F.col("tokens").alias(into))
    return short.unionByName(long)


def decode(docs: DataFrame, path: str, tokens: str = "tokens", into: str = "decoded") -> DataFrame:
    """``docs`` with the text of the piece ids in ``tokens``; null ids give null.

    The text comes back but for U+2581, which pieces write for a space and which comes back as one.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def texts(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = pieces(path)
        plain = [chr(v.of_byte[i]) if v.of_byte.get(i, 255) < 128 else t.replace(SPACE, " ") for i, t in enumerate(v.text)]
        wide = np.zeros(len(plain), bool)
        wide[[i for i, b in v.of_byte.items() if b >= 128]] = True
        for part in ids:
            out = []
            for x in part:
                if x is None or wide[x].any():
                    out.append(None if x is None else v.decoded(x.tolist()))
                else:
                    line = "".join(map(plain.__getitem__, x.tolist()))
                    out.append(line[1:] if line.startswith(" ") else line)
            yield pd.Series(out, dtype=object)

    return docs.withColumn(into, texts(F.col(tokens)))
