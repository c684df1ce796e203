"""Quality rules as a short-circuit cascade, in DataFrame operations only.

Cost and selectivity of each rule are estimated on a sample; the rules run in the order of rejections per
cost, and a text that one rule rejects is not looked at by the next. The order changes the work, never the
verdict.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdlake.llm.common import WORD
from crowdlake.operators.materialize import materialize

WINDOW = 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where a filter above repeats the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words in windows that occur twice or more. Only texts with such a window are sorted to find them."""
    n = F.size(words)
    hashes = F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    )

    def starts(by_hash: Column) -> Column:
        same = lambda x, k: F.coalesce(x["h"] == F.get(by_hash, k)["h"], F.lit(False))
        twice = F.filter(by_hash, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        span = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(span, F.lit(0), lambda a, x: a + x)

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        found = _let(pairs, lambda s: _let(starts(s), covered))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), found).otherwise(0)

    return F.when(n > WINDOW, _let(hashes, count)).otherwise(0)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each whole text.

    Null texts count as empty: all zero. Windows of five words are compared by a 64-bit hash within one
    text. Columns named like the added ones are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in MEASURES])
    of, taken = "_w", {c.lower() for c in docs.columns}
    while of in taken:
        of += "_"
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    of_words = _let(
        F.regexp_extract_all(t, F.lit(WORD), F.lit(0)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    of_lines = _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return (
        docs.withColumns({
            of: of_words,
            "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long"),
            "n_dup_lines": of_lines,
        })
        .withColumns({c: F.col(of)[c] for c in ("n_words", "word_chars", "n_repeat_words")})
        .drop(of)
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rules(text: str = "text") -> dict[str, Column]:
    """Named conditions that reject a text, over the text and its measures. Each is never null."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.greatest(F.col("n_words"), F.lit(1))
    without = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
    return {
        "symbols": 10 * F.col("n_symbols") > n,
        "same_lines": 5 * F.col("n_dup_lines") > 2 * (F.size(F.split(t, "\n", -1))),
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 14 * n),
        "shouting": 10 * without(r"\p{Lu}+") > 6 * F.greatest(without(r"\p{L}+"), F.lit(1)),
        "exclaiming": 2 * without(r"!+") > n,
        "digits": 2 * without(r"[0-9]+") > F.greatest(F.col("word_chars"), F.lit(1)),
    }


def ordered(docs: DataFrame, named: dict[str, Column], text: str = "text", sample_rows: int = 2000) -> list[tuple[str, float, float]]:
    """``(rule, rejected share, seconds)`` in the order of a cascade, estimated on about ``sample_rows`` rows.

    Next comes the rule that rejects most per second of what the earlier ones left; the share is that of the rest, with
    one made-up rejection and one acceptance, and 0 if nothing is left. Seconds are the least of three counts over the sample beyond the least of
    three counts without a rule. The sample steers only the order of evaluation.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = materialize(measures(docs.select(text).sample(fraction=share, seed=7), text)).where(~base_failed())

    def seconds(rejects: Column) -> float:
        taken = []
        for _ in range(3):
            start = time.perf_counter()
            sample.where(rejects).count()
            taken.append(time.perf_counter() - start)
        return min(taken)

    # One row for each combination of answers: at most 2 to the number of rules.
    answers = sample.select(F.array(*named.values()).alias("hit")).groupBy("hit").agg(F.count("*").alias("n")).collect()
    idle = seconds(F.col("n_words") < 0)
    cost = {name: max(seconds(rejects) - idle, 1e-3) for name, rejects in named.items()}
    place, rest, found = {name: i for i, name in enumerate(named)}, [(r.hit, r.n) for r in answers], []
    while cost:
        rows = sum(n for _, n in rest)
        left = {name: (sum(n for hit, n in rest if hit[place[name]]) + 1) / (rows + 2) if rows else 0.0 for name in cost}
        name = min(cost, key=lambda x: (-left[x] / cost[x], cost[x], x))
        found.append((name, left[name], cost.pop(name)))
        rest = [(hit, n) for hit, n in rest if not hit[place[name]]]
    return found


def judge(docs: DataFrame, text: str = "text", sample_rows: int = 2000) -> DataFrame:
    """``docs`` with the measures, base_failed and kept: neither the base nor a rule rejects the text.

    Null and empty texts fail the base. Repeated rows are judged alike; no row is dropped.
    """
    named = rules(text)
    verdict = F.when(F.col("base_failed"), False)
    for name, _, _ in ordered(docs, named, text, sample_rows):
        verdict = verdict.when(named[name], False)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("base_failed", "kept")])
    return measures(docs, text).withColumn("base_failed", base_failed()).withColumn("kept", verdict.otherwise(True))
