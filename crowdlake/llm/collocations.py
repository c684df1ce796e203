"""Phrase collocations by set-oriented mining (SETM).

The relation of a length holds that length's phrases that may be frequent, one row per occurrence: document, position of the
first word and the numbers of the words. The next length is the merge join of the relation with itself on document and adjacent
position, written in buckets of documents, so that the following joins need no exchange; its groups are counted and most of the
infrequent ones go by a broadcast bitmap of the frequent ones before the next join, so that no occurrence is shuffled again
however many phrases there are. Every part of a frequent phrase is frequent, so nothing is lost; what passes the bitmap by
chance goes at the next count.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crowdlake.llm.common import ascii_lower
from crowdlake.operators.materialize import freeing_shuffles, materialize, materialize_by, release

#: What ends a piece; within it, words are runs of anything but space and tab.
ENDS = r"[.,;:!?\x0A-\x0D]"
#: Words with their numbers that tasks hold at once, some tens of megabytes.
SMALL = 300_000
#: Bits of the bitmap for each frequent phrase, and the binary logarithm of its least and most bits (16 MB).
BITS, BITMAP = 16, (18, 27)


@contextmanager
def _joined_by_document(spark: SparkSession):
    """Within this block, joins on document and position may keep a partitioning by document alone."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Any character but ASCII and those of Latin-1 and usual punctuation that have no lower case of their own.
_CASED = r"[^\x00-\x7F\u00A0-\u00BF\u00D7\u00DF-\u00FF\u2010-\u2027\u20AC]"


def _lowered(text: Column) -> Column:
    """:func:`ascii_lower`, which looks up each character, only for texts in which ``lower`` might change more than A-Z."""
    return F.when(text.rlike(_CASED), ascii_lower(text)).otherwise(F.lower(text))


def _words(text: Column) -> Column:
    """The words of a text; the end of a piece is an element of its own, a line feed, so that words on both sides
    of it have no adjacent positions."""
    ended = F.regexp_replace(_lowered(F.coalesce(text, F.lit(""))), ENDS, " \n ")
    return F.split(ended, "[ \t]+")


_IS_WORD = "word <> '' and word <> '\n'"


def _sieve(phrases: DataFrame, words: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Drops rows whose columns ``words`` are not among ``phrases``, but for at most one in about ``BITS`` of them.

    A bitmap of the hashes, broadcast in chunks of 4,096 longs, one row each.
    """
    size = min(max((BITS * phrases.count()).bit_length(), BITMAP[0]), BITMAP[1])
    at = F.xxhash64(*words).bitwiseAND(F.lit((1 << size) - 1))
    cells = phrases.select(at.alias("_at")).selectExpr("_at >> 6 as cell", "shiftleft(1L, cast(_at & 63 as int)) as bits")
    cells = cells.unionByName(phrases.sparkSession.range(1 << (size - 6)).selectExpr("id as cell", "0L as bits"))
    cells = cells.groupBy("cell").agg(F.bit_or("bits").alias("bits"))
    chunks = cells.groupBy(F.shiftright("cell", 12).alias("_chunk")).agg(F.sort_array(F.collect_list(F.struct("cell", "bits")))["bits"].alias("_bits"))
    chunks = materialize(chunks)

    def sieved(rows: DataFrame) -> DataFrame:
        placed = rows.withColumn("_at", at).withColumn("_chunk", F.shiftright("_at", 18))
        found = placed.join(F.broadcast(chunks), "_chunk")  # 16 MB at most
        return found.where("get(_bits, cast(_at >> 6 & 4095 as int)) & shiftleft(1L, cast(_at & 63 as int)) <> 0").select(rows.columns)

    return sieved


def _hashed(seed: int) -> Column:
    """A negative number for a word."""
    return F.xxhash64(F.lit(seed), "lang", "word").bitwiseOR(F.lit(-(2**63)))


def _numbered(counts: DataFrame, least: int) -> tuple[DataFrame, Column]:
    """The frequent of all words (lang, word, f) with a number ``w1`` of their own, and the number of the others.

    About ``SMALL`` most frequent ones are counted up. The others have a hash, which a broadcast need not hold; its seed
    is one by which no frequent word meets any other.
    """
    frequent = counts.where(F.col("f") >= least)
    n, common, seed = frequent.count(), F.lit(0), 0
    if n > SMALL:
        common = F.lit(frequent.agg(F.percentile_approx("f", 1 - SMALL / n, 10000)).first()[0])
        met = lambda seed: counts.where(F.col("f") <= common).groupBy(_hashed(seed)).agg(F.count("*").alias("n"), F.max("f").alias("f"))
        while not met(seed).where((F.col("n") > 1) & (F.col("f") >= least)).isEmpty():
            seed += 1
    number = F.when(F.col("f") > common, F.monotonically_increasing_id()).otherwise(_hashed(seed))
    return materialize(frequent.withColumn("w1", number)), _hashed(seed)


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _longer(relation: DataFrame) -> DataFrame:
    """Occurrences (doc, pos, head, tail) of one word more: phrase ``head`` at a position, ``tail`` one word on.

    A merge join by place of the relation, partitioned by document, with itself.
    """
    after = relation.select("doc", (F.col("pos") - 1).alias("pos"), F.col("phrase").alias("tail"))
    return relation.withColumnRenamed("phrase", "head").hint("merge").join(after, ["doc", "pos"])


def mined(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 100, longest: int = 5, first: int = 2000
) -> DataFrame:
    """Collocations per language: lang, rank (from 1), phrase, a, l, r, n, score (numbers long).

    Texts are lower-cased (A-Z), split at ``.,;:!?`` and line ends into pieces and those at spaces and tabs into words;
    null texts are empty, a null language is ``und``. A candidate has 2 to ``longest`` words and ``a >= least`` occurrences
    within pieces, overlaps included. Cut after k words it has ``l`` and ``r`` occurrences of its parts and the score
    ``floor(1000 * a * n / (l * r))`` with ``n`` words in the language; the cut of least score counts, the smallest k
    among equals. A candidate goes if its words lie within a longer one that is as frequent. The ``first`` by score,
    a (both falling) and phrase (bytes) are returned. Repeated rows count each time. An empty table gives none.

    Counts and scores are exact: decimals of 38 digits hold ``1000 * a * n`` up to 10^17 words. A document's positions are
    merged in one task, its sort spilling to disk; a frequent word or phrase is spread with the documents that hold it and
    counted before each exchange. Only occurrences of words are shuffled, as numbers and once; about ``SMALL`` words and a bitmap are
    broadcast. The files of a length go when the next one is written. The driver sees a few numbers a length.
    """
    with freeing_shuffles(docs.sparkSession):
        known, totals = _mined(docs, lang, text, least, longest)
    return _ranked(known, totals, first)


def _mined(docs: DataFrame, lang: str, text: str, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """All frequent phrases (lang, words, f) and the words of each language (lang, n)."""
    spark = docs.sparkSession
    parts = _parts(spark)
    rows = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
        _words(F.col(text)).alias("words"),
        F.monotonically_increasing_id().alias("doc"),
    )
    counts = materialize(rows.select("lang", F.explode("words").alias("word")).where(_IS_WORD).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("f")))
    totals = materialize(counts.groupBy("lang").agg(F.sum("f").alias("n")))
    names, other = _numbered(counts, least)
    level = names.select("lang", F.array("word").alias("words"), "f", "w1")
    levels = [level]

    placed = rows.select("lang", "doc", F.posexplode("words").alias("pos", "word")).where(_IS_WORD)
    common = F.broadcast(names.where("w1 >= 0").select("lang", "word", "w1"))
    if names.where("w1 < 0").isEmpty():
        placed = placed.join(common, ["lang", "word"])
    else:
        placed = placed.join(common, ["lang", "word"], "left").withColumn("w1", F.coalesce("w1", other))
        placed = _sieve(names, ["w1"])(placed.select("doc", "pos", "w1"))
    relation = placed.select("doc", "pos", "w1").repartition(parts, "doc").select("doc", "pos", F.struct("w1").alias("phrase"))
    pairs = None
    for size in range(2, longest + 1):
        head, last = [f"w{i}" for i in range(1, size)], f"w{size}"
        longer = _longer(relation).select("doc", "pos", *[F.col(f"head.{w}").alias(w) for w in head], F.col(f"tail.{head[-1]}").alias(last))
        before = pairs
        with _joined_by_document(spark):
            pairs = materialize_by(longer, "doc", parts)
        if before:
            release(before)
        groups = materialize(pairs.groupBy(*head, last).agg(F.count(F.lit(1)).alias("f")).where(F.col("f") >= least))
        if groups.isEmpty():
            break
        heads = level.select("lang", "words", *head)
        tails = names.select(F.col("w1").alias(last), "word")
        level = materialize(groups.join(heads, head).join(tails, last).select("lang", F.concat("words", F.array("word")).alias("words"), "f", *head, last))
        levels.append(level)
        if size < longest:
            relation = _sieve(groups, [*head, last])(pairs).select("doc", "pos", F.struct(*head, last).alias("phrase"))
    if pairs:
        release(pairs)

    known = levels[0].select("lang", "words", "f")
    for longer in levels[1:]:
        known = known.unionByName(longer.select("lang", "words", "f"))
    return known, totals


def _ranked(known: DataFrame, totals: DataFrame, first: int) -> DataFrame:
    """Scores, the longer ones' claims and ranks of all frequent phrases (lang, words, f)."""
    phrases = known.where(F.size("words") > 1)
    cuts = phrases.select("lang", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("words", 1, F.col("k")), "right": F.expr("slice(words, k + 1, size(words) - k)")})
    part = lambda side, name: known.select("lang", F.col("words").alias(side), F.col("f").alias(name))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    wide = {c: F.col(c).cast("decimal(17,0)") for c in ("a", "n", "l", "r")}
    product = (F.lit(1000).cast("decimal(4,0)") * wide["a"] * wide["n"]).cast("decimal(38,0)")
    score = F.call_function("div", product, (wide["l"] * wide["r"]).cast("decimal(34,0)"))
    best = cuts.withColumn("score", score).groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inside = known.where(F.size("words") > 2).select("lang", "words", "f", F.explode(F.expr("sequence(2, size(words) - 1)")).alias("size"))
    inside = inside.select("lang", "f", "words", "size", F.explode(F.expr("sequence(1, size(words) - size + 1)")).alias("at"))
    claims = inside.select("lang", F.expr("slice(words, at, size)").alias("words"), "f").groupBy("lang", "words").agg(F.max("f").alias("claim"))
    kept = best.join(claims, ["lang", "words"], "left").where("claim is null or claim < a")

    ranked = kept.select("lang", F.concat_ws(" ", "words").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = ranked.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
