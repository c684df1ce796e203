"""URL filters: host-suffix and path-prefix expressions joined on short digest prefixes.

Each URL is expanded into the expressions a rule could have (every host suffix at a label boundary, every
path prefix of a length that some rule has). Only the first eight hex digits of an expression's SHA-256 are
joined on and shuffled; where they meet those of a rule, the full digests are compared, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdlake.llm.common import ascii_lower

#: Hex digits of the digest that are joined on.
PREFIX = 8


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def rules_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """``(action, "host/path")`` pairs as the table :func:`judge` takes."""
    rows = [(action, rule.partition("/")[0], "/" + rule.partition("/")[2]) for action, rule in rules]
    return spark.createDataFrame(rows, "action string, host string, path string")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict (columns of these names are replaced).

    ``rules`` has action (allow or block), host and path. A rule fits its host and all subdomains when the
    URL's path starts with the rule's path. The rule of most characters wins, then the one with the longer
    host, then block over allow, so repeated and contradicting rules have one result. URLs that no rule fits
    get ``default``, as do null and malformed ones. Rules with a null part are skipped. Page rows are never
    dropped or multiplied; page ids play no part.

    The driver learns only the distinct path lengths and the highest label count of the rules, both bounded
    by the length of a rule. Matching runs over distinct (host, path) pairs, so a hot URL is matched once.
    """
    rules = rules.where("action is not null and host is not null and path is not null").select(
        "action", ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path")
    )
    shape = rules.agg(
        F.collect_set(F.length("rule_path")).alias("lengths"), F.max(F.size(F.split("rule_host", r"\.", -1))).alias("labels")
    ).first()
    out = pages.drop(*[c for c in pages.columns if c.lower() in ("host", "path", "rule", "verdict")])
    host, path = host_path(F.col(url))
    out = out.withColumns({"host": host, "path": path})
    if not shape.lengths:
        return out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})

    digest = F.sha2(F.concat("rule_host", "rule_path"), 256)
    keyed = rules.groupBy("rule_host", "rule_path").agg(F.max("action").alias("action")).select(
        F.substring(digest, 1, PREFIX).alias("key"), digest.alias("rule_digest"), "action",
        F.length("rule_host").alias("host_length"), F.concat("rule_host", "rule_path").alias("rule"),
    )
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(  # the lengths of the host's last 1, 2, ... labels with their dots
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(shape.labels))),
        lambda n: F.length(F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")),
    )
    prefixes = F.filter(F.array(*map(F.lit, sorted(shape.lengths))), lambda n: n <= F.length("path"))
    expression = F.concat(F.substring("host", F.length("host") - F.col("of_host") + 1, F.col("of_host")), F.substring("path", F.lit(1), F.col("of_path")))
    # Not an equality, or it would become a second join key: both digests have 64 digits.
    confirmed = F.startswith(F.sha2(expression, 256), F.col("rule_digest"))
    found = (
        out.select("host", "path").distinct()
        .select("host", "path", F.explode(suffixes).alias("of_host"), prefixes.alias("prefixes"))
        .select("host", "path", "of_host", F.explode("prefixes").alias("of_path"))
        .withColumn("key", F.substring(F.sha2(expression, 256), 1, PREFIX))
        .join(keyed, "key").where(confirmed)
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule", "action"), F.struct(F.length("rule"), "host_length", "action")).alias("best"))
        .select("host", "path", "best.rule", F.col("best.action").alias("verdict"))
    )
    return out.join(found, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
