"""URL filters: host-suffix and path-prefix expressions, matched by short hash prefixes, confirmed by full digests.

Null or malformed urls have an empty host and path and fit no rule; an empty path fits no rule either, since every
rule's path starts with a slash. Equal (key, url) rows are judged once and returned as often as they came.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of a digest that candidates and rules are joined on.
PREFIX = 8


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host after the first '://' with A-Z lower-cased, and the path up to '?', '#' or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def with_digests(rules: DataFrame) -> DataFrame:
    """rules(host, path, verdict) with the joined expression, its digest and the digest's prefix; repeats go."""
    expression = F.concat("host", "path")
    return (
        rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
        .select(expression.alias("rule"), F.sha2(expression, 256).alias("digest"), "verdict", F.length("host").alias("host_length"), F.length(expression).alias("rule_length"))
        .withColumn("prefix", F.substring("digest", 1, PREFIX))
    )


def judge(urls: DataFrame, rules: DataFrame, key: str, url: str = "url", default: str = "allow") -> DataFrame:
    """One row (key, host, path, rule, verdict) for each row of urls.

    Only shapes that rules have (labels in the host, length of the path) are expanded, so no url makes more candidates
    than there are shapes, and no rule is missed however deep the host or long the path is. Shapes are collected:
    there are as many as distinct pairs of two small integers, whatever the number of rules. Of the rules that fit, the
    longest wins, then the one with the longer host.
    """
    shapes = rules.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length")).distinct().collect()
    pairs = urls.select(F.col(key).alias("__key"), F.col(url).alias("__url"))
    host, path = split_url(F.col("__url"))
    parts = pairs.groupBy("__key", "__url").agg(F.count("*").alias("__copies")).select("__key", "__copies", "__url", host.alias("host"), path.alias("path"))
    parts = parts.withColumn("__labels", F.size(F.split("host", r"\.")))
    fits = [
        F.when((F.col("__labels") >= s["labels"]) & (F.length("path") >= s["length"]), F.concat(F.substring_index("host", ".", -s["labels"]), F.substring("path", 1, s["length"])))
        for s in shapes
    ]
    candidates = F.array_distinct(F.array_compact(F.array(*fits))) if fits else F.array().cast("array<string>")
    expanded = parts.withColumn("__candidate", F.explode_outer(candidates)).withColumn("__digest", F.sha2("__candidate", 256))
    known = with_digests(rules)
    hit = (F.substring("__digest", 1, PREFIX) == known["prefix"]) & (F.col("__digest") == known["digest"])
    best = F.max(F.when(known["rule"].isNotNull(), F.struct("rule_length", "host_length", "rule", "verdict"))).alias("__best")
    return (
        expanded.join(known, hit, "left")
        .groupBy("__key", "__url", "host", "path", "__copies").agg(best)
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
        .select(F.col("__key").alias(key), "host", "path", F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict"))
    )
